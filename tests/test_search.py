"""Retrieval against brute force: BM25 by definition, cosine in blocks, analyzers by golden cases, and odd tables."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import analyzers as A
from tidemark.functions import canonical
from tidemark.operators import retrieval as R


@pytest.mark.parametrize(
    "analyzer, text, words",
    [
        ("plain", "Moisturizing creams", ["moisturizing", "creams"]),
        ("english", "Moisturizing creams", ["moistur", "cream"]),
        ("plain", "Lancôme's Génifique", ["lancome's", "genifique"]),
        ("english", "Lancôme's Génifique", ["lancom", "genifiqu"]),
        ("english", "the brushes were shedding", ["brush", "were", "shed"]),
        ("plain", "the brushes were shedding", ["the", "brushes", "were", "shedding"]),
        ("plain", "SPF 50 sunscreen", ["spf", "50", "sunscreen"]),
        ("english", None, []),
        ("plain", " ", []),
    ],
)
def test_analyzers(analyzer, text, words):
    assert A.ANALYZERS[analyzer](text) == words


@pytest.mark.parametrize("word, root", [p.split(":") for p in (
    "caresses:caress ponies:poni cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat sized:size hopping:hop tanned:tan falling:fall hissing:hiss failing:fail "
    "filing:file happy:happi sky:sky relational:relat digitizer:digit triplicate:triplic formalize:formal hopeful:hope goodness:good revival:reviv adjustable:adjust replacement:replac adoption:adopt "
    "probate:probat rate:rate cease:ceas controll:control roll:roll"
).split()])
def test_stems(word, root):
    assert A.stem(word) == root


def docs_of(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, title string, query_id string, rank int")
    return df.select("doc_id", "query_id", "rank", *(canonical.tokens(F.col(f)).alias(f) for f in ("text", "title")))


def by_definition(rows, queries, k):
    words = lambda t: (t or "").split()
    out = {}
    for f, boost in ((1, 2.0), (2, 1.0)):
        full = [r for r in rows if words(r[f])]
        mean = sum(len(words(r[f])) for r in full) / max(1, len(full))
        for q, text in queries:
            for r in full:
                tf, s = Counter(words(r[f])), 0.0
                for t, times in Counter(words(text)).items():
                    df = sum(t in words(x[f]) for x in full)
                    if tf[t]:
                        s += boost * times * math.log(1 + (len(full) - df + 0.5) / (df + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(words(r[f])) / mean))
                if s:
                    out[q, r[0]] = max(s, out.get((q, r[0]), 0))
    best = {}
    for q, _ in queries:
        best[q] = sorted((d for x, d in out if x == q), key=lambda d: (-round(out[q, d], 9), d))[:k]
    return best


@pytest.mark.parametrize("entries", [2_000_000, 20])
def test_bm25_equals_its_definition(spark, monkeypatch, entries):
    monkeypatch.setattr(R, "ENTRIES", entries)
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 20))), " ".join(rng.choices(vocab, k=3)) if i % 3 else None) for i in range(80)]
    rows += [(100, None, None), (101, "", " "), (102, rows[3][1], rows[3][2]), (103, "w1 " * 3000, "w2")]
    queries = [(f"q{i}", " ".join(rng.choices(vocab, k=rng.randint(1, 6)))) for i in range(15)] + [("none", "zzz"), ("null", None)]
    asked = R.query_terms(spark.createDataFrame(queries, "query_id string, text string"))
    got = {}
    for r in R.bm25(docs_of(spark, rows), {"text": 2.0, "title": 1.0}, asked, 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == {q: d for q, d in by_definition(rows, queries, 7).items() if d}


def test_bm25_of_empty_tables_and_scopes(spark):
    d = docs_of(spark, [(1, "a b", None), (2, "a", "b")])
    asked = R.query_terms(spark.createDataFrame([("1", "a")], "query_id string, text string"))
    assert R.bm25(d.limit(0), {"text": 1.0}, asked, 3).count() == 0 == R.bm25(d, {"text": 1.0}, asked.limit(0), 3).count()
    assert [r.doc_id for r in R.bm25(d, {"text": 1.0}, asked, 3, among=F.col("doc_id") == 1).collect()] == [1]
    assert [r.doc_id for r in R.bm25(d, {"text": 1.0}, asked, 3, itself=False).collect()] == [2]


@pytest.mark.parametrize("block", [4096, 3])
def test_cosine_search_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK", block)
    x = np.random.default_rng(3).normal(size=(60, 5))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(60, [float(v) for v in x[7] * 2]), (70, None), (71, []), (72, [0.0] * 5), (73, [float("nan")] * 5), (74, [1.0])]
    v = spark.createDataFrame(rows, "vec_id bigint, v array<double>")
    q = v.where("vec_id % 10 = 7 or vec_id > 70").select(F.col("vec_id").cast("string").alias("query_id"), F.col("v").alias("q"))
    got = {}
    for r in R.cosine_knn(v, q, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    u = np.concatenate([x, x[7:8] * 2])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = {}
    for i in range(7, 60, 10):
        s = u @ u[i]
        want[str(i)] = sorted((j for j in range(61) if j != i), key=lambda j: (-round(s[j], 9), j))[:4]
    assert got == want


def test_measures_count_complete_queries_only(spark):
    run = spark.createDataFrame([("a", k, k == 2) for k in range(1, 11)] + [("b", k, None if k == 9 else True) for k in range(1, 11)] + [("c", 1, True)], "query_id string, rank int, relevant boolean")
    q = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 2)], "query_id string, stratum int")
    assert [(r.stratum, r.queries, r.complete, r.precision_at_5, r.mrr_at_10) for r in R.measures(run, q).orderBy("stratum").collect()] == [(1, 2, 1, 0.2, 0.5), (2, 2, 0, None, None)]
