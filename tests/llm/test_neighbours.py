"""Neighbour search: exact where one list holds all, high recall where many do, copies and bad vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import neighbours as N

SCHEMA = "id string, vec array<float>, spec string, ts int, vkey string, list int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [float(x) for x in v], s, t, "clash", 1) for i, v, s, t in rows], SCHEMA)


def found(df, k, dims, **how):
    return {(r.spec, r.id, r.neighbour) for r in N.neighbours(df, k, "id", "vec", dims, "spec", "ts", **how).collect()}


def test_small_table_is_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    got = found(frame(spark, [(f"i{k:02}", v, "s", 0) for k, v in enumerate(x)]), 4, 8)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert got == {("s", f"i{a:02}", f"i{b:02}") for a in range(60) for b in np.argsort(-s[a])[:4]}


def test_what_does_not_count(spark):
    rows = [("a", [1, 0], "s", 0), ("b", [2, 0.1], "s", 0), ("n", None, "s", 0), ("e", [], "s", 0), ("l", [1, 0, 0], "s", 0), ("z", [0, 0], "s", 0), ("q", [float("nan"), 1], "s", 0),
            ("f", [float("inf"), 1], "s", 0), (None, [1, 0], "s", 0), ("a", [1, 0], "t", 0), ("b", [0, 1], "s", -1), ("b", [2, 0.1], "s", 0)]
    assert found(frame(spark, rows), 5, 2) == {("s", "a", "b"), ("s", "b", "a")}
    assert found(frame(spark, rows[:1]), 5, 2) == set() == found(frame(spark, []), 5, 2)


def test_copies_rank_by_id(spark):
    rows = [(f"c{k}", [1, 1], "s", 0) for k in range(9)] + [("x", [1, 0.9], "s", 0)]
    got = found(frame(spark, rows), 3, 2)
    assert {n for _, i, n in got if i == "c8"} == {"c0", "c1", "c2"} == {n for _, i, n in got if i == "x"}
    assert {n for _, i, n in got if i == "c1"} == {"c0", "c2", "c3"}
    pairs = N.mutual(N.neighbours(frame(spark, rows), 3, "id", "vec", 2, "spec", "ts"), 0.8)
    assert {(r.a, r.b) for r in pairs.collect()} == {("c0", "c1"), ("c0", "c2"), ("c0", "c3"), ("c1", "c2"), ("c1", "c3"), ("c2", "c3")}


def test_stated_queries_only(spark):
    rng = np.random.default_rng(2)
    rows = [(str(k), v, "s", 0) for k, v in enumerate(rng.normal(size=(40, 4)))]
    rows.append(("99", rows[7][1], "s", 0))
    assert {i for _, i, _ in found(frame(spark, rows), 3, 4, queries="cast(id as int) % 10 = 7")} == {"7", "17", "27", "37"}


def clustered(n, dims, themes, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(themes, dims))
    x = c[rng.integers(0, themes, n)] + rng.normal(size=(n, dims)) * 0.9
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def exact(x, k):
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1)[:, :k]


@pytest.mark.parametrize("shape", [N.Shape(size=120), N.Shape(size=60, fan=10, group=500), N.Shape(size=40, fan=4, group=200)])
def test_recall_over_many_lists_and_divisions(spark, shape):
    x = clustered(3000, 24, 40)
    got = found(frame(spark, [(str(k), v, "s", 0) for k, v in enumerate(x)] + [(str(k), v, "t", 0) for k, v in enumerate(x[:7])]), 5, 24, shape=shape)
    truth = exact(x, 5)
    assert sum(("s", str(a), str(b)) in got for a in range(len(x)) for b in truth[a]) / (5 * len(x)) >= 0.9
    few = exact(x[:7], 5)
    assert {(i, n) for s, i, n in got if s == "t"} == {(str(a), str(b)) for a in range(7) for b in few[a]}


def test_lists_stay_bounded(spark):
    rows = frame(spark, [(str(k), v, "s", 0) for k, v in enumerate(clustered(3000, 24, 40))])
    shape = N.Shape(size=60, fan=10, group=500)
    v = rows.select(F.col("spec"), F.lit(True).alias("wanted"), F.col("vec").alias("vector"))
    marked = N._marked(rows.select("spec", "id", "ts", F.lit(True).alias("wanted"), F.col("vec").alias("vector")), 24, 1.0).checkpoint()
    sizes = spark.createDataFrame([("s", "", 3000)], "spec string, cell string, n bigint")
    lists = [r["count"] for r in N._postings(N._vectors(v, 24), marked, sizes, 24, shape).groupBy("cell").count().collect()]
    assert len(lists) >= 40 and max(lists) <= 6 * 60


def test_more_specifications_than_the_former_bound(spark):
    rows = [(f"{s}-{k}", [1.0, k + s / 2000], f"s{s}", 0) for s in range(1001) for k in range(2)]
    assert len(found(frame(spark, rows), 1, 2)) == 2002


def test_graph_finds_the_nearest_centroids():
    x = clustered(2500, 64, 80)
    c, q = x[:2000], x[2000:]
    ids, sims = N.Graph.over(c).search(q, 4)
    true = np.argsort(-(q @ c.T), axis=1)[:, :4]
    assert np.mean([len(set(a) & set(b)) / 4 for a, b in zip(ids, true)]) > 0.95
    assert np.allclose(sims, np.take_along_axis(q @ c.T, ids, 1), atol=1e-5)


def test_lists_are_balanced():
    x = np.concatenate([clustered(4000, 16, 1), clustered(500, 16, 20)])
    c = N.balanced(x, 30)
    assert np.bincount((x @ c.T).argmax(1)).max() <= 3 * len(x) / 30 and 30 <= len(c) <= 90


def test_large_list_is_divided_again(monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 500)
    monkeypatch.setattr(N, "LIST", 100)
    x = clustered(2500, 24, 40)
    row, near, cosine = N.nearest(x, np.ones(len(x), bool), 5)
    best = {}
    for a, b, c in zip(row, near, cosine):
        best.setdefault(a, {})[b] = c
    truth = exact(x, 5)
    hit = sum(b in sorted(best[a], key=lambda y: -best[a][y])[:5] for a in range(len(x)) for b in truth[a])
    assert hit / (5 * len(x)) >= 0.9


@pytest.mark.parametrize("n", [1, 2, 3])
def test_tiny_lists(n):
    row, near, _ = N.nearest(np.eye(3, dtype=np.float32)[:n], np.ones(n, bool), 5)
    assert len(row) == n * (n - 1) and all(a != b for a, b in zip(row, near))


def test_superseded_vectors_take_no_places(spark):
    at = lambda a: [math.cos(a), math.sin(a)]
    rows = [("a", at(0.0), 1), ("b", at(0.5), 2), ("c", at(0.6), 2), ("d", at(3.0), 9)] + [("d", at(0.01 * i), i) for i in range(1, 7)]
    df = spark.createDataFrame(rows, "id string, v array<double>, ts int")
    got = {(r.id, r["rank"]): r.neighbour for r in N.neighbours(df, 2, "id", "v", 2, ts_col="ts").collect()}
    assert len(got) == 8 and (got["a", 1], got["a", 2]) == ("b", "c")
