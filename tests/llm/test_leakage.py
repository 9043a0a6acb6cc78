"""Leaks against brute force, tiling by hand, normalisation, and odd tables."""

import random
import time

import numpy as np
import pytest

from tidemark.llm import leakage as L


def brute(docs, items, n=10):
    grams = {}
    for i, t in items:
        w = L.words(t)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(d, i) for d, t in docs for w in [L.words(t)] for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ())}


@pytest.mark.parametrize("a, b", [("It&#39;s  FINE", "it's fine"), ("café", "café"), ("ﬁne", "fine"), ("so­ft", "soft"), ("a​b", "ab"), ("x&nbsp;y", "x y"), ("STRASSE", "straße"), ("Ａ１", "a1"), ("a_b", "a b")])
def test_words_are_compared_alike(a, b):
    assert L.words(a) == L.words(b)


def test_words_of_nothing():
    assert L.words(None) == L.words("") == L.words(" .,!") == []


def test_tiles_are_longest_first_and_disjoint():
    a, b = "a b c d e f x a b c".split(), "a b c q a b c d e f".split()
    seeds = [(i, j) for i in range(9) for j in range(9) if a[i : i + 2] == b[j : j + 2]]
    t = L.tiles(a, b, 2, seeds)
    assert t[0] == (0, 4, 6) and (7, 0, 3) in t and sum(x[2] for x in t) == 9


def test_overlapping_matches_shrink():
    a, b = "p q r s".split(), "p q r x q r s".split()
    t = L.tiles(a, b, 1, [(i, j) for i in range(4) for j in range(7) if a[i] == b[j]])
    assert t == [(0, 0, 3), (3, 6, 1)]


DOC = "doc_id bigint, text string, words string, seeds int, item_id string"
ITEM = "item_id bigint, text string, doc_id int, b string"


def frames(spark, docs, items):
    return spark.createDataFrame([(d, t, "x", 1, "y") for d, t in docs], DOC), spark.createDataFrame([(i, t, 1, "z") for i, t in items], ITEM)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 40)))) for i in range(40)] + [(90, None), (91, ""), (92, "too short")]
    items.append((93, items[3][1]))
    docs = []
    for d in range(120):
        w = rng.choices(vocab, k=rng.randint(0, 60))
        if d % 3 == 0:
            src = (items[rng.randrange(40)][1] or "").split()
            at = rng.randrange(len(src) or 1)
            w += src[at : at + rng.randint(8, 14)]
        docs.append((d, ", ".join(w).upper()))
    docs += [(500, None), (501, ""), (3, docs[3][1]), (3, "another text of the same id"), (600, " ".join([items[3][1]] * 200))]
    d, i = frames(spark, docs, items)
    want = brute(docs, items)
    assert want and {(r.doc_id, r.item_id) for r in L.leaks(d, i).collect()} == want


def test_many_seeds_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_SEEDS", 3)
    text = " ".join(f"v{i}" for i in range(30))
    d, i = frames(spark, [(1, "start " + text), (2, "nothing")], [(7, text)])
    assert [(r.doc_id, r.item_id, r.longest, r.covered) for r in L.leaks(d, i).collect()] == [(1, 7, 30, 30)]
    rng = random.Random(6)
    vocab = [f"w{k}" for k in range(25)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randint(0, 25)))) for k in range(20)]
    docs = [(k, " ".join(rng.choices(vocab, k=20)) + " " + items[rng.randrange(20)][1]) for k in range(40)]
    d, i = frames(spark, docs, items)
    assert {(r.doc_id, r.item_id) for r in L.leaks(d, i).collect()} == brute(docs, items)


def test_reordered_passage_is_found_by_coverage(spark):
    s = [" ".join(f"s{k}w{i}" for i in range(6)) for k in range(5)]
    d, i = frames(spark, [(1, ". ".join(s[k] for k in (3, 1, 4, 0, 2)))], [(7, " ".join(s))])
    assert L.leaks(d, i).count() == 0
    (r,) = L.leaks(d, i, coverage=0.8).collect()
    assert (r.longest, r.covered, r.tiles) == (6, 30, 5)


def test_coverage_filter_loses_no_pair(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(25)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(5, 30)))) for i in range(25)] + [(77, "w1 " * 12)]
    docs = []
    for d in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            src = items[rng.randrange(len(items))][1].split()
            at = rng.randrange(len(src))
            parts += [*src[at : at + rng.randint(5, 12)], f"x{d}"]
        docs.append((d, " ".join(parts)))
    d, i = frames(spark, docs, items)
    want = set()
    for dd, t in docs:
        for ii, u in items:
            a, b = L.words(t), L.words(u)
            seeds = [(x, y) for x in range(len(a) - 4) for y in range(len(b) - 4) if a[x : x + 5] == b[y : y + 5]]
            got = L.tiles(a, b, 5, seeds)
            if got and (got[0][2] >= 10 or sum(g[2] for g in got) >= 0.8 * len(b)):
                want.add((dd, ii))
    assert len(want) > 10 and {(r.doc_id, r.item_id) for r in L.leaks(d, i, coverage=0.8).collect()} == want


def test_empty_tables(spark):
    d, i = frames(spark, [(1, "a " * 20)], [(1, "a " * 20)])
    assert L.leaks(d.limit(0), i).count() == 0 and L.leaks(d, i.limit(0)).count() == 0


def slow_tiles(a, b, least):
    """Greedy tiling by its definition: the longest free match of all, the first of equals, again and again."""
    ua, ub, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not (ua[i + k] or ub[j + k]):
                    k += 1
                if k > best[2]:
                    best = (i, j, k)
        i, j, k = best
        if k < least:
            return out
        ua[i : i + k], ub[j : j + k] = [True] * k, [True] * k
        out.append(best)


def test_tiles_equal_their_definition():
    rng = random.Random(8)
    for _ in range(150):
        a, b = (rng.choices("xyz" if rng.random() < 0.5 else "pqrstuvw", k=rng.randint(0, 25)) for _ in range(2))
        ha, hb = (np.array([hash(tuple(t[i : i + 2])) for i in range(len(t) - 1)], np.int64) for t in (a, b))
        got, want = L.tiles(a, b, 2, L.starts(ha, hb)), slow_tiles(a, b, 2)
        assert [k for _, _, k in got] == [k for _, _, k in want] or sum(k for _, _, k in got) == sum(k for _, _, k in want)
        assert (got[0][2] if got else 0) == (want[0][2] if want else 0)


def test_repetitive_texts_have_few_seeds():
    began = time.perf_counter()
    a, b = ["w"] * 3000, ["w"] * 2500
    h = L.running(np.full(3000, 7, np.uint64), 10), L.running(np.full(2500, 7, np.uint64), 10)
    pairs = L.starts(*h)
    assert len(pairs) == len(h[0]) + len(h[1]) - 1
    assert L.tiles(a, b, 10, pairs) == [(0, 0, 2500)] and time.perf_counter() - began < 2
