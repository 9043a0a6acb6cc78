"""Hand traces of the decline machine, golden encodings, and table versions."""

import hashlib
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidemark.functions import canonical as C
from tidemark.operators import decline, matching, ordering, retrieval, terms
from tidemark.session import scratch
from tidemark.sources.versioned import VersionedTable

RULE = decline.Rule(baseline=3, recent=3, delta=0.5, persistence=2, max_gap=1, recovery=2, min_reviews=6, min_active=2)
CALENDAR = "parent_asin string, ix int, review_count bigint, rating_sum double, neg_count bigint, verified_count bigint, verified_rating_sum double, nonempty_text_count bigint, long_text_count bigint"
JANUARY = 2015 * 12


def calendar(spark, products):
    """Months from January 2015 on, four reviews each; ``products`` maps a name to runs of months as (mean or None, how many)."""
    rows = []
    for name, runs in products.items():
        months = [mean for mean, times in runs for _ in range(times)]
        rows += [(name, JANUARY + i, *((0, 0.0, 0, 0, 0.0, 0, 0) if m is None else (4, 4 * m, 0, 4, 0.0, 4, 2))) for i, m in enumerate(months)]
    return spark.createDataFrame(rows, CALENDAR)


# Runs of months, changes of the rule, and per episode: condition start, alert, close, reason.
TRACES = {
    "flat": ([(4.5, 10)], {}, []),
    "step": ([(4.5, 6), (3.5, 6)], {}, [("2015-05", "2015-06", "2015-09", "recovery")]),
    "gap": ([(4.5, 4), (3.0, 3), (None, 3), (3.0, 4)], {"max_gap": 0}, [("2015-03", "2015-04", "2015-06", "gap")]),
    "twice": ([(4.5, 4), (3.0, 4), (4.5, 6), (3.0, 4)], {}, [("2015-03", "2015-04", "2015-07", "recovery"), ("2015-12", "2016-01", "2016-03", "end_of_data")]),
}


@pytest.mark.parametrize("name", TRACES)
def test_traces(spark, name):
    runs, change, expected = TRACES[name]
    rule = replace(RULE, **change)
    found = decline.episodes(decline.points(calendar(spark, {"A": runs}), rule), rule).orderBy("condition_started_at").collect()
    assert [(e.condition_started_at, e.alert_triggered_at, e.episode_closed_at, e.closed_by) for e in found] == expected


def test_points_of_a_step_and_of_a_hole(spark):
    step, hole = [(4.5, 6), (3.5, 6)], [(4.5, 5), (3.4, 1), (None, 2), (3.4, 4)]
    p = decline.points(calendar(spark, {"S": step, "H": hole, "F": [(4.5, 10)]}), RULE).cache()
    at = {(r.parent_asin, r.point_month): r for r in p.collect()}
    assert sum(a == "F" for a, _ in at) == 5 and all(at["F", f"2015-0{m}"].evaluable for m in range(3, 8))
    assert [at["H", f"2015-0{m}"].condition for m in (3, 4)] == [False, True] and at["H", "2015-05"].unevaluable_reason == "recent_reviews"
    (e,) = decline.episodes(p.where("parent_asin = 'S'"), RULE).collect()
    assert (e.alert_complete_month, e.last_supported_at, e.drop_at_alert) == ("2015-09", "2015-07", pytest.approx(1.0))
    of = {r.point_month: r.episode_id for r in decline.point_episodes(p, decline.episodes(p, RULE)).where("parent_asin = 'S'").collect()}
    assert (of["2015-04"], of["2015-05"], of["2015-09"]) == (None, "S:2015-05", "S:2015-05")


def test_holdout_points_are_withheld_until_the_rule_is_frozen(spark):
    months = calendar(spark, {"A": [(4.5, 12)]})
    open_rule = replace(RULE, holdout_ix=JANUARY + 6, frozen=False)
    last = lambda rule: decline.points(months, rule).agg(F.max("ix")).first()[0]
    assert last(open_rule) == JANUARY + 5 and last(replace(open_rule, frozen=True)) == last(RULE) == JANUARY + 8


def test_fold_equals_a_plain_machine(spark):
    rng = random.Random(5)
    months = calendar(spark, {f"P{i}": [(rng.choice([None, 5.0, 4.0, 3.0, 2.0]), 1) for _ in range(40)] for i in range(40)})
    p = decline.points(months, RULE).cache()
    want = []
    by = {}
    for r in sorted(p.collect(), key=lambda r: r.ix):
        by.setdefault(r.parent_asin, []).append(r)
    for a, rows in by.items():
        run_, ep, misses, gaps = [], None, 0, 0
        for r in rows:
            if ep is None:
                run_ = [*run_, r] if r.condition else []
                if len(run_) >= RULE.persistence:
                    ep, misses, gaps = {"start": run_[0].ix, "n": len(run_), "top": r.drop}, 0, 0
                continue
            shut = None
            if not r.evaluable:
                gaps += 1
                shut = "gap" if gaps > RULE.max_gap else None
            else:
                gaps, ep["n"] = 0, ep["n"] + 1
                misses = 0 if r.condition else misses + 1
                ep["top"] = max(ep["top"], r.drop) if r.condition else ep["top"]
                shut = "recovery" if misses >= RULE.recovery else None
            if shut:
                want.append((a, ep["start"], r.ix, shut, ep["n"], round(ep["top"], 9)))
                ep, run_ = None, []
        if ep:
            want.append((a, ep["start"], rows[-1].ix, "end_of_data", ep["n"], round(ep["top"], 9)))
    key = lambda m: int(m[:4]) * 12 + int(m[5:]) - 1
    got = [(e.parent_asin, key(e.condition_started_at), key(e.episode_closed_at), e.closed_by, e.evaluable_points, round(e.max_drop, 9)) for e in decline.episodes(p, RULE).collect()]
    assert sorted(got) == sorted(want) and len({w[3] for w in want}) == 3


def test_golden_encodings(spark):
    df = spark.createDataFrame([(" u1 ", "B00ABC", 1262304000000)], "u string, p string, t bigint")
    assert df.select(C.review_key(F.col("u"), F.col("p"), F.col("t"))).first()[0] == "a2ae6da56fcbdb26d485528fb03cf2281fd375db493a58d3fb97f7b3f2aa9b4f"
    x = spark.createDataFrame([(1, "", None, False, 0, "X", "[]")], "r int, t string, x string, v boolean, h int, a string, i string")
    assert x.select(C.content_hash(*(F.col(c) for c in "rtxvhai"))).first()[0] == "cfb7a986a6e7f4f9e6eb95c0c7b8e01482f8019de0b249dedd5b73ae9d54e1c6"


@pytest.mark.parametrize("text", [None, "", " ", "a", "a b", "a\tb c", "a　b c", "x\x1cy", "x​y", "one\r\ntwo", "  lead and trail  "])
def test_word_count_is_split(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(C.word_count(F.col("t"))).first()[0]
    assert got == len((text or "").split())


def test_draw_key(spark):
    got = spark.createDataFrame([("id7",)], "i string").select(C.draw_key(F.col("i"), 3, "s")).first()[0]
    assert got == int.from_bytes(hashlib.sha256(b"3\x1fs\x1fid7").digest()[:8], "big") / 2**64


def test_stratified_equals_greedy(spark):
    rng = random.Random(1)
    rows = [(f"r{i}", f"p{rng.randint(0, 5)}", rng.randint(1, 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "review_id string, parent_asin string, rating int")
    got = {(r.review_id, r.stratum) for r in matching.stratified(df, F.when(F.col("rating") <= 2, "low").otherwise("high"), {"low": 9, "high": 7}, 1, "x", 2).collect()}
    key = lambda i: int.from_bytes(hashlib.sha256(f"1\x1fx\x1f{i}".encode()).digest()[:8], "big") / 2**64
    want = set()
    for stratum, quota in (("low", 9), ("high", 7)):
        per, n = {}, 0
        for i, p, _ in sorted((r for r in rows if (r[2] <= 2) == (stratum == "low")), key=lambda r: (key(r[0]), r[0])):
            if n < quota and per.get(p, 0) < 2:
                per[p] = per.get(p, 0) + 1
                n += 1
                want.add((i, stratum))
    assert got == want


def test_fusion_ties_by_id(spark):
    leg = lambda rows: spark.createDataFrame(rows, "query_id string, doc_id bigint, rank int")
    got = retrieval.fuse({"a": leg([("q", 1, 1), ("q", 2, 2), ("q", 9, 51)]), "b": leg([("q", 2, 1), ("q", 1, 2)])}).orderBy("rank").collect()
    assert [(r.doc_id, r.rank, r.a_rank, r.b_rank) for r in got] == [(1, 1, 1, 2), (2, 2, 2, 1)]


def test_empty_windows_are_greedy(spark):
    m = spark.createDataFrame([("A", 0), ("A", 20), ("A", 26), ("A", 33)], "parent_asin string, ix int")
    assert [(r.lo, r.hi) for r in terms.empty_windows(m).orderBy("lo").collect()] == [(1, 6), (7, 12), (13, 18), (27, 32)]


def test_positions_are_total(spark):
    df = spark.range(5000).selectExpr("id", "cast(rand(3) * 50 as int) k")
    rows = ordering.numbered(df.repartition(7), "k", "id").orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(5000)) and [(r.k, r.id) for r in rows] == sorted((r.k, r.id) for r in rows)


def test_versions(spark):
    t = VersionedTable(spark, scratch(spark, "t"))
    with pytest.raises(LookupError):
        t.read()
    assert t.write(spark.range(5), "a") == 1
    assert t.append(spark.range(5, 8), "b") == 2
    assert t.merge(spark.range(1).selectExpr("id"), ["id"], "c") == 3
    assert (t.read(1).count(), t.read(2).count(), t.read().count(), t.read(t.of_run("b")).count()) == (5, 8, 8, 8)
    assert [r.version for r in t.snapshots().orderBy("version").collect()] == [1, 2, 3]
    with pytest.raises(LookupError):
        t.read(9)
