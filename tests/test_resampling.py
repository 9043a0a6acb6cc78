"""Resampling and calibration over whole grids and draws."""

import random

import pytest

from tidemark.operators import calibration, citations, decline
from tidemark.plans import measures


def spine(spark, products=12, months=30):
    rng = random.Random(5)
    rows = []
    for p in range(products):
        for ix in range(rng.randint(2, months)):
            n = rng.choice([0, 1, 3, 6, 9])
            rows.append((f"P{p}", ix, n, float(sum(rng.randint(1, 5) for _ in range(n))), 0, 0, 0.0, 0, 0))
    names = ("parent_asin", "ix", *decline.MEASURES)
    return spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(names, ("string", "int", "bigint", "double", "bigint", "bigint", "double", "bigint", "bigint")))).repartition(1).cache()


def plainly(m, rule):
    p = decline.points(m, rule)
    e = decline.episodes(p, rule)
    return p.count(), p.where("evaluable").count(), e.count(), e.select("parent_asin").distinct().count()


RULES = calibration.grid(decline.Rule(max_gap=2, recovery=3, min_reviews=7), delta=[0.2, 0.5], recent=[2, 4], persistence=[1, 3])


def test_grid_equals_the_rule_by_rule_episodes(spark):
    m = spine(spark)
    got = {r.config: (r.points, r.evaluable, r.alerts, r.products) for r in calibration.grid_alerts(m, RULES).collect()}
    some = list(RULES)[::3]
    assert set(got) == set(RULES) and {k: got[k] for k in some} == {k: plainly(m, RULES[k]) for k in some}
    assert any(v[2] > 1 for v in got.values())


def test_a_comparable_point_ends_a_gap(spark):
    import numpy as np

    rule = decline.Rule(persistence=1, max_gap=1, recovery=3)
    points = [(1, 1), (0, 0), (1, 0), (0, 0), (1, 1), (0, 0), (0, 0), (1, 1)]
    rows = [("P", i, bool(e), bool(c) if e else None, 4.0, 3.0, 1.0) for i, (e, c) in enumerate(points)]
    df = spark.createDataFrame(rows, "parent_asin string, ix int, evaluable boolean, condition boolean, baseline_mean double, recent_mean double, drop double")
    ok, cond = (np.array([[p[k]] for p in points], bool) for k in (0, 1))
    assert decline.episodes(df, rule).count() == 2 and calibration._opens(ok, cond, rule).sum(axis=0).tolist() == [2]


def test_placebo_scores_the_permuted_spines(spark):
    m, name = spine(spark, 6), list(RULES)[0]
    want = [plainly(calibration.permuted_blocks(m, 6, r, 11), RULES[name]) for r in (1, 2)]
    (r,) = calibration.placebo(m, {name: RULES[name]}, 6, 2, 11).collect()
    assert (r.replicates, r.evaluable, r.alerts) == (2, sum(x[1] for x in want), sum(x[2] for x in want)) and r.alerts > 0


def test_registered_sizes():
    assert len(measures.CALIBRATED) == 144 and (measures.REPLICATES, measures.BLOCK, measures.DRAWS) == (24, 6, 1000)


def test_bound_of_every_case_prefers_the_certain_decline(spark):
    rows = [("many", 0, r) for r in [5, 4] * 100] + [("many", 1, r) for r in [3, 2] * 100] + [("few", 0, 5), ("few", 0, 4), ("few", 1, 3), ("few", 1, 1), ("none", 0, 5)]
    rows += [(f"p{i:03}", ix, 5) for i in range(70) for ix in (0, 1)]
    w = [(p, n, ix, ix) for p in {r[0] for r in rows} for n, ix in (("baseline", 0), ("recent", 1))]
    got = citations.decline_bound(spark.createDataFrame(rows, "parent_asin string, ix int, rating int"), spark.createDataFrame(w, "parent_asin string, window string, lo int, hi int")).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 73)) and got[0].parent_asin == "many" and {r.draws for r in got} == {2000}
    assert 1.8 < got[0].bound < 1.95 and {r.bound for r in got if r.parent_asin[0] == "p"} == {0.0}
    with pytest.raises(ValueError):
        citations.decline_bound(None, None, draws=40)


def test_slots_walk_the_whole_ranking(spark):
    ranked = spark.createDataFrame([(f"e{i}", f"a{i}", i) for i in range(1, 81)], "episode_id string, parent_asin string, rank long")
    controls = spark.createDataFrame([(f"e{i}", "c", 1) for i in range(1, 80)] + [("e80", "d", 1)], "episode_id string, control_asin string, control_rank int")
    assert [(r["episode_id"], r["control_asin"]) for r in citations.distinct_slots(ranked, controls, 2)] == [("e1", "c"), ("e80", "d")]
