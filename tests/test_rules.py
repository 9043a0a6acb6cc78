"""Terms, citation contract, star rule, agreement, collisions, controls and watermark: hand cases and former bounds."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import citations, collisions, matching, ordering, scoring, terms


def terms_of(spark, text):
    return {r.term for r in terms.document_terms(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()}


def test_candidate_terms(spark):
    assert len(terms.STOPWORDS) == len(set(terms.STOPWORDS)) == 117
    got = terms_of(spark, "It does not work at all")
    assert got == {"work", "not work", "work at"}
    assert terms_of(spark, "It doesn’t work") == {"work", "doesn't", "it doesn't", "doesn't work"}
    assert terms_of(spark, None) == set() == terms_of(spark, " . ")


def mined(spark, docs, corpus=1000, **how):
    t = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(docs)], "doc_id bigint, text string")
    th = spark.createDataFrame([(i, theme) for i, (theme, _) in enumerate(docs)], "doc_id bigint, theme string")
    return {(r.theme, r.term): r.odds for r in terms.mine(terms.document_terms(t), th, corpus, **how).collect()}


def test_mined_terms_have_one_owner_and_plain_odds(spark):
    docs = [("scent", "awful chemical smell"), ("scent", "chemical smell again"), ("scent", "the smell is chemical"), ("damage", "arrived cracked and broken"),
            ("damage", "arrived broken in the box"), ("damage", "box arrived cracked, chemical")]
    got = mined(spark, docs, odds=2.0)
    assert got["scent", "chemical"] == 3.0 and got["damage", "arrived"] == float("inf")
    assert len({t for _, t in got}) == len(got)
    # equal odds: the last theme by name owns the term
    assert set(mined(spark, [("a", "zebra"), ("a", "zebra"), ("b", "zebra"), ("b", "zebra"), *[("c", "other")] * 8], odds=2.0)) >= {("b", "zebra")}
    assert ("scent", "chemical") not in mined(spark, docs, corpus=7, common=0.5, odds=2.0)
    with pytest.raises(ValueError, match="odds"):
        mined(spark, docs, odds=1.0)


def test_every_owned_term_is_mined_and_matched(spark):
    docs = [("many", " ".join(f"word{i}" for i in range(200)))] * 2 + [("few", "other thing")] * 2
    assert sum(theme == "many" for theme, _ in mined(spark, docs)) == 399  # 200 words, 199 pairs
    assert sum(theme == "many" for theme, _ in mined(spark, docs, most=120)) == 120
    t = terms.document_terms(spark.createDataFrame([(i, theme, text) for i, (theme, text) in enumerate(docs)], "doc_id bigint, theme string, text string"), keep=("theme",))
    got = terms.matched(t.drop("theme"), terms.mine(t, t.select("doc_id", "theme").distinct(), 1000))
    assert sorted(tuple(r) for r in got.collect()) == [(0, "many", 399), (1, "many", 399), (2, "few", 2), (3, "few", 2)]


def test_matches_shuffle_few_terms_that_nobody_owns(spark):
    texts = [*((i, f"zebra zebra zebra stripe alpha{i % 40}") for i in range(80)), (None, "zebra"), (900, None), (901, "the of and"), (902, "plain")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    owned = spark.createDataFrame([("zebra", "z"), ("stripe", "s"), ("zebra stripe", "s"), *((f"absent{i}", "a") for i in range(50))], "term string, theme string")
    once, places = terms.document_terms(docs), terms.term_places(docs)
    assert sorted(map(str, once.collect())) == sorted(map(str, places.distinct().collect())) and places.count() > once.count()
    kept = {r.term for r in terms.possible(places, owned, 1024).collect()}
    assert kept >= {"zebra", "stripe", "zebra stripe"} and len(kept) < 20 < once.select("term").distinct().count()
    want = sorted([(i, t, n) for i in range(80) for t, n in (("s", 2), ("z", 1))] + [(None, "z", 1)], key=str)
    for bits in (64, 2**24):  # a bitmap with every bit set keeps all rows; the join decides
        assert sorted((tuple(r) for r in terms.matched(places, owned, bits).collect()), key=str) == want
    assert terms.matched(places, owned.where("false")).count() == 0


def test_a_theme_beside_the_term_needs_no_join(spark):
    docs = spark.createDataFrame([(1, "a", "zebra"), (2, "a", "zebra"), (3, "b", "other"), (4, None, "zebra")], "doc_id bigint, theme string, text string")
    themes = docs.select("doc_id", "theme").where("theme is not null")
    beside = terms.mine(terms.document_terms(docs, keep=("theme",)), themes, 100)
    joined = terms.mine(terms.document_terms(docs), themes, 100)
    assert beside.collect() == joined.collect() and [r.term for r in beside.collect()] == ["zebra"]


CONTRACT = {
    # name: (status, refused, reason, claims as lists of (handle, window), broken rules with times)
    "sound": ("succeeded", False, None, [[("R1", "baseline")], [("R1", "baseline"), ("R2", "recent")]], {}),
    "clean refusal": ("succeeded", True, "no review says so", [], {}),
    "failed": ("parse_failed", False, None, [[("R9", "x")]], {"terminal": 1}),
    "no status": (None, True, None, [], {"terminal": 1}),
    "refusal that cites": ("succeeded", True, "but see", [[("R1", "baseline")]], {"refusal_empty": 2}),
    "refusal without reason": ("succeeded", True, "  ", [], {"refusal_empty": 1}),
    "no claims": ("succeeded", False, None, [], {"claims_cite": 1}),
    "bare claims": ("succeeded", False, None, [[], [], [("R1", "baseline")]], {"claims_cite": 2}),
    "not retrieved": ("succeeded", False, None, [[("R99", "baseline")]], {"citations_retrieved": 1}),
    "undeclared window": ("succeeded", False, None, [[("R1", "scope")]], {"citations_in_scope": 1}),
    "relabelled window": ("succeeded", False, None, [[("R1", "recent")]], {"citations_in_scope": 1}),
    "outside its window": ("succeeded", False, None, [[("R3", "baseline")]], {"citations_in_scope": 1}),
    "first and last month": ("succeeded", False, None, [[("R1", "baseline"), ("R4", "baseline")]], {}),
}


def test_contract(spark):
    cites = "array<struct<cite_id:string,window:string>>"
    answers = spark.createDataFrame([(q, s, r, w) for q, (s, r, w, _, _) in CONTRACT.items()], "question_id string, status string, refused boolean, reason string")
    claims = spark.createDataFrame([(q, f"c{i}", c) for q, (*_, cs, _) in CONTRACT.items() for i, c in enumerate(cs)], f"question_id string, claim string, citations {cites}")
    shown = [("R1", "baseline", 10), ("R2", "recent", 25), ("R3", "baseline", 16), ("R4", "baseline", 15)]
    retrieved = spark.createDataFrame([(q, *x) for q in CONTRACT for x in shown], "question_id string, cite_id string, window string, ix int")
    scopes = spark.createDataFrame([(q, *x) for q in CONTRACT for x in (("baseline", 10, 15), ("recent", 20, 25))], "question_id string, window string, lo int, hi int")
    got = {}
    for r in citations.violations(answers, claims, retrieved, scopes).collect():
        got.setdefault(r.question_id, {})[r.rule] = r.times
    assert got == {q: v for q, (*_, v) in CONTRACT.items() if v}


def test_star_rule_of_many_themes(spark):
    rows = [(i, i % 5 + 1, [f"t{i % 1500}"]) for i in range(3000)] + [(9000, 1, None), (9001, 2, [])]
    got = scoring.star_rule(spark.createDataFrame(rows, "id int, rating int, themes array<string>")).collect()
    assert len(got) == 1500 and all(r.tp == 2 and r.fn == 0 for r in got)


def test_pooled_agreement(spark):
    df = spark.createDataFrame([(1, "x", "a"), (1, "y", "a"), (2, "x", "a"), (2, "y", "b"), (3, "x", "b")], "id int, rater string, label string")
    r = scoring.pooled_agreement(df, "x", "y").first()
    assert (r["items"], r.labels, r.equal_sets, r.decisions, r.agreed) == (2, 2, 1, 4, 2) and r.kappa == 0.0


def test_a_review_with_very_many_copies_has_two_leaders(spark):
    rows = spark.range(6000).selectExpr(
        "if(id % 3 = 0, 'hot', concat('r', id % 1000)) review_id", "5 rating", "'t' title", "repeat('x', cast(id % 7 as int)) text", "true verified_purchase", "cast(id % 5 as int) helpful_vote", "'a' asin", "0 image_count",
        "0 kafka_partition", "id kafka_offset",
    )
    c = collisions.classify(rows)
    hot = c.where("review_id = 'hot'")
    assert hot.where("selection_rank = 1").count() == 1 == hot.where("selection_rank = 2").count() and hot.count() == 2000
    best = hot.where("is_survivor").first()
    assert (best.helpful_vote, len(best.text), best.collision_class) == (4, 6, "conflicting")
    assert c.where("is_survivor").count() == rows.select("review_id").distinct().count()
    assert "WindowGroupLimit" in collisions.leaders(rows)._jdf.queryExecution().executedPlan().toString()


def test_an_episode_without_its_point_is_an_error(spark):
    p = spark.createDataFrame([("A", "2020-01", 1)], "parent_asin string, point_month string, ix int")
    e = spark.createDataFrame([("A", "2020-02", "A:x")], "parent_asin string, alert_triggered_at string, episode_id string")
    with pytest.raises(Exception, match="no evaluation point of episode A:x"):
        matching.candidate_points(p, e).collect()


@pytest.mark.parametrize("chunk", [1, 2, 10_000])
def test_watermark_over_ranges_of_batches(spark, chunk):
    ts = [0, 50, 10, 90, 5, 80, 95, 20, 300, 100, 110, 250, 240, 10]
    pos = spark.createDataFrame(list(enumerate(ts)), "pos bigint, ts_ms bigint")
    want = [i for i, t in enumerate(ts) if i // 2 >= 2 and t < max(ts[: (i // 2 - 1) * 2]) - 30]
    assert sorted(r.pos for r in ordering.simulate_watermark(pos, 2, 30, chunk).collect()) == want and want


def test_first_at_or_after_skips_empty_days(spark):
    day = 86_400_000
    pos = spark.createDataFrame([(0, 5), (1, day), (2, 9 * day)], "pos bigint, ts_ms bigint")
    t = spark.createDataFrame([(1, 0), (2, 6), (3, day + 1), (4, 4 * day), (5, 10 * day)], "id int, target_ms bigint")
    assert [(r.id, r.pos) for r in ordering.first_at_or_after(t, pos).orderBy("id").collect()] == [(1, 0), (2, 1), (3, 2), (4, 2), (5, None)]
