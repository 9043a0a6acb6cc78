"""Queries that compare, order, profile, calibrate, stream and version."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import calibration, citations, classifier, decline, late, lateness, ordering, profile, scoring, spine
from ..session import scratch, shared_dir
from ..sources.tables import table
from ..sources.versioned import VersionedTable
from ..streaming import product_months
from . import text
from ..functions.keys import month_ix
from .gold import EPISODES, MONTHS, POINTS, RULE, SPINE, _MONTH, first_arrivals, months

GRID = [round(0.05 * i, 2) for i in range(1, 20)]
DRAWS, SEED = 1000, 11
# The rule fields that calibration holds fixed, the grid that it varies, blocks of months and replicates of the placebo.
CALIBRATED = calibration.grid(
    replace(RULE, max_gap=3, recovery=2, min_active=3), baseline=[6, 12], recent=[6, 12], delta=[0.3, 0.5, 0.75, 1.0], persistence=[2, 3, 4], min_reviews=[10, 20, 40]
)
BLOCK, REPLICATES = 6, 24
# Calibration sees no month from here on; steps are drawn under this rule.
HOLDOUT, REFERENCE = 2025 * 12, replace(RULE, baseline=6, recent=6, max_gap=3, recovery=2, min_active=3, min_reviews=10)


def _flat(s, d):
    """First copies with flags: theme words in the text (reference) and in the title (system)."""
    cols = ["review_id", "parent_asin", "rating", "title", "text"]
    r = table(s, d, "silver_reviews").select(*cols, "kafka_partition", "kafka_offset")
    m = r.groupBy("review_id").agg(F.min(F.struct("kafka_partition", "kafka_offset", *cols[1:])).alias("m")).select(F.col("review_id").alias("id"), "m.*")
    words = {"ref": F.lower(F.coalesce("text", F.lit(""))), "sys": F.lower(F.coalesce("title", F.lit("")))}
    theme = lambda c: F.array_compact(F.array(F.when(c.rlike("broke|stuck|bent"), "broken"), F.when(c.rlike("bad|disappoint|waste"), "regret"), F.when(c.rlike("love|great|gift"), "praise")))
    return m.select("id", "parent_asin", "rating", "text", *(theme(v).alias(k) for k, v in words.items()))


def _outcomes(s, d):
    f = _flat(s, d)
    return scoring.outcomes(f.select("id", F.explode("ref").alias("theme")), f.select("id", F.explode("sys").alias("theme")))


def _round(df):
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _clustered(s, d):
    f = _flat(s, d).select("id", F.col("parent_asin").alias("cluster"))
    o = _outcomes(s, d).join(f, "id")
    n = lambda a, b: F.sum(((F.col("ref") == a) & (F.col("sys") == b)).cast("int")).cast("long")
    return o.groupBy("cluster", "theme").agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"))


def _cuts(s, d):
    p = table(s, d, "product_month").where("neg_share is not null and mean_rating is not null")
    rows = p.select(F.lit("low").alias("theme"), F.col("neg_share").alias("score"), (F.col("mean_rating") < 3).cast("int").alias("label"))
    return scoring.best_cut(rows, GRID).withColumn("cut", F.round("cut", 2))


def _ratings(s, d):
    r = table(s, d, "reading_labels").where("level is not null and rater is not null")
    return r.groupBy(F.col("doc_id").alias("id"), "rater").agg(F.max("level").alias("label"))


def _sentiment(s, d):
    f = _flat(s, d).where("rating <> 3")
    said = F.when(F.array_contains("ref", "praise") & ~F.array_contains("ref", "broken"), "positive").when(F.array_contains("ref", "broken") & ~F.array_contains("ref", "praise"), "negative").when(F.size("ref") == 0, "none").otherwise("mixed")
    star = F.when(F.col("rating") > 3, "positive").otherwise("negative")
    return f.groupBy(star.alias("stars"), said.alias("said")).agg(F.count(F.lit(1)).alias("reviews"))


def _positions(s, d):
    e = table(s, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    return ordering.numbered(e, "ts_ms", "event_id")


def _arrival_positions(s, d):
    b = table(s, d, "review_collisions").select("kafka_partition", "kafka_offset", "ingested_at", F.unix_millis(F.col("event_ts").cast("timestamp")).alias("ts_ms")).where("ts_ms is not null").distinct()
    return ordering.numbered(b, "ingested_at", "kafka_partition", "kafka_offset").select("pos", "kafka_offset", "ts_ms")


def _release(s, d):
    p = _positions(s, d)
    late_rows = p.withColumn("k", F.sha2(F.concat_ws("\u001f", F.lit("late"), F.col("event_id").cast("string")), 256)).orderBy("k").limit(50)
    t = late_rows.select(F.col("event_id").alias("id"), (F.col("ts_ms") + 7_200_000).alias("target_ms"))
    return ordering.first_at_or_after(t, p)


def _stream_reviews(s, d):
    # copies of a review share its event time; the later position would be the later arrival, so each copy carries the first's figures
    r = first_arrivals(s, d).select("review_id", F.struct("parent_asin", "rating", "verified_purchase").alias("x"))
    every = table(s, d, "silver_reviews").select("review_id", "event_ts").join(r, "review_id")
    return every.select("review_id", F.col("event_ts").cast("timestamp").alias("event_ts"), "x.*")


def _stream(s, d):
    return product_months.run(_stream_reviews(s, d))[0]


def _injection(s, d):
    """(held rows, send order, spec): a far slice that a 30 day watermark drops and a near one that it takes, over first copies."""
    r = first_arrivals(s, d).select(F.col("review_id").alias("id"), F.unix_millis(F.col("event_ts").cast("timestamp")).alias("ts_ms"))
    pos = ordering.numbered(r, "ts_ms", "id")
    n = pos.count()
    spec = lateness.Injection(max(1, n // 200), max(1, n // 200), max(1, n // 10))
    return *lateness.plan(pos, spec), spec


def _injection_plan(s, d):
    return _injection(s, d)[0].withColumnRenamed("id", "review_id")


def _stream_gap(s, d):
    """The stream with late rows against the batch: months that differ, and that the dropped rows explain them."""
    held, order, spec = _injection(s, d)
    rows = first_arrivals(s, d).withColumn("event_ts", F.col("event_ts").cast("timestamp")).select("review_id", "event_ts", "parent_asin", "rating", "verified_purchase")
    sent = order.select(F.col("id").alias("review_id"), F.floor(F.col("slot") / F.lit(spec.batch)).cast("int").alias("batch"))
    files = sent.agg(F.max("batch")).first()[0] + 1
    stream, told = product_months.run(rows.join(sent, "review_id"), files, "batch")
    if told["dropped"] != spec.far_rows:
        raise RuntimeError(f"the stream dropped {told['dropped']} rows, the plan says {spec.far_rows}")
    figures = lambda df: product_months.project(product_months.contributions(df))
    far = held.where("slice = 'far'").select(F.col("id").alias("review_id"))
    return product_months.reconcile(stream, figures(rows), figures(rows.join(far, "review_id", "left_semi")))


def _late_stream(s, d):
    return product_months.corrected(late.arrivals(table(s, d, "silver_reviews").select("review_id", "event_ts", "rating", "kafka_partition", "kafka_offset"), table(s, d, "bronze_reviews").select("kafka_partition", "kafka_offset", "ingested_at")))


def _merged_table(s, d):
    t = VersionedTable(s, scratch(s, "products"))
    p = table(s, d, "products").select("parent_asin", "store", "rating_number")
    t.write(p, "load")
    t.merge(p.where("rating_number > 10").withColumn("rating_number", F.lit(0)), ["parent_asin"], "fix")
    return t.read().select("parent_asin", "rating_number").join(t.read(t.of_run("load")).select("parent_asin", F.col("rating_number").alias("before")), "parent_asin")


def _replaced_partitions(s, d):
    t = VersionedTable(s, scratch(s, "months"))
    p = table(s, d, "product_month").select("parent_asin", "month", "review_count").where("month is not null")
    t.write(p, "load", "month")
    t.replace_partitions(p.where("month = '2022-01'").withColumn("review_count", F.lit(-1)), "fix")
    return t.read().groupBy("month").agg(F.sum("review_count").alias("reviews"), F.count(F.lit(1)).alias("rows"))


def _citations(s, d):
    r = table(s, d, "silver_reviews").select("review_id", "parent_asin", F.expr("int(year(event_ts) * 12 + month(event_ts) - 1)").alias("ix")).distinct()
    w = text._windows(s, d)
    got = citations.handles(citations.retrieved_by_draw(r, w, 3, SEED))
    scopes = w.select(F.col("parent_asin").alias("question_id"), "window", "lo", "hi")
    # seven kinds of answers, by a hash of the product: sound, three citations at fault, no claims, a refusal with and without reason, one that failed
    pick = F.conv(F.substring(F.md5(F.col("question_id").cast("binary")), 1, 4), 16, 10).cast("int") % 8
    qs = scopes.select("question_id").distinct().withColumn("k", pick)
    answers = qs.select("question_id", F.when(F.col("k") == 7, "parse_failed").otherwise("succeeded").alias("status"), F.col("k").isin(5, 6).alias("refused"), F.when(F.col("k") == 5, "nothing said").alias("reason"))
    one = lambda c, w: F.array(F.struct(F.lit(c).alias("cite_id"), F.lit(w).alias("window")))
    cites = (
        F.when(F.col("k").isin(0, 7), one("R1", "baseline")).when(F.col("k") == 1, one("R99", "recent")).when(F.col("k") == 2, one("R1", "recent"))
        .when(F.col("k").isin(3, 6), one("R1", "other")).otherwise(F.array().cast("array<struct<cite_id:string,window:string>>"))
    )
    claims = qs.where("k <> 4").select("question_id", F.lit("c1").alias("claim"), F.when(F.col("k") != 5, cites).alias("citations")).where("citations is not null")
    bare = qs.where("k = 0 or k = 2").select("question_id", F.lit("c2").alias("claim"), F.array().cast("array<struct<cite_id:string,window:string>>").alias("citations"))
    return citations.violations(answers, claims.unionByName(bare), got, scopes)


def _decline_bounds(s, d):
    r = first_arrivals(s, d).select("review_id", "parent_asin", "rating", F.expr("int(year(event_ts) * 12 + month(event_ts) - 1)").alias("ix"))
    return citations.decline_bound(r, text._windows(s, d))


def _classified(s, d):
    shared_dir(s)
    rows = _flat(s, d).select("id", "text", F.col("ref").alias("themes"))
    encoder, models = classifier.train(rows, ["broken", "regret", "praise"])
    return classifier.predict(rows, encoder, models, {}).select("id", "theme", F.round("score", 6).alias("score"), "predicted")


def _grid_alerts(s, d):
    return calibration.grid_alerts(spine.spine(months(s, d)), CALIBRATED)


def _placebo(s, d):
    return calibration.placebo(spine.spine(months(s, d)), CALIBRATED, BLOCK, REPLICATES, SEED)


def _early(s, d):
    """Months before the holdout, with 5-star reviews, of products that can carry a point."""
    stars = first_arrivals(s, d).where("rating = 5").groupBy("parent_asin", month_ix(F.col("event_ts")).alias("ix")).agg(F.count(F.lit(1)).alias("fives"))
    m = months(s, d).join(stars, ["parent_asin", "ix"], "left").na.fill(0, ["fives"])
    return calibration.before_holdout(m, HOLDOUT, min(r.min_reviews for r in CALIBRATED.values()), min(r.baseline + r.recent for r in CALIBRATED.values()))


def _power(s, d, rules=None, effects=(0.2, 0.3, 0.5), ramps=(1, 6), mechanisms=("severe", "moderate")):
    return calibration.power(spine.spine(_early(s, d)), rules or CALIBRATED, REFERENCE, list(effects), list(ramps), 6, 3, SEED, mechanisms)


def _selected(s, d):
    """The rule that the ceiling of one placebo alert a month admits and that finds most severe steps of 0.3 stars."""
    sp = spine.spine(_early(s, d))
    watched = calibration.surveillance_months(decline.points(sp, REFERENCE)).first().months
    rates = calibration.placebo_rates(calibration.placebo(sp, CALIBRATED, BLOCK, REPLICATES, SEED), watched)
    return _round(calibration.selected(rates, _power(s, d, effects=(0.3,), ramps=(1,), mechanisms=("severe",)), CALIBRATED, 1.0, 0.8))


def _fast_path(s, d):
    """The scan of all rules at once, for the one rule that episodes are made with."""
    return calibration.grid_alerts(spine.spine(months(s, d)), {"rule": RULE}).drop("config")


def _permuted(s, d):
    p = calibration.permuted_blocks(spine.spine(months(s, d)).select("parent_asin", "ix", "review_count", "rating_sum"), 6, 1, SEED)
    return p


def _injected(s, d):
    m = months(s, d)
    start = m.groupBy("parent_asin").agg(F.floor((F.min("ix") + F.max("ix")) / F.lit(2)).cast("int").alias("at"))
    return _round(calibration.injected(m.select("parent_asin", "ix", "review_count", "rating_sum"), start, 0.3, 1.0))


def _events_latest(s, d):
    e = table(s, d, "events").select("user_id", "ts", "event_id", "event_type")
    return ordering.latest(e, ["user_id"], "ts", "event_id")


def _quantiles(s, d):
    e = table(s, d, "silver_reviews").select(F.col("text_word_count").cast("double").alias("n"))
    return profile.quantiles(e, "n", [0.5, 0.9, 0.99]).withColumn("mean", F.round("mean", 6))


QUERIES = {
    "score_by_theme": lambda s, d: _round(scoring.by_theme(_outcomes(s, d))),
    "score_macro": lambda s, d: _round(scoring.macro(scoring.by_theme(_outcomes(s, d)))),
    "score_disagreements": lambda s, d: scoring.disagreements(_outcomes(s, d)),
    "score_best_cut": _cuts,
    "score_star_rule": lambda s, d: scoring.star_rule(_flat(s, d).select("id", "rating", F.col("ref").alias("themes"))),
    "score_agreement": lambda s, d: scoring.agreement(_ratings(s, d), "r1", "r2"),
    "score_agreement_pooled": lambda s, d: scoring.pooled_agreement(_ratings(s, d), "r1", "r2"),
    "score_sentiment": _sentiment,
    "score_resampled": lambda s, d: _round(scoring.resampled_macro(_clustered(s, d), DRAWS, SEED)),
    "score_interval": lambda s, d: scoring.interval(scoring.resampled_macro(_clustered(s, d), DRAWS, SEED)),
    "score_classifier": _classified,
    "order_positions": lambda s, d: _positions(s, d).select("pos", "event_id"),
    "order_disorder": lambda s, d: ordering.disorder(_arrival_positions(s, d).withColumnRenamed("ts_ms", "ts"), bucket=100).select("pos", "kafka_offset"),
    "order_watermark": lambda s, d: ordering.simulate_watermark(_arrival_positions(s, d), 5, 86_400_000),
    "order_release": _release,
    "order_latest": _events_latest,
    "profile_quantiles": _quantiles,
    "profile_distribution": lambda s, d: profile.distribution(table(s, d, "silver_reviews"), F.col("rating"), "rating"),
    "profile_shared_keys": lambda s, d: profile.shared_keys(table(s, d, "silver_reviews").select("review_id", "parent_asin", "rating", "title", "text", "helpful_vote", "verified_purchase")),
    "profile_digest": lambda s, d: profile.digest(table(s, d, "silver_reviews"), "review_id", "rating", "text"),
    "profile_single_value": lambda s, d: profile.single_value(table(s, d, "bronze_reviews"), "kafka_topic"),
    "calibrate_grid": _grid_alerts,
    "calibrate_placebo": _placebo,
    "calibrate_power": lambda s, d: _round(_power(s, d)),
    "calibrate_selected": _selected,
    "calibrate_fast_path": _fast_path,
    "calibrate_permuted": _permuted,
    "calibrate_injected": _injected,
    "calibrate_surveillance": lambda s, d: calibration.surveillance_months(decline.points(spine.spine(months(s, d)), RULE)),
    "stream_product_months": _stream,
    "stream_reconciled": _stream_gap,
    "stream_injection_plan": _injection_plan,
    "stream_late_corrected": _late_stream,
    "table_merged": _merged_table,
    "table_replaced_partitions": _replaced_partitions,
    "answer_violations": _citations,
    "answer_decline_bounds": _decline_bounds,
}

_TH = lambda c: f"list_filter([case when regexp_matches({c}, 'broke|stuck|bent') then 'broken' end, case when regexp_matches({c}, 'bad|disappoint|waste') then 'regret' end, case when regexp_matches({c}, 'love|great|gift') then 'praise' end], lambda x: x is not null)"
FLAT = f"""
fl as (select review_id id, parent_asin, rating, {_TH("lower(coalesce(text, ''))")} ref, {_TH("lower(coalesce(title, ''))")} sys
       from silver_reviews qualify row_number() over (partition by review_id order by kafka_partition, kafka_offset) = 1),
oc as (select id, parent_asin, theme, coalesce(r, 0) ref, coalesce(s, 0) sys from
        (select id, parent_asin, unnest(ref) theme, 1 r from fl) full join (select id, parent_asin, unnest(sys) theme, 1 s from fl) using (id, parent_asin, theme)),
bt as (select theme, count(*) filter (where ref = 1 and sys = 1) tp, count(*) filter (where ref = 0 and sys = 1) fp, count(*) filter (where ref = 1 and sys = 0) fn from oc group by 1),
sf as (select *, tp + fn support, coalesce(tp / nullif(tp + fp, 0), 0) "precision", coalesce(tp / nullif(tp + fn, 0), 0) recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) f1 from bt)"""
_CUTS = lambda rows, grid: f"""
gr as (select theme, cut, count(*) filter (where score >= cut and label = 1) tp, count(*) filter (where score >= cut and label = 0) fp, count(*) filter (where score < cut and label = 1) fn
       from {rows}, (select unnest({grid}) cut) group by 1, 2),
bc as (select *, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) f1 from gr qualify row_number() over (partition by theme order by f1 desc, cut) = 1)"""  # noqa: E731
_P = []
_t, _term = 0.0, 0.36787944117144233
for _k in range(7):
    _t += _term
    _P.append(f"when u < {round(_t, 12)} then {_k}")
    _term /= _k + 1
RESAMPLED = f"""{FLAT},
cl as (select parent_asin, theme, count(*) filter (where ref = 1 and sys = 1) tp, count(*) filter (where ref = 0 and sys = 1) fp, count(*) filter (where ref = 1 and sys = 0) fn from oc group by 1, 2),
rs as (select *, case {" ".join(_P)} else 7 end w from (select *, ('0x' || substr(sha256('{SEED}' || chr(31) || draw || chr(31) || parent_asin), 1, 8))::ubigint::double / 4294967296.0 u from cl, (select unnest(range(1, {DRAWS + 1})) draw))),
rd as (select draw, avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) macro_f1 from (select draw, theme, sum(w * tp) tp, sum(w * fp) fp, sum(w * fn) fn from rs where w > 0 group by 1, 2) group by 1)"""
_POS = """
po as (select row_number() over (order by epoch_us(ts) // 1000, event_id) - 1 pos, event_id, epoch_us(ts) // 1000 ts_ms from events),
ap as (select row_number() over (order by ingested_at, kafka_partition, kafka_offset) - 1 pos, kafka_offset, epoch_us(event_ts) // 1000 ts_ms from (select distinct kafka_partition, kafka_offset, ingested_at, event_ts from review_collisions where event_ts is not null))"""
_Z = 1.959963984540054
_PM = f"""{MONTHS}, pm as (select parent_asin, {_MONTH("ix")} as month, review_count, rating_sum, neg_count, verified_count from m)"""

_HELD = """
f as (select * from silver_reviews qualify row_number() over (partition by review_id order by kafka_partition, kafka_offset) = 1),
ip as (select review_id, epoch_ms(event_ts) ts_ms, row_number() over (order by epoch_ms(event_ts), review_id) - 1 pos, count(*) over () n from f),
iq as (select *, (select count(*) from ip b where b.ts_ms < a.ts_ms + 730 * 86400000::bigint) far_q, (select count(*) from ip b where b.ts_ms < a.ts_ms + 7 * 86400000::bigint) near_q from ip a),
ig as (select iq.*, g.ts_ms guard_ms from iq left join ip g on g.pos = iq.far_q - 2 * greatest(1, iq.n // 10) - 4 * greatest(1, iq.n // 200)),
fr as (select 'far' slice, review_id, pos, ts_ms, ts_ms + 730 * 86400000::bigint release_ms, far_q release_before from ig
       where far_q < n and guard_ms - 30 * 86400000::bigint > ts_ms qualify row_number() over (order by sha256('42' || chr(31) || 'far' || chr(31) || review_id), review_id) <= greatest(1, n // 200)),
nr as (select 'near' slice, review_id, pos, ts_ms, ts_ms + 7 * 86400000::bigint release_ms, near_q release_before from ig
       where near_q < n and pos not in (select pos from fr) qualify row_number() over (order by sha256('42' || chr(31) || 'near' || chr(31) || review_id), review_id) <= greatest(1, n // 200)),
held as (select * from fr union all select * from nr)"""

ORACLE = {
    "score_by_theme": f"with {FLAT} select theme, tp, fp, fn, support, round(\"precision\", 9) \"precision\", round(recall, 9) recall, round(f1, 9) f1 from sf",
    "score_macro": f"with {FLAT} select count(*) themes, round(avg(f1), 9) macro_f1 from sf where support >= 10",
    "score_disagreements": f"with {FLAT} select id, theme, case when ref = 1 then 'only_reference' else 'only_system' end side from oc where ref <> sys",
    "score_best_cut": f"""with r as (select 'low' theme, neg_share score, (mean_rating < 3)::int as label from product_month where neg_share is not null and mean_rating is not null), {_CUTS("r", GRID)}
select theme, cut::double cut, tp, fp, fn, f1 from bc""",
    "score_star_rule": f"""with {FLAT}, r as (select theme, -rating::double score, list_contains(fl.ref, theme)::int as label from fl, (select distinct unnest(ref) theme from fl)), {_CUTS("r", [-1.0, -2.0, -3.0, -4.0, -5.0])}
select theme, (-cut)::int k, tp, fp, fn, f1 from bc""",
    "score_agreement": f"""with r as (select doc_id id, rater, max(level) as label from reading_labels where level is not null and rater is not null group by 1, 2),
j as (select a.label a, b.label b from r a join r b using (id) where a.rater = 'r1' and b.rater = 'r2'),
g as (select l as label, count(*) items, count(*) filter (where a = l and b = l) "both", count(*) filter (where a = l) "first", count(*) filter (where b = l) "second" from j, (select distinct unnest([a, b]) l from j) group by 1),
k as (select *, (items - "first" - "second" + 2 * "both") / items p, ("first" / items) * ("second" / items) + (1 - "first" / items) * (1 - "second" / items) ch from g)
select label, items, "both", "first", "second", round(case when ch < 1 then (p - ch) / (1 - ch) end, 9) kappa,
  round(greatest(((p + {_Z * _Z / 2} / items) / (1 + {_Z * _Z} / items)) - {_Z} * sqrt(p * (1 - p) / items + {_Z * _Z / 4} / (items * items)) / (1 + {_Z * _Z} / items), 0), 9) low,
  round(least(((p + {_Z * _Z / 2} / items) / (1 + {_Z * _Z} / items)) + {_Z} * sqrt(p * (1 - p) / items + {_Z * _Z / 4} / (items * items)) / (1 + {_Z * _Z} / items), 1), 9) high
from k""",
    "score_agreement_pooled": f"""with r as (select doc_id id, rater, max(level) as label from reading_labels where level is not null and rater is not null group by 1, 2),
j as (select a.label a, b.label b from r a join r b using (id) where a.rater = 'r1' and b.rater = 'r2'),
z as (select count(*) n, count(*) filter (where a = b) e, (select count(distinct l) from (select unnest([a, b]) l from j)) ls from j)
select n items, ls as labels, e equal_sets, n * ls decisions, n * ls - 2 * (n - e) agreed, round(((1 - ls) * 2 * n + n * ls * ls - 2 * ls * (n - e)) / ((1 - ls) * 2 * n + n * ls * ls), 9) kappa from z""",
    "score_sentiment": f"""with {FLAT}
select case when rating > 3 then 'positive' else 'negative' end stars,
  case when list_contains(ref, 'praise') and not list_contains(ref, 'broken') then 'positive' when list_contains(ref, 'broken') and not list_contains(ref, 'praise') then 'negative' when len(ref) = 0 then 'none' else 'mixed' end said,
  count(*) reviews from fl where rating <> 3 group by 1, 2""",
    "score_resampled": f"with {RESAMPLED} select draw, round(macro_f1, 9) macro_f1 from rd",
    "score_interval": f"""with {RESAMPLED}, o as (select list(round(macro_f1, 9) order by macro_f1) l from rd)
select len(l) draws, l[greatest(1, ceil(len(l) * 0.025))::int] low, l[greatest(1, ceil(len(l) * 0.975))::int] high from o""",
    "order_positions": f"with {_POS} select pos, event_id from po",
    "order_disorder": f"with {_POS} select pos, kafka_offset from (select *, lag(ts_ms) over (order by pos) p from ap) where ts_ms < p",
    "order_watermark": f"""with {_POS}, b as (select *, pos // 5 batch from ap), t as (select batch, max(ts_ms) top from b group by 1),
k as (select batch, max(top) over (order by batch rows between unbounded preceding and 2 preceding) - 86400000 mark from t)
select pos, batch, ts_ms from b join k using (batch) where ts_ms < mark""",
    "order_release": f"""with {_POS}, l as (select event_id id, ts_ms + 7200000 target_ms from po order by sha256('late' || chr(31) || event_id) limit 50)
select id, target_ms, (select min(pos) from po where ts_ms >= target_ms) pos from l""",
    "order_latest": "select user_id, ts, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "profile_quantiles": "select quantile_disc(text_word_count, 0.5)::double p50, quantile_disc(text_word_count, 0.9)::double p90, quantile_disc(text_word_count, 0.99)::double p99, round(avg(text_word_count), 6) mean, max(text_word_count)::double most from silver_reviews",
    "profile_distribution": "select rating, count(*) as \"rows\", round(100 * count(*) / (select count(*) from silver_reviews), 2) as percent from silver_reviews group by 1",
    "profile_shared_keys": """with k as (select review_id, count(*) group_size, count(distinct parent_asin) products, count(distinct rating) r, count(distinct coalesce(title, chr(0))) t, count(distinct coalesce(text, chr(0))) x,
  count(distinct coalesce(helpful_vote::varchar, chr(0))) h, count(distinct coalesce(verified_purchase::varchar, chr(0))) v from silver_reviews group by 1 having count(*) > 1)
select group_size, count(*) as groups, count(*) filter (where greatest(r, t, x, h, v) = 1) exact, count(*) filter (where greatest(r, t, x, h, v) > 1) conflicting, max(products) most_products,
  count(*) filter (where r > 1) rating_differs, count(*) filter (where t > 1) title_differs, count(*) filter (where x > 1) text_differs, count(*) filter (where h > 1) helpful_vote_differs, count(*) filter (where v > 1) verified_purchase_differs
from k group by 1""",
    "profile_single_value": "select case when min(kafka_topic) = max(kafka_topic) then min(kafka_topic) end as value, min(kafka_topic) <> max(kafka_topic) several from bronze_reviews",
    "calibrate_fast_path": f"""with recursive {EPISODES}
select (select count(*) from p) points, (select count(*) from p where evaluable) evaluable, count(*) alerts, count(distinct parent_asin) products from ep""",
    "calibrate_permuted": f"""with {SPINE},
a as (select parent_asin, ix, review_count, rating_sum, row_number() over (partition by parent_asin order by ix) - 1 i, count(*) over (partition by parent_asin) n from sp),
b as (select *, (i + floor(('0x' || substr(sha256('{SEED}' || chr(31) || 'shift1' || chr(31) || parent_asin), 1, 16))::ubigint::double / 18446744073709551616.0 * n)::bigint) % n c from a),
k as (select *, c // 6 bl, ('0x' || substr(sha256('{SEED}' || chr(31) || 'block1' || chr(31) || parent_asin || ':' || (c // 6)), 1, 16))::ubigint::double / 18446744073709551616.0 kk from b),
t as (select *, row_number() over (partition by parent_asin order by kk, bl, c) - 1 dest from k)
select t.parent_asin, a.ix, t.review_count, t.rating_sum from t join a on a.parent_asin = t.parent_asin and a.i = t.dest""",
    "calibrate_injected": f"""with {MONTHS}, s as (select parent_asin, (min(ix) + max(ix)) // 2 as start_ix from m group by 1),
r as (select parent_asin, ix, review_count, rating_sum, floor(round(sum(case when ix >= start_ix then review_count * 0.3::double else 0.0 end) over (partition by parent_asin order by ix), 9)) run from m join s using (parent_asin)),
l as (select *, (run - coalesce(lag(run) over (partition by parent_asin order by ix), 0))::bigint lowered from r)
select parent_asin, ix, review_count, rating_sum, lowered, round(rating_sum - lowered * greatest(rating_sum / review_count - 1, 0), 9) injected_sum from l""",
    "calibrate_surveillance": f"with {POINTS} select count(distinct point_month) \"months\", round(count(*) / 12, 9) product_years from p where evaluable",
    "stream_product_months": f"with {_PM} select * from pm",
    "stream_injection_plan": f"with {_HELD} select * from held",
    "stream_reconciled": f"""with {_HELD}, {_PM.replace("f as (select", "g as (select", 1).replace("from f group by", "from g group by", 1)},
x as (select g.parent_asin, {_MONTH("year(event_ts) * 12 + month(event_ts) - 1")} as month, count(*) n from g join held using (review_id) where slice = 'far' group by 1, 2)
select parent_asin, month, case when n = review_count then 'only_batch' else 'differs' end kind, -n review_gap, true explained from x join pm using (parent_asin, month)""",
    "answer_violations": f"""with {text.WINDOWED},
rv as (select review_id, any_value(parent_asin) parent_asin, ix from (select *, year(event_ts) * 12 + month(event_ts) - 1 ix from silver_reviews) group by 1, 3),
rt as (select parent_asin qid, win, review_id, ix, row_number() over (partition by parent_asin, win order by {text._DRAW("retrieve").replace(f"'{text.SEED}'", f"'{SEED}'")}, review_id) rk from rv join wi using (parent_asin) where ix between lo and hi qualify rk <= 3),
hd as (select qid, 'R' || row_number() over (partition by qid order by win, rk, review_id) cite_id, win, ix from rt),
qs as (select distinct parent_asin qid, ('0x' || substr(md5(parent_asin), 1, 4))::int % 8 k from wi),
ci as (select qid, k, case when k = 1 then 'R99' else 'R1' end cite_id, case k when 0 then 'baseline' when 1 then 'recent' when 2 then 'recent' else 'other' end said from qs where k in (0, 1, 2, 3)),
fw as (select ci.qid, hd.win shown, wi.lo, wi.hi, ix, said from ci left join hd using (qid, cite_id) left join wi on wi.parent_asin = ci.qid and wi.win = said)
select qid question_id, 'terminal' as rule, 1 as times from qs where k = 7
union all select qid, 'refusal_empty', case when k = 6 then 3 else 1 end from qs where k = 6
union all select qid, 'claims_cite', 1 from qs where k in (0, 2, 4)
union all select qid, case when shown is null then 'citations_retrieved' else 'citations_in_scope' end, 1 from fw where shown is null or not coalesce(shown = said and ix between lo and hi, false)""",
    "table_merged": "select parent_asin, case when rating_number > 10 then 0 else rating_number end rating_number, rating_number as before from products",
    "table_replaced_partitions": "select month, sum(case when month = '2022-01' then -1 else review_count end)::bigint reviews, count(*) as \"rows\" from product_month where month is not null group by 1",
}
from .pipeline_problems import _ARRIVED  # noqa: E402

ORACLE["stream_late_corrected"] = f"""with {_ARRIVED},
z as (select review_id, event_ts, rating from arrived where not past qualify row_number() over (partition by review_id order by arrival desc, kafka_offset desc, kafka_partition desc) = 1)
select date_trunc('month', event_ts)::date event_month, count(*) reviews, sum(rating)::bigint rating_sum from z group by 1"""
