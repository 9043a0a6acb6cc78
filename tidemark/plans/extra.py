"""Queries of evidence, byte positions, send order, resumption and count identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import citations, collisions, evidence, matching, records
from ..sources.tables import table
from . import gold, measures, silver, text
from .pipeline_problems import ORACLE as PROBLEM_SQL

SEED = measures.SEED


def _flat(s, d):
    return measures._flat(s, d).select(F.col("id").alias("review_id"), "parent_asin", "rating", "text", "ref")


def _evidence(s, d):
    r = table(s, d, "silver_reviews").select("review_id", F.expr("int(year(event_ts) * 12 + month(event_ts) - 1)").alias("ix")).distinct()
    return evidence.window_evidence(_flat(s, d).join(r, "review_id"), text._windows(s, d), "ref", "text")


def _offsets(s, d):
    b = table(s, d, "bronze_reviews").select("delivery_id", "payload")
    return evidence.byte_offsets(b, ["delivery_id"], "payload")


def _send(s, d):
    p = measures._positions(s, d).select("pos", F.col("event_id").alias("id"))
    return evidence.send_order(p, measures._release(s, d).select("id", "pos"))


def _reject_confusion(s, d):
    r = table(s, d, "silver_rejects").select("payload", "reject_reason", "kafka_partition", "kafka_offset", "ingested_at")
    told = r.groupBy("kafka_partition", "kafka_offset").agg(F.max("reject_reason").alias("said"))
    found = records.failing(r.drop("reject_reason")).select("kafka_partition", "kafka_offset", F.col("reject_reason").alias("found"))
    return evidence.confusion(told.join(found, ["kafka_partition", "kafka_offset"], "left"), F.col("said"), F.col("found"))


def _resume(s, d):
    work = table(s, d, "silver_reviews").select("review_id").distinct()
    done = table(s, d, "review_embeddings").select("review_id", F.col("vector").isNull().alias("failed")).groupBy("review_id").agg(F.min("failed").alias("failed"))
    return evidence.resume(work, done, "review_id", F.col("failed"))


def _identity(s, d):
    c = collisions.counts(silver.reviews(s, d))
    out = collisions.survivors(silver.reviews(s, d)).agg(F.count(F.lit(1)).alias("rows_out"), F.count_distinct("review_id").alias("distinct_out"))
    return c.join(out, F.lit(True)).select("rows_in", "rows_removed", "rows_out", (F.col("rows_in") == F.col("rows_removed") + F.col("rows_out")).alias("adds_up"), (F.col("rows_out") == F.col("distinct_out")).alias("unique"))


def _disjoint(s, d):
    a = text._stratified(s, d).select("review_id", F.lit("discovery").alias("sample"))
    b = text._representative(s, d).select("review_id", F.lit("prevalence").alias("sample"))
    return a.unionByName(b).groupBy("review_id").agg(F.count(F.lit(1)).alias("samples")).groupBy("samples").agg(F.count(F.lit(1)).alias("reviews"))


def _slots(s, d):
    p = gold._points(s, d)
    e = gold.decline.episodes(p, gold.RULE)
    controls = matching.matched_controls(p, e).select("episode_id", "control_asin", "control_rank")
    at = matching.candidate_points(p, e).join(controls.select("episode_id"), "episode_id", "left_semi").select("episode_id", "parent_asin", "ix")
    two = F.array(
        F.struct(F.lit("baseline").alias("window"), (F.col("ix") - (gold.RULE.baseline - 1)).alias("lo"), F.col("ix").alias("hi")),
        F.struct(F.lit("recent").alias("window"), (F.col("ix") + 1).alias("lo"), (F.col("ix") + gold.RULE.recent).alias("hi")),
    )
    r = gold.first_arrivals(s, d).select("parent_asin", "rating", F.expr("int(year(event_ts) * 12 + month(event_ts) - 1)").alias("ix"))
    ranked = citations.decline_bound(r, at.select("episode_id", "parent_asin", F.explode(two).alias("w")).select("episode_id", "parent_asin", "w.*"), key="episode_id")
    rows = citations.distinct_slots(ranked, controls, 5)
    return s.createDataFrame([(r["slot"], r["episode_id"], r["parent_asin"], r["control_asin"]) for r in rows], "slot int, episode_id string, parent_asin string, control_asin string")


def _window_ratings(s, d):
    r = gold.first_arrivals(s, d).select("review_id", "parent_asin", "rating", F.expr("int(year(event_ts) * 12 + month(event_ts) - 1)").alias("ix"))
    return citations.window_ratings(r, text._windows(s, d))


QUERIES = {
    "evidence_frequent_products": lambda s, d: evidence.frequent_groups(table(s, d, "silver_reviews").select("parent_asin", "title", "kafka_partition", "kafka_offset"), "parent_asin", 5, F.col("title"), F.struct("kafka_partition", "kafka_offset")),
    "evidence_aspects": lambda s, d: evidence.aspect_support(_flat(s, d), "ref"),
    "evidence_windows": _evidence,
    "evidence_window_ratings": _window_ratings,
    "order_byte_offsets": _offsets,
    "order_send": _send,
    "silver_reject_confusion": _reject_confusion,
    "silver_resume": _resume,
    "silver_identity": _identity,
    "draw_disjoint": _disjoint,
    "answer_slots": _slots,
}

ORACLE = {
    "evidence_frequent_products": "select parent_asin, count(*) as \"rows\", arg_min_null(title, (kafka_partition, kafka_offset)) shown from silver_reviews group by 1 having count(*) >= 5",
    "evidence_aspects": f"""with {measures.FLAT}, x as (select id, parent_asin, rating, unnest(ref) aspect from fl)
select aspect, count(distinct id) reviews, count(distinct case when rating <= 2 then id end) low_reviews, count(distinct parent_asin) products,
  count(distinct id) >= (select count(*) from fl) * 0.03 and count(distinct parent_asin) >= 2 supported from x group by 1""",
    "evidence_windows": f"""with {text.WINDOWED}, {measures.FLAT},
t as (select id, any_value(text) txt, any_value(year(event_ts) * 12 + month(event_ts) - 1) ix from (select review_id id, text, event_ts from silver_reviews qualify row_number() over (partition by review_id order by kafka_partition, kafka_offset) = 1) group by 1),
x as (select fl.parent_asin, win, fl.id, txt, ref from fl join t using (id) join wi on wi.parent_asin = fl.parent_asin where ix between lo and hi),
u as (select parent_asin, win, id, txt, unnest(ref) theme from x union all select parent_asin, win, id, txt, null from x where len(ref) = 0)
select parent_asin, win as "window", theme, count(distinct id) reviews, min(txt) first_quote from u group by 1, 2, 3""",
    "evidence_window_ratings": f"""with {text.WINDOWED}
select f.parent_asin, win as "window", count(*) n, sum(rating)::bigint s from f join wi on wi.parent_asin = f.parent_asin and year(event_ts) * 12 + month(event_ts) - 1 between lo and hi group by 1, 2""",
    "order_byte_offsets": """select delivery_id, octet_length(encode(coalesce(payload, '')))::bigint bytes, sha256(coalesce(payload, '')) sha256,
  coalesce(sum(octet_length(encode(coalesce(payload, ''))) + 1) over (order by delivery_id rows between unbounded preceding and 1 preceding), 0)::bigint byte_from from bronze_reviews""",
    "order_send": f"""with {measures._POS}, l as (select event_id id, ts_ms + 7200000 target_ms from po order by sha256('late' || chr(31) || event_id) limit 50),
h as (select id, (select min(pos) from po where ts_ms >= target_ms) before from l)
select row_number() over (order by case when h.id is not null then coalesce(before, 4611686018427387904) else pos end, case when h.id is not null then 0 else 1 end, pos) - 1 slot, event_id id, h.id is not null held
from po left join h on h.id = po.event_id""",
    "silver_reject_confusion": f"""with fo as ({PROBLEM_SQL["p5_found"].replace("from bronze_reviews", "from bronze_reviews where false")}),
t as (select kafka_partition, kafka_offset, max(reject_reason) said from silver_rejects group by 1, 2)
select said, fo.reject_reason as found, count(*) as "rows" from t left join fo using (kafka_partition, kafka_offset) group by 1, 2""",
    "silver_resume": "select distinct review_id from silver_reviews where review_id not in (select review_id from review_embeddings where vector is not null)",
    "silver_identity": f"""with {silver.CLASSED},
z as (select count(*) rows_in, count(*) filter (where selection_rank = 1 and collision_class is distinct from 'unresolvable') rows_out,
  count(distinct case when selection_rank = 1 and collision_class is distinct from 'unresolvable' then review_id end) du from y)
select rows_in, rows_in - rows_out rows_removed, rows_out, true adds_up, rows_out = du as "unique" from z""",
    "draw_disjoint": f"""with {text.STRATIFIED},
re as (select review_id from f where review_id not in (select review_id from st) order by {text._DRAW("prevalence")}, review_id limit 40)
select samples, count(*) reviews from (select review_id, count(*) samples from (select review_id from st union all select review_id from re) group by 1) group by 1""",
}
