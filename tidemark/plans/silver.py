"""Queries over accepted reviews: identifiers, collisions, enrichment, word counts, reject census."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canonical
from ..operators import collisions, records
from ..sources.tables import table
from .pipeline_problems import ORACLE as PROBLEM_SQL

RETAINED = ["review_id", "parent_asin", "user_id", "event_ts", "rating", "title", "text", "verified_purchase", "helpful_vote", "asin", "image_count", "kafka_partition", "kafka_offset"]


def reviews(s, d):
    return table(s, d, "silver_reviews").select(*RETAINED)


def _ids(s, d):
    ms = F.unix_millis(F.col("event_ts").cast("timestamp"))
    return table(s, d, "silver_reviews").select(
        "kafka_partition", "kafka_offset", canonical.review_key(F.col("user_id"), F.col("parent_asin"), ms).alias("computed_id"), "review_id"
    )


def _classes(s, d):
    c = collisions.classify(reviews(s, d))
    return c.select("kafka_partition", "kafka_offset", "review_id", "row_hash", "group_size", "collision_class", F.array_join("differing_fields", ",").alias("differing_fields"), "selection_rank", "selection_reason", "is_survivor")


def _reject_census(s, d):
    cols = ["kafka_partition", "kafka_offset", "payload", "ingested_at"]
    f = records.failing(*(table(s, d, t).select(*cols) for t in ("bronze_reviews", "silver_rejects")))
    return f.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("messages"))


def _duplicate_offsets(s, d):
    return table(s, d, "bronze_reviews").groupBy("kafka_partition", "kafka_offset").agg(F.count(F.lit(1)).alias("deliveries")).where("deliveries > 1")


def _match_rate(s, d):
    r = table(s, d, "silver_reviews").select("parent_asin")
    p = table(s, d, "products").select("parent_asin")
    flag = r.join(p.withColumn("hit", F.lit(1)), "parent_asin", "left")
    return flag.agg(F.count(F.lit(1)).alias("reviews"), F.count("hit").alias("matched"), F.round(100 * F.count("hit") / F.count(F.lit(1)), 4).alias("percent"))


def _set_equality(s, d):
    a = table(s, d, "silver_reviews").select("review_id", "text_word_count").where("text_word_count >= 20").select("review_id").distinct()
    b = table(s, d, "review_embeddings").select("review_id").distinct()
    left = a.join(b, "review_id", "left_anti").agg(F.count(F.lit(1)).alias("only_reviews"))
    right = b.join(a, "review_id", "left_anti").agg(F.count(F.lit(1)).alias("only_vectors"))
    return left.join(right, F.lit(True))


QUERIES = {
    "silver_review_ids": _ids,
    "silver_collisions": _classes,
    "silver_collision_counts": lambda s, d: collisions.counts(reviews(s, d)),
    "silver_enriched": lambda s, d: collisions.enrich(table(s, d, "silver_reviews").select("kafka_partition", "kafka_offset", "review_id", "parent_asin"), table(s, d, "products")),
    "silver_word_counts": lambda s, d: table(s, d, "silver_reviews").select("kafka_partition", "kafka_offset", canonical.word_count(F.col("text")).alias("words"), "text_word_count"),
    "silver_reject_census": _reject_census,
    "silver_duplicate_offsets": _duplicate_offsets,
    "silver_catalogue_match": _match_rate,
    "silver_vector_cohort": _set_equality,
}

_ENC = lambda x: f"coalesce(unhex(printf('%08X', octet_length(encode({x})))) || encode({x}), unhex('FFFFFFFF'))"
_HASH = "sha256(" + " || ".join(
    _ENC(x) for x in ("rating::varchar", "title", "text", "verified_purchase::varchar", "helpful_vote::varchar", "trim(asin)", "image_count::varchar")
) + ")"
_DIFF = ", ".join(
    f"case when (min({f}::varchar) over g <> max({f}::varchar) over g) or (count({f}) over g > 0 and count({f}) over g < count(*) over g) then '{f}' end"
    for f in collisions.RETAINED
)
CLASSED = f"""
h as (select *, {_HASH} row_hash, coalesce(length(text), 0) size from silver_reviews),
x as (select *, count(*) over g group_size, list_filter([{_DIFF}], lambda y: y is not null) diff
      from h window g as (partition by review_id)),
y as (select *, case when group_size = 1 then null when list_contains(diff, 'rating') then 'unresolvable' when len(diff) = 0 then 'exact' else 'conflicting' end collision_class,
        row_number() over o selection_rank, lead(helpful_vote) over o nv, lead(size) over o ns
      from x window o as (partition by review_id order by helpful_vote desc nulls last, size desc, row_hash, kafka_partition, kafka_offset))"""

ORACLE = {
    "silver_review_ids": f"""select kafka_partition, kafka_offset, review_id,
  sha256({_ENC("trim(user_id)")} || {_ENC("trim(parent_asin)")} || {_ENC("epoch_ms(event_ts)::varchar")}) computed_id
from silver_reviews""",
    "silver_collisions": f"""with {CLASSED}
select kafka_partition, kafka_offset, review_id, row_hash, group_size, collision_class, array_to_string(diff, ',') differing_fields, case when selection_rank <= 2 then selection_rank end selection_rank,
  case when group_size = 1 then 'only_row' when collision_class = 'unresolvable' then 'no_survivor' when selection_rank > 1 then 'not_selected'
       when collision_class = 'exact' then 'exact_duplicate' when helpful_vote is distinct from nv then 'highest_helpful_vote'
       when size <> ns then 'longest_text' else 'lowest_canonical_hash' end selection_reason,
  selection_rank = 1 and collision_class is distinct from 'unresolvable' is_survivor
from y""",
    "silver_collision_counts": f"""with {CLASSED}, g as (select review_id, any_value(group_size) n, any_value(collision_class) c from y group by 1)
select sum(n)::bigint rows_in, count(*) as groups, count(*) filter (where c = 'exact') exact_groups, count(*) filter (where c = 'conflicting') conflicting_groups,
  count(*) filter (where c = 'unresolvable') unresolvable_groups, sum(n - case when c is not distinct from 'unresolvable' then 0 else 1 end)::bigint rows_removed
from g""",
    "silver_enriched": """select r.kafka_partition, r.kafka_offset, r.review_id, r.parent_asin, p.title product_title, p.main_category product_category, p.store product_store,
  p.parent_asin is not null in_catalogue
from silver_reviews r left join products p on r.parent_asin = p.parent_asin""",
    "silver_word_counts": "select kafka_partition, kafka_offset, text_word_count, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x0b]+'), lambda x: x <> ''))::int words from silver_reviews",
    "silver_reject_census": f"select reject_reason, count(*) messages from ({PROBLEM_SQL['p5_found']}) group by 1",
    "silver_duplicate_offsets": "select kafka_partition, kafka_offset, count(*) deliveries from bronze_reviews group by 1, 2 having count(*) > 1",
    "silver_catalogue_match": """select count(*) reviews, count(p.parent_asin) matched, round(100 * count(p.parent_asin) / count(*), 4) as percent
from silver_reviews r left join products p using (parent_asin)""",
    "silver_vector_cohort": """select
  (select count(distinct review_id) from silver_reviews r where text_word_count >= 20 and review_id not in (select review_id from review_embeddings)) only_reviews,
  (select count(distinct review_id) from review_embeddings where review_id not in (select review_id from silver_reviews where text_word_count >= 20)) only_vectors""",
}
