"""Queries of the general data problems (3 to 7) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arrivals, heavy, late, records, rolling
from ..sources.tables import table

_BRONZE_MESSAGE = ["delivery_id", "kafka_partition", "kafka_offset", "ingested_at"]


def _p3(f):
    return lambda s, d: f(table(s, d, "product_month"))


def _p4(f):
    return lambda s, d: f(
        table(s, d, "silver_reviews").select("review_id", "event_ts", "rating", "kafka_partition", "kafka_offset"),
        table(s, d, "bronze_reviews").select("kafka_partition", "kafka_offset", "ingested_at"),
    )


def _p5(f):
    cols = ["kafka_partition", "kafka_offset", "payload", "ingested_at"]
    return lambda s, d: f(table(s, d, "bronze_reviews").select("delivery_id", *cols), table(s, d, "silver_rejects").select(*cols))


def _p7(f):
    return lambda s, d: f(table(s, d, "bronze_reviews").select(*_BRONZE_MESSAGE), table(s, d, "silver_reviews").select("review_id", "kafka_partition", "kafka_offset"))


def _p3_rolling(df):
    t = rolling.product_trailing(df)
    return t.select(
        "parent_asin", "month", *(c for c in t.columns if c.startswith(("reviews", "negatives", "rating_sum"))),
        *(F.round(f"mean_rating_{k}", 9).alias(f"mean_rating_{k}") for k in (3, 12)),
    )


QUERIES = {
    "p3_found": _p3(rolling.turning_bad),
    "p3_rolling": _p3(_p3_rolling),
    "p4_found": _p4(late.past_cutoff),
    "p4_month_versions": _p4(late.monthly_versions),
    "p5_found": _p5(lambda *both: records.failing(*both).drop("fault")),
    "p5_loaded": _p5(records.load),
    "p5_faults": _p5(records.faults),
    "p5_recovered": _p5(records.recovered),
    "p6_found": lambda s, d: heavy.heavy_keys(table(s, d, "bronze_reviews"), "kafka_key").select(F.col("key").alias("parent_asin")),
    "p6_product_profile": lambda s, d: heavy.product_profile(table(s, d, "silver_reviews")).withColumn("mean_rating", F.round("mean_rating", 9)),
    "p7_found": _p7(arrivals.to_drop),
    "p7_seen": _p7(lambda b, r: arrivals.seen_census(b, r).agg(F.sum("messages").cast("long").alias("messages"))),
}

_FACTS = """
facts as (
  select parent_asin, ix, coalesce(review_count, 0)::bigint reviews, coalesce(neg_count, 0)::bigint negatives,
         coalesce(rating_sum, round(mean_rating * coalesce(review_count, 0)), 0.0) rating_sum
  from (select *, year(month_date) * 12 + month(month_date) - 1 ix,
               row_number() over (partition by parent_asin, date_trunc('month', month_date)
                 order by source_silver_snapshot_id desc nulls last, review_count desc nulls last, neg_count desc nulls last,
                          rating_sum desc nulls last, mean_rating desc nulls last) rn
        from product_month) where rn = 1),
calendar as (
  select parent_asin, unnest(generate_series(min(ix), max(ix))) ix from facts group by parent_asin),
filled as (
  select c.parent_asin, c.ix, coalesce(f.reviews, 0) reviews, coalesce(f.negatives, 0) negatives, coalesce(f.rating_sum, 0.0) rating_sum
  from calendar c left join facts f on f.parent_asin = c.parent_asin and f.ix = c.ix),
spans as (
  select parent_asin, printf('%04d-%02d', ix // 12, ix % 12 + 1) as month,
         sum(reviews) over w3 reviews_3, sum(negatives) over w3 negatives_3, sum(rating_sum) over w3 rating_sum_3,
         sum(reviews) over w12 reviews_12, sum(negatives) over w12 negatives_12, sum(rating_sum) over w12 rating_sum_12
  from filled
  window w3 as (partition by parent_asin order by ix rows between 2 preceding and current row),
         w12 as (partition by parent_asin order by ix rows between 11 preceding and current row))"""

_ARRIVED = """
first as (select kafka_partition, kafka_offset, min(ingested_at) arrival from bronze_reviews group by all),
arrived as (
  select s.review_id, s.event_ts, s.rating, f.arrival, kafka_offset, kafka_partition,
         f.arrival >= date_trunc('month', s.event_ts) + interval 1 month + interval 30 days as past
  from silver_reviews s join first f using (kafka_partition, kafka_offset))"""

_OUTER = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_JUDGED = """m as (
  select kafka_partition, kafka_offset, min(payload) payload, min(ingested_at) arrived
  from (select kafka_partition, kafka_offset, payload, ingested_at from bronze_reviews
        union all select kafka_partition, kafka_offset, payload, ingested_at from silver_rejects)
  group by 1, 2),
j as (select *, case when json_valid(payload) then payload::json end as j from m),
f as (
  select *, j->>'$.user_id' u, j->>'$.parent_asin' p, j->>'$.timestamp' t, try_cast(trim(j->>'$.rating') as double) r,
         j->'$.images' im
  from j),
v as (
  select kafka_partition, kafka_offset,
    case when j is null or json_type(j) <> 'OBJECT' then 'unparsable_json'
         when not (im is null or json_type(im) = 'NULL'
                   or (json_type(im) = 'ARRAY' and len(list_filter(json_extract(im, '$[*]'), lambda x: json_type(x) <> 'OBJECT')) = 0))
         then 'unparsable_json'
         when coalesce(trim(u), '') = '' or coalesce(trim(p), '') = '' or coalesce(trim(t), '') = '' then 'missing_key_field'
         when r is null or not (r between 1 and 5 and r = floor(r)) then 'invalid_rating'
         when not regexp_full_match(t, '-?[0-9]+') or try_cast(t as hugeint) is null or t::hugeint < 788918400000
              or t::hugeint > epoch_ms(arrived) then 'timestamp_out_of_range' end as reject_reason
  from f)"""

ORACLE = {
    "p3_found": f"""with {_FACTS}
select parent_asin, month from spans
where reviews_3 >= 10 and 2 * negatives_3 * reviews_12 >= 3 * negatives_12 * reviews_3
  and 2 * rating_sum_3 * reviews_12 <= 2 * rating_sum_12 * reviews_3 - reviews_3 * reviews_12""",
    "p3_rolling": f"""with {_FACTS}
select parent_asin, month, reviews_3::bigint reviews_3, negatives_3::bigint negatives_3, rating_sum_3,
       reviews_12::bigint reviews_12, negatives_12::bigint negatives_12, rating_sum_12,
       round(case when reviews_3 > 0 then rating_sum_3 / reviews_3 end, 9) mean_rating_3,
       round(case when reviews_12 > 0 then rating_sum_12 / reviews_12 end, 9) mean_rating_12
from spans""",
    "p4_found": f"""with {_ARRIVED}
select review_id from arrived group by review_id having bool_and(past)""",
    "p4_month_versions": f"""with {_ARRIVED},
v as (
  select review_id, arrival::date as version, date_trunc('month', event_ts)::date event_month, rating,
         row_number() over (partition by review_id, arrival::date order by arrival desc, kafka_offset desc, kafka_partition desc) rn
  from arrived where not past),
c as (
  select *, lag(rating) over w old_rating, lag(event_month) over w old_month, row_number() over w k
  from v where rn = 1 window w as (partition by review_id order by version)),
d as (
  select event_month, version, rating, 1 as diff from c
  union all select old_month, version, old_rating, -1 from c where k > 1),
net as (
  select event_month, version, sum(diff)::bigint reviews_delta, sum(rating * diff)::bigint rating_delta,
         count(*) filter (where diff < 0) retractions from d group by 1, 2)
select *, (sum(reviews_delta) over w)::bigint reviews, (sum(rating_delta) over w)::bigint rating_sum
from net window w as (partition by event_month order by version)""",
    "p5_found": f"with {_JUDGED} select * from v where reject_reason is not null",
    "p5_loaded": f"""with {_JUDGED},
t as (select kafka_partition, kafka_offset, j from f semi join (select * from v where reject_reason is null) ok using (kafka_partition, kafka_offset)),
d as (select delivery_id, kafka_partition, kafka_offset from bronze_reviews union all select null, kafka_partition, kafka_offset from silver_rejects)
select delivery_id, kafka_partition, kafka_offset, make_timestamp((j->>'$.timestamp')::bigint * 1000) event_ts,
  {_OUTER("j->>'$.user_id'")} user_id, {_OUTER("j->>'$.parent_asin'")} parent_asin, nullif({_OUTER("j->>'$.asin'")}, '') asin,
  try_cast(trim(j->>'$.rating') as double)::int rating, j->>'$.title' title, j->>'$.text' as text, try_cast(j->>'$.helpful_vote' as bigint) helpful_vote,
  case when json_type(j->'$.verified_purchase') = 'BOOLEAN' then (j->>'$.verified_purchase')::boolean end verified_purchase,
  coalesce(json_array_length(j->'$.images'), 0)::int image_count
from d join t using (kafka_partition, kafka_offset)""",
    "p6_found": """select parent_asin from (
  select nullif(upper(regexp_replace(kafka_key, '^\\s+|\\s+$', '', 'g')), '') parent_asin, count(*) n from bronze_reviews group by 1)
where parent_asin is not null and n * 100 >= (select count(*) from bronze_reviews)""",
    "p6_product_profile": """select parent_asin, count(*) reviews, sum(rating)::bigint rating_sum, round(avg(rating), 9) mean_rating,
  count(*) filter (where rating <= 2) negatives, sum(coalesce(helpful_vote, 0))::bigint votes,
  min(event_ts) first_ts, max(event_ts) last_ts, count(distinct user_id) users
from silver_reviews group by parent_asin""",
    "p7_found": """with ids as (select kafka_partition, kafka_offset, min(review_id) review_id from silver_reviews group by 1, 2)
select delivery_id from (
  select delivery_id, row_number() over (
    partition by coalesce(review_id, '@:' || kafka_partition || ':' || kafka_offset) order by ingested_at, delivery_id) rn
  from bronze_reviews left join ids using (kafka_partition, kafka_offset))
where rn > 1""",
    "p7_seen": """with ids as (select kafka_partition, kafka_offset, min(review_id) review_id from silver_reviews group by 1, 2)
select count(distinct coalesce(review_id, '@:' || kafka_partition || ':' || kafka_offset)) messages
from bronze_reviews left join ids using (kafka_partition, kafka_offset)""",
}
