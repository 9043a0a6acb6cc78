"""Queries over product months: aggregates, calendar, decline points and episodes, controls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decline, matching, spine
from ..sources.tables import table

RULE = decline.Rule()


def first_arrivals(s, d):
    """Reviews with the copy of the lowest position of each."""
    cols = ["review_id", "parent_asin", "user_id", "event_ts", "rating", "verified_purchase", "text_word_count"]
    r = table(s, d, "silver_reviews").select(*cols, "kafka_partition", "kafka_offset")
    best = F.min(F.struct("kafka_partition", "kafka_offset", *cols[1:])).alias("m")
    return r.groupBy("review_id").agg(best).select("review_id", "m.*")


def months(s, d):
    return spine.monthly(first_arrivals(s, d))


def _points(s, d):
    return decline.points(spine.spine(months(s, d)), RULE)


def _rounded(df):
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _point_episodes(s, d):
    p = _points(s, d)
    return decline.point_episodes(p.select("parent_asin", "ix", "point_month", "evaluable"), decline.episodes(p, RULE)).drop("ix")


def _controls(s, d):
    p = _points(s, d)
    return _rounded(matching.matched_controls(p, decline.episodes(p, RULE)))


def _never(s, d):
    p = _points(s, d)
    return matching.never_alerting(p, decline.episodes(p, RULE)).select("parent_asin").distinct()


def _outcomes(s, d):
    p = _points(s, d)
    e = decline.episodes(p, RULE)
    return matching.case_outcomes(p, e, matching.matched_controls(p, e))


QUERIES = {
    "gold_product_months": lambda s, d: _rounded(months(s, d)),
    "gold_spine": lambda s, d: _rounded(spine.spine(months(s, d)).drop("ix")),
    "gold_span_check": lambda s, d: spine.span_check(months(s, d)),
    "gold_dashboard": lambda s, d: spine.weighted_dashboard(months(s, d)),
    "gold_top_products": lambda s, d: spine.top_products(months(s, d)),
    "gold_month_presence": lambda s, d: spine.month_presence(months(s, d)),
    "gold_points": lambda s, d: _rounded(_points(s, d).drop("ix")),
    "gold_unevaluable": lambda s, d: _points(s, d).groupBy("unevaluable_reason").agg(F.count(F.lit(1)).alias("points"), F.count_distinct("parent_asin").alias("products")),
    "gold_episodes": lambda s, d: _rounded(decline.episodes(_points(s, d), RULE)),
    "gold_point_episodes": _point_episodes,
    "gold_matched_controls": _controls,
    "gold_never_alerting": _never,
    "gold_case_outcomes": _outcomes,
}

MONTHS = """
f as (select * from silver_reviews qualify row_number() over (partition by review_id order by kafka_partition, kafka_offset) = 1),
m as (select parent_asin, year(event_ts) * 12 + month(event_ts) - 1 ix, count(*) review_count, sum(rating)::double rating_sum,
        count(*) filter (where rating <= 2) neg_count, count(*) filter (where verified_purchase) verified_count,
        coalesce(sum(rating) filter (where verified_purchase), 0)::double verified_rating_sum,
        count(*) filter (where text_word_count > 0) nonempty_text_count, count(*) filter (where text_word_count >= 20) long_text_count,
        count(distinct user_id) distinct_users
      from f group by 1, 2)"""
_MONTH = lambda x: f"printf('%04d-%02d', ({x}) // 12, ({x}) % 12 + 1)"
SPINE = f"""{MONTHS},
c as (select parent_asin, unnest(generate_series(min(ix), max(ix))) ix from m group by 1),
sp as (select c.parent_asin, c.ix, {", ".join(f"coalesce(m.{x}, 0) {x}" for x in ("review_count", "rating_sum", "neg_count", "verified_count", "verified_rating_sum", "nonempty_text_count", "long_text_count", "distinct_users"))}
       from c left join m on c.parent_asin = m.parent_asin and c.ix = m.ix)"""
POINTS = f"""{SPINE},
w as (select parent_asin, ix,
        {", ".join(f"sum({x}) over {n} {n}_{x}" for n in ("b", "r") for x in decline.MEASURES)},
        {", ".join(f"count(*) filter (where review_count > 0) over {n} {n}_active, count(*) over {n} {n}_months" for n in ("b", "r"))}
      from sp window b as (partition by parent_asin order by ix rows between {RULE.baseline - 1} preceding and current row),
                     r as (partition by parent_asin order by ix rows between 1 following and {RULE.recent} following)),
e as (select *, case when b_review_count > 0 then b_rating_sum / b_review_count end baseline_mean,
        case when r_review_count > 0 then r_rating_sum / r_review_count end recent_mean,
        case when b_review_count < {RULE.min_reviews} then 'baseline_reviews' when b_active < {RULE.min_active} then 'baseline_active_months'
             when r_review_count < {RULE.min_reviews} then 'recent_reviews' when r_active < {RULE.min_active} then 'recent_active_months' end unevaluable_reason
      from w where b_months = {RULE.baseline} and r_months = {RULE.recent}),
p as (select *, {_MONTH("ix")} point_month, unevaluable_reason is null evaluable,
        case when unevaluable_reason is null then recent_mean <= baseline_mean - {RULE.delta} end as cond,
        case when unevaluable_reason is null then baseline_mean - recent_mean end as dropped
      from e)"""
EPISODES = f"""{POINTS.replace("f as (", "f as (", 1)},
n as (select *, row_number() over (partition by parent_asin order by ix) k, count(*) over (partition by parent_asin) last_k from p),
walk as (
  select parent_asin, 0::bigint k, null::bigint ix, 0 run, null::bigint start, false is_open, null::bigint alerted, null::bigint sup, 0 ev, 0 su,
         null::double d0, null::double mx, 0 falses, 0 gaps, null::varchar closed_by, null::bigint c_start, null::bigint c_alert, null::bigint c_sup, 0 c_ev, 0 c_su, null::double c_d0, null::double c_mx
  from n where k = 1
  union all
  select q.parent_asin, q.k, q.ix,
    case when q.closing is not null then 0 when q.is_open then q.run when q.good then q.run + 1 else 0 end,
    case when q.closing is not null then null when q.is_open then q.start when q.good then coalesce(q.start, q.ix) end,
    case when q.closing is not null then false when q.is_open then true else q.good and q.run + 1 >= {RULE.persistence} end,
    case when q.is_open then q.alerted when q.good and q.run + 1 >= {RULE.persistence} then q.ix end,
    case when q.is_open and not q.good then q.sup when q.good then q.ix end,
    case when q.is_open then q.ev + q.evaluable::int when q.good then q.run + 1 else 0 end,
    case when q.is_open then q.su + q.good::int when q.good then q.run + 1 else 0 end,
    case when q.is_open then q.d0 when q.good then q.dropped end,
    case when q.is_open and q.good then greatest(q.mx, q.dropped) when q.is_open then q.mx when q.good then q.dropped end,
    case when not q.is_open or q.good or q.closing is not null then 0 when q.evaluable then q.falses + 1 else q.falses end,
    case when not q.is_open or q.evaluable or q.closing is not null then 0 else q.gaps + 1 end,
    q.closing, q.start, q.alerted, q.sup, q.ev + q.evaluable::int, q.su, q.d0, q.mx
  from (select n.parent_asin, n.k, n.ix, n.evaluable, coalesce(n.cond, false) good, n.dropped, z.run, z.start, z.is_open, z.alerted, z.sup, z.ev, z.su, z.d0, z.mx, z.falses, z.gaps,
          case when z.is_open and not n.evaluable and z.gaps + 1 > {RULE.max_gap} then 'gap'
               when z.is_open and n.evaluable and not n.cond and z.falses + 1 >= {RULE.recovery} then 'recovery' end closing
        from walk z join n on n.parent_asin = z.parent_asin and n.k = z.k + 1) q),
eps as (
  select parent_asin, c_start s, c_alert a, c_sup l, ix c, closed_by, c_ev ev, c_su su, c_d0 d0, c_mx mx from walk where closed_by is not null
  union all
  select walk.parent_asin, start, alerted, sup, walk.ix, 'end_of_data', ev, su, d0, mx from walk join n on n.parent_asin = walk.parent_asin and n.k = walk.k
  where is_open and n.k = n.last_k),
ep as (select parent_asin, parent_asin || ':' || {_MONTH("s")} episode_id, {_MONTH("s")} condition_started_at, {_MONTH("a")} alert_triggered_at, {_MONTH("l")} last_supported_at,
         {_MONTH("c")} episode_closed_at, {_MONTH(f"a + {RULE.recent}")} alert_complete_month, closed_by, ev evaluable_points, su supported_points, d0 drop_at_alert, mx max_drop from eps)"""
_R = lambda *c: ", ".join(f"round({x}, 9) {x}" for x in c)
_SHARE = lambda a, b, n: f"round(case when {b} > 0 then {a} / {b} end, 9) {n}"

ORACLE = {
    "gold_product_months": f"with {MONTHS} select * from m",
    "gold_spine": f"""with {SPINE}
select parent_asin, {_MONTH("ix")} as month, review_count, rating_sum, neg_count, verified_count, verified_rating_sum, nonempty_text_count, long_text_count, distinct_users,
  {_SHARE("rating_sum", "review_count", "mean_rating")}, {_SHARE("neg_count", "review_count", "neg_share")}, {_SHARE("verified_count", "review_count", "verified_share")} from sp""",
    "gold_span_check": f"""with {SPINE}
select count(*) spine_rows, sum(review_count)::bigint reviews_on_spine, (select sum(k) from (select max(ix) - min(ix) + 1 k from m group by parent_asin))::bigint months_due,
  (select sum(review_count) from m)::bigint reviews from sp""",
    "gold_dashboard": f"""with {MONTHS}
select {_MONTH("ix")} as month, sum(review_count)::bigint reviews, sum(neg_count)::bigint negatives, count(*) products, round(sum(rating_sum) / sum(review_count), 9) mean_rating
from m group by ix""",
    "gold_top_products": f"""with {MONTHS}
select parent_asin, sum(review_count)::bigint reviews, sum(neg_count)::bigint negatives, count(*) as "months" from m group by 1 order by 2 desc, 1 limit 15""",
    "gold_month_presence": f"""with {MONTHS}, g as (select parent_asin, ix - lag(ix) over (partition by parent_asin order by ix) - 1 gap from m)
select parent_asin, count(*) active_months, coalesce(max(gap), 0) longest_gap from g group by 1""",
    "gold_points": f"""with {POINTS}
select parent_asin, point_month, b_review_count::bigint baseline_reviews, b_active::bigint baseline_active_months, {_R("baseline_mean")},
  {_SHARE("b_neg_count", "b_review_count", "baseline_neg_share")}, {_SHARE("b_verified_rating_sum", "b_verified_count", "baseline_verified_mean")},
  b_nonempty_text_count::bigint baseline_nonempty_text, b_long_text_count::bigint baseline_long_text,
  r_review_count::bigint recent_reviews, r_active::bigint recent_active_months, {_R("recent_mean")},
  {_SHARE("r_neg_count", "r_review_count", "recent_neg_share")}, {_SHARE("r_verified_rating_sum", "r_verified_count", "recent_verified_mean")},
  r_nonempty_text_count::bigint recent_nonempty_text, r_long_text_count::bigint recent_long_text, evaluable, unevaluable_reason, cond as condition, round(dropped, 9) as "drop"
from p""",
    "gold_unevaluable": f"with {POINTS} select unevaluable_reason, count(*) points, count(distinct parent_asin) products from p group by 1",
    "gold_episodes": f"with recursive {EPISODES} select * replace (round(drop_at_alert, 9) as drop_at_alert, round(max_drop, 9) as max_drop) from ep",
    "gold_point_episodes": f"""with recursive {EPISODES}
select p.parent_asin, p.point_month, p.evaluable, ep.episode_id
from p left join ep on p.parent_asin = ep.parent_asin and p.point_month between ep.condition_started_at and ep.episode_closed_at""",
    "gold_never_alerting": f"with recursive {EPISODES} select distinct parent_asin from p where parent_asin not in (select parent_asin from ep)",
    "gold_case_outcomes": f"""with recursive {EPISODES},
cand as (select p.*, ep.episode_id from ep join p on p.parent_asin = ep.parent_asin and p.point_month = ep.alert_triggered_at),
pool as (select * from p where parent_asin not in (select parent_asin from ep) and evaluable and not cond
           and b_nonempty_text_count >= 1 and r_nonempty_text_count >= 1),
r as (select c.episode_id, q.parent_asin control_asin, c.point_month, round(abs(q.baseline_mean - c.baseline_mean), 12) dm,
        round(abs(log2(q.b_review_count / c.b_review_count)), 12) dv, q.baseline_mean, q.b_review_count, q.recent_mean, q.r_review_count
      from cand c join pool q on q.ix = c.ix and q.parent_asin <> c.parent_asin
      where abs(q.baseline_mean - c.baseline_mean) <= 0.5 and q.b_review_count / c.b_review_count between 0.5 and 2),
k as (select episode_id, least(count(*), 2) n from r group by 1)
select episode_id, coalesce(n, 0) controls, case when least(b_nonempty_text_count, r_nonempty_text_count) < 1 then 'too_little_text' when coalesce(n, 0) = 0 then 'no_control' when n < 2 then 'too_few_controls' end drop_reason
from cand left join k using (episode_id)""",
    "gold_matched_controls": f"""with recursive {EPISODES},
cand as (select p.*, ep.episode_id from ep join p on p.parent_asin = ep.parent_asin and p.point_month = ep.alert_triggered_at),
pool as (select * from p where parent_asin not in (select parent_asin from ep) and evaluable and not cond
           and b_nonempty_text_count >= 1 and r_nonempty_text_count >= 1),
r as (select c.episode_id, q.parent_asin control_asin, c.point_month, round(abs(q.baseline_mean - c.baseline_mean), 12) dm,
        round(abs(log2(q.b_review_count / c.b_review_count)), 12) dv, q.baseline_mean, q.b_review_count, q.recent_mean, q.r_review_count
      from cand c join pool q on q.ix = c.ix and q.parent_asin <> c.parent_asin
      where abs(q.baseline_mean - c.baseline_mean) <= 0.5 and q.b_review_count / c.b_review_count between 0.5 and 2)
select * from (
  select episode_id, control_asin, point_month, row_number() over (partition by episode_id order by dm, dv, control_asin) control_rank,
    round(dm, 9) baseline_mean_diff, round(dv, 9) abs_log2_volume_ratio, round(baseline_mean, 9) control_baseline_mean, b_review_count::bigint control_baseline_reviews,
    round(recent_mean, 9) control_recent_mean, r_review_count::bigint control_recent_reviews from r)
where control_rank <= 2""",
}
