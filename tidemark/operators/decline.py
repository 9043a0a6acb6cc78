"""Sustained declines: two windows at every month, and episodes with hysteresis.

Point statistics are ROWS frames over the complete spine.  The episode machine
is a fold over the ordered points of a product; a calendar bounds their number,
so the fold runs inside the JVM on an array of that length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import month_text


@dataclass(frozen=True)
class Rule:
    """Windows in months, the drop, and how many points start, end or interrupt an episode."""

    baseline: int = 3
    recent: int = 3
    delta: float = 0.5
    persistence: int = 2
    max_gap: int = 1
    recovery: int = 2
    min_reviews: int = 4
    min_active: int = 2
    holdout_ix: int | None = None
    frozen: bool = True


MEASURES = ("review_count", "rating_sum", "neg_count", "verified_count", "verified_rating_sum", "nonempty_text_count", "long_text_count")


def points(spine: DataFrame, rule: Rule) -> DataFrame:
    """Evaluation points: both windows' figures, whether they can be compared, and the condition.

    The baseline ends with the point's month, the recent window begins after
    it; only points with both windows complete exist.
    """
    base = Window.partitionBy("parent_asin").orderBy("ix").rowsBetween(1 - rule.baseline, 0)
    recent = Window.partitionBy("parent_asin").orderBy("ix").rowsBetween(1, rule.recent)
    active = F.when(F.col("review_count") > 0, 1).otherwise(0)
    cols = []
    for name, w in (("b", base), ("r", recent)):
        cols += [F.sum(m).over(w).alias(f"{name}_{m}") for m in MEASURES]
        cols += [F.sum(active).over(w).alias(f"{name}_active"), F.count(F.lit(1)).over(w).alias(f"{name}_months")]
    x = spine.select("parent_asin", "ix", *cols).where((F.col("b_months") == rule.baseline) & (F.col("r_months") == rule.recent))
    if rule.holdout_ix is not None and not rule.frozen:
        x = x.where(F.col("ix") < rule.holdout_ix)
    mean = lambda s, n: F.when(F.col(n) > 0, F.col(s) / F.col(n))
    x = x.withColumn("baseline_mean", mean("b_rating_sum", "b_review_count")).withColumn("recent_mean", mean("r_rating_sum", "r_review_count"))
    reason = (
        F.when(F.col("b_review_count") < rule.min_reviews, "baseline_reviews")
        .when(F.col("b_active") < rule.min_active, "baseline_active_months")
        .when(F.col("r_review_count") < rule.min_reviews, "recent_reviews")
        .when(F.col("r_active") < rule.min_active, "recent_active_months")
    )
    ok = F.col("unevaluable_reason").isNull()
    return x.withColumn("unevaluable_reason", reason).select(
        "parent_asin",
        "ix",
        month_text(F.col("ix")).alias("point_month"),
        F.col("b_review_count").alias("baseline_reviews"),
        F.col("b_active").alias("baseline_active_months"),
        "baseline_mean",
        mean("b_neg_count", "b_review_count").alias("baseline_neg_share"),
        mean("b_verified_rating_sum", "b_verified_count").alias("baseline_verified_mean"),
        F.col("b_nonempty_text_count").alias("baseline_nonempty_text"),
        F.col("b_long_text_count").alias("baseline_long_text"),
        F.col("r_review_count").alias("recent_reviews"),
        F.col("r_active").alias("recent_active_months"),
        "recent_mean",
        mean("r_neg_count", "r_review_count").alias("recent_neg_share"),
        mean("r_verified_rating_sum", "r_verified_count").alias("recent_verified_mean"),
        F.col("r_nonempty_text_count").alias("recent_nonempty_text"),
        F.col("r_long_text_count").alias("recent_long_text"),
        ok.alias("evaluable"),
        "unevaluable_reason",
        F.when(ok, F.col("recent_mean") <= F.col("baseline_mean") - F.lit(rule.delta)).alias("condition"),
        F.when(ok, F.col("baseline_mean") - F.col("recent_mean")).alias("drop"),
    )


_EPISODE = "started int, alerted int, supported int, closed int, closed_by string, evaluable_points int, supported_points int, baseline_mean double, recent_mean double, drop_at_alert double, max_drop double"


def _fold(rule: Rule):
    """The transition of one point: state is (run, start, open episode or null, falses, gaps, finished episodes)."""
    kind = f"struct<{_EPISODE.replace(', ', ',').replace(' ', ':')}>"
    none = F.lit(None)

    def step(s: Column, p: Column) -> Column:
        zero, ep, done = F.lit(0), s["ep"], s["done"]
        run, start = s["run"] + 1, F.coalesce(s["start"], p["ix"])

        def episode(**new: Column) -> Column:
            names = [x.split()[0] for x in _EPISODE.split(", ")]
            return F.struct(*(new.get(n, ep[n]).alias(n) for n in names))

        opened = F.struct(
            start.alias("started"), p["ix"].alias("alerted"), p["ix"].alias("supported"), none.cast("int").alias("closed"), none.cast("string").alias("closed_by"),
            run.alias("evaluable_points"), run.alias("supported_points"), p["baseline_mean"].alias("baseline_mean"), p["recent_mean"].alias("recent_mean"),
            p["drop"].alias("drop_at_alert"), p["drop"].alias("max_drop"),
        )
        null_ep = none.cast(kind)
        mk = lambda run, start, ep, falses, gaps, done: F.struct(
            run.cast("int").alias("run"), start.cast("int").alias("start"), ep.cast(kind).alias("ep"), falses.cast("int").alias("falses"), gaps.cast("int").alias("gaps"), done.alias("done")
        )
        shut = lambda e: mk(zero, none.cast("int"), null_ep, zero, zero, F.concat(done, F.array(e.cast(kind))))
        idle = mk(zero, none.cast("int"), null_ep, zero, zero, done)
        waiting = (
            F.when(~p["evaluable"] | ~F.coalesce(p["condition"], F.lit(False)), idle)
            .when(run >= rule.persistence, mk(run, start, opened, zero, zero, done))
            .otherwise(mk(run, start, null_ep, zero, zero, done))
        )
        more = ep["evaluable_points"] + 1
        during = (
            F.when(~p["evaluable"] & (s["gaps"] + 1 > rule.max_gap), shut(episode(closed=p["ix"], closed_by=F.lit("gap"))))
            .when(~p["evaluable"], mk(s["run"], s["start"], ep, s["falses"], s["gaps"] + 1, done))
            .when(
                p["condition"],
                mk(s["run"], s["start"], episode(supported=p["ix"], evaluable_points=more, supported_points=ep["supported_points"] + 1, max_drop=F.greatest(ep["max_drop"], p["drop"])), zero, zero, done),
            )
            .when(s["falses"] + 1 >= rule.recovery, shut(episode(closed=p["ix"], closed_by=F.lit("recovery"), evaluable_points=more)))
            .otherwise(mk(s["run"], s["start"], episode(evaluable_points=more), s["falses"] + 1, zero, done))
        )
        return F.when(ep.isNull(), waiting).otherwise(during)

    start = F.struct(
        F.lit(0).alias("run"), none.cast("int").alias("start"), none.cast(kind).alias("ep"), F.lit(0).alias("falses"), F.lit(0).alias("gaps"), F.array().cast(f"array<{kind}>").alias("done")
    )
    return start, step


def episodes(pts: DataFrame, rule: Rule) -> DataFrame:
    """Episodes of every product; one still open at its last point is closed by the end of data."""
    start, step = _fold(rule)
    x = pts.groupBy("parent_asin").agg(
        F.sort_array(F.collect_list(F.struct("ix", "evaluable", "condition", "baseline_mean", "recent_mean", "drop"))).alias("p")
    )
    folded = x.select("parent_asin", F.aggregate("p", start, step).alias("s"), F.element_at("p", -1)["ix"].alias("last"))
    left = F.when(F.col("s.ep").isNotNull(), F.array(F.col("s.ep").withField("closed", F.col("last")).withField("closed_by", F.lit("end_of_data")))).otherwise(
        F.array().cast(folded.select("s.done").schema[0].dataType)
    )
    return folded.select("parent_asin", F.explode(F.concat("s.done", left)).alias("e")).select(
        "parent_asin",
        F.concat_ws(":", "parent_asin", month_text(F.col("e.started"))).alias("episode_id"),
        *(month_text(F.col(f"e.{a}")).alias(b) for a, b in (("started", "condition_started_at"), ("alerted", "alert_triggered_at"), ("supported", "last_supported_at"), ("closed", "episode_closed_at"))),
        month_text(F.col("e.alerted") + rule.recent).alias("alert_complete_month"),
        *(F.col(f"e.{c}").alias(c) for c in ("closed_by", "evaluable_points", "supported_points", "drop_at_alert", "max_drop")),
    )


def point_episodes(pts: DataFrame, eps: DataFrame) -> DataFrame:
    """Points with the episode that spans them, the closing one included, or null."""
    e = eps.select(F.col("parent_asin").alias("e_asin"), "episode_id", "condition_started_at", "episode_closed_at")
    inside = (F.col("parent_asin") == F.col("e_asin")) & F.col("point_month").between(F.col("condition_started_at"), F.col("episode_closed_at"))
    return pts.join(e, inside, "left").select(*pts.columns, "episode_id")
