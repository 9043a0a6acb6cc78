"""Controls for cases, and reproducible draws."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import draw_key


def never_alerting(points: DataFrame, episodes: DataFrame) -> DataFrame:
    """Points of products without any episode."""
    return points.join(episodes.select("parent_asin"), "parent_asin", "left_anti")


def candidate_points(points: DataFrame, episodes: DataFrame) -> DataFrame:
    """The point at which each episode alerted; an episode without its point is an error."""
    e = episodes.select("parent_asin", F.col("alert_triggered_at").alias("point_month"), "episode_id")
    # a left join keeps lost episodes, so that they stop the job instead of vanishing
    j = e.join(points.withColumn("_here", F.lit(True)), ["parent_asin", "point_month"], "left")
    lost = F.raise_error(F.concat(F.lit("no evaluation point of episode "), F.col("episode_id")))
    return j.withColumn("episode_id", F.when(F.col("_here").isNull(), lost).otherwise(F.col("episode_id"))).drop("_here")


def matched_controls(
    points: DataFrame, episodes: DataFrame, per_case: int = 2, mean_diff: float = 0.5, ratio: tuple[float, float] = (0.5, 2.0), texts: int = 1, long_texts: int = 0
) -> DataFrame:
    """The nearest never-alerting products of the same month for each episode.

    Products need ``texts`` reviews with text and ``long_texts`` long ones in
    both windows.  Means and volumes are bucketed as wide as they may differ, so
    a case only meets products of its month in the neighbouring buckets; ranks
    by difference of means, then of log volumes, then product.
    """
    wide = float(max(abs(math.log2(r)) for r in ratio)) or 1.0
    pool = never_alerting(points, episodes).where(
        F.col("evaluable") & ~F.col("condition") & (F.col("baseline_reviews") > 0)
        & (F.least("baseline_nonempty_text", "recent_nonempty_text") >= texts) & (F.least("baseline_long_text", "recent_long_text") >= long_texts)
    )
    cell = lambda c, width: F.floor(c / F.lit(width)).cast("int")
    near = lambda c: F.explode(F.array(c - 1, c, c + 1))
    cases = candidate_points(points, episodes).select(
        "ix", "point_month", "episode_id", F.col("parent_asin").alias("case_asin"), F.col("baseline_mean").alias("case_mean"), F.col("baseline_reviews").alias("case_reviews")
    )
    cases = cases.select("*", near(cell(F.col("case_mean"), mean_diff)).alias("_m")).select("*", near(cell(F.log2("case_reviews"), wide)).alias("_v"))
    pool = pool.drop("point_month").withColumn("_m", cell(F.col("baseline_mean"), mean_diff)).withColumn("_v", cell(F.log2("baseline_reviews"), wide))
    volume = F.col("baseline_reviews") / F.col("case_reviews")
    diff = F.abs(F.col("baseline_mean") - F.col("case_mean"))
    pairs = cases.join(pool, ["ix", "_m", "_v"]).where((F.col("parent_asin") != F.col("case_asin")) & (diff <= mean_diff) & volume.between(*ratio))
    order = Window.partitionBy("episode_id").orderBy("baseline_mean_diff", "abs_log2_volume_ratio", "control_asin")
    return (
        pairs.select(
            "episode_id", F.col("parent_asin").alias("control_asin"), "point_month",
            F.round(diff, 12).alias("baseline_mean_diff"), F.round(F.abs(F.log2(volume)), 12).alias("abs_log2_volume_ratio"),
            F.col("baseline_mean").alias("control_baseline_mean"), F.col("baseline_reviews").alias("control_baseline_reviews"),
            F.col("recent_mean").alias("control_recent_mean"), F.col("recent_reviews").alias("control_recent_reviews"),
        )
        .withColumn("control_rank", F.row_number().over(order))
        .where(F.col("control_rank") <= per_case)
    )


def case_outcomes(points: DataFrame, episodes: DataFrame, controls: DataFrame, per_case: int = 2, texts: int = 1) -> DataFrame:
    """(episode_id, controls, drop_reason): whether each case is kept; the first reason that drops it, else null."""
    found = controls.groupBy("episode_id").agg(F.count(F.lit(1)).alias("controls"))
    cases = candidate_points(points, episodes).select("episode_id", (F.least("baseline_nonempty_text", "recent_nonempty_text") >= texts).alias("texts"))
    j = cases.join(found, "episode_id", "left").withColumn("controls", F.coalesce("controls", F.lit(0)).cast("long"))
    why = F.when(~F.col("texts"), "too_little_text").when(F.col("controls") == 0, "no_control").when(F.col("controls") < per_case, "too_few_controls")
    return j.select("episode_id", "controls", why.alias("drop_reason"))


def smallest(df: DataFrame, identifier: str, k: int, seed: int, salt: str) -> DataFrame:
    """The k rows of the smallest draw key: a bounded top-k, no global sort."""
    return df.withColumn("draw", draw_key(F.col(identifier), seed, salt)).orderBy("draw", identifier).limit(k)


def stratified(df: DataFrame, stratum: Column, quota: dict[str, int], seed: int, salt: str, per_product: int) -> DataFrame:
    """In draw order up to ``quota`` rows of each stratum, at most ``per_product`` of one product within it.

    The product cap looks only at earlier rows of the same product, so the
    greedy draw equals two nested ranks.
    """
    keyed = df.withColumn("stratum", stratum).withColumn("draw", draw_key(F.col("review_id"), seed, salt))
    inner = Window.partitionBy("stratum", "parent_asin").orderBy("draw", "review_id")
    outer = Window.partitionBy("stratum").orderBy("draw", "review_id")
    limit = F.coalesce(*(F.when(F.col("stratum") == k, F.lit(n)) for k, n in quota.items()), F.lit(0))
    capped = keyed.withColumn("in_product", F.row_number().over(inner)).where(F.col("in_product") <= per_product)
    return capped.withColumn("rank", F.row_number().over(outer)).where(F.col("rank") <= limit).drop("in_product")


def enriched(df: DataFrame, matched: DataFrame, order: list[str], per_theme: int, total: int, seed: int, salt: str) -> DataFrame:
    """Per theme, in the given order, the rows with most matched terms not taken by an earlier theme; then a backfill.

    ``matched`` is (review_id, theme, terms).  Sequential by nature: one
    bounded top-k per theme, each an anti-join against the few rows taken so
    far, which are checkpointed so that no plan grows.
    """
    keyed = df.withColumn("draw", draw_key(F.col("review_id"), seed, salt))
    taken = keyed.sparkSession.createDataFrame([], "review_id string, stratum string")
    for theme in order:
        offers = keyed.join(matched.where((F.col("theme") == theme) & (F.col("terms") > 0)), "review_id").join(taken, "review_id", "left_anti")
        chosen = offers.orderBy(F.desc("terms"), "draw", "review_id").limit(per_theme).select("review_id", F.lit(f"enriched_{theme}").alias("stratum"))
        taken = taken.unionByName(chosen).checkpoint()
    missing = max(0, total - taken.count())
    rest = keyed.join(matched.where("terms > 0").select("review_id").distinct(), "review_id").join(taken, "review_id", "left_anti")
    back = rest.orderBy("draw", "review_id").limit(missing).select("review_id", F.lit("enriched_backfill").alias("stratum"))
    return taken.unionByName(back)


def proportional(df: DataFrame, stratum: str, total: int, seed: int, salt: str) -> DataFrame:
    """A sample whose strata have their share of ``total`` (floors first, the rest by largest remainder)."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    every = df.agg(F.count(F.lit(1))).scalar()
    share = sizes.select(stratum, F.floor(F.col("n") * total / every).alias("base"), (F.col("n") * total / every - F.floor(F.col("n") * total / every)).alias("rest"))
    left = F.lit(total) - share.agg(F.sum("base")).scalar()
    quota = share.withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("rest"), stratum))).select(
        stratum, (F.col("base") + F.when(F.col("r") <= left, 1).otherwise(0)).alias("quota")
    )
    w = Window.partitionBy(stratum).orderBy("draw", "review_id")
    ranked = df.withColumn("draw", draw_key(F.col("review_id"), seed, salt)).withColumn("rank", F.row_number().over(w))
    return ranked.join(quota, stratum).where(F.col("rank") <= F.col("quota")).drop("quota")


def blind(df: DataFrame, identifier: str, seed: int, salt: str, prefix: str) -> DataFrame:
    """(blind_id, identifier): rows in draw order under sequential names.

    A range sort gives the order; ranks come from counts per partition, so no
    single task sees all rows.
    """
    keyed = df.select(identifier, draw_key(F.col(identifier), seed, salt).alias("draw")).orderBy("draw", identifier)
    part = keyed.withColumn("part", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = part.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("part").orderBy("draw", identifier)
    return part.join(starts, "part").select(F.format_string(f"{prefix}-%06d", (F.col("base") + F.row_number().over(own)).cast("long")).alias("blind_id"), identifier)
