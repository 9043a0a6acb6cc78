"""Totals over trailing spans of a calendar (problem 3).

Each (entity, month) of the calendar is joined by range to the monthly totals
within its trailing bounds.  Coarse buckets, as long as the longest span, turn
the range join into an equi-join on (entity, bucket): a total lies in at most
two buckets.  Rows are first reduced to one per entity and month, with map-side
combining, so that an entity with a third of all rows costs no more afterwards
than any other: its totals are bounded by the length of the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import month_ix, month_key_ix, month_text
from ..session import shared_dir


def monthly_facts(df: DataFrame) -> DataFrame:
    """One row per product and month: (entity, ix, reviews, negatives, rating_sum).

    ``month_date`` tells the month, ``month`` where it is null; rows without
    product or month are no facts.  Of several rows the one with the highest
    source_silver_snapshot_id counts, once; further ties go to the largest row
    in column order.  A null count is 0; a missing rating_sum is mean_rating
    times review_count in whole numbers, 0 where that is unknown too.
    """
    picked = (
        df.select(
            F.col("parent_asin").alias("entity"),
            F.coalesce(month_ix(F.col("month_date")), month_key_ix(F.col("month"))).alias("ix"),
            F.struct("source_silver_snapshot_id", "review_count", "neg_count", "rating_sum", "mean_rating").alias("r"),
        )
        .where("entity is not null and ix is not null")
        .groupBy("entity", "ix")
        .agg(F.max("r").alias("r"))
    )
    n = F.coalesce("r.review_count", F.lit(0)).cast("long")
    return picked.select(
        "entity",
        "ix",
        n.alias("reviews"),
        F.coalesce("r.neg_count", F.lit(0)).cast("long").alias("negatives"),
        F.coalesce("r.rating_sum", F.round(F.col("r.mean_rating") * n), F.lit(0.0)).alias("rating_sum"),
    )


def trailing(facts: DataFrame, measures: Sequence[str], spans: Sequence[int]) -> DataFrame:
    """For every (entity, ix) from an entity's first to its last period: ``<measure>_<span>``.

    ``facts`` has one row per (entity, ix); other columns are ignored.  Periods
    without a fact are included.  Spans begin no earlier than the first period.
    An empty input gives an empty result.
    """
    width = max(spans)
    facts = facts.select("entity", "ix", *measures)
    calendar = (
        facts.groupBy("entity")
        .agg(F.min("ix").alias("lo"), F.max("ix").alias("hi"))
        .select("entity", F.explode(F.sequence("lo", "hi")).alias("ix"))
        .withColumn("bucket", F.floor(F.col("ix") / F.lit(width)))
    )
    bucketed = facts.select(
        F.col("entity").alias("f_entity"),
        F.col("ix").alias("f_ix"),
        *measures,
        F.explode(
            F.array_distinct(F.array(F.floor(F.col("ix") / F.lit(width)), F.floor((F.col("ix") + F.lit(width - 1)) / F.lit(width))))
        ).alias("f_bucket"),
    )
    age = F.col("ix") - F.col("f_ix")
    joined = calendar.join(
        bucketed,
        (F.col("entity") == F.col("f_entity")) & (F.col("bucket") == F.col("f_bucket")) & (age >= 0) & (age < width),
        "left",
    )
    totals = [
        F.coalesce(F.sum(F.when(age < s, F.col(m))), F.lit(0)).alias(f"{m}_{s}") for s in spans for m in measures
    ]
    return joined.groupBy("entity", "ix").agg(*totals)


def product_trailing(df: DataFrame, spans: Sequence[int] = (3, 12)) -> DataFrame:
    """Trailing review, negative and rating totals, and mean rating per review, by product and month.

    The monthly facts, which calendar and totals both need, are checkpointed,
    so the table is read once.
    """
    shared_dir(df.sparkSession)
    t = trailing(monthly_facts(df).checkpoint(), ["reviews", "negatives", "rating_sum"], spans)
    means = [F.try_divide(F.col(f"rating_sum_{s}"), F.col(f"reviews_{s}")).alias(f"mean_rating_{s}") for s in spans]
    return t.select(F.col("entity").alias("parent_asin"), month_text(F.col("ix")).alias("month"), *t.columns[2:], *means)


def turning_bad(df: DataFrame) -> DataFrame:
    """Product months whose last 3 months are clearly worse than their last 12.

    At least 10 reviews in 3 months, negatives per review at least 1.5 times
    those of 12 months, mean rating at least 0.5 lower.  Fractions are compared
    by cross multiplication, so nothing is rounded.
    """
    t = product_trailing(df)
    worse = F.expr("2 * negatives_3 * reviews_12 >= 3 * negatives_12 * reviews_3")
    lower = F.expr("2 * rating_sum_3 * reviews_12 <= 2 * rating_sum_12 * reviews_3 - reviews_3 * reviews_12")
    return t.where((F.col("reviews_3") >= 10) & worse & lower).select("parent_asin", "month")
