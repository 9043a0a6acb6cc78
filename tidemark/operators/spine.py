"""Monthly aggregates and the complete calendar of every product."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import month_ix, month_text

LONG_WORDS = 20
COUNTS = ("review_count", "neg_count", "verified_count", "nonempty_text_count", "long_text_count")
SUMS = ("rating_sum", "verified_rating_sum")


def monthly(reviews: DataFrame) -> DataFrame:
    """(parent_asin, ix) with counts and sums of its reviews."""
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    return reviews.groupBy("parent_asin", month_ix(F.col("event_ts")).alias("ix")).agg(
        F.count(F.lit(1)).alias("review_count"),
        F.sum(F.col("rating").cast("double")).alias("rating_sum"),
        n(F.col("rating") <= 2).alias("neg_count"),
        n(F.col("verified_purchase")).alias("verified_count"),
        F.sum(F.when(F.col("verified_purchase"), F.col("rating").cast("double")).otherwise(0.0)).alias("verified_rating_sum"),
        n(F.col("text_word_count") > 0).alias("nonempty_text_count"),
        n(F.col("text_word_count") >= LONG_WORDS).alias("long_text_count"),
        F.count_distinct("user_id").alias("distinct_users"),
    )


def spine(months: DataFrame) -> DataFrame:
    """Every month from a product's first to its last: counts 0 and rates null where it has no reviews."""
    span = months.groupBy("parent_asin").agg(F.min("ix").alias("lo"), F.max("ix").alias("hi"))
    every = span.select("parent_asin", F.explode(F.sequence("lo", "hi")).alias("ix"))
    filled = every.join(months, ["parent_asin", "ix"], "left").na.fill(0)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return filled.select(
        "*",
        month_text(F.col("ix")).alias("month"),
        share("rating_sum", "review_count").alias("mean_rating"),
        share("neg_count", "review_count").alias("neg_share"),
        share("verified_count", "review_count").alias("verified_share"),
    )


def span_check(months: DataFrame) -> DataFrame:
    """One row: spine rows, months that the spans call for, and reviews on both sides."""
    s = spine(months)
    want = months.groupBy("parent_asin").agg((F.max("ix") - F.min("ix") + 1).alias("n")).agg(F.sum("n").alias("months_due"))
    have = s.agg(F.count(F.lit(1)).alias("spine_rows"), F.sum("review_count").alias("reviews_on_spine"))
    total = months.agg(F.sum("review_count").alias("reviews"))
    return have.join(want, F.lit(True)).join(total, F.lit(True))


def weighted_dashboard(months: DataFrame) -> DataFrame:
    """Per month: reviews, negatives, products, and the mean rating weighted by reviews."""
    return months.groupBy(month_text(F.col("ix")).alias("month")).agg(
        F.sum("review_count").alias("reviews"),
        F.sum("neg_count").alias("negatives"),
        F.count(F.lit(1)).alias("products"),
        F.round(F.sum("rating_sum") / F.sum("review_count"), 9).alias("mean_rating"),
    )


def top_products(months: DataFrame, k: int = 15) -> DataFrame:
    """The k products with most reviews; ties by product."""
    return (
        months.groupBy("parent_asin")
        .agg(F.sum("review_count").alias("reviews"), F.sum("neg_count").alias("negatives"), F.count(F.lit(1)).alias("months"))
        .orderBy(F.desc("reviews"), "parent_asin")
        .limit(k)
    )


def month_presence(months: DataFrame) -> DataFrame:
    """Products by number of active months and longest gap between them."""
    w = Window.partitionBy("parent_asin").orderBy("ix")
    gaps = months.select("parent_asin", (F.col("ix") - F.lag("ix").over(w) - 1).alias("gap"))
    return gaps.groupBy("parent_asin").agg(F.count(F.lit(1)).alias("active_months"), F.coalesce(F.max("gap"), F.lit(0)).alias("longest_gap"))
