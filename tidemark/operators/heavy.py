"""Per-key results where a few keys hold most rows (problem 6).

Only algebraic aggregates are used: each task folds its rows into a bounded
hash table of key states, which spills sorted runs when it is full, and only
one compact state per task and key is shuffled.  A key with a third of all
rows therefore sends as many rows to its reducer as there are map tasks.
Exact distinct counts are planned by Spark in two steps, over (key, value)
first, so they have no hot reducer either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import upper_key


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows of each normalised key, (key, n); null and blank keys form the null key."""
    return df.select(upper_key(F.col(key)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def heavy_keys(df: DataFrame, key: str, percent: int = 1) -> DataFrame:
    """Keys that hold at least ``percent`` of all rows, those without key counted in the total; an empty table has none."""
    total = df.agg(F.count(F.lit(1))).scalar()
    counts = key_counts(df, key)
    return counts.where(F.col("key").isNotNull() & (F.col("n") * 100 >= total * percent)).select("key", "n")


def product_profile(reviews: DataFrame) -> DataFrame:
    """Counts, rating figures, votes and span of every product; null products are one group."""
    return reviews.groupBy("parent_asin").agg(
        F.count(F.lit(1)).alias("reviews"),
        F.sum(F.col("rating").cast("long")).alias("rating_sum"),
        F.avg("rating").alias("mean_rating"),
        F.sum(F.when(F.col("rating") <= 2, 1).otherwise(0)).alias("negatives"),
        F.sum(F.coalesce("helpful_vote", F.lit(0)).cast("long")).alias("votes"),
        F.min("event_ts").alias("first_ts"),
        F.max("event_ts").alias("last_ts"),
        F.count_distinct("user_id").alias("users"),
    )
