"""Figures that describe a table: quantiles, distributions, digests, anatomy of shared keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(df: DataFrame, *columns: str) -> DataFrame:
    """An order-free digest of content: row count and XOR of row hashes, one row."""
    return df.agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.lower(F.hex(F.coalesce(F.bit_xor(F.xxhash64(*columns)), F.lit(0))))).alias("digest"))


def distribution(df: DataFrame, column: Column, name: str) -> DataFrame:
    """(value, rows, percent of all rows)."""
    total = df.agg(F.count(F.lit(1))).scalar()
    g = df.groupBy(column.alias(name)).agg(F.count(F.lit(1)).alias("rows"))
    return g.select(name, "rows", F.round(100 * F.col("rows") / total, 2).alias("percent"))


def quantiles(df: DataFrame, column: str, at: list[float], accuracy: int = 10_000) -> DataFrame:
    """One row: approximate quantiles, mean, and maximum."""
    q = F.percentile_approx(column, at, accuracy)
    return df.agg(q.alias("q"), F.avg(column).alias("mean"), F.max(column).alias("most")).select(
        *(F.col("q")[i].alias(f"p{round(p * 100)}") for i, p in enumerate(at)), "mean", "most"
    )


def shared_keys(reviews: DataFrame) -> DataFrame:
    """(group_size, groups, exact, conflicting, products): how keys with several rows are made up."""
    fields = ["rating", "title", "text", "helpful_vote", "verified_purchase"]
    alike = [F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))).alias(c) for c in fields]
    g = reviews.groupBy("review_id").agg(F.count(F.lit(1)).alias("group_size"), F.count_distinct("parent_asin").alias("products"), *alike).where("group_size > 1")
    same = F.greatest(*fields) == 1
    return g.groupBy("group_size").agg(
        F.count(F.lit(1)).alias("groups"), F.sum(same.cast("int")).cast("long").alias("exact"), F.sum((~same).cast("int")).cast("long").alias("conflicting"),
        F.max("products").alias("most_products"), *(F.sum((F.col(c) > 1).cast("int")).cast("long").alias(f"{c}_differs") for c in fields),
    )


def single_value(df: DataFrame, column: str) -> DataFrame:
    """One row: the only value of a column, or null where there are several or none."""
    return df.agg(F.when(F.min(column) == F.max(column), F.min(column)).alias("value"), (F.min(column) != F.max(column)).alias("several"))
