"""Evidence by group, byte positions of lines, send orders, and the identities that counts must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir


def frequent_groups(df: DataFrame, key: str, least: int, show: Column, first_by: Column) -> DataFrame:
    """(key, rows, shown): keys with at least ``least`` rows and one column of their first row."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.min_by(show, first_by).alias("shown")).where(F.col("rows") >= least)


def aspect_support(df: DataFrame, aspects: str, share: float = 0.03, products: int = 2) -> DataFrame:
    """Per aspect: reviews, low-rated reviews and products that name it, and whether it is supported.

    ``df`` is (review_id, parent_asin, rating, aspects array).  A review counts
    once for an aspect; the share is of all reviews, aspects or none.
    """
    total = df.select("review_id").distinct().agg(F.count(F.lit(1))).scalar()
    x = df.select("review_id", "parent_asin", "rating", F.explode(F.array_distinct(aspects)).alias("aspect"))
    g = x.groupBy("aspect").agg(
        F.count_distinct("review_id").alias("reviews"), F.count_distinct(F.when(F.col("rating") <= 2, F.col("review_id"))).alias("low_reviews"), F.count_distinct("parent_asin").alias("products")
    )
    return g.withColumn("supported", (F.col("reviews") >= total * share) & (F.col("products") >= products))


def window_evidence(df: DataFrame, windows: DataFrame, themes: str, quote: str) -> DataFrame:
    """Per product window and theme: reviews and the first quote in alphabetical order; reviews without theme give a null one."""
    w = windows.select(F.col("parent_asin").alias("w_asin"), "window", "lo", "hi")
    inside = (F.col("parent_asin") == F.col("w_asin")) & F.col("ix").between(F.col("lo"), F.col("hi"))
    x = df.join(w, inside).select("parent_asin", "window", "review_id", quote, F.explode_outer(themes).alias("theme"))
    return x.groupBy("parent_asin", "window", "theme").agg(F.count_distinct("review_id").alias("reviews"), F.min(quote).alias("first_quote"))


def byte_offsets(lines: DataFrame, order: list[str], line: str) -> DataFrame:
    """Where each line of a file in this order begins, and its digest: (..., byte_from, bytes, sha256).

    Sizes are summed within sorted partitions and partition totals are added,
    so no task sees the whole file.
    """
    shared_dir(lines.sparkSession)
    size = F.octet_length(F.coalesce(F.col(line), F.lit("")))
    placed = lines.select(*order, size.cast("long").alias("bytes"), F.sha2(F.coalesce(F.col(line), F.lit("")), 256).alias("sha256")).orderBy(*order)
    placed = placed.withColumn("_part", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("_part").agg(F.sum(F.col("bytes") + 1).alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(F.broadcast(base), "_part").withColumn("byte_from", F.col("_base") + F.coalesce(F.sum(F.col("bytes") + 1).over(own), F.lit(0))).drop("_part", "_base")


def send_order(positions: DataFrame, moved: DataFrame) -> DataFrame:
    """A permutation of a sorted stream in which some rows are held back: (slot, id, held).

    ``positions`` (pos, id), ``moved`` (id, pos): a held row goes just before
    the row at ``pos``, or last where that is null; held rows of one place keep
    their own order.
    """
    held = moved.select("id", F.col("pos").alias("before"))
    x = positions.join(held.withColumn("held", F.lit(True)), "id", "left").withColumn("held", F.coalesce("held", F.lit(False)))
    place = F.when(F.col("held"), F.coalesce("before", F.lit(2**62))).otherwise(F.col("pos"))
    from .ordering import numbered

    return numbered(x.select("id", "held", place.alias("place"), F.when(F.col("held"), 0).otherwise(1).alias("turn"), "pos"), "place", "turn", "pos", column="slot").select("slot", "id", "held")


def confusion(df: DataFrame, said: Column, found: Column) -> DataFrame:
    """(said, found, rows) of two classifications of the same rows."""
    return df.groupBy(said.alias("said"), found.alias("found")).agg(F.count(F.lit(1)).alias("rows"))


def resume(work: DataFrame, done: DataFrame, key: str, retry: Column) -> DataFrame:
    """Work whose key isn't done; done rows for which ``retry`` holds don't count."""
    return work.join(done.where(~F.coalesce(retry, F.lit(False))).select(key), key, "left_anti")
