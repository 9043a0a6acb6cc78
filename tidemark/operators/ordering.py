"""Positions in a total order, as-of lookups, and the watermark of a replayed stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir


def numbered(df: DataFrame, *order: str | Column, column: str = "pos") -> DataFrame:
    """Rows with their position, from 0, in a total order.

    A range sort places rows; positions are ranks within a partition plus the
    sizes of those before, so no task sees more than its range.  The sorted
    rows are checkpointed, as ranges are drawn from samples.
    """
    shared_dir(df.sparkSession)
    placed = df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    ahead = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select("_part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_at")) - 1
    return placed.join(F.broadcast(starts), "_part").withColumn(column, (F.col("_base") + rank).cast("long")).drop("_part", "_at", "_base")


def disorder(positions: DataFrame, ts: str = "ts", bucket: int = 100_000) -> DataFrame:
    """Rows whose time is before that of the row ahead of them.

    Rows are compared within buckets of positions; the first row of a bucket
    meets the last of the one before.
    """
    b = F.floor(F.col("pos") / F.lit(bucket))
    w = Window.partitionBy("_b").orderBy("pos")
    inner = positions.withColumn("_b", b).withColumn("_prev", F.lag(ts).over(w))
    last = inner.groupBy("_b").agg(F.max_by(ts, "pos").alias("_last")).select((F.col("_b") + 1).alias("_b"), "_last")
    return inner.join(last, "_b", "left").where(F.col(ts) < F.coalesce("_prev", "_last")).drop("_b", "_prev", "_last")


def simulate_watermark(positions: DataFrame, batch: int, delay_ms: int, chunk: int = 10_000) -> DataFrame:
    """Rows that a streaming watermark would drop: (pos, batch, ts_ms).

    Batch N is filtered by the watermark that N - 2 and earlier batches set.
    ``positions`` is (pos, ts_ms), dense.  Windows run over batches of one range
    of ``chunk`` batches and over ranges, never over all batches.
    """
    rows = positions.select("pos", "ts_ms", F.floor(F.col("pos") / F.lit(batch)).alias("batch"))
    # what batch N shows is in force from batch N + 2 on: prefix maxima by range of batches, then over ranges
    top = rows.groupBy((F.col("batch") + 2).alias("batch")).agg(F.max("ts_ms").alias("top")).withColumn("_c", F.floor(F.col("batch") / F.lit(chunk)))
    inner = Window.partitionBy("_c").orderBy("batch")
    ahead = Window.partitionBy(F.lit(0)).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    before = top.groupBy("_c").agg(F.max("top").alias("t")).select("_c", F.max("t").over(ahead).alias("_before"))
    own = top.withColumn("_own", F.max("top").over(inner)).join(before, "_c")
    marks = own.select("batch", (F.greatest("_own", "_before") - F.lit(delay_ms)).alias("mark"))
    return rows.join(marks, "batch").where(F.col("ts_ms") < F.col("mark")).select("pos", "batch", "ts_ms")


def first_at_or_after(targets: DataFrame, positions: DataFrame, grain_ms: int = 86_400_000) -> DataFrame:
    """For each target (id, target_ms) the first position whose ts_ms is at or after it, or null.

    Rows are bucketed by ``grain_ms``: the answer is in the target's bucket or
    is the first row of the next one that has rows.
    """
    g = lambda c: F.floor(F.col(c) / F.lit(grain_ms))
    rows = positions.select("pos", "ts_ms", g("ts_ms").alias("bucket"))
    firsts = rows.groupBy("bucket").agg(F.min("pos").alias("first_pos"))
    t = targets.select("id", "target_ms", g("target_ms").alias("bucket"))
    same = t.join(rows, "bucket").where("ts_ms >= target_ms").groupBy("id").agg(F.min("pos").alias("same_pos"))
    # the first row after each bucket, for buckets of rows and of targets; a calendar bounds their number
    w = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)
    every = firsts.unionByName(t.select("bucket", F.lit(None).cast("bigint").alias("first_pos"))).groupBy("bucket").agg(F.min("first_pos").alias("first_pos"))
    after = every.select("bucket", F.first("first_pos", ignorenulls=True).over(w).alias("later_pos"))
    later = t.select("id", "bucket").join(after, "bucket").select("id", "later_pos")
    return t.select("id", "target_ms").join(same, "id", "left").join(later, "id", "left").select("id", "target_ms", F.coalesce("same_pos", "later_pos").alias("pos"))


def latest(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The row of each key that is last by ``order``; one state per key and task."""
    rest = [c for c in df.columns if c not in key and c not in order]
    return df.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_r")).select(*key, "_r.*")
