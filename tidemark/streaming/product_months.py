"""A watermarked stream of reviews, projected to product months.

Each micro-batch contributes additive counts, written to a partition named by
its batch id, so a repeated batch replaces itself.  The projection is the sum
of contributions.  Duplicates are dropped within the watermark: an identifier
contains the event time, so copies share it and meet in the state.  Late rows
behind the watermark are dropped and counted.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.keys import month_ix, month_text
from ..operators import late
from ..session import filesystem, scratch

ADDITIVE = ("review_count", "rating_sum", "neg_count", "verified_count")
DELAY = "30 days"


def drained(spark: SparkSession, source: str, schema, per_trigger: int = 1) -> DataFrame:
    """A bounded stream over files that arrive in a folder; any file format with a fixed schema would do."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(source)


def deduplicated(stream: DataFrame, delay: str = DELAY) -> DataFrame:
    return stream.withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(["review_id"])


def contributions(batch: DataFrame) -> DataFrame:
    """Additive figures of one batch: (parent_asin, ix, ...)."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return batch.groupBy("parent_asin", month_ix(F.col("event_ts")).alias("ix")).agg(
        F.count(F.lit(1)).alias("review_count"), F.sum(F.col("rating").cast("double")).alias("rating_sum"), n(F.col("rating") <= 2).alias("neg_count"), n(F.col("verified_purchase")).alias("verified_count")
    )


def start(stream: DataFrame, out: str, checkpoint: str, delay: str = DELAY) -> StreamingQuery:
    """Contributions of every micro-batch under ``out/batch_id=N``; exactly once across restarts."""

    def write(batch: DataFrame, batch_id: int) -> None:
        contributions(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return deduplicated(stream, delay).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def project(parts: DataFrame) -> DataFrame:
    """Product months from contributions."""
    g = parts.groupBy("parent_asin", "ix").agg(*(F.sum(c).alias(c) for c in ADDITIVE))
    return g.select("parent_asin", month_text(F.col("ix")).alias("month"), *ADDITIVE)


def progress(query: StreamingQuery) -> dict[str, int]:
    """Rows read, rows dropped behind the watermark, and batches with input; an error once history is incomplete."""
    reports = [p for p in query.recentProgress]
    if reports and reports[0]["batchId"] > 0 and len(reports) >= 100:
        raise RuntimeError("progress of early batches is no longer kept")
    dropped = sum(o.get("numRowsDroppedByWatermark", 0) for p in reports for o in p["stateOperators"])
    return {"rows": sum(p["numInputRows"] for p in reports), "dropped": dropped, "batches": sum(p["numInputRows"] > 0 for p in reports)}


def replay(reviews: DataFrame, files: int, order: str = "event_ts", exact: bool = False) -> str:
    """Write reviews as files in the given order, one micro-batch each; returns the folder.

    With ``exact`` the column holds the number of the file, else its ranges are
    cut alike.  A file source reads by modification time, so that is set a
    minute apart, in order.
    """
    spark = reviews.sparkSession
    folder = scratch(spark, "replay")
    if exact:
        for k in range(files):
            reviews.where(F.col(order) == k).drop(order).coalesce(1).write.mode("append").parquet(f"{folder}/{k:06d}")
        parents = [f"{folder}/{k:06d}" for k in range(files)]
    else:
        reviews.repartitionByRange(files, order).sortWithinPartitions(order).write.parquet(folder)
        parents = [folder]
    paths = []
    for parent in parents:
        fs, path = filesystem(spark, parent)
        paths += sorted((x.getPath() for x in fs.listStatus(path) if x.getPath().getName().startswith("part-")), key=lambda x: x.getName())
    now = int(time.time() * 1000)
    for i, part in enumerate(paths):
        fs.setTimes(part, now - 60_000 * (len(paths) - i), -1)
    return folder + "/*" if exact else folder


def run(reviews: DataFrame, files: int = 4, batch: str | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Replay, drain and project; waits for the end of the stream.  ``batch`` names a column with the number of each row's file."""
    spark = reviews.sparkSession
    source = replay(reviews, files, batch, True) if batch else replay(reviews, files)
    out, checkpoint = scratch(spark, "months"), scratch(spark, "stream")
    q = start(drained(spark, source, reviews.drop(batch).schema if batch else reviews.schema), out, checkpoint)
    q.awaitTermination()
    return project(spark.read.option("basePath", out).parquet(out)), progress(q)


def reconcile(stream: DataFrame, batch: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """Product months that differ: (parent_asin, month, kind, review_gap, explained).

    ``dropped`` holds the contributions of rows that the watermark is known to
    have dropped.  A difference is explained if the stream plus those rows is
    the batch in every figure; a month that only the batch has, if those rows
    are the whole month.  ``only_stream`` months of products that the batch
    doesn't have at all are ``unmaterialised``: it answers another question.
    """
    figures = lambda df, name: df.select("parent_asin", "month", F.struct(*ADDITIVE).alias(name))
    j = figures(stream, "s").join(figures(batch, "b"), ["parent_asin", "month"], "full_outer")
    j = j.join(figures(dropped, "x"), ["parent_asin", "month"], "full_outer") if dropped is not None else j.withColumn("x", F.lit(None).cast(f"struct<{','.join(f'{c}:double' for c in ADDITIVE)}>"))
    known = batch.select("parent_asin", F.lit(True).alias("known")).distinct()
    j = j.join(known, "parent_asin", "left")
    kind = (
        F.when(F.col("s").isNull() & F.col("b").isNull(), None)
        .when(F.col("b").isNull(), F.when(F.col("known"), "only_stream").otherwise("unmaterialised"))
        .when(F.col("s").isNull(), "only_batch")
        .when(F.col("s") != F.col("b"), "differs")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    sums = F.lit(True)
    for c in ADDITIVE:
        sums = sums & (zero(f"s.{c}") + zero(f"x.{c}") == zero(f"b.{c}"))
    explained = F.col("x").isNotNull() & F.col("b").isNotNull() & sums
    gap = zero("s.review_count") - zero("b.review_count")
    return j.select("parent_asin", "month", kind.alias("kind"), gap.alias("review_gap"), explained.alias("explained")).where("kind is not null")


def reread(spark: SparkSession, source: str, schema) -> DataFrame:
    """The files of a stream as one bounded batch, in full."""
    return spark.read.schema(schema).parquet(source)


def shaped(rows: DataFrame, ingested_at) -> DataFrame:
    """Records with one fixed arrival, so that a replay is judged alike whenever it runs."""
    return rows.withColumn("ingested_at", F.lit(ingested_at).cast("timestamp"))


def corrected(arrivals: DataFrame, days: int = late.CUTOFF_DAYS, versions: int = 3) -> DataFrame:
    """Monthly figures after feeding arrivals in ``versions`` batches, by time of arrival, to the differential state."""
    spark = arrivals.sparkSession
    d = late.feed(arrivals, scratch(spark, "late-state"), days, versions, "arrival").where("status = 'accepted'")
    g = d.groupBy("event_month").agg(F.sum("diff").cast("long").alias("reviews"), F.coalesce(F.sum(F.col("rating") * F.col("diff")), F.lit(0)).cast("long").alias("rating_sum"))
    return g.where("reviews <> 0 or rating_sum <> 0")
