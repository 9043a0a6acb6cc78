"""Late and out-of-order events, corrected by retraction (problem 4).

State is keyed by review: its last arrival before the cut-off, its last one at
or after it, and what follows from them, the month and rating that count or
``past_cutoff``.  Both arrivals merge by maximum, so batches may come in any
order.  A batch that changes what a review stands for emits a negative delta for
the old and a positive one for the new; sums of deltas are the figures as known
after each batch, and a review first seen past the cut-off is retracted from
``past_cutoff`` when an earlier arrival turns up later.

The state is a versioned table in buckets of reviews.  A batch replaces the
buckets that it touches in one commit, each row tells the version that changed
it and what it stood for before, and so every version carries its deltas.

Messages are first reduced to their earliest arrival, then to one row per
review and batch, both with map-side combining, so a review that holds a third
of all deliveries costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, scratch
from ..sources.versioned import VersionedTable

#: Days after the end of the month of an event until which it still counts.
CUTOFF_DAYS = 30
#: Parts of the state, and batches that a whole table is fed in.
BUCKETS, BATCHES = 8, 3


def cutoff(event_ts: Column, days: int = CUTOFF_DAYS) -> Column:
    """First instant of the month after ``event_ts``, plus ``days``."""
    return F.add_months(F.trunc(event_ts, "month"), 1).cast("timestamp_ntz") + F.expr(f"interval {days} days")


def arrivals(events: DataFrame, deliveries: DataFrame) -> DataFrame:
    """One row per message: review_id, event_ts, rating and its earliest arrival.

    Messages without review_id, event_ts or any arrival are left out: neither
    their period nor their lateness is defined.
    """
    first = (
        deliveries.where("ingested_at is not null")
        .groupBy("kafka_partition", "kafka_offset")
        .agg(F.min(F.col("ingested_at").cast("timestamp_ntz")).alias("arrival"))
    )
    messages = (
        events.where("review_id is not null and event_ts is not null")
        .groupBy("kafka_partition", "kafka_offset")
        .agg(F.max(F.struct("review_id", F.col("event_ts").cast("timestamp_ntz").alias("event_ts"), "rating")).alias("m"))
    )
    return messages.join(first, ["kafka_partition", "kafka_offset"]).select(
        "m.*", "arrival", "kafka_partition", "kafka_offset"
    )


def versions(arrived: DataFrame, days: int = CUTOFF_DAYS) -> DataFrame:
    """One row per review, arrival day and side of the cut-off; the last arrival of a day counts.

    ``past`` is true for arrivals at or after the cut-off.
    """
    return (
        arrived.withColumn("past", F.col("arrival") >= cutoff(F.col("event_ts"), days))
        .groupBy("review_id", F.to_date("arrival").alias("version"), "past")
        .agg(
            F.min("arrival").alias("first_arrival"),
            F.max(F.struct("arrival", "kafka_offset", "kafka_partition", "rating", "event_ts")).alias("last"),
        )
        .select("review_id", "version", "past", "first_arrival", F.col("last.rating").alias("rating"), F.col("last.event_ts").alias("event_ts"))
    )


def deltas(versioned: DataFrame) -> DataFrame:
    """Signed changes of the keyed state: (review_id, version, status, event_month, rating, diff).

    A version before the cut-off retracts the state it replaces.  One past it
    asserts ``past_cutoff`` once, and only while nothing was accepted.
    """
    w = Window.partitionBy("review_id").orderBy("version", "first_arrival")
    rows = versioned.select(
        "review_id",
        "version",
        F.when(F.col("past"), "past_cutoff").otherwise("accepted").alias("status"),
        F.trunc("event_ts", "month").alias("event_month"),
        F.col("rating").cast("long").alias("rating"),
        F.lag(F.struct("past", F.trunc("event_ts", "month").alias("event_month"), F.col("rating").cast("long").alias("rating"))).over(w).alias("old"),
        F.row_number().over(w).alias("rn"),
    )
    new = F.struct("status", "event_month", "rating", F.lit(1).alias("diff"))
    old = F.struct(F.when(F.col("old.past"), "past_cutoff").otherwise("accepted").alias("status"), F.col("old.event_month").alias("event_month"), F.col("old.rating").alias("rating"), F.lit(-1).alias("diff"))
    accepted = F.col("status") == "accepted"
    change = (
        F.when(accepted & F.col("old").isNull(), F.array(new))
        .when(accepted, F.array(old, new))
        .when(F.col("rn") == 1, F.array(new))
        .otherwise(F.array().cast("array<struct<status:string,event_month:date,rating:bigint,diff:int>>"))
    )
    return rows.select("review_id", "version", F.explode(change).alias("d")).select("review_id", "version", "d.*")


def _stands_for(accepted: Column, past: Column) -> Column:
    """What a review counts as, from its last arrivals on both sides of the cut-off."""
    month = lambda c: F.trunc(c["event_ts"], "month")
    what = lambda status, c: F.struct(F.lit(status).alias("status"), month(c).alias("event_month"), c["rating"].cast("long").alias("rating"))
    return F.when(accepted.isNotNull(), what("accepted", accepted)).otherwise(what("past_cutoff", past))


def advance(table: VersionedTable, batch: DataFrame, run_id: str, days: int = CUTOFF_DAYS) -> int:
    """Merge one batch of ``arrivals`` into the state; the new version is returned, and ``changes`` reads its deltas."""
    row = F.struct("arrival", "kafka_offset", "kafka_partition", F.col("rating").alias("rating"), "event_ts")
    past = F.col("arrival") >= cutoff(F.col("event_ts"), days)
    bucket = F.pmod(F.xxhash64("review_id"), F.lit(BUCKETS)).cast("int")
    fresh = batch.groupBy("review_id").agg(F.max(F.when(~past, row)).alias("accepted"), F.max(F.when(past, row)).alias("past"))
    version = (table.current() or 0) + 1
    if version == 1:
        now = _stands_for(F.col("accepted"), F.col("past"))
        state = fresh.select(bucket.alias("bucket"), "review_id", "accepted", "past", now.alias("now"), F.lit(None).cast(_NOW).alias("old"), F.lit(1).alias("changed"))
        return table.write(state, run_id, "bucket")
    touched = [str(r[0]) for r in batch.select(bucket).distinct().collect()]
    before = table.read(only=touched).select("review_id", F.struct("accepted", "past", "now", "old", "changed").alias("b"))
    j = fresh.join(before, "review_id", "full_outer").select(
        "review_id", "b", F.greatest("accepted", "b.accepted").alias("accepted"), F.greatest("past", "b.past").alias("past")
    )
    j = j.withColumn("now", _stands_for(F.col("accepted"), F.col("past")))
    same = F.col("now").eqNullSafe(F.col("b.now"))
    state = j.select(
        bucket.alias("bucket"), "review_id", "accepted", "past", "now",
        F.when(same, F.col("b.old")).otherwise(F.col("b.now")).alias("old"), F.when(same, F.col("b.changed")).otherwise(F.lit(version)).alias("changed"),
    )
    return table.revise(run_id, swap=state)


_NOW = "struct<status:string,event_month:date,rating:bigint>"


def changes(table: VersionedTable, version: int) -> DataFrame:
    """Signed deltas of one version: (version, review_id, status, event_month, rating, diff)."""
    rows = table.read(version).where(F.col("changed") == version)
    d = F.struct(F.col("now.status"), F.col("now.event_month"), F.col("now.rating"), F.lit(1).alias("diff")), F.struct(F.col("old.status"), F.col("old.event_month"), F.col("old.rating"), F.lit(-1).alias("diff"))
    signed = F.when(F.col("old").isNull(), F.array(d[0])).otherwise(F.array(*d))
    return rows.select(F.lit(version).alias("version"), "review_id", F.explode(signed).alias("d")).select("version", "review_id", "d.*")


def feed(arrived: DataFrame, root: str, days: int = CUTOFF_DAYS, batches: int = BATCHES, order: str = "kafka_offset") -> DataFrame:
    """All deltas after feeding ``arrivals`` to the state under ``root`` in ``batches`` by ``order``.

    By the log's own order (``kafka_offset``) arrivals come out of order, so
    later batches correct earlier ones.
    """
    spark = arrived.sparkSession
    # arrivals are joined once and read by batch
    where = scratch(spark, "arrived")
    arrived.write.option("compression", "zstd").parquet(where)
    rows = spark.read.parquet(where)
    at = F.unix_micros(F.col(order).cast("timestamp")) if dict(rows.dtypes)[order].startswith("timestamp") else F.col(order)
    cuts = rows.agg(F.percentile_approx(at, [i / batches for i in range(1, batches)])).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    table = VersionedTable(spark, root)
    first = (table.current() or 0) + 1
    number = sum(((at > F.lit(c)).cast("int") for c in cuts), F.lit(0))
    for k in range(len(cuts) + 1):
        advance(table, rows.where(number == k), f"batch-{first + k}", days)
    discard(where)
    every = changes(table, first)
    for v in range(first + 1, first + len(cuts) + 1):
        every = every.unionByName(changes(table, v))
    return every


def past_cutoff(events: DataFrame, received: DataFrame, days: int = CUTOFF_DAYS, batches: int = BATCHES) -> DataFrame:
    """Reviews whose earliest arrival lies at or past the cut-off: what the deltas of that status leave."""
    d = feed(arrivals(events, received), scratch(events.sparkSession, "late"), days, batches).where("status = 'past_cutoff'")
    return d.groupBy("review_id").agg(F.sum("diff").alias("n")).where("n > 0").select("review_id")


def monthly_versions(events: DataFrame, received: DataFrame, days: int = CUTOFF_DAYS) -> DataFrame:
    """Per event month and version: net change, corrections (retractions) and the figures as known then."""
    d = deltas(versions(arrivals(events, received), days)).where("status = 'accepted'")
    net = d.groupBy("event_month", "version").agg(
        F.sum("diff").cast("long").alias("reviews_delta"),
        F.coalesce(F.sum(F.col("rating") * F.col("diff")), F.lit(0)).cast("long").alias("rating_delta"),
        F.sum((F.col("diff") < 0).cast("int")).cast("long").alias("retractions"),
    )
    w = Window.partitionBy("event_month").orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    return net.select(
        "*", F.sum("reviews_delta").over(w).alias("reviews"), F.sum("rating_delta").over(w).alias("rating_sum")
    )
