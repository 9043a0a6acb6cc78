"""Messages delivered more than once (problem 7).

Identifiers are dictionary-encoded exactly: a hash names the shard, the rank
within the shard the position, so a code is dense and no two identifiers share
one.  What has been seen is kept as bitmaps of 32,768 bits per (shard, bucket),
stored compressed; Spark's own bitmap aggregates build and unite them.  Batches
are taken in order of arrival.  A batch keeps one arrival for each bit that
isn't set yet, and its new bits are united with the old ones in one atomic
commit.  Membership is decided by the bits alone: the dictionary covers all
identifiers of a run before its first batch is taken.

State is a versioned table whose parts are slices of the dictionary, to which a
run only adds, and slices of the bitmaps, of which a batch replaces those that
it touches.  Shards follow the number of identifiers (``PER_SHARD``), so ranks
are computed over bounded parts at any size.

Deliveries are folded to the earliest per message and batch, then per
identifier and batch, with map-side combining; which deliveries to drop is an
anti-join on the unique delivery_id.  So no step gathers the copies of one
message in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import discard, scratch
from ..sources.versioned import VersionedTable

#: Shards at least, and new identifiers of a shard about which their number doubles.
SHARDS, PER_SHARD = 64, 1 << 18
#: Parts of the dictionary and of the bitmaps.
SLICES = 8
#: Bits of one bitmap, fixed by Spark's bitmap functions.
BITS = 32768
#: Batches, by order of arrival, that the deliveries of a run are fed in.
BATCHES = 3

_STATE = "part string, shard int, at bigint, identifier string, bits binary"


@dataclass
class Seen:
    """State between batches: dictionary (identifier, shard, pos) and bitmaps (shard, bucket, bits)."""

    dictionary: DataFrame
    bitmaps: DataFrame

    @staticmethod
    def load(table: VersionedTable, words: list[int] | None = None, bits: list[int] | None = None) -> Seen | None:
        """The newest state, or null before the first commit; ``words`` and ``bits`` name the slices to read."""
        version = table.current()
        if version is None:
            return None
        part = lambda kind, some: table.read(version, [f"{kind}{k}" for k in (range(SLICES) if some is None else some)])
        return Seen(
            part("d", words).select("identifier", "shard", F.col("at").alias("pos")),
            part("b", bits).select("shard", F.col("at").alias("bucket"), "bits"),
        )


def _words(codes: DataFrame) -> DataFrame:
    """Dictionary rows of codes (identifier, shard, pos) as state."""
    part = F.concat(F.lit("d"), _slice(F.col("identifier")).cast("string"))
    return codes.select(part.alias("part"), "shard", F.col("pos").alias("at"), "identifier", F.lit(None).cast("binary").alias("bits"))


def _bits(bitmaps: DataFrame) -> DataFrame:
    """Bitmap rows as state."""
    part = F.concat(F.lit("b"), F.pmod(F.col("shard"), F.lit(SLICES)).cast("string"))
    return bitmaps.select(part.alias("part"), "shard", F.col("bucket").alias("at"), F.lit(None).cast("string").alias("identifier"), "bits")


def shard_of(identifier: Column, shards: int = SHARDS) -> Column:
    return F.pmod(F.xxhash64(identifier), F.lit(shards)).cast("int")


def _slice(identifier: Column) -> Column:
    return F.pmod(F.xxhash64(identifier, F.lit(1)), F.lit(SLICES)).cast("int")


def encode(rows: DataFrame, dictionary: DataFrame | None = None, shards: int = SHARDS) -> DataFrame:
    """``rows`` with exact codes: columns ``shard``, ``pos``, and ``fresh`` on one row of each new identifier.

    ``rows`` has few rows per identifier.  New identifiers rank by value behind
    the highest position of their shard, so a repeated run gives the same
    codes; known ones keep theirs, whatever the number of shards was.
    """
    home = rows.withColumn("_home", shard_of(F.col("identifier"), shards))
    if dictionary is None:
        home = home.withColumn("_pos", F.lit(None).cast("bigint")).withColumn("_shard", F.lit(None).cast("int")).withColumn("_top", F.lit(-1).cast("bigint"))
    else:
        top = dictionary.groupBy(F.col("shard").alias("_home")).agg(F.max("pos").alias("_top"))
        known = dictionary.select("identifier", F.col("shard").alias("_shard"), F.col("pos").alias("_pos"))
        home = home.join(known, "identifier", "left").join(top, "_home", "left")
    new = F.col("_pos").isNull()
    w = Window.partitionBy("_home", new).orderBy("identifier")
    ranked = home.withColumn("_rank", F.dense_rank().over(w)).withColumn("_first", ~F.lag("identifier").over(w).eqNullSafe(F.col("identifier")))
    return ranked.select(
        *rows.columns,
        F.coalesce("_shard", "_home").alias("shard"),
        F.coalesce("_pos", F.col("_rank") + F.coalesce("_top", F.lit(-1))).cast("bigint").alias("pos"),
        (new & F.col("_first")).alias("fresh"),
    )


def _bit_set(bits: Column, pos: Column) -> Column:
    """Whether bit ``pos`` of a bitmap is set; false for no bitmap."""
    at = F.pmod(pos, F.lit(BITS)).cast("int")
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3) + F.lit(1), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8))) == 1, F.lit(False))


def unseen(coded: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """One arrival per bit not yet set in the bitmaps ``seen``: (shard, pos, delivery_id), the earliest, then the lowest id.

    ``coded`` is (shard, pos, ingested_at, delivery_id) with any repetition.
    """
    first = coded.groupBy("shard", "pos").agg(F.min(F.struct("ingested_at", "delivery_id")).alias("first")).select("shard", "pos", F.col("first.delivery_id").alias("delivery_id"))
    if seen is None:
        return first
    known = first.withColumn("bucket", F.floor(F.col("pos") / F.lit(BITS))).join(seen, ["shard", "bucket"], "left")
    return known.where(~_bit_set(F.col("bits"), F.col("pos"))).select("shard", "pos", "delivery_id")


def bitmaps(coded: DataFrame) -> DataFrame:
    """Bitmaps (shard, bucket, bits) of codes (shard, pos)."""
    return coded.groupBy("shard", F.floor(F.col("pos") / F.lit(BITS)).alias("bucket")).agg(
        F.bitmap_construct_agg(F.pmod(F.col("pos"), F.lit(BITS))).alias("bits")
    )


def union_bits(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("shard", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def _advance(table: VersionedTable, coded: DataFrame, words: DataFrame | None, run_id: str, size: int = 0) -> str:
    """Choose arrivals against the bits, then commit new bits (and ``words``, new dictionary rows) at once; the path of the choice.

    The choice is written to the shared folder before the commit, so a failure
    before that leaves the state as it was, and the result doesn't depend on
    the state afterwards.
    """
    spark = coded.sparkSession
    old = Seen.load(table)
    kept = scratch(spark, "kept")
    unseen(coded, old.bitmaps if old else None).write.parquet(kept)
    new = bitmaps(spark.read.parquet(kept))
    if old is None:
        table.write(_words(words).unionByName(_bits(new)) if words is not None else _bits(new), run_id, "part")
        return kept
    # slices that the batch touches are replaced whole, the others are shared with the version before
    # (a batch of ``size`` rows that many touches all of them)
    touched = list(range(SLICES)) if size > 100 * SLICES else [r[0] for r in new.select(F.pmod(F.col("shard"), F.lit(SLICES))).distinct().collect()]
    part = Seen.load(table, bits=touched).bitmaps
    table.revise(run_id, add=_words(words) if words is not None else None, swap=_bits(union_bits(part, new)))
    return kept


def take(batch: DataFrame, root: str, run_id: str, shards: int = SHARDS) -> DataFrame:
    """Feed one batch to the state under ``root``: (shard, pos, delivery_id) of the arrivals that stay.

    ``batch`` is (identifier, delivery_id, ingested_at) with any repetition.
    """
    spark = batch.sparkSession
    table = VersionedTable(spark, root)
    slices = [r[0] for r in batch.select(_slice(F.col("identifier"))).distinct().collect()]
    seen = Seen.load(table, words=slices)
    where = scratch(spark, "coded")
    first = batch.groupBy("identifier").agg(F.min(F.struct("ingested_at", "delivery_id")).alias("m")).select("identifier", "m.*")
    encode(first, _dictionary(seen, table), shards).write.option("compression", "zstd").parquet(where)
    coded = spark.read.parquet(where)
    kept = _advance(table, coded, coded.where("fresh").select("identifier", "shard", "pos"), run_id)
    discard(where)
    return spark.read.parquet(kept)


def _dictionary(seen: Seen | None, table: VersionedTable) -> DataFrame | None:
    """Known identifiers of the touched slices, with the highest position of every shard besides."""
    if seen is None:
        return None
    tops = Seen.load(table, bits=[]).dictionary.groupBy("shard").agg(F.max("pos").alias("pos")).select(F.lit(None).cast("string").alias("identifier"), "shard", "pos")
    return seen.dictionary.unionByName(tops)


def named(deliveries: DataFrame, reviews: DataFrame, batch: Column | None = None) -> DataFrame:
    """The earliest delivery of each message (in each batch) with its identifier: (batch, identifier, ingested_at, delivery_id).

    Deliveries are of one message if partition and offset agree, and messages
    are one if ``reviews`` gives them the same review_id (the lowest, should it
    give several).  A message without review_id, or without partition or
    offset, is identified by its position; rows that lack a position have only
    themselves.  A null ingested_at sorts last.
    """
    at = F.coalesce(F.col("ingested_at").cast("timestamp_ntz"), F.lit("9999-12-31").cast("timestamp_ntz"))
    rows = deliveries.select("kafka_partition", "kafka_offset", "delivery_id", at.alias("ingested_at"), (F.lit(0) if batch is None else batch).alias("batch"))
    placed = F.col("kafka_partition").isNotNull() & F.col("kafka_offset").isNotNull()
    messages = rows.where(placed).groupBy("kafka_partition", "kafka_offset", "batch").agg(F.min(F.struct("ingested_at", "delivery_id")).alias("first"))
    ids = reviews.where(F.col("review_id").isNotNull() & placed).groupBy("kafka_partition", "kafka_offset").agg(F.min("review_id").alias("review_id"))
    place = F.concat_ws(":", F.lit("@"), F.col("kafka_partition").cast("string"), F.col("kafka_offset").cast("string"))
    loose = rows.where(~placed).select("batch", F.concat(F.lit("#"), F.col("delivery_id").cast("string")).alias("identifier"), "ingested_at", "delivery_id")
    return (
        messages.join(ids, ["kafka_partition", "kafka_offset"], "left")
        .select("batch", F.coalesce("review_id", place).alias("identifier"), "first.*")
        .unionByName(loose)
    )


def feed(deliveries: DataFrame, reviews: DataFrame, root: str, run_id: str = "batch", batches: int = BATCHES) -> list[str]:
    """Feed deliveries to the state under ``root`` in ``batches`` by order of arrival: paths of the arrivals that stay.

    Identifiers are encoded once for the run; from the second batch on the bits
    of those before decide.  Bounds of batches are quantiles of the arrival, so
    their sizes are alike.
    """
    spark = deliveries.sparkSession
    table = VersionedTable(spark, root)
    us = F.unix_micros(F.col("ingested_at").cast("timestamp"))
    size, cuts = deliveries.agg(F.count(F.lit(1)), F.percentile_approx(us, [i / batches for i in range(1, batches)] or [0.0])).first()
    cuts = sorted(set(cuts or [])) if batches > 1 else []
    late = F.coalesce(us, F.lit(2**62))
    number = sum(((late > F.lit(c)).cast("int") for c in cuts), F.lit(0))
    rows = named(deliveries, reviews, number).groupBy("identifier", "batch").agg(F.min(F.struct("ingested_at", "delivery_id")).alias("m")).select("identifier", "batch", "m.*")
    shards = SHARDS
    while shards * PER_SHARD < size:
        shards *= 2
    seen = Seen.load(table)
    where = scratch(spark, "coded")
    encode(rows, seen.dictionary if seen else None, shards).write.option("compression", "zstd").partitionBy("batch").parquet(where)
    coded = spark.read.parquet(where) if size else encode(rows, None, shards)
    words = coded.where("fresh").select("identifier", "shard", "pos")
    kept = []
    for k in range(len(cuts) + 1):
        kept.append(_advance(table, coded.where(F.col("batch") == k), words if k == 0 else None, f"{run_id}-{k}", size // (len(cuts) + 1)))
    discard(where)
    return kept


def to_drop(deliveries: DataFrame, reviews: DataFrame, root: str | None = None, run_id: str = "batch", batches: int = BATCHES) -> DataFrame:
    """Deliveries that repeat a message: all but the one that stays (none stays of a message seen before).

    ``root`` holds the state between runs; without it the state is new and is
    deleted after the last batch.
    """
    spark = deliveries.sparkSession
    state = root or scratch(spark, "seen")
    kept = spark.read.schema("delivery_id bigint").parquet(*feed(deliveries, reviews, state, run_id, batches))
    if root is None:
        discard(state)
    return deliveries.select("delivery_id").join(kept, "delivery_id", "left_anti")


def seen_census(deliveries: DataFrame, reviews: DataFrame) -> DataFrame:
    """Set bits per shard after all batches: (shard, messages)."""
    spark = deliveries.sparkSession
    root = scratch(spark, "seen")
    discard(*feed(deliveries, reviews, root))
    return Seen.load(VersionedTable(spark, root)).bitmaps.groupBy("shard").agg(F.sum(F.bitmap_count("bits")).alias("messages"))
