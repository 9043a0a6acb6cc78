"""JSON lines with a fixed schema: typed rows, rejects with reasons, and a sorted copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(payload, file): the lines of all files under ``path``; empty lines are rows too."""
    return spark.read.text(path).select(F.col("value").alias("payload"), F.col("_metadata.file_name").alias("file"))


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejects with reason, located fault and payload digest) of JSON lines.

    The arrival of a line isn't known, so timestamps have no upper bound.
    """
    raw = lines(spark, path)
    parsed = records.parse(raw.withColumn("line_sha256", F.sha2("payload", 256)), typed=True)
    good = parsed.where("reason is null").withColumn("event_ts", F.timestamp_millis("ts_ms").cast("timestamp_ntz"))
    return good.drop("reason", "fault", "recovered"), parsed.where("reason is not null").select("file", "line_sha256", "reason", "fault", "recovered")


def write_sorted(spark: SparkSession, path: str, target: str, rejects: str) -> None:
    """Lines in event order (time, user and product, digest) as text, those that fail beside them.

    The order doesn't depend on the order of the input; the sort is by range,
    so files follow each other.
    """
    raw = lines(spark, path).withColumn("line_sha256", F.sha2("payload", 256)).withColumn("line", F.col("payload"))
    parsed = records.parse(raw, typed=True)
    good = parsed.where("reason is null").orderBy("ts_ms", "user_id", "parent_asin", "line_sha256")
    good.select(F.col("line").alias("value")).write.text(target)
    parsed.where("reason is not null").select("line_sha256", "reason", "fault").write.json(rejects)
