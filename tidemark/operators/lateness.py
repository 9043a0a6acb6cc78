"""Holding rows of a sorted stream back so that a watermark drops exactly the ones meant to be dropped.

A plan draws a far slice, released so late that it must be dropped, and a near
slice that must be accepted.  Rows whose fate could depend on where a batch
ends aren't drawn; whatever isn't drawn has a reason.  The send order is run
through the model of the watermark, and a plan that doesn't land as meant is an
error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import numbered, simulate_watermark

DAY_MS = 86_400_000


class PlanError(RuntimeError):
    """The slices can't be injected with a predictable outcome."""


@dataclass(frozen=True)
class Injection:
    """Sizes and lags of both slices, the delay of the watermark, rows of a batch, and the seed of the draws."""

    far_rows: int
    near_rows: int
    batch: int
    far_days: int = 730
    near_days: int = 7
    delay_days: int = 30
    seed: int = 42

    def __post_init__(self) -> None:
        if not self.near_days < self.delay_days < self.far_days:
            raise ValueError("the delay must lie between the near and the far lag")
        if min(self.far_rows, self.near_rows, self.batch) < 1:
            raise ValueError("slices and batches need rows")

    @property
    def slack(self) -> int:
        """How far a row that stays can move because others are moved."""
        return self.far_rows + self.near_rows


def release_points(positions: DataFrame, lag_ms: int) -> DataFrame:
    """(pos, q): the first position whose time is at or after that of ``pos`` plus the lag; their number where there is none.

    Rows and targets are placed in one range sort; how many rows lie ahead of a
    target is its place less the targets ahead of it, which are as many as its position.
    """
    rows = positions.select(F.col("ts_ms").alias("t"), F.lit(1).alias("kind"), "pos")
    targets = positions.select((F.col("ts_ms") + F.lit(lag_ms)).alias("t"), F.lit(0).alias("kind"), "pos")
    return numbered(rows.unionByName(targets), "t", "kind", "pos", column="ahead").where("kind = 0").select("pos", (F.col("ahead") - F.col("pos")).alias("q"))


def pools(positions: DataFrame, spec: Injection) -> DataFrame:
    """(pos, id, ts_ms, far_q, near_q, far_reason, near_reason): why each row isn't eligible; null where it is.

    ``positions`` is (pos, id, ts_ms), dense and in order of time.
    """
    n = positions.agg(F.count(F.lit(1))).scalar()
    shared = positions.groupBy("id").agg((F.count(F.lit(1)) > 1).alias("shared"))
    far = release_points(positions, spec.far_days * DAY_MS).withColumnRenamed("q", "far_q")
    near = release_points(positions, spec.near_days * DAY_MS).withColumnRenamed("q", "near_q")
    x = positions.join(shared, "id").join(far, "pos").join(near, "pos")
    # a row that late is dropped for certain if one two batches and all shifts ahead lies past its time plus the delay
    x = x.withColumn("guard", F.col("far_q") - 2 * spec.batch - 2 * spec.slack)
    x = x.join(positions.select(F.col("pos").alias("guard"), F.col("ts_ms").alias("guard_ms")), "guard", "left")
    past_end = lambda c: F.col(c) >= n
    sure = F.coalesce(F.col("guard_ms") - spec.delay_days * DAY_MS > F.col("ts_ms"), F.lit(False))
    far_reason = F.when(F.col("shared"), "key_collision").when(past_end("far_q"), "release_past_end").when(~sure, "watermark_undecidable")
    near_reason = F.when(F.col("shared"), "key_collision").when(past_end("near_q"), "release_past_end")
    return x.select("pos", "id", "ts_ms", "far_q", "near_q", far_reason.alias("far_reason"), near_reason.alias("near_reason"))


def census(pooled: DataFrame) -> DataFrame:
    """(slice, reason, rows): eligible rows have a null reason."""
    x = pooled.select(F.explode(F.array(F.struct(F.lit("far").alias("slice"), F.col("far_reason").alias("reason")), F.struct(F.lit("near").alias("slice"), F.col("near_reason").alias("reason")))).alias("x"))
    return x.groupBy("x.slice", "x.reason").agg(F.count(F.lit(1)).alias("rows"))


def drawn(pooled: DataFrame, spec: Injection) -> DataFrame:
    """(slice, id, pos, ts_ms, release_ms, release_before) of the rows held back; too few eligible rows are an error."""

    def smallest(name: str, eligible: DataFrame, rows: int, days: int) -> DataFrame:
        rank = F.sha2(F.concat_ws("\u001f", F.lit(str(spec.seed)), F.lit(name), "id"), 256)
        some = eligible.orderBy(rank, "id").limit(rows).checkpoint()
        if (got := some.count()) < rows:
            told = {f"{r.slice}:{r.reason}": r["rows"] for r in census(pooled).collect()}
            raise PlanError(f"{got} rows are eligible for the {name} slice of {rows}: {told}")
        return some.select(F.lit(name).alias("slice"), "id", "pos", "ts_ms", (F.col("ts_ms") + days * DAY_MS).alias("release_ms"), F.col(f"{name}_q").alias("release_before"))

    far = smallest("far", pooled.where("far_reason is null"), spec.far_rows, spec.far_days)
    near = smallest("near", pooled.where("near_reason is null").join(far.select("pos"), "pos", "left_anti"), spec.near_rows, spec.near_days)
    return far.unionByName(near)


def send_order(positions: DataFrame, held: DataFrame) -> DataFrame:
    """(slot, id, ts_ms, slice): every row once; a held one goes right before the row that it is released ahead of."""
    h = held.select("pos", "slice", "release_before", "release_ms")
    x = positions.join(h, "pos", "left").withColumn("place", F.coalesce("release_before", "pos"))
    # several of one place go by release, slice and id
    x = x.withColumn("turn", F.when(F.col("slice").isNotNull(), 0).otherwise(1))
    return numbered(x, "place", "turn", "release_ms", "slice", "id", "pos", column="slot").select("slot", "id", "ts_ms", "slice")


def plan(positions: DataFrame, spec: Injection) -> tuple[DataFrame, DataFrame]:
    """(held rows, send order), once the model of the watermark drops the far slice whole and nothing else."""
    pooled = pools(positions, spec).checkpoint()
    held = drawn(pooled, spec)
    order = send_order(positions, held)
    lost = simulate_watermark(order.select(F.col("slot").alias("pos"), "ts_ms"), spec.batch, spec.delay_days * DAY_MS)
    fate = lost.select(F.col("pos").alias("slot")).join(order, "slot").groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    got = {r.slice: r.n for r in fate.collect()}
    if got != {"far": spec.far_rows}:
        raise PlanError(f"the watermark drops {got}, not the far slice of {spec.far_rows} alone")
    return held, order
