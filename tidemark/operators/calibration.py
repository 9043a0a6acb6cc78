"""Calibrating the decline rule: grids, permuted blocks, injected declines, selection."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import replace
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import draw_key
from ..session import ship
from . import decline


def grid(base: decline.Rule, **values: list) -> dict[str, decline.Rule]:
    """Every combination of field values as a named rule."""
    names = list(values)
    return {",".join(f"{n}={v}" for n, v in zip(names, combo)): replace(base, **dict(zip(names, combo))) for combo in product(*values.values())}


def _windows_of(n: np.ndarray, rating: np.ndarray, size: np.ndarray, rule: decline.Rule) -> tuple[np.ndarray, ...]:
    """Reviews, active months and means of both windows at every point of every series, and which points exist."""
    sums = [np.concatenate([np.zeros((1, n.shape[1]), x.dtype), np.cumsum(x, axis=0)]) for x in (n, (n > 0).astype(np.int64), rating)]
    count = max(0, n.shape[0] - rule.baseline - rule.recent + 1)
    cut = lambda c, lo, hi: c[hi : hi + count] - c[lo : lo + count]
    end = rule.baseline + rule.recent
    (bn, ba, bs), (rn, ra, rs) = ([cut(c, lo, hi) for c in sums] for lo, hi in ((0, rule.baseline), (rule.baseline, end)))
    mean = lambda s, c: np.divide(s, c, out=np.zeros_like(s), where=c > 0)
    there = np.arange(count)[:, None] <= (size - end)[None, :]
    return bn, ba, mean(bs, bn), rn, ra, mean(rs, rn), there


def _opens(ok: np.ndarray, cond: np.ndarray, rule: decline.Rule, persistence: np.ndarray | None = None) -> np.ndarray:
    """Where episodes open: ``decline.episodes`` as a walk over the points, all series at once; ``persistence`` may differ by series."""
    persistence = rule.persistence if persistence is None else persistence
    run, falses, gaps = (np.zeros(ok.shape[1], np.int32) for _ in range(3))
    active = np.zeros(ok.shape[1], bool)
    out = np.zeros(ok.shape, bool)
    for at, (e, c) in enumerate(zip(ok, ok & cond)):
        gaps += ~e
        falses += e & ~c
        gaps[e] = 0
        falses[c] = 0
        gaps[e & ~c & (falses >= rule.recovery)] = rule.max_gap + 1
        shut = active & (gaps > rule.max_gap)
        run = np.where(c, run + 1, 0)
        opens = ~active & (run >= persistence)
        active = (active & ~shut) | opens
        out[at] = opens
        idle = ~active | opens
        run[shut] = 0
        falses[idle] = gaps[idle] = 0
    return out


def _permutation(product: str, n: int, block: int, replicate: int, seed: int) -> np.ndarray:
    """Places from which the months of ``permuted_blocks`` come."""
    key = lambda salt, what: int(hashlib.sha256(f"{seed}\x1f{salt}\x1f{what}".encode()).hexdigest()[:16], 16) / 2**64
    shift = int(key(f"shift{replicate}", product) * n)
    blocks = sorted(range(-(-n // block)), key=lambda b: (key(f"block{replicate}", f"{product}:{b}"), b))
    placed = np.concatenate([np.arange(b * block, min(n, (b + 1) * block)) for b in blocks])
    return (placed - shift) % n


def _scan(spine: DataFrame, rules: dict[str, decline.Rule], replicates: int, block: int, seed: int) -> DataFrame:
    """(config, points, evaluable, alerts, products) of every rule over every spine, or over ``replicates`` permutations of each.

    One row per product holds its months; every rule is scored on the same
    series.  Products with too few reviews for the most lenient rule have no
    evaluable point and count with their points only.
    """
    ship(spine.sparkSession)
    few = min(2 * r.min_reviews for r in rules.values())
    series = spine.groupBy("parent_asin").agg(F.sort_array(F.collect_list(F.struct("ix", F.col("review_count").cast("bigint").alias("n"), F.col("rating_sum").cast("double").alias("s")))).alias("m"))
    series = series.select("parent_asin", F.col("m.n").alias("n"), F.col("m.s").alias("s"))

    def chunk(some: list[tuple[str, np.ndarray, np.ndarray]], out: dict[str, np.ndarray]) -> None:
        size = np.array([len(n) for _, n, _ in some for _ in range(max(1, replicates))])
        n, rating = np.zeros((size.max(), len(size)), np.int64), np.zeros((size.max(), len(size)))
        at = 0
        for product, one, stars in some:
            for r in range(1, replicates + 1) if replicates else [0]:
                order = _permutation(product, len(one), block, r, seed) if r else slice(None)
                n[: len(one), at], rating[: len(one), at] = one[order], stars[order]
                at += 1
        by: dict[tuple[int, int], list[str]] = {}
        for name, rule in rules.items():
            by.setdefault((rule.baseline, rule.recent), []).append(name)
        for names in by.values():
            bn, ba, bm, rn, ra, rm, there = _windows_of(n, rating, size, rules[names[0]])
            for name in names:
                rule = rules[name]
                ok = there & (bn >= rule.min_reviews) & (rn >= rule.min_reviews) & (ba >= rule.min_active) & (ra >= rule.min_active)
                hot = np.flatnonzero((ok & (rm <= bm - rule.delta)).sum(axis=0) >= rule.persistence)
                alerts = _opens(ok[:, hot], rm[:, hot] <= bm[:, hot] - rule.delta, rule).sum(axis=0)
                out[name] += [0, ok.sum(), alerts.sum(), len(set((hot[alerts > 0] // max(1, replicates)).tolist()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = {k: np.zeros(4, np.int64) for k in rules}
        waiting: list[tuple[str, np.ndarray, np.ndarray]] = []
        for b in batches:
            for product, n, s in zip(*(c.to_pylist() for c in b.columns)):
                for k, r in rules.items():
                    out[k][0] += max(1, replicates) * max(0, len(n) - r.baseline - r.recent + 1)
                if sum(n) >= few:
                    waiting.append((product, np.array(n, np.int64), np.array(s, np.float64)))
                if len(waiting) * max(1, replicates) >= 512:
                    chunk(waiting, out)
                    waiting = []
        if waiting:
            chunk(waiting, out)
        yield pa.RecordBatch.from_arrays([pa.array(list(rules)), *(pa.array([int(v[i]) for v in out.values()], pa.int64()) for i in range(4))], ["config", *_COUNTS])

    found = series.mapInArrow(run, "config string, " + ", ".join(f"{c} bigint" for c in _COUNTS))
    return found.groupBy("config").agg(*(F.sum(c).alias(c) for c in _COUNTS))


_COUNTS = ("points", "evaluable", "alerts", "products")


def grid_alerts(spine: DataFrame, rules: dict[str, decline.Rule]) -> DataFrame:
    """(config, points, evaluable, alerts, products) of every rule over one spine."""
    return _scan(spine, rules, 0, 1, 0)


def permuted_blocks(spine: DataFrame, block: int, replicate: int, seed: int) -> DataFrame:
    """The spine with blocks of months in a drawn order within each product: a placebo without trends.

    Blocks start at a drawn offset and wrap around; months keep their places in
    the calendar and take the figures of the month that moves there.
    """
    w = Window.partitionBy("parent_asin")
    size = F.count(F.lit(1)).over(w)
    i = F.row_number().over(w.orderBy("ix")) - 1
    shift = F.floor(draw_key(F.col("parent_asin"), seed, f"shift{replicate}") * size)
    x = spine.withColumn("_i", i).withColumn("_n", size).withColumn("_c", F.pmod(F.col("_i") + shift, F.col("_n")))
    x = x.withColumn("_b", F.floor(F.col("_c") / F.lit(block)))
    x = x.withColumn("_k", draw_key(F.concat_ws(":", "parent_asin", F.col("_b").cast("string")), seed, f"block{replicate}"))
    to = F.row_number().over(w.orderBy("_k", "_b", "_c")) - 1
    moved = x.withColumn("_to", to)
    places = moved.select("parent_asin", F.col("_i").alias("_to"), "ix")
    rest = [c for c in spine.columns if c not in ("parent_asin", "ix", "month")]
    return moved.select("parent_asin", "_to", *rest).join(places, ["parent_asin", "_to"]).drop("_to")


def placebo(spine: DataFrame, rules: dict[str, decline.Rule], block: int, replicates: int, seed: int) -> DataFrame:
    """(config, replicates, alerts, evaluable): alerts on the spines of ``permuted_blocks`` 1 to ``replicates``."""
    return _scan(spine, rules, replicates, block, seed).select("config", F.lit(replicates).cast("bigint").alias("replicates"), "alerts", "evaluable")


def injected(months: DataFrame, start: DataFrame, share: float, stars: float) -> DataFrame:
    """Months with a share of their reviews lowered to ``stars`` from a start month on.

    Whole reviews are relabelled: the running share is rounded down and each
    month takes the difference, so the fraction left over carries to the next.
    ``months`` is (parent_asin, ix, review_count, rating_sum), ``start`` (parent_asin, at).
    """
    x = months.join(start, "parent_asin", "left")
    w = Window.partitionBy("parent_asin").orderBy("ix")
    due = F.when(F.col("ix") >= F.col("at"), F.col("review_count") * F.lit(share)).otherwise(0.0)
    run = F.floor(F.round(F.sum(due).over(w), 9))
    x = x.withColumn("_run", run).withColumn("lowered", (F.col("_run") - F.coalesce(F.lag("_run").over(w), F.lit(0))).cast("long"))
    mean = F.try_divide(F.col("rating_sum"), F.col("review_count"))
    drop = F.col("lowered") * F.greatest(F.coalesce(mean, F.lit(0.0)) - F.lit(stars), F.lit(0.0))
    return x.select("parent_asin", "ix", "review_count", "rating_sum", "lowered", (F.col("rating_sum") - drop).alias("injected_sum"))


def surveillance_months(points: DataFrame) -> DataFrame:
    """One row: calendar months with an evaluable point, and product years they make up."""
    e = points.where("evaluable")
    return e.agg(F.count_distinct("point_month").alias("months"), F.round(F.count(F.lit(1)) / 12, 9).alias("product_years"))


# What a relabelled 5-star review becomes, in turn, by mechanism.
MECHANISMS = {"severe": (1, 2), "moderate": (3,)}


def before_holdout(months: DataFrame, holdout_ix: int, min_reviews: int, min_months: int) -> DataFrame:
    """Months before the holdout of products that have enough reviews and a long enough span to carry a point."""
    early = months.where(F.col("ix") < holdout_ix)
    fit = early.groupBy("parent_asin").agg(F.sum("review_count").alias("n"), (F.max("ix") - F.min("ix") + 1).alias("span")).where((F.col("n") >= min_reviews) & (F.col("span") >= min_months))
    return early.join(fit.select("parent_asin"), "parent_asin", "left_semi")


def inject(n: np.ndarray, fives: np.ndarray, step: int, drop: float, mechanism: str, ramp: int) -> np.ndarray:
    """What relabelling takes from the rating sum of each month, so that means fall by ``drop`` from ``step`` on.

    Only 5-star reviews are relabelled.  Each month's share is whole: the
    fraction left over, and what a month lacks in 5-star reviews, goes to the
    next.  With a ramp the effect grows over that many months to its full size.
    """
    targets = MECHANISMS[mechanism]
    each = 5.0 - sum(targets) / len(targets)
    lost, carry, taken = np.zeros(len(n)), 0.0, 0
    for m in range(step, len(n)):
        if not n[m]:
            continue
        want = drop * min(1.0, (m - step + 1) / ramp) * n[m] / each + carry
        take = min(max(0, int(want)), int(fives[m]))
        carry = want - take
        lost[m] = sum(5 - targets[(taken + k) % len(targets)] for k in range(take))
        taken += take
    return lost


def _detected(ok: np.ndarray, cond: np.ndarray, rule: decline.Rule, step: np.ndarray, within: int, persistence: np.ndarray) -> np.ndarray:
    """Evaluable points spent until the first alert that can be about the step, for each series; -1 where none came in time.

    Alerts count from the first point whose recent window touches the step; the
    budget of ``within`` points runs from the first that sees all of it.
    """
    spine_ix = np.arange(ok.shape[0])[:, None] + rule.baseline - 1
    opens = _opens(ok, cond, rule, persistence) & (spine_ix >= np.maximum(0, step - rule.recent)[None, :])
    first = opens.argmax(axis=0) if len(opens) else np.zeros(ok.shape[1], int)
    clock = np.cumsum(ok & (spine_ix >= np.maximum(0, step - 1)[None, :]), axis=0)
    spent = np.maximum(clock[first, np.arange(ok.shape[1])] - 1, 0) if len(opens) else first
    return np.where(opens.any(axis=0) & (spent < within), spent, -1)


def power(
    spine: DataFrame, rules: dict[str, decline.Rule], reference: decline.Rule, effects: list[float], ramps: list[int], within: int, replicates: int, seed: int, mechanisms: tuple[str, ...] = tuple(MECHANISMS)
) -> DataFrame:
    """(config, mechanism, effect, ramp, eligible, delivered, detected, power, median_delay) of injected declines.

    ``spine`` has ``fives``, the 5-star reviews of each month, besides count and
    sum.  The step of a product is drawn, under the reference rule, from months
    that leave ``within`` evaluable points; one without such a month isn't
    eligible.  One that alerts there anyway isn't delivered to that rule.  All
    rules see the same injected series.
    """
    ship(spine.sparkSession)
    series = spine.groupBy("parent_asin").agg(F.sort_array(F.collect_list(F.struct("ix", F.col("review_count").cast("bigint").alias("n"), F.col("rating_sum").cast("double").alias("s"), F.col("fives").cast("bigint").alias("f")))).alias("m"))
    series = series.select("parent_asin", *(F.col(f"m.{c}").alias(c) for c in "nsf"))
    variants = [(m, e, r) for m in mechanisms for e in effects for r in ramps]
    few = 2 * min(r.min_reviews for r in rules.values())
    alike: dict[tuple, list[str]] = {}
    for name, r in rules.items():
        alike.setdefault((r.baseline, r.recent, r.max_gap, r.recovery), []).append(name)

    def evaluable(x: tuple, rule: decline.Rule) -> np.ndarray:
        bn, ba, _, rn, ra, _, there = x
        return there & (bn >= rule.min_reviews) & (rn >= rule.min_reviews) & (ba >= rule.min_active) & (ra >= rule.min_active)

    def chunk(some: list, replicate: int, out: dict) -> None:
        size = np.array([len(n) for _, n, _, _ in some])
        n, s, f = (np.zeros((size.max(), len(some)), t) for t in (np.int64, float, np.int64))
        for k, (_, *cols) in enumerate(some):
            for into, col in zip((n, s, f), cols):
                into[: len(col), k] = col
        room = evaluable(_windows_of(n, s, size, reference), reference)
        step = np.full(len(some), -1)
        for k, (product, *_) in enumerate(some):
            at = np.flatnonzero(room[:, k])
            if len(at) >= within:
                u = int(hashlib.sha256(f"{seed}\x1fstep{replicate}\x1f{product}".encode()).hexdigest()[:16], 16) / 2**64
                step[k] = at[int(u * (len(at) - within + 1))] + reference.baseline - 1
        keep = np.flatnonzero(step >= 0)
        if not len(keep):
            return
        n, s, f, size, step = n[:, keep], s[:, keep], f[:, keep], size[keep], step[keep]

        def scored(sums: np.ndarray) -> dict[str, np.ndarray]:
            got = {}
            for names in alike.values():  # rules that differ in thresholds only walk side by side
                some = [rules[name] for name in names]
                x = _windows_of(n, sums, size, some[0])
                ok = np.concatenate([evaluable(x, rule) for rule in some], 1)
                cond = np.concatenate([x[5] <= x[2] - rule.delta for rule in some], 1)
                delay = _detected(ok, cond, some[0], np.tile(step, len(some)), within, np.repeat([rule.persistence for rule in some], len(step)))
                got |= dict(zip(names, delay.reshape(len(some), len(step))))
            return got

        prior = scored(s)
        for v in variants:
            # months behind a product's last have no reviews, so nothing is taken there
            lost = np.stack([inject(n[:, k], f[:, k], int(step[k]), v[1], v[0], v[2]) for k in range(len(step))], 1)
            for name, delay in scored(s - lost).items():
                delivered = prior[name] < 0
                cell = out.setdefault((name, *v), [0, 0, {}])
                cell[0] += len(step)
                cell[1] += int(delivered.sum())
                for d, times in zip(*np.unique(delay[delivered & (delay >= 0)], return_counts=True)):
                    cell[2][int(d)] = cell[2].get(int(d), 0) + int(times)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict = {(name, *v): [0, 0, {}] for name in rules for v in variants}
        waiting: list = []

        def flush() -> None:
            for r in range(1, replicates + 1) if waiting else []:
                chunk(waiting, r, out)
            waiting.clear()

        for b in batches:
            for product, *cols in zip(*(c.to_pylist() for c in b.columns)):
                if sum(cols[0]) >= few:
                    waiting.append((product, *cols))
                if len(waiting) >= 512:
                    flush()
        flush()
        rows = [(*key, None, e, d, 0) for key, (e, d, _) in out.items()] + [(*key, delay, 0, 0, k) for key, (_, _, ds) in out.items() for delay, k in ds.items()]
        kinds = [pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["config", "mechanism", "effect", "ramp", "delay", "eligible", "delivered", "detected"])

    found = series.mapInArrow(run, "config string, mechanism string, effect double, ramp int, delay int, eligible bigint, delivered bigint, detected bigint")
    g = found.groupBy("config", "mechanism", "effect", "ramp", "delay").agg(*(F.sum(c).alias(c) for c in ("eligible", "delivered", "detected")))
    median = F.expr("percentile(delay, 0.5, greatest(detected, 1)) filter (where delay is not null)").alias("median_delay")
    g = g.groupBy("config", "mechanism", "effect", "ramp").agg(*(F.sum(c).alias(c) for c in ("eligible", "delivered", "detected")), median)
    return g.withColumn("power", F.coalesce(F.try_divide("detected", "delivered"), F.lit(0.0)))


def placebo_rates(placebos: DataFrame, months: int) -> DataFrame:
    """(config, alerts_per_month, alerts_per_product_year): placebo alerts on one desk a month, and a year of one product."""
    a = F.coalesce(F.try_divide(F.col("alerts"), F.col("replicates") * F.lit(months)), F.lit(0.0))
    return placebos.select("config", a.alias("alerts_per_month"), F.coalesce(F.try_divide(F.col("alerts"), F.col("evaluable") / 12), F.lit(0.0)).alias("alerts_per_product_year"))


def selected(rates: DataFrame, powers: DataFrame, rules: dict[str, decline.Rule], ceiling: float, target: float) -> DataFrame:
    """One row: the rule under the ceiling with most power, then least median delay, larger drop, longer persistence, name.

    ``powers`` has one row per rule.  No row if no rule holds the ceiling.
    ``target_met`` reports a missed target; it doesn't weaken the ceiling.
    """
    said = powers.sparkSession.createDataFrame([(k, r.delta, r.persistence) for k, r in rules.items()], "config string, delta double, persistence int")
    x = powers.join(rates, "config").join(said, "config").where(F.col("alerts_per_month") <= ceiling)
    best = x.orderBy(F.desc("power"), F.col("median_delay").asc_nulls_last(), F.desc("delta"), F.desc("persistence"), "config").limit(1)
    return best.select("config", "power", "median_delay", "alerts_per_month", (F.col("power") >= target).alias("target_met"))
