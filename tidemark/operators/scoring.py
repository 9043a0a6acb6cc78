"""Comparing label sets: confusion by theme, macro averages, agreement, cuts, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import kappa, wilson


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """Harmonic mean of precision and recall; 0 where neither is defined."""
    return ratio(2.0 * tp, 2 * tp + fp + fn)


def outcomes(reference: DataFrame, system: DataFrame, key: str = "id") -> DataFrame:
    """(id, theme, ref, sys): every theme that either side gives an item."""
    r = reference.select(key, "theme", F.lit(1).alias("ref")).distinct()
    s = system.select(key, "theme", F.lit(1).alias("sys")).distinct()
    return r.join(s, [key, "theme"], "full_outer").na.fill(0, ["ref", "sys"])


def by_theme(joined: DataFrame) -> DataFrame:
    """Per theme: tp, fp, fn, support, precision, recall, f1."""
    n = lambda c: F.sum(c.cast("int")).cast("long")
    ref, sys = F.col("ref") == 1, F.col("sys") == 1
    c = joined.groupBy("theme").agg(n(ref & sys).alias("tp"), n(~ref & sys).alias("fp"), n(ref & ~sys).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("*", (tp + fn).alias("support"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1(tp, fp, fn).alias("f1"))


def macro(scores: DataFrame, least: int = 10) -> DataFrame:
    """One row: mean F1 over themes with enough support, and how many those are."""
    s = scores.where(F.col("support") >= least)
    return s.agg(F.count(F.lit(1)).alias("themes"), F.avg("f1").alias("macro_f1"))


def disagreements(joined: DataFrame, key: str = "id") -> DataFrame:
    """Themes that one side gives an item and the other doesn't."""
    return joined.where("ref <> sys").select(key, "theme", F.when(F.col("ref") == 1, "only_reference").otherwise("only_system").alias("side"))


def best_cut(df: DataFrame, grid: list[float], score: str = "score", label: str = "label", theme: str = "theme") -> DataFrame:
    """Per theme the cut with the best F1 of ``score >= cut``; the lowest of equals.

    The grid is short and stated; each row adds to one state per cut within
    its task, and only states are exchanged.
    """
    cuts = df.select(theme, label, score, F.explode(F.array(*map(F.lit, grid))).alias("cut"))
    hit, pos = F.col(score) >= F.col("cut"), F.col(label) == 1
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int")).cast("long")
    c = cuts.groupBy(theme, "cut").agg(n(hit & pos).alias("tp"), n(hit & ~pos).alias("fp"), n(~hit & pos).alias("fn"))
    scored = c.withColumn("f1", F.round(f1(F.col("tp"), F.col("fp"), F.col("fn")), 9))
    w = Window.partitionBy(theme).orderBy(F.desc("f1"), "cut")
    return scored.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def star_rule(labelled: DataFrame) -> DataFrame:
    """Per theme the star bound k with the best F1 of ``rating <= k``: (theme, k, tp, fp, fn, f1).

    ``labelled`` is (id, rating, themes): each item with the array of its
    themes.  Themes, any number of them, and items are counted by star; what a
    bound gets wrong follows from both counts.
    """
    stars = F.sequence(F.lit(1), F.lit(5))
    own = labelled.select("rating", F.explode(F.array_distinct("themes")).alias("theme")).groupBy("theme", "rating").agg(F.count(F.lit(1)).alias("n"))
    own = own.select("theme", "rating", "n", F.explode(stars).alias("k")).groupBy("theme", "k").agg(
        F.sum(F.when(F.col("rating") <= F.col("k"), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("support")
    )
    every = labelled.select("rating", F.explode(stars).alias("k")).groupBy("k").agg(F.count(F.when(F.col("rating") <= F.col("k"), 1)).alias("said"))
    c = own.join(F.broadcast(every), "k").select("theme", "k", "tp", (F.col("said") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"))  # five rows
    scored = c.withColumn("f1", F.round(f1(F.col("tp"), F.col("fp"), F.col("fn")), 9))
    w = Window.partitionBy("theme").orderBy(F.desc("f1"), F.desc("k"))
    return scored.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def _both(ratings: DataFrame, first: str, second: str) -> DataFrame:
    a = ratings.where(F.col("rater") == first).select("id", F.col("label").alias("a"))
    b = ratings.where(F.col("rater") == second).select("id", F.col("label").alias("b"))
    return a.join(b, "id")


def agreement(ratings: DataFrame, first: str, second: str) -> DataFrame:
    """Per label: how two raters agree on the items both rated, with kappa and a Wilson interval.

    ``ratings`` is (id, rater, label), one label of a rater for an item.  An
    item meets only the labels that it was given.
    """
    both = _both(ratings, first, second)
    items = both.agg(F.count(F.lit(1))).scalar()
    n = lambda c: F.sum(c.cast("int")).cast("long")
    is_a, is_b = F.col("a") == F.col("label"), F.col("b") == F.col("label")
    said = both.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("label"))
    g = said.groupBy("label").agg(n(is_a & is_b).alias("both"), n(is_a).alias("first"), n(is_b).alias("second")).withColumn("items", items)
    agree = F.col("items") - F.col("first") - F.col("second") + 2 * F.col("both")
    lo, hi = wilson(agree, F.col("items"))
    return g.select("*", F.round(kappa(F.col("both"), F.col("first"), F.col("second"), F.col("items")), 9).alias("kappa"), F.round(lo, 9).alias("low"), F.round(hi, 9).alias("high"))


def pooled_agreement(ratings: DataFrame, first: str, second: str) -> DataFrame:
    """One row: items, labels, items with equal labels, decisions (items x labels), those agreed on, and pooled kappa."""
    both = _both(ratings, first, second)
    g = both.agg(F.count(F.lit(1)).alias("items"), F.count(F.when(F.col("a") == F.col("b"), 1)).alias("equal_sets"))
    labels = both.select(F.explode(F.array("a", "b")).alias("label")).agg(F.count_distinct("label").alias("labels"))
    x = g.join(labels, F.lit(True)).withColumn("decisions", F.col("items") * F.col("labels"))
    k = kappa(F.col("equal_sets"), F.col("items"), F.col("items"), F.col("decisions"))
    return x.select("items", "labels", "equal_sets", "decisions", (F.col("decisions") - 2 * (F.col("items") - F.col("equal_sets"))).alias("agreed"), F.round(k, 9).alias("kappa"))


def poisson_weight(identifier: Column, draw: Column, seed: int) -> Column:
    """How often a cluster stands in one resample: Poisson of mean 1, from a hash."""
    h = F.sha2(F.concat_ws("\u001f", F.lit(str(seed)), draw.cast("string"), identifier), 256)
    u = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    bounds, total, term = [], 0.0, 0.36787944117144233
    for k in range(7):
        total += term
        bounds.append(round(total, 12))
        term /= k + 1
    w = F.when(u < bounds[0], 0)
    for k, b in enumerate(bounds[1:], 1):
        w = w.when(u < b, k)
    return w.otherwise(7)


def resampled_macro(clustered: DataFrame, draws: int, seed: int) -> DataFrame:
    """(draw, macro_f1) over resamples of clusters.

    ``clustered`` is (cluster, theme, tp, fp, fn).  Weights are drawn per
    cluster and draw where the cluster's counts lie, then summed with
    map-side combining; resamples are never materialised.
    """
    own = clustered.groupBy("cluster").agg(F.collect_list(F.struct("theme", "tp", "fp", "fn")).alias("own"))  # one hash serves all themes
    x = own.select("*", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    w = poisson_weight(F.col("cluster"), F.col("draw"), seed)
    s = x.select("draw", w.alias("w"), "own").where("w > 0").select("draw", "w", F.inline("own")).groupBy("draw", "theme").agg(*(F.sum(F.col(c) * F.col("w")).cast("long").alias(c) for c in ("tp", "fp", "fn")))
    return s.groupBy("draw").agg(F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1"))


def interval(draws: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Nearest-rank bounds of resampled values; few rows by construction."""
    n = F.count(F.lit(1))
    at = lambda q: F.element_at(F.sort_array(F.collect_list(F.round("macro_f1", 9))), F.greatest(F.lit(1), F.ceil(n * q)).cast("int"))
    return draws.agg(n.alias("draws"), at(low).alias("low"), at(high).alias("high"))
