"""Answers with citations: handles, contract checks, rankings of declines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import draw_key
from ..session import ship
from .ordering import numbered

# The rules of the contract in their order.
RULES = ("terminal", "refusal_empty", "claims_cite", "citations_retrieved", "citations_in_scope")


def handles(retrieved: DataFrame) -> DataFrame:
    """Number retrieved reviews of each question R1..Rn over its windows, by window then rank."""
    w = Window.partitionBy("question_id").orderBy("window", "rank", "review_id")
    return retrieved.withColumn("cite_id", F.concat(F.lit("R"), F.row_number().over(w).cast("string")))


def violations(answers: DataFrame, claims: DataFrame, retrieved: DataFrame, scopes: DataFrame) -> DataFrame:
    """(question_id, rule, times) of the broken rules.

    ``answers`` (question_id, status, refused, reason), ``claims`` (question_id,
    claim, citations array<struct<cite_id, window>>), ``retrieved``
    (question_id, cite_id, window, ix), ``scopes`` (question_id, window, lo, hi).

    An answer that didn't succeed breaks the first rule and isn't judged
    further.  A refusal breaks the second for each of: carrying claims,
    carrying citations, lacking a written reason; nothing else of it is judged.
    Another answer breaks the third if it has no claims, and for each claim
    without citations; the fourth for each citation of something that wasn't
    retrieved for its question, the fifth for each whose window isn't declared,
    isn't the one it was retrieved for, or doesn't hold the review's month.
    """
    done = F.coalesce(F.col("status") == "succeeded", F.lit(False))
    refused = F.coalesce(F.col("refused"), F.lit(False))
    carried = claims.groupBy("question_id").agg(F.count(F.lit(1)).alias("claims"), F.sum(F.greatest(F.coalesce(F.size("citations"), F.lit(0)), F.lit(0))).alias("cited"), F.count(F.when(F.coalesce(F.size("citations"), F.lit(0)) <= 0, 1)).alias("bare"))
    a = answers.join(carried, "question_id", "left").na.fill(0, ["claims", "cited", "bare"])
    blank = F.coalesce(F.trim("reason"), F.lit("")) == ""
    of_refusal = (F.col("claims") > 0).cast("long") + (F.col("cited") > 0).cast("long") + blank.cast("long")
    of_answer = F.when(F.col("claims") == 0, 1).otherwise(F.col("bare"))
    shape = a.select(
        "question_id",
        F.when(~done, F.struct(F.lit(RULES[0]).alias("rule"), F.lit(1).cast("long").alias("times")))
        .when(refused, F.struct(F.lit(RULES[1]).alias("rule"), of_refusal.alias("times")))
        .otherwise(F.struct(F.lit(RULES[2]).alias("rule"), of_answer.cast("long").alias("times")))
        .alias("r"),
    ).select("question_id", "r.rule", "r.times").where("times > 0")
    open_claims = claims.join(answers.where(done & ~refused).select("question_id"), "question_id", "left_semi")
    cited = open_claims.select("question_id", F.explode("citations").alias("c")).select("question_id", "c.cite_id", F.col("c.window").alias("said"))
    shown = retrieved.select("question_id", "cite_id", F.col("window").alias("shown"), "ix")
    declared = scopes.select("question_id", F.col("window").alias("said"), "lo", "hi")
    found = cited.join(shown, ["question_id", "cite_id"], "left").join(declared, ["question_id", "said"], "left")
    inside = (F.col("shown") == F.col("said")) & F.col("ix").between(F.col("lo"), F.col("hi"))
    rule = F.when(F.col("shown").isNull(), RULES[3]).when(~F.coalesce(inside, F.lit(False)), RULES[4])
    wrong = found.select("question_id", rule.alias("rule")).where("rule is not null").groupBy("question_id", "rule").agg(F.count(F.lit(1)).alias("times"))
    return shape.unionByName(wrong)


def window_ratings(reviews: DataFrame, windows: DataFrame) -> DataFrame:
    """Ratings of each product window as counts by star: (parent_asin, window, n, sum, ...)."""
    w = windows.select(F.col("parent_asin").alias("w_asin"), "window", "lo", "hi")
    inside = (F.col("parent_asin") == F.col("w_asin")) & F.col("ix").between(F.col("lo"), F.col("hi"))
    return reviews.join(w, inside).groupBy("parent_asin", "window").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("s"))


def decline_bound(reviews: DataFrame, windows: DataFrame, draws: int = 2000, seed: int = 20260911, low: float = 0.025, key: str = "parent_asin") -> DataFrame:
    """(key, parent_asin, draws, bound, rank): a resampled lower bound of baseline mean less recent mean.

    ``windows`` is (key, parent_asin, window, lo, hi).  Ratings of a window are
    folded to counts by star; a resample of n ratings with replacement is then
    a multinomial draw of those counts.  The generator is seeded by the key.  A
    case with an empty window has no bound.  The bound is the value at index
    ``low * draws`` of the sorted differences; every case is ranked.
    """
    if draws < 100:
        raise ValueError(f"{draws} draws can't support a lower bound")
    ship(reviews.sparkSession)
    w = windows.select(F.col(key).alias("_key"), F.col("parent_asin").alias("w_asin"), "window", "lo", "hi")
    inside = (F.col("parent_asin") == F.col("w_asin")) & F.col("ix").between(F.col("lo"), F.col("hi"))
    stars = reviews.where("rating is not null").groupBy("parent_asin", "ix", "rating").agg(F.count(F.lit(1)).alias("n"))
    cells = stars.join(w, inside).groupBy("_key", "parent_asin", "window", "rating").agg(F.sum("n").alias("n"))
    cell = F.struct(F.col("rating").cast("double").alias("rating"), "n")
    both = cells.groupBy("_key", "parent_asin").agg(*(F.sort_array(F.collect_list(F.when(F.col("window") == x, cell))).alias(x) for x in ("baseline", "recent")))
    both = both.where((F.size("baseline") > 0) & (F.size("recent") > 0)).select("_key", "parent_asin", *(F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in ("baseline", "recent") for c in ("rating", "n")))

    def means(rng: np.random.Generator, rating: list[float], n: list[int]) -> np.ndarray:
        total = sum(n)
        return rng.multinomial(total, np.array(n) / total, size=draws) @ np.array(rating) / total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bounds = []
            for k, _, br, bn, rr, rn in zip(*(c.to_pylist() for c in b.columns)):
                rng = np.random.default_rng(int(hashlib.sha256(f"{seed}:{k}".encode()).hexdigest()[:16], 16))
                d = means(rng, br, bn) - means(rng, rr, rn)
                at = min(draws - 1, max(0, int(low * draws)))
                bounds.append(round(float(np.partition(d, at)[at]), 6) + 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([draws] * len(bounds), pa.int64()), pa.array(bounds, pa.float64())], ["_key", "parent_asin", "draws", "bound"])

    bound = both.mapInArrow(run, "_key string, parent_asin string, draws bigint, bound double")
    ranked = numbered(bound, F.desc("bound"), "parent_asin", "_key").withColumn("rank", F.col("pos") + 1).drop("pos")
    return ranked.drop("_key") if key == "parent_asin" else ranked.withColumnRenamed("_key", key)


def distinct_slots(ranked: DataFrame, controls: DataFrame, wanted: int) -> list[dict]:
    """Greedy choice over few ranked cases: each takes its nearest control not used so far.

    ``ranked`` (episode_id, parent_asin, rank), ``controls`` (episode_id,
    control_asin, control_rank).  The driver walks the ranking range by range
    until the slots are filled.
    """
    rows = ranked.select("episode_id", "parent_asin", "rank").join(controls, "episode_id").orderBy("rank", "control_rank").toLocalIterator()
    used: set[str] = set()
    chosen: list[dict] = []
    seen: set[str] = set()
    for r in rows:
        if len(chosen) == wanted:
            break
        if r.episode_id in seen or r.parent_asin in used or r.control_asin is None or r.control_asin in used:
            continue
        seen.add(r.episode_id)
        used |= {r.parent_asin, r.control_asin}
        chosen.append({"slot": len(chosen) + 1, "episode_id": r.episode_id, "parent_asin": r.parent_asin, "control_asin": r.control_asin})
    return chosen


def retrieved_by_draw(reviews: DataFrame, windows: DataFrame, k: int, seed: int) -> DataFrame:
    """Up to k reviews of each product window in draw order, as a stand-in for a retriever."""
    w = windows.select(F.col("parent_asin").alias("w_asin"), "window", "lo", "hi")
    inside = (F.col("parent_asin") == F.col("w_asin")) & F.col("ix").between(F.col("lo"), F.col("hi"))
    x = reviews.join(w, inside).select(F.col("parent_asin").alias("question_id"), "window", "review_id", "ix")
    order = Window.partitionBy("question_id", "window").orderBy(draw_key(F.col("review_id"), seed, "retrieve"), "review_id")
    return x.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
