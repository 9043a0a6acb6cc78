"""Ranked retrieval: BM25 in one narrow pass, exact cosine, rank fusion, scopes, pools and measures.

Queries are a stated, few set against all documents.  Their weights are handed
to every task in blocks of bounded size (``ENTRIES`` weights, ``BLOCK``
vectors); each task keeps the best k of every query and only those are
exchanged, however many documents a common word meets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import tokens
from ..session import ship

# The usual BM25 constants, and the fusion constant with its window.
K1, B = 1.2, 0.75
RRF_K, RRF_WINDOW = 60, 50
#: Weights of query terms, and query vectors, that are handed to the tasks at once.
ENTRIES, BLOCK = 2_000_000, 4096


def query_terms(queries: DataFrame, identifier: str = "query_id", words: Column | None = None) -> DataFrame:
    """(query_id, term, times); a repeated query term weighs as often as it stands."""
    words = tokens(F.col("text")) if words is None else words
    return queries.select(identifier, F.explode(words).alias("term")).groupBy(identifier, "term").agg(F.count(F.lit(1)).alias("times"))


def weights(docs: DataFrame, fields: dict[str, float], asked: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """((field, query_id, term, weight), mean length by field): what a query term is worth in each field.

    ``docs`` has an array of words for each field of ``fields``.  Statistics are
    taken over all documents that have words in the field; only terms that
    are asked for are counted.
    """
    wanted = asked.select("term").distinct()
    row = docs.agg(*(x for f in fields for x in (F.count(F.when(F.size(f) > 0, 1)).alias(f"n_{f}"), F.avg(F.when(F.size(f) > 0, F.size(f))).alias(f"mean_{f}")))).first()
    parts = []
    for f, boost in fields.items():
        df = docs.select(F.explode(F.array_distinct(f)).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        idf = F.log(1 + (row[f"n_{f}"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
        parts.append(asked.join(df, "term").select(F.lit(f).alias("field"), "query_id", "term", (F.lit(boost) * F.col("times") * idf).alias("weight")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every, {f: row[f"mean_{f}"] or 1.0 for f in fields}


class Best:
    """The k best (id, score) of every query so far; equal scores (to 12 places) rank by id."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.q, self.ids, self.scores = [np.zeros(0, np.int64)], [], [np.zeros(0)]
        self.held = 0

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        scores = np.round(scores, 12)
        good = scores >= self.floor[q]
        if good.any():
            self.q.append(q[good])
            self.ids.append(ids[good])
            self.scores.append(scores[good])
            self.held += int(good.sum())
            if self.held > 4 * self.k * len(self.floor) + 100_000:
                self.shrink()

    def shrink(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, scores = np.concatenate(self.q), np.concatenate(self.scores)
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, object)
        order = np.lexsort((ids, -scores, q)) if ids.dtype != object else np.array(sorted(range(len(q)), key=lambda i: (q[i], -scores[i], ids[i])), np.int64)
        q, ids, scores = q[order], ids[order], scores[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.k - 1
        self.floor[q[last]] = scores[last]
        keep = rank < self.k
        self.q, self.ids, self.scores = [q[keep]], [ids[keep]], [scores[keep]]
        self.held = int(keep.sum())
        return q[keep], ids[keep], scores[keep]


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) else np.array(column.to_pylist(), object)


def _blocks(df: DataFrame, rows: int, key: str) -> Iterator[list]:
    """The rows of ``df`` on the driver in parts of about ``rows``, those of one key together."""
    parts = max(1, -(-df.count() // rows))
    for i in range(parts):
        part = df if parts == 1 else df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i)
        yield part.collect()


def _union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    u = parts[0] if parts else empty
    for p in parts[1:]:
        u = u.unionByName(p)
    return u


def bm25(docs: DataFrame, fields: dict[str, float], asked: DataFrame, k: int, identifier: str = "doc_id", among: Column | None = None, itself: bool = True) -> DataFrame:
    """(query_id, id, score, rank) of the k best documents of every query by the better of its fields.

    ``docs`` is (id, an array of words per field, ...), ``asked`` what
    ``query_terms`` gives.  Documents where ``among`` doesn't hold count for
    the statistics but aren't found.  ``itself`` tells whether a query may find
    the document of its own id.
    """
    ship(docs.sparkSession)
    weighed, mean = weights(docs, fields, asked)
    weighed = weighed.checkpoint()
    kind = docs.schema[identifier].dataType.simpleString()
    schema = f"query_id string, `{identifier}` {kind}, score double"
    found = docs if among is None else docs.where(among)
    names = list(fields)
    parts = []
    for block in _blocks(weighed, ENTRIES, "query_id"):
        queries = sorted({r.query_id for r in block})
        at = {q: i for i, q in enumerate(queries)}
        tables = {}
        for f in names:
            own = sorted((r.term, at[r.query_id], r.weight) for r in block if r.field == f)
            terms = sorted({t for t, _, _ in own})
            start = np.searchsorted(np.array([t for t, _, _ in own], object), np.array([*terms], object)) if own else np.zeros(0, np.int64)
            tables[f] = (terms, np.append(start, len(own)).astype(np.int64), np.array([q for _, q, _ in own], np.int64), np.array([w for _, _, w in own]))
        shared = docs.sparkSession.sparkContext.broadcast((queries, tables))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            queries, tables = shared.value
            count, best = len(queries), Best(len(queries), k)
            sets = {f: pa.array(t[0], pa.string()) for f, t in tables.items()}
            names_of = np.array(queries, object)
            for b in batches:
                for lo in range(0, b.num_rows, 512):
                    part = b.slice(lo, 512)
                    ids = _ids(part.column(0))
                    total = np.zeros(len(ids) * count)
                    for j, f in enumerate(names, 1):
                        terms, start, q, w = tables[f]
                        if not terms:
                            continue
                        words = part.column(j)
                        size = np.asarray(words.value_lengths().fill_null(0)).astype(np.int64)
                        doc = np.repeat(np.arange(len(ids)), size)
                        term = pc.index_in(words.flatten(), value_set=sets[f])
                        hit = np.asarray(term.is_valid())
                        cell, tf = np.unique(doc[hit] * len(terms) + np.asarray(term.drop_null()).astype(np.int64), return_counts=True)
                        doc, term = cell // len(terms), cell % len(terms)
                        gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / mean[f]))
                        times = start[term + 1] - start[term]
                        src = np.repeat(np.arange(len(cell)), times)
                        pos = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(start[term], times)
                        total = np.maximum(total, np.bincount(doc[src] * count + q[pos], weights=gain[src] * w[pos], minlength=len(total)))
                    some = np.flatnonzero(total > 0)
                    qs, ds = some % count, some // count
                    other = np.ones(len(some), bool) if itself or not len(some) else names_of[qs] != ids[ds].astype(str).astype(object)
                    best.add(qs[other], ids[ds[other]], total[some[other]])
            q, ids, scores = best.shrink()
            yield pa.RecordBatch.from_arrays([pa.array([queries[i] for i in q], pa.string()), pa.array(ids.tolist(), _ARROW[kind]), pa.array(scores, pa.float64())], ["query_id", identifier, "score"])

        parts.append(found.select(identifier, *names).mapInArrow(run, schema))
    return ranked(_union(parts, docs.sparkSession.createDataFrame([], schema)), k, identifier)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def scoped_bm25(pairs: DataFrame, mean: dict[str, float], fields: dict[str, float]) -> DataFrame:
    """(every column, score): BM25 of documents already joined with the one query whose scope holds them.

    ``pairs`` has the words of each field and ``worth``, a map per field from
    term to weight.  The score of a pair needs nothing else, so it stays in the JVM.
    """
    def of(f: str) -> Column:
        own, size = F.col(f"worth_{f}"), F.size(f)

        def gain(t: Column) -> Column:
            tf = F.size(F.filter(F.col(f), lambda x: x == t))
            return own[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / F.lit(mean[f])))

        hits = F.filter(F.array_distinct(f), lambda t: F.map_contains_key(own, t))
        return F.coalesce(F.aggregate(hits, F.lit(0.0), lambda s, t: s + gain(t)), F.lit(0.0))

    scores = [of(f) for f in fields]
    return pairs.withColumn("score", F.greatest(*scores) if len(scores) > 1 else scores[0])


def ranked(scores: DataFrame, k: int, identifier: str = "doc_id") -> DataFrame:
    """(query_id, id, score, rank) of the k best of each query; scores equal to 9 places rank by id."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), identifier)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where one is zero, and for unequal sizes."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_knn(vectors: DataFrame, queries: DataFrame, k: int, identifier: str = "vec_id") -> DataFrame:
    """Exact cosine search of a stated query set: (query_id, id, score, rank), score is cosine + 1.

    ``vectors`` is (id, v), ``queries`` (query_id, q).  Blocks of queries meet
    all vectors as matrix products; only k rows per task and query are
    exchanged.  Vectors of another length than a block's first, with nulls, not
    finite or zero don't count.  A vector is not its own hit.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = vectors.schema[identifier].dataType.simpleString()
    schema = f"query_id string, `{identifier}` {kind}, score double"
    parts = []
    for block in _blocks(queries.select("query_id", "q"), BLOCK, "query_id"):
        size = max((len(r.q) for r in block if r.q is not None), default=0)
        rows = [(r.query_id, np.array(r.q, np.float64)) for r in block if r.q is not None and len(r.q) == size and None not in r.q]
        rows = [(i, x / n) for i, x in rows if np.isfinite(n := np.linalg.norm(x)) and n > 0]
        if not rows:
            continue
        shared = spark.sparkContext.broadcast(([i for i, _ in rows], np.stack([x for _, x in rows])))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, size=size) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            best, names_of = Best(len(names), k), np.array(names, object)
            for b in batches:
                ids, column = _ids(b.column(0)), b.column(1)
                rows = np.flatnonzero(np.asarray(column.value_lengths().fill_null(0)) == size)
                flat = column.take(pa.array(rows)).flatten()
                x = np.asarray(flat.fill_null(np.nan) if flat.null_count else flat, np.float64).reshape(len(rows), size)
                norm = np.linalg.norm(x, axis=1)
                good = np.isfinite(norm) & (norm > 0)
                x, ids = x[good] / norm[good, None], ids[rows[good]]
                for lo in range(0, len(x), 1024):
                    s = 1 + x[lo : lo + 1024] @ q.T
                    own = ids[lo : lo + 1024]
                    s[own.astype(str).astype(object)[:, None] == names_of[None, :]] = -np.inf
                    if len(s) > k:  # rows below the k best of this block can't be among the k best of all
                        s[np.round(s, 12) < np.round(-np.partition(-s, k - 1, axis=0)[k - 1], 12)] = -np.inf
                    d, at = np.nonzero(s > -np.inf)
                    best.add(at, own[d], s[d, at])
            at, ids, scores = best.shrink()
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in at], pa.string()), pa.array(ids.tolist(), _ARROW[kind]), pa.array(scores, pa.float64())], ["query_id", identifier, "score"])

        parts.append(vectors.select(identifier, "v").mapInArrow(run, schema))
    return ranked(_union(parts, spark.createDataFrame([], schema)), k, identifier)


def fuse(legs: dict[str, DataFrame], k: int = RRF_K, window: int = RRF_WINDOW, identifier: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion: (query_id, id, score, rank, <leg>_rank...)."""
    parts = [d.where(F.col("rank") <= window).select("query_id", identifier, "rank", F.lit(n).alias("leg")) for n, d in legs.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    scored = u.groupBy("query_id", identifier).agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"), *(F.max(F.when(F.col("leg") == n, F.col("rank"))).alias(f"{n}_rank") for n in legs))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), identifier)
    return scored.withColumn("rank", F.row_number().over(w))


def pool(systems: dict[str, DataFrame], depth: int = 10, identifier: str = "doc_id") -> DataFrame:
    """(query_id, id, ranks): what any system ranks within ``depth``, with its rank in each as ``name=rank``."""
    parts = [d.where(F.col("rank") <= depth).select("query_id", identifier, F.concat_ws("=", F.lit(n), F.col("rank").cast("string")).alias("r")) for n, d in systems.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("query_id", identifier).agg(F.array_join(F.array_sort(F.collect_list("r")), " ").alias("ranks"))


def completeness(pooled: DataFrame, judged: DataFrame, identifier: str = "doc_id") -> DataFrame:
    """(query_id, pooled, judged, complete)."""
    j = pooled.join(judged.select("query_id", identifier, F.lit(1).alias("hit")).distinct(), ["query_id", identifier], "left")
    return j.groupBy("query_id").agg(F.count(F.lit(1)).alias("pooled"), F.count("hit").alias("judged"), (F.count("hit") == F.count(F.lit(1))).alias("complete"))


def measures(run: DataFrame, queries: DataFrame, p_at: int = 5, mrr_at: int = 10) -> DataFrame:
    """Per stratum: queries, complete ones, and mean precision and reciprocal rank over the complete ones.

    ``run`` is (query_id, rank, relevant), relevant null where nobody judged;
    ``queries`` (query_id, stratum).  A query is complete if it has ``mrr_at``
    ranks and all are judged.
    """
    top = run.where(F.col("rank") <= mrr_at).groupBy("query_id").agg(
        ((F.count("rank") == mrr_at) & (F.count("relevant") == mrr_at)).alias("complete"),
        F.count(F.when(F.col("relevant") & (F.col("rank") <= p_at), 1)).alias("hits"),
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"),
    )
    per = queries.join(top, "query_id", "left").select("stratum", F.coalesce("complete", F.lit(False)).alias("complete"), (F.col("hits") / p_at).alias("p"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))
    mean = lambda c: F.round(F.avg(F.when(F.col("complete"), F.col(c))), 9)
    return per.groupBy("stratum").agg(F.count(F.lit(1)).alias("queries"), F.count(F.when(F.col("complete"), 1)).alias("complete"), mean("p").alias("precision_at_5"), mean("rr").alias("mrr_at_10"))


def overlap(found: DataFrame, truth: DataFrame, k: int, identifier: str = "doc_id") -> DataFrame:
    """(query_id, recall): share of the k true neighbours that were found."""
    hit = truth.where(F.col("rank") <= k).join(found.where(F.col("rank") <= k).select("query_id", identifier, F.lit(1).alias("hit")), ["query_id", identifier], "left")
    return hit.groupBy("query_id").agg(F.round(F.count("hit") / F.lit(k), 9).alias("recall"))


def overlap_summary(recall: DataFrame) -> DataFrame:
    return recall.agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg("recall"), 9).alias("mean_recall"), F.min("recall").alias("min_recall"),
        F.count(F.when(F.col("recall") == 1, 1)).alias("perfect"), F.count(F.when(F.col("recall") < 0.8, 1)).alias("below_80"),
    )
