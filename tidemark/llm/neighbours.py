"""The k most similar vectors of every vector (problem 2).

Posting lists around centroids.  Centroids are fitted on samples by spherical
k-means and kept balanced: a list that drew more than ``SLACK`` times its share
is split.  A nearest-neighbour graph over the centroids, held in memory, is
searched by beams from a few pivots.  A vector enters the lists whose centroids
lie within ``(1 + RATIO)`` of its smallest distance, ``REPLICAS`` at most, so
vectors near a border are replicated, and it searches the same lists.  The top
k of its lists merge into its result.

Lists hold about ``LIST`` vectors at any size.  A specification of more than
``FAN`` lists is first divided, by the same means, into cells of about ``FAN``
lists, and each cell has its own centroids, fitted on its own sample where the
executors hold it.  Vectors are routed in groups of about ``GROUP`` of one cell
that meet the centroids of that cell only, so neither centroids nor vectors of
all cells are ever in one place.  A list that still grew beyond ``BLOCK`` is
divided again inside its task.

Copies of one vector are one entry of the index.  Of its holders only the
k + 1 of lowest id can be anyone's neighbours, ties being broken by id, and
they are found by a rank with map-side limit.  So a group of copies with a third of
all rows is as cheap as any other and no neighbour of any row is lost.

A vector that is null, of another length, zero, or not finite doesn't count.
Of several rows of one id and specification the last ``embedded_at`` counts,
then the largest vector key.  Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch, shared_dir, ship

#: Vectors of a list, lists that hold a vector at most, and how much farther than the nearest centroid theirs may be.
LIST, REPLICAS, RATIO = 1000, 4, 0.12
#: Lists of a cell, vectors routed at once, and vectors that centroids are fitted on: for each, and for a cell at most.
FAN, GROUP, PER_LIST, SAMPLE = 128, 1024, 48, 50_000
#: A list is split when it drew more than this times its share of the sample.
SLACK = 2.0
#: Vectors compared at once inside a list, and the size from which a list is divided again.
ROWS, BLOCK = 1024, 12_000
#: Links of a centroid each way, beam width, and pivots at least.
DEGREE, BEAM, PIVOTS = 16, 16, 64
#: Rows of a table of cells up to which it is broadcast.
FEW = 100_000


@dataclass(frozen=True)
class Shape:
    """Sizes that decide how an index divides."""

    size: int = LIST
    fan: int = FAN
    group: int = GROUP

    @property
    def cell(self) -> int:
        """Vectors of a cell that is divided into lists next."""
        return self.fan * self.size

    @property
    def share(self) -> float:
        """Part of the vectors that samples are drawn from."""
        return min(1.0, max(PER_LIST / self.size, 0.01))


def unit_rows(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors) of the rows that count."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(column.value_lengths().fill_null(0))
    rows = np.flatnonzero(size == dims)
    if not len(rows):
        return rows, np.zeros((0, dims), np.float32)
    taken = column.take(pa.array(rows))
    flat = taken.flatten()
    x = np.asarray(flat.fill_null(np.nan) if flat.null_count else flat, np.float32).reshape(len(rows), dims)
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
        good = np.isfinite(norm) & (norm > 0)
        return rows[good], (x[good] / norm[good, None]).astype(np.float32)


def means(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; an empty cluster restarts at a drawn row."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        order = np.argsort(at, kind="stable")
        n = np.bincount(at, minlength=k)
        has = np.flatnonzero(n)
        c[has] = np.add.reduceat(x[order], np.concatenate(([0], np.cumsum(n[has])[:-1])), axis=0)
        lost = np.flatnonzero(n == 0)
        c[lost] = x[rng.choice(len(x), len(lost))]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def balanced(x: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """About k centroids, none of which draws more than ``SLACK`` shares of ``x`` where rows differ."""
    k = max(1, min(k, len(x)))
    if k == 1:
        m = x.sum(0, keepdims=True)
        return (m / max(np.linalg.norm(m), 1e-12)).astype(np.float32)
    c = means(x, k, seed)
    share = len(x) / k
    for turn in range(3):
        at = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        n = np.bincount(at, minlength=len(c))
        big = np.flatnonzero(n > SLACK * share)
        if not len(big):
            break
        parts = [means(x[at == b], min(int(np.ceil(n[b] / share)), n[b]), seed + turn + 1) for b in big]
        c = np.concatenate([np.delete(c, big, axis=0), *parts])
    return c.astype(np.float32)


@dataclass
class Graph:
    """Centroids with a nearest-neighbour graph and the pivots where searches begin."""

    centroids: np.ndarray
    links: np.ndarray
    pivots: np.ndarray

    @staticmethod
    def over(c: np.ndarray) -> Graph:
        d = min(DEGREE, len(c) - 1)
        s = c @ c.T
        np.fill_diagonal(s, -2)
        near_first = np.argsort(-s, axis=1, kind="stable")[:, :d].astype(np.int32)
        # links back make every centroid reachable; a place without link holds len(c), which no search visits
        source, target = np.repeat(np.arange(len(c)), d), near_first.ravel()
        order = np.lexsort((-s[source, target], target))
        source, target = source[order], target[order]
        place = np.arange(len(target)) - np.searchsorted(target, target)
        back = np.full((len(c), d), len(c), np.int32)
        few = place < d
        back[target[few], place[few]] = source[few]
        links = np.concatenate([near_first, back], 1)
        # pivots spread: each is the centroid farthest from those before; a part of the graph without links
        # to the rest has more than DEGREE centroids, so there are pivots enough for every part
        count = min(len(c), max(PIVOTS, -(-len(c) // DEGREE)))
        pivots, near = [0], s[0].copy()
        near[0] = 2
        while len(pivots) < count:
            p = int(near.argmin())
            pivots.append(p)
            near = np.maximum(near, s[p])
            near[p] = 2
        return Graph(c, links, np.array(pivots, np.int32))

    def search(self, q: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities), best first, of the ``want`` centroids found for each row of ``q``."""
        n, m = len(q), len(self.centroids)
        beam = min(m, max(BEAM, want))
        ids = np.full((n, beam), -1, np.int32)
        sims = np.full((n, beam), -3, np.float32)
        done = np.ones((n, beam), bool)
        seen = np.zeros((n, m + 1), bool)
        seen[:, m] = True
        s = q @ self.centroids[self.pivots].T
        b = min(beam, len(self.pivots))
        o = np.argsort(-s, axis=1, kind="stable")[:, :b]
        ids[:, :b], sims[:, :b], done[:, :b] = self.pivots[o], np.take_along_axis(s, o, 1), False
        seen[:, self.pivots] = True
        live = np.arange(n)
        while len(live) and self.links.shape[1]:
            open_sims = np.where(done[live], -4, sims[live])
            at = open_sims.argmax(1)
            go = open_sims[np.arange(len(live)), at] > -3
            live, at = live[go], at[go]
            if not len(live):
                break
            done[live, at] = True
            cand = self.links[ids[live, at]]
            fresh = ~seen[live[:, None], cand]
            half = cand.shape[1] // 2
            fresh[:, half:] &= ~(cand[:, half:, None] == cand[:, None, :half]).any(2)
            seen[live[:, None], cand] = True
            cs = np.matmul(self.centroids[np.minimum(cand, m - 1)], q[live][:, :, None])[:, :, 0]
            cs[~fresh] = -3
            all_s = np.concatenate([sims[live], cs], 1)
            o = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
            sims[live] = np.take_along_axis(all_s, o, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], cand], 1), o, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], 1), o, 1)
        return ids[:, :want], sims[:, :want]

    def lists(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every list each vector enters, pruned by the ratio of distances."""
        ids, sims = self.search(q, min(REPLICAS, len(self.centroids)))
        far = np.sqrt(np.maximum(2 - 2 * sims, 0))
        take = (ids >= 0) & (far <= far[:, :1] * (1 + RATIO) + 1e-6)
        take[:, 0] = True
        row, k = np.nonzero(take)
        return row, ids[row, k]


def nearest(x: np.ndarray, wanted: np.ndarray, k: int, depth: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, neighbour, cosine) of the k best of every wanted row of ``x``, in no order."""
    n = len(x)
    if n > BLOCK and depth < 4:
        rng = np.random.default_rng(depth)
        graph = Graph.over(balanced(x[rng.choice(n, min(n, PER_LIST * (n // LIST)), replace=False)], n // LIST))
        row, at = np.concatenate([np.stack(graph.lists(x[i : i + 2048])) + [[i], [0]] for i in range(0, n, 2048)], axis=1)
        order = np.argsort(at, kind="stable")
        parts = []
        for members in np.split(row[order], np.flatnonzero(np.diff(at[order])) + 1):
            if len(members) < n:
                a, b, c = nearest(x[members], wanted[members], k, depth + 1)
                parts.append((members[a], members[b], c))
        if parts:
            return tuple(np.concatenate(p) for p in zip(*parts))
    rows, found, cosines = [], [], []
    asked = np.flatnonzero(wanted)
    k = min(k, n - 1)
    for i in range(0, len(asked) if k else 0, ROWS):
        a = asked[i : i + ROWS]
        best = np.full((len(a), 0), 0, np.int64)
        score = np.zeros((len(a), 0), np.float32)
        for j in range(0, n, 8 * ROWS):
            s = x[a] @ x[j : j + 8 * ROWS].T
            own = (a >= j) & (a < j + s.shape[1])
            s[np.flatnonzero(own), a[own] - j] = -3
            if s.shape[1] > k:
                p = np.argpartition(-s, k - 1, axis=1)[:, :k]
                s = np.take_along_axis(s, p, 1)
            else:
                p = np.broadcast_to(np.arange(s.shape[1]), s.shape)
            best, score = np.concatenate([best, p + j], 1), np.concatenate([score, s], 1)
        if score.shape[1] > k:
            p = np.argpartition(-score, k - 1, axis=1)[:, :k]
            best, score = np.take_along_axis(best, p, 1), np.take_along_axis(score, p, 1)
        r, b, keep = np.repeat(a, best.shape[1]), best.ravel(), score.ravel() > -3
        rows.append(r[keep])
        found.append(b[keep])
        # the cosine of a pair is summed alike in every list
        cosines.append(np.einsum("ij,ij->i", x[r[keep]].astype(np.float64), x[b[keep]].astype(np.float64)))
    none = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(found), np.concatenate(cosines)) if rows else (none, none, np.zeros(0))


def _keys(x: np.ndarray) -> list[bytes]:
    return [xxhash.xxh3_128_digest(r) for r in x]


def _marked(df: DataFrame, dims: int, share: float) -> DataFrame:
    """(spec, id, ts, wanted, vkey, vec): rows that count; ``vec`` only of the vectors that a share of the hashes draws."""
    cut = int(min(1.0, share) * (2**32 - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = unit_rows(b.column(4), dims)
            at, keys = pa.array(rows), _keys(x)
            vec = [v.tobytes() if int.from_bytes(k[:4], "big") <= cut else None for k, v in zip(keys, x)]
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns[:4]), pa.array(keys, pa.binary()), pa.array(vec, pa.binary())], ["spec", "id", "ts", "wanted", "vkey", "vec"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select("spec", "id", "ts", "wanted", "vector").mapInArrow(run, f"spec string, id string, ts {kinds['ts']}, wanted boolean, vkey binary, vec binary")


def _holders(marked: DataFrame) -> DataFrame:
    """(spec, id, vkey, wanted, several): one row per id and specification that counts.

    ``several`` says that the id has different vectors, of which the others are superseded.
    """
    return marked.groupBy("spec", "id").agg(F.max(F.struct("ts", "vkey", "wanted")).alias("m"), (F.min("vkey") != F.max("vkey")).alias("several")).select("spec", "id", "m.vkey", "m.wanted", "several")


def _vectors(df: DataFrame, dims: int) -> DataFrame:
    """(spec, vkey, vec, wanted): different vectors of each task, as bytes.

    ``wanted`` of the first row seen stands for its copies: a copy set is
    searched when any of its rows may be asked for, which the caller settles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b in batches:
            rows, x = unit_rows(b.column(2), dims)
            specs, asked = b.column(0).to_pylist(), b.column(1).to_pylist()
            keep, keys = [], []
            for i, (r, key) in enumerate(zip(rows.tolist(), _keys(x))):
                mark = (specs[r], key, asked[r])
                if mark not in seen:
                    seen.add(mark)
                    keep.append(i)
                    keys.append(key)
            if len(seen) > 500_000:
                seen.clear()
            vec = pa.array([v.tobytes() for v in x[keep]], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([specs[rows[i]] for i in keep], pa.string()), pa.array(keys, pa.binary()), vec, pa.array([asked[rows[i]] for i in keep], pa.bool_())], ["spec", "vkey", "vec", "wanted"]
            )

    return df.select("spec", "wanted", "vector").mapInArrow(run, "spec string, vkey binary, vec binary, wanted boolean")


def _fitted(sample: DataFrame, sizes: DataFrame, dims: int, shape: Shape, last: bool) -> DataFrame:
    """(spec, cell, centroids, groups): balanced centroids of every cell, from its sample; one bounded group a task.

    ``sample`` is (spec, cell, vec), a ``shape.share`` of the vectors; ``sizes``
    is (spec, cell, n).  A cell is divided into lists where that is the
    ``last`` division, else into cells.
    """
    part = shape.size if last else shape.cell

    def run(key: tuple, t: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(v for v in t.column("vec").to_pylist() if v is not None), np.float32).reshape(-1, dims)
        n = t.column("n")[0].as_py()
        c = balanced(np.unique(x, axis=0), n // part if last else -(-n // part)) if len(x) else np.zeros((1, dims), np.float32)
        return pa.table({"spec": [key[0].as_py()], "cell": [key[1].as_py()], "centroids": pa.array([c.tobytes()], pa.binary()), "groups": pa.array([-(-n // shape.group)], pa.int32())})

    # a cell of which nothing was drawn comes with a null vector and has one list
    held = sizes.join(sample, ["spec", "cell"], "left")
    want = F.least(F.lit(float(SAMPLE)), F.greatest(F.lit(2000.0), F.col("n") / F.lit(part) * F.lit(float(PER_LIST))))
    drawn = F.pmod(F.xxhash64("vec", F.lit(5)), F.lit(1_000_000)) < want / (F.col("n") * F.lit(shape.share)) * F.lit(1_000_000)
    held = held.select("spec", "cell", "n", F.when(drawn, F.col("vec")).alias("vec"))
    return held.groupBy("spec", "cell").applyInArrow(run, "spec string, cell string, centroids binary, groups int")


def _few(df: DataFrame) -> DataFrame:
    """Broadcast a small table of cells after counting its rows; leave a large one to Spark."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def _routed(vectors: DataFrame, models: DataFrame, sizes: DataFrame, dims: int, shape: Shape) -> DataFrame:
    """(spec, cell, vkey, vec, wanted) one division further down: each vector once in every list or cell that holds it."""
    groups = F.ceil(F.col("n") / F.lit(shape.group)).cast("int")
    grouped = vectors.join(_few(sizes.select("spec", "cell", groups.alias("groups"))), ["spec", "cell"]).select(
        "spec", "cell", F.pmod(F.xxhash64("vkey"), F.col("groups")).cast("int").alias("part"), "vkey", "vec", "wanted"
    )
    copies = models.select("spec", "cell", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), "centroids")

    def run(key: tuple, t: pa.Table, model: pa.Table) -> pa.Table:
        names = ["spec", "cell", "vkey", "vec", "wanted"]
        kinds = [pa.string(), pa.string(), pa.binary(), pa.binary(), pa.bool_()]
        if not t.num_rows:
            return pa.table({n: pa.array([], k) for n, k in zip(names, kinds)})
        # copies of a vector lie in one group; an asked row must not be lost behind one that isn't
        keep = list(dict(zip(zip(t.column("vkey").to_pylist(), t.column("wanted").to_pylist()), range(t.num_rows))).values())
        t = t.take(pa.array(keep))
        vec = t.column("vec").to_pylist()
        graph = Graph.over(np.frombuffer(model.column("centroids")[0].as_py(), np.float32).reshape(-1, dims))
        rows, at = [], []
        for i in range(0, len(vec), 1024):
            r, k = graph.lists(np.frombuffer(b"".join(vec[i : i + 1024]), np.float32).reshape(-1, dims))
            rows.append(r + i)
            at.append(k)
        src = pa.array(np.concatenate(rows))
        cells = [f"{key[1].as_py()}/{k}" for k in np.concatenate(at).tolist()]
        return pa.table([t.column("spec").take(src), pa.array(cells), *(t.column(c).take(src) for c in names[2:])], names)

    both = grouped.groupBy("spec", "cell", "part").cogroup(copies.groupBy("spec", "cell", "part"))
    return both.applyInArrow(run, "spec string, cell string, vkey binary, vec binary, wanted boolean")


def _postings(vectors: DataFrame, marked: DataFrame, sizes: DataFrame, dims: int, shape: Shape) -> DataFrame:
    """(spec, cell, vkey, vec, wanted): the entries of all lists, after as many divisions as the largest specification needs."""
    spark = vectors.sparkSession
    largest = sizes.agg(F.max("n")).first()[0] or 0
    rows, sample = vectors.withColumn("cell", F.lit("")), marked.where("vec is not null").select("spec", F.lit("").alias("cell"), "vec")
    coarse = largest > shape.cell
    while coarse:
        path = scratch(spark, "cells")
        _routed(rows, _fitted(sample, sizes, dims, shape, False), sizes, dims, shape).write.parquet(path)
        rows = spark.read.parquet(path)
        sizes = rows.groupBy("spec", "cell").agg(F.count(F.lit(1)).alias("n")).checkpoint()
        sample = rows.where(F.pmod(F.xxhash64("vkey", F.lit(3)), F.lit(1_000_000)) < int(shape.share * 1_000_000)).select("spec", "cell", "vec")
        before, largest = largest, sizes.agg(F.max("n")).first()[0]
        # borders are replicated, so cells exceed their plan; one that can't be divided further is left to its lists
        coarse = 4 * shape.cell < largest < 0.9 * before
    return _routed(rows, _fitted(sample, sizes, dims, shape, True), sizes, dims, shape)


def _scan(postings: DataFrame, k: int, dims: int) -> DataFrame:
    """(spec, vkey, near): the k best of each wanted vector within one list."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        keys = np.array(t.column("vkey").to_pylist(), object)
        asked = np.asarray(t.column("wanted").combine_chunks())
        # a vector that came with and without being asked for counts once
        order = np.lexsort((~asked, keys))
        first = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
        pick = np.sort(order[first])
        keys, asked = keys[pick], asked[pick]
        vec = t.column("vec").combine_chunks().take(pa.array(pick))
        x = np.frombuffer(b"".join(vec.to_pylist()), np.float32).reshape(len(pick), dims)
        row, near, cosine = nearest(x, asked, k)
        return pa.table(
            {"spec": pa.array([key[0].as_py()] * len(row), pa.string()), "vkey": pa.array(keys[row].tolist(), pa.binary()), "nkey": pa.array(keys[near].tolist(), pa.binary()), "cosine": pa.array(cosine, pa.float64())}
        )

    return postings.groupBy("spec", "cell").applyInArrow(run, "spec string, vkey binary, nkey binary, cosine double")


def neighbours(
    df: DataFrame, k: int, id_col: str, vector_col: str, dims: int, spec_col: str | None = None, ts_col: str | None = None, queries: str | None = None, shape: Shape = Shape()
) -> DataFrame:
    """(spec, id, neighbour, cosine, rank) of the k nearest of every id, or of those where ``queries`` holds.

    Only vectors of one specification compare, however many there are.  Equal
    cosines rank by id.
    """
    spark = df.sparkSession
    shared_dir(spark)
    ship(spark)
    rows = df.select(
        (F.coalesce(F.col(spec_col), F.lit("")) if spec_col else F.lit("")).alias("spec"),
        F.col(id_col).cast("string").alias("id"),
        (F.col(ts_col) if ts_col else F.lit(0)).alias("ts"),
        (F.coalesce(F.expr(queries), F.lit(False)) if queries else F.lit(True)).alias("wanted"),
        F.col(vector_col).alias("vector"),
    ).where("id is not null")
    total = max(1, df.count())
    marked = _marked(rows, dims, max(shape.share, 2000 / total)).checkpoint()
    holders = _holders(marked.drop("vec")).checkpoint()
    sizes = holders.groupBy("spec").agg(F.count(F.lit(1)).alias("n")).select("spec", F.lit("").alias("cell"), "n").checkpoint()
    vectors = _vectors(rows, dims)
    if holders.where("several").limit(1).count():  # superseded vectors would take places of the k nearest
        vectors = vectors.join(holders.select("spec", "vkey").distinct(), ["spec", "vkey"], "left_semi")
    scanned = _scan(_postings(vectors, marked, sizes, dims, shape), k, dims)
    # at most REPLICAS lists reported each vector, so these arrays are bounded
    near = (
        scanned.groupBy("spec", "vkey", "nkey")
        .agg(F.max("cosine").alias("cosine"))
        .groupBy("spec", "vkey")
        .agg(F.slice(F.sort_array(F.collect_list(F.struct("cosine", "nkey")), False), 1, k).alias("near"))
        .select("spec", "vkey", F.explode("near").alias("n"))
        .select("spec", "vkey", F.col("n.nkey").alias("nkey"), F.col("n.cosine").alias("cosine"))
    )
    w = Window.partitionBy("spec", "vkey").orderBy("id")
    lowest = holders.select("spec", "vkey", "id", F.row_number().over(w).alias("r")).where(F.col("r") <= k + 1)
    named = lowest.groupBy("spec", F.col("vkey").alias("nkey")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    options = near.join(named, ["spec", "nkey"]).select("spec", "vkey", "cosine", F.explode("ids").alias("neighbour"))
    copies = named.where(F.size("ids") > 1).select("spec", F.col("nkey").alias("vkey"), F.lit(1.0).alias("cosine"), F.explode("ids").alias("neighbour"))
    # k + 1 options of each vector suffice for all its holders, as one of them may be the holder itself
    best = options.unionByName(copies).groupBy("spec", "vkey").agg(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "neighbour")).alias("o"))
    best = best.select("spec", "vkey", F.slice(F.array_sort("o"), 1, k + 1).alias("o"))
    asked = holders.where("wanted")
    ranked = asked.join(best, ["spec", "vkey"]).select(
        "spec", "id", F.posexplode(F.slice(F.filter("o", lambda x: x["neighbour"] != F.col("id")), 1, k)).alias("rank", "n")
    )
    return ranked.select("spec", "id", F.col("n.neighbour").alias("neighbour"), (-F.col("n.far")).alias("cosine"), (F.col("rank") + 1).alias("rank"))


def mutual(near: DataFrame, least: float) -> DataFrame:
    """Pairs that are each among the other's neighbours, with cosine of at least ``least``: (a, b), a < b.

    Pairs that are mutual in several specifications count once.
    """
    pairs = near.where(F.col("cosine") >= least).select("spec", F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b"))
    return pairs.groupBy("spec", "a", "b").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("a", "b").distinct()
