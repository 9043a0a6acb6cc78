"""Evaluation texts inside training texts (problem 9).

Greedy string tiling over words.  A running Karp-Rabin hash over ``least``
words of every item gives seeds; documents compute the same running hash and
keep the positions that share a seed with any item.  Each (document, item) with
a shared seed is then tiled: matches grow from the seeds, the longest are
marked first, marked words aren't used again, until none of ``least`` words
remains.  Tiles are compared word by word, so a hash collision can't report.
The share of an item that its tiles cover shows passages that were reordered.

Documents are never compared with each other and their words are never
shuffled before a pair is known: seeds of the items are broadcast as one sorted
array of at most ``BROADCAST_SEEDS`` (8 bytes each); more of them take further
rounds over the documents.

Of seeds that continue each other on a diagonal only the first is kept, so
texts that repeat a few words thousands of times have as many seeds as
diagonals, not as pairs of positions.

Words are runs of letters and digits after HTML character references are
resolved, format characters are removed and NFKC and case folding applied.
Null and empty texts have no words and never match.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir, ship

#: Words of the shortest tile that is a leak by itself, and of the shortest tile that counts for coverage.
LEAST, TILE = 10, 5
#: Share of an item's words that tiles must cover where no tile of ``LEAST`` words exists.
COVERAGE = 0.8
#: Seeds that are broadcast at once; more take further rounds.
BROADCAST_SEEDS = 4_000_000

_WORD = re.compile(r"[^\W_]+").findall
_BASE = np.uint64(0x9E3779B97F4A7C15)


@cache
def _format_characters() -> re.Pattern:
    return re.compile("[" + "".join(re.escape(chr(i)) for i in range(0x110000) if unicodedata.category(chr(i)) == "Cf") + "]")


def words(text: str | None) -> list[str]:
    """The words of a text as they are compared."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _format_characters().sub("", text)
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
        # NFKC can yield format characters and marks apart from their letter; only the former are removed
        return _WORD(text)
    return _WORD(text.lower())


def _code(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


class Codes(dict):
    """64-bit codes of words; emptied when it has grown to ``most``."""

    most = 1 << 18

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        c = self[word] = _code(word)
        return c


def running(codes: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2**64, of all windows of ``width`` words."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = h * _BASE + codes[k : k + n]
        h ^= h >> np.uint64(29)
    return h


def _agreeing(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """How many words from ``a[i]`` and ``b[j]`` on agree."""
    most, k, step = min(len(a) - i, len(b) - j), 0, 64
    while k < most:
        differ = a[i + k : i + min(most, k + step)] != b[j + k : j + min(most, k + step)]
        at = int(differ.argmax())
        if differ[at]:
            return k + at
        k, step = k + step, step * 2
    return most


def starts(ha: np.ndarray, hb: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of positions with equal hashes that don't continue such a pair one position before."""
    _, code = np.unique(np.concatenate((ha, hb)), return_inverse=True)
    ca, cb = code[: len(ha)], code[len(ha) :]

    def by_code(c: np.ndarray, among: np.ndarray) -> dict[int, dict[int, list[int]]]:
        before = np.concatenate(([-1], c[:-1]))
        out: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i in np.flatnonzero(np.isin(c, among)).tolist():
            out[int(c[i])][int(before[i])].append(i)
        return out

    of_a, of_b = by_code(ca, cb), by_code(cb, ca)
    return [(i, j) for h, left in of_a.items() for p, some in left.items() for q, other in of_b[h].items() if p != q or p < 0 for i in some for j in other]


def tiles(a: list[str], b: list[str], least: int, seeds: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Greedy tiling of ``a`` and ``b``: (start in a, start in b, words), longest first.

    ``seeds`` are the pairs of positions whose windows of ``least`` words may
    agree; each maximal match begins at one.
    """
    number: dict[str, int] = {}
    ca, cb = (np.array([number.setdefault(w, len(number)) for w in t], np.int64) for t in (a, b))
    by_size: dict[int, list] = defaultdict(list)
    at, stop = None, -1
    for d, i in sorted((i - j, i) for i, j in seeds):
        if d != at:
            at, stop = d, -1
        if i >= stop:
            k = _agreeing(ca, cb, i, i - d)
            if k >= least:
                by_size[k].append((i, i - d))
            stop = max(stop, i + k - least + 1)
    used_a, used_b, out = np.zeros(len(a) + 1, bool), np.zeros(len(b) + 1, bool), []
    while by_size:
        k = max(by_size)
        for i, j in sorted(by_size.pop(k)):
            # parts that earlier tiles left free
            taken = used_a[i : i + k] | used_b[j : j + k]
            if not taken.any():
                used_a[i : i + k] = used_b[j : j + k] = True
                out.append((i, j, k))
                continue
            edge = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True]))))
            for x, y in zip(edge[0::2].tolist(), edge[1::2].tolist()):
                if y - x >= least:
                    by_size[y - x].append((i + x, j + x))
    return out


def item_words(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, words) of items that have words; items without text never match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([words(t) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], ["item_id", "words"])

    kind = items.schema[item_id].dataType.simpleString()
    return items.select(F.col(item_id).alias("item_id"), text).mapInArrow(run, f"item_id {kind}, words array<string>").where("size(words) > 0")


def item_seeds(worded: DataFrame, width: int) -> DataFrame:
    """Distinct running hashes of all items: (seed)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = Codes()
        for b in batches:
            for w in b["words"]:
                h = running(np.fromiter((codes[x] for x in w), np.uint64, len(w)), width)
                yield pd.DataFrame({"seed": h.view(np.int64)})

    return worded.select("words").mapInPandas(run, "seed bigint").distinct()


def _seeded(docs: DataFrame, doc_id: str, text: str, width: int, among) -> DataFrame:
    """(doc_id, words, seeds) of documents that share a seed with ``among``, a broadcast sorted array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        known = among.value
        for b in batches:
            ids, kept, found = [], [], []
            for i, t in zip(b.column(0), b.column(1).to_pylist()):
                w = words(t)
                if len(w) < width:
                    continue
                h = running(np.fromiter((codes[x] for x in w), np.uint64, len(w)), width).view(np.int64)
                at = np.searchsorted(known, h)
                at[at == len(known)] = 0
                h = h[known[at] == h] if len(known) else h[:0]
                if len(h):
                    ids.append(i.as_py())
                    kept.append(w)
                    found.append(np.unique(h))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, b.column(0).type), pa.array(kept, pa.list_(pa.string())), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "words", "seeds"]
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), text).mapInArrow(run, f"doc_id {kind}, words array<string>, seeds array<bigint>")


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", least: int = LEAST, coverage: float | None = None, tile: int = TILE) -> DataFrame:
    """Documents that hold passages of items: (doc_id, item_id, longest, covered, item_words, tiles).

    Reported is every pair with a tile of at least ``least`` words and, with
    ``coverage``, every pair whose tiles of at least ``tile`` words cover that
    share of the item.  Without ``coverage`` tiles shorter than ``least`` play
    no part.  Repeated ids count once.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    ship(spark)
    width = least if coverage is None else min(tile, least)
    worded = item_words(items, item_id, text).dropDuplicates(["item_id", "words"])
    seeds = item_seeds(worded, width).checkpoint()
    rounds = max(1, -(-seeds.count() // BROADCAST_SEEDS))
    hit = None
    for k in range(rounds):  # documents are read and hashed once a round; one that has seeds of several rounds comes in each
        some = seeds if rounds == 1 else seeds.where(F.pmod(F.xxhash64("seed"), F.lit(rounds)) == k)
        known = spark.sparkContext.broadcast(np.sort(some.toPandas()["seed"].to_numpy(np.int64)))
        found = _seeded(docs, doc_id, text, width, known).checkpoint()
        known.unpersist()
        hit = found if hit is None else hit.unionByName(found)
    # candidate pairs by shared seed; both sides carry their words only once the pair is known
    doc_seeds = hit.select("doc_id", F.xxhash64("words").alias("w"), F.explode("seeds").alias("seed")).distinct()
    by_seed = seed_items(worded, width)
    # A tile of k words holds k - width + 1 windows.  So a pair to be reported shares the windows of one tile of
    # ``least`` words or, as its tiles have ``width`` words at least, one window for each ``width`` words covered.
    due = F.lit(least - width + 1)
    if coverage is not None:
        due = F.least(due, F.ceil(F.col("item_n") * F.lit(coverage / width) - F.lit(1e-9)))
    pairs = (
        doc_seeds.join(by_seed, "seed")
        .groupBy("doc_id", "w", "item_id", "item_w")
        .agg(F.sum("times").alias("shared"), F.max("item_n").alias("item_n"))
        .where(F.col("shared") >= due)
        .select("doc_id", "w", "item_id", "item_w")
    )
    sides = (
        pairs.join(hit.select("doc_id", F.xxhash64("words").alias("w"), F.col("words").alias("a")).dropDuplicates(["doc_id", "w"]), ["doc_id", "w"])
        .join(worded.select("item_id", F.xxhash64("words").alias("item_w"), F.col("words").alias("b")), ["item_id", "item_w"])
        .select("doc_id", "item_id", "a", "b")
    )
    tiled = _tile(sides, width)
    keep = F.col("longest") >= least
    if coverage is not None:
        keep = keep | (F.col("covered") >= F.col("item_words") * F.lit(coverage))
    best = F.max(F.struct("longest", "covered", "item_words", "tiles")).alias("r")
    return tiled.where(keep).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "r.*")


def seed_items(worded: DataFrame, width: int) -> DataFrame:
    """(seed, item_id, item_w, item_n, times): which items hold which seed, how often, and their words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = Codes()
        for b in batches:
            for i, w, x in zip(b["item_id"], b["words"], b["item_w"]):
                h, times = np.unique(running(np.fromiter((codes[y] for y in w), np.uint64, len(w)), width), return_counts=True)
                yield pd.DataFrame({"seed": h.view(np.int64), "item_id": i, "item_w": x, "item_n": len(w), "times": times})

    kind = worded.schema["item_id"].dataType.simpleString()
    return worded.withColumn("item_w", F.xxhash64("words")).mapInPandas(run, f"seed bigint, item_id {kind}, item_w bigint, item_n int, times bigint")


def _tile(sides: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            rows = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                ha, hb = (running(np.fromiter((codes[x] for x in t), np.uint64, len(t)), width) for t in (a, b))
                t = tiles(a, b, width, starts(ha, hb))
                rows.append((t[0][2] if t else 0, sum(x[2] for x in t), len(b), len(t)))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, pa.int32()) for c in cols)], ["doc_id", "item_id", "longest", "covered", "item_words", "tiles"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in sides.schema}
    return sides.mapInArrow(run, f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, longest int, covered int, item_words int, tiles int")
