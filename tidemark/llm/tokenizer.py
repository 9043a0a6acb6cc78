"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 8).

Pre-tokenisation works on arrays.  Texts of a batch are joined into one array
of code points; a table gives the class of each, and neighbours refine it to a
symbol (is this the last white space of its run, does this apostrophe begin a
contraction).  An automaton over those symbols says where pieces begin.  Its
transition functions form a small monoid, so the state before every character
comes from an associative scan: blocks are folded side by side, block results
are scanned, and prefixes are expanded again.  No pattern matching takes place.

The slices between boundaries are merged by rank, lowest first, with a bounded
cache from piece to ids; long pieces use a heap and are never cached.  Piece
offsets are retained, so ids decode to the text and point into it.

Null and empty texts give an empty list of ids.  Strings that look like special
tokens are ordinary text.  A lone surrogate can't occur in Spark strings.
"""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..session import ship

#: Folder of the public vocabulary files; a parameter of every operator here.
TOKENIZERS = os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces kept in the cache of a worker, and the longest that is kept, in characters.
CACHE_PIECES, CACHE_CHARS = 1 << 18, 48
#: Bytes above which a piece is merged with a heap.
HEAP_BYTES = 96

# symbols of the automaton
LETTER, NUMBER, OTHER, SPACE, LAST_BLANK, LAST_SPACE, SHORT, LONG, RESET = range(9)
# states: a piece has ended; inside letters, numbers, others, white space; after
# a blank that belongs to the next piece; one or two letters of a contraction are due
ENDED, LETTERS, NUMBERS, OTHERS, SPACES, PREFIX, DUE1, DUE2 = range(8)

#: The contractions of the vocabulary's pattern, by their letters.
CONTRACTIONS_1 = "stmd"
CONTRACTIONS_2 = ("re", "ve", "ll")
#: Code points of White_Space.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    return table


def _next_state(state: int, symbol: int) -> int:
    if symbol in (RESET, LAST_SPACE):
        return ENDED
    if symbol == LAST_BLANK:
        return PREFIX
    if symbol == SPACE:
        return SPACES
    if symbol == NUMBER:
        return NUMBERS
    if symbol == LETTER:
        return {DUE2: DUE1, DUE1: ENDED}.get(state, LETTERS)
    if symbol == OTHER or state in (OTHERS, PREFIX):
        return OTHERS
    return DUE1 if symbol == SHORT else DUE2


def _begins(state: int, symbol: int) -> bool:
    """Whether a piece begins at a character read in ``state``."""
    if symbol in (LAST_BLANK, LAST_SPACE):
        return True
    inside = {LETTER: (LETTERS, PREFIX, DUE1, DUE2), NUMBER: (NUMBERS, PREFIX), SPACE: (SPACES,)}
    return state not in inside.get(symbol, (OTHERS, PREFIX))


@cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]:
    """(element of each symbol, product table, element -> state from ENDED, identity, begins[state, symbol])."""
    states = range(8)
    unit = tuple(states)
    gens = [tuple(_next_state(s, x) for s in states) for x in range(9)]
    elements = {unit: 0}
    todo = [unit]
    while todo:
        f = todo.pop()
        for g in gens:
            h = tuple(g[f[s]] for s in states)
            if h not in elements:
                elements[h] = len(elements)
                todo.append(h)
    fs = list(elements)
    product = np.array([[elements[tuple(g[f[s]] for s in states)] for g in fs] for f in fs], np.uint8)
    begins = np.array([[_begins(s, x) for x in range(9)] for s in states])
    return np.array([elements[g] for g in gens], np.uint8), product, np.array([f[ENDED] for f in fs], np.uint8), 0, begins


def scan(elements: np.ndarray, product: np.ndarray, unit: int, width: int = 256) -> np.ndarray:
    """Exclusive prefix products of ``elements``: an associative scan in blocks of ``width``."""
    n = len(elements)
    if n <= width:
        out = np.empty(n, np.uint8)
        acc = unit
        for i, e in enumerate(elements.tolist()):
            out[i] = acc
            acc = product[acc, e]
        return out
    blocks = -(-n // width)
    padded = np.full(blocks * width, unit, np.uint8)
    padded[:n] = elements
    columns = np.ascontiguousarray(padded.reshape(blocks, width).T)
    flat, m = product.ravel(), np.intp(product.shape[1])
    acc = np.full(blocks, unit, np.uint8)
    for c in columns:
        acc = flat[acc * m + c]
    acc = scan(acc, product, unit, width)
    out = np.empty_like(columns)
    for k, c in enumerate(columns):
        out[k] = acc
        acc = flat[acc * m + c]
    return out.T.ravel()[:n]


def boundaries(texts: list[str]) -> list[np.ndarray]:
    """For every text the offsets where its pieces begin, in characters."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    # each text is followed by U+0000 that stands for the end of a document
    points = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = starts[1:] - 1
    kind = classes()[points]
    symbol = kind.copy()
    after = np.append(kind[1:], OTHER).astype(np.uint8)
    end_next = np.zeros(len(points) + 1, bool)
    end_next[ends] = True
    last = (kind == SPACE) & (after != SPACE) & ~end_next[1:]
    symbol[last] = np.where(points[last] == 32, LAST_BLANK, LAST_SPACE)
    quote = np.flatnonzero(points == 39)
    if len(quote):
        p1 = np.append(points, [0, 0])[quote + 1]
        p2 = np.append(points, [0, 0])[quote + 2]
        symbol[quote[np.isin(p1, [ord(c) for c in CONTRACTIONS_1])]] = SHORT
        for a, b in CONTRACTIONS_2:
            symbol[quote[(p1 == ord(a)) & (p2 == ord(b))]] = LONG
    symbol[ends] = RESET
    of_symbol, product, state_of, unit, begins = monoid()
    before = state_of[scan(of_symbol[symbol], product, unit)]
    begin = begins[before, symbol]
    begin[ends] = False
    at = np.flatnonzero(begin)
    cut = np.searchsorted(at, starts)
    return [at[cut[k] : cut[k + 1]] - starts[k] for k in range(len(texts))]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: adjacent parts of the lowest rank merge first, the leftmost of equals."""
    if (r := ranks.get(piece)) is not None:
        return [r]
    if len(piece) > HEAP_BYTES:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [ranks.get(piece[i : i + 2]) for i in range(len(piece) - 1)]
    while True:
        best = min((r for r in pairs if r is not None), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i])
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1])


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap over a linked list, for pieces of any length."""
    n = len(piece)
    ahead, back, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := ahead[i]) >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i], ahead[i] = stop, ahead[j]
        if ahead[i] < n:
            back[ahead[i]] = i
            if (r := ranks.get(piece[i : end[ahead[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[ahead[i]]))
        if (k := back[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


@cache
def load_ranks(folder: str, vocabulary: str) -> dict[bytes, int]:
    with open(f"{folder}/{vocabulary}", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Vocabulary and cache of one worker."""

    def __init__(self, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
        self.ranks = load_ranks(folder, vocabulary)
        self.cache: dict[str, list[int]] = {}

    def piece(self, p: str) -> list[int]:
        ids = merge(p.encode("utf-8", "replace"), self.ranks)
        if len(p) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            self.cache[p] = ids
        return ids

    def encode(self, texts: list[str | None]) -> tuple[list[list[int]], list[np.ndarray]]:
        """(ids, piece offsets) of every text."""
        texts = [t or "" for t in texts]
        known, out, offsets = self.cache, [], boundaries(texts)
        for t, at in zip(texts, offsets):
            cut = at.tolist()
            pieces = [t[a:b] for a, b in zip(cut, [*cut[1:], len(t)])]
            ids: list[int] = []
            for p, got in zip(pieces, map(known.get, pieces)):
                ids += got if got is not None else self.piece(p)
            out.append(ids)
        return out, offsets


@cache
def encoder(folder: str, vocabulary: str) -> Encoder:
    return Encoder(folder, vocabulary)


@cache
def _bytes_of(folder: str, vocabulary: str) -> dict[int, bytes]:
    return {i: b for b, i in load_ranks(folder, vocabulary).items()}


def decode(ids: list[int], folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> str:
    table = _bytes_of(folder, vocabulary)
    return b"".join(table[i] for i in ids).decode("utf-8", "replace")


def _slices(texts: pa.Array, most: int = 1 << 22) -> Iterator[pa.Array]:
    """Parts of at most ``most`` bytes, or one text, so that arrays stay small."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    at, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield texts.slice(at, i - at)
            at, total = i, 0
        total += n
    yield texts.slice(at)


def encode_table(df: DataFrame, id_col: str, text_col: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids) of every row; one narrow pass, no shuffle."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, vocabulary)
        for b in batches:
            at = 0
            for part in _slices(b.column(1)):
                ids, _ = enc.encode(part.to_pylist())
                sizes = np.fromiter(map(len, ids), np.int32, len(ids))
                flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(ids)), pa.ListArray.from_arrays(offsets, flat)], [id_col, "ids"])
                at += len(ids)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def piece_census(df: DataFrame, id_col: str, text_col: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, tokens, pieces, intact) of every row; ``intact`` tells whether ids decode to the text and pieces cover it."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, vocabulary)
        for b in batches:
            at = 0
            for part in _slices(b.column(1)):
                texts = part.to_pylist()
                ids, cuts = enc.encode(texts)
                good = [decode(i, folder, vocabulary) == (t or "") and (not len(c) or c[0] == 0) for i, t, c in zip(ids, texts, cuts)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(ids)), pa.array(map(len, ids), pa.int32()), pa.array(map(len, cuts), pa.int32()), pa.array(good, pa.bool_())],
                    [id_col, "tokens", "pieces", "intact"],
                )
                at += len(ids)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, tokens int, pieces int, intact boolean")
