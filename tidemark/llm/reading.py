"""Reading level of documents (problem 10).

Every sentence is classified by two L2-regularised softmax models, one over
hashed character 4-grams and one over hashed words and word pairs; their
log-probabilities are averaged.  Sentence distributions, weighted by length,
give a document's profile, and a third, small model calibrates profiles to
document levels.  It is fitted on profiles of documents that the sentence
models hadn't seen (two folds).  A model of the same kind tells the language,
so that the ``lang`` column, which is often wrong, only serves as a noisy label.

Fitting uses bounded samples (``LABELLED`` rated documents, ``PER_LANGUAGE``
documents of each language class, none longer than ``FIT_CHARS``), chosen by the
hash of doc_id; as many rated documents again stand for English.  A language has
a class of its own if ``SHARE`` of the documents name it; all rarer ones
together are one class, so every language has one.  Every document is
classified, whole.  Weights are broadcast; their size is fixed by ``BUCKETS``
and the number of classes.

A document rated several times trains with the share of each level; repeated
rows count once, null levels not at all.  Null, empty and blank texts have no
sentences and get null level and language.  Without usable ratings every level
is null.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

LEVELS = 4
#: Rated documents, documents per language class, and characters of a document used for fitting, at most.
LABELLED, PER_LANGUAGE, FIT_CHARS = 3000, 300, 20_000
#: Share of the documents with a language that makes a class of its own; 1 / SHARE classes at most.
SHARE = 0.005
#: Feature buckets of each sentence model.
BUCKETS = 1 << 16
#: Weight of the L2 penalty, steps of the fit, sentences of a step about, and steps that see every sentence once at most.
PENALTY, STEPS, TURN, PARTS = 2e-4, 72, 2000, 8

_TAG = re.compile(r"<[^<>]{1,300}>")
_LINE = re.compile(r"[ \t]*\n[ \t]*(?:[>#*+\-•][>#*+\- \t]*)?")
_END = re.compile(r"(?<=[.!?])[\"')\]”’*_]*\s+|(?<=[。！？])")
_SPACES = re.compile(r"\s+")


def sentences(text: str | None) -> list[str]:
    """Lower-case sentences of a text without markup; none of a blank text."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = _LINE.sub(" ", text.replace("\r", "\n")).lower()
    return [s for x in _END.split(text) if (s := _SPACES.sub(" ", x).strip())]


@dataclass
class Features:
    """Bucket of each feature, segment starts and sizes of each sentence."""

    bucket: np.ndarray
    start: np.ndarray
    count: np.ndarray


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32)


def features(sents: list[str]) -> tuple[Features, Features]:
    """Character and word features of sentences, without a loop over characters or words.

    A feature that would cross sentences falls into a last bucket of weight 0.
    """
    joined = "".join(f" {s} " for s in sents)
    p = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(s) + 2 for s in sents), np.int64, len(sents))
    start = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
    digit = (p >= 48) & (p <= 57)
    p[digit] = 48
    n = len(p)
    padded = np.concatenate((p, np.zeros(3, np.uint64)))
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(4):
            h = h * np.uint64(0x100000001B3) + padded[k : k + n]
        chars = _mix(h)
        ends = start + size
        room = np.repeat(ends, size) - np.arange(n)
        chars[room < 4] = BUCKETS
        inside = (p > 127) | ((p >= 97) & (p <= 122)) | (p == 48) | (p == 39)
        first = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        powers = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
        if len(first):
            lead = first[0]
            rel = np.arange(n - lead) - np.repeat(first - lead, np.diff(np.append(first, n)))
            value = np.where(inside[lead:], p[lead:] * powers[rel % 64], np.uint64(0))
            word = np.add.reduceat(value, first - lead)
        else:
            word = np.zeros(0, np.uint64)
        of = np.searchsorted(ends, first, side="right")
        pair = np.zeros(len(word), np.uint64)
        if len(word) > 1:
            pair[:-1] = word[:-1] * np.uint64(0xD6E8FEB86659FD93) + word[1:]
        pair_b = _mix(pair)
        if len(word):
            pair_b[np.append(of[1:] != of[:-1], True)] = BUCKETS
    both = np.empty(2 * len(word), np.int32)
    both[0::2], both[1::2] = _mix(word), pair_b
    per = np.bincount(of, minlength=len(sents)) * 2
    return Features(chars, start, np.maximum(size - 3, 1)), Features(both, np.concatenate(([0], np.cumsum(per)[:-1])).astype(np.int64), per)


def _sums(weights: np.ndarray, f: Features) -> np.ndarray:
    """Summed weights of each sentence, divided by the root of its feature count."""
    rows = np.zeros((len(f.count), weights.shape[1]), np.float32)
    some = f.count > 0
    if some.any():
        step = 1 << 20  # bounded memory whatever the length of a text
        if len(f.bucket) <= step:
            rows[some] = np.add.reduceat(weights[f.bucket], f.start[some], axis=0)
        else:
            owner = np.repeat(np.arange(len(f.count)), np.diff(np.append(f.start, len(f.bucket))))
            for a in range(0, len(f.bucket), step):
                w, o = weights[f.bucket[a : a + step]], owner[a : a + step]
                for c in range(weights.shape[1]):
                    rows[:, c] += np.bincount(o, weights=w[:, c], minlength=len(rows)).astype(np.float32)
    return rows / np.sqrt(np.maximum(f.count, 1))[:, None].astype(np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Linear:
    """Softmax model over hashed features: (BUCKETS + 1) x classes, the last row stays 0."""

    weights: np.ndarray
    bias: np.ndarray

    def log_p(self, f: Features) -> np.ndarray:
        return np.log(softmax(_sums(self.weights, f) + self.bias) + 1e-9)


def _part(f: Features, rows: np.ndarray) -> Features:
    """The features of some sentences."""
    size = np.diff(np.append(f.start, len(f.bucket)))[rows]
    start = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
    at = np.arange(size.sum()) - np.repeat(start, size) + np.repeat(f.start[rows], size)
    return Features(f.bucket[at], start, f.count[rows])


def fit(f: Features, target: np.ndarray, weight: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> Linear:
    """Adam on weighted cross-entropy with an L2 penalty; each step sees one of up to ``PARTS`` drawn parts of the sentences."""
    classes = target.shape[1]
    w = np.zeros((BUCKETS + 1, classes), np.float32)
    b = np.log(np.maximum((target * weight[:, None]).sum(0) / weight.sum(), 1e-4)).astype(np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    drawn = np.random.default_rng(len(target)).permutation(len(target))
    parts = []
    for rows in np.array_split(drawn, max(1, min(PARTS, len(target) // TURN))):
        p = _part(f, rows)
        owner = np.repeat(np.arange(len(rows)), np.diff(np.append(p.start, len(p.bucket))))
        parts.append((p, target[rows], (weight[rows] / weight[rows].sum())[:, None], np.sqrt(np.maximum(p.count, 1)), owner))
    for t in range(1, steps + 1):
        p, goal, share, root, owner = parts[t % len(parts)]
        err = (softmax(_sums(w, p) + b) - goal) * share
        scaled = (err / root[:, None])[owner]
        g = np.stack([np.bincount(p.bucket, weights=scaled[:, c], minlength=BUCKETS + 1) for c in range(classes)], 1).astype(np.float32)
        g += penalty * w / max(1, classes)
        g[BUCKETS] = 0
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        b -= 0.5 * err.sum(0).astype(np.float32)
    return Linear(w, b)


def fit_small(x: np.ndarray, target: np.ndarray, penalty: float = 1e-3, steps: int = 600) -> np.ndarray:
    """Softmax regression on few dense columns, the last of which is 1."""
    w = np.zeros((x.shape[1], target.shape[1]))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = x.T @ (softmax(x @ w) - target) / len(x) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def profile(log_p: np.ndarray, owner: np.ndarray, size: np.ndarray, docs: int) -> np.ndarray:
    """Columns of each document: its mean sentence distribution by length and by number, their logs, and 1."""
    p = softmax(log_p)
    by_size = np.stack([np.bincount(owner, weights=p[:, c] * size, minlength=docs) for c in range(p.shape[1])], 1)
    by_size /= np.maximum(np.bincount(owner, weights=size, minlength=docs), 1)[:, None]
    by_count = np.stack([np.bincount(owner, weights=p[:, c], minlength=docs) for c in range(p.shape[1])], 1)
    by_count /= np.maximum(np.bincount(owner, minlength=docs), 1)[:, None]
    return np.hstack([by_size, by_count, np.log(by_size + 0.02), np.log(by_count + 0.02), np.ones((docs, 1))])


@dataclass
class Model:
    chars: Linear | None
    words: Linear | None
    calibration: np.ndarray | None
    language: Linear | None
    english: int | None

    def classify(self, texts: list[str | None]) -> tuple[list, list, list]:
        """Level, level probabilities and share of English against its likeliest rival, of each text; null where undefined."""
        level, probs, english = [None] * len(texts), [None] * len(texts), [None] * len(texts)
        different, which, owner, size = _split(texts)
        if not different:
            return level, probs, english
        fc, fw = features(different)
        has = np.unique(owner).tolist()
        if self.language is not None:
            p = np.exp(self.language.log_p(fc))[which] * size[:, None]
            share = np.stack([np.bincount(owner, weights=p[:, c], minlength=len(texts)) for c in range(p.shape[1])], 1)
            own = share[:, self.english].copy()
            share[:, self.english] = 0
            rival = share.max(1)
            for i in has:
                english[i] = float(own[i] / max(own[i] + rival[i], 1e-9))
        elif self.english is not None:  # no rival language
            for i in has:
                english[i] = 1.0
        if self.chars is not None:
            log_p = (self.chars.log_p(fc) + self.words.log_p(fw))[which]
            got = softmax(profile(log_p, owner, size, len(texts)) @ self.calibration)
            for i in has:
                probs[i] = got[i].tolist()
                level[i] = int(got[i].argmax()) + 1
        return level, probs, english


def _split(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(different sentences, which of them stand in order, the document of each, its size)."""
    split = [sentences(t) for t in texts]
    seen: dict[str, int] = {}
    which = np.fromiter((seen.setdefault(s, len(seen)) for d in split for s in d), np.int64)
    owner = np.repeat(np.arange(len(split)), [len(d) for d in split])
    different = list(seen)
    return different, which, owner, np.fromiter(map(len, different), np.float64, len(different))[which] if different else np.zeros(0)


def _pooled(which: np.ndarray, size: np.ndarray, target: np.ndarray, different: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean target and weight of each different sentence; every occurrence weighs as the root of its size."""
    w = np.sqrt(size)
    weight = np.bincount(which, weights=w, minlength=different)
    mean = np.stack([np.bincount(which, weights=w * target[:, c], minlength=different) for c in range(target.shape[1])], 1)
    return mean / np.maximum(weight, 1e-12)[:, None], weight


def fit_levels(texts: list[str], target: np.ndarray) -> tuple[Linear, Linear, np.ndarray]:
    """Sentence models on all documents; calibration on profiles from two folds."""
    different, which, owner, size = _split(texts)
    fc, fw = features(different)

    def both(docs: np.ndarray) -> tuple[Linear, Linear]:
        mine = docs[owner]  # sentences of these documents
        pooled, weight = _pooled(which[mine], size[mine], target[owner[mine]], len(different))
        rows = np.flatnonzero(weight > 0)
        return tuple(fit(_part(f, rows), pooled[rows], weight[rows]) for f in (fc, fw))

    def profiles(models: tuple[Linear, Linear], docs: np.ndarray) -> np.ndarray:
        mine = docs[owner]
        place = np.cumsum(docs) - 1
        return profile((models[0].log_p(fc) + models[1].log_p(fw))[which[mine]], place[owner[mine]], size[mine], int(docs.sum()))

    every = np.ones(len(texts), bool)
    fold = np.zeros(len(texts), bool)
    fold[np.random.default_rng(len(texts)).permutation(len(texts))[0::2]] = True  # a pattern in the order of rows must not split the levels
    x = np.zeros((len(texts), 4 * LEVELS + 1))
    for a, b in ((fold, ~fold), (~fold, fold)):
        if a.any() and b.any():
            x[b] = profiles(both(a), b)
    chars, words = both(every)
    return chars, words, fit_small(x, target)


def fit_language(texts: list[str], which: np.ndarray, classes: int) -> Linear | None:
    """Fitted twice: documents that the first fit finds in another language change their noisy label."""
    different, order_of, owner, size = _split(texts)
    if not different:
        return None
    f = features(different)[0]
    for last in (False, True):
        model = fit(f, *_pooled(order_of, size, np.eye(classes)[which][owner], len(different)))
        if last:
            return model
        p = np.exp(model.log_p(f))[order_of] * size[:, None]
        share = np.stack([np.bincount(owner, weights=p[:, c], minlength=len(texts)) for c in range(classes)], 1)
        which = np.where(share.any(1), share.argmax(1), which)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded samples, which one scan of the texts collects to the driver.

    Rated documents are English even where no ``lang`` says so.  Without another
    language every document counts as English.
    """
    named = F.substring(F.lower(F.trim("lang")), 1, 2)
    counts = docs.select(named.alias("lang")).where("lang <> ''").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    every = counts.agg(F.sum("n")).scalar()
    own = (F.col("n") >= SHARE * every) | (F.col("lang") == "en")
    # rarer languages together are the class "*"
    found = counts.groupBy(F.when(own, F.col("lang")).otherwise("*").alias("lang")).agg(F.sum("n").alias("n")).orderBy("lang").collect()
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    rated = (
        labels.where("level between 1 and 4 and doc_id is not null")
        .select("doc_id", "rater", "level")
        .distinct()
        .groupBy("doc_id")
        .agg(*(F.sum((F.col("level") == k).cast("double")).alias(f"n{k}") for k in range(1, LEVELS + 1)))
        .orderBy(order, "doc_id")
        .limit(LABELLED)
    )
    # a threshold on the hash leaves about four times PER_LANGUAGE documents of each class, so that ranks move few texts
    drawn = F.pmod(order, F.lit(2**32))
    cut = F.coalesce(*(F.when(F.col("lang") == r.lang, F.lit(int(min(1.0, 4 * PER_LANGUAGE / r.n) * 2**32))) for r in found), F.lit(0))
    kept = [r.lang for r in found]
    rare = F.when(named == "", F.lit(None)).when(named.isin(kept), named).when(named.isNotNull(), F.lit("*"))
    texts = docs.where(F.length("text").between(1, FIT_CHARS)).select("doc_id", "text", rare.alias("lang"), drawn.alias("drawn"))
    picked = texts.join(F.broadcast(rated), "doc_id", "left").where((F.col("drawn") < cut) | F.col("n1").isNotNull())  # at most LABELLED rows
    rank = F.row_number().over(Window.partitionBy("lang", F.col("drawn") < cut).orderBy("drawn", "doc_id"))
    picked = picked.withColumn("rank", F.when(F.col("drawn") < cut, rank)).where((F.col("rank") <= PER_LANGUAGE) | F.col("n1").isNotNull()).collect()
    rows = sorted((r for r in picked if r.n1 is not None and sentences(r.text)), key=lambda r: r.doc_id)
    sample = sorted((r for r in picked if r.lang is not None and r["rank"] is not None and r["rank"] <= PER_LANGUAGE), key=lambda r: (r.lang, r.drawn, r.doc_id))
    common = sorted({r.lang for r in sample} | ({"en"} if rows else set()))
    texts = [r.text for r in sample]
    which = [common.index(r.lang) for r in sample]
    if "en" in common:  # rated documents are English: some of each level show the language's whole range
        for k in range(1, LEVELS + 1):
            some = [r.text for r in rows if r[f"n{k}"] >= max(r[f"n{j}"] for j in range(1, LEVELS + 1))][: PER_LANGUAGE // LEVELS]
            texts += some
            which += [common.index("en")] * len(some)
    language = None
    if "en" in common and len(common) > 1:
        language = fit_language(texts, np.array(which), len(common))
    english = common.index("en") if "en" in common else None if common else 0
    if not rows:
        return Model(None, None, None, language, english)
    target = np.array([[r[f"n{k}"] for k in range(1, LEVELS + 1)] for r in rows])
    chars, words, calibration = fit_levels([r.text for r in rows], target / target.sum(1, keepdims=True))
    return Model(chars, words, calibration, language, english)


def levels(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, level, english, p1..p4) of every document; ``english`` is its odds against the likeliest other language, as a share."""
    ship(docs.sparkSession)
    model = model or train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                level, probs, english = shared.value.classify(part.column(1).to_pylist())
                cols = [pa.array([None if p is None else p[k] for p in probs], pa.float64()) for k in range(LEVELS)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(level, pa.int32()), pa.array(english, pa.float64()), *cols], ["doc_id", "level", "english", "p1", "p2", "p3", "p4"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, level int, english double, p1 double, p2 double, p3 double, p4 double")


def demanding(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """English documents of the highest level: (doc_id)."""
    return levels(docs, labels).where(f"level = {LEVELS} and english >= 0.5").select("doc_id")
