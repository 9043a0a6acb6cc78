"""Text analyzers of a search index: plain words, and English words with stop words and stems."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

# The usual English stop words of search engines.
ENGLISH_STOP = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
]
# Suffixes of the Porter stemmer, steps 2, 3 and 4.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

_WORD = re.compile(r"[^\W_]+(?:['.:][^\W_]+)*")
_FORM = re.compile(r"(?:[aeiou]|(?<=[^aeiou])y)+")


def plain(text: str | None) -> list[str]:
    """Lower-case words without accents; inner apostrophes stay."""
    if not text:
        return []
    words = _WORD.findall(unicodedata.normalize("NFC", text).replace("\u2019", "'"))
    return [w.lower() if w.isascii() else folded(w.lower()) for w in words]


def folded(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def measure(stem: str) -> int:
    """How often a vowel run is followed by a consonant."""
    return sum(m.end() < len(stem) for m in _FORM.finditer(stem))


def _vowel(stem: str) -> bool:
    return _FORM.search(stem) is not None


def _is_vowel(word: str, i: int) -> bool:
    return word[i] in "aeiou" or (word[i] == "y" and i > 0 and not _is_vowel(word, i - 1))


def _short(stem: str) -> bool:
    """Consonant, vowel, consonant at the end, the last not w, x or y."""
    n = len(stem)
    return n > 2 and stem[-1] not in "wxy" and not _is_vowel(stem, n - 1) and _is_vowel(stem, n - 2) and not _is_vowel(stem, n - 3)


def _swap(word: str, table: dict[str, str]) -> str:
    for size in range(7, 1, -1):
        if (end := word[-size:]) in table and len(word) > size:
            stem = word[:-size]
            return stem + table[end] if measure(stem) > 0 else word
    return word


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """Porter's stem of a lower-case word."""
    if len(word) < 3:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and _vowel(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and word[-1] not in "aeioulsz":
                    word = word[:-1]
                elif measure(word) == 1 and _short(word):
                    word += "e"
                break
    if word.endswith("y") and _vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, STEP2), STEP3)
    for end in sorted(STEP4, key=len, reverse=True):
        if word.endswith(end):
            s = word[: -len(end)]
            if measure(s) > 1 and (end != "ion" or s.endswith(("s", "t"))):
                word = s
            break
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


def english(text: str | None) -> list[str]:
    """Stems of the words of a text without possessive endings and stop words."""
    words = (w[:-2] if w.endswith("'s") else w for w in plain(text))
    return [stem(w) for w in words if w not in _STOP]


_STOP = frozenset(ENGLISH_STOP)
ANALYZERS = {"plain": plain, "english": english}


def analyzed(df: DataFrame, analyzer: str, *fields: str) -> DataFrame:
    """``df`` with the words of each text field in its place; null has none."""
    ship(df.sparkSession)
    f = ANALYZERS[analyzer]
    at = [df.columns.index(c) for c in fields]
    schema = ", ".join(f"`{c}` {'array<string>' if c in fields else t}" for c, t in df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [pa.array([f(t) for t in c.to_pylist()], pa.list_(pa.string())) if i in at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return df.mapInArrow(run, schema)
