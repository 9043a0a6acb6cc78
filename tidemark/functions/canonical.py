"""Canonical encodings, stable draws and text measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import outer_trim

# White space that separates words, as code point ranges of a Java character class.
WORD_SPACE = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def field_bytes(c: Column) -> Column:
    """Length (4 bytes, big-endian) and UTF-8 bytes of a text; four bytes FF for null."""
    size = F.unhex(F.lpad(F.hex(F.octet_length(c)), 8, "0"))
    return F.coalesce(F.concat(size, F.encode(c, "UTF-8")), F.unhex(F.lit("FFFFFFFF")))


def digest_of(*fields: Column) -> Column:
    """SHA-256 of the encoded fields in order; null and empty differ."""
    return F.sha2(F.concat(*(field_bytes(c) for c in fields)), 256)


def review_key(user: Column, product: Column, ms: Column) -> Column:
    return digest_of(outer_trim(user), outer_trim(product), ms.cast("string"))


def image_json(images: Column) -> Column:
    """JSON of an image array with keys in order and nulls left out; null for null."""
    keys = ("attachment_type", "large_image_url", "medium_image_url", "small_image_url")
    return F.to_json(F.transform(images, lambda x: F.struct(*(x[k].alias(k) for k in keys))))


def content_hash(rating: Column, title: Column, text: Column, verified: Column, votes: Column, asin: Column, images: Column) -> Column:
    """Hash of the seven retained fields of a review."""
    whole = lambda c: c.cast("int").cast("string")
    return digest_of(whole(rating), title, text, verified.cast("string"), whole(votes), outer_trim(asin), images)


def word_count(text: Column) -> Column:
    """Words between Unicode white space; 0 for null and blank."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), f"[{WORD_SPACE}]+"), lambda w: w != ""))


def draw_key(identifier: Column, seed: int, salt: str) -> Column:
    """A stable number in [0, 1) for one row in one named draw: 64 bits of a hash over 2**64."""
    h = F.sha2(F.concat_ws("\u001f", F.lit(str(seed)), F.lit(salt), identifier), 256)
    return F.conv(F.substring(h, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def tuple_key(*fields: Column) -> Column:
    """SHA-256 of ``length:value`` of each field; identifies a request whatever its values hold."""
    part = lambda c: F.concat(F.length(F.coalesce(c, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(c, F.lit("")))
    return F.sha2(F.concat(*(part(c) for c in fields)), 256)


def prepared(title: Column, text: Column) -> Column:
    """Title and text as one line for an encoder: ``title. text``, white space collapsed."""
    squeeze = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{WORD_SPACE}]+", " "))
    t, b = squeeze(title), squeeze(text)
    return F.when(t == "", b).when(b == "", t).otherwise(F.concat(t, F.lit(". "), b))


def quotes(quote: Column, *sources: Column) -> Column:
    """Whether a quote stands in any source, ignoring case and the kind of white space; false for a blank one."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"[{WORD_SPACE}]+", " "))
    q = plain(quote)
    found = F.lit(False)
    for s in sources:
        found = found | F.contains(plain(s), q)
    return (q != "") & found


def tokens(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits, with an inner apostrophe ending."""
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("’"), F.lit("'")))
    return F.regexp_extract_all(plain, F.lit("[a-z0-9]+(?:'[a-z]+)?"), F.lit(0))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; (0, 1) where nothing was observed."""
    p = F.try_divide(hits, n)
    d = 1 + F.lit(z * z) / n
    mid = (p + F.lit(z * z / 2) / n) / d
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z / 4) / (n * n)) / d
    some = n > 0
    return F.when(some, F.greatest(mid - half, F.lit(0.0))).otherwise(0.0), F.when(some, F.least(mid + half, F.lit(1.0))).otherwise(1.0)


def kappa(both: Column, first: Column, second: Column, n: Column) -> Column:
    """Cohen's kappa of two binary raters; null where chance agreement is total or n is 0."""
    agree = F.try_divide(n - first - second + 2 * both, n)
    a, b = F.try_divide(first, n), F.try_divide(second, n)
    chance = a * b + (1 - a) * (1 - b)
    return F.when((n > 0) & (chance < 1), F.try_divide(agree - chance, 1 - chance))
