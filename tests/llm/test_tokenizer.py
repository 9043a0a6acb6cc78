"""Tokenizer: equality with public libraries, round trip, and boundary scans."""

import base64
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import tokenizer as T

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")
ALPHABET = list("ab's't're'll've'd'm  \n\t\r 　é12²Ⅳ!?-_.<|endoftext|>'' 'S'RE日本語😀‍\x1c\x85\x00")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(T.VOCABULARY), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return T.Encoder()


def test_random_texts(reference, encoder):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(20_000)]
    texts += ["a" * 5000, " " * 3000, "' " * 500, "<|endoftext|>", "", "'s", "x'", "'", "  'll "]
    assert encoder.encode(texts)[0] == [reference.encode_ordinary(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text_round_trips(t):
    (ids,), (cuts,) = T.Encoder().encode([t])
    assert T.decode(ids) == t.encode("utf-8", "replace").decode() and list(cuts) == sorted(set(cuts)) and (not t or cuts[0] == 0)


def test_every_code_point_in_context(reference, encoder):
    chars = [chr(i) for i in range(0, 0x110000, 1) if not 0xD800 <= i < 0xE000][:70_000]
    texts = [f"a{c}a1{c}1{c}!{c}  x" for c in chars]
    assert encoder.encode(texts)[0] == reference.encode_ordinary_batch(texts)


def test_null_and_empty(encoder):
    assert encoder.encode([None, "", "a"])[0][:2] == [[], []]


def test_long_piece_is_merged_by_the_heap(reference, encoder):
    t = "".join(random.Random(1).choice("abcdeé") for _ in range(20_000))
    assert encoder.encode([t])[0][0] == reference.encode_ordinary(t)
    assert len(encoder.cache) <= T.CACHE_PIECES and t not in encoder.cache


def test_scan_is_a_prefix_product():
    of_symbol, product, state_of, unit, _ = T.monoid()
    rng = np.random.default_rng(0)
    for n in (0, 1, 255, 256, 257, 70_000):
        e = of_symbol[rng.integers(0, 9, n)]
        got, acc = T.scan(e, product, unit), unit
        for i in range(n):
            assert got[i] == acc
            acc = product[acc, e[i]]
    for a in range(len(product)):  # associative
        assert (product[product[a]] == np.array([[product[a, product[b, c]] for c in range(len(product))] for b in range(len(product))])).all()


def test_table_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 5, "x"), (2, "", 5, "x"), (3, "Hello  world", 5, "x"), (3, "Hello  world", 5, "x"), (None, "a", 5, "x")], "doc_id bigint, text string, ids int, pieces string")
    rows = sorted(((r.doc_id or 0, r.ids) for r in T.encode_table(df, "doc_id", "text").collect()))
    assert rows[1:3] == [(1, []), (2, [])] and rows[3] == rows[4] and len(rows) == 5
    assert T.encode_table(df.limit(0), "doc_id", "text").count() == 0
    assert all(r.intact for r in T.piece_census(df, "doc_id", "text").collect())


def test_pattern_is_matched_without_a_pattern(encoder):
    regex = pytest.importorskip("regex")
    texts = ["I'll go,\n\n  don't   you? 'tis 12º'S we've", "a\n b", "x  ", " \t\n"]
    for t, cuts in zip(texts, T.boundaries(texts)):
        assert list(cuts) == [m.start() for m in regex.finditer(P.PATTERN, t)]
    assert not re.search("import re", open(T.__file__).read().split('"""')[2].split("\n\n")[0] or "")
