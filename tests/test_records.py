"""The record grammar: what fails, why, and what is recovered."""

import json
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators import records as R

GOOD = {"rating": 5.0, "title": "t", "text": "x", "images": [], "asin": "A", "parent_asin": "P", "user_id": "U", "timestamp": 1600000000000, "helpful_vote": 0, "verified_purchase": True}


def made(**change):
    return json.dumps({k: v for k, v in (GOOD | change).items() if v is not ...})


@pytest.mark.parametrize(
    "payload, reason",
    [
        (made(), None),
        (None, "unparsable_json"),
        ("", "unparsable_json"),
        (" \t\n", "unparsable_json"),
        ("null", "unparsable_json"),
        ("[" + made() + "]", "unparsable_json"),
        (made() + made(), "unparsable_json"),
        (made() + " trailing", "unparsable_json"),
        (made()[:-1], "unparsable_json"),
        (made()[1:], "unparsable_json"),
        (made().replace('"', "'"), "unparsable_json"),
        (made(text="tab\there").replace("\\t", "\t"), "unparsable_json"),
        (made().replace("true", "undefined"), "unparsable_json"),
        (made().replace("5.0", "05"), "unparsable_json"),
        (made().replace("5.0", "NaN"), "unparsable_json"),
        ("﻿" + made(), "unparsable_json"),
        (made(images={"a": 1}), "unparsable_json"),
        (made(images="[]"), "unparsable_json"),
        (made(images=[1]), "unparsable_json"),
        (made(images=None), None),
        (made(images=...), None),
        (made(images=[{"small_image_url": "s", "more": [[{"deep": [1, {}]}]]}]), None),
        (made(user_id=...), "missing_key_field"),
        (made(user_id="  "), "missing_key_field"),
        (made(parent_asin=None), "missing_key_field"),
        (made(timestamp="  "), "missing_key_field"),
        (made(user_id=" ", rating=9), "missing_key_field"),
        (made(rating=None), "invalid_rating"),
        (made(rating=True), "invalid_rating"),
        (made(rating="4"), None),
        (made(rating="4.0"), None),
        (made(rating=4), None),
        (made(rating="4,0"), "invalid_rating"),
        (made(rating=4.5), "invalid_rating"),
        (made(rating=0, timestamp="x"), "invalid_rating"),
        (made().replace("5.0", "1e999"), "invalid_rating"),
        (made(timestamp="1600000000000"), None),
        (made(timestamp=1600000000000.0), "timestamp_out_of_range"),
        (made(timestamp="12.5"), "timestamp_out_of_range"),
        (made(timestamp=788918400000), None),
        (made(timestamp=788918399999), "timestamp_out_of_range"),
        (made(timestamp=-5), "timestamp_out_of_range"),
    ],
)
def test_reasons(payload, reason):
    assert R.judge(payload)[0] == reason


def test_deep_nesting_and_long_text():
    deep = "[" * 200_000 + "]" * 200_000
    assert R.judge(made(text="y" * 3_000_000).replace('"images": []', f'"more": {deep}'))[0] is None
    assert R.judge("[" * 100_000)[0] == "unparsable_json"


def test_recovers_records_behind_a_broken_quote():
    found, faults = R.records('{"title: "x", "rating": 1}' + made() + made(title="z"))
    assert [r["title"] for r in found] == ["t", "z"] and len(faults) == 1 and faults[0].at < 12


def test_a_nested_object_is_no_record():
    found, _ = R.records('{"rating": 1, "images": [{"url": "u"}], "title" "x"}')
    assert found == []


values = st.recursive(
    st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(),
    lambda v: st.lists(v, max_size=4) | st.dictionaries(st.text(max_size=5), v, max_size=4),
    max_leaves=20,
)


def plain(v):
    if isinstance(v, R.Number):
        return json.loads(v)
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return [plain(x) for x in v] if isinstance(v, list) else v


@settings(max_examples=300, deadline=None)
@given(values, st.booleans())
def test_agrees_with_a_plain_parser(v, ascii_only):
    s = json.dumps(v, ensure_ascii=ascii_only)
    found, faults = R.records(f" {s}\n")
    assert not faults and [plain(x) for x in found] == [json.loads(s)]


@settings(max_examples=300, deadline=None)
@given(values, st.integers(0, 60), st.sampled_from('{}[]",:\\x0 -.eE'))
def test_damage_is_noticed_as_a_strict_parser_does(v, at, put):
    s = json.dumps(v)
    s = s[:at] + put + s[at + 1 :]
    try:
        json.loads(s, parse_constant=lambda c: 1 / 0)
        good = True
    except (ValueError, ZeroDivisionError):
        good = False
    assert (not R.records(s)[1]) == good


def test_messages_once_each_against_their_earliest_arrival(spark):
    late, early = datetime(2020, 9, 13, 12, 26, 41), datetime(2020, 9, 13, 12, 26, 39)
    rows = [(1, 1, made(), late, "clash"), (1, 1, made(), early, "clash"), (1, 2, made(), late, "x"), (1, 3, None, late, "x"), (1, 3, None, early, "x"), (None, None, "{", late, "x")]
    df = spark.createDataFrame(rows, "kafka_partition int, kafka_offset bigint, payload string, ingested_at timestamp_ntz, reason string")
    got = {(r.kafka_partition, r.kafka_offset): r.reject_reason for r in R.failing(df, df.limit(0)).collect()}
    assert got == {(1, 1): "timestamp_out_of_range", (1, 3): "unparsable_json", (None, None): "unparsable_json"}
    assert R.failing(df.limit(0)).count() == 0


def test_load_gives_typed_rows(spark):
    df = spark.createDataFrame([(7, 1, 1, made(helpful_vote="3", user_id=" U "), datetime(2024, 1, 1)), (8, 1, 2, "{", datetime(2024, 1, 1))], "delivery_id bigint, kafka_partition int, kafka_offset bigint, payload string, ingested_at timestamp_ntz")
    (r,) = R.load(df).collect()
    assert (r.delivery_id, r.user_id, r.rating, r.helpful_vote, r.verified_purchase, r.image_count) == (7, "U", 5, 3, True, 0)
    assert r.event_ts == datetime(2020, 9, 13, 12, 26, 40)


def test_every_message_is_either_found_or_loaded(spark):
    early, late = datetime(2020, 9, 13, 12, 26, 39), datetime(2020, 9, 13, 12, 26, 41)
    schema = "kafka_partition int, kafka_offset bigint, payload string, ingested_at timestamp_ntz"
    bronze = [(1, 1, 1, made(), late), (2, 1, 1, made(), early), (3, 1, 2, made(), late), (4, 1, 3, made(), None), (5, 1, 4, "{", late), (6, 1, 5, made(), late), (7, 1, 5, "{", late), (8, None, 6, made(), late)]
    b = spark.createDataFrame(bronze, "delivery_id bigint, " + schema)
    r = spark.createDataFrame([(2, 1, made(), late), (2, 1, made(), late), (2, 2, None, late), (2, 3, made(), early)], schema)
    found = {(x.kafka_partition, x.kafka_offset) for x in R.failing(b.drop("delivery_id"), r).collect()}
    loaded = sorted((x.kafka_partition or 0, x.kafka_offset, x.delivery_id or 0) for x in R.load(b, r).collect())
    assert found == {(1, 1), (1, 4), (1, 5), (2, 2), (2, 3)}
    assert loaded == [(0, 6, 8), (1, 2, 3), (1, 3, 4), (2, 1, 0), (2, 1, 0)]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_found_and_loaded_split_the_messages_of_both_tables(spark, sf):
    from tidemark.plans.pipeline_problems import QUERIES
    from tidemark.sources.tables import table

    d, key = f"/root/testdata/{sf}", ["kafka_partition", "kafka_offset"]
    found, loaded = ([tuple(x) for x in QUERIES[q](spark, d).select(*key).distinct().collect()] for q in ("p5_found", "p5_loaded"))
    every = table(spark, d, "bronze_reviews").select(*key).unionByName(table(spark, d, "silver_rejects").select(*key)).distinct().collect()
    assert sorted(found + loaded, key=str) == sorted((tuple(x) for x in every), key=str)


def test_other_columns_pass_and_clashing_ones_give_way(spark):
    df = spark.createDataFrame([("{", 1, "mine", "keep")], "payload string, ts_ms int, reason string, _payload string")
    r = R.parse(df).first()
    assert (r.reason, r.ts_ms, r["_payload"]) == ("unparsable_json", None, "keep")


def test_recovery_is_linear_in_the_payload():
    import time

    for text in ('x' + '{"a":' * 120_000 + "1" + "}" * 120_000, 'x' + '{"a":[' * 80_000, 'x{"a":"' * 100_000, '{"rating: 1}' * 60_000):
        began = time.perf_counter()
        assert R.judge(text)[0] == "unparsable_json"
        assert time.perf_counter() - began < 2.0


def test_records_inside_a_value_are_recovered_once():
    faults, found, _ = R.located('x {"a": [{"rating": 1, "images": [{"title": "no record by itself"}]}, {"b": {"title": "t"}}]} {"c": 1} {"rating": 2}')
    assert [r.get("rating") for r in found] == ["1", None, "2"] and len(faults) == 1


ROWS = "delivery_id bigint, kafka_partition int, kafka_offset bigint, payload string, ingested_at timestamp_ntz, at int, reason string"


def test_faults_and_recovered_records(spark):
    t = datetime(2021, 1, 1)
    broken = '{"title: "x"}' + made(title="saved") + made(rating=9) + "{"
    rows = [(1, 0, 1, broken, t), (2, 0, 1, broken, t), (3, 0, 2, made(), t), (4, 0, 3, made(rating=None), t), (5, None, None, None, None)]
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], ROWS)
    got = sorted((r.kafka_offset or 0, r.fault_no, r.expected) for r in R.faults(df).collect())
    assert got == [(0, 1, "payload"), (1, 1, "member"), (1, 2, "member"), (3, 1, "rating")]
    saved = sorted((r.record_no, r.title, r.rating, r.reason) for r in R.recovered(df).collect())
    assert saved == [(1, "saved", 5, None), (2, "t", None, "invalid_rating")]
    assert R.faults(df.limit(0)).count() == 0 == R.recovered(df.limit(0)).count()


def test_every_delivery_is_loaded_or_failing(spark):
    t, later = datetime(2020, 1, 1), datetime(2021, 1, 1)
    rows = [(1, 0, 1, made(), t), (2, 0, 1, made(), later), (3, 0, 2, made(), None), (4, 0, 3, made(), later), (5, 0, 4, "{", later), (6, None, 4, made(), later)]
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], ROWS)
    loaded = {r.delivery_id for r in R.load(df).collect()}
    failed = {(r.kafka_partition, r.kafka_offset) for r in R.failing(df).collect()}
    # message 1 arrived before its own timestamp, so no delivery of it loads
    assert loaded == {3, 4, 6} and failed == {(0, 1), (0, 4)}
    assert all(((p, o) in failed) != (i in loaded) for i, p, o, *_ in rows)
