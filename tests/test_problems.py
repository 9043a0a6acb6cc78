"""Hand-made cases of the general data problems: nulls, ties, repeats, empty tables, clashing columns."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import arrivals, heavy, late, rolling
from tidemark.session import scratch
from tidemark.sources.versioned import VersionedTable
from tidemark.streaming import product_months

MONTHS = "parent_asin string, month string, month_date date, review_count int, rating_sum double, mean_rating double, neg_count int, source_silver_snapshot_id bigint, entity int, bucket int"


def months(spark, rows):
    return spark.createDataFrame([(*r, 1, 1) for r in rows], MONTHS)


def test_trailing_totals_fill_months_and_start_at_the_first(spark):
    df = months(spark, [
        ("A", None, date(2020, 1, 31), 2, 8.0, 4.0, 1, 1), ("A", "2020-01", date(2020, 1, 2), 5, 20.0, 4.0, 0, 2), ("A", "2020-01", date(2020, 1, 2), 5, 20.0, 4.0, 0, 2),
        ("A", "2020-05", None, 3, None, 2.0, None, 1), ("A", None, None, 9, 9.0, 1.0, 9, 9), (None, "2020-01", date(2020, 1, 1), 9, 9.0, 1.0, 9, 9), ("B", "2021-01", date(2021, 1, 1), None, None, None, None, None),
    ])
    got = {(r.parent_asin, r.month): (r.reviews_3, r.reviews_12, r.rating_sum_12) for r in rolling.product_trailing(df).collect()}
    assert got == {("A", "2020-01"): (5, 5, 20.0), ("A", "2020-02"): (5, 5, 20.0), ("A", "2020-03"): (5, 5, 20.0), ("A", "2020-04"): (0, 5, 20.0), ("A", "2020-05"): (3, 8, 26.0), ("B", "2021-01"): (0, 0, 0.0)}
    assert rolling.turning_bad(df.limit(0)).count() == 0


def test_turning_bad_compares_exactly_at_the_bounds(spark):
    # 12 months: 40 reviews, 8 negatives, sum 160; last 3: 10 reviews, 3 negatives, sum 35
    rows = [("A", None, date(2020, 1, 1), 30, 125.0, None, 5, 1), ("A", None, date(2020, 6, 1), 10, 35.0, None, 3, 1)]
    assert [(r.parent_asin, r.month) for r in rolling.turning_bad(months(spark, rows)).collect()] == [("A", "2020-06")]
    rows[1] = ("A", None, date(2020, 6, 1), 10, 36.0, None, 3, 1)
    assert rolling.turning_bad(months(spark, rows)).count() == 0


EVENTS = "review_id string, event_ts timestamp_ntz, rating int, kafka_partition int, kafka_offset bigint, arrival int"
DELIVERIES = "kafka_partition int, kafka_offset bigint, ingested_at timestamp_ntz, version int"


def test_late_reviews_and_corrections(spark):
    t = datetime(2020, 1, 15)
    ev = [("in", t, 5, 0, 1), ("in", t, 2, 0, 2), ("edge", t, 4, 0, 3), ("just", t, None, 0, 4), ("none", None, 4, 0, 5), (None, t, 4, 0, 6), ("lost", t, 4, 0, 7), ("two", t, 1, 0, 8), ("two", t, 3, 0, 9)]
    de = [(0, 1, datetime(2020, 1, 20)), (0, 1, datetime(2020, 5, 1)), (0, 2, datetime(2020, 1, 25)), (0, 3, datetime(2020, 3, 2)), (0, 4, datetime(2020, 3, 1, 23, 59, 59)), (0, 5, t), (0, 6, t), (0, 8, datetime(2020, 2, 1)), (0, 9, datetime(2020, 9, 1)), (None, None, None)]
    e, d = spark.createDataFrame([(*x, 0) for x in ev], EVENTS), spark.createDataFrame([(*x, 0) for x in de], DELIVERIES)
    assert [r.review_id for r in late.past_cutoff(e, d).collect()] == ["edge"]
    rows = late.monthly_versions(e, d).orderBy("version").collect()
    assert [(r.version.isoformat(), r.reviews_delta, r.rating_delta, r.retractions, r.reviews, r.rating_sum) for r in rows] == [
        ("2020-01-20", 1, 5, 0, 1, 5), ("2020-01-25", 0, -3, 1, 1, 2), ("2020-02-01", 1, 1, 0, 2, 3), ("2020-03-01", 1, 0, 0, 3, 3)]
    a = late.arrivals(e, d)
    for n in (1, 2, 4):
        (r,) = product_months.corrected(a, versions=n).collect()
        assert (r.reviews, r.rating_sum) == (3, 3)
    assert late.past_cutoff(e.limit(0), d).count() == 0 and late.monthly_versions(e, d.limit(0)).count() == 0


def test_heavy_keys(spark):
    df = spark.createDataFrame([(" a ",)] * 2 + [("A",)] + [("b",)] + [(None,), ("\t ",)] * 100, "k string")
    assert [(r.key, r.n) for r in heavy.heavy_keys(df, "k").collect()] == [("A", 3)]
    assert heavy.heavy_keys(df.limit(0), "k").count() == 0
    assert heavy.key_counts(df, "k").where("key is null").first().n == 200


NAMED = "identifier string, delivery_id bigint, ingested_at timestamp_ntz"


def test_repeated_messages(spark):
    t = [datetime(2020, 1, i) for i in range(1, 9)]
    b = spark.createDataFrame(
        [(1, 0, 1, t[3], "x"), (2, 0, 1, t[3], "x"), (3, 0, 2, t[1], "x"), (4, 0, 3, t[1], "x"), (5, None, 1, t[1], "x"), (6, None, 1, t[1], "x"), (7, 0, 4, None, "x"), (8, 0, 4, t[5], "x")],
        "delivery_id bigint, kafka_partition int, kafka_offset bigint, ingested_at timestamp_ntz, identifier string",
    )
    r = spark.createDataFrame([("r", 0, 1), ("r", 0, 2), ("r", 0, 2), (None, 0, 3)], "review_id string, kafka_partition int, kafka_offset bigint")
    assert sorted(x.delivery_id for x in arrivals.to_drop(b, r).collect()) == [1, 2, 7]
    assert arrivals.to_drop(b.limit(0), r).count() == 0
    assert sorted(x.delivery_id for x in arrivals.to_drop(b, r.limit(0)).collect()) == [2, 7]


def test_seen_bits_over_batches_equal_one_batch(spark):
    rows = [(f"m{i % 40}", i, datetime(2020, 1, 1 + i % 28)) for i in range(120)]
    root, kept = scratch(spark, "seen"), []
    for k in range(3):
        batch = spark.createDataFrame(rows[k * 40 - 5 * (k > 0) : k * 40 + 40], NAMED)
        kept += [(r.shard, r.pos) for r in arrivals.take(batch, root, f"b{k}", shards=3).collect()]
    assert len(kept) == 40 == len(set(kept))
    table = VersionedTable(spark, root)
    seen = arrivals.Seen.load(table)
    codes = seen.dictionary.collect()
    assert len({(r.shard, r.pos) for r in codes}) == len({r.identifier for r in codes}) == len(codes) == 40
    for shard in {r.shard for r in codes}:
        assert sorted(r.pos for r in codes if r.shard == shard) == list(range(sum(r.shard == shard for r in codes)))
    assert sum(r.n for r in seen.bitmaps.selectExpr("bitmap_count(bits) n").collect()) == 40
    assert table.current() == 3 and arrivals.take(spark.createDataFrame(rows, NAMED), root, "again", shards=3).count() == 0


def test_failed_batch_leaves_the_state(spark, monkeypatch):
    root = scratch(spark, "seen")
    one = spark.createDataFrame([("a", 1, None)], NAMED)
    arrivals.take(one.limit(0), scratch(spark, "none"), "b0", shards=2)
    arrivals.take(one.limit(0), root, "b-", shards=2)
    arrivals.take(one, root, "b0", shards=2)
    monkeypatch.setattr(arrivals, "union_bits", lambda a, b: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        arrivals.take(spark.createDataFrame([("b", 2, None)], NAMED), root, "b1", shards=2)
    monkeypatch.undo()
    assert VersionedTable(spark, root).current() == 2
    assert [r.delivery_id for r in arrivals.take(spark.createDataFrame([("b", 2, None), ("a", 3, None)], NAMED), root, "b1", shards=2).collect()] == [2]


def test_hot_identifier_is_one_row(spark):
    df = spark.range(20_000).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) identifier", "id delivery_id", "timestamp_ntz'2020-01-01' ingested_at")
    got = {r.delivery_id for r in arrivals.take(df, scratch(spark, "seen"), "b").collect()}
    assert got == {0} | {i for i in range(20_000) if i % 3}


@pytest.mark.parametrize("f, name", [(lambda s, e: rolling.product_trailing(e), "rolling")])
def test_buckets_do_not_repeat_totals(spark, f, name):
    rows = [("A", None, date(2019 + i // 12, i % 12 + 1, 1), 1, 1.0, 1.0, 0, 1) for i in range(40)]
    got = {r.month: (r.reviews_3, r.reviews_12) for r in f(spark, months(spark, rows)).collect()}
    assert all(v == (min(3, i + 1), min(12, i + 1)) for i, (_, v) in enumerate(sorted(got.items()))) and len(got) == 40


def _spread(spark):
    """Two deliveries of each of 30 messages, far apart in time, and a message sent again under another offset."""
    rows = [(k, 0, k % 30, datetime(2020, 1 + 6 * (k // 30), 1 + k % 28)) for k in range(60)] + [(90, 0, 77, datetime(2021, 1, 1))]
    b = spark.createDataFrame(rows, "delivery_id bigint, kafka_partition int, kafka_offset bigint, ingested_at timestamp_ntz")
    return b, spark.createDataFrame([("same", 0, 3), ("same", 0, 77)], "review_id string, kafka_partition int, kafka_offset bigint")


def test_bits_of_earlier_batches_decide(spark, monkeypatch):
    b, r = _spread(spark)
    assert sorted(x.delivery_id for x in arrivals.to_drop(b, r).collect()) == [*range(30, 60), 90]
    monkeypatch.setattr(arrivals, "_bit_set", lambda bits, pos: F.lit(False))
    assert arrivals.to_drop(b, r).count() < 31


def test_number_of_batches_and_shards_changes_nothing(spark, monkeypatch):
    b, r = _spread(spark)
    monkeypatch.setattr(arrivals, "PER_SHARD", 4)
    monkeypatch.setattr(arrivals, "SHARDS", 2)
    for n in (1, 2, 7):
        assert sorted(x.delivery_id for x in arrivals.to_drop(b, r, batches=n).collect()) == [*range(30, 60), 90]


def test_state_of_an_earlier_run_decides(spark, monkeypatch):
    b, r = _spread(spark)
    root = scratch(spark, "runs")
    assert sorted(x.delivery_id for x in arrivals.to_drop(b.where("delivery_id < 20"), r, root, "a").collect()) == []
    monkeypatch.setattr(arrivals, "PER_SHARD", 1)  # more shards than before: known identifiers keep their codes
    assert sorted(x.delivery_id for x in arrivals.to_drop(b.where("delivery_id >= 20"), r, root, "b").collect()) == [*range(30, 60), 90]
    seen = arrivals.Seen.load(VersionedTable(spark, root))
    assert seen.dictionary.select("shard", "pos").distinct().count() == 30 == seen.bitmaps.selectExpr("sum(bitmap_count(bits)) n").first().n


def test_small_batch_replaces_only_touched_parts(spark):
    rows = [(f"m{i}", i, datetime(2020, 1, 1)) for i in range(300)]
    root = scratch(spark, "seen")
    table = VersionedTable(spark, root)
    arrivals.take(spark.createDataFrame(rows, NAMED), root, "a")
    before = {p["path"] for p in table.entry(1)["parts"]}
    arrivals.take(spark.createDataFrame([("new", 999, None)], NAMED), root, "b")
    after = {p["path"] for p in table.entry(2)["parts"]}
    assert len(before - after) == 1 and len(after - before) == 2


def test_versions_share_parts_and_conflicts_are_refused(spark, monkeypatch):
    from tidemark.sources.versioned import Conflict

    t = VersionedTable(spark, scratch(spark, "parts"))
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b/=", 3), (None, 4)], "k string, v int")
    t.write(df, "one", "k")
    t.replace_partitions(spark.createDataFrame([("b/=", 9), ("c", 5)], "k string, v int"), "two")
    assert sorted((r.k or "", r.v) for r in t.read().collect()) == [("", 4), ("a", 1), ("a", 2), ("b/=", 9), ("c", 5)]
    kept = {p["value"]: p["path"] for p in t.entry(1)["parts"]}
    assert {p["value"]: p["path"] for p in t.entry(2)["parts"]}["a"] == kept["a"] and t.read(1).count() == 4
    t.merge(spark.createDataFrame([("a", 2, 7)], "k string, v int, w int").select("k", "v"), ["k", "v"], "three")
    assert t.read().count() == 5 and sorted(r.v for r in t.read(only=["a"]).collect()) == [1, 2]
    with pytest.raises(ValueError, match="several rows"):
        t.merge(df, ["k"], "twice")
    stale = VersionedTable(spark, t.root)
    monkeypatch.setattr(stale, "current", lambda: 2)
    with pytest.raises(Conflict):
        stale.append(df, "late")
    assert t.current() == 3 and [r.version for r in t.snapshots().orderBy("version").collect()] == [1, 2, 3]
    assert spark.sql(f"select sum(v) s from {t.view('parted', 1)}").first().s == 10 and t.refs().count() == 4
    assert t.expire(1) == [1, 2] and t.versions() == [3] and t.read().count() == 5


def test_out_of_order_batches_retract_what_was_past_the_cutoff(spark):
    t = datetime(2020, 1, 15)
    # the log brings the late copy first, the timely one two batches later
    ev = [("back", t, 5, 0, 1), ("back", t, 4, 0, 90), ("late", t, 3, 0, 2), ("late", t, 2, 0, 91), ("mid", t, 1, 0, 50)]
    de = [(0, 1, datetime(2020, 9, 1)), (0, 90, datetime(2020, 1, 20)), (0, 2, datetime(2020, 9, 1)), (0, 91, datetime(2020, 8, 1)), (0, 50, datetime(2020, 1, 16))]
    a = late.arrivals(spark.createDataFrame([(*x, 0) for x in ev], EVENTS), spark.createDataFrame([(*x, 0) for x in de], DELIVERIES))
    root = scratch(spark, "state")
    d = [(r.version, r.review_id, r.status, r.rating, r["diff"]) for r in late.feed(a, root, batches=3).orderBy("version", "review_id", "diff").collect()]
    assert ("back", "past_cutoff", 1) in {(i, s, x) for v, i, s, _, x in d if v == 1}
    assert {(i, s, r, x) for v, i, s, r, x in d if v > 1 and i == "back"} == {("back", "past_cutoff", 5, -1), ("back", "accepted", 4, 1)}
    table = VersionedTable(spark, root)
    assert {r.review_id: r.now.status for r in table.read().collect()} == {"back": "accepted", "late": "past_cutoff", "mid": "accepted"}
    assert table.read(1).where("review_id = 'back'").first().now.status == "past_cutoff"
    e = spark.createDataFrame([(*x, 0) for x in ev], EVENTS)
    r = spark.createDataFrame([(*x, 0) for x in de], DELIVERIES)
    for n in (1, 2, 5):
        assert [x.review_id for x in late.past_cutoff(e, r, batches=n).collect()] == ["late"]
