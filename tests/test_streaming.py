"""The stream in miniature: projection, duplicates, restarts, lateness, sources."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import config
from tidemark.operators import decline, ordering
from tidemark.session import scratch
from tidemark.sources import jsonlines
from tidemark.streaming import product_months as P

SCHEMA = "review_id string, event_ts timestamp, parent_asin string, rating int, verified_purchase boolean"


def reviews(spark, n=60, step=3):
    rows = [(f"r{i}", datetime(2020, 1, 1) + timedelta(days=step * i), f"p{i % 3}", i % 5 + 1, i % 2 == 0) for i in range(n)]
    return spark.createDataFrame(rows + rows[5:9], SCHEMA)


def batch(df):
    return P.project(P.contributions(df.dropDuplicates(["review_id"])))


def test_stream_equals_batch_when_sorted(spark):
    df = reviews(spark)
    got, told = P.run(df, 4)
    assert P.reconcile(got, batch(df)).count() == 0 and told["dropped"] == 0 and told["rows"] == 64 and told["batches"] >= 4


def test_late_rows_are_dropped_as_simulated(spark):
    rows = reviews(spark).dropDuplicates(["review_id"]).orderBy("event_ts").collect()
    order = [r for i, r in enumerate(rows) if i not in (2, 3)] + [rows[2], rows[3]]
    folder = scratch(spark, "late")
    for k in range(0, 60, 10):
        spark.createDataFrame(order[k : k + 10], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    times = sorted((x.getModificationTime(), x.getPath().getName(), x.getPath()) for x in fs.listStatus(path) if x.getPath().getName().startswith("part-"))
    for i, (_, _, p) in enumerate(times):
        fs.setTimes(p, times[0][0] - 1_000_000 + 60_000 * i, -1)
    q = P.start(P.drained(spark, folder, rows and spark.createDataFrame(rows[:1], SCHEMA).schema), scratch(spark, "o"), scratch(spark, "c"))
    q.awaitTermination()
    pos = spark.createDataFrame([(i, int(r.event_ts.timestamp() * 1000)) for i, r in enumerate(order)], "pos bigint, ts_ms bigint")
    dropped = [r.pos for r in ordering.simulate_watermark(pos, 10, 30 * 86_400_000).collect()]
    assert sorted(dropped) == [58, 59] and P.progress(q)["dropped"] == 2


def test_restart_repeats_nothing(spark, monkeypatch):
    df = reviews(spark)
    source, out, checkpoint = P.replay(df, 4), scratch(spark, "out"), scratch(spark, "chk")
    real, calls = P.contributions, []

    def failing(b):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return real(b)

    monkeypatch.setattr(P, "contributions", failing)
    q = P.start(P.drained(spark, source, df.schema), out, checkpoint)
    with pytest.raises(Exception, match="lost"):
        q.awaitTermination()
    P.start(P.drained(spark, source, df.schema), out, checkpoint).awaitTermination()
    got = P.project(spark.read.option("basePath", out).parquet(out))
    monkeypatch.setattr(P, "contributions", real)
    assert P.reconcile(got, batch(df)).count() == 0


def test_json_lines(spark, tmp_path):
    good = {"rating": 5, "title": "t", "text": "x", "asin": "A", "parent_asin": "P", "user_id": "U", "helpful_vote": 0, "verified_purchase": True}
    text = [json.dumps(good | {"timestamp": 1_600_000_000_000 + k}) for k in (3, 1, 2)] + ["{", json.dumps(good)]
    (tmp_path / "in.jsonl").write_text("\n".join(text) + "\n")
    ok, bad = jsonlines.load(spark, str(tmp_path / "in.jsonl"))
    assert ok.count() == 3 and sorted(r.reason for r in bad.collect()) == ["missing_key_field", "unparsable_json"]
    jsonlines.write_sorted(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "s"), str(tmp_path / "r"))
    lines = [r.value for p in sorted((tmp_path / "s").glob("part-*")) for r in spark.read.text(str(p)).collect()]
    assert lines == [text[1], text[2], text[0]] and spark.read.json(str(tmp_path / "r")).count() == 2


def test_settings(tmp_path):
    (tmp_path / "a.toml").write_text("[rule]\ndelta = 0.3\nrecent = 4\n")
    (tmp_path / "b.json").write_text('{"recent": 4, "delta": 0.3}')
    rule, h = config.load(tmp_path / "a.toml", decline.Rule, "rule")
    assert rule.recent == 4 and rule.baseline == 3 and h == config.load(tmp_path / "b.json", decline.Rule)[1]
    (tmp_path / "b.json").write_text('{"other": 1}')
    with pytest.raises(ValueError, match="other"):
        config.load(tmp_path / "b.json", decline.Rule)


def test_digest_ignores_order(spark):
    from tidemark.operators import profile

    df = spark.range(50).withColumn("x", F.col("id") % 7)
    a, b = (profile.digest(d, "id", "x").first()[0] for d in (df, df.repartition(5).orderBy(F.desc("id"))))
    assert a == b != profile.digest(df.limit(49), "id", "x").first()[0]


def test_injection_plan_refuses_what_cannot_land(spark):
    from tidemark.operators import lateness as L

    day = L.DAY_MS
    rows = [(i, f"r{i}", i * day) for i in range(1200)]
    pos = spark.createDataFrame(rows, "pos bigint, id string, ts_ms bigint")
    held, order = L.plan(pos, L.Injection(5, 5, 40))
    got = held.collect()
    assert sorted(h.slice for h in got) == ["far"] * 5 + ["near"] * 5 and all(h.release_before == h.pos + (730 if h.slice == "far" else 7) for h in got)
    sent = order.orderBy("slot").collect()
    assert [r.slot for r in sent] == list(range(1200)) and len({r.id for r in sent}) == 1200
    for h in got:
        at = next(k for k, r in enumerate(sent) if r.id == h.id)
        assert next(r for r in sent[at:] if r.slice is None).ts_ms == h.release_ms
    told = {(r.slice, r.reason): r["rows"] for r in L.census(L.pools(pos.unionByName(spark.createDataFrame([(1200, "r0", 1200 * day)], pos.schema)), L.Injection(5, 5, 40))).collect()}
    assert told["far", "key_collision"] == 2 and told["near", "release_past_end"] == 6 and told["far", "release_past_end"] == 729
    with pytest.raises(L.PlanError, match="watermark_undecidable"):
        L.plan(pos, L.Injection(5, 5, 400))
    with pytest.raises(ValueError, match="delay"):
        L.Injection(1, 1, 1, far_days=20)


def test_reconciliation_explains_dropped_rows(spark):
    cols = "parent_asin string, month string, review_count bigint, rating_sum double, neg_count bigint, verified_count bigint"
    f = lambda rows: spark.createDataFrame(rows, cols)
    batch = f([("A", "2020-01", 3, 9.0, 1, 1), ("A", "2020-02", 1, 5.0, 0, 0), ("A", "2020-03", 2, 4.0, 2, 0), ("A", "2020-04", 1, 1.0, 1, 0)])
    stream = f([("A", "2020-01", 2, 5.0, 1, 1), ("A", "2020-03", 1, 3.0, 0, 0), ("A", "2020-09", 1, 1.0, 1, 0), ("B", "2020-01", 1, 1.0, 1, 0), ("A", "2020-04", 1, 1.0, 1, 0)])
    dropped = f([("A", "2020-01", 1, 4.0, 0, 0), ("A", "2020-02", 1, 5.0, 0, 0), ("C", "2020-01", 1, 1.0, 1, 0)])
    got = {(r.parent_asin, r.month): (r.kind, r.review_gap, r.explained) for r in P.reconcile(stream, batch, dropped).collect()}
    assert got == {("A", "2020-01"): ("differs", -1, True), ("A", "2020-02"): ("only_batch", -1, True), ("A", "2020-03"): ("differs", -1, False), ("A", "2020-09"): ("only_stream", 1, False), ("B", "2020-01"): ("unmaterialised", 1, False)}
    assert not any(r.explained for r in P.reconcile(stream, batch).collect())
