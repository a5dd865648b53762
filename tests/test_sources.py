"""Envelopes, jobs, tables, control-plane inputs."""

import gzip
import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from signalfold.operators import rollups
from signalfold.sources import control, envelopes, jobs, tables
from signalfold.streaming import batches

HEADER = b'{"sent_at":"2024-01-01T00:00:00Z","sdk":{"name":"js","version":"1"}}\n'


def item(kind, payload, newline=True):
    return b'{"type":"%s","length":%d}\n' % (kind.encode(), len(payload)) + payload + (b"\n" if newline else b"")


def test_items():
    body = HEADER + item("error", b'{"a":\n"b"}') + item("novel", b"x" * 9) + b"\n" + item("log", "é€".encode()) + item("span", b"", newline=False)
    header, items, skipped = envelopes.split_items(body)
    assert header["sdk"]["name"] == "js" and skipped == 1
    assert items == [("error", b'{"a":\n"b"}'), ("log", "é€".encode()), ("span", b"")]
    assert envelopes.split_items(HEADER) [1] == []
    assert envelopes.split_items(b"{}\r\n" + item("log", b"x"))[1] == [("log", b"x")]


@pytest.mark.parametrize("body,word", [
    (b"", "empty"), (b"nope\n", "header"), (b"[]\n", "header"), (HEADER + b"junk\n", "item 0"),
    (HEADER + b'{"type":"log","length":9}\nabc', "ends inside"), (HEADER + b'{"type":"log","length":-1}\n', "bad length"),
    (HEADER + b'{"type":"log","length":%d}\n' % (envelopes.MAX_ITEM + 1), "over the limit"),
    (b"{" + b" " * envelopes.MAX_LINE + b"}\n", "over the limit"),
    (HEADER + item("log", b"x") * 1001, "more than"),
])
def test_bad_envelopes(body, word):
    with pytest.raises(envelopes.EnvelopeError, match=word):
        envelopes.split_items(body)


def test_inflate():
    assert envelopes.inflate(gzip.compress(b"abc")) == b"abc" == envelopes.inflate(b"abc", "identity")
    assert envelopes.inflate(gzip.compress(b"a") + gzip.compress(b"b")) == b"ab"
    with pytest.raises(envelopes.EnvelopeError, match="over the limit"):
        envelopes.inflate(gzip.compress(b"0" * (envelopes.MAX_BODY + 10)))
    with pytest.raises(envelopes.EnvelopeError, match="supported"):
        envelopes.inflate(b"x", "br")
    for bad in (gzip.compress(b"abc" * 500)[:-12], b"xyz"):
        with pytest.raises(envelopes.EnvelopeError, match="gzip"):
            envelopes.inflate(bad, "gzip")


def test_read_envelopes(spark, tmp_path):
    (tmp_path / "a.env").write_bytes(HEADER + item("log", b'{"body":"x"}') + item("error", b"{}"))
    (tmp_path / "b.env").write_bytes(gzip.compress(HEADER + item("metric", b"{}")))
    (tmp_path / "c.env").write_bytes(b"junk")
    rows = envelopes.read_envelopes(spark, str(tmp_path)).collect()
    assert sorted((r.path[-5:], r.type) for r in rows if r.type) == [("a.env", "error"), ("a.env", "log"), ("b.env", "metric")]
    assert [r.error is not None for r in rows if r.path.endswith("c.env")] == [True]
    items = envelopes.read_envelopes(spark, str(tmp_path)).withColumns({"project_id": F.lit(4), "received_at": F.lit(datetime(2024, 1, 1)), "client_ip": F.lit("1.2.3.4")})
    got = envelopes.jobs_from_items(items).collect()
    assert len(got) == 3 and all(r.sdk.name == "js" and r.sent_at == datetime(2024, 1, 1) for r in got)


def test_jobs(spark):
    good = {"project_id": 4, "type": "log", "payload": {"body": "x", "n": [1]}, "received_at": "2024-01-01T00:00:00Z", "sdk": {"name": "js"}}
    lines = [json.dumps(good)] + [json.dumps({**good, **bad}) for bad in ({"project_id": 0}, {"project_id": None}, {"type": "x"}, {"received_at": None})] + ["{", "", "[1]", json.dumps({**good, "type": "session"})]
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    ok = jobs.decode_jobs(df).collect()
    assert [r.type for r in ok] == ["log", "session"] and json.loads(ok[0].payload) == good["payload"]
    reasons = sorted(r.reason for r in jobs.rejected_jobs(df).collect())
    assert reasons == ["no project"] * 2 + ["no receive time"] + ["not readable"] * 3 + ["unknown type"]
    sig = spark.createDataFrame([('{"project_id":1,"issue_id":2,"kind":"new_issue","at":"2024-01-01T00:00:00Z"}',), ('{"project_id":1}',), ("x",)], "value string")
    assert jobs.decode_alert_signals(sig).count() == 1


def rows_by_day(spark, path):
    return {(r.project_id, str(r.day)): r["count"] for r in tables.read(spark, path).groupBy("project_id", "day").count().collect()}


def test_table_life(spark, tmp_path):
    path = str(tmp_path / "logs")
    data = [(p, datetime(2024, 1, d, h), "info", "s", "b") for p, d, h in ((1, 1, 1), (2, 1, 2), (1, 2, 3), (2, 3, 4), (2, 3, 5))]
    df = spark.createDataFrame(data, "project_id long, timestamp timestamp, severity string, service string, body string")
    tables.append(df, path, "logs", conform=False)
    tables.append(df, path, "logs", conform=False)
    assert rows_by_day(spark, path) == {(1, "2024-01-01"): 2, (2, "2024-01-01"): 2, (1, "2024-01-02"): 2, (2, "2024-01-03"): 4}
    tables.purge_project(spark, path, "logs", 2)
    assert rows_by_day(spark, path) == {(1, "2024-01-01"): 2, (1, "2024-01-02"): 2}
    assert tables.apply_retention(spark, path, "logs", date(2024, 2, 1)) == [date(2024, 1, 1)]
    assert rows_by_day(spark, path) == {(1, "2024-01-02"): 2}


def test_compaction_keeps_values(spark, tmp_path):
    raw = spark.range(500).select(F.lit(1).alias("project_id"), F.lit("m").alias("name"), F.lit("gauge").alias("type"), F.lit("").alias("unit"),
                                  F.create_map(F.lit("page"), (F.col("id") % 3).cast("string")).alias("tags"),
                                  (F.lit(datetime(2024, 1, 5)) + F.expr("make_dt_interval(0, 0, 0, id)")).alias("timestamp"), F.col("id").cast("double").alias("value"))
    path, archive = str(tmp_path / "m"), str(tmp_path / "archive")
    for i in range(3):
        batches.write_batch(rollups.metrics_1m(raw.filter(F.col("value") % 3 == i)), path, "metrics_1m", i)
    batches.write_batch(rollups.metrics_1m(raw.filter("value % 3 = 2")), path, "metrics_1m", 2)  # repeated batch
    def total():
        s = batches.read_states(spark, path, archive, "metrics_1m")
        return s.count(), s.agg(rollups.merged("sum"), rollups.merged("uniq")).first()
    before = total()
    assert before[1][0] == sum(range(500))
    batches.archive_month(spark, path, archive, "metrics_1m", date(2024, 1, 1), rollups.compact_metrics)
    after = total()
    assert after[1][0] == before[1][0] and after[0] <= before[0]
    tables.compact(spark, archive, "metrics_1m", date(2024, 1, 1), rollups.compact_metrics)
    assert total()[0] == after[0]


def test_releases(spark):
    up = spark.createDataFrame([(1, "v", "sha1", "~/a.js", "k1", 1, "c1", 1), (1, "v", "", "~/a.js", "k2", 2, "c2", 2), (1, "v", "", "~/b.js", "k3", 3, "c3", 1), (2, "v", "", "~/b.js", "k4", 3, "c3", 1)],
                               "project_id long, version string, ref string, url_pattern string, artifact_key string, size_bytes long, checksum string, uploaded_at long")
    assert sorted((r.project_id, r.ref) for r in control.fold_releases(up).collect()) == [(1, "sha1"), (2, "")]
    assert sorted(r.artifact_key for r in control.fold_release_files(up).collect()) == ["k2", "k3", "k4"]


def test_ingest_keys(spark):
    keys = spark.createDataFrame([("k1", 1, None), ("k2", 1, "2024")], "public_key string, project_id long, revoked_at string")
    projects = spark.createDataFrame([(1, "shop")], "project_id long, name string")
    items = spark.createDataFrame([("k1", 1), ("k2", 2), ("k3", 3)], "public_key string, n int")
    ok, bad = control.resolve_keys(items, keys, projects)
    assert [r.n for r in ok.collect()] == [1] and sorted(r.n for r in bad.collect()) == [2, 3]


def test_reads_by_trace_shuffle_nothing(spark):
    from signalfold.plans import catalog

    for name in ("l8_waterfall_by_trace", "j7_joined_by_trace"):
        df = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan, name
