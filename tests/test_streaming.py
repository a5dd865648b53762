"""Streaming jobs: any split of the input into batches, repeats and restarts give the batch result."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from signalfold.operators import alerts, issues, rollups
from signalfold.plans import signal_queries, streaming_queries
from signalfold.sources.jobs import stream_lines
from signalfold.streaming import alerts as alert_stream
from signalfold.streaming import batches, issue_state, jobs, schedule, seen

T0 = datetime(2024, 1, 1)


def iso(t):
    return t.isoformat() + "Z"


def line(kind, payload, minute, project=1):
    at = T0 + timedelta(minutes=minute)
    return json.dumps({"project_id": project, "type": kind, "payload": {"timestamp": iso(at), **payload}, "received_at": iso(at + timedelta(seconds=1)), "sdk": {"name": "js"}})


def error(i, minute, user="u"):
    return line("error", {"event_id": f"{i:032x}", "exception": [{"type": f"E{i % 3}", "value": f"v {i}", "frames": [{"function": f"f{i % 3}", "module": "m", "in_app": True}]}],
                          "user": {"id": user}, "contexts": {"a": {"password": "p"}}, "tags": {"token": "x"}}, minute)


LINES = [error(i + 1, i * 7, f"u{i % 5}") for i in range(30)]
LINES += [line("metric", {"name": "m", "type": "gauge", "value": float(i), "tags": {"page": f"/{i % 2}"}}, i) for i in range(90)]
LINES += [line("log", {"severity": "warning", "body": "Bearer abc", "attributes": {"k": "v"}}, i) for i in range(20)]
LINES += ["junk", json.dumps({"project_id": 1, "type": "log", "payload": [1], "received_at": iso(T0)})]


def land(folder, lines, files):
    os.makedirs(folder, exist_ok=True)
    for f in range(files):
        path = os.path.join(folder, f"part-{len(os.listdir(folder)):04d}.txt")
        with open(path, "w") as out:
            out.write("\n".join(lines[f::files]) + "\n")


def run(spark, source, root, per_batch):
    for q in jobs.start_router(stream_lines(spark, source, per_batch), root, available_now=True).values():
        q.awaitTermination()
    jobs.start_issue_fold(spark, root, available_now=True).awaitTermination()


def changes(spark, root, hash_type="long"):
    return spark.read.schema(issue_state.change_schema(hash_type)).parquet(jobs.Paths(root).of("issue_changes"))


def summary(spark, root):
    paths = jobs.Paths(root)
    stats = rollups.compact_issue_stats(spark.read.parquet(paths.of("issue_stats_1h")).drop("batch", "month"))
    hours = spark.read.parquet(paths.of("metrics_1h")).groupBy("hour", F.col("tags")["page"].alias("page"))
    fold = jobs.issues_from_partials(batches.read_partials(spark, paths.of("issue_partials")))
    return {
        "errors": sorted((r.event_id, r.group_hash, r.title, r.contexts, r.tags["token"]) for r in spark.read.parquet(paths.of("errors")).collect()),
        "logs": spark.read.parquet(paths.of("logs")).filter("body = '[redacted]' AND severity = 'warn'").count(),
        "stats": sorted((r.group_hash, r.hour, r.times_seen, r.first_seen, r.last_seen) for r in stats.collect()),
        "hours": sorted(tuple(r) for r in hours.agg(rollups.merged("sum"), rollups.merged("count"), rollups.merged("max")).collect()),
        "issues": sorted(tuple(map(str, r)) for r in fold.collect()),
        "state": sorted((r.id, r.title, r.times_seen, r.first_seen, r.last_seen, r.level, r.status) for r in issue_state.latest(changes(spark, root)).collect()),
        "signals": sorted((r.kind, r.issue_id) for r in issue_state.signals_of(changes(spark, root)).collect()),
        "rejects": sorted(r.reason for r in spark.read.parquet(paths.of("rejects")).collect()),
    }


@pytest.fixture(scope="module")
def one_batch(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("one")
    land(f"{base}/in", LINES, 1)
    run(spark, f"{base}/in", f"{base}/out", 10)
    return summary(spark, f"{base}/out")


def test_one_batch(one_batch):
    assert len(one_batch["errors"]) == 30 and one_batch["logs"] == 20 and len(one_batch["signals"]) == 3
    assert one_batch["rejects"] == ["not readable", "unreadable log"]
    assert all(c == '{"a":{"password":"[redacted]"}}' and t == "[redacted]" for *_, c, t in one_batch["errors"])
    assert sum(r[2] for r in one_batch["hours"]) == sum(range(90))


def test_several_batches_and_a_restart(spark, one_batch, tmp_path):
    source, root = f"{tmp_path}/in", f"{tmp_path}/out"
    land(source, LINES[:70], 3)
    run(spark, source, root, 1)
    land(source, LINES[70:], 2)
    run(spark, source, root, 1)
    assert summary(spark, root) == one_batch


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    lines = spark.createDataFrame([(v,) for v in LINES], "value string")
    half = spark.createDataFrame([(v,) for v in LINES[:12]], "value string")
    paths = jobs.Paths(f"{tmp_path}/out")
    error_batch, metric_batch = jobs.error_batch(paths), jobs.metric_batch(paths)

    def counts():
        return {t: spark.read.parquet(paths.of(t)).count() for t in ("errors", "errors_seen", "issue_stats_1h", "issue_partials", "metrics_raw", "metrics_1m")}

    def files():
        return sorted(r[0] for r in spark.read.parquet(paths.of("issue_partials")).select(F.input_file_name()).distinct().collect())

    error_batch(half, 0), metric_batch(lines, 0), error_batch(lines, 1)
    before, named = counts(), files()
    error_batch(lines, 1), metric_batch(lines, 0)
    assert counts() == before and before["errors"] == 30  # the lines of both batches count once
    assert files() == named  # a stream that follows the partials does not see the batch again


def test_redelivered_events(spark, tmp_path):
    """Only committed events of earlier batches are dropped, however full the filter is."""
    cols = "project_id long, event_id string, timestamp timestamp, received_at timestamp, n int"
    make = lambda ids, n: [(1 + i % 2, f"e{i}", T0 + timedelta(hours=i % 60), T0 + timedelta(minutes=n), n) for i in ids]
    old = spark.createDataFrame(make(range(0, 400), 0), cols)
    new = spark.createDataFrame(make(range(200, 900), 1) + make(range(880, 950), 2), cols)
    for blocks in (1, 1 << 16):
        hits = {(r.project_id, r.event_id) for r in seen.possible_repeats(new, seen.filter_of(old, blocks=blocks), blocks=blocks).collect()}
        true = {(1 + i % 2, f"e{i}") for i in range(200, 400)}
        assert hits >= true and (len(hits) > 400) == (blocks == 1)
    table, filters = f"{tmp_path}/t", f"{tmp_path}/f"
    old.withColumn("day", F.to_date("timestamp")).withColumn("batch", F.lit(0)).write.partitionBy("day", "batch").parquet(table)
    for batch in (0, 0):  # a repeated write replaces itself
        seen.write_filter(old, filters, batch)
    with seen.first_deliveries(new, table, filters, 1) as fresh:
        got = sorted((int(r.event_id[1:]), r.n) for r in fresh.collect())
        assert fresh.columns == new.columns
    assert got == [(i, 1 if i < 900 else 2) for i in range(400, 950)]
    with seen.first_deliveries(old, table, filters, 0) as again:  # batch 0 itself runs again
        assert again.count() == 400
    assert seen.forget(spark, filters, (T0 + timedelta(days=1)).date()) == ["2024-01-01"]
    with seen.first_deliveries(new, table, filters, 1) as fresh:
        assert fresh.count() == 550 + sum(1 for i in range(200, 400) if i % 60 < 24)


def test_regressions_across_batches(spark, tmp_path):
    rows = []
    for i in range(40):
        at = T0 + timedelta(minutes=i)
        rows.append((1, f"g{i % 2}", at, f"{i:03d}", at, "t", "c", "error", "", ""))
    cols = "project_id long, group_hash string, received_at timestamp, event_id string, timestamp timestamp, title string, culprit string, level string, release string, environment string"
    df = spark.createDataFrame(rows, cols).withColumn("user_id", F.lit("u")).withColumn("components", F.array().cast("array<string>"))
    acts = [(1, g, T0 + timedelta(minutes=m, seconds=30), "s", k, "") for g, m, k in
            (("g0", 5, "resolved"), ("g0", 21, "resolved"), ("g1", 9, "resolved"), ("g1", 9.5, "ignored"), ("g1", 30, "resolved"), ("g0", 38, "resolved"))]
    actions = spark.createDataFrame([(p, g, t, s, k, r) for p, g, t, s, k, r in acts], "project_id long, group_hash string, acted_at timestamp, seq string, kind string, release string")
    want = sorted(r.timestamp for r in issues.regressions(df, actions, issue_state.ORDER).collect())
    assert len(want) == 3
    moves = f"{tmp_path}/moves"
    actions.write.parquet(moves)
    for cuts, each in (([0, 40], True), ([0, 7, 23, 31, 40], True), (list(range(0, 41, 4)), False)):
        path, out = f"{tmp_path}/{len(cuts)}", f"{tmp_path}/{len(cuts)}-out"
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            part = df.filter(F.col("event_id").between(f"{a:03d}", f"{b - 1:03d}"))
            batches.write_partial(issue_state.partials(part, actions), path, n)
            if each or b == 40:
                stream = spark.readStream.schema(actions.schema).parquet(moves)
                issue_state.start_issues(spark, path, out, out + "-check", stream, available_now=True, hash_type="string").awaitTermination()
        found = spark.read.schema(issue_state.change_schema("string")).parquet(out)
        got = [(r.kind, r.at) for r in issue_state.signals_of(found).collect()]
        assert sum(k == "new_issue" for k, _ in got) == 2
        assert sorted(t for k, t in got if k == "regression") == want
        now = {r.group_hash: (r.times_seen, r.status) for r in issue_state.latest(found).collect()}
        assert now == {"g0": (20, "resolved"), "g1": (20, "unresolved")}


def test_issue_state_goes_on_from_a_batch_fold(spark, tmp_path):
    cols = "project_id long, group_hash string, received_at timestamp, event_id string, timestamp timestamp, title string, culprit string, level string, release string, environment string, user_id string, components array<string>"
    row = lambda g, m, title: (1, g, T0 + timedelta(minutes=m), f"{m:03d}", T0 + timedelta(minutes=m), title, "c", "error", "r1", "production", "u", ["x"])
    past = issue_state.partials(spark.createDataFrame([row("a", 1, "one"), row("a", 2, "two"), row("b", 3, "three")], cols))
    initial = issue_state.initial_state(past)
    path, out = f"{tmp_path}/p", f"{tmp_path}/o"
    acts = "project_id long, group_hash string, acted_at timestamp, seq string, kind string, release string, assignee_id long"
    steps = [([row("c", 9, "new")], [("a", 5, "resolved", None), ("b", 5, "assigned", 7)]), ([row("a", 10, "back"), row("a", 0, "late")], [("b", 4, "ignored", None)])]
    for n, (rows, moves) in enumerate(steps):
        new = spark.createDataFrame([(1, g, T0 + timedelta(minutes=m), str(m), k, "r2", who) for g, m, k, who in moves], acts)
        new.write.mode("append").parquet(f"{tmp_path}/m")
        known = spark.read.parquet(f"{tmp_path}/m")
        part = issue_state.partials(spark.createDataFrame(rows, cols), known)
        batches.write_partial(part, path, n)
        if n == 1:  # the same batch under another file name
            part.write.mode("append").parquet(f"{path}/batch={n}")
        stream = spark.readStream.schema(new.schema).parquet(f"{tmp_path}/m")
        issue_state.start_issues(spark, path, out, out + "-c", stream, initial, True, hash_type="string").awaitTermination()
    found = spark.read.schema(issue_state.change_schema("string")).parquet(out)
    assert sorted((r.kind, r.group_hash, r.title) for r in issue_state.signals_of(found).collect()) == [("new_issue", "c", "new"), ("regression", "a", "back")]
    now = {r.group_hash: r for r in issue_state.latest(found).collect()}
    assert {g: (r.title, r.times_seen, r.status, r.assignee_id, r.first_seen) for g, r in now.items()} == {
        "a": ("back", 4, "unresolved", None, T0), "b": ("three", 1, "ignored", 7, T0 + timedelta(minutes=3)), "c": ("new", 1, "unresolved", None, T0 + timedelta(minutes=9))}


RULES = [(1, 1, "all", "new_issue", '{}', '[{"type":"webhook","settings":{"url":"u"}},{"type":"email","settings":{}}]', 3600, True),
         (2, 1, "narrow", "new_issue", '{"environment":"PRODUCTION","level":"error","release":"r1"}', '[{"type":"webhook","settings":{}}]', 3600, True),
         (3, 1, "silent", "new_issue", '{}', '[]', 3600, True), (4, 1, "off", "new_issue", '{}', '[{"type":"x"}]', 3600, False),
         (5, 1, "reg", "regression", '{}', '[{"type":"webhook"}]', 10, True)]


def rules(spark):
    df = spark.createDataFrame(RULES, "rule_id long, project_id long, name string, kind string, conditions string, channels string, throttle_seconds int, enabled boolean")
    return alerts.parse_rules(df)


def signal(kind, issue, second, level="error", release="r1"):
    return (kind, 1, issue, issue, "t", "c", level, release, "production", T0 + timedelta(seconds=second))


def test_alert_stream(spark, tmp_path):
    folder = f"{tmp_path}/signals"
    cols = alert_stream.SIGNAL_COLUMNS.format(hash="long")
    first = [signal("new_issue", 7, 0), signal("new_issue", 7, 5), signal("new_issue", 8, 6, "fatal"), signal("regression", 7, 10)]
    second = [signal("new_issue", 7, 4000), signal("regression", 7, 15), signal("regression", 7, 20), signal("regression", 7, 25)]
    out = f"{tmp_path}/out"
    for n, part in enumerate((first, second)):
        batches.write_partial(spark.createDataFrame(part, cols), folder, n)
        stream = alert_stream.signal_stream(spark, folder)
        alert_stream.start_alerts(stream, rules(spark), out, f"{tmp_path}/check", "https://d.example.com/", True).awaitTermination()
    got = sorted((r.rule_id, r.dedupe_key, r.channel, (r.fired_at - T0).total_seconds(), r.url) for r in spark.read.parquet(out).collect())
    url = "https://d.example.com/issues/"
    assert got == [
        (1, "issue:7", "email", 0, url + "7"), (1, "issue:7", "email", 4000, url + "7"), (1, "issue:7", "webhook", 0, url + "7"), (1, "issue:7", "webhook", 4000, url + "7"),
        (1, "issue:8", "email", 6, url + "8"), (1, "issue:8", "webhook", 6, url + "8"),
        (2, "issue:7", "webhook", 0, url + "7"), (2, "issue:7", "webhook", 4000, url + "7"),
        (5, "issue:7", "webhook", 10, url + "7"), (5, "issue:7", "webhook", 20, url + "7"),
    ]


def test_timed_passes(spark, tmp_path):
    def evaluate(now):
        one = spark.createDataFrame([(9, "metric:9", now, 150, 1, "Metric threshold", "t", "c", "", "", "", 0, "5m", "")],
                                    "rule_id long, dedupe_key string, at timestamp, throttle_seconds int, project_id long, reason string, title string, culprit string, level string, release string, environment string, count long, window string, url string")
        return one.withColumn("channels", F.from_json(F.lit('[{"type":"webhook"}]'), "array<struct<type:string,settings:map<string,string>>>"))

    out = f"{tmp_path}/n"
    for n in range(6):
        schedule.tick(spark, evaluate, T0 + timedelta(minutes=n), out, n)
    schedule.tick(spark, evaluate, T0 + timedelta(minutes=3), out, 3)  # a repeated pass
    fired = sorted((r.fired_at - T0).seconds // 60 for r in spark.read.parquet(out).collect())
    assert fired == [0, 3]
    # Only what a later pass can need is kept: one row for the one target, or none once its throttle is over.
    kept = batches.folder_numbers(spark, out + "-fires", "tick")
    assert sorted(kept) == [3, 4, 5] and spark.read.parquet(f"{out}-fires/tick=5").count() == 1
    schedule.tick(spark, lambda now: evaluate(now).limit(0), T0 + timedelta(hours=1), out, 6)
    assert spark.read.parquet(f"{out}-fires/tick=6").count() == 0


def test_rule_checks(spark):
    rows = [(1, "n", "metric", '{"metric_name":"m","agg":"p95","operator":"gt","window_minutes":5}', '[{"type":"x"}]'), (2, "", "metric", "{}", "[]"), (3, "n", "odd", "{}", "[]"),
            (4, "n", "metric", "{}", '[{"type":"x"}]'), (5, "n", "metric", '{"metric_name":"m","agg":"p42"}', '[{"type":"x"}]'), (6, "n", "metric", '{"metric_name":"m","agg":"sum","operator":"eq"}', '[{"type":"x"}]'),
            (7, "n", "metric", '{"metric_name":"m","agg":"sum","operator":"lt","window_minutes":0}', '[{"type":"x"}]'), (8, "n", "new_issue", "{}", "[]"), (9, "n", "new_issue", "{}", '[{"type":"x"}]')]
    df = alerts.parse_rules(spark.createDataFrame(rows, "rule_id long, name string, kind string, conditions string, channels string"))
    assert {r.rule_id: r.reason for r in alerts.validate_rules(df).collect()} == {
        2: "name is missing", 3: "unknown kind", 4: "metric name is missing", 5: "unknown aggregation", 6: "unknown operator", 7: "window must be positive", 8: "no channel"}


def test_numbers_as_text(spark):
    values = [500.0, 812.25, 0.1, 1e7, 123456789.5, 0.0001, -3.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(alerts.plain_number(F.col("v"))).collect()] == ["500", "812.25", "0.1", "10000000", "123456789.5", "0.0001", "-3"]


class HeldState:
    """The state handle and the value state of one issue, without a stream."""

    def __init__(self):
        self.value = None

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_signals_carry_no_state():
    """What a batch tells of an issue grows with its regressions, not with these times its actions."""
    at = lambda i: i * 60_000_000
    first = {"timestamp_us": 0, "level": "error", "release": "", "environment": "", "title": "t", "culprit": "c", "components": []}
    occurrence = lambda i: {"first_us": at(i), "first_id": f"{i:04d}", "first": first, "last_us": at(i), "last_id": f"{i:04d}", "last": {"title": "t", "culprit": "c"}, "last_seen_us": at(i), "times_seen": 1}
    resolve = lambda i: {"batch": None, "segments": None, "action": {"kind": "resolved", "release": "", "assignee_id": None, "acted_us": at(i), "seq": f"{i:04d}"}}
    processor, held = issue_state.IssueProcessor(), []
    processor.init(HeldState())
    for batch in range(3):
        numbers = range(batch * 200, batch * 200 + 200)
        rows = [resolve(i) for i in numbers if i % 2] + [{"batch": batch, "segments": [occurrence(i) for i in numbers if i % 2 == 0], "action": None}]
        told = list(processor.handleInputRows((1, 7), iter(rows), None))
        assert [sum(r.kind == k for r in told) for k in ("new_issue", "regression", "issue")] == [batch == 0, 100 - (batch == 0), 1]
        held.append(sum(len(r.moves or ()) for r in told))
        assert {r.version for r in told if r.kind != "issue"} == {None}
    assert held == [100, 200, 300]


def test_stores_of_an_ended_query_close(spark):
    for ends in (True, False):
        batches.keyed_state(spark, ends)
        assert spark.conf.get("spark.sql.streaming.stateStore.unloadOnCommit") == str(ends).lower()


def test_partials_between_actions(spark):
    """Stretches between actions over many hours, against plain Python; some at the same moment, some hours without any."""
    rng = random.Random(5)
    moment = lambda: T0 + timedelta(minutes=rng.choice([0, 0, 300, 900]) + rng.randrange(40) * 5)
    rows = [(1, rng.choice("ab"), moment(), f"{i:03d}", T0, "t", "c", "error", "", "", "u", []) for i in range(300)] + [(1, "a", None, "x", T0, "t", "c", "error", "", "", "u", [])]
    cols = "project_id long, group_hash string, received_at timestamp, event_id string, timestamp timestamp, title string, culprit string, level string, release string, environment string, user_id string, components array<string>"
    acts = [(1, rng.choice("abc"), moment(), rng.choice(["000", "150", "999"]), rng.choice(["resolved", "ignored", "assigned"])) for _ in range(120)]
    actions = spark.createDataFrame(acts, "project_id long, group_hash string, acted_at timestamp, seq string, kind string")
    got = {r.group_hash: r for r in issue_state.partials(spark.createDataFrame(rows, cols), actions).collect()}
    some = [r[2] for r in rows if r[2]]
    for group in "ab":
        cuts = sorted((a[2], a[3]) for a in acts if a[1] == group and a[4] != "assigned" and min(some) <= a[2] <= max(some))
        mine = sorted((r[2] or datetime.min, r[3]) for r in rows if r[1] == group)
        want = {}
        for x in mine:
            want.setdefault(sum(c < x for c in cuts), []).append(x)
        assert [(s.first_at.o1, s.last_at.o1, s.times_seen) for s in got[group].segments] == [(x[0][1], x[-1][1], len(x)) for _, x in sorted(want.items())]
        assert got[group].times_seen == len(mine)


def test_lines_land_in_parts(spark):
    """Every part reaches the tables of its signals and is gone then; shuffle files are kept as before afterwards."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(name)
    parts = [spark.createDataFrame([(x,) for x in LINES[k::2]], "value string") for k in range(2)]
    label = f"parts-{random.random()}"
    paths = streaming_queries._routed_by_parts(spark, parts, label, ("logs", "errors", "rejects"))
    beside = os.path.dirname(paths.root.removeprefix("file:"))
    assert spark.read.parquet(paths.of("logs")).count() == 20
    assert spark.read.parquet(paths.of("errors")).select("event_id").distinct().count() == 30
    assert sorted(r.reason for r in spark.read.parquet(paths.of("rejects")).collect()) == ["not readable", "unreadable log"]
    assert [os.listdir(f"{beside}/{x}") for x in os.listdir(beside) if x.startswith(f"{label}-lines")] == [[]]
    assert spark.conf.get(name) == old


def test_parts_hold_every_line(spark, tmp_path):
    """The parts of each kind of lines are its lines, each once; null times and keys as well."""
    at = [T0 + timedelta(hours=i) for i in range(6)] + [None]
    kinds = ["error", "view", "signup", "purchase", "error", "click", "error"]
    events = [(i, t, i, k, float(i), "{}") for i, (t, k) in enumerate(zip(at, kinds))]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(i, i, "F", 1.5, t, "1-URGENT") for i, t in enumerate(at)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i % 4, i, 2.5, "N") for i in range(9)], "l_orderkey long, l_linenumber int, l_extendedprice double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    for lines in (signal_queries.log_lines, signal_queries.metric_lines, signal_queries.span_lines, signal_queries.error_lines):
        whole = sorted(r.value for r in lines(spark, str(tmp_path)).collect())
        parts = [lines(spark, str(tmp_path), lambda c: F.pmod(F.xxhash64(c), F.lit(3)) == k).collect() for k in range(3)]  # noqa: B023
        assert sorted(r.value for p in parts for r in p) == whole and sum(map(bool, parts)) > 1
