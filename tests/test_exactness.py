"""Distributed algorithms against brute force on skewed random data."""

import random
import struct
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from signalfold.operators import alerts, issues, panes, rollups, throttle
from signalfold.operators.percentiles import SHIFTS, aggregate_with_percentiles, order_key, rank_percentiles

T0 = datetime(2024, 1, 1)


def test_percentiles_match_numpy(spark):
    rng = random.Random(5)
    rows = [("hot", int(rng.lognormvariate(15, 2))) for _ in range(6000)] + [("one", 7)] + [("two", v) for v in (1, 2)]
    rows += [("flat", 5)] * 50 + [("neg", -rng.randrange(10_000)) for _ in range(300)] + [("nulls", None), ("nulls", 3)] + [(None, 4), (None, 8)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(7)
    probs = [0.0, 0.5, 0.75, 0.95, 0.99, 1.0]
    by_key = {}
    for k, v in rows:
        if v is not None:
            by_key.setdefault(k, []).append(v)
    want = {k: np.quantile(v, probs) for k, v in by_key.items()}
    for got in (rank_percentiles(df, ["k"], "v", probs),
                aggregate_with_percentiles(df, ["k"], "v", probs, {"n": F.count("*")})):
        got = {r.k: r.q for r in got.collect()}
        assert set(got) == set(want)
        for k in want:
            assert np.allclose(got[k], want[k], rtol=1e-12), k


def test_percentiles_of_tiny_and_odd_values(spark):
    tiny = spark.range(100_000).select(F.lit("tiny").alias("k"), (F.col("id") / 25_641_026.0).alias("v"))
    odd = spark.createDataFrame([("odd", x) for x in (float("nan"), 1.0, 2.0, float("inf"), -float("inf"), 0.0, -1e-300, 5e-324)], "k string, v double")
    df = tiny.unionByName(odd)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: r.q for r in rank_percentiles(df, ["k"], "v", probs).collect()}
    want = {r.k: r.q for r in df.groupBy("k").agg(F.percentile("v", probs).alias("q")).collect()}
    for k in want:
        assert np.allclose(got[k], want[k], rtol=1e-12, equal_nan=True), k
    ordered = [r.v for r in odd.orderBy("v").collect()]
    assert [r.v for r in odd.orderBy(order_key(F.col("v"))).collect()][:-1] == ordered[:-1]


def test_keys_are_the_bits_of_doubles(spark):
    rng = random.Random(2)
    values = [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(3000)]
    values += [x * y for e in range(-1074, 1024, 7) for x in (2.0**e, np.nextafter(2.0**e, 0), np.nextafter(2.0**e, np.inf)) for y in (1, -1)]
    values += [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, np.nextafter(2.0**-1022, 0), float("inf"), -float("inf"), 1.7976931348623157e308]
    values = [float(v) for v in values if v == v]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", order_key(F.col("v")).alias("k")).collect()
    for v, k in got:
        bits = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
        assert k == (-bits if v < 0 else bits), v


def test_a_million_values_in_one_range(spark):
    """Values that agree in their first digits are narrowed by the next ones, not sorted in one task."""
    n = 1_000_000
    rows = spark.range(n).select(F.lit(1).alias("g"), (F.lit(1.0) + F.col("id") / (300.0 * n)).alias("v"))
    rows = rows.unionByName(spark.range(1000).select(F.lit(2).alias("g"), F.col("id").cast("double").alias("v")))
    assert rows.filter("g = 1").select(F.shiftright(order_key(F.col("v")), SHIFTS[0])).distinct().count() == 1
    probs = [0.0, 0.123456, 0.5, 0.999999, 1.0]
    want = {1: np.quantile(1.0 + np.arange(n) / (300.0 * n), probs), 2: np.quantile(np.arange(1000.0), probs)}
    for small in (1000, 1):
        got = {r.g: r.q for r in rank_percentiles(rows, ["g"], "v", probs, small=small).collect()}
        assert all(np.allclose(got[g], want[g], rtol=1e-15, atol=1e-12) for g in want)


def test_sums_and_percentiles_need_one_scan_each(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"), F.lit("x").alias("label"))
    out = aggregate_with_percentiles(df, ["k"], "v", [0.5], {"n": F.count("*"), "s": F.sum("v")}, ["label"])
    assert sorted(map(tuple, out.collect())) == [(k, "x", len(v), sum(v), [float(np.median(v))]) for k in range(3) for v in [list(range(k, 100, 3))]]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 100") == 1  # sums and first digits were read in the pass before


def test_metric_rules_reach_beyond_a_quarter(spark):
    kinds = "rule_id long, project_id long, name string, kind string, enabled boolean, throttle_seconds int, conditions string, channels string"
    rule = '{"metric_name": "m", "agg": "sum", "operator": "gte", "value": 1, "window_minutes": 216000}'
    rules = spark.createDataFrame([(1, 1, "r", "metric", True, 60, rule, "[]")], kinds)
    raw = spark.createDataFrame(
        [(1, T0.replace(month=1), "m", "gauge", "", {}, 5.0), (1, T0.replace(month=4), "m", "gauge", "", {}, 7.0)],
        "project_id long, timestamp timestamp, name string, type string, unit string, tags map<string,string>, value double",
    )
    minutes = rollups.metrics_1m(raw)
    got = alerts.observed_metrics(minutes, rollups.metrics_1h(minutes), alerts.parse_rules(rules), T0.replace(month=5))
    assert [r["observed"] for r in got.collect()] == [12.0]


def test_windows_are_few_panes(spark):
    rng = random.Random(6)
    widths = [1, 2, 3, 7, 8, 1440, 10_079, 43_200, 129_600, *(rng.randrange(1, 200_000) for _ in range(30))]
    windows = spark.createDataFrame([(i % 2, i, w) for i, w in enumerate(widths)], "p int, rule int, minutes int")
    ages = [(i % 2, rng.choice([1, 2, 3, 8, 9, rng.randrange(1, 200_001)])) for i in range(4000)]
    rows = spark.createDataFrame(ages, "p int, age long")
    sums = panes.pane_sums(rows, windows, ["p"], ["p"], [F.count("*").alias("n")], max(widths))
    got = panes.over_windows(sums, windows, ["p"]).groupBy("rule").agg(F.sum("n").alias("n"))
    want = {i: sum(p == i % 2 and a <= w for p, a in ages) for i, w in enumerate(widths)}
    assert {r.rule: r.n for r in got.collect()} == {i: n for i, n in want.items() if n}
    parts = windows.select("minutes", F.size(panes.window_panes(F.col("minutes"))).alias("n")).collect()
    assert all(r.n == r.minutes.bit_count() for r in parts)


def brute_fires(times, gap, last):
    fires = []
    for t in sorted(set(times)):
        if last is None or t - last >= gap:
            fires.append(t)
            last = t
    return fires


def test_throttle_matches_the_chain(spark):
    rng = random.Random(7)
    attempts, history, want = [], [], set()
    for rule, seconds in ((1, 10), (2, 3600), (3, 7 * 86400), (4, 86400)):
        for key, n in (("hot", 3000), ("cold", 5), ("steady", 400)):
            if key == "steady":
                times = [i * seconds * 1_000_000 // 3 for i in range(n)]
            else:
                times = [rng.randrange(40 * 86400) * 1_000_000 + rng.randrange(3) for _ in range(n)]
            prior = rng.choice([None, -5_000_000, 86_400_000_000])
            if prior is not None:
                history.append((rule, key, T0 + timedelta(microseconds=prior)))
            attempts += [(rule, key, T0 + timedelta(microseconds=t), seconds) for t in times]
            want |= {(rule, key, T0 + timedelta(microseconds=t)) for t in brute_fires(times, seconds * 1_000_000, prior)}
    df = spark.createDataFrame(attempts, "rule_id long, dedupe_key string, at timestamp, throttle_seconds int")
    hist = spark.createDataFrame(history, "rule_id long, dedupe_key string, fired_at timestamp")
    for chunk_rows in (1 << 17, 500, 40):
        got = [tuple(r) for r in throttle.fired_times(df, hist, chunk_rows).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_a_busy_target_is_cut_into_chunks(spark):
    n, gap = 1_000_000, 977
    at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 80_003).alias("at")  # within a day
    df = spark.range(n).select(F.lit(1).cast("long").alias("rule_id"), F.lit("k").alias("dedupe_key"), at, F.lit(gap).alias("throttle_seconds"))
    points = df.select("rule_id", "dedupe_key", F.unix_micros("at").alias("_at"))
    largest = throttle.chunked(points, 50_000).groupBy("_chunk").agg(F.count("*").alias("n"), F.max("_at") - F.min("_at")).agg(F.max("n")).first()[0]
    assert largest < 150_000
    got = sorted(r["us"] for r in throttle.fired_times(df, chunk_rows=50_000).select(F.unix_micros("at").alias("us")).collect())
    assert got == [1_704_067_200_000_000 + t for t in brute_fires((i * 80_003 for i in range(n)), gap * 1_000_000, None)]


def test_throttle_known_chain(spark):
    df = spark.createDataFrame([(1, "k", T0 + timedelta(seconds=s), 10) for s in (1, 5, 9, 12, 20, 25)], "rule_id long, dedupe_key string, at timestamp, throttle_seconds int")
    got = sorted((r.at - T0).seconds for r in throttle.fired_times(df).collect())
    assert got == [1, 12, 25]


def fold(occurrences, actions):
    """One pass in processing order: what the issue rows and regressions must be."""
    state, regressed = {}, set()
    merged = [(o["at"], o["seq"], 1, o) for o in occurrences] + [(a["at"], a["seq"], 0, a) for a in actions]
    for _, _, is_occ, r in sorted(merged, key=lambda x: x[:2]):
        s = state.setdefault(r["g"], {"status": "unresolved", "n": 0})
        if not is_occ:
            s["status"] = r["kind"]
            s["release"] = r["release"] if r["kind"] == "resolved" else None
            continue
        if s["n"] == 0:
            s.update(level=r["level"], first=r["at"])
        if s["status"] == "resolved":
            regressed.add(r["seq"])
            s.update(status="unresolved", release=None)
        s["n"] += 1
        s.update(title=r["title"], last=r["at"])
    return state, regressed


def test_issue_fold_and_regressions(spark):
    rng = random.Random(11)
    seq = iter(range(1_000_000))
    occ = [{"g": rng.choice(["hot"] * 8 + ["b", "c"]), "at": T0 + timedelta(minutes=rng.randrange(6000)), "seq": next(seq),
            "level": rng.choice(["error", "fatal"]), "title": f"t{rng.randrange(50)}"} for _ in range(2500)]
    first = {g: min((o["at"], o["seq"]) for o in occ if o["g"] == g) for g in ("hot", "b", "c")}
    act = [{"g": rng.choice(["hot", "b", "c"]), "at": T0 + timedelta(minutes=rng.randrange(6000)), "seq": next(seq),
            "kind": rng.choice(["resolved", "resolved", "ignored", "unresolved"]), "release": rng.choice(["", "r1"])} for _ in range(150)]
    act = [a for a in act if (a["at"], a["seq"]) > first[a["g"]]]
    state, regressed = fold(occ, act)
    odf = spark.createDataFrame([(1, o["g"], o["at"], o["seq"], o["level"], o["title"], "c", "rel", "u", "") for o in occ],
                                "project_id long, group_hash string, timestamp timestamp, seq long, level string, title string, culprit string, release string, user_id string, environment string")
    adf = spark.createDataFrame([(1, a["g"], a["at"], a["seq"], a["kind"], a["release"], 7) for a in act],
                                "project_id long, group_hash string, acted_at timestamp, seq long, kind string, release string, actor_id long")
    for bucket in ("minute", "hour", "day", "month"):
        got = [r.seq for r in issues.regressions(odf, adf, bucket=bucket).collect()]
        assert len(got) == len(set(got)) and set(got) == regressed, bucket
    for r in issues.fold_issues(odf, adf).collect():
        s = state[r.group_hash]
        assert (r.status, r.times_seen, r.level, r.title, r.first_seen, r.last_seen) == (s["status"], s["n"], s["level"], s["title"], s["first"], s["last"])
        assert r.resolved_in_release == ((s.get("release") or None) if s["status"] == "resolved" else None)
    assert issues.fold_issues(odf).filter("status <> 'unresolved'").count() == 0
    signals = issues.alert_signals(odf, adf)
    assert signals.filter("kind = 'new_issue'").count() == 3
    assert signals.filter("kind = 'regression'").count() == len(regressed)


def test_issue_filter_sets(spark):
    df = spark.createDataFrame([(1, "a", "resolved"), (1, "b", "ignored")], "project_id long, group_hash string, status string")
    empty = df.filter("false")
    assert issues.filter_issues(df).count() == 2
    assert issues.filter_issues(df, groups=empty).count() == 0
    assert issues.filter_issues(df, status="ignored", groups=df).count() == 1
