"""Registered queries for alert rules, throttling and notifications (T1-T10, S7, S11, J6, J10)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from signalfold.operators import alerts, throttle
from signalfold.operators import issues as iss
from signalfold.operators import rollups as roll
from signalfold.plans.adapters import errors, metrics, rules, table
from signalfold.plans.issue_queries import FOLD, GROUP, ID, REGRESSIONS, SPARK_ID, actions, issues, occurrences
from signalfold.plans.registry import register
from signalfold.scale import work_dir
from signalfold.streaming import schedule

NOW = "2024-01-30"


def parsed_rules(spark, d):
    return alerts.parse_rules(rules(spark, d))


def signals(spark, d):
    """New issues and regressions, numbered the way the oracle can number them."""
    found = iss.alert_signals(occurrences(spark, d), actions(spark, d))
    return found.withColumn("issue_id", F.expr(SPARK_ID))


SIGNALS = f"""
ids AS (SELECT *, {GROUP} AS group_hash, {ID} AS issue_id FROM fx_errors),
sig AS (
  SELECT 'new_issue' AS kind, * FROM ids QUALIFY row_number() OVER (PARTITION BY project_id, group_hash ORDER BY timestamp, event_id) = 1
  UNION ALL
  SELECT 'regression', ids.* FROM ids WHERE event_id IN (SELECT event_id FROM ({REGRESSIONS}))),
att AS (
  SELECT r.rule_id, 'issue:' || issue_id AS dedupe_key, timestamp AS at_, throttle_seconds, n_channels, s.project_id,
    CASE s.kind WHEN 'new_issue' THEN 'New issue' ELSE 'Regression' END AS reason,
    exception_type || ': ' || exception_value AS title, level, release, environment,
    'https://app.example.com/issues/' || issue_id AS url
  FROM sig s JOIN fx_rules r ON r.project_id = s.project_id AND r.kind = s.kind AND r.enabled
    AND (c_environment = '' OR lower(c_environment) = lower(environment))
    AND (c_level = '' OR lower(c_level) = lower(level)) AND (c_release = '' OR c_release = release))
"""


def attempts(spark, d):
    return alerts.match_signals(signals(spark, d), parsed_rules(spark, d), "https://app.example.com/")


@register(
    "s7_alert_signals",
    f"WITH {SIGNALS} SELECT kind, project_id, issue_id, group_hash, level, release, environment, timestamp AS fired FROM sig",
)
def _(spark, d):
    return signals(spark, d).select(
        "kind", "project_id", "issue_id", "group_hash", "level", "release", "environment",
        F.col("at").alias("fired"),
    )


@register(
    "t1_signal_rules",
    f"WITH {SIGNALS} SELECT rule_id, dedupe_key, at_, reason, title, level, environment, url FROM att",
)
def _(spark, d):
    return attempts(spark, d).select(
        "rule_id", "dedupe_key", F.col("at").alias("at_"), "reason", "title", "level", "environment", "url"
    )


FREQUENT = f"""
freq AS (
  SELECT rule_id, e.project_id, {GROUP} AS group_hash, count(*) AS count
  FROM fx_rules r JOIN fx_errors e ON e.project_id = r.project_id
    AND e.timestamp >= TIMESTAMP '2024-01-30' - to_minutes(c_window)
  WHERE r.kind = 'frequency' AND r.enabled AND c_threshold > 0 AND c_window > 0
  GROUP BY ALL HAVING count(*) >= min(c_threshold))
"""


@register(
    "t2_frequent_groups",
    f"""WITH {FREQUENT} SELECT * FROM freq
QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY count DESC, group_hash) <= 100""",
)
def _(spark, d):
    return alerts.frequent_groups(errors(spark, d), parsed_rules(spark, d), NOW)


@register(
    "t2_frequency_attempts",
    f"""WITH {FOLD}, {FREQUENT}
SELECT rule_id, 'freq:' || rule_id || ':issue:' || id AS dedupe_key, title, level, c_environment AS environment, count,
  c_window || 'm' AS "window"
FROM freq JOIN issues USING (project_id, group_hash) JOIN fx_rules USING (rule_id)
WHERE c_level = '' OR lower(c_level) = lower(level)""",
)
def _(spark, d):
    rows = alerts.evaluate_frequency(errors(spark, d), issues(spark, d), parsed_rules(spark, d), NOW)
    return rows.select("rule_id", "dedupe_key", "title", "level", "environment", "count", "window")


OBSERVED = """
obs AS (
  SELECT rule_id, r.name AS rule_name, r.project_id, c_metric, c_agg, c_operator, c_value, c_window,
    CASE c_agg WHEN 'sum' THEN sum(m.value) WHEN 'avg' THEN avg(m.value) WHEN 'max' THEN max(m.value)
      WHEN 'count' THEN count(*) ELSE min(m.value) END AS observed
  FROM fx_rules r JOIN fx_metrics m ON m.project_id = r.project_id AND m.name = c_metric
    AND CASE WHEN c_window > 2880 THEN date_trunc('hour', m.timestamp) ELSE date_trunc('minute', m.timestamp) END
      >= TIMESTAMP '2024-01-30' - to_minutes(c_window) AND m.timestamp < TIMESTAMP '2024-01-30'
  WHERE r.kind = 'metric' AND enabled AND c_window > 0
  GROUP BY rule_id, r.name, r.project_id, c_metric, c_agg, c_operator, c_value, c_window)
"""


def states(spark, d):
    minutes = roll.metrics_1m(metrics(spark, d))
    return minutes, roll.metrics_1h(minutes)


@register(
    "t3_observed_metrics",
    f"WITH {OBSERVED} SELECT rule_id, project_id, c_metric AS name, c_agg AS agg, round(observed, 6) AS observed FROM obs",
)
def _(spark, d):
    rows = alerts.observed_metrics(*states(spark, d), parsed_rules(spark, d), NOW)
    return rows.select("rule_id", "project_id", "name", "agg", F.round("observed", 6).alias("observed"))


@register(
    "t3_metric_attempts",
    f"""WITH {OBSERVED} SELECT rule_id, 'metric:' || rule_id AS dedupe_key, rule_name AS title, c_window || 'm' AS "window"
FROM obs WHERE CASE c_operator WHEN 'lt' THEN observed < c_value ELSE observed >= c_value END""",
)
def _(spark, d):
    rows = alerts.evaluate_metrics(*states(spark, d), parsed_rules(spark, d), NOW)
    return rows.select("rule_id", "dedupe_key", "title", "window")


# A chain of fires: each next one is the first attempt a throttle window later or more.
FIRES = """
fires AS (
  SELECT rule_id, dedupe_key, min(at_) AS at_, min(throttle_seconds) AS gap FROM {attempts} GROUP BY ALL
  UNION ALL
  SELECT f.rule_id, f.dedupe_key, min(a.at_), min(f.gap) FROM fires f JOIN {attempts} a
    ON a.rule_id = f.rule_id AND a.dedupe_key = f.dedupe_key AND a.at_ >= f.at_ + to_seconds(f.gap)
  GROUP BY f.rule_id, f.dedupe_key)
"""
BUSY = """
busy AS (SELECT 1 + user_id % 3 AS rule_id, 'issue:' || user_id % 40 AS dedupe_key, ts AS at_,
  3600 * (6 + user_id % 3) AS throttle_seconds FROM events)
"""


@register(
    "t4_throttle_all_events",
    f"WITH RECURSIVE {BUSY}, {FIRES.format(attempts='busy')} SELECT rule_id, dedupe_key, at_ FROM fires",
)
def _(spark, d):
    """Every event is an attempt, so that targets are busy enough to be throttled."""
    busy = table(spark, d, "events").select(
        (F.lit(1) + F.col("user_id") % 3).alias("rule_id"),
        F.concat(F.lit("issue:"), (F.col("user_id") % 40).cast("string")).alias("dedupe_key"),
        F.col("ts").alias("at"),
        (F.lit(3600) * (6 + F.col("user_id") % 3)).alias("throttle_seconds"),
    )
    return throttle.fired_times(busy).withColumnRenamed("at", "at_")


LISTENED = "listened AS (SELECT * FROM att WHERE n_channels > 0)"


@register(
    "t4_throttled_signals",
    f"WITH {SIGNALS}, {LISTENED}, {FIRES.format(attempts='listened')} SELECT rule_id, dedupe_key, at_ FROM fires",
)
def _(spark, d):
    fired = throttle.claim(alerts.with_channels(attempts(spark, d)))
    return fired.select("rule_id", "dedupe_key", F.col("at").alias("at_"))


@register(
    "t5_dedupe_keys",
    f"WITH {SIGNALS} SELECT dedupe_key, count(*) AS attempts FROM att GROUP BY ALL",
)
def _(spark, d):
    return attempts(spark, d).groupBy("dedupe_key").agg(F.count("*").alias("attempts"))


@register(
    "t6_rules_with_channels",
    f"WITH {SIGNALS} SELECT rule_id, count(*) AS attempts FROM att WHERE n_channels > 0 GROUP BY ALL",
)
def _(spark, d):
    rows = alerts.with_channels(attempts(spark, d))
    return rows.groupBy("rule_id").agg(F.count("*").alias("attempts"))


@register(
    "t7_rejected_rules",
    """SELECT rule_id, CASE WHEN kind = 'metric' AND c_window <= 0 THEN 'window must be positive' ELSE 'no channel' END AS reason
FROM fx_rules WHERE (kind = 'metric' AND c_window <= 0) OR n_channels = 0""",
)
def _(spark, d):
    return alerts.validate_rules(parsed_rules(spark, d))


NUMBER = """CASE WHEN {0} = round({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"""


@register(
    "t8_metric_text",
    f"""WITH {OBSERVED} SELECT rule_id, c_agg || '(' || c_metric || ') ' || CASE c_operator WHEN 'lt' THEN '<' ELSE '≥' END
  || ' ' || {NUMBER.format('c_value')} || ' — ' || {NUMBER.format('exact')} || ' over ' || c_window || 'm' AS text,
  'https://app.example.com/projects/' || project_id || '/metrics?name=' || c_metric AS url
FROM (SELECT *, round(observed, 3) AS exact FROM obs) WHERE CASE c_operator WHEN 'lt' THEN exact < c_value ELSE exact >= c_value END""",
)
def _(spark, d):
    """The whole text of a breached rule; observed values are rounded as a dashboard would, sums of doubles have no one order."""
    minutes, hours = states(spark, d)
    observed = alerts.observed_metrics(minutes, hours, parsed_rules(spark, d), NOW)
    rounded = observed.withColumn("observed", F.round("observed", 3))
    rows = alerts.metric_attempts(rounded, NOW, "https://app.example.com")
    return rows.select("rule_id", F.col("culprit").alias("text"), "url")


@register(
    "t10_projects_to_evaluate",
    "SELECT DISTINCT project_id FROM fx_rules WHERE enabled AND kind = 'frequency'",
)
def _(spark, d):
    return alerts.projects_to_evaluate(parsed_rules(spark, d), "frequency")


@register(
    "s11_notifications",
    f"""WITH {SIGNALS}, {LISTENED}, {FIRES.format(attempts='listened')}
SELECT rule_id, dedupe_key, 'webhook' AS channel, 'https://hooks.example.com/' || rule_id AS hook, 'project ' || project_id AS project,
  any_value(reason) AS reason, max(level) AS level, at_ AS fired_at
FROM fires JOIN (SELECT DISTINCT * FROM listened) USING (rule_id, dedupe_key, at_), range(2) copies(i)
WHERE i < n_channels GROUP BY rule_id, dedupe_key, at_, project_id, i""",
)
def _(spark, d):
    fired = throttle.claim(alerts.with_channels(attempts(spark, d)))
    rows = alerts.notifications(fired)
    return rows.select(
        "rule_id", "dedupe_key", "channel", F.col("settings")["url"].alias("hook"), "project",
        "reason", "level", "fired_at",
    )


def _written(spark, df, label):
    path = work_dir(spark, label)
    df.write.parquet(path)
    return spark.read.parquet(path)


@register(
    "t9_minute_passes",
    f"""WITH t AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-28', TIMESTAMP '2024-01-30', INTERVAL 12 HOUR)) AS now_),
obs AS (
  SELECT now_, rule_id, c_operator, c_value, throttle_seconds, CASE c_agg WHEN 'sum' THEN sum(m.value) WHEN 'avg' THEN avg(m.value)
    WHEN 'max' THEN max(m.value) WHEN 'count' THEN count(*) ELSE min(m.value) END AS observed
  FROM t CROSS JOIN fx_rules r JOIN fx_metrics m ON m.project_id = r.project_id AND m.name = c_metric
    AND CASE WHEN c_window > 2880 THEN date_trunc('hour', m.timestamp) ELSE date_trunc('minute', m.timestamp) END >= now_ - to_minutes(c_window)
    AND CASE WHEN c_window > 2880 THEN date_trunc('hour', m.timestamp) ELSE date_trunc('minute', m.timestamp) END < now_
  WHERE r.kind = 'metric' AND enabled AND c_window > 0 AND n_channels > 0
  GROUP BY now_, rule_id, c_agg, c_operator, c_value, throttle_seconds),
hit AS (SELECT rule_id, 'metric:' || rule_id AS dedupe_key, now_ AS at_, throttle_seconds FROM obs
  WHERE CASE c_operator WHEN 'lt' THEN observed < c_value ELSE observed >= c_value END),
{FIRES.format(attempts='hit')}
SELECT rule_id, dedupe_key, at_ FROM fires""",
)
def _(spark, d):
    """Timed passes over the whole metric table, each of which reads the last fires that the one before it left."""
    minutes, hours = (_written(spark, s, "t9") for s in states(spark, d))
    ready, out = parsed_rules(spark, d), work_dir(spark, "t9-notifications")
    for n in range(5):
        now = datetime(2024, 1, 28) + timedelta(hours=12 * n)
        schedule.tick(spark, lambda at: alerts.evaluate_metrics(minutes, hours, ready, at), now, out, n)
    told = spark.read.parquet(out).select("rule_id", "dedupe_key", F.col("fired_at").cast("timestamp_ntz").alias("at_"))
    return told.distinct()
