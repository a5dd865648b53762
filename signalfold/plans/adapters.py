"""Views that read the driver's tables as the four signals.

Every view is one SQL text accepted by Spark and by DuckDB.  `@name@` stands for a table:
a Parquet path in Spark, the pre-registered view in DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENVIRONMENT = "CASE {0} % 4 WHEN 0 THEN 'staging' WHEN 3 THEN '' ELSE 'production' END"

ERRORS = f"""
SELECT 1 + user_id % 3 AS project_id, event_id, ts AS timestamp,
  CASE WHEN event_id % 11 = 0 THEN 'fatal' WHEN event_id % 5 = 0 THEN 'warning' ELSE 'error' END AS level,
  {ENVIRONMENT.format('event_id')} AS environment,
  CASE WHEN day(ts) <= 10 THEN 'web@1.0' WHEN day(ts) <= 20 THEN 'web@1.1' ELSE 'web@1.2' END AS release,
  CASE user_id % 3 WHEN 0 THEN 'TypeError' WHEN 1 THEN 'RangeError' ELSE 'IOError' END AS exception_type,
  'user ' || CAST(user_id AS STRING) || ' not found in /srv/app/m' || CAST(user_id % 5 AS STRING) || '.js' AS exception_value,
  'app/m' || CAST(user_id % 5 AS STRING) AS module, 'fn' || CAST(user_id % 7 AS STRING) AS func,
  'fn' || CAST(user_id % 7 AS STRING) || '(app/m' || CAST(user_id % 5 AS STRING) || ')' AS culprit,
  CASE WHEN event_id % 6 = 0 THEN '' ELSE CAST(user_id AS STRING) END AS user_id,
  CASE event_id % 3 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Safari' ELSE '' END AS browser,
  user_id AS trace_id
FROM @events@ WHERE event_type = 'error'
"""

LOGS = f"""
SELECT 1 + user_id % 3 AS project_id, ts AS timestamp,
  CASE event_type WHEN 'error' THEN 17 WHEN 'signup' THEN 13 WHEN 'purchase' THEN 9 WHEN 'view' THEN 5 ELSE 1 END AS severity_number,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' WHEN 'purchase' THEN 'info' WHEN 'view' THEN 'debug' ELSE 'trace' END AS severity,
  'svc' || CAST(user_id % 4 AS STRING) AS service,
  {ENVIRONMENT.format('event_id')} AS environment,
  event_type || ' by user ' || CAST(user_id AS STRING) AS body, event_type || ' by user <id>' AS template,
  user_id AS trace_id, event_id
FROM @events@
"""

SPANS = f"""
SELECT 1 + o_custkey % 3 AS project_id, o_orderkey AS trace_id, o_orderkey * 100 AS span_id, CAST(0 AS BIGINT) AS parent_span_id,
  true AS is_segment, 'GET /orders/' || o_orderpriority AS name, 'http.server' AS op, 'svc' || CAST(o_custkey % 4 AS STRING) AS service,
  o_orderdate AS timestamp, CAST(round(o_totalprice * 1000) AS BIGINT) AS duration_ns,
  CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'P' THEN 'cancelled' ELSE 'ok' END AS status,
  CASE o_orderstatus WHEN 'F' THEN 500 WHEN 'P' THEN 499 ELSE 200 END AS http_status,
  {ENVIRONMENT.format('o_custkey')} AS environment,
  'api@' || CAST(year(o_orderdate) AS STRING) AS release, '/orders/:id' AS http_route, '' AS db_system, '' AS db_statement
FROM @orders@
UNION ALL
SELECT 1 + o.o_custkey % 3, l.l_orderkey, l.l_orderkey * 100 + l.l_linenumber, l.l_orderkey * 100,
  false, 'db.' || l.l_returnflag, 'db.query', 'svc' || CAST(o.o_custkey % 4 AS STRING),
  o.o_orderdate, CAST(round(l.l_extendedprice * 100) AS BIGINT), 'ok', 0,
  {ENVIRONMENT.format('o.o_custkey')},
  'api@' || CAST(year(o.o_orderdate) AS STRING), '', 'postgresql', 'SELECT * FROM item WHERE flag = ''' || l.l_returnflag || ''' AND id = $1'
FROM @lineitem@ l JOIN @orders@ o ON o.o_orderkey = l.l_orderkey
"""

METRICS = """
SELECT 1 + user_id % 3 AS project_id, ts AS timestamp,
  CASE event_type WHEN 'view' THEN 'web.lcp' WHEN 'click' THEN 'web.inp' WHEN 'signup' THEN 'web.cls' WHEN 'purchase' THEN 'web.fcp' ELSE 'web.ttfb' END AS name,
  'distribution' AS type, CASE event_type WHEN 'signup' THEN '' ELSE 'millisecond' END AS unit,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE '/p' || CAST(user_id % 10 AS STRING) END AS page, value
FROM @events@
"""

ISSUE_ACTIONS = """
SELECT 1 + user_id % 3 AS project_id, CASE user_id % 3 WHEN 0 THEN 'TypeError' WHEN 1 THEN 'RangeError' ELSE 'IOError' END AS exception_type,
  'app/m' || CAST(user_id % 5 AS STRING) AS module, 'fn' || CAST(user_id % 7 AS STRING) AS func,
  ts AS acted_at, event_id AS seq, user_id AS actor_id,
  CASE event_id % 5 WHEN 0 THEN 'ignored' WHEN 1 THEN 'unresolved' ELSE 'resolved' END AS kind,
  CASE WHEN day(ts) <= 10 THEN 'web@1.0' WHEN day(ts) <= 20 THEN 'web@1.1' ELSE 'web@1.2' END AS release
FROM @events@ WHERE event_type = 'signup'
"""

RULES = """
SELECT CAST(n_nationkey AS BIGINT) AS rule_id, CAST(1 + n_nationkey % 3 AS BIGINT) AS project_id, n_name AS name,
  CASE n_nationkey % 4 WHEN 0 THEN 'new_issue' WHEN 1 THEN 'regression' WHEN 2 THEN 'frequency' ELSE 'metric' END AS kind,
  CASE n_nationkey % 5 WHEN 0 THEN 'Production' WHEN 1 THEN 'staging' ELSE '' END AS c_environment,
  CASE n_nationkey % 3 WHEN 0 THEN 'ERROR' ELSE '' END AS c_level,
  CASE n_nationkey % 7 WHEN 3 THEN 'web@1.1' ELSE '' END AS c_release,
  CAST(n_nationkey % 6 AS BIGINT) AS c_threshold, n_nationkey % 8 * 1440 AS c_window,
  CASE n_nationkey % 3 WHEN 0 THEN 'web.lcp' WHEN 1 THEN 'web.inp' ELSE 'web.fcp' END AS c_metric,
  CASE n_nationkey % 5 WHEN 0 THEN 'sum' WHEN 1 THEN 'avg' WHEN 2 THEN 'max' WHEN 3 THEN 'count' ELSE 'min' END AS c_agg,
  CASE n_nationkey % 2 WHEN 0 THEN 'lt' ELSE 'gte' END AS c_operator,
  CAST(n_nationkey * 2 AS DOUBLE) AS c_value,
  3600 * (1 + n_nationkey % 6) AS throttle_seconds, n_nationkey % 3 AS n_channels, n_nationkey % 11 <> 5 AS enabled
FROM @nation@
"""

VIEWS = {
    "fx_rules": RULES,
    "fx_errors": ERRORS,
    "fx_logs": LOGS,
    "fx_spans": SPANS,
    "fx_metrics": METRICS,
    "fx_issue_actions": ISSUE_ACTIONS,
}
GROUP_KEYS = ["project_id", "exception_type", "module", "func"]
GROUP_TEXT = "exception_type || '|' || module || '|' || func"


def for_duckdb(sql: str) -> str:
    """Turn `@table@` into the pre-registered view and prefix the adapter views in use as CTEs."""
    used = [name for name in VIEWS if re.search(rf"\b{name}\b", sql)]
    body = sql.strip()
    if used:
        ctes = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in used)
        if body.upper().startswith("WITH "):
            # RECURSIVE is harmless where nothing recurs.
            body = re.sub(r"(?i)^WITH (RECURSIVE )?", "", body)
            sql = f"WITH RECURSIVE {ctes},\n{body}"
        else:
            sql = f"WITH {ctes}\n{body}"
    return re.sub(r"@(\w+)@", r"\1", sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One adapter view as a DataFrame."""
    base = sf_dir.rstrip("/")
    return spark.sql(re.sub(r"@(\w+)@", rf"parquet.`{base}/\1.parquet`", VIEWS[name]))


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error occurrences with a group key and the processing sequence number."""
    return view(spark, sf_dir, "fx_errors").select(
        "*", F.expr(GROUP_TEXT).alias("group_hash"), F.col("event_id").alias("seq")
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_logs")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_spans")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric observations with `page` as a tag; rows without a page have an empty map."""
    tags = F.when(F.col("page").isNull(), F.expr("map()").cast("map<string,string>")).otherwise(
        F.create_map(F.lit("page"), F.col("page"))
    )
    return view(spark, sf_dir, "fx_metrics").withColumn("tags", tags).drop("page")


def issue_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_issue_actions").withColumn("group_hash", F.expr(GROUP_TEXT))


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert rules with their conditions and channels as the JSON text a rule is saved with."""
    df = view(spark, sf_dir, "fx_rules")
    names = {
        "environment": "c_environment",
        "level": "c_level",
        "release": "c_release",
        "threshold": "c_threshold",
        "window_minutes": "c_window",
        "metric_name": "c_metric",
        "agg": "c_agg",
        "operator": "c_operator",
        "value": "c_value",
    }
    conditions = F.to_json(F.struct(*[F.col(c).alias(n) for n, c in names.items()]))
    channel = F.struct(
        F.lit("webhook").alias("type"),
        F.create_map(F.lit("url"), F.concat(F.lit("https://hooks.example.com/"), "rule_id")).alias("settings"),
    )
    channels = F.to_json(F.array_repeat(channel, F.col("n_channels")))
    return df.select(
        "rule_id", "project_id", "name", "kind", "throttle_seconds", "enabled",
        conditions.alias("conditions"), channels.alias("channels"),
    )
