"""Registered queries for sources, decoding and row building (S, N, R7, R8, U, D)."""

from __future__ import annotations

import gzip
from datetime import date

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalfold import schemas
from signalfold.functions import normalize
from signalfold.operators import signals
from signalfold.plans.adapters import errors, logs, metrics, spans, table
from signalfold.plans.registry import register
from signalfold.scale import work_dir
from signalfold.sources import control, envelopes, jobs, tables

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
STAMPED = "timestamp + INTERVAL 1 SECOND"  # sent 4 s and received 5 s after the event


def _stamp(name: str, seconds: int = 0):
    return F.date_format(F.col(name) + F.expr(f"INTERVAL {seconds} SECONDS"), ISO)


def job_lines(rows, kind: str, payload, part=None, part_of="timestamp"):
    """Queue lines as a gateway writes them: received 5 s and sent 4 s after the event.

    `part` makes a condition of a column; then the lines of these rows alone come, in the splits of the table.
    """
    job = F.struct(
        "project_id",
        F.lit(kind).alias("type"),
        payload.alias("payload"),
        _stamp("timestamp", 5).alias("received_at"),
        _stamp("timestamp", 4).alias("sent_at"),
        F.struct(F.lit("js").alias("name"), F.lit("1.2").alias("version")).alias("sdk"),
        F.lit("198.51.100.7").alias("client_ip"),
    )
    if part is not None:
        return rows.filter(part(part_of)).select(F.to_json(job).alias("value"))
    # A queue has many readers: lines are spread over them, however few splits the table has.
    return rows.select(F.to_json(job).alias("value")).repartition(rows.sparkSession.sparkContext.defaultParallelism)


def error_lines(spark, d, part=None):
    e = errors(spark, d)
    frame = F.struct(
        F.col("func").alias("function"), "module", F.lit("m.js").alias("filename"),
        (F.col("seq") % 100 + 1).cast("int").alias("lineno"), F.lit(True).alias("in_app"),
    )
    library = F.struct(
        F.lit("next").alias("function"), F.lit("express").alias("module"), F.lit("e.js").alias("filename"),
        F.lit(7).alias("lineno"), F.lit(False).alias("in_app"),
    )
    exception = F.struct(
        F.col("exception_type").alias("type"),
        F.concat("exception_value", F.lit(" token abc")).alias("value"),
        F.array(frame, library).alias("frames"),
    )
    payload = F.struct(
        F.lpad(F.lower(F.hex(F.col("seq") + 1)), 32, "0").alias("event_id"),
        _stamp("timestamp").alias("timestamp"),
        F.when(F.col("seq") % 7 == 0, "LOUD").otherwise(F.col("level")).alias("level"),
        F.lit("javascript").alias("platform"),
        "release",
        "environment",
        F.array(exception).alias("exception"),
        F.array(
            F.struct(
                _stamp("timestamp").alias("ts"),
                F.lit("Bearer xyz").alias("message"),
                F.struct(F.lit("s3cret").alias("password"), F.lit("/cart").alias("url")).alias("data"),
            )
        ).alias("breadcrumbs"),
        F.struct(F.struct(F.lit("Safari").alias("name")).alias("browser")).alias("contexts"),
        F.struct(
            F.col("user_id").alias("id"),
            F.when(F.col("seq") % 2 == 0, "{{auto}}").otherwise("203.0.113.9").alias("ip_address"),
        ).alias("user"),
        F.create_map(F.lit("plan"), F.lit("free"), F.lit("api_key"), F.lit("k")).alias("tags"),
        F.lpad(F.lower(F.hex("seq")), 16, "0").alias("span_id"),
    )
    return job_lines(e, "error", payload, part)


def log_lines(spark, d, part=None):
    payload = F.struct(
        F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("789Z")).alias("timestamp"),
        F.expr(
            "CASE severity WHEN 'warn' THEN ' WARNING ' WHEN 'error' THEN 'err' WHEN 'info' THEN 'notice'"
            " WHEN 'debug' THEN 'Verbose' ELSE severity END"
        ).alias("severity"),
        "service",
        F.concat("body", F.lit(" basic dXNlcg==")).alias("body"),
        "template",
        "environment",
        F.create_map(F.lit("user"), F.col("trace_id").cast("string"), F.lit("csrf"), F.lit("c")).alias("attributes"),
        F.lpad(F.hex("event_id"), 16, "0").alias("span_id"),
    )
    return job_lines(logs(spark, d), "log", payload, part)


def span_lines(spark, d, part=None):
    payload = F.struct(
        F.lpad(F.hex("trace_id"), 32, "0").alias("trace_id"),
        F.hex("span_id").alias("span_id"),
        F.hex("parent_span_id").alias("parent_span_id"),
        "is_segment",
        "name",
        "op",
        "service",
        _stamp("timestamp").alias("start_time"),
        (F.col("duration_ns") / 1e6).alias("duration_ms"),
        F.when(F.col("status") == "ok", "fine").otherwise(F.col("status")).alias("status"),
        "environment",
        "release",
        "http_status",
        "db_system",
        F.when(F.col("db_statement") != "", F.concat("db_statement", F.lit(" -- token t0k")))
        .otherwise("")
        .alias("db_statement"),
        F.create_map(F.lit("cookie"), F.lit("c"), F.lit("zone"), F.col("service")).alias("tags"),
    )
    # By trace, so that only this part of the order lines meets its orders.
    return job_lines(spans(spark, d), "span", payload, part, "trace_id")


def metric_lines(spark, d, part=None):
    payload = F.struct(
        _stamp("timestamp").alias("timestamp"), "name",
        F.when(F.col("name") == "web.cls", "odd").otherwise(F.col("type")).alias("type"),
        "unit", "value", "tags",
    )
    return job_lines(metrics(spark, d), "metric", payload, part)


def _naive(name: str):
    return F.col(name).cast("timestamp_ntz").alias(name)


UUID = r"regexp_replace(lpad(lower(to_hex({0})), 32, '0'), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5')"
LEVEL = "CASE WHEN event_id % 7 = 0 THEN 'error' ELSE level END"
ENV = "CASE WHEN environment = '' THEN 'production' ELSE environment END"


def _error_rows(spark, d):
    return signals.error_rows(signals.error_items(jobs.decode_jobs(error_lines(spark, d))))


@register(
    "n1_error_rows",
    f"""SELECT project_id, {UUID.format('event_id + 1')} AS event_id, {STAMPED} AS timestamp, timestamp + INTERVAL 5 SECOND AS received_at,
  {LEVEL} AS level, {ENV} AS environment, release, 'javascript' AS platform, exception_type,
  exception_value || ' [redacted]' AS exception_value, event_id AS span_id, user_id, 'js' AS sdk_name
FROM fx_errors""",
)
def _(spark, d):
    rows = schemas.conform(_error_rows(spark, d), schemas.ERRORS)
    return rows.select(
        "project_id", "event_id", _naive("timestamp"), _naive("received_at"), "level", "environment",
        "release", "platform", "exception_type", "exception_value", "span_id", "user_id", "sdk_name",
    )


@register(
    "n2_log_rows",
    f"""SELECT project_id, severity, severity_number, {STAMPED} AS timestamp, epoch_us({STAMPED}) * 1000 + 789 AS ts_ns, service,
  {ENV} AS environment, body || ' [redacted]' AS body, template, event_id AS span_id,
  'csrf=[redacted];user=' || trace_id AS attributes
FROM fx_logs""",
)
def _(spark, d):
    rows = signals.log_rows(jobs.decode_jobs(log_lines(spark, d)))
    text = F.transform(
        F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return rows.select(
        "project_id", "severity", F.col("severity_number").cast("int").alias("severity_number"),
        _naive("timestamp"), "ts_ns", "service", "environment", "body", "template", "span_id",
        F.array_join(text, ";").alias("attributes"),
    )


@register(
    "n3_span_rows",
    f"""SELECT project_id, {UUID.format('trace_id')} AS trace_id, span_id, parent_span_id, is_segment, name, op, {STAMPED} AS timestamp,
  CAST(trunc(duration_ns / 1e6 * 1e6) AS BIGINT) AS duration_ns, status, {ENV} AS environment, http_status,
  CASE WHEN db_statement = '' THEN '' ELSE db_statement || ' -- [redacted]' END AS db_statement, service AS zone, '[redacted]' AS cookie
FROM fx_spans""",
)
def _(spark, d):
    rows = signals.span_rows(jobs.decode_jobs(span_lines(spark, d)))
    return rows.select(
        "project_id", "trace_id", "span_id", "parent_span_id", "is_segment", "name", "op",
        _naive("timestamp"), "duration_ns", "status", "environment", "http_status", "db_statement",
        F.col("tags")["zone"].alias("zone"), F.col("tags")["cookie"].alias("cookie"),
    )


@register(
    "n4_metric_rows",
    f"""SELECT project_id, {STAMPED} AS timestamp, name, CASE WHEN name = 'web.cls' THEN 'counter' ELSE type END AS type, unit, value,
  coalesce(page, '') AS page FROM fx_metrics""",
)
def _(spark, d):
    rows = signals.metric_rows(jobs.decode_jobs(metric_lines(spark, d)))
    return rows.select(
        "project_id", _naive("timestamp"), "name", "type", "unit", "value",
        F.coalesce(F.col("tags")["page"], F.lit("")).alias("page"),
    )


@register(
    "n5_job_facts_win",
    f"""SELECT {UUID.format('event_id + 1')} AS event_id, {ENV} AS environment,
  CASE WHEN event_id % 2 = 0 THEN '198.51.100.7' ELSE '203.0.113.9' END AS user_ip, '1.2' AS sdk_version FROM fx_errors""",
)
def _(spark, d):
    return _error_rows(spark, d).select("event_id", "environment", "user_ip", "sdk_version")


@register(
    "n6_severity",
    """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'warn' WHEN 1 THEN 'debug' WHEN 2 THEN 'fatal' WHEN 3 THEN 'error' WHEN 4 THEN 'trace'
  WHEN 5 THEN 'fatal' ELSE 'info' END AS severity, CASE event_id % 8 WHEN 0 THEN 13 WHEN 1 THEN 5 WHEN 2 THEN 21 WHEN 3 THEN 17 WHEN 4 THEN 1
  WHEN 5 THEN 21 ELSE 9 END AS number FROM events""",
)
def _(spark, d):
    said = F.expr(
        "CASE event_id % 8 WHEN 0 THEN 'Warning' WHEN 1 THEN 'VERBOSE ' WHEN 2 THEN 'Emerg' WHEN 3 THEN ' Err'"
        " WHEN 4 THEN 'trace' WHEN 5 THEN 'critical' WHEN 6 THEN event_type || '!' ELSE NULL END"
    )
    level = normalize.severity(said)
    return table(spark, d, "events").select(
        "event_id", level.alias("severity"), normalize.severity_number(level).cast("int").alias("number")
    )


# Receive time is the event's; the client's clock and send time vary by event.
CLOCK_TS = "ts + to_seconds(CASE event_id % 5 WHEN 0 THEN -30 WHEN 1 THEN 7200 WHEN 2 THEN -90000 WHEN 3 THEN 45 ELSE -86400 END)"
CLOCK_SENT = "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ts + to_seconds(7200) WHEN 2 THEN ts - to_seconds(100000) ELSE ts END"


@register(
    "n7_clock_skew",
    f"""WITH c AS (SELECT event_id, ts AS received, {CLOCK_TS} AS t, {CLOCK_SENT} AS sent FROM events),
s AS (SELECT *, coalesce(epoch_us(received) - epoch_us(sent), 0) AS skew FROM c)
SELECT event_id, CASE WHEN abs(skew) > 86400000000 OR event_id % 11 = 0 THEN received
  WHEN epoch_us(t) + skew > epoch_us(received) + 60000000 OR epoch_us(t) + skew < epoch_us(received) - 86400000000 THEN received
  ELSE make_timestamp(epoch_us(t) + skew) END AS corrected FROM s""",
)
def _(spark, d):
    received = F.col("ts").cast("timestamp")
    offset = F.expr("CASE event_id % 5 WHEN 0 THEN -30 WHEN 1 THEN 7200 WHEN 2 THEN -90000 WHEN 3 THEN 45 ELSE -86400 END")
    sent = F.expr("CASE event_id % 4 WHEN 1 THEN 7200 WHEN 2 THEN -100000 WHEN 3 THEN 0 END")

    def later(seconds):
        return F.timestamp_micros(F.unix_micros(received) + seconds.cast("long") * 1_000_000)

    claimed = F.when(F.col("event_id") % 11 != 0, later(offset))
    fixed = normalize.corrected_time(claimed, received, later(sent))
    return table(spark, d, "events").select("event_id", fixed.cast("timestamp_ntz").alias("corrected"))


@register(
    "n8_uuids",
    r"""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 5 THEN '00000000-0000-0000-0000-000000000000'
  ELSE regexp_replace(md5(CAST(o_orderkey AS STRING)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') END AS id FROM orders""",
)
def _(spark, d):
    digest = F.md5(F.col("o_orderkey").cast("string"))
    dashed = F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    kind = F.col("o_orderkey") % 6
    said = (
        F.when(kind == 0, dashed)
        .when(kind == 1, F.upper(dashed))
        .when(kind == 2, digest)
        .when(kind == 3, F.concat(F.lit("{"), dashed, F.lit("}")))
        .when(kind == 4, F.concat(F.lit("urn:uuid:"), dashed))
        .otherwise(F.concat(F.lit("x"), digest))
    )
    return table(spark, d, "orders").select("o_orderkey", normalize.parse_uuid(said).alias("id"))


@register(
    "n9_span_ids",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN 0 WHEN o_orderkey % 5 = 3 THEN -1 - o_orderkey ELSE o_orderkey * 1000003 END AS id FROM orders""",
)
def _(spark, d):
    key = F.col("o_orderkey")
    said = (
        F.when(key % 5 == 4, F.concat(F.hex(key), F.lit("-")))
        .when(key % 5 == 3, F.concat(F.lit("abc"), F.hex(F.lit(-1) - key)))
        .otherwise(F.lower(F.hex(key * 1000003)))
    )
    return table(spark, d, "orders").select("o_orderkey", normalize.parse_span_id(said).alias("id"))


@register(
    "n10_absent_maps",
    "SELECT project_id, count(*) AS rows, count(*) FILTER (page IS NULL) AS empty FROM fx_metrics GROUP BY ALL",
)
def _(spark, d):
    bare = metrics(spark, d).withColumn("tags", F.when(F.size("tags") > 0, F.col("tags")))
    payload = F.struct(_stamp("timestamp").alias("timestamp"), "name", "value", "tags")
    rows = signals.metric_rows(jobs.decode_jobs(job_lines(bare, "metric", payload)))
    return rows.groupBy("project_id").agg(
        F.count("tags").alias("rows"), F.count_if(F.size("tags") == 0).alias("empty")
    )


@register(
    "n11_error_projection",
    f"""SELECT {UUID.format('event_id + 1')} AS event_id, exception_type || ': ' || exception_value || ' [redacted]' AS title,
  func || '(' || module || ')' AS culprit, 'stack_trace' AS method, 'type:' || exception_type || '|frame:' || module || ':' || func AS components,
  'Safari' AS browser, func AS frame_function, 1 + event_id % 100 AS frame_line FROM fx_errors""",
)
def _(spark, d):
    return _error_rows(spark, d).select(
        "event_id", "title", "culprit", "method", F.array_join("components", "|").alias("components"), "browser",
        F.get_json_object("stacktrace", "$[0].frames[0].function").alias("frame_function"),
        F.get_json_object("stacktrace", "$[0].frames[0].lineno").cast("long").alias("frame_line"),
    )


@register(
    "n13_culprits",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'fn' || user_id % 7 || '(app/m' || user_id % 5 || ')' WHEN event_id % 3 = 1 THEN 'next(express)'
  ELSE 'm' || user_id % 5 || '.js' END AS culprit FROM events""",
)
def _(spark, d):
    kind = F.col("event_id") % 3

    def frame(function, module, filename, in_app):
        return F.struct(
            function.alias("function"), module.alias("module"), filename.alias("filename"), in_app.alias("in_app")
        )

    own = frame(
        F.when(kind == 2, "").otherwise(F.expr("'fn' || user_id % 7")),
        F.when(kind == 2, "").otherwise(F.expr("'app/m' || user_id % 5")),
        F.expr("'m' || user_id % 5 || '.js'"),
        kind != 1,
    )
    library = frame(F.lit("next"), F.lit("express"), F.lit("e.js"), F.lit(False))
    exc = F.array(F.struct(F.array(own, library).alias("frames")))
    return table(spark, d, "events").select("event_id", normalize.culprit(exc).alias("culprit"))


@register(
    "n14_finite_values",
    "SELECT event_type, count(*) FILTER (event_id % 5 > 2) AS kept FROM events GROUP BY ALL",
)
def _(spark, d):
    value = F.expr(
        "CASE event_id % 5 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') WHEN 2 THEN double('-Infinity') ELSE value END"
    )
    rows = table(spark, d, "events").filter(normalize.is_finite(value))
    return rows.groupBy("event_type").agg(F.count("*").alias("kept"))


@register(
    "n15_stringify",
    """SELECT event_id, event_type AS plain, CAST(event_id AS STRING) AS number, 'true' AS flag, '{"u":' || user_id || ',"l":[1]}' AS nested FROM events""",
)
def _(spark, d):
    doc = F.to_json(
        F.struct(
            F.col("event_type").alias("plain"),
            F.col("event_id").alias("number"),
            F.lit(True).alias("flag"),
            F.struct(F.col("user_id").alias("u"), F.array(F.lit(1)).alias("l")).alias("nested"),
        )
    )
    values = signals.stringify(doc)
    return table(spark, d, "events").select(
        "event_id", *[values[k].alias(k) for k in ("plain", "number", "flag", "nested")]
    )


VITALS = """
WITH e AS (SELECT *, user_id * 100 + CAST(epoch(ts) / 86400 AS BIGINT) % 30 AS view_id FROM events),
v AS (SELECT 1 + user_id % 3 AS project_id, view_id, '/p' || user_id % 10 AS page,
  arg_max(CASE WHEN event_type = 'view' THEN value * 10 END, CASE WHEN event_type = 'view' THEN event_id END) AS lcp,
  arg_max(CASE WHEN event_type = 'purchase' THEN value END, CASE WHEN event_type = 'purchase' THEN event_id END) AS fcp,
  max(CASE WHEN event_type = 'signup' THEN value END) AS ttfb,
  max(CASE WHEN event_type = 'click' AND value >= 40 THEN value END) AS inp,
  coalesce(sum(CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN value / 128 END), 0.0) AS cls
  FROM e GROUP BY ALL),
u AS (SELECT project_id, view_id, page, 'web.lcp' AS name, round(lcp) AS value FROM v UNION ALL SELECT project_id, view_id, page, 'web.fcp', round(fcp) FROM v
  UNION ALL SELECT project_id, view_id, page, 'web.ttfb', round(ttfb) FROM v UNION ALL SELECT project_id, view_id, page, 'web.inp', round(inp) FROM v
  UNION ALL SELECT project_id, view_id, page, 'web.cls', round(cls, 3) FROM v)
SELECT project_id, view_id, page, name, value FROM u WHERE name = 'web.cls' OR value > 0
"""


@register("n17_web_vitals", VITALS)
def _(spark, d):
    kind = F.col("event_type")
    entries = table(spark, d, "events").select(
        (F.lit(1) + F.col("user_id") % 3).alias("project_id"),
        F.expr("user_id * 100 + CAST(round(CAST(unix_micros(CAST(ts AS TIMESTAMP)) AS DOUBLE) / 1000000 / 86400) AS BIGINT) % 30").alias("view_id"),
        F.expr("'/p' || user_id % 10").alias("page"),
        F.col("ts").alias("timestamp"),
        F.col("event_id").alias("seq"),
        F.when(kind == "view", "largest-contentful-paint").when(kind == "purchase", "paint").when(kind == "signup", "navigation")
        .when(kind == "click", "event").otherwise("layout-shift").alias("entry_type"),
        F.lit("first-contentful-paint").alias("name"),
        F.when(kind == "view", F.col("value") * 10).otherwise(F.col("value")).alias("start_time"),
        (F.col("value") / 128).alias("value"),
        F.col("value").alias("duration"),
        (F.col("event_id") % 2 == 1).alias("had_recent_input"),
    )
    rows = signals.web_vitals(entries)
    return rows.select("project_id", "view_id", F.col("tags")["page"].alias("page"), "name", "value")


@register(
    "n18_log_table_rows",
    f"SELECT project_id, service, {ENV} AS environment, count(*) AS rows, count(DISTINCT template) AS templates FROM fx_logs GROUP BY ALL",
)
def _(spark, d):
    rows = signals.log_rows(jobs.decode_jobs(log_lines(spark, d)))
    return rows.groupBy("project_id", "service", "environment").agg(
        F.count("*").alias("rows"), F.count_distinct("template").alias("templates")
    )


@register(
    "n19_span_table_rows",
    "SELECT project_id, op, status, count(*) AS rows, count(*) FILTER (is_segment) AS segments FROM fx_spans GROUP BY ALL",
)
def _(spark, d):
    rows = signals.span_rows(jobs.decode_jobs(span_lines(spark, d)))
    return rows.groupBy("project_id", "op", "status").agg(
        F.count("*").alias("rows"), F.count_if("is_segment").alias("segments")
    )


@register(
    "n20_metric_table_rows",
    "SELECT project_id, name, unit, count(*) AS rows, round(sum(value), 6) AS total FROM fx_metrics GROUP BY ALL",
)
def _(spark, d):
    rows = signals.metric_rows(jobs.decode_jobs(metric_lines(spark, d)))
    return rows.groupBy("project_id", "name", "unit").agg(
        F.count("*").alias("rows"), F.round(F.sum("value"), 6).alias("total")
    )


@register(
    "r7_error_scrub",
    f"""SELECT {UUID.format('event_id + 1')} AS event_id, exception_value || ' [redacted]' AS value, '[redacted]' AS crumb, '[redacted]' AS crumb_password,
  '/cart' AS crumb_url, '[redacted]' AS api_key, 'free' AS plan FROM fx_errors""",
)
def _(spark, d):
    items = signals.error_items(jobs.decode_jobs(error_lines(spark, d)))
    crumb = F.from_json("breadcrumbs", "array<struct<message:string,data:struct<password:string,url:string>>>")[0]
    return items.withColumn("c", crumb).select(
        "event_id",
        F.col("exceptions")[0]["value"].alias("value"),
        F.col("c.message").alias("crumb"),
        F.col("c.data.password").alias("crumb_password"),
        F.col("c.data.url").alias("crumb_url"),
        F.col("tags")["api_key"].alias("api_key"),
        F.col("tags")["plan"].alias("plan"),
    )


@register(
    "r8_signal_scrub",
    """SELECT 'log' AS signal, count(*) AS redacted FROM fx_logs UNION ALL SELECT 'span', count(*) FILTER (db_statement <> '') FROM fx_spans""",
)
def _(spark, d):
    log = signals.log_rows(jobs.decode_jobs(log_lines(spark, d))).filter(
        F.col("body").endswith("[redacted]") & (F.col("attributes")["csrf"] == "[redacted]")
    )
    span = signals.span_rows(jobs.decode_jobs(span_lines(spark, d))).filter(
        F.col("db_statement").endswith("-- [redacted]") & (F.col("tags")["cookie"] == "[redacted]")
    )
    return log.agg(F.lit("log").alias("signal"), F.count("*").alias("redacted")).unionByName(
        span.agg(F.lit("span").alias("signal"), F.count("*").alias("redacted"))
    )


# --- sources and sinks ------------------------------------------------------------------------------


def _all_lines(spark, d):
    return (
        error_lines(spark, d)
        .unionByName(log_lines(spark, d))
        .unionByName(span_lines(spark, d))
        .unionByName(metric_lines(spark, d))
    )


@register(
    "s1_decode_jobs",
    """SELECT 'error' AS type, project_id, count(*) AS jobs, max(timestamp) + INTERVAL 5 SECOND AS received FROM fx_errors GROUP BY ALL
UNION ALL SELECT 'log', project_id, count(*), max(timestamp) + INTERVAL 5 SECOND FROM fx_logs GROUP BY ALL
UNION ALL SELECT 'span', project_id, count(*), max(timestamp) + INTERVAL 5 SECOND FROM fx_spans GROUP BY ALL
UNION ALL SELECT 'metric', project_id, count(*), max(timestamp) + INTERVAL 5 SECOND FROM fx_metrics GROUP BY ALL""",
)
def _(spark, d):
    rows = jobs.decode_jobs(_all_lines(spark, d))
    return rows.groupBy("type", "project_id").agg(
        F.count("*").alias("jobs"), F.max("received_at").cast("timestamp_ntz").alias("received")
    )


DOC_ENVELOPE = """concat('{"sent_at":"2024-01-01T00:00:00Z","sdk":{"name":"js","version":"1"}}', chr(10),
  '{"type":"log","length":', octet_length(text), '}', chr(10), text, chr(10),
  '{"type":"mystery","length":', octet_length(source), '}', chr(10), source, chr(10), chr(10),
  '{"type":"error","length":', octet_length(lang), '}', chr(10), lang)"""


def _doc_envelopes(spark, d):
    """One envelope per document: its whole text, an item of an unknown type, and a last item without newline."""
    return table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("path"), F.encode(F.expr(DOC_ENVELOPE), "UTF-8").alias("content")
    )


@register(
    "s2_envelopes",
    """SELECT CAST(doc_id AS STRING) AS path, 0 AS idx, 'log' AS type, md5(text) AS digest, 1 AS skipped FROM documents
UNION ALL SELECT CAST(doc_id AS STRING), 1, 'error', md5(lang), 1 FROM documents""",
)
def _(spark, d):
    items = envelopes.parse_envelopes(_doc_envelopes(spark, d))
    return items.select("path", "idx", "type", F.md5("payload").alias("digest"), "skipped")


@F.pandas_udf(T.BinaryType())
def _gzip(content: pd.Series) -> pd.Series:
    return content.map(lambda c: gzip.compress(bytes(c)))


@register(
    "s3_gzip_envelopes",
    """SELECT CAST(doc_id AS STRING) AS path, CASE WHEN doc_id % 3 = 2 THEN 'encoding ''br'' is not supported' ELSE '' END AS error,
  CASE WHEN doc_id % 3 = 2 THEN '' ELSE md5(text) END AS digest FROM documents""",
)
def _(spark, d):
    """Compressed envelopes, told by their first bytes or by the declared encoding."""
    kind = F.col("path").cast("long") % 3
    encoding = F.when(kind == 1, "gzip").when(kind == 2, "br")
    files = _doc_envelopes(spark, d).select("path", _gzip("content").alias("content"), encoding.alias("encoding"))
    items = envelopes.parse_envelopes(files).filter("idx = 0 OR error IS NOT NULL")
    return items.select(
        "path", F.coalesce("error", F.lit("")).alias("error"),
        F.when(F.col("error").isNull(), F.md5("payload")).otherwise("").alias("digest"),
    )


@register(
    "s2_broken_envelopes",
    """SELECT doc_id % 3 AS kind, CASE doc_id % 3 WHEN 0 THEN 'item 1: body ends inside the payload' WHEN 1 THEN 'empty body' ELSE 'item 0: bad length' END AS error,
  count(*) AS envelopes FROM documents GROUP BY ALL""",
)
def _(spark, d):
    text = F.expr(DOC_ENVELOPE)
    kind = F.col("doc_id") % 3
    broken = (
        F.when(kind == 0, F.expr(f"left({DOC_ENVELOPE}, length({DOC_ENVELOPE}) - 1)"))
        .when(kind == 1, F.lit(""))
        .otherwise(F.replace(text, F.lit('"length":'), F.lit('"length":-')))
    )
    files = table(spark, d, "documents").select(
        F.concat_ws("/", kind.cast("string"), F.col("doc_id").cast("string")).alias("path"),
        F.encode(broken, "UTF-8").alias("content"),
    )
    items = envelopes.parse_envelopes(files)
    return items.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).cast("long").alias("kind"), "error").agg(
        F.count("*").alias("envelopes")
    )


@register(
    "s6_rejected_jobs",
    """SELECT CASE event_type WHEN 'click' THEN 'no project' WHEN 'view' THEN 'unknown type' WHEN 'signup' THEN 'no receive time' ELSE 'not readable' END AS reason,
  count(*) AS lines FROM events WHERE event_type <> 'error' GROUP BY ALL""",
)
def _(spark, d):
    kind = F.col("event_type")
    line = F.to_json(
        F.struct(
            F.when(kind == "click", 0).otherwise(4).alias("project_id"),
            F.when(kind == "view", "mystery").otherwise("log").alias("type"),
            F.struct(F.col("props").alias("body")).alias("payload"),
            F.when(kind != "signup", _stamp("ts")).alias("received_at"),
        )
    )
    line = F.when(kind == "purchase", F.expr("left(props, 4)")).otherwise(line)
    lines = table(spark, d, "events").select(line.alias("value"))
    return jobs.rejected_jobs(lines).groupBy("reason").agg(F.count("*").alias("lines"))


@register(
    "s6_unreadable_payloads",
    "SELECT event_type, count(*) AS parked FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL",
)
def _(spark, d):
    """Payloads of the wrong shape are parked, the others decode."""
    kind = F.col("event_type")
    payload = F.when(kind == "view", F.lit('{"body": ')).when(kind == "click", F.lit("[1, 2]")).otherwise(F.col("props"))
    rows = table(spark, d, "events").select("event_type", F.lit("log").alias("type"), payload.alias("payload"))
    _, parked = signals.read_payload(rows, "log", schemas.LOG_PAYLOAD)
    return parked.groupBy("event_type").agg(F.count("*").alias("parked"))


@register(
    "s8_ingest_keys",
    """SELECT o_orderkey, c_nationkey AS project_id, n_name AS project FROM orders JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal >= 0""",
)
def _(spark, d):
    """Customers as ingest keys (overdrawn ones are revoked), nations as projects, orders as items."""
    keys = table(spark, d, "customer").select(
        F.col("c_name").alias("public_key"),
        F.col("c_nationkey").alias("project_id"),
        F.when(F.col("c_acctbal") < 0, F.lit("2024-01-01")).alias("revoked_at"),
    )
    projects = table(spark, d, "nation").select(
        F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("project")
    )
    items = table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("public_key")
    )
    matched, _rejected = control.resolve_keys(items, keys, projects)
    return matched.select("o_orderkey", "project_id", "project")


def _uploads(spark, d):
    return table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 25).alias("project_id"),
        F.concat(F.lit("v"), F.col("l_suppkey").cast("string")).alias("version"),
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.concat("l_returnflag", F.col("l_orderkey").cast("string"))).alias("ref"),
        F.concat(F.lit("~/js/"), F.col("l_linenumber").cast("string"), F.lit(".js")).alias("url_pattern"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("artifact_key"),
        F.col("l_partkey").alias("size_bytes"),
        F.col("l_linestatus").alias("checksum"),
        F.concat(F.date_format("l_shipdate", "yyyyMMdd"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0")).alias("uploaded_at"),
    )


UPLOADS = """up AS (SELECT l_suppkey % 25 AS project_id, 'v' || l_suppkey AS version, CASE l_returnflag WHEN 'N' THEN '' ELSE l_returnflag || l_orderkey END AS ref,
  '~/js/' || l_linenumber || '.js' AS url_pattern, l_orderkey || '-' || l_partkey AS artifact_key, l_partkey AS size_bytes, l_linestatus AS checksum,
  strftime(l_shipdate, '%Y%m%d') || lpad(CAST(l_orderkey AS STRING), 12, '0') AS uploaded_at FROM lineitem)"""


@register(
    "s9_release_files",
    f"""WITH {UPLOADS} SELECT project_id, version, url_pattern, artifact_key, size_bytes, checksum FROM up
QUALIFY row_number() OVER (PARTITION BY project_id, version, url_pattern ORDER BY uploaded_at DESC, artifact_key DESC, size_bytes DESC, checksum DESC) = 1""",
)
def _(spark, d):
    return control.fold_release_files(_uploads(spark, d))


@register(
    "s9_releases",
    f"""WITH {UPLOADS} SELECT project_id, version, count(*) FILTER (ref <> '') > 0 AS named,
  coalesce(substr(max(uploaded_at || ref) FILTER (ref <> ''), 1, 20), '') AS named_at FROM up GROUP BY ALL""",
)
def _(spark, d):
    uploads = _uploads(spark, d)
    named = uploads.filter("ref <> ''").groupBy("project_id", "version", "ref").agg(F.max("uploaded_at").alias("named_at"))
    rows = control.fold_releases(uploads).join(named, ["project_id", "version", "ref"], "left")
    return rows.select(
        "project_id", "version", (F.col("ref") != "").alias("named"), F.coalesce("named_at", F.lit("")).alias("named_at")
    )


@register(
    "j3_files_of_releases",
    f"""WITH {UPLOADS}, f AS (SELECT DISTINCT project_id, version, url_pattern FROM up)
SELECT project_id, count(*) AS files FROM f GROUP BY ALL""",
)
def _(spark, d):
    uploads = _uploads(spark, d)
    joined = control.files_of_releases(control.fold_release_files(uploads), control.fold_releases(uploads))
    return joined.groupBy("project_id").agg(F.count("*").alias("files"))


# --- tables ------------------------------------------------------------------------------------------


def _log_table(spark, d, label):
    """All log rows written to a day-partitioned table; returns its path."""
    path = work_dir(spark, label)
    rows = logs(spark, d).select("project_id", "timestamp", "severity", "service", "body")
    tables.append(rows, path, "logs", conform=False)
    return path


PER_DAY = "SELECT project_id, CAST(timestamp AS DATE) AS day, count(*) AS rows FROM fx_logs {where} GROUP BY ALL"


def _per_day(spark, path):
    return tables.read(spark, path).groupBy("project_id", "day").agg(F.count("*").alias("rows"))


@register("s4_write_logs", PER_DAY.format(where=""))
def _(spark, d):
    return _per_day(spark, _log_table(spark, d, "s4"))


def _appended(spark, rows, name, label, writes=2):
    """Rows of the job lines appended in some writes to the table of their signal, read back."""
    path = work_dir(spark, label)
    for i in range(writes):
        tables.append(rows.filter(F.pmod(F.xxhash64("timestamp"), F.lit(writes)) == i), path, name)
    return tables.read(spark, path)


@register(
    "s4_write_errors",
    f"""SELECT project_id, CAST({STAMPED} AS DATE) AS day, {ENV} AS environment, count(*) AS rows, count(DISTINCT event_id) AS events,
  CAST(sum(length(exception_value || ' [redacted]')) AS BIGINT) AS chars FROM fx_errors GROUP BY ALL""",
)
def _(spark, d):
    return _appended(spark, _error_rows(spark, d), "errors", "s4e").groupBy("project_id", "day", "environment").agg(
        F.count("*").alias("rows"), F.count_distinct("event_id").alias("events"), F.sum(F.length("exception_value")).alias("chars")
    )


@register(
    "s4_write_spans",
    f"""SELECT project_id, CAST(date_trunc('month', {STAMPED}) AS DATE) AS month, op, count(*) AS rows,
  CAST(sum(trunc(duration_ns / 1e6 * 1e6)) AS BIGINT) AS total_ns FROM fx_spans GROUP BY ALL""",
)
def _(spark, d):
    rows = _appended(spark, signals.span_rows(jobs.decode_jobs(span_lines(spark, d))), "spans", "s4s", 1)
    return rows.groupBy("project_id", F.trunc("day", "month").alias("month"), "op").agg(
        F.count("*").alias("rows"), F.sum("duration_ns").alias("total_ns")
    )


@register(
    "s4_write_metrics",
    f"""SELECT project_id, CAST({STAMPED} AS DATE) AS day, name, count(*) AS rows, min(value) AS least, max(value) AS most,
  count(page) AS tagged FROM fx_metrics GROUP BY ALL""",
)
def _(spark, d):
    rows = _appended(spark, signals.metric_rows(jobs.decode_jobs(metric_lines(spark, d))), "metrics_raw", "s4m")
    return rows.groupBy("project_id", "day", "name").agg(
        F.count("*").alias("rows"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.count(F.col("tags")["page"]).alias("tagged"),
    )


@register("d1_retention", PER_DAY.format(where="WHERE timestamp >= TIMESTAMP '2024-01-15'"))
def _(spark, d):
    path = _log_table(spark, d, "d1")
    tables.apply_retention(spark, path, "logs", date(2024, 2, 14))
    return _per_day(spark, path)


@register("d2_purge_project", PER_DAY.format(where="WHERE project_id <> 2"))
def _(spark, d):
    path = _log_table(spark, d, "d2")
    tables.purge_project(spark, path, "logs", 2)
    return _per_day(spark, path)


@register(
    "d3_spans_by_trace",
    """SELECT project_id, trace_id, count(*) AS spans, CAST(sum(duration_ns) AS BIGINT) AS total_ns FROM fx_spans GROUP BY ALL""",
)
def _(spark, d):
    path = work_dir(spark, "d3")
    # The spans cover ten years; month partitions keep their files from being tiny.
    tables.write_by_trace(spans(spark, d), path, "month")
    return (
        tables.read(spark, path)
        .groupBy("project_id", "trace_id")
        .agg(F.count("*").alias("spans"), F.sum("duration_ns").alias("total_ns"))
    )


# --- hook and sampling ---------------------------------------------------------------------------------


@register(
    "u1_event_hook",
    "SELECT event_id, level, 'v-' || release AS release FROM fx_errors WHERE level <> 'warning'",
)
def _(spark, d):
    def hook(df):
        return df.filter("level <> 'warning'").withColumn("release", F.concat(F.lit("v-"), "release"))

    return signals.apply_hook(errors(spark, d), hook).select("event_id", "level", "release")


@register("u2_sample_counts", "SELECT project_id, count(*) AS total, true AS near_rate FROM fx_logs GROUP BY ALL")
def _(spark, d):
    """Kept plus discarded is everything, and the kept share is near the rate."""
    kept, discarded = signals.sample(logs(spark, d), 0.25)
    counts = kept.groupBy("project_id").agg(F.count("*").alias("kept"))
    both = counts.join(discarded, "project_id")
    total = F.col("kept") + F.col("discarded")
    return both.select(
        "project_id", total.alias("total"), (F.abs(F.col("kept") / total - 0.25) < 0.06).alias("near_rate")
    )
