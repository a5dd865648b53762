"""Registered queries for the search filter (F1-F14), lists (L1-L12) and trace joins (J2, J7)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from signalfold.functions.search import search, time_range
from signalfold.operators import listing
from signalfold.plans.adapters import errors, logs, metrics, spans
from signalfold.plans.registry import register
from signalfold.scale import work_dir
from signalfold.sources import tables

NOW = datetime(2024, 1, 31)
ERROR_COLUMNS = ["project_id", "event_id", "level", "release"]
LOG_COLUMNS = ["project_id", "event_id", "severity_number", "service"]
SPAN_COLUMNS = ["trace_id", "span_id", "duration_ns", "status"]


def _tagged_errors(spark, d):
    """Error rows with tags: `module` on every row, `func` only where the user is known."""
    tags = F.when(
        F.col("user_id") != "", F.create_map(F.lit("module"), "module", F.lit("func"), "func")
    ).otherwise(F.create_map(F.lit("module"), "module"))
    return errors(spark, d).withColumn("tags", tags)


FUNC_TAG = "(CASE WHEN user_id <> '' THEN func ELSE '' END)"

# name -> (signal, search text, SQL condition)
SEARCHES = {
    "f2_equality": ("errors", "level:error release:web@1.1", "level = 'error' AND release = 'web@1.1'"),
    "f2_not_equal_bang": ("errors", "!browser:Safari", "browser <> 'Safari'"),
    "f2_not_equal_dash": ("errors", "-browser:Safari", "browser <> 'Safari'"),
    "f3_duration_above": ("spans", "duration:>400ms", "duration_ns > 400000000"),
    "f3_number_at_least": ("spans", "http.status:>=499 op:http.server", "http_status >= 499 AND op = 'http.server'"),
    "f4_negated_ordering": ("spans", "!duration:>400ms", "NOT (duration_ns > 400000000)"),
    "f5_map_key": ("errors", "tags.module:app/m3", "module = 'app/m3'"),
    "f5_unknown_field_is_tag": ("errors", "func:fn2", f"{FUNC_TAG} = 'fn2'"),
    "f5_missing_key_differs": ("errors", "!func:fn2", f"{FUNC_TAG} <> 'fn2'"),
    "f5_declared_dotted_field": ("errors", "user.id:17", "user_id = '17'"),
    "f6_free_text": ("errors", "level:error NOT Found m2.js", "level = 'error' AND contains(lower(exception_value), 'not') AND contains(lower(exception_value), 'found') AND contains(lower(exception_value), 'm2.js')"),
    "f6_free_text_any_column": ("errors", "FN3(", "contains(lower(exception_value), 'fn3(') OR contains(lower(culprit), 'fn3(')"),
    "f7_duration_units": ("spans", "duration:>=0.2s duration:<=300000us", "duration_ns >= 200000000 AND duration_ns <= 300000000"),
    "f8_absolute_time": ("logs", 'timestamp:>=2024-01-15 timestamp:<"2024-01-20"', None),
    "f8_relative_time": ("logs", "timestamp:>-36h", "timestamp > TIMESTAMP '2024-01-29 12:00:00'"),
    "f9_severity_at_least": ("logs", "severity:>=warn", "severity_number >= 13"),
    "f9_severity_alias": ("logs", "level:err", "severity_number = 17"),
    "f9_severity_below": ("logs", "severity:<info service:svc1", "severity_number < 9 AND service = 'svc1'"),
    "f10_quoted_value": ("errors", 'value:"user 17 not found in /srv/app/m2.js"', "exception_value = 'user 17 not found in /srv/app/m2.js'"),
    "f10_colon_in_value": ("spans", 'http.route:"/orders/:id" name:"GET /orders/1-URGENT"', "http_route = '/orders/:id' AND name = 'GET /orders/1-URGENT'"),
    "f11_blank_matches_all": ("spans", "", "true"),
}
del SEARCHES["f8_absolute_time"]
SEARCHES["f8_absolute_time"] = (
    "logs",
    "timestamp:>=2024-01-15 timestamp:<2024-01-20T06:30:00Z",
    "timestamp >= TIMESTAMP '2024-01-15' AND timestamp < TIMESTAMP '2024-01-20 06:30:00'",
)
COLUMNS = {"errors": ERROR_COLUMNS, "logs": LOG_COLUMNS, "spans": SPAN_COLUMNS}
LOADERS = {"errors": _tagged_errors, "logs": logs, "spans": spans}

for _name, (_signal, _text, _condition) in SEARCHES.items():

    @register(
        _name, f"SELECT {', '.join(COLUMNS[_signal])} FROM fx_{_signal} WHERE {_condition}"
    )
    def _(spark, d, signal=_signal, text=_text):
        return search(LOADERS[signal](spark, d), signal, text, now=NOW).select(COLUMNS[signal])


@register(
    "f1_time_scope",
    """SELECT project_id, event_id, level, release FROM fx_errors
WHERE timestamp >= TIMESTAMP '2024-01-10' AND timestamp < TIMESTAMP '2024-01-20'""",
)
def _(spark, d):
    return search(errors(spark, d), "errors", "", start="2024-01-10", end="2024-01-20").select(
        ERROR_COLUMNS
    )


@register(
    "f13_environment",
    "SELECT project_id, event_id, level, release FROM fx_errors WHERE environment = 'staging'",
)
def _(spark, d):
    return search(errors(spark, d), "errors", environment="staging").select(ERROR_COLUMNS)


@register(
    "f14_default_range",
    """SELECT project_id, event_id, severity_number, service FROM fx_logs
WHERE timestamp >= TIMESTAMP '2024-01-17' AND timestamp < TIMESTAMP '2024-01-31'""",
)
def _(spark, d):
    start, end = time_range(NOW)
    return search(logs(spark, d), "logs", start=start, end=end).select(LOG_COLUMNS)


# --- lists ---------------------------------------------------------------------------------


@register(
    "l1_search_logs",
    """SELECT * FROM fx_logs
QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY timestamp DESC, event_id DESC) <= 500""",
)
def _(spark, d):
    return listing.list_logs(logs(spark, d), 500, per_project=True)


@register(
    "l1_search_logs_next_page",
    """SELECT project_id, event_id, timestamp, body FROM fx_logs
WHERE severity_number >= 13 AND timestamp < TIMESTAMP '2024-01-15'
ORDER BY timestamp DESC, event_id DESC LIMIT 101""",
)
def _(spark, d):
    rows = search(logs(spark, d), "logs", "severity:>=warn")
    page = listing.list_logs(rows, 100, {"timestamp": "2024-01-15", "event_id": -1})
    return page.select("project_id", "event_id", "timestamp", "body")


@register(
    "l2_logs_of_traces",
    """SELECT *, row_number() OVER (PARTITION BY project_id, trace_id ORDER BY timestamp, event_id) AS position FROM fx_logs
WHERE (project_id, trace_id) IN (SELECT (project_id, trace_id) FROM fx_errors WHERE level = 'fatal')
QUALIFY position <= 500""",
)
def _(spark, d):
    fatal = search(errors(spark, d), "errors", "level:fatal")
    return listing.logs_of_traces(logs(spark, d), fatal)


@register(
    "l3_tail_logs",
    """SELECT * FROM fx_logs WHERE timestamp > TIMESTAMP '2024-01-20'
QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY timestamp, event_id) <= 500""",
)
def _(spark, d):
    return listing.tail_logs(logs(spark, d), "2024-01-20")


@register(
    "l4_search_events",
    """SELECT project_id, event_id, timestamp, exception_value FROM fx_errors WHERE level <> 'warning'
QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY timestamp DESC, event_id DESC) <= 200""",
)
def _(spark, d):
    rows = search(errors(spark, d), "errors", "!level:warning")
    return listing.list_events(rows, 200, per_project=True).select(
        "project_id", "event_id", "timestamp", "exception_value"
    )


@register(
    "l5_latest_event",
    """SELECT project_id, exception_type || '|' || module || '|' || func AS group_hash, event_id, timestamp, level, exception_value
FROM fx_errors QUALIFY row_number() OVER (PARTITION BY project_id, exception_type, module, func ORDER BY timestamp DESC, event_id DESC) = 1""",
)
def _(spark, d):
    rows = errors(spark, d).select(
        "project_id", "group_hash", "event_id", "timestamp", "level", "exception_value"
    )
    return listing.latest_event(rows)


@register(
    "l6_matching_groups",
    """SELECT DISTINCT project_id, exception_type || '|' || module || '|' || func AS group_hash FROM fx_errors
WHERE level = 'fatal' AND browser = 'Chrome'""",
)
def _(spark, d):
    return listing.matching_groups(search(errors(spark, d), "errors", "level:fatal browser:Chrome"))


@register(
    "j2_issues_with_matching_events",
    """WITH issues AS (SELECT project_id, exception_type || '|' || module || '|' || func AS group_hash, count(*) AS times_seen FROM fx_errors GROUP BY ALL)
SELECT * FROM issues WHERE (project_id, group_hash) IN (
  SELECT (project_id, exception_type || '|' || module || '|' || func) FROM fx_errors WHERE level = 'fatal' AND browser = 'Chrome')""",
)
def _(spark, d):
    occurrences = errors(spark, d)
    issues = occurrences.groupBy("project_id", "group_hash").agg(F.count("*").alias("times_seen"))
    hits = listing.matching_groups(search(occurrences, "errors", "level:fatal browser:Chrome"))
    return issues.join(hits, ["project_id", "group_hash"], "left_semi")


@register(
    "l7_search_traces",
    """SELECT project_id, trace_id, span_id, name, op, service, timestamp, duration_ns, status, http_status FROM fx_spans
WHERE is_segment AND status = 'error'
QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY timestamp DESC, trace_id DESC, span_id DESC) <= 200""",
)
def _(spark, d):
    return listing.list_traces(search(spans(spark, d), "spans", "status:error"), 200, per_project=True)


@register(
    "l8_waterfall",
    """SELECT project_id, trace_id, span_id, parent_span_id, name, timestamp, duration_ns,
  row_number() OVER (PARTITION BY project_id, trace_id ORDER BY timestamp, span_id, name, duration_ns) AS position
FROM fx_spans QUALIFY position <= 2000""",
)
def _(spark, d):
    rows = spans(spark, d).select(
        "project_id", "trace_id", "span_id", "parent_span_id", "name", "timestamp", "duration_ns"
    )
    return listing.waterfall(rows)


def _by_trace(spark, rows, label):
    """Rows in the layout by trace, as a table of its own."""
    path = work_dir(spark, label)
    return tables.write_trace_buckets(rows, f"traces_{path.rsplit('-', 1)[1]}", path)


@register(
    "l8_waterfall_by_trace",
    """SELECT project_id, trace_id, span_id, parent_span_id, name, timestamp, duration_ns,
  row_number() OVER (PARTITION BY project_id, trace_id ORDER BY timestamp, span_id, name, duration_ns) AS position
FROM fx_spans QUALIFY position <= 2000""",
)
def _(spark, d):
    """The waterfall of all traces from the layout by trace, without a shuffle."""
    rows = spans(spark, d).select(
        "project_id", "trace_id", "span_id", "parent_span_id", "name", "timestamp", "duration_ns"
    )
    return listing.waterfall(_by_trace(spark, rows, "l8"))


for _signal, _text, _condition in (
    ("logs", "severity:>=warn", "severity_number >= 13"),
    ("errors", "level:error", "level = 'error'"),
    ("spans", "status:error", "is_segment AND status = 'error'"),
):

    @register(
        f"l9_count_{_signal}",
        f"SELECT project_id, count(*) AS count FROM fx_{_signal} WHERE {_condition} GROUP BY project_id",
    )
    def _(spark, d, signal=_signal, text=_text):
        rows = search(LOADERS[signal](spark, d), signal, text)
        return listing.count_rows(rows.filter("is_segment") if signal == "spans" else rows)


@register(
    "l10_cursor_page",
    """SELECT project_id, event_id, timestamp FROM (
  SELECT *, row_number() OVER (ORDER BY timestamp DESC, event_id DESC) AS rk FROM fx_errors)
WHERE rk BETWEEN 51 AND 101""",
)
def _(spark, d):
    rows = errors(spark, d).select("project_id", "event_id", "timestamp")
    _, token = listing.take_page(listing.list_events(rows, 50), listing.EVENT_ORDER, 50)
    return listing.list_events(rows, 50, listing.decode_cursor(token))


@register(
    "l11_environments",
    """WITH e AS (
  SELECT project_id, environment FROM fx_errors WHERE timestamp >= TIMESTAMP '1990-01-01'
  UNION SELECT project_id, environment FROM fx_logs WHERE timestamp >= TIMESTAMP '1990-01-01'
  UNION SELECT project_id, environment FROM fx_spans WHERE timestamp >= TIMESTAMP '1990-01-01')
SELECT project_id, environment, row_number() OVER (PARTITION BY project_id ORDER BY environment <> 'production', environment) AS position
FROM e WHERE environment <> ''""",
)
def _(spark, d):
    return listing.environments(errors(spark, d), logs(spark, d), spans(spark, d), "1990-01-01")


@register(
    "l12_metric_catalogue",
    """SELECT project_id, name, min(type) AS type, min(unit) AS unit, CASE WHEN count(page) > 0 THEN 'page' ELSE '' END AS tags
FROM fx_metrics GROUP BY project_id, name""",
)
def _(spark, d):
    return listing.metric_catalogue(metrics(spark, d)).withColumn("tags", F.array_join("tags", ","))


@register(
    "j7_signals_by_trace",
    """WITH u AS (
  SELECT project_id, trace_id, 1 AS e, 0 AS l, 0 AS s FROM fx_errors
  UNION ALL SELECT project_id, trace_id, 0, 1, 0 FROM fx_logs
  UNION ALL SELECT project_id, trace_id, 0, 0, 1 FROM fx_spans)
SELECT project_id, trace_id, CAST(sum(e) AS BIGINT) AS errors, CAST(sum(l) AS BIGINT) AS logs, CAST(sum(s) AS BIGINT) AS spans
FROM u GROUP BY ALL""",
)
def _(spark, d):
    return listing.signals_by_trace(errors(spark, d), logs(spark, d), spans(spark, d))


@register(
    "j7_joined_by_trace",
    """WITH e AS (SELECT trace_id, count(*) AS errors FROM fx_errors GROUP BY ALL), l AS (SELECT trace_id, count(*) AS logs FROM fx_logs GROUP BY ALL)
SELECT s.project_id, s.trace_id, count(*) AS spans, CAST(sum(duration_ns) AS BIGINT) AS total_ns, any_value(coalesce(errors, 0)) AS errors, any_value(coalesce(logs, 0)) AS logs
FROM fx_spans s LEFT JOIN e USING (trace_id) LEFT JOIN l USING (trace_id) GROUP BY s.project_id, s.trace_id""",
)
def _(spark, d):
    """Traces with the errors and logs that share them, joined bucket by bucket from the layouts by trace."""
    parts = {
        name: _by_trace(spark, rows(spark, d).select("project_id", "trace_id", "timestamp", *more), f"j7-{name}")
        for name, rows, more in (("spans", spans, ["duration_ns"]), ("errors", errors, []), ("logs", logs, []))
    }
    traces = parts["spans"].groupBy("project_id", "trace_id").agg(F.count("*").alias("spans"), F.sum("duration_ns").alias("total_ns"))
    for name in ("errors", "logs"):
        counted = parts[name].groupBy("trace_id").agg(F.count("*").alias(name))
        traces = traces.join(counted, "trace_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return traces
