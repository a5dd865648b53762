"""Lists, lookups and pages over the event tables.

Pages are keyset pages: the last sort key of a page bounds the next one, so no page costs
more than the first.  Every list takes the rows selected by `functions.search.search`.
"""

from __future__ import annotations

import base64
import binascii
import json
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from signalfold.scale import clamp, in_window, scoped, time_literal, top_per_project, utc

MAX_LOGS = 500
MAX_EVENTS = 200
MAX_TRACES = 200
MAX_TRACE_SPANS = 2000
MAX_METRIC_NAMES = 500


# --- page cursor -----------------------------------------------------------------------


def encode_cursor(key: Mapping | None) -> str:
    """Opaque token of a sort key; no further page is the empty string."""
    if key is None:
        return ""
    plain = {
        k: utc(v).isoformat(timespec="microseconds") + "Z" if isinstance(v, datetime) else v
        for k, v in key.items()
    }
    token = base64.urlsafe_b64encode(json.dumps(plain, separators=(",", ":")).encode())
    return token.decode().rstrip("=")


def decode_cursor(token: str) -> dict | None:
    """The sort key of a token; empty means the first page, damage is an error."""
    if not token:
        return None
    try:
        raw = base64.b64decode(token + "=" * (-len(token) % 4), altchars=b"-_", validate=True)
        key = json.loads(raw)
    except (binascii.Error, ValueError) as error:
        raise ValueError(f"bad page token: {error}") from None
    if not isinstance(key, dict):
        raise ValueError("bad page token: not an object")
    return key


def after_cursor(df: DataFrame, columns: Sequence[str], cursor: Mapping | None) -> DataFrame:
    """Rows strictly behind the cursor in descending order of the columns."""
    if cursor is None:
        return df

    def literal(name: str) -> Column:
        value = cursor[name]
        is_time = df.schema[name].dataType.typeName().startswith("timestamp")
        return time_literal(df, name, value) if is_time else F.lit(value)

    behind = F.lit(False)
    for depth in range(len(columns), 0, -1):
        name = columns[depth - 1]
        step = F.col(name) < literal(name)
        for equal in columns[: depth - 1]:
            step = step & (F.col(equal) == literal(equal))
        behind = behind | step
    # The plain bound on the first column is implied, and is what the file scan can use.
    return df.filter(F.col(columns[0]) <= literal(columns[0])).filter(behind)


def newest(
    df: DataFrame,
    columns: Sequence[str],
    limit: int,
    cursor: Mapping | None = None,
    per_project: bool = False,
) -> DataFrame:
    """Newest rows first, with one row more than the page to tell whether another follows."""
    order = [F.col(c).desc() for c in columns]
    rows = after_cursor(df, columns, cursor)
    if per_project:
        return top_per_project(rows, order, limit)
    return rows.orderBy(*order).limit(limit + 1)


def take_page(page: DataFrame, columns: Sequence[str], limit: int) -> tuple[list[Row], str]:
    """Bring one page (at most `limit` + 1 rows) to the caller with the token of the next."""
    rows = page.take(limit + 1)
    more = len(rows) > limit
    rows = rows[:limit]
    key = {c: rows[-1][c] for c in columns} if more else None
    return rows, encode_cursor(key)


# --- logs, events, traces ----------------------------------------------------------------

LOG_ORDER = ("timestamp", "event_id")
EVENT_ORDER = ("timestamp", "event_id")
TRACE_ORDER = ("timestamp", "trace_id", "span_id")


def log_order(logs: DataFrame) -> tuple[str, ...]:
    """Nanosecond column first where the table has one, and a tie-breaker where it has one."""
    first = "ts_ns" if "ts_ns" in logs.columns else "timestamp"
    return tuple(c for c in (first, "event_id", "row_id") if c in logs.columns)


def list_logs(logs, limit: int = 100, cursor=None, per_project: bool = False) -> DataFrame:
    return newest(logs, log_order(logs), clamp(limit, MAX_LOGS), cursor, per_project)


def list_events(errors, limit: int = 50, cursor=None, per_project: bool = False) -> DataFrame:
    return newest(errors, EVENT_ORDER, clamp(limit, MAX_EVENTS), cursor, per_project)


def list_traces(spans, limit: int = 50, cursor=None, per_project: bool = False) -> DataFrame:
    """Segment spans (one per service slice of a trace), newest first."""
    segments = spans.filter("is_segment").select(
        "project_id",
        "trace_id",
        "span_id",
        "name",
        "op",
        "service",
        "timestamp",
        "duration_ns",
        "status",
        "http_status",
    )
    return newest(segments, TRACE_ORDER, clamp(limit, MAX_TRACES), cursor, per_project)


def logs_of_traces(logs: DataFrame, traces: DataFrame, limit: int = MAX_LOGS) -> DataFrame:
    """Logs of each given (project_id, trace_id), oldest first; nil traces never match."""
    wanted = drop_nil_traces(traces).select("project_id", "trace_id").distinct()
    found = logs.join(wanted, ["project_id", "trace_id"], "left_semi")
    order = Window.partitionBy("project_id", "trace_id").orderBy(*log_order(logs))
    return found.withColumn("position", F.row_number().over(order)).filter(
        F.col("position") <= clamp(limit, MAX_LOGS)
    )


def waterfall(spans: DataFrame, traces: DataFrame | None = None, limit: int | None = MAX_TRACE_SPANS) -> DataFrame:
    """Spans of each trace in start order with their position, 2000 per trace unless told otherwise; None gives all."""
    if traces is not None:
        wanted = drop_nil_traces(traces).select("project_id", "trace_id").distinct()
        spans = spans.join(wanted, ["project_id", "trace_id"], "left_semi")
    order = Window.partitionBy("project_id", "trace_id").orderBy(
        "timestamp", "span_id", "name", "duration_ns"
    )
    ranked = spans.withColumn("position", F.row_number().over(order))
    return ranked if limit is None else ranked.filter(F.col("position") <= limit)


def tail_logs(logs: DataFrame, after, limit: int = MAX_LOGS, project_id=None) -> DataFrame:
    """Log lines strictly after a time, oldest first."""
    rows = scoped(logs, project_id).filter(
        F.col("timestamp") > time_literal(logs, "timestamp", after)
    )
    order = [F.col(c).asc() for c in log_order(logs)]
    if project_id is None:
        return top_per_project(rows, order, clamp(limit, MAX_LOGS))
    return rows.orderBy(*order).limit(clamp(limit, MAX_LOGS))


def latest_event(errors: DataFrame) -> DataFrame:
    """The newest occurrence of every group; ties go to the larger event id."""
    columns = [c for c in errors.columns if c not in ("project_id", "group_hash")]
    return (
        errors.groupBy("project_id", "group_hash")
        .agg(F.max_by(F.struct(*columns), F.struct("timestamp", "event_id")).alias("_e"))
        .select("project_id", "group_hash", "_e.*")
    )


def matching_groups(errors: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct groups with a matching occurrence.  Without a limit, fit for a semi-join."""
    groups = errors.select("project_id", "group_hash").distinct()
    return groups if limit is None else groups.limit(clamp(limit, 1000))


def count_rows(df: DataFrame) -> DataFrame:
    return df.groupBy("project_id").agg(F.count("*").alias("count"))


# --- environments, metric catalogue, traces across signals ---------------------------------


def environments(
    errors: DataFrame, logs: DataFrame, spans: DataFrame, since, project_id: int | None = None
) -> DataFrame:
    """Named environments of each project; production ranks first, the rest by name."""
    parts = [
        scoped(df, project_id, "", since)
        .filter("environment <> ''")
        .select("project_id", "environment")
        .distinct()
        for df in (errors, logs, spans)
    ]
    names = parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()
    order = Window.partitionBy("project_id").orderBy(
        F.col("environment") != "production", "environment"
    )
    return names.withColumn("position", F.row_number().over(order))


def metric_catalogue(metrics: DataFrame, limit: int = MAX_METRIC_NAMES) -> DataFrame:
    """Each metric name with its type, unit and tag keys."""
    # Distinct keys first: the list collected per name holds keys, never rows.
    keys = (
        metrics.select("project_id", "name", "type", "unit", F.map_keys("tags").alias("_keys"))
        .distinct()
        .select("project_id", "name", "type", "unit", F.explode_outer("_keys").alias("_key"))
        .distinct()
    )
    names = keys.groupBy("project_id", "name").agg(
        F.min("type").alias("type"),
        F.min("unit").alias("unit"),
        F.array_sort(F.collect_set("_key")).alias("tags"),
    )
    return top_per_project(names, [F.col("name")], clamp(limit, MAX_METRIC_NAMES))


NIL_UUID = "00000000-0000-0000-0000-000000000000"


def drop_nil_traces(df: DataFrame) -> DataFrame:
    """Rows without a trace must not meet each other in a join."""
    if df.schema["trace_id"].dataType.typeName() == "string":
        return df.filter((F.col("trace_id") != NIL_UUID) & (F.col("trace_id") != ""))
    return df.filter(F.col("trace_id").isNotNull())


def signals_by_trace(
    errors: DataFrame, logs: DataFrame, spans: DataFrame, start=None, end=None
) -> DataFrame:
    """Per trace: how many errors, logs and spans share it.

    Each signal is reduced to one row per trace before the rows meet, so a trace that
    holds a large share of all rows costs no more than any other.
    """

    def reduced(df: DataFrame, signal: str) -> DataFrame:
        rows = drop_nil_traces(in_window(df, start, end))
        return rows.groupBy("project_id", "trace_id").agg(
            *[F.count("*" if name == signal else F.lit(None)).alias(name) for name in names]
        )

    names = ("errors", "logs", "spans")
    parts = [reduced(df, name) for df, name in zip((errors, logs, spans), names, strict=True)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("project_id", "trace_id").agg(*[F.sum(n).alias(n) for n in names])
