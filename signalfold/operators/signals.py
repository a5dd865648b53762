"""Queued jobs to table rows: decode, normalise, scrub, symbolicate, enrich, fingerprint.

Everything is a narrow plan; the only shuffle is the artifact lookup of symbolication.
Scrubbing comes before any value is stored, fingerprinting after symbolication.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalfold import schemas
from signalfold.functions import grouping, normalize, scrub
from signalfold.functions.enrich import client_from_contexts
from signalfold.functions.text import blank_to_null

CORRUPT = "_corrupt"
JOB_META = ("project_id", "received_at", "sent_at", "sdk", "client_ip")


def read_payload(jobs: DataFrame, kind: str, ddl: str) -> tuple[DataFrame, DataFrame]:
    """(decoded rows of one kind with the payload in `p`, rows whose payload is not readable)."""
    schema = schemas.struct(f"{ddl}, {CORRUPT} string")
    options = {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"}
    rows = jobs.filter(F.col("type") == kind)
    parsed = F.array(F.from_json("payload", schema, options))

    def is_bad(p: Column) -> Column:
        return p.isNull() | p[CORRUPT].isNotNull()

    # As in the job decoder: a generator keeps the parse from being repeated.
    good = F.explode(F.filter(parsed, lambda p: ~is_bad(p)))
    bad = F.explode(F.filter(F.transform(parsed, is_bad), lambda b: b))
    return rows.select("*", good.alias("p")), rows.select("*", bad.alias("_bad")).drop("_bad")


def _meta(time_field: str) -> dict[str, Column]:
    p = F.col("p")
    return {
        "timestamp": normalize.corrected_time(
            normalize.parse_time(p[time_field]), F.col("received_at"), F.col("sent_at")
        ),
        "environment": normalize.environment(p["environment"]),
        "release": normalize.text(p["release"]),
    }


@F.pandas_udf(T.StringType())
def _scrub_breadcrumbs(crumbs: pd.Series, deny: pd.Series, allow: pd.Series) -> pd.Series:
    return pd.Series(
        [scrub.scrub_breadcrumbs_text(c, d, a) for c, d, a in zip(crumbs, deny, allow)],
        dtype=object,
    )


def scrubbed_exceptions(exceptions: Column) -> Column:
    return F.transform(
        exceptions, lambda e: e.withField("value", scrub.scrub_text(normalize.text(e["value"])))
    )


def error_items(jobs: DataFrame, policies: DataFrame | None = None) -> DataFrame:
    """Decoded, normalised and scrubbed errors, one row each, frames not yet symbolicated."""
    rows, _ = read_payload(jobs, "error", schemas.ERROR_PAYLOAD)
    rows = scrub.with_policy(rows, policies)
    p = F.col("p")
    deny, allow = F.col("deny_keys"), F.col("allow_keys")
    given = normalize.parse_uuid(p["event_id"])
    ip = normalize.client_ip(p["user"]["ip_address"], F.col("client_ip"))
    return rows.select(
        *JOB_META,
        F.when(given != normalize.NIL_UUID, given)
        .otherwise(normalize.derived_uuid(F.col("project_id"), F.col("received_at"), F.col("payload")))
        .alias("event_id"),
        *[c.alias(n) for n, c in _meta("timestamp").items()],
        normalize.one_of(p["level"], normalize.LEVELS, "error").alias("level"),
        normalize.text(p["platform"]).alias("platform"),
        normalize.parse_uuid(p["trace_id"]).alias("trace_id"),
        normalize.parse_span_id(p["span_id"]).alias("span_id"),
        normalize.text(p["user"]["id"]).alias("user_id"),
        normalize.text(p["user"]["email"]).alias("user_email"),
        scrub.apply_ip_policy(ip, F.col("truncate_ip"), F.col("drop_ip")).alias("user_ip"),
        F.coalesce(scrub.scrub_map(p["tags"], deny, allow), schemas.empty_map()).alias("tags"),
        scrubbed_exceptions(p["exception"]).alias("exceptions"),
        scrub.scrub_text(normalize.text(p["message"])).alias("message"),
        _scrub_breadcrumbs(p["breadcrumbs"], deny, allow).alias("breadcrumbs"),
        scrub.scrub_json(p["contexts"], deny, allow).alias("contexts"),
        p["fingerprint"].alias("fingerprint"),
    )


def error_rows(items: DataFrame, exact_hash: bool = False) -> DataFrame:
    """Error items (symbolicated or not) as rows of the errors table plus title and components."""
    exceptions, message = F.col("exceptions"), F.col("message")
    last = normalize.last_exception(exceptions)
    browser, os = client_from_contexts(F.col("contexts"))
    print_ = grouping.fingerprint(exceptions, message, F.col("fingerprint"))
    return (
        items.withColumn("_print", print_)
        .withColumns(
            {
                "group_hash": grouping.group_hash(F.col("_print.components"), exact_hash),
                "method": F.col("_print.method"),
                "components": F.col("_print.components"),
                "title": normalize.title(exceptions, message),
                "culprit": normalize.culprit(exceptions),
                "exception_type": normalize.text(last["type"]),
                "exception_value": normalize.text(
                    F.coalesce(blank_to_null(last["value"]), message)
                ),
                "geo_country": F.lit(""),
                "browser": browser,
                "os": os,
                "sdk_name": normalize.text(F.col("sdk.name")),
                "sdk_version": normalize.text(F.col("sdk.version")),
                "stacktrace": F.coalesce(F.to_json("exceptions"), F.lit("null")),
                "breadcrumbs": F.coalesce("breadcrumbs", F.lit("null")),
                "contexts": F.coalesce("contexts", F.lit("null")),
            }
        )
        .drop("_print", "exceptions", "message", "fingerprint", "sdk", "sent_at", "client_ip")
    )


def log_rows(jobs: DataFrame, policies: DataFrame | None = None) -> DataFrame:
    rows, _ = read_payload(jobs, "log", schemas.LOG_PAYLOAD)
    rows = scrub.with_policy(rows, policies)
    p = F.col("p")
    level = normalize.severity(p["severity"])
    meta = _meta("timestamp")
    sent = normalize.parse_time(p["timestamp"])
    # The wire carries nanoseconds; what the timestamp type cannot hold is kept beside it.
    below_micro = F.rpad(F.regexp_extract(normalize.text(p["timestamp"]), r"\.\d{6}(\d{1,3})", 1), 3, "0")
    micros = normalize.corrected_micros(sent, F.col("received_at"), F.col("sent_at"))
    replaced = micros == F.unix_micros("received_at")
    nanos = micros * 1000 + F.when(replaced, 0).otherwise(below_micro.cast("long"))
    out = rows.select(
        "project_id",
        level.alias("severity"),
        normalize.severity_number(level).alias("severity_number"),
        meta["timestamp"].alias("timestamp"),
        nanos.alias("ts_ns"),
        "received_at",
        normalize.text(p["service"]).alias("service"),
        meta["environment"].alias("environment"),
        meta["release"].alias("release"),
        scrub.scrub_text(normalize.text(p["body"])).alias("body"),
        scrub.scrub_text(normalize.text(p["template"])).alias("template"),
        normalize.parse_uuid(p["trace_id"]).alias("trace_id"),
        normalize.parse_span_id(p["span_id"]).alias("span_id"),
        F.coalesce(
            scrub.scrub_map(p["attributes"], F.col("deny_keys"), F.col("allow_keys")),
            schemas.empty_map(),
        ).alias("attributes"),
    )
    return schemas.conform(out, schemas.LOGS)


def span_rows(jobs: DataFrame, policies: DataFrame | None = None) -> DataFrame:
    rows, _ = read_payload(jobs, "span", schemas.SPAN_PAYLOAD)
    rows = scrub.with_policy(rows, policies)
    p = F.col("p")
    meta = _meta("start_time")
    same = ("name", "op", "service", "http_method", "http_route", "db_system")
    out = rows.select(
        "project_id",
        normalize.parse_uuid(p["trace_id"]).alias("trace_id"),
        *[normalize.parse_span_id(p[c]).alias(c) for c in ("span_id", "parent_span_id", "segment_id")],
        F.coalesce(p["is_segment"], F.lit(False)).alias("is_segment"),
        *[normalize.text(p[c]).alias(c) for c in same],
        *[c.alias(n) for n, c in meta.items()],
        "received_at",
        normalize.duration_ns(p["duration_ms"]).alias("duration_ns"),
        normalize.one_of(p["status"], normalize.SPAN_STATUSES, "ok").alias("status"),
        F.coalesce(p["http_status"], F.lit(0)).alias("http_status"),
        scrub.scrub_text(normalize.text(p["db_statement"])).alias("db_statement"),
        F.coalesce(
            scrub.scrub_map(p["tags"], F.col("deny_keys"), F.col("allow_keys")),
            schemas.empty_map(),
        ).alias("tags"),
        F.coalesce(p["measurements"], schemas.empty_map("map<string,double>")).alias("measurements"),
        normalize.text(p["user"]["id"]).alias("user_id"),
        F.lit("").alias("geo_country"),
    )
    return schemas.conform(out, schemas.SPANS)


def metric_rows(jobs: DataFrame, policies: DataFrame | None = None) -> DataFrame:
    rows, _ = read_payload(jobs, "metric", schemas.METRIC_PAYLOAD)
    rows = scrub.with_policy(rows, policies)
    p = F.col("p")
    out = rows.select(
        "project_id",
        _meta("timestamp")["timestamp"].alias("timestamp"),
        normalize.text(p["name"]).alias("name"),
        normalize.one_of(p["type"], normalize.METRIC_TYPES, "counter").alias("type"),
        normalize.text(p["unit"]).alias("unit"),
        F.coalesce(
            scrub.scrub_map(p["tags"], F.col("deny_keys"), F.col("allow_keys")),
            schemas.empty_map(),
        ).alias("tags"),
        F.coalesce(p["value"], F.lit(0.0)).alias("value"),
    )
    # One non-finite observation would spoil the sums and quantiles of its whole minute.
    return schemas.conform(out.filter(normalize.is_finite(F.col("value"))), schemas.METRICS_RAW)


def stringify(values_json: Column) -> Column:
    """A JSON object as a string map; nested values become their JSON text."""
    return F.coalesce(F.from_json(values_json, schemas.TAGS), schemas.empty_map())


# --- event hook and sampling -----------------------------------------------------------------


def apply_hook(items: DataFrame, hook: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a user's filter or rewrite over the items; the columns must stay the same."""
    out = items.transform(hook)
    if out.columns != items.columns:
        raise ValueError("the hook must keep the columns of its input")
    return out


def sample(items: DataFrame, rate: float, key: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """(kept rows, count of discarded rows per project); the choice depends on the key alone."""
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000))
    keep = bucket < F.lit(round(rate * 1_000_000))
    discarded = (
        items.filter(~keep)
        .groupBy("project_id")
        .agg(F.count("*").alias("discarded"))
        .withColumn("reason", F.lit("sample_rate"))
    )
    return items.filter(keep), discarded


# --- web vitals --------------------------------------------------------------------------------

MIN_INTERACTION_MS = 40


def web_vitals(entries: DataFrame) -> DataFrame:
    """One metric row per vital of each page view.

    `entries` holds raw performance entries: project_id, view_id, page, timestamp, seq,
    entry_type, name, start_time, value, duration, had_recent_input.
    """
    kind = F.col("entry_type")

    def latest(condition: Column) -> Column:
        return F.max_by(F.when(condition, F.col("start_time")), F.when(condition, F.col("seq")))

    interaction = (kind == "event") & (F.col("duration") >= MIN_INTERACTION_MS)
    shift = (kind == "layout-shift") & ~F.coalesce(F.col("had_recent_input"), F.lit(False))
    paint = (kind == "paint") & (F.col("name") == "first-contentful-paint")
    views = entries.groupBy("project_id", "view_id", "page").agg(
        F.max("timestamp").alias("timestamp"),
        F.round(latest(kind == "largest-contentful-paint")).alias("lcp"),
        F.round(latest(paint)).alias("fcp"),
        F.round(F.max(F.when(kind == "navigation", F.col("start_time")))).alias("ttfb"),
        F.round(F.max(F.when(interaction, F.col("duration")))).alias("inp"),
        F.round(F.coalesce(F.sum(F.when(shift, F.col("value"))), F.lit(0.0)), 3).alias("cls"),
    )
    return (
        views.select(
            "project_id",
            "view_id",
            "timestamp",
            F.create_map(F.lit("page"), "page").alias("tags"),
            F.expr(
                "stack(5, 'web.lcp', lcp, 'web.fcp', fcp, 'web.ttfb', ttfb, 'web.inp', inp, 'web.cls', cls)"
                " AS (name, value)"
            ),
        )
        .filter((F.col("name") == "web.cls") | (F.col("value") > 0))
        .withColumn("type", F.lit("distribution"))
        .withColumn("unit", F.when(F.col("name") == "web.cls", "").otherwise("millisecond"))
    )
