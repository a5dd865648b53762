"""Metric series, window values, Web Vitals and issue statistics.

Every read takes either a rollup table (states are merged) or raw observations (values are
exact); which one is told from the columns.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalfold.operators.percentiles import aggregate_with_percentiles
from signalfold.operators.rollups import (
    QUANTILES,
    _truncated,
    checked_aggregation,
    exact,
    merged,
)
from signalfold.scale import in_window, scoped, top_per_project, utc

ROLLUP_CUTOVER = timedelta(hours=48)
# The Core Web Vitals.
CORE_VITALS = ("web.lcp", "web.inp", "web.cls", "web.fcp", "web.ttfb")
PAGE_VITALS = {"web.lcp": "lcp_p75", "web.inp": "inp_p75", "web.cls": "cls_p75"}


def rollup_for(start, end) -> str:
    """Hour buckets for windows over 48 hours, minute buckets below."""
    return "1h" if utc(end) - utc(start) > ROLLUP_CUTOVER else "1m"


def time_column(df: DataFrame) -> str:
    return next(c for c in ("minute", "hour", "timestamp") if c in df.columns)


def aggregate(df: DataFrame, keys: list[str], agg: str) -> DataFrame:
    """keys, value and the number of observations, from states or raw rows."""
    agg = checked_aggregation(agg)
    if "quantiles" in df.columns:
        return df.groupBy(*keys).agg(
            merged(agg).alias("value"), F.sum("count").alias("observations")
        )
    count = F.count("*")
    if agg in QUANTILES:
        rows = aggregate_with_percentiles(
            df, keys, "value", [QUANTILES[agg]], {"observations": count}
        )
        return rows.select(*keys, F.col("q")[0].alias("value"), "observations")
    return df.groupBy(*keys).agg(exact(agg).alias("value"), count.alias("observations"))


def _selected(df: DataFrame, start, end, project_id, names) -> DataFrame:
    rows = in_window(scoped(df, project_id), start, end, time_column(df))
    return rows if names is None else rows.filter(F.col("name").isin(*names))


def series(
    df: DataFrame,
    agg: str = "sum",
    start=None,
    end=None,
    name: str | None = None,
    group_by: str = "",
    project_id: int | None = None,
    rollup: str = "1m",
) -> DataFrame:
    """Value per time bucket (and per value of the tag `group_by`, on rows that carry it)."""
    rows = _selected(df, start, end, project_id, None if name is None else [name])
    unit = "hour" if rollup == "1h" else "minute"
    rows = rows.withColumn("t", _truncated(rows, unit, time_column(rows)))
    keys = ["project_id", "name", "t"]
    if group_by:
        rows = rows.filter(F.map_contains_key("tags", group_by)).withColumn(
            "group", F.col("tags")[group_by]
        )
        keys.append("group")
    return aggregate(rows, keys, agg).drop("observations")


def window_value(
    df: DataFrame, agg: str, start, end, names=None, project_id: int | None = None
) -> DataFrame:
    """One value per metric over the whole window; `found` tells whether there was any data."""
    rows = aggregate(_selected(df, start, end, project_id, names), ["project_id", "name"], agg)
    return rows.withColumn("found", F.col("observations") > 0)


def core_vitals(df: DataFrame, start, end, project_id: int | None = None) -> DataFrame:
    """p75 of the five vitals for every project with metrics; a silent vital has found = false."""
    values = window_value(df, "p75", start, end, CORE_VITALS, project_id)
    wanted = (
        _selected(df, start, end, project_id, None)
        .select("project_id")
        .distinct()
        .select("project_id", F.explode(F.array(*map(F.lit, CORE_VITALS))).alias("name"))
    )
    return wanted.join(values, ["project_id", "name"], "left").select(
        "project_id",
        F.col("name").alias("metric"),
        F.coalesce("value", F.lit(0.0)).alias("p75"),
        F.coalesce("found", F.lit(False)).alias("found"),
    )


def vitals_by_page(
    df: DataFrame, start, end, project_id: int | None = None, limit: int = 50
) -> DataFrame:
    """p75 of LCP, INP and CLS per page, worst LCP first; a missing vital reads 0."""
    rows = _selected(df, start, end, project_id, PAGE_VITALS)
    rows = rows.filter(F.map_contains_key("tags", "page")).withColumn("page", F.col("tags")["page"])
    values = aggregate(rows, ["project_id", "page", "name"], "p75")
    pages = values.groupBy("project_id", "page").agg(
        *[
            F.coalesce(F.max(F.when(F.col("name") == n, F.col("value"))), F.lit(0.0)).alias(label)
            for n, label in PAGE_VITALS.items()
        ],
        F.max("observations").alias("samples"),
    )
    if limit <= 0:
        return pages
    return top_per_project(pages, [F.col("lcp_p75").desc(), F.col("page")], limit)


# --- issue statistics ----------------------------------------------------------------------------


def issue_totals(stats: DataFrame, start=None, end=None) -> DataFrame:
    """Events and (estimated) distinct users per issue from hourly states."""
    return (
        in_window(stats, start, end, "hour")
        .groupBy("project_id", "group_hash")
        .agg(
            F.sum("times_seen").alias("events"),
            F.hll_sketch_estimate(F.hll_union_agg("users_state")).alias("users"),
        )
    )


def exact_issue_totals(errors: DataFrame, start=None, end=None) -> DataFrame:
    """Events and exact distinct users per issue from the occurrences."""
    return (
        in_window(errors, start, end)
        .groupBy("project_id", "group_hash")
        .agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"))
    )


def hourly_counts(stats: DataFrame, start=None, end=None) -> DataFrame:
    return (
        in_window(stats, start, end, "hour")
        .groupBy("project_id", "group_hash", "hour")
        .agg(F.sum("times_seen").alias("n"))
    )


def sparklines(stats: DataFrame, start, end, fill: bool = False) -> DataFrame:
    """Hourly counts per issue, oldest first, as one array; `fill` adds the empty hours.

    The array holds one entry per hour of the window, so its size is set by the window.
    """
    points = hourly_counts(stats, start, end)
    kind = points.schema["hour"].dataType
    lines = points.groupBy("project_id", "group_hash").agg(
        F.array_sort(F.collect_list(F.struct("hour", "n"))).alias("points")
    )
    if not fill:
        return lines
    first = F.date_trunc("hour", F.lit(utc(start)).cast("timestamp")).cast(kind)
    last = F.date_trunc("hour", F.lit(utc(end) - timedelta(microseconds=1)).cast("timestamp")).cast(kind)
    hours = F.sequence(first, last, F.expr("INTERVAL 1 HOUR"))
    known = F.map_from_entries("points")
    filled = F.transform(
        hours, lambda h: F.struct(h.alias("hour"), F.coalesce(known[h], F.lit(0).cast("long")).alias("n"))
    )
    return lines.withColumn("points", filled)


def with_stats(issues: DataFrame, totals: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """A list of issues with its statistics; an issue without any keeps its row."""
    out = issues.join(totals, ["project_id", "group_hash"], "left")
    return out if lines is None else out.join(lines, ["project_id", "group_hash"], "left")
