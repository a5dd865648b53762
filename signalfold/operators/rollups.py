"""Rollups kept as mergeable partial states, and the final aggregates read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRIC_KEYS = ("project_id", "name", "type", "unit", "tags")
KLL_K = 400
HLL_LG_K = 14


def _truncated(df: DataFrame, unit: str, time_col: str) -> Column:
    """Start of the minute or hour in the column's own timestamp type."""
    return F.date_trunc(unit, F.col(time_col)).cast(df.schema[time_col].dataType)


def issue_stats_1h(errors: DataFrame, exclude_blank_users: bool = False) -> DataFrame:
    """Hourly count, user sketch and first/last time per issue."""
    user = F.nullif("user_id", F.lit("")) if exclude_blank_users else F.col("user_id")
    return errors.groupBy(
        "project_id", "group_hash", _truncated(errors, "hour", "timestamp").alias("hour")
    ).agg(
        F.count("*").alias("times_seen"),
        F.hll_sketch_agg(user, F.lit(HLL_LG_K)).alias("users_state"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    )


def metrics_1m(raw: DataFrame) -> DataFrame:
    """Minute states per metric and tag set."""
    value = F.col("value")
    return raw.groupBy(
        *METRIC_KEYS, _truncated(raw, "minute", "timestamp").alias("minute")
    ).agg(
        F.sum(value).alias("sum"),
        F.count("*").alias("count"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.kll_sketch_agg_double(value, F.lit(KLL_K)).alias("quantiles"),
        F.hll_sketch_agg(value.cast("string"), F.lit(HLL_LG_K)).alias("unique"),
    )


def _merged_metrics(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*METRIC_KEYS, *keys).agg(
        F.sum("sum").alias("sum"),
        F.sum("count").alias("count"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.hll_union_agg("unique").alias("unique"),
    )


def metrics_1h(minutes: DataFrame) -> DataFrame:
    """Hour states from minute states; the raw rows are not read again."""
    return _merged_metrics(minutes, _truncated(minutes, "hour", "minute").alias("hour"))


def compact_metrics(states: DataFrame) -> DataFrame:
    """Collapse states of equal keys, e.g. those appended by many micro-batches."""
    return _merged_metrics(states, "minute" if "minute" in states.columns else "hour")


def compact_issue_stats(states: DataFrame) -> DataFrame:
    return states.groupBy("project_id", "group_hash", "hour").agg(
        F.sum("times_seen").alias("times_seen"),
        F.hll_union_agg("users_state").alias("users_state"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


# --- final aggregates over states --------------------------------------------------------------

QUANTILES = {"p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
AGGREGATIONS = ("sum", "count", "avg", "min", "max", "uniq", *QUANTILES)


def checked_aggregation(agg: str) -> str:
    name = agg.strip().lower() or "sum"
    if name not in AGGREGATIONS:
        raise ValueError(f"no aggregation {agg!r}; use one of {', '.join(AGGREGATIONS)}")
    return name


def merged(agg: str) -> Column:
    """The final value of one aggregation over metric states."""
    agg = checked_aggregation(agg)
    if agg in QUANTILES:
        return F.kll_sketch_get_quantile_double(
            F.kll_merge_agg_double("quantiles"), F.lit(QUANTILES[agg])
        )
    return {
        "sum": F.sum("sum"),
        "count": F.sum("count").cast("double"),
        "avg": F.sum("sum") / F.sum("count"),
        "min": F.min("min"),
        "max": F.max("max"),
        "uniq": F.hll_sketch_estimate(F.hll_union_agg("unique")).cast("double"),
    }[agg]


def exact(agg: str) -> Column:
    """The same value over raw observations (percentiles are computed by the caller)."""
    return {
        "sum": F.sum("value"),
        "count": F.count("*").cast("double"),
        "avg": F.avg("value"),
        "min": F.min("value"),
        "max": F.max("value"),
        "uniq": F.count_distinct("value").cast("double"),
    }[checked_aggregation(agg)]
