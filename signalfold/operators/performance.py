"""Endpoint, query and release performance over spans.

All functions cover every project at once (limits apply per project); pass `project_id`
to narrow to one.  `any` of the reference is `min` here, so results do not depend on
task order.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalfold.operators.percentiles import aggregate_with_percentiles
from signalfold.scale import clamp, scoped, top_per_project, utc

DEFAULT_APDEX_T = 0.5
NS_PER_MS = 1e6

# Fixed values of the release comparison: slower by 20 % and 20 ms, or 2 points more
# failures, judged only from 20 requests on.
SLOWER_RATIO = 0.20
SLOWER_MS = 20.0
FAIL_RATE_RISE = 0.02
MIN_REQUESTS = 20


def to_ms(nanos: Column) -> Column:
    return nanos / F.lit(NS_PER_MS)


ERRORS = "_errors"
SATISFIED = "_satisfied"
TOLERATING = "_tolerating"


def failures() -> Column:
    return F.count_if(F.col("status") == "error")


def apdex_counts(duration: str, t_seconds: float = DEFAULT_APDEX_T) -> dict[str, Column]:
    """Requests satisfied (up to T) and tolerating (up to 4T)."""
    t = F.lit(int(round(t_seconds * 1e9)))
    return {
        SATISFIED: F.count_if(F.col(duration) <= t),
        TOLERATING: F.count_if((F.col(duration) > t) & (F.col(duration) <= t * 4)),
    }


def apdex_score(satisfied: Column, tolerating: Column, count: Column) -> Column:
    return (satisfied + tolerating / 2) / count


def apdex(duration: str, t_seconds: float = DEFAULT_APDEX_T) -> Column:
    """The score as one aggregate expression."""
    counts = apdex_counts(duration, t_seconds)
    return apdex_score(counts[SATISFIED], counts[TOLERATING], F.count("*"))


def window_minutes(start: datetime | str, end: datetime | str) -> float:
    minutes = (utc(end) - utc(start)).total_seconds() / 60
    return minutes if minutes > 0 else 1.0


def transaction_order(sort: str) -> Column:
    """Order of the endpoint list; an unknown sort is an error, never a silent default."""
    orders = {
        "": F.col("count").desc(),
        "count": F.col("count").desc(),
        "throughput": F.col("count").desc(),
        "p95": F.col("p95_ms").desc(),
        "slowest": F.col("p95_ms").desc(),
        "p99": F.col("p99_ms").desc(),
        "failure_rate": F.col("failure_rate").desc(),
        "impact": (F.col("p95_ms") * F.col("count")).desc(),
        "apdex": F.col("apdex").asc(),
    }
    if sort not in orders:
        raise ValueError(f"unknown sort {sort!r}")
    return orders[sort]


def transactions(
    spans: DataFrame,
    start,
    end,
    apdex_t: float = DEFAULT_APDEX_T,
    sort: str = "count",
    environment: str = "",
    project_id: int | None = None,
    limit: int = 50,
) -> DataFrame:
    """Endpoints (segment spans by name): volume, latency percentiles, failures, Apdex."""
    order = transaction_order(sort)
    segments = scoped(spans, project_id, environment, start, end).filter("is_segment")
    grouped = aggregate_with_percentiles(
        segments,
        ["project_id", "name"],
        "duration_ns",
        [0.5, 0.75, 0.95, 0.99],
        {"count": F.count("*"), ERRORS: failures(), **apdex_counts("duration_ns", apdex_t)},
        labels=["op", "service"],
    )
    minutes = window_minutes(start, end)
    rows = grouped.select(
        "project_id",
        "name",
        "op",
        "service",
        "count",
        (F.col("count") / F.lit(minutes)).alias("throughput"),
        *[
            to_ms(F.col("q")[i]).alias(f"{label}_ms")
            for i, label in enumerate(("p50", "p75", "p95", "p99"))
        ],
        (F.col(ERRORS) / F.col("count")).alias("failure_rate"),
        apdex_score(F.col(SATISFIED), F.col(TOLERATING), F.col("count")).alias("apdex"),
    )
    return top_per_project(rows, [order, F.col("name")], clamp(limit, 200))


def transaction_samples(
    spans: DataFrame,
    start,
    end,
    name: str | None = None,
    environment: str = "",
    project_id: int | None = None,
    limit: int = 10,
) -> DataFrame:
    """Slowest requests of one endpoint, or of every endpoint when no name is given."""
    segments = scoped(spans, project_id, environment, start, end).filter("is_segment")
    if name is not None:
        segments = segments.filter(F.col("name") == name)
    by_endpoint = Window.partitionBy("project_id", "name").orderBy(
        F.col("duration_ns").desc(), F.col("trace_id"), F.col("span_id")
    )
    return (
        segments.select(
            "project_id",
            "name",
            "trace_id",
            "span_id",
            "timestamp",
            "duration_ns",
            "status",
            "http_status",
        )
        .withColumn("rank", F.row_number().over(by_endpoint))
        .filter(F.col("rank") <= clamp(limit, 50))
    )


def _database_spans(spans, start, end, environment, project_id) -> DataFrame:
    return scoped(spans, project_id, environment, start, end).filter(
        "op = 'db.query' AND db_statement <> ''"
    )


def slow_queries(
    spans: DataFrame,
    start,
    end,
    environment: str = "",
    project_id: int | None = None,
    limit: int = 50,
) -> DataFrame:
    """Database statements by total time."""
    grouped = aggregate_with_percentiles(
        _database_spans(spans, start, end, environment, project_id),
        ["project_id", "db_statement"],
        "duration_ns",
        [0.95],
        {"count": F.count("*"), "_total": F.sum("duration_ns")},
        labels=["db_system"],
    )
    rows = grouped.select(
        "project_id",
        F.col("db_statement").alias("statement"),
        "db_system",
        "count",
        to_ms(F.col("q")[0]).alias("p95_ms"),
        to_ms(F.col("_total") / F.col("count")).alias("avg_ms"),
        to_ms(F.col("_total").cast("double")).alias("total_ms"),
    )
    return top_per_project(rows, [F.col("total_ms").desc(), F.col("statement")], clamp(limit, 100))


def n_plus_one(
    spans: DataFrame,
    start,
    end,
    environment: str = "",
    threshold: int = 5,
    project_id: int | None = None,
    limit: int = 50,
) -> DataFrame:
    """Statements repeated under one parent span at least `threshold` times (2 at least)."""
    repeats = (
        _database_spans(spans, start, end, environment, project_id)
        .filter("parent_span_id <> 0")
        .groupBy("project_id", "trace_id", "parent_span_id", "db_statement")
        .agg(F.count("*").alias("repeats"), F.min("db_system").alias("db_system"))
        .filter(F.col("repeats") >= max(threshold, 2))
    )
    rows = (
        repeats.groupBy("project_id", "db_statement")
        .agg(
            F.min("db_system").alias("db_system"),
            F.count("*").alias("occurrences"),
            F.avg("repeats").alias("avg_repeats"),
            # The trace of the largest repeat; the larger id wins a tie.
            F.max(F.struct("repeats", "trace_id")).alias("_worst"),
        )
        .select(
            "project_id",
            F.col("db_statement").alias("statement"),
            "db_system",
            "occurrences",
            F.col("_worst.repeats").alias("max_repeats"),
            "avg_repeats",
            F.col("_worst.trace_id").alias("sample_trace"),
        )
    )
    order = [F.col("max_repeats").desc(), F.col("occurrences").desc(), F.col("statement")]
    return top_per_project(rows, order, clamp(limit, 50))


def recent_releases(
    spans: DataFrame, start, end, environment: str = "", project_id: int | None = None
) -> DataFrame:
    """The two releases seen last in each project: rank 1 is current, 2 is previous."""
    latest = (
        scoped(spans, project_id, environment, start, end)
        .filter("is_segment AND release <> ''")
        .groupBy("project_id", "release")
        .agg(F.max("timestamp").alias("last_seen"))
    )
    order = Window.partitionBy("project_id").orderBy(
        F.col("last_seen").desc(), F.col("release").desc()
    )
    return latest.withColumn("rank", F.row_number().over(order)).filter("rank <= 2")


def compare_releases(
    spans: DataFrame,
    start,
    end,
    environment: str = "",
    project_id: int | None = None,
    limit: int = 50,
) -> DataFrame:
    """Endpoints present in both recent releases, worst p95 change first."""
    pair = recent_releases(spans, start, end, environment, project_id).select(
        "project_id", "release", "rank"
    )
    segments = (
        scoped(spans, project_id, environment, start, end)
        .filter("is_segment")
        .select("project_id", "release", "name", "duration_ns", "status")
        .join(pair, ["project_id", "release"])
    )
    stats = aggregate_with_percentiles(
        segments,
        ["project_id", "name", "rank"],
        "duration_ns",
        [0.95],
        {"n": F.count("*"), ERRORS: failures()},
        labels=["release"],
    )
    stats = stats.withColumn("p95", to_ms(F.col("q")[0])).withColumn("fail", F.col(ERRORS) / F.col("n"))

    def side(rank: int, column: str) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col(column)))

    both = (
        stats.groupBy("project_id", "name")
        .agg(
            side(1, "release").alias("current"),
            side(2, "release").alias("previous"),
            side(1, "p95").alias("current_p95_ms"),
            side(2, "p95").alias("previous_p95_ms"),
            side(1, "fail").alias("current_failure_rate"),
            side(2, "fail").alias("previous_failure_rate"),
            side(1, "n").alias("current_count"),
            side(2, "n").alias("_previous_count"),
        )
        .filter((F.col("current_count") >= MIN_REQUESTS) & F.col("_previous_count").isNotNull())
        .drop("_previous_count")
    )
    delta = F.col("current_p95_ms") - F.col("previous_p95_ms")
    change = F.when(F.col("previous_p95_ms") > 0, delta / F.col("previous_p95_ms")).otherwise(0.0)
    rise = F.col("current_failure_rate") - F.col("previous_failure_rate")
    rows = both.withColumn("p95_change_pct", change).withColumn(
        "regressed",
        ((F.col("p95_change_pct") >= SLOWER_RATIO) & (delta >= SLOWER_MS))
        | (rise >= FAIL_RATE_RISE),
    )
    if limit <= 0:
        return rows
    return top_per_project(rows, [F.col("p95_change_pct").desc(), F.col("name")], limit)
