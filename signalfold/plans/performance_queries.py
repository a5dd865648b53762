"""Registered queries for span performance (P1-P10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalfold.operators import performance as perf
from signalfold.operators.percentiles import rank_percentiles
from signalfold.plans.adapters import spans
from signalfold.plans.registry import register

START, END = "1990-01-01", "2010-01-01"
APDEX_T = 0.2


def rounded(df, *names):
    return df.select(
        *[F.round(c, 8).alias(c) if c in names else F.col(c) for c in df.columns]
    )


TRANSACTION_DOUBLES = (
    "throughput",
    "p50_ms",
    "p75_ms",
    "p95_ms",
    "p99_ms",
    "failure_rate",
    "apdex",
)
TRANSACTION_SQL = """
WITH g AS (
  SELECT project_id, name, min(op) AS op, min(service) AS service, count(*) AS count,
    quantile_cont(duration_ns, 0.5) / 1e6 AS p50_ms, quantile_cont(duration_ns, 0.75) / 1e6 AS p75_ms,
    quantile_cont(duration_ns, 0.95) / 1e6 AS p95_ms, quantile_cont(duration_ns, 0.99) / 1e6 AS p99_ms,
    count(*) FILTER (status = 'error') / count(*) AS failure_rate,
    (count(*) FILTER (duration_ns <= 200000000) + count(*) FILTER (duration_ns > 200000000 AND duration_ns <= 800000000) / 2)
      / count(*) AS apdex
  FROM fx_spans WHERE is_segment AND timestamp >= TIMESTAMP '1990-01-01' AND timestamp < TIMESTAMP '2010-01-01' {where}
  GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY {order}, name) AS rk FROM g)
SELECT project_id, name, op, service, count, round(count / 10519200.0, 8) AS throughput,
  round(p50_ms, 8) AS p50_ms, round(p75_ms, 8) AS p75_ms, round(p95_ms, 8) AS p95_ms, round(p99_ms, 8) AS p99_ms,
  round(failure_rate, 8) AS failure_rate, round(apdex, 8) AS apdex
FROM r WHERE rk <= {limit}
"""


@register("p1_transactions", TRANSACTION_SQL.format(where="", order="count DESC", limit=50))
def _(spark, d):
    return rounded(perf.transactions(spans(spark, d), START, END, APDEX_T), *TRANSACTION_DOUBLES)


@register(
    "p1_transactions_environment",
    TRANSACTION_SQL.format(where="AND environment = 'production'", order="count DESC", limit=50),
)
def _(spark, d):
    df = perf.transactions(spans(spark, d), START, END, APDEX_T, environment="production")
    return rounded(df, *TRANSACTION_DOUBLES)


for _sort, _order in {
    "p95": "p95_ms DESC",
    "p99": "p99_ms DESC",
    "failure_rate": "failure_rate DESC",
    "apdex": "apdex ASC",
    "impact": "p95_ms * count DESC",
}.items():

    @register(
        f"p2_transactions_by_{_sort}",
        TRANSACTION_SQL.format(where="", order=_order, limit=50),
    )
    def _(spark, d, sort=_sort):
        df = perf.transactions(spans(spark, d), START, END, APDEX_T, sort=sort)
        return rounded(df, *TRANSACTION_DOUBLES)


@register(
    "p1_exact_percentiles_by_rank",
    """
SELECT project_id, op, round(quantile_cont(duration_ns, 0.5) / 1e6, 8) AS p50_ms, round(quantile_cont(duration_ns, 0.95) / 1e6, 8) AS p95_ms,
  round(quantile_cont(duration_ns, 0.99) / 1e6, 8) AS p99_ms
FROM fx_spans GROUP BY ALL
""",
)
def _(spark, d):
    q = rank_percentiles(
        spans(spark, d), ["project_id", "op"], "duration_ns", [0.5, 0.95, 0.99]
    )
    return q.select(
        "project_id",
        "op",
        *[
            F.round(perf.to_ms(F.col("q")[i]), 8).alias(f"{n}_ms")
            for i, n in enumerate(("p50", "p95", "p99"))
        ],
    )


@register(
    "p3_apdex",
    """
SELECT project_id, service, round((count(*) FILTER (duration_ns <= 200000000)
  + count(*) FILTER (duration_ns > 200000000 AND duration_ns <= 800000000) / 2) / count(*), 8) AS apdex
FROM fx_spans WHERE is_segment GROUP BY ALL
""",
)
def _(spark, d):
    return (
        spans(spark, d)
        .filter("is_segment")
        .groupBy("project_id", "service")
        .agg(F.round(perf.apdex("duration_ns", APDEX_T), 8).alias("apdex"))
    )


@register(
    "p4_throughput",
    """
SELECT project_id, name, count(*) AS count, round(count(*) / 10519200.0, 9) AS per_minute
FROM fx_spans WHERE is_segment GROUP BY ALL
""",
)
def _(spark, d):
    minutes = perf.window_minutes(START, END)
    return (
        spans(spark, d)
        .filter("is_segment")
        .groupBy("project_id", "name")
        .agg(F.count("*").alias("count"))
        .withColumn("per_minute", F.round(F.col("count") / minutes, 9))
    )


@register(
    "p5_transaction_samples",
    """
SELECT project_id, name, trace_id, span_id, timestamp, duration_ns, status, http_status, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id, name ORDER BY duration_ns DESC, trace_id, span_id) AS rank
  FROM fx_spans WHERE is_segment)
WHERE rank <= 10
""",
)
def _(spark, d):
    return perf.transaction_samples(spans(spark, d), START, END)


@register(
    "p6_slow_queries",
    """
WITH g AS (
  SELECT project_id, db_statement AS statement, min(db_system) AS db_system, count(*) AS count,
    quantile_cont(duration_ns, 0.95) / 1e6 AS p95_ms, avg(duration_ns) / 1e6 AS avg_ms, CAST(sum(duration_ns) AS DOUBLE) / 1e6 AS total_ms
  FROM fx_spans WHERE op = 'db.query' AND db_statement <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY total_ms DESC, statement) AS rk FROM g)
SELECT project_id, statement, db_system, count, round(p95_ms, 8) AS p95_ms, round(avg_ms, 8) AS avg_ms, round(total_ms, 8) AS total_ms
FROM r WHERE rk <= 50
""",
)
def _(spark, d):
    return rounded(
        perf.slow_queries(spans(spark, d), START, END), "p95_ms", "avg_ms", "total_ms"
    )


@register(
    "p7_n_plus_one",
    """
WITH i AS (
  SELECT project_id, trace_id, parent_span_id, db_statement, min(db_system) AS db_system, count(*) AS repeats
  FROM fx_spans WHERE op = 'db.query' AND db_statement <> '' AND parent_span_id <> 0 GROUP BY ALL HAVING count(*) >= 3),
g AS (
  SELECT project_id, db_statement AS statement, min(db_system) AS db_system, count(*) AS occurrences, max(repeats) AS max_repeats,
    round(avg(repeats), 8) AS avg_repeats, arg_max(trace_id, {'r': repeats, 't': trace_id}) AS sample_trace
  FROM i GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY max_repeats DESC, occurrences DESC, statement) AS rk FROM g)
SELECT * EXCLUDE (rk) FROM r WHERE rk <= 50
""",
)
def _(spark, d):
    return rounded(perf.n_plus_one(spans(spark, d), START, END, threshold=3), "avg_repeats")


RELEASES_SQL = """
  SELECT project_id, release, max(timestamp) AS last_seen,
    row_number() OVER (PARTITION BY project_id ORDER BY max(timestamp) DESC, release DESC) AS rank
  FROM fx_spans WHERE is_segment AND release <> '' GROUP BY project_id, release"""


@register("p8_recent_releases", f"SELECT * FROM ({RELEASES_SQL}) WHERE rank <= 2")
def _(spark, d):
    return perf.recent_releases(spans(spark, d), START, END)


@register(
    "p9_compare_releases",
    f"""
WITH pair AS ({RELEASES_SQL}),
s AS (
  SELECT project_id, name, p.rank, release, quantile_cont(duration_ns, 0.95) / 1e6 AS p95,
    count(*) FILTER (status = 'error') / count(*) AS fail, count(*) AS n
  FROM fx_spans JOIN pair p USING (project_id, release) WHERE is_segment AND p.rank <= 2 GROUP BY ALL),
b AS (
  SELECT c.project_id, c.name, c.release AS current, p.release AS previous, c.p95 AS current_p95_ms, p.p95 AS previous_p95_ms,
    c.fail AS current_failure_rate, p.fail AS previous_failure_rate, c.n AS current_count,
    CASE WHEN p.p95 > 0 THEN (c.p95 - p.p95) / p.p95 ELSE 0.0 END AS p95_change_pct
  FROM s c JOIN s p ON c.project_id = p.project_id AND c.name = p.name AND c.rank = 1 AND p.rank = 2 WHERE c.n >= 20)
SELECT project_id, name, current, previous, round(current_p95_ms, 8) AS current_p95_ms, round(previous_p95_ms, 8) AS previous_p95_ms,
  round(current_failure_rate, 8) AS current_failure_rate, round(previous_failure_rate, 8) AS previous_failure_rate, current_count,
  round(p95_change_pct, 8) AS p95_change_pct,
  (p95_change_pct >= 0.2 AND current_p95_ms - previous_p95_ms >= 20) OR current_failure_rate - previous_failure_rate >= 0.02 AS regressed
FROM b
""",
)
def _(spark, d):
    return rounded(
        perf.compare_releases(spans(spark, d), START, END, limit=0),
        "current_p95_ms",
        "previous_p95_ms",
        "current_failure_rate",
        "previous_failure_rate",
        "p95_change_pct",
    )


@register(
    "p10_duration_ms",
    "SELECT trace_id, span_id, duration_ns / 1e6 AS duration_ms FROM fx_spans",
)
def _(spark, d):
    return spans(spark, d).select(
        "trace_id", "span_id", perf.to_ms(F.col("duration_ns")).alias("duration_ms")
    )
