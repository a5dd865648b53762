"""Registered queries for rollups (A1-A5), metrics, vitals and issue statistics (M1-M10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalfold.operators import metrics as met
from signalfold.operators import rollups as roll
from signalfold.plans.adapters import errors, metrics
from signalfold.plans.issue_queries import GROUP, issues
from signalfold.plans.registry import register

START, END = "2024-01-01", "2024-02-01"


def rounded(df, *names):
    return df.select(*[F.round(c, 8).alias(c) if c in names else F.col(c) for c in df.columns])


@register(
    "a1_issue_stats_1h",
    f"""SELECT project_id, {GROUP} AS group_hash, date_trunc('hour', timestamp) AS hour, count(*) AS times_seen,
  min(timestamp) AS first_seen, max(timestamp) AS last_seen, true AS users_close
FROM fx_errors GROUP BY ALL""",
)
def _(spark, d):
    """Counts and times are exact; the user sketch is checked against the exact count."""
    occ = errors(spark, d)
    stats = roll.issue_stats_1h(occ)
    exact = occ.groupBy(
        "project_id", "group_hash", F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("hour")
    ).agg(F.count_distinct("user_id").alias("_users"))
    estimate = F.hll_sketch_estimate("users_state")
    return stats.join(exact, ["project_id", "group_hash", "hour"]).select(
        "project_id", "group_hash", "hour", "times_seen", "first_seen", "last_seen",
        (F.abs(estimate - F.col("_users")) <= F.greatest(F.lit(1), F.col("_users") * 0.03)).alias("users_close"),
    )


METRIC_STATES = """
SELECT project_id, name, type, unit, coalesce(page, '') AS page, date_trunc('{unit}', timestamp) AS t,
  round(sum(value), 8) AS sum, count(*) AS count, min(value) AS min, max(value) AS max
FROM fx_metrics GROUP BY ALL
"""


def _states(df, column):
    return df.select(
        "project_id", "name", "type", "unit", F.coalesce(F.col("tags")["page"], F.lit("")).alias("page"),
        F.col(column).alias("t"), F.round("sum", 8).alias("sum"), "count", "min", "max",
    )


@register("a2_metrics_1m", METRIC_STATES.format(unit="minute"))
def _(spark, d):
    return _states(roll.metrics_1m(metrics(spark, d)), "minute")


@register("a3_metrics_1h_cascade", METRIC_STATES.format(unit="hour"))
def _(spark, d):
    return _states(roll.metrics_1h(roll.metrics_1m(metrics(spark, d))), "hour")


@register(
    "a4_merge_on_read",
    """SELECT project_id, name, round(sum(value), 6) AS sum, CAST(count(*) AS DOUBLE) AS count, round(avg(value), 8) AS avg,
  min(value) AS min, max(value) AS max, true AS quantiles_close, true AS uniq_close
FROM fx_metrics GROUP BY ALL""",
)
def _(spark, d):
    """Sums and extremes are exact; sketches must be within 1 % rank error and 3 % of uniques."""
    raw = metrics(spark, d)
    states = roll.metrics_1h(roll.metrics_1m(raw))
    read = states.groupBy("project_id", "name").agg(
        *[roll.merged(a).alias(a) for a in ("sum", "count", "avg", "min", "max", "uniq", "p50", "p95")]
    )
    ranks = (
        raw.join(read.select("project_id", "name", "p50", "p95"), ["project_id", "name"])
        .groupBy("project_id", "name")
        .agg(
            F.count_distinct("value").alias("_uniq"),
            *[(F.count_if(F.col("value") <= F.col(p)) / F.count("*")).alias(f"_{p}") for p in ("p50", "p95")],
            *[(F.count_if(F.col("value") < F.col(p)) / F.count("*")).alias(f"_below_{p}") for p in ("p50", "p95")],
        )
    )
    close = F.lit(True)
    for p, q in (("p50", 0.5), ("p95", 0.95)):
        close = close & (F.col(f"_{p}") >= q - 0.01) & (F.col(f"_below_{p}") <= q + 0.01)
    return read.join(ranks, ["project_id", "name"]).select(
        "project_id", "name", F.round("sum", 6).alias("sum"), "count", F.round("avg", 8).alias("avg"), "min", "max",
        close.alias("quantiles_close"),
        (F.abs(F.col("uniq") - F.col("_uniq")) <= F.col("_uniq") * 0.03 + 1).alias("uniq_close"),
    )


@register("a5_compact_states", METRIC_STATES.format(unit="minute"))
def _(spark, d):
    """States of two halves of the input, appended and then collapsed."""
    raw = metrics(spark, d)
    early = F.col("timestamp") < F.expr("timestamp_ntz'2024-01-15 12:00:30'")
    parts = roll.metrics_1m(raw.filter(early)).unionByName(roll.metrics_1m(raw.filter(~early)))
    return _states(roll.compact_metrics(parts), "minute")


SQL_AGG = {
    "sum": "round(sum(value), 8)",
    "count": "CAST(count(*) AS DOUBLE)",
    "avg": "round(avg(value), 8)",
    "min": "min(value)",
    "max": "max(value)",
    "uniq": "CAST(count(DISTINCT value) AS DOUBLE)",
    "p50": "round(quantile_cont(value, 0.5), 8)",
    "p75": "round(quantile_cont(value, 0.75), 8)",
    "p95": "round(quantile_cont(value, 0.95), 8)",
    "p99": "round(quantile_cont(value, 0.99), 8)",
}

for _agg in ("sum", "count", "avg", "min", "max"):

    @register(
        f"m1_series_{_agg}",
        f"SELECT project_id, name, date_trunc('hour', timestamp) AS t, {SQL_AGG[_agg]} AS value FROM fx_metrics GROUP BY ALL",
    )
    def _(spark, d, agg=_agg):
        hours = roll.metrics_1h(roll.metrics_1m(metrics(spark, d)))
        return rounded(met.series(hours, agg, START, END, rollup="1h"), "value")


@register(
    "m2_series_by_tag",
    """SELECT project_id, name, date_trunc('hour', timestamp) AS t, page AS "group", round(sum(value), 8) AS value
FROM fx_metrics WHERE page IS NOT NULL GROUP BY ALL""",
)
def _(spark, d):
    hours = roll.metrics_1h(roll.metrics_1m(metrics(spark, d)))
    return rounded(met.series(hours, "sum", START, END, group_by="page", rollup="1h"), "value")


for _agg in ("uniq", "p50", "p75", "p95", "p99"):

    @register(
        f"m3_exact_{_agg}",
        f"SELECT project_id, name, date_trunc('hour', timestamp) AS t, {SQL_AGG[_agg]} AS value FROM fx_metrics GROUP BY ALL",
    )
    def _(spark, d, agg=_agg):
        return rounded(met.series(metrics(spark, d), agg, START, END, rollup="1h"), "value")


@register(
    "m4_window_value",
    """SELECT project_id, name, round(sum(value), 6) AS value, count(*) AS observations, true AS found FROM fx_metrics
WHERE timestamp >= TIMESTAMP '2024-01-10' AND timestamp < TIMESTAMP '2024-01-12' GROUP BY ALL""",
)
def _(spark, d):
    minutes = roll.metrics_1m(metrics(spark, d))
    rows = met.window_value(minutes, "sum", "2024-01-10", "2024-01-12")
    return rows.withColumn("value", F.round("value", 6))


@register(
    "m5_rollup_choice",
    """SELECT project_id, name, count(DISTINCT date_trunc('minute', timestamp)) AS narrow_points, 0 AS wide_points
FROM fx_metrics WHERE timestamp >= TIMESTAMP '2024-01-10' AND timestamp < TIMESTAMP '2024-01-12' GROUP BY ALL
UNION ALL
SELECT project_id, name, 0, count(DISTINCT date_trunc('hour', timestamp)) FROM fx_metrics GROUP BY ALL""",
)
def _(spark, d):
    minutes = roll.metrics_1m(metrics(spark, d))
    states = {"1m": minutes, "1h": roll.metrics_1h(minutes)}

    def points(start, end):
        rollup = met.rollup_for(start, end)
        line = met.series(states[rollup], "count", start, end, rollup=rollup)
        return line.groupBy("project_id", "name").agg(F.count("*").alias("n"))

    zero = F.lit(0).cast("long")
    narrow = points("2024-01-10", "2024-01-12")
    wide = points(START, END)
    return narrow.select(
        "project_id", "name", F.col("n").alias("narrow_points"), zero.alias("wide_points")
    ).unionByName(
        wide.select("project_id", "name", zero.alias("narrow_points"), F.col("n").alias("wide_points"))
    )


@register(
    "m6_core_vitals",
    """SELECT p.project_id, v.metric, coalesce(round(quantile_cont(m.value, 0.75), 8), 0.0) AS p75, count(m.value) > 0 AS found
FROM (SELECT DISTINCT project_id FROM fx_metrics) p
CROSS JOIN (VALUES ('web.lcp'), ('web.inp'), ('web.cls'), ('web.fcp'), ('web.ttfb')) v(metric)
LEFT JOIN fx_metrics m ON m.project_id = p.project_id AND m.name = v.metric
GROUP BY ALL""",
)
def _(spark, d):
    return rounded(met.core_vitals(metrics(spark, d), START, END), "p75")


@register(
    "m7_vitals_by_page",
    """WITH g AS (SELECT project_id, page, name, quantile_cont(value, 0.75) AS p75, count(*) AS n FROM fx_metrics
  WHERE page IS NOT NULL AND name IN ('web.lcp', 'web.inp', 'web.cls') GROUP BY ALL)
SELECT project_id, page, coalesce(round(max(p75) FILTER (name = 'web.lcp'), 8), 0.0) AS lcp_p75,
  coalesce(round(max(p75) FILTER (name = 'web.inp'), 8), 0.0) AS inp_p75,
  coalesce(round(max(p75) FILTER (name = 'web.cls'), 8), 0.0) AS cls_p75, max(n) AS samples
FROM g GROUP BY ALL""",
)
def _(spark, d):
    pages = met.vitals_by_page(metrics(spark, d), START, END)
    return rounded(pages, "lcp_p75", "inp_p75", "cls_p75")


@register(
    "m8_issue_totals",
    f"""SELECT project_id, {GROUP} AS group_hash, count(*) AS events, count(DISTINCT user_id) AS users FROM fx_errors
WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-25' GROUP BY ALL""",
)
def _(spark, d):
    return met.exact_issue_totals(errors(spark, d), "2024-01-05", "2024-01-25")


@register(
    "m8_issue_totals_from_states",
    f"SELECT project_id, {GROUP} AS group_hash, count(*) AS events, true AS users_close FROM fx_errors GROUP BY ALL",
)
def _(spark, d):
    occ = errors(spark, d)
    totals = met.issue_totals(roll.issue_stats_1h(occ), START, END)
    exact = met.exact_issue_totals(occ, START, END).select(
        "project_id", "group_hash", F.col("users").alias("_exact")
    )
    return totals.join(exact, ["project_id", "group_hash"]).select(
        "project_id", "group_hash", "events",
        (F.abs(F.col("users") - F.col("_exact")) <= F.col("_exact") * 0.03 + 1).alias("users_close"),
    )


SPARKLINE = f"""
SELECT project_id, {GROUP} AS group_hash, date_trunc('hour', timestamp) AS hour, count(*) AS n FROM fx_errors GROUP BY ALL
"""


@register(
    "m9_sparklines",
    f"""SELECT project_id, group_hash, string_agg(strftime(hour, '%Y-%m-%d %H') || '=' || n, ' ' ORDER BY hour) AS line
FROM ({SPARKLINE}) GROUP BY ALL""",
)
def _(spark, d):
    lines = met.sparklines(roll.issue_stats_1h(errors(spark, d)), START, END)
    text = F.transform(
        "points", lambda p: F.concat(F.date_format(p["hour"], "yyyy-MM-dd HH"), F.lit("="), p["n"].cast("string"))
    )
    return lines.select("project_id", "group_hash", F.array_join(text, " ").alias("line"))


@register(
    "m9_sparklines_filled",
    f"""WITH p AS ({SPARKLINE})
SELECT g.project_id, g.group_hash, string_agg(CAST(coalesce(p.n, 0) AS STRING), ' ' ORDER BY h.hour) AS line
FROM (SELECT DISTINCT project_id, group_hash FROM p) g
CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31 23:00:00', INTERVAL 1 HOUR)) AS hour) h
LEFT JOIN p ON p.project_id = g.project_id AND p.group_hash = g.group_hash AND p.hour = h.hour
GROUP BY ALL""",
)
def _(spark, d):
    lines = met.sparklines(roll.issue_stats_1h(errors(spark, d)), START, END, fill=True)
    counts = F.transform("points", lambda p: p["n"].cast("string"))
    return lines.select("project_id", "group_hash", F.array_join(counts, " ").alias("line"))


@register(
    "m10_issue_list_with_stats",
    f"""WITH stats AS (SELECT project_id, {GROUP} AS group_hash, count(*) AS events,
    count(DISTINCT date_trunc('hour', timestamp)) AS hours FROM fx_errors
  WHERE timestamp >= TIMESTAMP '2024-01-29' AND timestamp < TIMESTAMP '2024-02-01' GROUP BY ALL),
g AS (SELECT DISTINCT project_id, {GROUP} AS group_hash FROM fx_errors)
SELECT project_id, group_hash, events, hours FROM g LEFT JOIN stats USING (project_id, group_hash)""",
)
def _(spark, d):
    stats = roll.issue_stats_1h(errors(spark, d))
    totals = met.issue_totals(stats, "2024-01-29", END).drop("users")
    lines = met.sparklines(stats, "2024-01-29", END)
    return met.with_stats(issues(spark, d), totals, lines).select(
        "project_id", "group_hash", "events",
        F.when(F.col("points").isNotNull(), F.size("points").cast("long")).alias("hours"),
    )
