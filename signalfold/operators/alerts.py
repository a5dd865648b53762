"""Alert rules: which signals, spikes and metric values they match, and what they say."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalfold import schemas
from signalfold.operators.issues import KEYS as ISSUE_KEYS
from signalfold.operators.panes import age_in_minutes, over_windows, pane_sums
from signalfold.operators.rollups import AGGREGATIONS, QUANTILES
from signalfold.scale import broadcast_if_small, in_window, utc

# Fixed values of the rule language.
KINDS = ("new_issue", "regression", "frequency", "metric")
OPERATORS = {"gt": ">", "gte": "≥", "lt": "<", "lte": "≤"}
REASONS = {"new_issue": "New issue", "regression": "Regression"}
DEFAULT_THROTTLE_SECONDS = 3600
MAX_SPIKES = 100
ROLLUP_CUTOVER_MINUTES = 48 * 60


def parse_rules(rules: DataFrame) -> DataFrame:
    """Rules with `conditions` and `channels` as JSON text, decoded."""
    return rules.withColumns(
        {
            "conditions": F.from_json("conditions", schemas.CONDITIONS),
            "channels": F.coalesce(
                F.from_json("channels", schemas.CHANNELS), F.array().cast(schemas.CHANNELS)
            ),
        }
    )


def enabled(rules: DataFrame, kind: str) -> DataFrame:
    return rules.filter(F.col("enabled") & (F.col("kind") == kind))


def projects_to_evaluate(rules: DataFrame, kind: str) -> DataFrame:
    return enabled(rules, kind).select("project_id").distinct()


def _condition(name: str) -> Column:
    return F.coalesce(F.col(f"conditions.{name}"), F.lit(""))


def throttle_or_default(seconds: Column) -> Column:
    return F.when(seconds > 0, seconds).otherwise(F.lit(DEFAULT_THROTTLE_SECONDS))


def validate_rules(rules: DataFrame) -> DataFrame:
    """(rule_id, reason) of every rule that may not be saved."""
    metric = F.col("kind") == "metric"
    reason = (
        F.when(F.coalesce(F.col("name"), F.lit("")) == "", "name is missing")
        .when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unknown kind")
        .when(metric & (_condition("metric_name") == ""), "metric name is missing")
        .when(metric & ~_condition("agg").isin(*AGGREGATIONS), "unknown aggregation")
        .when(metric & ~_condition("operator").isin(*OPERATORS), "unknown operator")
        .when(
            metric & (F.coalesce("conditions.window_minutes", F.lit(0)) <= 0),
            "window must be positive",
        )
        .when(F.coalesce(F.size("channels"), F.lit(0)) <= 0, "no channel")
    )
    return rules.select("rule_id", reason.alias("reason")).filter(F.col("reason").isNotNull())


# --- text ------------------------------------------------------------------------------------


def plain_number(value: Column) -> Column:
    """Shortest decimal text without exponent or trailing zeros."""
    digits = value.cast("string")
    spelled = F.when(
        digits.contains("E"), F.coalesce(digits.try_cast("decimal(38,18)").cast("string"), digits)
    ).otherwise(digits)
    return F.when(
        spelled.contains("."), F.regexp_replace(F.regexp_replace(spelled, "0+$", ""), r"\.$", "")
    ).otherwise(spelled)


def operator_symbol(operator: Column) -> Column:
    text = operator
    for name, symbol in OPERATORS.items():
        text = F.when(operator == name, symbol).otherwise(text)
    return text


def issue_url(dashboard: str, issue_id: Column) -> Column:
    if not dashboard:
        return F.lit("")
    return F.concat(F.lit(dashboard.rstrip("/") + "/issues/"), issue_id.cast("string"))


def metric_url(dashboard: str, project_id: Column, name: Column) -> Column:
    if not dashboard:
        return F.lit("")
    return F.concat(
        F.lit(dashboard.rstrip("/") + "/projects/"), project_id.cast("string"),
        F.lit("/metrics?name="), F.url_encode(name),
    )


def window_label(minutes: Column) -> Column:
    return F.concat(minutes.cast("string"), F.lit("m"))


# --- T1: signals ---------------------------------------------------------------------------------


def match_signals(signals: DataFrame, rules: DataFrame, dashboard: str = "") -> DataFrame:
    """Attempts of the enabled rules whose narrowing conditions fit the signal."""
    narrowed = rules.filter("enabled").select(
        "project_id", "kind", "rule_id", "throttle_seconds", "channels",
        _condition("environment").alias("_env"),
        _condition("level").alias("_level"),
        _condition("release").alias("_release"),
    )
    joined = signals.join(broadcast_if_small(narrowed), ["project_id", "kind"])
    fits = (
        ((F.col("_env") == "") | (F.lower("_env") == F.lower("environment")))
        & ((F.col("_level") == "") | (F.lower("_level") == F.lower("level")))
        & ((F.col("_release") == "") | (F.col("_release") == F.col("release")))
    )
    reason = F.coalesce(
        *[F.when(F.col("kind") == k, F.lit(v)) for k, v in REASONS.items()], F.lit("Alert")
    )
    return joined.filter(fits).select(
        "rule_id",
        F.concat(F.lit("issue:"), F.col("issue_id").cast("string")).alias("dedupe_key"),
        F.col("at"),
        "throttle_seconds",
        "channels",
        "project_id",
        reason.alias("reason"),
        "title",
        "culprit",
        "level",
        "release",
        "environment",
        F.lit(0).cast("long").alias("count"),
        F.lit("").alias("window"),
        issue_url(dashboard, F.col("issue_id")).alias("url"),
    )


def _widest(rules: DataFrame) -> timedelta:
    """The longest `_window` (minutes) of some rules; one row comes back."""
    return timedelta(minutes=rules.agg(F.max("_window")).first()[0] or 0)


# --- T2: frequency -------------------------------------------------------------------------------


def frequent_groups(
    errors: DataFrame, rules: DataFrame, now: datetime | str, most: int | None = MAX_SPIKES
) -> DataFrame:
    """(rule_id, project_id, group_hash, count) of the groups over each rule's threshold.

    The scan reaches back as far as the widest enabled rule.  Occurrences are counted per group
    and minute of age, then per pane, and the rules sum panes: a window of any width is a few.
    `most` groups per rule, the busiest ones, come out; None gives all.
    """
    moment = utc(now)
    now_us = F.lit(int((moment - datetime(1970, 1, 1)).total_seconds()) * 1_000_000 + moment.microsecond)
    at_us = F.unix_micros(F.col("timestamp").cast("timestamp"))
    usable = (
        enabled(rules, "frequency")
        .select(
            "rule_id",
            "project_id",
            F.col("conditions.threshold").alias("_threshold"),
            F.col("conditions.window_minutes").alias("_window"),
        )
        .filter("_threshold > 0 AND _window > 0")
    )
    widest = _widest(usable)
    windows = usable.withColumnRenamed("_window", "minutes")
    counts = (
        in_window(errors, moment - widest)
        .withColumn("age", F.greatest(age_in_minutes(at_us, now_us), F.lit(1)))
        .groupBy(*ISSUE_KEYS, "age")
        .agg(F.count("*").alias("_n"))
    )
    minutes = int(widest.total_seconds() // 60)
    panes = pane_sums(counts, windows, ["project_id"], ISSUE_KEYS, [F.sum("_n").alias("_n")], minutes)
    summed = (
        over_windows(panes, windows, ["project_id"])
        .groupBy("rule_id", "_threshold", *ISSUE_KEYS)
        .agg(F.sum("_n").alias("count"))
        .filter(F.col("count") >= F.col("_threshold"))
    )
    if most is None:
        return summed.select("rule_id", *ISSUE_KEYS, "count")
    busiest = Window.partitionBy("rule_id").orderBy(F.col("count").desc(), "group_hash")
    return (
        summed.withColumn("_rank", F.row_number().over(busiest))
        .filter(F.col("_rank") <= most)
        .select("rule_id", *ISSUE_KEYS, "count")
    )


def evaluate_frequency(
    errors: DataFrame, issues: DataFrame, rules: DataFrame, now, dashboard: str = ""
) -> DataFrame:
    """Attempts of the frequency rules; a rule's level narrows the issues, not the count."""
    spikes = frequent_groups(errors, rules, now)
    details = enabled(rules, "frequency").select(
        "rule_id", "throttle_seconds", "channels",
        _condition("level").alias("_level"),
        _condition("environment").alias("_env"),
        F.col("conditions.window_minutes").alias("_window"),
    )
    named = spikes.join(
        issues.select(*ISSUE_KEYS, "id", "title", "culprit", "level"), ISSUE_KEYS
    ).join(details, "rule_id")
    named = named.filter((F.col("_level") == "") | (F.lower("_level") == F.lower("level")))
    return named.select(
        "rule_id",
        F.concat(
            F.lit("freq:"), F.col("rule_id").cast("string"), F.lit(":issue:"), F.col("id").cast("string")
        ).alias("dedupe_key"),
        F.lit(utc(now)).cast("timestamp_ntz").alias("at"),
        "throttle_seconds",
        "channels",
        "project_id",
        F.lit("High frequency").alias("reason"),
        "title",
        "culprit",
        "level",
        F.lit("").alias("release"),
        F.col("_env").alias("environment"),
        "count",
        window_label(F.col("_window")).alias("window"),
        issue_url(dashboard, F.col("id")).alias("url"),
    )


# --- T3: metric thresholds -----------------------------------------------------------------------


def breached(operator: Column, observed: Column, limit: Column) -> Column:
    return (
        F.when(operator == "gt", observed > limit)
        .when(operator == "gte", observed >= limit)
        .when(operator == "lt", observed < limit)
        .when(operator == "lte", observed <= limit)
        .otherwise(F.lit(False))
    )


def _metric_rules(rules: DataFrame) -> DataFrame:
    return (
        enabled(rules, "metric")
        .select(
            "rule_id", "project_id", "throttle_seconds", "channels",
            F.col("name").alias("rule_name"),
            _condition("metric_name").alias("name"),
            F.lower(_condition("agg")).alias("agg"),
            _condition("operator").alias("operator"),
            F.coalesce("conditions.value", F.lit(0.0)).alias("limit"),
            F.coalesce("conditions.window_minutes", F.lit(0)).alias("_window"),
        )
        .filter("name <> '' AND agg <> '' AND operator <> '' AND _window > 0")
    )


def observed_metrics(minutes: DataFrame, hours: DataFrame, rules: DataFrame, now) -> DataFrame:
    """One observed value per metric rule that has data in its window, however wide that is.

    States are merged per pane of age, and each rule merges the panes of its window.
    """
    moment = utc(now)
    candidates = _metric_rules(rules)
    wide = F.col("_window") > ROLLUP_CUTOVER_MINUTES

    end = F.unix_micros(F.lit(moment.isoformat(sep=" ") + " UTC").cast("timestamp"))
    scope = ["project_id", "name"]

    def merged() -> list[Column]:
        return [F.sum("sum").alias("sum"), F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"),
                F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("unique").alias("unique")]

    def summed(states: DataFrame, time_col: str, which: Column) -> DataFrame:
        own = candidates.filter(which).withColumn("minutes", F.col("_window"))
        widest = _widest(own)
        recent = in_window(states, moment - widest, moment, time_col)
        aged = recent.withColumn("age", F.greatest(age_in_minutes(F.unix_micros(F.col(time_col).cast("timestamp")), end), F.lit(1)))
        panes = pane_sums(aged, own, scope, scope, merged(), int(widest.total_seconds() // 60))
        return over_windows(panes, own.select(*scope, "rule_id", "agg", "minutes"), scope)

    pairs = summed(minutes, "minute", ~wide).unionByName(summed(hours, "hour", wide))
    quantile = F.col("agg").isin(*QUANTILES)
    kll = F.kll_merge_agg_double(F.when(quantile, F.col("quantiles")))
    hll = F.hll_union_agg(F.when(F.col("agg") == "uniq", F.col("unique")))
    values = pairs.groupBy("rule_id").agg(
        F.min("agg").alias("agg"),
        F.sum("sum").alias("_sum"),
        F.sum("count").alias("_count"),
        F.min("min").alias("_min"),
        F.max("max").alias("_max"),
        kll.alias("_kll"),
        hll.alias("_hll"),
    )
    agg = F.col("agg")
    observed = (
        F.when(agg == "sum", F.col("_sum"))
        .when(agg == "count", F.col("_count").cast("double"))
        .when(agg == "avg", F.col("_sum") / F.col("_count"))
        .when(agg == "min", F.col("_min"))
        .when(agg == "max", F.col("_max"))
        .when(agg == "uniq", F.hll_sketch_estimate("_hll").cast("double"))
    )
    for name, p in QUANTILES.items():
        sketch = F.when(agg == name, F.col("_kll"))
        observed = F.coalesce(observed, F.kll_sketch_get_quantile_double(sketch, F.lit(p)))
    return candidates.join(values.select("rule_id", observed.alias("observed")), "rule_id").filter(
        F.col("observed").isNotNull()
    )


def evaluate_metrics(
    minutes: DataFrame, hours: DataFrame, rules: DataFrame, now, dashboard: str = ""
) -> DataFrame:
    """Attempts of the metric rules that are breached; no data is no breach."""
    return metric_attempts(observed_metrics(minutes, hours, rules, now), now, dashboard)


def metric_attempts(observed: DataFrame, now, dashboard: str = "") -> DataFrame:
    """Attempts of the rules whose observed value (see `observed_metrics`) breaches their limit."""
    rows = observed.filter(
        breached(F.col("operator"), F.col("observed"), F.col("limit"))
    )
    label = window_label(F.col("_window"))
    culprit = F.concat(
        F.col("agg"), F.lit("("), F.col("name"), F.lit(") "), operator_symbol(F.col("operator")),
        F.lit(" "), plain_number(F.col("limit")), F.lit(" — "), plain_number(F.col("observed")),
        F.lit(" over "), label,
    )
    return rows.select(
        "rule_id",
        F.concat(F.lit("metric:"), F.col("rule_id").cast("string")).alias("dedupe_key"),
        F.lit(utc(now)).cast("timestamp_ntz").alias("at"),
        "throttle_seconds",
        "channels",
        "project_id",
        F.lit("Metric threshold").alias("reason"),
        F.col("rule_name").alias("title"),
        culprit.alias("culprit"),
        F.lit("").alias("level"),
        F.lit("").alias("release"),
        F.lit("").alias("environment"),
        F.lit(0).cast("long").alias("count"),
        label.alias("window"),
        metric_url(dashboard, F.col("project_id"), F.col("name")).alias("url"),
    )


# --- T6 and the notification records ----------------------------------------------------------


def with_channels(attempts: DataFrame) -> DataFrame:
    """Rules nobody listens to must not take a throttle slot."""
    return attempts.filter(F.coalesce(F.size("channels"), F.lit(0)) > 0)


def notifications(fired: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """One record per fired rule and channel; count and window only on frequency alerts."""
    if projects is None:
        fired = fired.withColumn("project", F.lit(None).cast("string"))
    else:
        names = projects.select("project_id", F.col("name").alias("project"))
        fired = fired.join(broadcast_if_small(names), "project_id", "left")
    project = F.coalesce("project", F.concat(F.lit("project "), F.col("project_id").cast("string")))
    return fired.withColumn("channel", F.explode("channels")).select(
        "rule_id",
        "dedupe_key",
        F.col("channel.type").alias("channel"),
        F.col("channel.settings").alias("settings"),
        "reason",
        project.alias("project"),
        "title",
        "culprit",
        "level",
        "release",
        "environment",
        "url",
        F.col("at").alias("fired_at"),
        F.when(F.col("count") > 0, F.col("count")).alias("count"),
        F.when(F.col("count") > 0, F.col("window")).alias("window"),
    )
