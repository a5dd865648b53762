"""Registered queries for issue state (I1-I10) and its joins (J1, J2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalfold.functions.search import search
from signalfold.operators import issues as iss
from signalfold.operators import metrics as met
from signalfold.operators.listing import matching_groups
from signalfold.plans.adapters import errors, issue_actions
from signalfold.plans.registry import register

GROUP = "exception_type || '|' || module || '|' || func"
# A number for each group that both engines can compute; it breaks ties like an issue id.
ID = "project_id * 1000 + CAST(substr(module, 6) AS BIGINT) * 10 + CAST(substr(func, 3) AS BIGINT)"
SPARK_ID = (
    "project_id * 1000 + CAST(split_part(split_part(group_hash, '|', 2), '/m', 2) AS BIGINT) * 10"
    " + CAST(substr(split_part(group_hash, '|', 3), 3) AS BIGINT)"
)


def occurrences(spark, d):
    return errors(spark, d).withColumn("title", F.concat_ws(": ", "exception_type", "exception_value"))


def actions(spark, d):
    return issue_actions(spark, d)


def issues(spark, d):
    return iss.fold_issues(occurrences(spark, d), actions(spark, d)).withColumn("id", F.expr(SPARK_ID))


FOLD = f"""
occ AS (SELECT *, {GROUP} AS group_hash, exception_type || ': ' || exception_value AS title, event_id AS seq, {ID} AS id FROM fx_errors),
base AS (
  SELECT project_id, group_hash, min(id) AS id,
    arg_max(title, {{'t': timestamp, 's': seq}}) AS title, arg_max(culprit, {{'t': timestamp, 's': seq}}) AS culprit,
    min(timestamp) AS first_seen, max(timestamp) AS last_seen, count(*) AS times_seen, count(DISTINCT user_id) AS users_affected,
    nullif(arg_min(release, {{'t': timestamp, 's': seq}}), '') AS first_release, arg_min(level, {{'t': timestamp, 's': seq}}) AS level,
    max({{'t': timestamp, 's': seq}}) AS last_at
  FROM occ GROUP BY project_id, group_hash),
act AS (
  SELECT project_id, {GROUP} AS group_hash, arg_max(kind, {{'t': acted_at, 's': seq}}) AS kind,
    arg_max(release, {{'t': acted_at, 's': seq}}) AS release, max({{'t': acted_at, 's': seq}}) AS moved
  FROM fx_issue_actions GROUP BY ALL),
issues AS (
  SELECT base.* EXCLUDE (last_at),
    CASE WHEN kind IS NULL OR (kind = 'resolved' AND last_at > moved) THEN 'unresolved' ELSE kind END AS status,
    CASE WHEN kind = 'resolved' AND NOT (last_at > moved) THEN nullif(act.release, '') END AS resolved_in_release
  FROM base LEFT JOIN act USING (project_id, group_hash))
"""


@register("i1_issue_fold", f"WITH {FOLD} SELECT * FROM issues")
def _(spark, d):
    return issues(spark, d).drop("assignee_id")


@register(
    "i2_new_issues",
    f"""SELECT project_id, {GROUP} AS group_hash, event_id, timestamp, level, release FROM fx_errors
QUALIFY row_number() OVER (PARTITION BY project_id, exception_type, module, func ORDER BY timestamp, event_id) = 1""",
)
def _(spark, d):
    return iss.new_issues(occurrences(spark, d)).select(
        "project_id", "group_hash", "event_id", "timestamp", "level", "release"
    )


REGRESSIONS = f"""
SELECT project_id, group_hash, event_id, timestamp, level FROM (
  SELECT *, lag(k) OVER (PARTITION BY project_id, group_hash ORDER BY timestamp, event_id) AS prev FROM (
    SELECT project_id, {GROUP} AS group_hash, timestamp, event_id, level, 'occurrence' AS k FROM fx_errors
    UNION ALL SELECT project_id, {GROUP}, acted_at, seq, '', kind FROM fx_issue_actions))
WHERE k = 'occurrence' AND prev = 'resolved'
"""


@register("i3_regressions", REGRESSIONS)
def _(spark, d):
    rows = iss.regressions(occurrences(spark, d), actions(spark, d))
    return rows.select("project_id", "group_hash", "event_id", "timestamp", "level")


@register("i3_regressions_by_day_bucket", REGRESSIONS)
def _(spark, d):
    rows = iss.regressions(occurrences(spark, d), actions(spark, d), bucket="day")
    return rows.select("project_id", "group_hash", "event_id", "timestamp", "level")


@register(
    "i4_status",
    f"WITH {FOLD} SELECT project_id, status, count(*) AS issues, count(resolved_in_release) AS with_release FROM issues GROUP BY ALL",
)
def _(spark, d):
    return issues(spark, d).groupBy("project_id", "status").agg(
        F.count("*").alias("issues"), F.count("resolved_in_release").alias("with_release")
    )


@register(
    "i5_assignee",
    f"""WITH groups AS (SELECT DISTINCT project_id, {GROUP} AS group_hash FROM fx_errors),
a AS (SELECT project_id, {GROUP} AS group_hash,
    arg_max(CASE WHEN kind = 'ignored' THEN NULL ELSE {{'v': actor_id}} END, {{'t': acted_at, 's': seq}}) AS x,
    arg_max(CASE WHEN kind = 'ignored' THEN -1 ELSE actor_id END, {{'t': acted_at, 's': seq}}) AS last_assignee
  FROM fx_issue_actions GROUP BY ALL)
SELECT project_id, group_hash, nullif(last_assignee, -1) AS assignee_id FROM groups LEFT JOIN a USING (project_id, group_hash)""",
)
def _(spark, d):
    assigns = actions(spark, d).select(
        "project_id",
        "group_hash",
        "acted_at",
        "seq",
        "release",
        F.when(F.col("kind") == "ignored", "unassigned").otherwise("assigned").alias("kind"),
        F.col("actor_id").alias("assignee_id"),
    )
    return iss.fold_issues(occurrences(spark, d), assigns).select(
        "project_id", "group_hash", "assignee_id"
    )


@register(
    "i6_activity",
    f"""SELECT project_id, {GROUP} AS group_hash, acted_at, seq, actor_id, kind,
  row_number() OVER (PARTITION BY project_id, exception_type, module, func ORDER BY acted_at DESC, seq DESC) AS position
FROM fx_issue_actions QUALIFY position <= 100""",
)
def _(spark, d):
    return iss.activity(actions(spark, d)).select(
        "project_id", "group_hash", "acted_at", "seq", "actor_id", "kind", "position"
    )


for _sort, _column in (
    ("last_seen", "last_seen"),
    ("first_seen", "first_seen"),
    ("times_seen", "times_seen"),
    ("users", "users_affected"),
):

    @register(
        f"i7_list_by_{_sort}",
        f"""WITH {FOLD} SELECT id, project_id, group_hash, title, status, last_seen, first_seen, times_seen, users_affected
FROM issues QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY {_column} DESC, id DESC) <= 25""",
    )
    def _(spark, d, sort=_sort):
        return iss.list_issues(issues(spark, d), sort=sort, limit=25).select(
            "id", "project_id", "group_hash", "title", "status", "last_seen", "first_seen",
            "times_seen", "users_affected",
        )


@register(
    "i7_list_next_page",
    f"""WITH {FOLD} SELECT id, project_id, times_seen FROM issues WHERE (times_seen, id) < (20, 2000)
QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY times_seen DESC, id DESC) <= 10""",
)
def _(spark, d):
    page = iss.list_issues(
        issues(spark, d), sort="times_seen", limit=10, cursor={"times_seen": 20, "id": 2000}
    )
    return page.select("id", "project_id", "times_seen")


@register(
    "i8_count_unresolved",
    f"WITH {FOLD} SELECT project_id, count(*) AS count FROM issues WHERE status = 'unresolved' GROUP BY ALL",
)
def _(spark, d):
    return iss.count_issues(issues(spark, d), status="unresolved")


HITS = f"SELECT DISTINCT project_id, {GROUP} AS group_hash FROM fx_errors WHERE level = 'fatal' AND browser = 'Safari'"


@register(
    "i9_issues_by_hash",
    f"WITH {FOLD} SELECT id, project_id, title FROM issues WHERE (project_id, group_hash) IN (SELECT (project_id, group_hash) FROM ({HITS}))",
)
def _(spark, d):
    hits = matching_groups(search(occurrences(spark, d), "errors", "level:fatal browser:Safari"))
    return iss.issues_by_hash(issues(spark, d), hits).select("id", "project_id", "title")


@register(
    "i10_latest_issue",
    f"WITH {FOLD} SELECT id, project_id, group_hash, title, level, first_seen, first_release FROM issues WHERE id = (SELECT max(id) FROM issues)",
)
def _(spark, d):
    folded = issues(spark, d)
    wanted = folded.agg(F.max("id")).scalar()
    return iss.get_issue(folded, wanted).select(
        "id", "project_id", "group_hash", "title", "level", "first_seen", "first_release"
    )


@register(
    "j1_issues_with_stats",
    f"""WITH {FOLD}, stats AS (SELECT project_id, group_hash, count(*) AS events, count(DISTINCT user_id) AS users
  FROM occ WHERE timestamp >= TIMESTAMP '2024-01-28' AND timestamp < TIMESTAMP '2024-01-30' GROUP BY ALL)
SELECT id, project_id, status, events, users FROM issues LEFT JOIN stats USING (project_id, group_hash)""",
)
def _(spark, d):
    totals = met.exact_issue_totals(errors(spark, d), "2024-01-28", "2024-01-30")
    return met.with_stats(issues(spark, d), totals).select(
        "id", "project_id", "status", "events", "users"
    )
