"""Issues: the fold of occurrences and user actions into one row per problem.

Occurrences (`project_id, group_hash, <order>, timestamp, level, title, culprit, release,
user_id`) are huge; actions (`project_id, group_hash, acted_at, seq, kind, release, actor_id,
assignee_id`) are made by people.  Nothing here sorts or gathers all occurrences of an issue:
folds are partial aggregates, and order-dependent questions first shrink the occurrences to
those that can matter.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalfold.operators.listing import after_cursor
from signalfold.scale import clamp, scoped, top_per_project

KEYS = ["project_id", "group_hash"]
STATUSES = ("resolved", "ignored", "unresolved")
MAX_ISSUES = 100
MAX_ACTIVITY = 100


def issue_id() -> Column:
    """A positive id made from the issue's key, the same on every run."""
    return F.xxhash64(*KEYS).bitwiseAND(F.lit((1 << 63) - 1))


def _order(columns: Sequence[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(columns)])


def fold_occurrences(occurrences: DataFrame, order: Sequence[str] = ("timestamp", "seq")) -> DataFrame:
    """One row per issue.

    `order` is the processing order: it decides which occurrence is first (level, components,
    release, first_seen) and which is newest (title, culprit); `last_seen` is the latest
    event time.
    """
    first = [c for c in ("timestamp", "level", "release", "components") if c in occurrences.columns]
    at = _order(order)
    folded = occurrences.groupBy(*KEYS).agg(
        F.min_by(F.struct(*first), at).alias("_first"),
        F.max_by(F.struct("title", "culprit"), at).alias("_last"),
        F.max(at).alias("_at"),
        F.max("timestamp").alias("last_seen"),
        F.count("*").alias("times_seen"),
        F.count_distinct("user_id").alias("users_affected"),
    )
    return folded.select(
        *KEYS,
        "_last.title",
        "_last.culprit",
        F.col("_first.timestamp").alias("first_seen"),
        "last_seen",
        "times_seen",
        "users_affected",
        F.nullif(F.col("_first.release"), F.lit("")).alias("first_release"),
        *[f"_first.{c}" for c in ("level", "components") if c in first],
        "_at",
    )


def fold_issues(
    occurrences: DataFrame,
    actions: DataFrame | None = None,
    order: Sequence[str] = ("timestamp", "seq"),
) -> DataFrame:
    """Folded issues with their current status, resolving release and assignee."""
    issues = fold_occurrences(occurrences, order)
    if actions is None:
        return issues.drop("_at").withColumn("status", F.lit("unresolved"))
    if "assignee_id" not in actions.columns:
        actions = actions.withColumn("assignee_id", F.lit(None).cast("long"))
    at = _order(("acted_at", "seq"))
    moves, assigns = F.col("kind").isin(*STATUSES), F.col("kind").isin("assigned", "unassigned")
    last = actions.groupBy(*KEYS).agg(
        F.max(F.when(moves, at)).alias("_moved"),
        F.max_by(F.when(moves, F.struct("kind", "release")), F.when(moves, at)).alias("_move"),
        F.max_by(
            F.when(assigns, F.struct(F.when(F.col("kind") == "assigned", F.col("assignee_id")).alias("a"))),
            F.when(assigns, at),
        ).alias("_assign"),
    )
    joined = issues.join(last, KEYS, "left")
    # An occurrence after the last resolve reopened the issue.
    reopened = (F.col("_move.kind") == "resolved") & (F.col("_at") > F.col("_moved"))
    status = F.when(F.coalesce(reopened, F.lit(False)), "unresolved").otherwise(
        F.coalesce("_move.kind", F.lit("unresolved"))
    )
    return (
        joined.withColumn("status", status)
        .withColumn(
            "resolved_in_release",
            F.when(F.col("status") == "resolved", F.nullif(F.col("_move.release"), F.lit(""))),
        )
        .withColumn("assignee_id", F.col("_assign.a"))
        .drop("_at", "_moved", "_move", "_assign")
    )


def new_issues(occurrences: DataFrame, order: Sequence[str] = ("timestamp", "seq")) -> DataFrame:
    """The occurrence that created each issue."""
    rest = [c for c in occurrences.columns if c not in KEYS]
    first = occurrences.groupBy(*KEYS).agg(F.min_by(F.struct(*rest), _order(order)).alias("_f"))
    return first.select(*KEYS, "_f.*")


def regressions(
    occurrences: DataFrame,
    actions: DataFrame,
    order: Sequence[str] = ("timestamp", "seq"),
    bucket: str = "hour",
) -> DataFrame:
    """Occurrences that found their issue resolved, i.e. directly follow a resolve action.

    Only an occurrence that comes first in a time bucket, or first after an action inside one,
    can directly follow an action.  Firsts are partial aggregates; only buckets with an action
    are sorted, each on its own.  What reaches the per-issue window is therefore at most one
    row per bucket and action, however many occurrences the issue has.
    """
    rest = [c for c in occurrences.columns if c not in KEYS]
    occ = occurrences.select(
        *KEYS,
        F.date_trunc(bucket, F.col(order[0])).alias("_b"),
        _order(order).alias("_at"),
        F.lit("occurrence").alias("_k"),
        F.struct(*rest).alias("_row"),
    )
    acts = actions.filter(F.col("kind").isin(*STATUSES)).select(
        *KEYS,
        F.date_trunc(bucket, "acted_at").alias("_b"),
        _order(("acted_at", "seq")).alias("_at"),
        F.col("kind").alias("_k"),
        F.lit(None).cast(occ.schema["_row"].dataType).alias("_row"),
    )
    firsts = occ.groupBy(*KEYS, "_b").agg(
        F.min("_at").alias("_at"), F.min_by("_row", "_at").alias("_row")
    )
    firsts = firsts.withColumn("_k", F.lit("occurrence")).select(occ.columns)

    busy = occ.join(acts.select(*KEYS, "_b").distinct(), [*KEYS, "_b"], "left_semi").select(occ.columns)
    in_bucket = Window.partitionBy(*KEYS, "_b").orderBy("_at")
    after_action = (
        busy.unionByName(acts)
        .withColumn("_prev", F.lag("_k").over(in_bucket))
        .filter((F.col("_k") == "occurrence") & F.col("_prev").isin(*STATUSES))
        .select(occ.columns)
    )
    per_issue = Window.partitionBy(*KEYS).orderBy("_at")
    return (
        firsts.unionByName(after_action)
        .unionByName(acts)
        .withColumn("_prev", F.lag("_k").over(per_issue))
        .filter((F.col("_k") == "occurrence") & (F.col("_prev") == "resolved"))
        .select(*KEYS, "_row.*")
    )


def alert_signals(
    occurrences: DataFrame, actions: DataFrame | None, order: Sequence[str] = ("timestamp", "seq")
) -> DataFrame:
    """New-issue and regression signals, ready for the alert rules."""
    # Only what a signal says; whole events would be carried through every sort.
    said = ("title", "culprit", "level", "release", "environment", "timestamp")
    occurrences = occurrences.select(*dict.fromkeys((*KEYS, *order, *said)))

    def signal(rows: DataFrame, kind: str) -> DataFrame:
        return rows.select(
            F.lit(kind).alias("kind"),
            "project_id",
            issue_id().alias("issue_id"),
            "group_hash",
            "title",
            "culprit",
            "level",
            "release",
            "environment",
            F.col("timestamp").alias("at"),
        )

    signals = signal(new_issues(occurrences, order), "new_issue")
    if actions is None:
        return signals
    return signals.unionByName(signal(regressions(occurrences, actions, order), "regression"))


def activity(actions: DataFrame, limit: int = MAX_ACTIVITY) -> DataFrame:
    """Audit trail of every issue, newest first."""
    newest = Window.partitionBy(*KEYS).orderBy(F.col("acted_at").desc(), F.col("seq").desc())
    return actions.withColumn("position", F.row_number().over(newest)).filter(
        F.col("position") <= clamp(limit, MAX_ACTIVITY)
    )


# --- issue list ------------------------------------------------------------------------------

SORT_COLUMNS = {
    "": "last_seen",
    "last_seen": "last_seen",
    "first_seen": "first_seen",
    "times_seen": "times_seen",
    "frequency": "times_seen",
    "users": "users_affected",
}


def filter_issues(
    issues: DataFrame,
    project_id: int | None = None,
    status: str = "",
    groups: DataFrame | None = None,
) -> DataFrame:
    """Issues of a status and group set; no set means no filter, an empty set matches nothing."""
    issues = scoped(issues, project_id)
    if status:
        issues = issues.filter(F.col("status") == status)
    if groups is not None:
        issues = issues.join(groups.select(*KEYS).distinct(), KEYS, "left_semi")
    return issues


def list_issues(
    issues: DataFrame,
    project_id: int | None = None,
    status: str = "",
    groups: DataFrame | None = None,
    sort: str = "last_seen",
    limit: int = 50,
    cursor: Mapping | None = None,
) -> DataFrame:
    """A page of issues, plus one row to tell whether another page follows."""
    column = SORT_COLUMNS.get(sort, "last_seen")
    rows = after_cursor(filter_issues(issues, project_id, status, groups), [column, "id"], cursor)
    order = [F.col(column).desc(), F.col("id").desc()]
    if project_id is None:
        return top_per_project(rows, order, clamp(limit, MAX_ISSUES))
    return rows.orderBy(*order).limit(clamp(limit, MAX_ISSUES) + 1)


def count_issues(issues: DataFrame, project_id=None, status: str = "", groups=None) -> DataFrame:
    rows = filter_issues(issues, project_id, status, groups)
    return rows.groupBy("project_id").agg(F.count("*").alias("count"))


def issues_by_hash(issues: DataFrame, hashes: DataFrame) -> DataFrame:
    return issues.join(hashes.select(*KEYS).distinct(), KEYS, "left_semi")


def get_issue(issues: DataFrame, wanted_id: int) -> DataFrame:
    return issues.filter(F.col("id") == wanted_id)
