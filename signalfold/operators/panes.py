"""Look-back windows as dyadic panes.

Ages are whole minutes before `now`, from 1.  A pane of level l covers 2**l ages; the window of the last w
minutes is one pane for each bit of w.  Rows are summed into the panes that some window needs,
and windows sum panes, so rules never meet minutes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalfold.scale import broadcast_if_small

# More than a window's minutes can have bits.
LEVELS = 31


def window_panes(minutes: Column) -> Column:
    """Array of (level, pane) that cover the last so many minutes."""
    w = minutes.cast("long")
    levels = F.filter(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda l: F.call_function("shiftright", w, l).bitwiseAND(F.lit(1)) == 1)
    return F.transform(levels, lambda l: F.struct(
        l.alias("level"), F.shiftleft(F.call_function("shiftright", w, l + 1), 1).alias("pane")
    ))


def age_in_minutes(moment_us: Column, now_us: Column) -> Column:
    return F.ceil((now_us - moment_us) / F.lit(60_000_000)).cast("long")


def pane_sums(rows: DataFrame, windows: DataFrame, scope: Sequence[str], group: Sequence[str], sums: Sequence[Column], widest: int) -> DataFrame:
    """(group, level, pane, sums) of the panes that windows of the same scope need.

    `rows` have `age`, `windows` have `minutes`; both have the columns of `scope`, which are part of `group`.
    `widest` is the longest window, so a row is tried on as many levels as that has bits.
    """
    wanted = windows.select(*scope, F.inline(window_panes(F.col("minutes")))).distinct()
    placed = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(max(widest.bit_length() - 1, 0)))))
    placed = placed.withColumn("pane", F.call_function("shiftright", F.col("age") - 1, F.col("level")))
    return placed.join(broadcast_if_small(wanted), [*scope, "level", "pane"]).groupBy(*group, "level", "pane").agg(*sums)


def over_windows(panes: DataFrame, windows: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Every window with each of the panes that make it up; the caller sums them by window."""
    parts = windows.select("*", F.inline(window_panes(F.col("minutes"))))
    return panes.join(broadcast_if_small(parts), [*scope, "level", "pane"]).drop("level", "pane")
