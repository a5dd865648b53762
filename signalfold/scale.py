"""Size checks and shared building blocks that keep the plans sound at any data size."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is hinted for broadcast only when its own files are no larger than this.
BROADCAST_BYTES = 8 << 20


# Session settings the jobs are written for.  Shuffle partitions are only the starting point:
# adaptive execution merges small ones and splits skewed ones.
SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Sketch aggregates keep hashing for more than the default 128 groups per task.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def configure(spark: SparkSession) -> SparkSession:
    for name, value in SESSION_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def input_bytes(df: DataFrame) -> int:
    """Bytes read by the leaves of the optimised plan; an unknown leaf counts as huge."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only for a checked size; otherwise leave the choice to the shuffle join."""
    return F.broadcast(df) if input_bytes(df) <= limit else df


def spread_scan(df: DataFrame) -> DataFrame:
    """Rows of a scan with fewer splits than there are cores, dealt to all of them; any other scan as it is.

    For work that costs much more than reading, on files whose few row groups keep most cores idle.  The
    splits decide, at every size; `df` is a scan without a shuffle, whose plan has them ready.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if splits < cores else df


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared folder of spark.checkpoint.dir, or of the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/work"
    return f"{base.rstrip('/')}/signalfold/{label}-{uuid.uuid4().hex}"


def utc(value: datetime | str) -> datetime:
    """Parse an ISO string or normalise a datetime to naive UTC."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value.replace("Z", "+00:00"))
    return value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value


def column_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def time_literal(df: DataFrame, name: str, value: datetime | str) -> Column:
    """A literal of the column's own type, so that the comparison still reaches the file scan."""
    text = utc(value).isoformat(sep=" ")
    if isinstance(column_type(df, name), T.TimestampNTZType):
        return F.expr(f"timestamp_ntz'{text}'")
    return F.expr(f"timestamp'{text} UTC'")


def in_window(df: DataFrame, start=None, end=None, time_col: str = "timestamp") -> DataFrame:
    """Half-open time range; also prunes `day` and `month` partitions, which a time range alone does not."""
    if start is not None:
        df = df.filter(F.col(time_col) >= time_literal(df, time_col, start))
        if "day" in df.columns:
            df = df.filter(F.col("day") >= F.lit(utc(start).date()))
        if dict(df.dtypes).get("month") == "date":
            df = df.filter(F.col("month") >= F.lit(utc(start).date().replace(day=1)))
    if end is not None:
        df = df.filter(F.col(time_col) < time_literal(df, time_col, end))
        if "day" in df.columns:
            df = df.filter(F.col("day") <= F.lit(utc(end).date()))
        if dict(df.dtypes).get("month") == "date":
            df = df.filter(F.col("month") <= F.lit(utc(end).date()))
    return df


def scoped(
    df: DataFrame, project_id: int | None = None, environment: str = "", start=None, end=None
) -> DataFrame:
    """Project, environment ('' means all) and time scope shared by every read."""
    if project_id is not None:
        df = df.filter(F.col("project_id") == project_id)
    if environment:
        df = df.filter(F.col("environment") == environment)
    return in_window(df, start, end)


def clamp(value: int, high: int) -> int:
    """A page size of at least 1; one above the maximum is an error, not silently a smaller page."""
    if value > high:
        raise ValueError(f"limit {value} is above the maximum of {high}")
    return max(value, 1)


def top_per_project(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """First `limit` rows of every project.

    The rank filter is pushed below the shuffle by Spark, so each task sends at most
    `limit` rows per project no matter how many rows one project holds.
    """
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join on same-named keys where NULL equals NULL; keeps the left copy of the keys."""
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"_r_{key}")
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(renamed[f"_r_{key}"])
    return left.join(renamed, condition, how).drop(*[f"_r_{key}" for key in keys])
