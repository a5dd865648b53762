"""Event tables on Parquet: layout, append, retention, purge and the layout by trace."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalfold import schemas


@dataclass(frozen=True)
class Layout:
    """Partition unit, sort order inside a file, days kept, and the declared columns."""

    time: str
    partition: str
    sort: tuple[str, ...]
    keep_days: int
    ddl: str | None = None


TABLES = {
    "errors": Layout("timestamp", "day", ("project_id", "_hour", "group_hash", "timestamp"), 90, schemas.ERRORS),
    "logs": Layout("timestamp", "day", ("project_id", "service", "severity", "_hour", "timestamp"), 30, schemas.LOGS),
    "spans": Layout("timestamp", "day", ("project_id", "_hour", "op", "name", "timestamp"), 30, schemas.SPANS),
    "metrics_raw": Layout("timestamp", "day", ("project_id", "name", "timestamp"), 7, schemas.METRICS_RAW),
    "metrics_1m": Layout("minute", "month", ("project_id", "name", "type", "unit", "minute"), 90),
    "metrics_1h": Layout("hour", "month", ("project_id", "name", "type", "unit", "hour"), 400),
    "issue_stats_1h": Layout("hour", "month", ("project_id", "group_hash", "hour"), 90),
}
# Columns looked up by single values get a bloom filter in every file.
BLOOM_COLUMNS = ("trace_id", "user_id")


def partition_value(layout: Layout) -> Column:
    moment = F.col(layout.time)
    return F.to_date(moment) if layout.partition == "day" else F.trunc(F.to_date(moment), "month")


def laid_out(df: DataFrame, name: str, conform: bool = True) -> DataFrame:
    """Rows in the table's columns, partitioned and sorted the way it is read.

    The rebalance hint lets Spark split a partition value that holds most of the rows over
    many tasks and pack the small ones together, so neither skew nor tiny files result.
    """
    layout = TABLES[name]
    rows = schemas.conform(df, layout.ddl) if conform and layout.ddl else df
    rows = rows.withColumn(layout.partition, partition_value(layout))
    rows = rows.hint("rebalance", F.col(layout.partition))
    if "_hour" in layout.sort:
        rows = rows.withColumn("_hour", F.date_trunc("hour", layout.time))
    return rows.sortWithinPartitions(layout.partition, *layout.sort).drop("_hour")


def _writer(df: DataFrame, partition: str):
    writer = df.write.partitionBy(partition).option("compression", "zstd")
    for column in BLOOM_COLUMNS:
        if column in df.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
            writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
    return writer


def append(df: DataFrame, path: str, name: str, conform: bool = True) -> None:
    _writer(laid_out(df, name, conform), TABLES[name].partition).mode("append").parquet(path)


def overwrite_partitions(df: DataFrame, path: str, name: str, conform: bool = True) -> None:
    """Replace exactly the partition values present in the rows."""
    rows = laid_out(df, name, conform)
    writer = _writer(rows, TABLES[name].partition).option("partitionOverwriteMode", "dynamic")
    writer.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# --- partitions --------------------------------------------------------------------------------


def partition_dates(spark: SparkSession, path: str, name: str) -> dict[date, str]:
    """Partition value -> folder, from the folder names alone."""
    column = TABLES[name].partition
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return {}
    folders = [s.getPath().toString() for s in fs.listStatus(root) if s.isDirectory()]
    prefix = f"{column}="
    return {
        date.fromisoformat(f.rsplit("/", 1)[1][len(prefix) :]): f
        for f in folders
        if f.rsplit("/", 1)[1].startswith(prefix) and "__HIVE" not in f
    }


def _drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def apply_retention(spark: SparkSession, path: str, name: str, today: date) -> list[date]:
    """Drop partitions whose last moment is older than the table keeps; returns what went."""
    layout = TABLES[name]
    limit = today - timedelta(days=layout.keep_days)
    dropped = []
    for start, folder in sorted(partition_dates(spark, path, name).items()):
        following = start + timedelta(days=1)
        if layout.partition == "month":
            following = (start.replace(day=1) + timedelta(days=32)).replace(day=1)
        if following <= limit:
            _drop_folder(spark, folder)
            dropped.append(start)
    return dropped


def purge_project(spark: SparkSession, path: str, name: str, project_id: int) -> None:
    """Remove a project's rows by rewriting the partitions that hold any."""
    column = TABLES[name].partition
    rows = read(spark, path)
    per_day = rows.groupBy(column).agg(
        F.count_if(F.col("project_id") == project_id).alias("mine"),
        F.count_if(F.col("project_id") != project_id).alias("others"),
    )
    # One row per partition: as many as there are folders.
    held = per_day.filter("mine > 0").collect()
    mixed = [r[column] for r in held if r["others"] > 0]
    if mixed:
        kept = rows.filter(F.col(column).isin(mixed) & (F.col("project_id") != project_id))
        overwrite_partitions(kept.drop(column), path, name, conform=False)
    folders = partition_dates(spark, path, name)
    for r in held:
        if r["others"] == 0:
            _drop_folder(spark, folders[r[column]])


def compact(spark: SparkSession, path: str, name: str, month: date, collapse) -> None:
    """Re-aggregate one closed month of a rollup table in place."""
    rows = read(spark, path).filter(F.col("month") == F.lit(month)).drop("month")
    overwrite_partitions(collapse(rows), path, name, conform=False)


def write_by_trace(spans: DataFrame, path: str, unit: str = "day") -> None:
    """Second copy of the spans, ordered by trace, for reading whole traces.

    Range partitioning gives every file of a day its own stretch of traces, the sort gives
    narrow row groups, and the bloom filter rules out the rest.
    """
    rows = spans.withColumn(unit, F.date_trunc(unit, "timestamp").cast("date"))
    rows = rows.repartitionByRange(unit, "project_id", "trace_id")
    rows = rows.sortWithinPartitions(unit, "project_id", "trace_id", "timestamp")
    _writer(rows, unit).mode("append").parquet(path)


def write_trace_buckets(rows: DataFrame, name: str, path: str, buckets: int = 64) -> DataFrame:
    """A copy of a signal bucketed and sorted by trace, as an external table; returns it.

    Reads that group, rank or join by trace find all rows of a trace in one bucket, so Spark
    shuffles nothing.  All signals that meet by trace need the same number of buckets.
    """
    writer = rows.repartition(buckets, "trace_id").write.bucketBy(buckets, "trace_id")
    writer = writer.sortBy("trace_id", "timestamp").option("compression", "zstd").option("path", path)
    writer.mode("overwrite").saveAsTable(name)
    return rows.sparkSession.table(name)
