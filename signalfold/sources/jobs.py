"""The job queue as a source: JSON lines from files or any stream with a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalfold import schemas
from signalfold.functions.normalize import parse_time

CORRUPT = "_corrupt"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int = 500) -> DataFrame:
    """New files of a folder; the trigger size bounds one micro-batch."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path)


def _reason(job: Column) -> Column:
    """Why a decoded line is no job; NULL for a good one."""
    return (
        F.when(job.isNull() | job[CORRUPT].isNotNull(), "not readable")
        .when(F.coalesce(job["project_id"], F.lit(0)) == 0, "no project")
        .when(~F.coalesce(job["type"].isin(*schemas.KINDS), F.lit(False)), "unknown type")
        .when(parse_time(job["received_at"]).isNull(), "no receive time")
    )


def _job(column: str) -> Column:
    schema = schemas.struct(f"{schemas.JOB}, {CORRUPT} string")
    options = {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"}
    return F.from_json(F.col(column).cast("string"), schema, options)


def decode_jobs(lines: DataFrame, column: str = "value") -> DataFrame:
    """Valid jobs, payload still JSON text."""
    # The test sits inside the generator: as a filter it would be moved below the
    # projection, and every line would be parsed once per mention.
    good = F.filter(F.array(_job(column)), lambda j: _reason(j).isNull())
    rows = lines.select(F.explode(good).alias("_job"))
    return rows.select(
        "_job.project_id",
        "_job.type",
        F.coalesce("_job.payload", F.lit("null")).alias("payload"),
        parse_time(F.col("_job.received_at")).alias("received_at"),
        parse_time(F.col("_job.sent_at")).alias("sent_at"),
        "_job.sdk",
        F.coalesce("_job.client_ip", F.lit("")).alias("client_ip"),
    )


def rejected_jobs(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that are no job, with the reason, for the dead-letter table."""
    reason = F.filter(F.transform(F.array(_job(column)), _reason), lambda r: r.isNotNull())
    return lines.select(F.col(column).cast("string").alias("line"), F.explode(reason).alias("reason"))


def decode_alert_signals(lines: DataFrame, column: str = "value") -> DataFrame:
    """Alert signals; one without project or issue id is dropped."""
    signal = F.from_json(F.col(column).cast("string"), schemas.ALERT_SIGNAL)
    rows = lines.select(signal.alias("s")).select("s.*").withColumn("at", parse_time(F.col("at")))
    return rows.filter(
        (F.coalesce("project_id", F.lit(0)) != 0) & (F.coalesce("issue_id", F.lit(0)) != 0)
    )
