"""Timed evaluation of frequency and metric rules."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from signalfold.operators import alerts, throttle
from signalfold.scale import utc
from signalfold.streaming.batches import folder_numbers

# Fixed value: rules are evaluated once a minute.
EVERY = "60 seconds"

Evaluate = Callable[[datetime], DataFrame]


# Snapshots of last fires that stay: a repeated pass needs the one before it.
KEEP_SNAPSHOTS = 3


def last_fires(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """The last fire of every target that a later attempt can still be too close to, as the passes before left it."""
    taken = [n for n in folder_numbers(spark, path, "tick") if n < before]
    return spark.read.parquet(f"{path}/tick={max(taken)}") if taken else None


def _snapshot(fired: DataFrame, history: DataFrame | None, now: datetime) -> DataFrame:
    """Last fires after a pass: one row per target, and none whose throttle has run out."""
    rows = fired.select("rule_id", "dedupe_key", F.col("at").alias("fired_at"), F.col("throttle_seconds").cast("long").alias("throttle_seconds"))
    if history is not None:
        rows = rows.unionByName(history.select(rows.columns))
    last = rows.groupBy("rule_id", "dedupe_key").agg(
        F.max("fired_at").alias("fired_at"), F.max("throttle_seconds").alias("throttle_seconds")
    )
    until = F.unix_micros(F.col("fired_at").cast("timestamp")) + F.col("throttle_seconds") * 1_000_000
    return last.filter(until > F.unix_micros(F.lit(utc(now).isoformat(sep=" ") + " UTC").cast("timestamp")))


def tick(spark: SparkSession, evaluate: Evaluate, now: datetime, out: str, tick_id: int, fires: str | None = None) -> None:
    """One pass: attempts at `now`, minus those whose target fired lately, become notifications.

    The last fires are a keyed snapshot beside the notifications (at `fires`), so a pass reads as many
    rows as there are targets under throttle, however long the history is.  Each pass owns the folders of its id
    and reads the snapshot before it, so a pass that is repeated gives the same records.
    """
    fires = fires or f"{out}-fires"
    history = last_fires(spark, fires, tick_id)
    attempts = alerts.with_channels(evaluate(now))
    fired = throttle.claim(attempts, history).persist()
    try:
        alerts.notifications(fired).write.mode("overwrite").parquet(f"{out}/tick={tick_id}")
        _snapshot(fired, history, now).coalesce(1).write.mode("overwrite").parquet(f"{fires}/tick={tick_id}")
    finally:
        fired.unpersist()
    for old in folder_numbers(spark, fires, "tick"):
        if old <= tick_id - KEEP_SNAPSHOTS:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{fires}/tick={old}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def start_evaluation(
    spark: SparkSession, evaluate: Evaluate, out: str, checkpoint: str, every: str = EVERY
) -> StreamingQuery:
    """Evaluate on a timer; the rate source serves as the clock."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def run(rows: DataFrame, batch_id: int) -> None:
        # One row per second since the last pass; its latest time is the pass's `now`.
        now = rows.agg({"timestamp": "max"}).first()[0]
        if now is not None:
            tick(spark, evaluate, now, out, batch_id)

    writer = clock.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every).start()
