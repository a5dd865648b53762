"""The alert stream: signals meet the rules, throttled per rule and target."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from signalfold import schemas
from signalfold.operators import alerts
from signalfold.operators.throttle import claim_in_order
from signalfold.streaming.batches import keyed_state

SIGNAL_COLUMNS = (
    "kind string, project_id long, issue_id long, group_hash {hash}, title string, culprit string, "
    "level string, release string, environment string, at timestamp"
)


class ThrottleProcessor(StatefulProcessor):
    """Keeps the last fire of one (rule, target) and lets later attempts through or not."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", T.StructType([T.StructField("us", T.LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        # Signals are state changes of one issue, so one target has few in a batch.
        by_time = sorted((row["at_us"], row["throttle_seconds"], row["body"]) for row in rows)
        last = self.last.get()[0] if self.last.exists() else None
        for at, seconds, body in by_time:
            fired, last = claim_in_order([at], seconds * 1_000_000, last)
            if fired:
                yield Row(rule_id=key[0], dedupe_key=key[1], at_us=at, body=body)
        if last is not None:
            self.last.update((last,))

    def close(self) -> None:
        pass


FIRED = "rule_id long, dedupe_key string, at_us long, body string"


def throttled(attempts: DataFrame) -> DataFrame:
    """Fires of a stream of attempts; other columns travel as JSON text."""
    rest = [c for c in attempts.columns if c not in ("rule_id", "dedupe_key", "at", "throttle_seconds")]
    body_type = T.StructType([attempts.schema[c] for c in rest])
    slim = attempts.select(
        F.col("rule_id").cast("long").alias("rule_id"),
        "dedupe_key",
        F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"),
        F.col("throttle_seconds").cast("long").alias("throttle_seconds"),
        F.to_json(F.struct(*rest)).alias("body"),
    )
    fired = slim.groupBy("rule_id", "dedupe_key").transformWithState(
        statefulProcessor=ThrottleProcessor(),
        outputStructType=schemas.struct(FIRED),
        outputMode="Append",
        timeMode="None",
    )
    return fired.select(
        "rule_id", "dedupe_key", F.timestamp_micros("at_us").alias("at"),
        F.from_json("body", body_type).alias("_b"),
    ).select("rule_id", "dedupe_key", "at", "_b.*")


def signal_stream(spark: SparkSession, path: str, hash_type: str = "long", files: int = 1000) -> DataFrame:
    """Signals of committed batches, as they appear."""
    reader = spark.readStream.schema(SIGNAL_COLUMNS.format(hash=hash_type) + ", batch long")
    return reader.option("maxFilesPerTrigger", files).parquet(path).drop("batch")


def start_alerts(
    signals: DataFrame,
    rules: DataFrame,
    out: str,
    checkpoint: str,
    dashboard: str = "",
    available_now: bool = False,
) -> StreamingQuery:
    """Notifications as an append-only table, written exactly once by the file sink."""
    keyed_state(signals.sparkSession, available_now)
    attempts = alerts.with_channels(alerts.match_signals(signals, rules, dashboard))
    records = alerts.notifications(throttled(attempts))
    writer = records.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": "1 second"}
    return writer.trigger(**trigger).start(out)
