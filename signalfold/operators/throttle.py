"""Alert throttling: fire only when the last fire of the same target is old enough.

Whether an attempt fires depends on the last *fire*, so the decision is a chain over time.
To keep a busy target from becoming one long task, all attempts are put in order of target and time
and cut into chunks of so many rows, wherever a target ends:

1. every chunk is reduced, on its own, to a step function "earliest time a fire is allowed ->
   last fire in this chunk";
2. the functions of a target are applied one after the other as they stream by in order of time, which
   gives the state each chunk starts with; a task holds one number and one chunk's steps;
3. every chunk, again on its own, lists its fires.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalfold.scale import work_dir

KEYS = ["rule_id", "dedupe_key"]
CHUNK_KEYS = [*KEYS, "_chunk"]
CHUNK_ROWS = 1 << 17


def _next_allowed(times: np.ndarray, gap: int) -> np.ndarray:
    """Index of the first attempt at least `gap` after each attempt (len = none)."""
    return np.searchsorted(times, times + gap, side="left")


def _last_of_chain(times: np.ndarray, gap: int) -> np.ndarray:
    """Index of the last fire of the chain that starts with a fire at each attempt."""
    following = _next_allowed(times, gap)
    reach = np.where(following < len(times), following, np.arange(len(times)))
    while True:
        further = reach[reach]
        if np.array_equal(further, reach):
            return reach
        reach = further


def chunk_steps(times: np.ndarray, gap: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(upper bounds, last fires): entering with `allowed` <= bound ends with that last fire.

    A state from before the chunk allows a fire at `start + gap` at the latest, so later
    attempts never come first.
    """
    last = times[_last_of_chain(times, gap)]
    can_be_first = np.concatenate(([True], times[:-1] < start + gap))
    bounds, last = times[can_be_first], last[can_be_first]
    keep = np.concatenate((last[1:] != last[:-1], [True]))
    return bounds[keep], last[keep]


def chunk_fires(times: np.ndarray, gap: int, allowed: int | None) -> np.ndarray:
    """Fires of one chunk given the earliest allowed time."""
    following = _next_allowed(times, gap)
    at = 0 if allowed is None else int(np.searchsorted(times, allowed, side="left"))
    fires = []
    while at < len(times):
        fires.append(at)
        at = int(following[at])
    return times[fires]


def _steps(pdf: pd.DataFrame) -> pd.DataFrame:
    times = np.unique(pdf["_at"].to_numpy("int64"))
    first = pdf.iloc[0]
    bounds, last = chunk_steps(times, int(first["_gap"]), int(times[0]))
    keys = {k: [first[k]] for k in [*CHUNK_KEYS, "_gap"]}
    return pd.DataFrame({**keys, "_bounds": [bounds], "_lasts": [last]})


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Earliest allowed time at the start of every chunk; rows come by target, then chunk."""
    target, allowed = object(), None
    for batch in batches:
        states = []
        bounds, lasts = batch.column("_bounds"), batch.column("_lasts")
        keys = zip(*[batch.column(k).to_pylist() for k in KEYS], batch.column("_gap").to_pylist(), strict=True)
        for i, (*key, gap) in enumerate(keys):
            if key != target:
                target, allowed = key, None
            states.append(allowed)
            steps = bounds[i].values.to_numpy()
            at = 0 if allowed is None else int(np.searchsorted(steps, allowed, side="left"))
            if at < len(steps):
                allowed = int(lasts[i].values[at].as_py()) + gap
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(k) for k in CHUNK_KEYS], pa.array(states, pa.int64())], names=[*CHUNK_KEYS, "_allowed"]
        )


def _fires(pdf: pd.DataFrame) -> pd.DataFrame:
    times = np.unique(pdf["_at"].to_numpy("int64"))
    first = pdf.iloc[0]
    allowed = None if pd.isna(first["_allowed"]) else int(first["_allowed"])
    fired = chunk_fires(times, int(first["_gap"]), allowed)
    return pd.DataFrame({**{k: first[k] for k in KEYS}, "_at": fired})


def _kept(df: DataFrame) -> DataFrame:
    path = work_dir(df.sparkSession, "throttle")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunked(points: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Points with `_chunk`: stretches of about `chunk_rows` rows in order of target and time.

    Range partitioning draws its bounds anew each time it runs, so chunks are written down.
    """
    points = _kept(points)
    chunks = points.count() // chunk_rows + 1
    if chunks == 1:
        return points.withColumn("_chunk", F.lit(0))
    return _kept(points.repartitionByRange(chunks, *KEYS, "_at").withColumn("_chunk", F.spark_partition_id()))


def fired_times(attempts: DataFrame, history: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(rule_id, dedupe_key, at) of the attempts that fire.

    `attempts` has rule_id, dedupe_key, at and throttle_seconds; `history` (rule_id,
    dedupe_key, fired_at) holds earlier fires.
    """
    kind = attempts.schema["at"].dataType
    gap = F.greatest(F.col("throttle_seconds").cast("long") * 1_000_000, F.lit(1))
    points = (
        attempts.groupBy(*KEYS, "at")
        .agg(F.max(gap).alias("_gap"))
        .withColumn("_at", F.unix_micros(F.col("at").cast("timestamp")))
        .drop("at")
    )
    if history is not None:
        # Attempts too close to the last recorded fire never fire; the rest start afresh.
        prior = history.groupBy(*KEYS).agg(
            F.unix_micros(F.max("fired_at").cast("timestamp")).alias("_prior")
        )
        points = points.join(prior, KEYS, "left")
        points = points.filter(F.col("_prior").isNull() | (F.col("_at") >= F.col("_prior") + F.col("_gap")))
        points = points.drop("_prior")
    points = chunked(points, chunk_rows)
    types = {f.name: f.dataType for f in points.schema}
    key_fields = [T.StructField(k, types[k]) for k in KEYS]
    chunk_field = T.StructField("_chunk", types["_chunk"])
    long = T.LongType()
    state_schema = T.StructType([*key_fields, chunk_field, T.StructField("_allowed", long)])
    steps_schema = T.StructType(
        [*key_fields, chunk_field, T.StructField("_gap", long)]
        + [T.StructField(n, T.ArrayType(long)) for n in ("_bounds", "_lasts")]
    )
    steps = points.groupBy(*CHUNK_KEYS).applyInPandas(_steps, steps_schema)
    states = steps.repartition(*KEYS).sortWithinPartitions(*CHUNK_KEYS).mapInArrow(_states, state_schema)
    fires = (
        points.join(states, CHUNK_KEYS)
        .groupBy(*CHUNK_KEYS)
        .applyInPandas(_fires, T.StructType([*key_fields, T.StructField("_at", long)]))
    )
    return fires.select(*KEYS, F.timestamp_micros("_at").cast(kind).alias("at"))


def claim(attempts: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """The attempts that fire, with all their columns; attempts at one instant fire once."""
    rest = [c for c in attempts.columns if c not in (*KEYS, "at")]
    texts = [c for c in rest if isinstance(attempts.schema[c].dataType, T.StringType)]
    order = F.struct(*texts) if texts else F.lit(0)
    single = attempts.groupBy(*KEYS, "at").agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return single.join(fired_times(attempts, history), [*KEYS, "at"]).select(*KEYS, "at", "_row.*")


def claim_in_order(times: Iterator[int], gap: int, last: int | None) -> tuple[list[int], int | None]:
    """Fires among ascending times given the last fire; used by the streaming state."""
    fires = []
    for at in times:
        if last is None or at - last >= gap:
            fires.append(at)
            last = at
    return fires, last
