"""Memory of tasks that run Python: small Arrow batches, and what a task has freed goes back to the system.

Spark keeps its Python workers for later stages.  The pools of Arrow and of the C library keep what was
freed, so without this a worker stays as large as its largest task was, beside an executor that has grown as well.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession

from signalfold.scale import SESSION_SETTINGS

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library may have none


def small_batches(spark: SparkSession) -> None:
    """Rows travel in batches of the number that the jobs are written for, or of a smaller one that is set."""
    most, now = int(SESSION_SETTINGS[_ROWS]), int(spark.conf.get(_ROWS))
    if not 0 < now <= most:
        spark.conf.set(_ROWS, str(most))


def give_back() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that gives back memory after its last batch."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def freed(of_group: Callable[..., Any], *tables: Any) -> Any:
    """What a function of a group returns, after its memory is given back."""
    try:
        return of_group(*tables)
    finally:
        give_back()
