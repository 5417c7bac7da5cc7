"""What Python workers keep from task to task.

Spark gives the workers of one stage to the next, so what an operator keeps would stay beside what later operators need. A worker holds
one thing at a time, and lets it go when a task of another operator begins.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows of an Arrow batch, where the session has Spark's own 10,000: texts of some KB fill buffers of many MB in both processes.
BATCH_ROWS = 1000
_BATCH, _SPARKS_OWN = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"

_held: dict[Hashable, object] = {}


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def release() -> None:
    if _held:
        _held.clear()
        give_back()


def held(key: Hashable, make: Callable[[], object]):
    """make(), kept until something else is asked for."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def alone(run):
    """The function of batches `run`, begun without what other operators hold; freed memory goes back when it ends."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        release()
        yield from run(batches)
        give_back()

    return task


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches, unless the session has a size of its own."""
    if spark.conf.get(_BATCH) == _SPARKS_OWN:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
