"""The size of Arrow batches that operators on texts ask Spark for, and the memory their workers keep."""

import ctypes

import pyarrow as pa
from pyspark.sql import SparkSession

ARROW_BYTES = 12 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Batches of at most ``ARROW_BYTES``, so that Python workers hold a few of them beside their own arrays. A smaller setting of
    the session stays. It holds for the session, as plans run after an operator has returned them."""
    told = spark.conf.get(_BYTES)
    digits = "".join(c for c in told if c.isdigit())
    bytes_ = int(digits or 0) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(told.lower().strip().lstrip("-0123456789")[:1], 1)
    if told.startswith("-") or not 0 < bytes_ <= ARROW_BYTES:
        spark.conf.set(_BYTES, str(ARROW_BYTES))


def trim() -> None:
    """Give freed memory back to the system: a worker lives on after a large group, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if free:
        free(0)


def trimmed_batches(function):
    """``function`` of a task's batches, with :func:`trim` after the last."""

    def run(batches):
        yield from function(batches)
        trim()

    return run


def trimmed(function):
    """``function`` of a group's table, with :func:`trim` after it."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return function(table)
        finally:
            trim()

    return run


def trimmed_pair(function):
    """``function`` of a key and the two tables of a cogroup, with :func:`trim` after it."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return function(key, left, right)
        finally:
            trim()

    return run
