"""Helpers of the llm operators: Arrow batches, text buffers and sorted groups."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftgraph.shipping import ship
from weftgraph.storage import small_enough

__all__ = ["as_bytes", "bound_batches", "small_enough", "sorted_runs", "table", "text_buffer"]



def _lean() -> None:
    """Let this process give freed memory back to the system, as a few Python workers share an executor's memory limit."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        malloc = ctypes.CDLL("libc.so.6").mallopt
    except OSError:  # another C library
        return
    for option, value in ((-3, 8 << 20), (-1, 16 << 20), (-8, 2)):  # fixed values of mallopt: M_MMAP_THRESHOLD, M_TRIM_THRESHOLD, M_ARENA_MAX
        malloc(option, value)


_lean()

#: Rows and bytes of one Arrow batch: a Python worker holds a few batches at a time, whatever the texts' lengths.
BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to a size that a small Python worker can take, and send the code to the executors."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch as one byte array, and the offsets of the texts in it; null is empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buffer[ends[0] : ends[-1]], ends - ends[0]


def sorted_runs(batches: Iterator[pa.RecordBatch], key: str, most: int = 1 << 62) -> Iterator[tuple[pa.Table, bool]]:
    """Cut a stream sorted by `key` into tables that never split a key's rows.

    A key of more than `most` rows comes in pieces, marked True; other tables hold many whole keys.
    """
    rest: list[pa.Table] = []
    held, open_key, piecewise = 0, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        keys = part.column(key).to_numpy()
        if piecewise:  # the rows of the large key go on
            n = int(np.searchsorted(keys != open_key, True)) if keys[-1] != open_key else len(keys)
            if n:
                yield part.slice(0, n), True
            if n == len(keys):
                continue
            part, keys, piecewise = part.slice(n), keys[n:], False
        last = int(np.searchsorted(keys, keys[-1]))
        if last or open_key != keys[-1]:
            whole = [*rest, part.slice(0, last)]
            if held + last:
                yield pa.concat_tables(whole).combine_chunks(), False
            rest, held, open_key = [], 0, keys[-1]
        rest.append(part.slice(last))
        held += len(keys) - last
        if held > most:
            yield pa.concat_tables(rest).combine_chunks(), True
            rest, held, piecewise = [], 0, True
    if held:
        yield pa.concat_tables(rest).combine_chunks(), False
