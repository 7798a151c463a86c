"""Sums of per-partition arrays, combined in rounds so that the driver sees few of them; and fits that share out a table of one block."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Partial results that one combining task, or the driver, adds up.
FAN_IN = 32
SCHEMA = "sums binary, peaks binary"
#: A table of at most so many rows of numbers is a block, which may be sent to every task.
BLOCK_ROWS = 1 << 16

Update = Callable[[dict, np.ndarray, np.ndarray], None]
#: Runs an update over all rows: (update, shape, peaks) -> (sums, peaks).
Pass = Callable[[Update, tuple[int, ...], int], tuple[np.ndarray, np.ndarray]]


def _pack(sums: np.ndarray, peaks: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "sums": pa.array([sums.tobytes()], pa.binary()),
            "peaks": pa.array([peaks.tobytes()], pa.binary()),
        }
    )


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = peak = None
    for batch in batches:
        for s, m in zip(batch.column(0), batch.column(1)):
            s, m = np.frombuffer(s.as_py()), np.frombuffer(m.as_py())
            total = s.copy() if total is None else total + s
            peak = m.copy() if peak is None else np.maximum(peak, m)
    if total is not None:
        yield _pack(total, peak)


def sum_over(
    df: DataFrame,
    columns: Sequence[str],
    update: Update,
    shape: tuple[int, ...],
    peaks: int = 1,
    partitions: int | None = None,
    floor: float = 0.0,
) -> tuple[np.ndarray, np.ndarray]:
    """Run ``update(batch, sums, peaks)`` over all rows and add the results up.

    ``batch`` holds each column as an array. ``sums`` (of ``shape``) is added
    and ``peaks``, which starts at ``floor``, is maximised across partitions. The arrays have the size of
    the model grid, never of the data.
    """
    columns = list(columns)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, top = np.zeros(shape), np.full(peaks, floor)
        for batch in batches:
            if batch.num_rows:
                update({c: as_numpy(batch.column(c)) for c in columns}, sums, top)
        yield _pack(sums, top)

    partials = df.select(*columns).mapInArrow(fold, SCHEMA)
    left = partitions if partitions is not None else df.rdd.getNumPartitions()
    while left > FAN_IN:
        left = math.ceil(left / FAN_IN)
        partials = partials.repartition(left).mapInArrow(_add, SCHEMA)
    rows = partials.collect()
    sums = np.zeros(shape)
    top = np.full(peaks, floor)
    for row in rows:
        sums += np.frombuffer(row["sums"]).reshape(shape)
        top = np.maximum(top, np.frombuffer(row["peaks"]))
    return sums, top


def as_numpy(column: pa.Array) -> np.ndarray:
    """Numbers with null as NaN; arrays of numbers as a matrix; text as dictionary codes."""
    if pa.types.is_list(column.type):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(column), -1)
    if pa.types.is_boolean(column.type) or pa.types.is_string(column.type):
        return column.to_numpy(zero_copy_only=False)
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def spark_pass(table: DataFrame, columns: Sequence[str]) -> Pass:
    """Passes over a stored table."""
    partitions = table.rdd.getNumPartitions()
    return lambda update, shape, peaks=1: sum_over(table, columns, update, shape, peaks, partitions)


def block_pass(block: dict[str, np.ndarray]) -> Pass:
    """The same over rows that are all here."""

    def run(update: Update, shape: tuple[int, ...], peaks: int = 1) -> tuple[np.ndarray, np.ndarray]:
        sums, top = np.zeros(shape), np.zeros(peaks)
        if len(next(iter(block.values()))):
            update(block, sums, top)
        return sums, top

    return run


def block_of(table: DataFrame, columns: Sequence[str]) -> dict[str, np.ndarray]:
    """Columns of a table of at most ``BLOCK_ROWS`` rows, as its callers have counted."""
    whole = table.select(*columns).toArrow()
    return {c: as_numpy(whole.column(c).combine_chunks()) for c in columns}


def share_out(spark: SparkSession, shared: object, jobs: int, work: Callable[[object, int], object]) -> list:
    """``work(shared, i)`` of every job in tasks of Spark; results are models, bounded by the grid."""
    sent = spark.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([pickle.dumps(work(sent.value, i))], pa.binary())], names=["i", "result"])

    rows = spark.range(0, jobs, 1, max(1, jobs)).mapInArrow(run, "i long, result binary").collect()
    return [pickle.loads(r["result"]) for r in sorted(rows, key=lambda r: r["i"])]
