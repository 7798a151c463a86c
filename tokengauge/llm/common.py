"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: Texts are handled in slices of about this many bytes inside a task, whatever the Arrow batch holds.
SLICE_BYTES = 4 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def without(df: DataFrame, own: Iterable[str]) -> DataFrame:
    """``df`` without input columns that an operator is about to write itself (names compare case-blind)."""
    names = {x.lower() for x in own}
    return df.drop(*[c for c in df.columns if c.lower() in names])


def text_bytes(text: str = "text") -> Column:
    """The text as UTF-8; a null text is empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about ``SLICE_BYTES`` of ``column``; a longer single text is one slice."""
    for batch in batches:
        sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)], dtype=np.int64)
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if total and total + size > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


#: Bytes of a text that are split into words at a time.
PART_BYTES = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def text_parts(text: bytes) -> Iterator[bytes]:
    """A text in bounded parts, cut where a white space begins, so that no word is cut."""
    start = 0
    while start < len(text):
        gap = _GAP.search(text, start + PART_BYTES)
        end = gap.start() if gap else len(text)
        yield text[start:end]
        start = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (the one of the splitmix generator), elementwise."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


#: A key with more than this part of all rows is joined by broadcast: fewer keys than this can be so frequent.
KEY_SHARE = 1000


def join_by_share(left: DataFrame, right: DataFrame, keys: list[str], rows: str, total: int, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, unique in ``keys`` (never null), without one task for a frequent key.

    The column ``rows`` of ``right`` counts the rows of ``left`` with the key and does not come out; ``total`` is the
    sum of these counts. At most ``KEY_SHARE`` keys hold more than that part of all rows: they are
    broadcast. The others are joined by merging, where no key can make a task much larger than the rest.
    """
    often = F.col(rows) * KEY_SHARE > total
    some = F.broadcast(right.where(often).drop(rows))
    frequent = left.join(some, keys)
    rest = left.join(F.broadcast(right.where(often).select(*keys)), keys, "left_anti")
    return frequent.unionByName(rest.join(right.where(~often).drop(rows).hint("merge"), keys, how))
