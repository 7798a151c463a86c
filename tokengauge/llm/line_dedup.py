"""Removal of lines that many documents share, by a sharded minimal perfect hash.

1. Every document gives the 128-bit hashes of its distinct keys; counts and largest holders are aggregated with
   map-side combination, so a line of a third of the corpus is one row per task before the shuffle.
2. Hashes that reach the document limit are dealt into shards of bounded size by their own bits. A task builds for its
   shard a minimal perfect hash (levels of bits, a key sits on the first level where it is alone) and stores
   three arrays in slot order: 64-bit fingerprints, counts, largest holders. The shards are files in the shared folder.
3. Documents stay where they are: a task hashes their lines and probes the arrays, loading shards when it needs them and
   keeping a bounded number of bytes of them. No line is shuffled back to its document and nothing is broadcast.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, shared_path
from .common import mix, slices, text_bytes, without

#: Average keys of a shard.
SHARD_KEYS = 1 << 16
#: Bytes of shards that a worker keeps.
KEPT_BYTES = 128 << 20
#: Bits of a level for each key that is still without a place.
LOAD = 2.0
NO_ID = -(1 << 63)

INDEX = "shard long, keys long, levels binary, bits binary, fingerprints binary, counts binary, holders binary"


def line_key(line: bytes) -> bytes:
    """White space stripped at both ends, A-Z lower-cased (bytes methods touch only ASCII)."""
    return line.strip().lower()


def is_long(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), dtype="<i8").reshape(-1, 2)


def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    low, high = hashes.view(np.uint64).T
    salt = np.uint64((level * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1))
    return (mix(mix(low ^ salt) ^ high) % np.uint64(size)).astype(np.int64)


def build(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level sizes and bits of a minimal perfect hash over distinct 128-bit keys (rows of two integers)."""
    left, sizes, bits = hashes, [], []
    while len(left):
        size = int(len(left) * LOAD) + 1
        at = _place(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[at]]
    return np.array(sizes, dtype=np.int64), np.concatenate(bits) if bits else np.zeros(0, bool)


def slots(hashes: np.ndarray, sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 where no level has it. ``ranks``: set bits before each position."""
    out = np.full(len(hashes), -1, dtype=np.int64)
    left, start = np.arange(len(hashes)), 0
    for level, size in enumerate(sizes):
        at = start + _place(hashes[left], level, int(size))
        hit = bits[at]
        out[left[hit]] = ranks[at[hit]]
        left, start = left[~hit], start + int(size)
        if not len(left):
            break
    return out


def _ranks(bits: np.ndarray) -> np.ndarray:
    return np.cumsum(bits, dtype=np.int64) - bits


def _shard(group: pd.DataFrame) -> pd.DataFrame:
    hashes = np.ascontiguousarray(group[["low", "high"]].to_numpy(np.int64))
    sizes, bits = build(hashes)
    at = slots(hashes, sizes, bits, _ranks(bits))
    order = np.argsort(at)
    column = lambda name: group[name].to_numpy(np.int64)[order].astype("<i8").tobytes()
    return pd.DataFrame({
        "shard": [int(group["shard"].iloc[0])], "keys": [len(hashes)], "levels": [sizes.tobytes()], "bits": [np.packbits(bits).tobytes()],
        "fingerprints": [column("high")], "counts": [column("docs")], "holders": [column("holder")],
    })


def frequent_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """low, high, docs, holder of every line hash that at least ``least_docs`` documents hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, ids = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = {k for k in map(line_key, text.split(b"\n")) if is_long(k, least_chars)}
                keys.extend(own)
                ids.extend([doc] * len(own))
            h = _hashes(keys)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids, pa.int64())], names=["low", "high", "doc_id"])

    lines = docs.mapInArrow(run, "low long, high long, doc_id long")
    counted = lines.groupBy("low", "high").agg(F.countDistinct("doc_id").alias("docs"), F.max("doc_id").alias("holder"))
    return counted.where(F.col("docs") >= least_docs)


def build_index(frequent: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[str, int]:
    """Write the shards; returns their folder and number."""
    spark = frequent.sparkSession
    lines = materialize(frequent, "lines")
    shards = max(1, -(-lines.count() // shard_keys))
    path = shared_path(spark, "line-index")
    dealt = lines.withColumn("shard", F.pmod(F.col("high"), F.lit(shards)))
    dealt.groupBy("shard").applyInPandas(_shard, INDEX).write.partitionBy("shard").parquet(path)
    return path, shards


class Index:
    """Reads shards from the shared folder on demand."""

    def __init__(self, path: str):
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
        self.kept: OrderedDict[int, tuple] = OrderedDict()
        self.bytes = 0

    def shard(self, number: int) -> tuple | None:
        if number in self.kept:
            self.kept.move_to_end(number)
            return self.kept[number]
        folder = f"{self.path}/shard={number}"
        files = [x.path for x in self.fs.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True)) if x.path.endswith(".parquet")]
        got = None
        if files:
            with self.fs.open_input_file(files[0]) as f:
                row = pyarrow.parquet.read_table(f).to_pylist()[0]
            sizes = np.frombuffer(row["levels"], np.int64)
            bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(sizes.sum())).astype(bool)
            got = (sizes, bits, _ranks(bits), *[np.frombuffer(row[c], "<i8") for c in ("fingerprints", "counts", "holders")])
        self.kept[number] = got
        self.bytes += sum(x.nbytes for x in got or ())
        while self.bytes > KEPT_BYTES and len(self.kept) > 1:
            self.bytes -= sum(x.nbytes for x in self.kept.popitem(last=False)[1] or ())
        return got

    def probe(self, hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Count and holder of each (low, high); 0 where the index has no such line."""
        counts, holders = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        of = hashes[:, 1] % shards
        for number in np.unique(of):
            got = self.shard(int(number))
            if got is None:
                continue
            sizes, bits, ranks, prints, count, holder = got
            rows = np.flatnonzero(of == number)
            at = slots(hashes[rows], sizes, bits, ranks)
            ok = at >= 0
            ok[ok] = prints[at[ok]] == hashes[rows[ok], 1]
            counts[rows[ok]], holders[rows[ok]] = count[at[ok]], holder[at[ok]]
        return counts, holders


def dedup_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``docs`` with shared lines removed from ``text``, and ``n_lines``, ``n_dropped`` appended.

    Rows that share a doc_id are one document; null ids count as one document, smaller than all others. A null or
    empty text is one empty line. Equal keys inside one document count once, and all their lines go or stay together. Other
    columns pass through; input columns named n_lines or n_dropped are replaced. An empty table gives an empty table.
    """
    docs = without(docs, ["n_lines", "n_dropped"])
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    path, shards = build_index(frequent_lines(docs.select(ids.alias("doc_id"), text_bytes()), least_chars, least_docs), shard_keys)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(path)
        for batch in slices(batches, "__data"):
            texts, keys, where = [x.split(b"\n") for x in batch.column("__data").to_pylist()], [], []
            for doc, lines in enumerate(texts):
                for i, line in enumerate(lines):
                    if is_long(key := line_key(line), least_chars):
                        keys.append(key)
                        where.append((doc, i))
            counts, holders = index.probe(_hashes(keys), shards) if keys else (np.zeros(0, int),) * 2
            own = batch.column("__id").to_numpy(zero_copy_only=False)
            dropped = [0] * len(texts)
            n_lines = [len(x) for x in texts]
            for at in np.flatnonzero(counts >= least_docs):
                doc, i = where[at]
                if own[doc] != holders[at]:
                    texts[doc][i] = None
                    dropped[doc] += 1
            kept = pa.array([b"\n".join([x for x in lines if x is not None]) if d else b"\n".join(lines) for lines, d in zip(texts, dropped, strict=True)], pa.binary()).cast(pa.string())
            arrays = [kept if c == "text" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*columns, "n_lines", "n_dropped"])

    return docs.withColumns({"__id": ids, "__data": text_bytes()}).mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    done = dedup_lines(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
