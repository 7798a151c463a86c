"""Packing of token streams: first-fit decreasing with a tournament tree, run independently in randomised groups.

A document's stream is cut into full sequences and one rest. A full piece has a sequence of its own; the rests of a
group are taken in decreasing length, and each goes to the first sequence that still has room. A tournament tree whose
leaves are the rooms of the sequences finds it in logarithmic time. Groups are drawn by a hash, so they are of about
equal size whatever the sources, a task holds a few thousand lengths, and no group waits for another. Only lengths and
checksums are shuffled unless the ids are asked for.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes

LIMIT = 1024
#: Average documents of a group.
GROUP_DOCS = 8192
#: sequence_id = group * 2**SHIFT + number in the group.
SHIFT = 32

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, part int"


def first_fit_decreasing(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; ties keep the given order. Lengths are from 1 to ``limit``."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    leaves = 1
    while leaves < n:
        leaves *= 2
    room = [limit] * (2 * leaves)  # node i has children 2i and 2i+1; a node holds the largest room below it
    for item in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[item]), 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[item], offsets[item] = node - leaves, limit - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


@lru_cache(maxsize=2)
def ranks(path: str, special: tuple[tuple[str, int], ...]):
    """The byte-level vocabulary of a rank file; ids are those of the same vocabulary's JSON file in the tokenizers library."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=dict(special))


#: The special token that the JSON file adds to the ranks.
SPECIAL = (("<|endoftext|>", 50256),)


def pieces(docs: DataFrame, path: str, end_id: int = 0, limit: int = LIMIT, keep_ids: bool = False) -> DataFrame:
    """Encode and cut: one row per piece of the byte-level vocabulary at ``path`` (a rank file); a special token's string in a text is that token. ``part`` is a checksum that only serves to draw groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = ranks(path, SPECIAL)
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = enc.encode_to_numpy(text.decode("utf-8", "replace"), allowed_special="all").astype("<u4").tobytes() + end
                total = len(ids) // 4
                for start in range(0, total, limit):
                    piece = ids[4 * start : 4 * (start + limit)]
                    rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), total, piece if keep_ids else None, zlib.crc32(ids) & 0x7FFFFFFF))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64()] * 5 + [pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "part"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).mapInArrow(run, PIECE)


def pack_documents(
    docs: DataFrame, path: str, end_id: int = 0, limit: int = LIMIT, group_docs: int = GROUP_DOCS, seed: int = 7, keep_ids: bool = False
) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``; with ``keep_ids`` also their ids (binary).

    A null text is empty and gives one piece, the end id alone. Rows with equal or null doc_id are documents
    of their own. Equal lengths are placed in the order of doc_id and checksum, so the result does not depend on the partitioning.
    Other columns are not read; an empty table gives none.
    """
    groups = max(1, -(-docs.count() // group_docs))
    cut = pieces(docs, path, end_id, limit, keep_ids)
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "part", F.lit(seed)), F.lit(groups)).cast("long"))
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "part", "start", "ids_crc32"], kind="stable", na_position="first")
        lengths = group["length"].to_numpy(np.int64)
        full = lengths == limit
        bins, offsets = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        bins[full] = np.arange(int(full.sum()))
        rest, at = first_fit_decreasing(lengths[~full], limit)
        bins[~full], offsets[~full] = rest + int(full.sum()), at
        out = group[kept].copy()
        out["sequence_id"] = (int(group["group"].iloc[0]) << SHIFT) + bins
        out["offset"] = offsets
        return out[[c for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids") if c in out]]

    return dealt.select(*kept, "part", "group").groupBy("group").applyInPandas(place, schema)


def sequences(packed: DataFrame, limit: int = LIMIT, pad_id: int = 0) -> DataFrame:
    """Token arrays of the sequences (sequence_id, n_tokens, ids binary), padded; needs ``pack_documents(keep_ids=True)``.

    A sequence whose length is a power of two is left as it is, others are padded to ``limit``.
    """
    joined = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pad = np.array([pad_id], "<u4").tobytes()
        for batch in batches:
            ids, n = [], batch.column("n_tokens").to_pylist()
            for p, length in zip(batch.column("p").to_pylist(), n, strict=True):
                whole = length & (length - 1) == 0
                ids.append(b"".join(x["ids"] for x in p) + (b"" if whole else pad * (limit - length)))
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), batch.column("n_tokens"), pa.array(ids, pa.binary())], names=["sequence_id", "n_tokens", "ids"])

    return joined.mapInArrow(fill, "sequence_id long, n_tokens long, ids binary")
