"""Near-duplicate documents by SimHash fingerprints and covering locality-sensitive hashing.

Every bit position of the fingerprint gets a nonzero vector of r + 1 bits. Each nonzero vector v of that size is a table, whose mask
keeps the positions with an odd inner product with v: about half of them. The positions in which two fingerprints within radius r
differ have at most r vectors, so some v is orthogonal to all of them, and the pair agrees on that table's mask. No pair within the
radius is missed, whatever the data: 15 tables for radius 3.

Equal fingerprints are one node. A bucket is scanned in one task while it holds at most ``LIMIT`` nodes; the members of a larger one
are dealt out again by a covering of the positions which its mask left out. Three coverings leave at most seven positions, so every
bucket ends bounded, and still no pair is missed. A bucket sends a spanning tree of its links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import local_table, materialize
from .common import join_by_share, slices, text_bytes, text_parts
from .minhash import components

WORDS, SEED, BITS, RADIUS = 3, 42, 64, 3
#: Nodes of a bucket that one task holds at a time (8 bytes each, twice).
LIMIT = 1 << 16
#: All pairs of a bucket of this size are compared at once.
SMALL = 128
#: A slot of keys with more than this part of all rows is dealt out again before it meets in one task.
SHARE, SLOTS = 2000, 4096
#: Children of a member in the tree that a bucket sends.
FAN_OUT = 16


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint; zero for a text without a word."""
    ones, total, last = np.zeros(BITS, np.int64), 0, []

    def add(rows: list[bytes]) -> None:
        nonlocal total
        total += len(rows)
        bits = np.unpackbits(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 8), axis=1)
        np.add(ones, bits.sum(axis=0, dtype=np.int64), out=ones)

    for own in text_parts(text.lower()):
        last += own.split()
        ends = np.cumsum([len(w) + 1 for w in last]).tolist()
        if len(last) >= words:
            line, starts = b" ".join(last), [0, *ends[: len(last) - words]]
            hashes = [xxhash.xxh64_digest(line[a : b - 1], seed) for a, b in zip(starts, ends[words - 1 :], strict=True)]
            for i in range(0, len(hashes), 1 << 16):
                add(hashes[i : i + (1 << 16)])
            last = last[len(last) - words + 1 :]
    if not total and last:
        add([xxhash.xxh64_digest(b" ".join(last), seed)])
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).mapInArrow(run, "doc_id long, fp long")


def covering(free: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the positions ``free``: any set of ``radius`` of them is left out whole by some mask."""
    tables = 2 ** (radius + 1) - 1
    vectors = [1 + i % tables for i in range(len(free))]
    return [sum(1 << p for p, x in zip(free, vectors, strict=True) if (x & v).bit_count() % 2) for v in range(1, tables + 1)]


def left_out(mask: int) -> list[int]:
    return [p for p in range(BITS) if not mask >> p & 1]


def masks_below(mask: int, radius: int = RADIUS) -> np.ndarray:
    """The masks, each with ``mask`` kept, that cover the positions which ``mask`` left out."""
    return np.array([mask | m for m in covering(left_out(mask), radius)], np.uint64)


def _roots(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links a-b: the smallest label of each component."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def linked(fps: np.ndarray, mask: int, radius: int = RADIUS) -> np.ndarray:
    """Component label of each of the distinct fingerprints, which agree on ``mask``."""
    label = np.arange(len(fps))
    todo = [(np.arange(len(fps)), mask)]
    while todo:
        at, kept = todo.pop()
        if (label[at] == label[at[0]]).all():
            continue
        if len(at) <= SMALL:
            a, b = np.nonzero(np.bitwise_count(fps[at][:, None] ^ fps[at][None, :]) <= radius)
            label = _roots(label, at[a[a < b]], at[b[a < b]])
            continue
        for finer in masks_below(kept, radius):
            key = fps[at] & finer
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
            own = label[at[order]]
            mixed = np.minimum.reduceat(own, starts) < np.maximum.reduceat(own, starts)
            ends = np.append(starts[1:], len(order))
            todo += [(at[order[s:e]], int(finer)) for s, e in zip(starts[mixed].tolist(), ends[mixed].tolist(), strict=True)]
    return label


_LINK = "mask long, a long, a_doc long, b long, b_doc long"


def _dealt(nodes: DataFrame, radius: int) -> DataFrame:
    """One row per finer mask of each node (mask, fp, doc): mask, key, fp, doc."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            mask, fp, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "fp", "doc"))
            for m in np.unique(mask):
                if int(m) not in known:
                    known[int(m)] = masks_below(int(m) % 2**64, radius).view(np.int64)
                own = mask == m
                for finer in known[int(m)]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(own.sum(), finer)), pa.array(fp[own] & finer), pa.array(fp[own]), pa.array(doc[own])], names=["mask", "key", "fp", "doc"]
                    )

    return nodes.mapInArrow(run, "mask long, key long, fp long, doc long")


def _scanned(buckets: DataFrame, radius: int, limit: int) -> DataFrame:
    """Links of the buckets, mask 0; members of a bucket beyond ``limit`` come back with their mask instead (b is null)."""

    def links(mask: int, fp: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        label = linked(fp.view(np.uint64), mask % 2**64, radius)
        order = np.lexsort((doc, label))
        starts = np.flatnonzero(np.concatenate([[True], label[order][1:] != label[order][:-1]]))
        first = np.repeat(starts, np.diff(np.append(starts, len(order))))
        place = np.arange(len(order)) - first
        child = place > 0
        return order[child], order[(first + (place - 1) // FAN_OUT)[child]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=["mask", "a", "a_doc", "b", "b_doc"])

        def again(mask, fp, doc) -> tuple:
            return np.full(len(fp), mask), fp, doc, fp, doc

        held, large = [np.zeros(0, np.int64)] * 4, False  # the last bucket so far, which the next batch may continue
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "key", "fp", "doc")]
            goes_on = len(held[0]) and held[0][0] == new[0][0] and held[1][0] == new[1][0]
            mask, key, fp, doc = (np.concatenate([h, x]) for h, x in zip(held, new, strict=True))
            starts = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]))
            ends = np.append(starts[1:], len(mask))
            parts = []
            for i in np.flatnonzero((ends - starts > 1) | (starts == starts[-1])).tolist():
                s, e = starts[i], ends[i]
                large = large and i == 0 and bool(goes_on)
                if i == len(starts) - 1:
                    if large or e - s > limit:  # send what is here, keep one row as a mark of the bucket
                        fresh = s + 1 if large else s
                        parts.append(again(mask[s], fp[fresh:e], doc[fresh:e]))
                        s, large = e - 1, True
                    held = [x[s:e] for x in (mask, key, fp, doc)]
                elif large:
                    parts.append(again(mask[s], fp[s + 1 : e], doc[s + 1 : e]))
                elif e - s > limit:
                    parts.append(again(mask[s], fp[s:e], doc[s:e]))
                else:
                    a, b = links(int(mask[s]), fp[s:e], doc[s:e])
                    if len(a):
                        parts.append((np.zeros(len(a), np.int64), fp[s + a], doc[s + a], fp[s + b], doc[s + b]))
            yield from sent(parts)
        if len(held[0]) > 1 and not large:
            mask, _, fp, doc = held
            a, b = links(int(mask[0]), fp, doc)
            yield from sent([(np.zeros(len(a), np.int64), fp[a], doc[a], fp[b], doc[b])] if len(a) else [])

    dealt = buckets.repartition("mask", "key").sortWithinPartitions("mask", "key")
    return dealt.select("mask", "key", "fp", "doc").mapInArrow(run, _LINK)


def links(nodes: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """Trees (a, a_doc, b, b_doc) whose components are those of all pairs of ``nodes`` (fp distinct, doc) within ``radius`` bits."""
    found: list[DataFrame] = []
    todo = nodes.select(F.lit(0).cast("long").alias("mask"), "fp", "doc")
    while True:
        buckets = materialize(_dealt(todo, radius), "buckets")
        slot = F.pmod(F.xxhash64("key"), F.lit(SLOTS)).alias("slot")
        rows = buckets.count()
        # at most SHARE slots: more rows than that part of all
        hot = buckets.groupBy("mask", slot).count().where((F.col("count") * SHARE > rows) & (F.col("count") > limit)).drop("count").collect()
        rest, later = buckets, None
        if hot:
            marks = F.broadcast(local_table(nodes.sparkSession, [tuple(r) for r in hot], "mask long, slot long"))
            slotted = buckets.withColumn("slot", slot)
            rest = slotted.join(marks, ["mask", "slot"], "left_anti")
            later = slotted.join(marks, ["mask", "slot"], "left_semi").select("mask", "fp", "doc")
        scanned = materialize(_scanned(rest, radius, limit), "links")
        found.append(scanned.where("mask = 0").drop("mask"))
        more = scanned.where("mask <> 0").select("mask", F.col("a").alias("fp"), F.col("a_doc").alias("doc"))
        later = more if later is None else later.union(more)
        if later.isEmpty():
            break
        todo = later
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def near_duplicates(docs: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for every row of ``docs`` (doc_id, text).

    A-Z are lower-cased, words are what ASCII white space separates. Null and empty texts and those without a word have fingerprint zero
    and are linked like any other. A text of one or two words is one shingle. Repeated rows come back as often, with one component.
    Rows of one id and several texts are nodes of their own. A null id is the smallest of its component only if there is
    no other (component_id null; the largest long counts as null there). Other columns are not read. An empty table gives an empty one.
    """
    known = materialize(fingerprints(docs.select("doc_id", "text")), "fingerprints")
    nodes = known.groupBy("fp").agg(F.min("doc_id").alias("doc"), F.count("*").alias("rows"))
    last = F.lit(2**63 - 1)  # stands for a missing id, so that no field is null
    nodes = materialize(nodes.select("fp", F.coalesce("doc", last).alias("doc"), "rows"), "nodes")
    pairs = materialize(links(nodes, radius, limit), "pairs")
    node = lambda fp, doc: F.struct(F.col(doc).alias("doc"), F.col(fp).alias("fp"))
    labels = components(pairs.select(node("a", "a_doc").alias("a"), node("b", "b_doc").alias("b")), "labels")
    labels = labels.select(F.col("id.fp").alias("fp"), F.col("label.doc").alias("low"))
    top = nodes.join(labels, "fp", "left").select("fp", "rows", F.nullif(F.coalesce("low", "doc"), last).alias("component_id"))
    out = join_by_share(known, materialize(top, "top"), ["fp"], "rows", known.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
