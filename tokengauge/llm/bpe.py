"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last eight bytes decides where a text is cut, so equal passages of different texts
are cut at the same places and give the same chunks. A worker encodes a distinct chunk once and keeps its ids. What lies
around a cut (the end of one chunk, the start of the next) is then repaired: the region is encoded again together with a
whole word on either side, and counts only if the ids of these outer words are exactly those that the chunks have;
should a region ever disagree, its whole text is encoded again. Encoding needs no shuffle and no state beyond two
bounded tables in each worker.
"""

from __future__ import annotations

import os
import re
from array import array
from collections import ChainMap
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, text_bytes, without

WINDOW = 8
#: A cut is made where the top bits of the rolling hash are zero: every 2**CUT_BITS bytes on average.
CUT_BITS = 9
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Entries a worker keeps. When a table is full it starts afresh, so memory is bounded whatever the corpus.
WORDS_KEPT, CHUNKS_KEPT = 1_000_000, 20_000
#: Longer words are not kept.
LONGEST_WORD = 200

_GAP = re.compile(rb"[ \t\n\r]")
#: White space that libraries read differently; texts that hold it are encoded whole (keep_gaps only).
_ODD_GAP = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: White space after something else: a token of a byte-level vocabulary always starts there.
_BOUNDARY = re.compile(rb"(?<=[^ \t\n\r])[ \t\n\r]")
_PIECE = re.compile(rb"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")


def cuts(texts: list[bytes], bits: int = CUT_BITS) -> list[list[int]]:
    """Offsets at which each text is cut, from the hash of the eight bytes before each offset."""
    data = b"".join(texts)
    found = [np.zeros(0, np.int64)]
    for shift in range(min(WINDOW, max(0, len(data) - WINDOW))):
        windows = np.frombuffer(data, dtype="<u8", count=(len(data) - shift) // WINDOW, offset=shift)
        with np.errstate(over="ignore"):
            hit = np.flatnonzero(windows * _FACTOR < np.uint64(1 << (64 - bits)))
        found.append(hit * WINDOW + shift + WINDOW)
    at = np.sort(np.concatenate(found))
    ends = np.cumsum([0, *map(len, texts)])
    owner = np.searchsorted(ends, at, side="right") - 1
    place = at - ends[owner]
    ok = place >= WINDOW  # the window lies within one text, and the cut before its end
    split = np.searchsorted(owner[ok], np.arange(len(texts) + 1))
    place = place[ok].tolist()
    return [place[a:b] for a, b in zip(split, split[1:], strict=False)]


class Encoder:
    """Encodes texts exactly as ``Tokenizer.encode(text, add_special_tokens=False).ids`` does.

    ``keep_gaps`` is for byte-level vocabularies, whose tokens hold the white space before a word. Without it the
    vocabulary must drop white space, so that words between white space are independent of each other.
    """

    def __init__(self, path: str, keep_gaps: bool = False, cut_bits: int = CUT_BITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker on every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.keep_gaps, self.cut_bits = keep_gaps, cut_bits
        self.words: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, tuple] = {}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.tokens = np.array([self.tokenizer.id_to_token(i) or "" for i in range(size)], dtype=object)

    def _raw(self, texts: list[bytes]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in texts], add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in got]

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """A table that has all of ``words``; what it learns is kept for later texts, but for very long words."""
        new = list(words.difference(self.words))
        if len(self.words) + len(new) > WORDS_KEPT:
            self.words = {w: self.words[w] for w in words.intersection(self.words)}
        rare = {}
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.words.update(zip(part, self._raw(part), strict=True))
        for w in new:
            if len(w) > LONGEST_WORD:
                rare[w] = self.words.pop(w)
        return ChainMap(self.words, rare) if rare else self.words

    def _chunks(self, texts: list[bytes]) -> list[list[tuple[bytes, bytes]]]:
        """(digest, bytes) of the chunks of each text."""
        out = []
        for data, at in zip(texts, cuts(texts, self.cut_bits), strict=True):
            parts = [data[a:b] for a, b in zip([0, *at], [*at, len(data)], strict=True)]
            out.append([(xxhash.xxh3_128_digest(p), p) for p in parts if p])
        return out

    def _fragments(self, part: bytes) -> tuple[bytes, list[bytes], bytes]:
        """Start of a chunk up to its first white space, whole words, end after the last white space."""
        first = (_BOUNDARY if self.keep_gaps else _GAP).search(part)
        if first is None:
            return part, None, b""
        if self.keep_gaps:
            pieces = _PIECE.findall(part[first.start() :])
            return part[: first.start()], pieces[:-1], pieces[-1]
        pieces = part[first.start() :].split()
        tail = b"" if part[-1:].isspace() else pieces.pop()
        return part[: first.start()], pieces, tail

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        whole = {}
        if self.keep_gaps:
            whole = {i: None for i, x in enumerate(texts) if _ODD_GAP.search(x.decode("utf-8", "replace"))}
            for i, ids in zip(whole, self._raw([texts[i] for i in whole]), strict=True):
                whole[i] = ids
        cut = self._chunks([b"" if i in whole else x for i, x in enumerate(texts)])
        fresh = {key: part for doc in cut for key, part in doc if key not in self.chunks}
        split = {key: self._fragments(part) for key, part in fresh.items()}
        words = self._learn(set().union(*[body for _, body, _ in split.values() if body]))
        known = self.chunks
        if len(known) + len(split) > CHUNKS_KEPT:
            known = {key: known[key] for doc in cut for key, _ in doc if key in known}
        for key, (head, body, tail) in split.items():
            ids = None if body is None else b"".join(map(words.__getitem__, body))
            known[key] = (head, ids, tail, *((body[0], body[-1]) if body else (b"", b"")))
        self.chunks = known

        plans, joints = [], []
        for doc in cut:
            plan: list = []  # ids of chunk bodies, and numbers of joints between them
            carry, before = b"", b""
            for key, part in doc:
                head, ids, tail, first, last = known[key]
                if ids is None:
                    carry += head
                    continue
                if carry + head:
                    plan.append(len(joints))
                    joints.append((before, carry + head, first))
                plan.append(ids)
                carry, before = tail, last
            if carry:
                plan.append(len(joints))
                joints.append((before, carry, b""))
            plans.append(plan)
        repaired = self._repair(joints)
        done: list = []
        for i, plan in enumerate(plans):
            ids = [repaired[x] if type(x) is int else x for x in plan]
            done.append(whole[i] if i in whole else self._raw([texts[i]])[0] if None in ids else b"".join(ids))
        return done

    def _repair(self, joints: list[tuple[bytes, bytes, bytes]]) -> list[bytes | None]:
        """Ids of each joint, encoded between the whole words on its two sides; None if these come out otherwise there."""
        space = b"" if self.keep_gaps else b" "
        regions = self._raw([space.join(x) for x in joints])
        words = self._learn({w for a, _, b in joints for w in (a, b) if w})
        out: list[bytes | None] = []
        for (a, _, b), ids in zip(joints, regions, strict=True):
            left, right = words[a] if a else b"", words[b] if b else b""
            agree = len(ids) >= len(left) + len(right) and ids.startswith(left) and ids.endswith(right)
            out.append(ids[len(left) : len(ids) - len(right)] if agree else None)
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included, for a vocabulary without a decoder (tokens joined by spaces)."""
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        return " ".join(self.tokens[np.frombuffer(ids, "<u4")].tolist())


@lru_cache(maxsize=4)
def encoder(path: str, keep_gaps: bool, cut_bits: int = CUT_BITS) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    return Encoder(path, keep_gaps, cut_bits)


SCHEMA = T.StructType().add("n_tokens", "long").add("ids", "binary").add("decoded", "string")


def encode_documents(
    docs: DataFrame, path: str, text: str = "text", keep_gaps: bool = False, decode: bool = True
) -> DataFrame:
    """Append ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and ``decoded`` to every row.

    A null text is encoded as the empty one: no ids, decoded "". Repeated rows give equal results; other columns pass
    through, nulls included, and input columns named like the three outputs are replaced. ``path`` is a vocabulary file that every worker can read.
    """
    keep = without(docs, ["n_tokens", "ids", "decoded"])
    schema = T.StructType([*keep.schema.fields, *SCHEMA.fields])
    columns = keep.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, keep_gaps)
        for batch in slices(batches, "__data"):
            ids = enc.encode(batch.column("__data").to_pylist())
            decoded = [enc.decode(x) for x in ids] if decode else [None] * len(ids)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                names=[*columns, "n_tokens", "ids", "decoded"],
            )

    return keep.withColumn("__data", text_bytes(text)).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    encoded = encode_documents(docs.select("doc_id", "text").withColumnRenamed("text", "__text"), path, "__text")
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
