"""Spelling variants by permuterm rotations.

A word is marked at its end and turned to all its rotations. Two words that differ in one replaced character have rotations that agree but for their
last character: the prefix that skips it is the same. A word that lacks that character is, in one of its rotations, this prefix itself. So a
word sends every rotation as it is, and every rotation without its last character; when these are sorted, a group of equal
prefixes holds one word at most that lacks the character, and no more others than the alphabet has letters. Groups are scanned, and a member sends
how many neighbours it has there and the most frequent of them, not its pairs. A character in a run of equal ones is skipped for its absence at the
last place of the run only, so each neighbour is counted once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import slices, text_bytes, text_parts

#: Words have at least this many code points and occurrences; a form is at least RATIO times as frequent.
LEAST_CHARS, LEAST_COUNT, RATIO = 5, 3, 2
#: One in so many (document, run) pairs loses a character, as the contract of the operator's query says.
DAMAGED = 97
_RUN = re.compile("[a-zÀ-ÿ]+")
_END = "$"
#: Words that a task counts before it sends them on.
HELD = 1 << 18
#: Prefixes of more code points are sent as fingerprints, so that a very long word sends as many bytes as it has characters.
LONGEST = 64
_PRIME, _BASE = (1 << 127) - 1, 0x9E3779B97F4A7C15F39CC0605CEDC835


def counted_words(docs: DataFrame, damaged: int = DAMAGED) -> DataFrame:
    """word, n: runs of letters in all texts, A-Z lower-cased, each as the damage of its document leaves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in slices(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                start = zlib.crc32(b"%s:" % ("" if doc is None else str(doc)).encode())
                for part in text_parts(text.lower()):
                    for word, n in Counter(_RUN.findall(part.decode())).items():
                        if (h := zlib.crc32(word.encode(), start)) % damaged == 0:
                            word = word[: h % len(word)] + word[h % len(word) + 1 :]
                        if len(word) >= LEAST_CHARS:
                            total[word] += n
                    if len(total) > HELD:
                        yield flush()
        if total:
            yield flush()

    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _fingerprints(word: str) -> tuple[list[int], list[int]]:
    """Of a long word: a fingerprint of each rotation without its last character, and of each rotation."""
    heads, powers = [0], [1]
    for c in word:
        heads.append((heads[-1] * _BASE + ord(c)) % _PRIME)
        powers.append(powers[-1] * _BASE % _PRIME)
    n, mark = len(word), ord(_END)

    def key(a: int, b: int) -> int:  # word[b:] + mark + word[:a]
        tail = (heads[n] - heads[b] * powers[n - b]) % _PRIME
        return ((tail * _BASE + mark) * powers[a] + heads[a]) % _PRIME

    return [key(i, i + 1) for i in range(n)], [key(i, i) for i in range(n + 1)]


ABSENT, REPLACED, EITHER = 0, 1, 2


def prefixes(word: str, longest: int = LONGEST) -> list[tuple[str, int]]:
    """The keys of a word: rotations (ABSENT), and rotations without their last character, which another word may replace or also lack (EITHER)."""
    n = len(word)
    if n < longest:
        skipped = [word[i + 1 :] + _END + word[:i] for i in range(n)]
        whole = [word[i:] + _END + word[:i] for i in range(n + 1)]
    else:
        skipped, whole = ([f"{n + i}:{k:032x}" for k in keys] for i, keys in enumerate(_fingerprints(word)))
        if n == longest:
            skipped = [word[i + 1 :] + _END + word[:i] for i in range(n)]
    kinds = [EITHER if i == n - 1 or word[i] != word[i + 1] else REPLACED for i in range(n)]
    return [*zip(skipped, kinds, strict=True), *((k, ABSENT) for k in whole)]


def neighbours(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """wid, n_near, best (minus the count of the most frequent neighbour, its wid) of the words (wid, word, n) that have a neighbour; wid in the words' order."""

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "word"):
            columns: list[list] = [[], [], [], []]
            for wid, word, n in zip(*(batch.column(c).to_pylist() for c in ("wid", "word", "n")), strict=True):
                own = prefixes(word, longest)
                for into, values in zip(columns, ([k for k, _ in own], [wid] * len(own), [n] * len(own), [k for _, k in own]), strict=True):
                    into += values
                if len(columns[0]) > 1 << 17:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns[:3]] + [pa.array(columns[3], pa.int32())], names=["prefix", "wid", "n", "kind"])
                    columns = [[], [], [], []]
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns[:3]] + [pa.array(columns[3], pa.int32())], names=["prefix", "wid", "n", "kind"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(members: list[tuple[int, int, int]], out: list[tuple]) -> None:
            """``members`` (-n, wid, kind), the most frequent first."""
            skipped = [m for m in members if m[2] != ABSENT]
            lacks = [m for m in members if m[2] == ABSENT]
            either = [m for m in skipped if m[2] == EITHER]
            for m in skipped:
                others = len(skipped) - 1
                best = skipped[m is skipped[0]][:2] if others else None
                if lacks and m[2] == EITHER:
                    others += 1
                    best = min(best, lacks[0][:2]) if best else lacks[0][:2]
                if others:
                    out.append((m[1], others, *best))
            if lacks and either:
                out.append((lacks[0][1], len(either), *either[0][:2]))

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            key = table.column("prefix").combine_chunks()
            new = np.concatenate([[True], pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)])
            starts = np.flatnonzero(new)
            held = table.slice(int(starts[-1]))  # the last group may go on; no group has more rows than letters
            ends = np.append(starts[1:], len(new))
            yield from sent(table, [(s, e) for s, e in zip(starts[:-1].tolist(), ends[:-1].tolist(), strict=True) if e - s > 1], group)
        if held is not None:
            yield from sent(held, [(0, held.num_rows)], group)

    def sent(table: pa.Table, spans: list[tuple[int, int]], group) -> Iterator[pa.RecordBatch]:
        n, wid, kind = (table.column(c).to_numpy() for c in ("n", "wid", "kind"))
        out: list[tuple] = []
        for s, e in spans:
            group(list(zip((-n[s:e]).tolist(), wid[s:e].tolist(), kind[s:e].tolist(), strict=True)), out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["wid", "near", "neg", "other"])

    turned = words.select("wid", F.col("word"), "n").mapInArrow(rotate, "prefix string, wid long, n long, kind int")
    ordered = turned.repartition("prefix").sortWithinPartitions("prefix", F.desc("n"), "wid")
    found = ordered.mapInArrow(scan, "wid long, near long, neg long, other long")
    return found.groupBy("wid").agg(F.sum("near").alias("n_near"), F.min(F.struct("neg", "other")).alias("best"))


def variants(docs: DataFrame, damaged: int = DAMAGED, longest: int = LONGEST) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs`` (doc_id, text).

    Runs are of a-z, A-Z (lower-cased) and U+00C0 to U+00FF. Null, empty and letterless texts have none. Repeated rows count as often as they come. A null
    doc_id reads as an empty one where damage is drawn. Of neighbours with one count the smallest in code-point order is the form. Very long
    runs are words like others. Other columns are not read. An empty table gives an empty one.
    """
    counts = counted_words(docs.select("doc_id", "text"), damaged)
    ids = materialize(materialize(counts, "counts").repartitionByRange("word").sortWithinPartitions("word").withColumn("wid", F.monotonically_increasing_id()), "words")
    near = ids.join(neighbours(ids, longest), "wid", "left")
    form = F.expr(f"if(-best.neg >= {RATIO} * n, best, null)")
    words = materialize(near.select("wid", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form.alias("form")), "near")
    # roots from the words without a form down: a word joins its form, which has few neighbours, never its root, which may have many words
    done = words.where("form is null").select("wid", "word", "n", "n_near", F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n"), F.col("word").alias("root"))
    level, rest = done, words.where("form is not null").select("wid", "word", "n", "n_near", F.col("form.other").alias("up"), (-F.col("form.neg")).alias("form_n"))
    while True:
        above = level.select(F.col("wid").alias("up"), F.col("word").alias("form"), "root")
        level = materialize(rest.join(above, "up").select("wid", "word", "n", "n_near", "form", "form_n", "root"), "level")
        if level.isEmpty():
            return done.select("word", "form", "root", "n", "n_near", "form_n")
        done = done.union(level)
