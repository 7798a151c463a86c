"""Exact quantiles of groups of any size, of several columns at once, in a fixed number of passes.

A double is read as 64 bits in an order that sorts like its value, and these as three digits. A pass counts the rows of each group by one
digit, among those that agree with a wanted rank on the digits before; a partition adds its counts up and sends only the digits that occur. The digit that holds
the rank is picked, and after the third pass the value is known to the last bit. So the data are read three times, whatever they
are, no row is shuffled, and no group ever sits in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokengauge.session import local_table

#: Bits of the digits, the highest first.
DIGITS = (18, 23, 23)
#: Counts that a task holds before they are added up, and of what it has added up, half as many; counts sent at a time.
HELD, SENT = 1 << 20, 1 << 16
_TOP = np.uint64(1 << 63)


def sortable(values: np.ndarray) -> np.ndarray:
    """64-bit numbers in the order of the doubles; both zeros are one, NaN comes last."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >= _TOP, ~bits, bits | _TOP)


def unsorted(bits: np.ndarray) -> np.ndarray:
    return np.where(bits >= _TOP, bits ^ _TOP, ~bits).view(np.float64)


def _summed(key: np.ndarray, n: np.ndarray | None, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, with their rows (one each without ``n``) and sums."""
    found, inverse = np.unique(key, return_inverse=True)
    return found, np.bincount(inverse, n, len(found)).astype(np.int64), np.bincount(inverse, s, len(found))


class _Counter:
    """Rows and sums of a task by group, value column, wanted prefix and digit; what it holds is bounded, whatever the task reads."""

    def __init__(self, names: list[str], bits: int, shift: int, wanted: dict[tuple[str, str], list[int]] | None):
        self.names, self.wanted = names, wanted
        self.bits, self.shift, self.before = np.uint64(bits), np.uint64(shift), np.uint64(shift + bits)
        self.slots = 1 if wanted is None else max(map(len, wanted.values()), default=1)
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}  # of the groups met
        self.marks: list[pa.RecordBatch] = []  # a row of each, for its keys
        self.prefixes = np.zeros((len(self.names), 0, self.slots), np.uint64)
        self.known = np.zeros(self.prefixes.shape, bool)
        self.held: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in self.names]
        self.size, self.full = 0, False

    def _groups(self, batch: pa.RecordBatch, kept: list[str]) -> np.ndarray:
        marks = batch.column("__group").dictionary_encode()
        codes, names = marks.indices.to_numpy(), marks.dictionary.to_pylist()
        fresh = [i for i, m in enumerate(names) if m not in self.numbers]
        if fresh:
            for i in fresh:
                self.numbers[names[i]] = len(self.numbers)
            first = np.zeros(len(names), int)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            self.marks.append(batch.select(kept).take(pa.array(first[fresh])))
            prefixes = np.zeros((len(self.names), len(fresh), self.slots), np.uint64)
            known = np.zeros(prefixes.shape, bool)
            for of, name in enumerate(self.names):
                for at, i in enumerate(fresh):
                    mine = [0] if self.wanted is None else self.wanted.get((names[i], name), [])
                    prefixes[of, at, : len(mine)], known[of, at, : len(mine)] = mine, True
            self.prefixes, self.known = np.concatenate([self.prefixes, prefixes], axis=1), np.concatenate([self.known, known], axis=1)
        return np.array([self.numbers[m] for m in names], int)[codes]

    def add(self, batch: pa.RecordBatch, kept: list[str]) -> None:
        group = self._groups(batch, kept)
        for of, name in enumerate(self.names):
            there = ~batch.column(name).is_null().to_numpy(zero_copy_only=False)
            values = batch.column(name).to_numpy(zero_copy_only=False)
            bits = sortable(values)
            for slot in range(self.slots):
                here = there & self.known[of, group, slot]
                if self.wanted is not None:
                    here &= bits >> self.before == self.prefixes[of, group, slot]
                at = np.flatnonzero(here)
                if len(at):
                    key = (group[at] * self.slots + slot).astype(np.uint64) << self.bits | bits[at] >> self.shift & (np.uint64(1) << self.bits) - np.uint64(1)
                    self.held[of].append(_summed(key, None, values[at]))
                    self.size += len(self.held[of][-1][0])
        if self.size > HELD:
            for of, parts in enumerate(self.held):
                if parts:
                    self.held[of] = [_summed(*(np.concatenate(c) for c in zip(*parts, strict=True)))]
            self.size = sum(len(parts[0][0]) for parts in self.held if parts)
            self.full = 2 * self.size > HELD

    def results(self) -> Iterator[pa.RecordBatch]:
        """All that is held, which is forgotten then."""
        marks = pa.Table.from_batches(self.marks).combine_chunks() if self.marks else None
        for of, parts in enumerate(self.held):
            if not parts:
                continue
            key, n, s = _summed(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            group, slot = np.divmod((key >> self.bits).astype(np.int64), self.slots)
            digit = (key & (np.uint64(1) << self.bits) - np.uint64(1)).astype(np.int64)
            prefix = self.prefixes[of, group, slot].astype(np.int64)
            for start in range(0, len(key), SENT):
                part = slice(start, start + SENT)
                own = marks.take(pa.array(group[part])).combine_chunks().to_batches()[0]
                many = len(digit[part])
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array(np.full(many, of, np.int32)), *(pa.array(c[part]) for c in (prefix, digit, n, s))],
                    names=[*own.schema.names, "of", "prefix", "digit", "n", "s"],
                )
        self.clear()


def _counts(data: DataFrame, keys: list[str], names: list[str], step: int, wanted: dict[tuple[str, str], list[int]] | None) -> DataFrame:
    """``keys, group, of, prefix, digit, n, s``: rows and sum of the values by digit, where the digits before are wanted ones (``group, of``)."""

    bits, shift = DIGITS[step], sum(DIGITS[step + 1 :])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(names, bits, shift, wanted)
        for batch in batches:
            if batch.num_rows:
                counter.add(batch, [*keys, "__group"])
                if counter.full or len(counter.numbers) > HELD:
                    yield from counter.results()
        yield from counter.results()

    fields = [*data.select(*keys, "__group").schema.fields]
    fields += [T.StructField(c, t) for c, t in (("of", T.IntegerType()), ("prefix", T.LongType()), ("digit", T.LongType()), ("n", T.LongType()), ("s", T.DoubleType()))]
    sent = data.mapInArrow(run, T.StructType(fields))
    return sent.groupBy(*keys, "__group", "of", "prefix", "digit").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def _mark(keys: Mapping[str, T.DataType]) -> Column:
    """A text that tells groups apart."""
    plain = (T.StringType, T.BooleanType, T.IntegerType, T.LongType)
    if all(isinstance(t, plain) for t in keys.values()):
        text = [F.col(k).cast("string") for k in keys]
        return F.concat(F.lit(""), *[F.coalesce(F.concat(F.length(c), F.lit(":"), c), F.lit("-")) for c in text])
    return F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]), {"ignoreNullFields": "false"})


def exact_quantiles_of(
    df: DataFrame, keys: Sequence[str], values: Mapping[str, Column], probs: Mapping[str, float], deviation: str | None = None
) -> DataFrame:
    """One row per group: ``keys``, and ``<value>_<prob>`` for each of ``values`` (name -> column) and ``probs`` (name -> probability).

    Linear interpolation between neighbouring ranks; nulls are left out, a group with nulls only has no quantile. With ``deviation`` (a name of
    ``probs``) also ``<value>_dev``, the mean distance of the values from that quantile. Groups are those of a report or a model grid: a few
    numbers of each pass through the driver.
    """
    keys, names = list(keys), list(values)
    spark = df.sparkSession
    mark = _mark({k: df.schema[k].dataType for k in keys})
    data = df.select(*keys, mark.alias("__group"), *[c.cast("double").alias(f"__v_{n}") for n, c in values.items()])
    columns = [f"__v_{n}" for n in names]
    order = Window.partitionBy("__group", "of", "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("__group", "of")

    def ranked(counts: DataFrame) -> DataFrame:
        return counts.withColumns({"upto": F.sum("n").over(order), "sum_upto": F.sum("s").over(order)})

    wanted_ranks = ", ".join(f"named_struct('prob', {i}, 'side', {j}, 'rank', cast({end}({q}D * (total - 1)) as long))" for i, q in enumerate(probs.values()) for j, end in enumerate(("floor", "ceil")))
    first = ranked(_counts(data, keys, columns, 0, None)).withColumns({"total": F.sum("n").over(whole), "sum_total": F.sum("s").over(whole)})
    found = first.selectExpr("*", f"explode(array({wanted_ranks})) as w").where("w.rank >= upto - n and w.rank < upto")
    rows = found.select(*keys, "__group", "of", "w.*", F.lit(0).alias("prefix"), "digit", (F.col("upto") - F.col("n")).alias("below"), (F.col("sum_upto") - F.col("s")).alias("sum_below"), "total", "sum_total").collect()
    state = {(r["__group"], r["of"], r["prob"], r["side"]): [r["digit"], r["rank"], r["below"], r["sum_below"]] for r in rows}
    about = {(r["__group"], r["of"]): (r["total"], r["sum_total"]) for r in rows}
    named = {r["__group"]: tuple(r[k] for k in keys) for r in rows}
    for step in range(1, len(DIGITS)):
        wanted: dict[tuple[str, str], list[int]] = {}
        for (group, of, _, _), (prefix, *_) in state.items():
            mine = wanted.setdefault((group, columns[of]), [])
            if prefix not in mine:
                mine.append(prefix)
        asked = [(g, of, prob, side, s[0], s[1], s[2]) for (g, of, prob, side), s in state.items()]
        ranks = local_table(spark, asked, "__group string, of int, prob int, side int, prefix long, rank long, below long")
        hit = ranked(_counts(data, keys, columns, step, wanted)).join(ranks, ["__group", "of", "prefix"])
        hit = hit.where("rank >= below + upto - n and rank < below + upto")
        for r in hit.select("__group", "of", "prob", "side", "digit", (F.col("upto") - F.col("n")).alias("more"), (F.col("sum_upto") - F.col("s")).alias("sum_more")).collect():
            s = state[r["__group"], r["of"], r["prob"], r["side"]]
            s[0], s[2], s[3] = s[0] << DIGITS[step] | r["digit"], s[2] + r["more"], s[3] + r["sum_more"]

    out = []
    for group, key in named.items():
        cells: list[float | None] = []
        for of in range(len(names)):
            if (group, of) not in about:
                cells += [None] * (len(probs) + (deviation is not None))
                continue
            total, sum_total = about[group, of]
            chosen: dict[str, float] = {}
            for i, (prob, q) in enumerate(probs.items()):
                a, b = (float(unsorted(np.array([state[group, of, i, j][0]], np.uint64))[0]) for j in (0, 1))
                at = q * (total - 1)
                chosen[prob] = a + (b - a) * (at - math.floor(at)) if a != b else a
            cells += chosen.values()
            if deviation is not None:  # rows below the upper of the two ranks lie at or below the quantile
                middle, (_, _, below, low) = chosen[deviation], state[group, of, list(probs).index(deviation), 1]
                cells.append(((sum_total - low) - middle * (total - below) + middle * below - low) / total)
        out.append((*key, *cells))
    fields = [*df.select(*keys).schema.fields]
    for name in names:
        fields += [T.StructField(f"{name}_{p}", T.DoubleType()) for p in probs] + ([T.StructField(f"{name}_dev", T.DoubleType())] if deviation is not None else [])
    return local_table(spark, out, T.StructType(fields))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """One row per group with a column per entry of ``probs`` (name -> probability). ``df`` is read three times."""
    found = exact_quantiles_of(df, keys, {"q": F.col(value)}, probs)
    return found.select(*keys, *[F.col(f"q_{p}").alias(p) for p in probs]).where(F.col(next(iter(probs))).isNotNull())
