"""Forests of exact regression trees over a narrow numeric table: growth, nested grid search, refit, storage and prediction.

A forest is grown once, with the most trees and the greatest depth of its grid; fewer trees are its first ones and smaller depths its upper
levels, so a grid of sizes and depths costs one growth per smallest leaf. Held-out rows are scored where a tree is grown, so no
tree of a search is stored.

A node with at most ``BLOCK`` rows is grown to its end in one task (:mod:`tokengauge.plans.tree_kernel`). If the whole table is no larger, it
is broadcast, and tasks share the trees out. Beyond that, the nodes above this size are split by passes over the stored rows:
partitions send arrays of ranges and sums per open node, which are added in rounds, and a row finds its nodes by walking the short tops of the trees. Cuts
of random forests are then found exactly by bounds: a node's range is cut into bins, and only bins whose best possible gain reaches the best one
found are cut again. Rows go once to the task of their node at the end of the tops. Both ways give the same trees.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokengauge.functions.text import SELECTED_FEATURES
from tokengauge.operators import metrics, selection
from tokengauge.operators.partials import as_numpy, sum_over
from tokengauge.operators.rows import SCOPES
from tokengauge.plans import tree_kernel as kernel
from tokengauge.plans.tree_kernel import BEST, RANDOM, UNLIMITED, Nodes
from tokengauge.session import local_table, materialize

SEED = 42
#: Rows of a node that one task holds: about 100 bytes each.
BLOCK = 1 << 16
#: Items (rows times trees) that the kernel grows together.
ITEMS = 1 << 14
#: Trees whose rows are on the way to their tasks at a time; open nodes, and windows of cuts, of one pass.
SWEEP, SLOTS, WINDOWS, BINS = 256, 2048, 512, 64
#: Trees of one task; nodes of the stored trees that one scoring pass takes along.
TASK_TREES, MODEL_NODES = 50, 1 << 21


@dataclass(frozen=True)
class TreeConfig:
    """Trees, depth (``None``: unlimited) and smallest leaf."""

    n_estimators: int
    max_depth: int | None
    min_samples_leaf: int

    @property
    def name(self) -> str:
        return f"n={self.n_estimators},depth={self.max_depth},leaf={self.min_samples_leaf}"

    @property
    def depth(self) -> int:
        return UNLIMITED if self.max_depth is None else self.max_depth


def tree_grid(
    n_estimators: Iterable[int] = (50, 100),
    max_depth: Iterable[int | None] = (10, 20, None),
    min_samples_leaf: Iterable[int] = (5, 10),
) -> list[TreeConfig]:
    """The full grid by default (fixed values), in the order ties are decided."""
    return [TreeConfig(n, d, l) for d, l, n in itertools.product(max_depth, min_samples_leaf, n_estimators)]


@dataclass(frozen=True)
class Forest:
    """What is grown together: a cell (fold -1: all rows train) and a smallest leaf, with the most trees and the greatest depth wanted."""

    tokenizer: str
    scope: str
    fold: int
    leaf: int
    trees: int
    depth: int

    def path(self, rule: str, seed: int, tree: int) -> int:
        return kernel.root_path(seed, rule, self.tokenizer, self.scope, self.fold, self.leaf, tree)


NO_FOLD = -1


class Rows:
    """Columns of some rows of the table as arrays."""

    def __init__(self, columns: dict[str, np.ndarray], features: Sequence[str]):
        self.x = np.column_stack([columns[f] for f in features])
        self.columns = columns
        self.hash = columns["__hash"].astype(np.uint64)  # 52 bits, exact as doubles
        self.english = columns["is_english"].astype(bool)

    def inside(self, forest: Forest) -> np.ndarray:
        known = ~np.isnan(self.columns[forest.tokenizer])
        return known if forest.scope == "all" else known & self.english

    def of(self, tokenizer: str, scope: str) -> np.ndarray:
        return np.flatnonzero(self.inside(Forest(tokenizer, scope, NO_FOLD, 0, 0, 0)))

    def training(self, forest: Forest) -> np.ndarray:
        return self.inside(forest) & (self.columns["fold"] != forest.fold)

    def held(self, forest: Forest) -> np.ndarray:
        return self.inside(forest) & (self.columns["fold"] == forest.fold)


def narrow_rows(table: DataFrame, targets: Sequence[str], features: Sequence[str], key: str) -> DataFrame:
    as_double = [F.col(c).cast("double").alias(c) for c in dict.fromkeys([*targets, *features])]
    return table.select(F.col(key).cast("long").alias("__key"), F.xxhash64(key).bitwiseAND(F.lit(2**52 - 1)).alias("__hash"), "is_english", F.col("fold").cast("int").alias("fold"), *as_double)


def as_columns(batch: pa.RecordBatch | pa.Table) -> dict[str, np.ndarray]:
    out = {}
    for name in batch.column_names:
        column = batch.column(name)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        exact = name in ("__key", "__hash") and not column.null_count
        out[name] = column.to_numpy(zero_copy_only=False) if exact else as_numpy(column)
    return out


def weights(rows: Rows, chosen: np.ndarray, path: int, rule: str) -> np.ndarray:
    return kernel.bootstrap(rows.hash[chosen], path) if rule == BEST else np.ones(len(chosen))


def _grown(rows: Rows, forest: Forest, numbers: Sequence[int], rule: str, seed: int) -> Nodes:
    """Trees of a forest over rows that are all here; root i is tree ``numbers[i]``."""
    train = np.flatnonzero(rows.training(forest))
    y = rows.columns[forest.tokenizer]
    paths = [forest.path(rule, seed, t) for t in numbers]
    items, w, node = [], [], []
    for i, path in enumerate(paths):
        drawn = weights(rows, train, path, rule)
        if not drawn.any():
            drawn = np.ones(len(train))  # a handful of rows, none of them drawn
        items.append(train[drawn > 0])
        w.append(drawn[drawn > 0])
        node.append(np.full(len(items[-1]), i))
    at, n = np.concatenate(items), len(paths)
    return kernel.grow(rows.x[at], y[at], np.concatenate(w), np.concatenate(node), np.array(paths, np.uint64), np.zeros(n, int), np.full(n, forest.leaf), np.full(n, forest.depth), rule)


def _together(rows: Rows, forest: Forest, numbers: Sequence[int]) -> Iterator[Sequence[int]]:
    step = max(1, ITEMS // max(1, int(rows.training(forest).sum())))
    for i in range(0, len(numbers), step):
        yield numbers[i : i + step]


_SCORE = "forest int, first int, key long, y double, sums array<double>"


def _scores(forest: int, first: int, keys: np.ndarray, y: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * sums.shape[1])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(keys), forest, np.int32)), pa.array(np.full(len(keys), first, np.int32)), pa.array(keys.astype(np.int64)),
            pa.array(y), pa.ListArray.from_arrays(offsets, pa.array(sums.ravel())),
        ],
        names=["forest", "first", "key", "y", "sums"],
    )


def _units(forests: Sequence[Forest], sizes: Sequence[int]) -> list[tuple[int, int, int]]:
    """(forest, first tree, last tree + 1) of each task; no task lies across one of the ``sizes``."""
    units = []
    for i, forest in enumerate(forests):
        ends = sorted({*(s for s in sizes if s < forest.trees), forest.trees})
        for low, high in zip([0, *ends[:-1]], ends, strict=True):
            units += [(i, a, min(a + TASK_TREES, high)) for a in range(low, high, TASK_TREES)]
    return units


def _block_rows(narrow: DataFrame, features: Sequence[str]):
    """The whole table, at most ``BLOCK`` rows as its callers have counted, on every executor."""
    return narrow.sparkSession.sparkContext.broadcast((as_columns(narrow.toArrow()), list(features)))


def _scored_in_block(narrow: DataFrame, features, forests, units, depths, rule, seed) -> DataFrame:
    shared = _block_rows(narrow, features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(*shared.value)
        for unit in itertools.chain.from_iterable(b.column(0).to_pylist() for b in batches):
            number, first, last = units[unit]
            forest = forests[number]
            held = np.flatnonzero(rows.held(forest))
            if not len(held) or not rows.training(forest).any():
                continue
            sums = np.zeros((len(held), len(depths)))
            for numbers in _together(rows, forest, range(first, last)):
                nodes = _grown(rows, forest, numbers, rule, seed)
                start = np.repeat(np.arange(len(numbers)), len(held))
                for j, at in enumerate(kernel.walk(nodes, np.tile(rows.x[held], (len(numbers), 1)), start, depths)):
                    sums[:, j] += nodes.value[at].reshape(len(numbers), -1).sum(axis=0)
            yield _scores(number, first, rows.columns["__key"][held], rows.columns[forest.tokenizer][held], sums)

    ids = narrow.sparkSession.range(0, len(units), 1, len(units))
    return materialize(ids.mapInArrow(run, _SCORE), "tree-scores")


# --- tables of more than a block of rows ----------------------------------------------


@dataclass
class Top:
    """The upper part of one tree; ``goes`` names the piece that goes on below a node."""

    forest: int
    tree: int
    feature: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0.0])
    left: list = field(default_factory=lambda: [-1])
    value: list = field(default_factory=lambda: [float("nan")])
    n: list = field(default_factory=lambda: [0])
    level: list = field(default_factory=lambda: [0])
    path: list = field(default_factory=list)
    goes: list = field(default_factory=lambda: [-1])

    def nodes(self) -> Nodes:
        a = np.array
        return Nodes(a(self.feature), a(self.cut), a(self.left), a(self.value), a(self.n), a(self.level), np.zeros(len(self.n), int))

    def split(self, node: int, feature: int, cut: float) -> list[int]:
        self.feature[node], self.cut[node], self.left[node] = int(feature), float(cut), len(self.n)
        paths = kernel.child_paths(np.array([self.path[node]], np.uint64)).tolist()
        for path in paths:
            for into, value in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.value, float("nan")), (self.n, 0), (self.level, self.level[node] + 1), (self.path, path), (self.goes, -1)):
                into.append(value)
        return [self.left[node], self.left[node] + 1]


class _Passes:
    """Sums over the training rows of open nodes; each pass reads the stored rows once."""

    def __init__(self, narrow: DataFrame, features, forests, tops: list[Top], rule: str, seed: int):
        self.narrow, self.features, self.forests, self.tops, self.rule, self.seed = narrow, list(features), forests, tops, rule, seed
        self.columns = list(dict.fromkeys(["__hash", "is_english", "fold", *{f.tokenizer: 0 for f in forests}, *self.features]))

    def over(self, open_nodes: list[tuple[int, int]], shape: tuple[int, ...], peaks: int, add) -> tuple[np.ndarray, np.ndarray]:
        """``add(slots, x, y, w, sums, peaks)`` for the items of the open nodes (tree, node), whose places in the list are the slots."""
        slots: dict[int, dict[int, int]] = {}
        for slot, (tree, node) in enumerate(open_nodes):
            slots.setdefault(tree, {})[node] = slot
        model = {}
        for tree, own in slots.items():
            of = np.full(len(self.tops[tree].n), -1)
            of[list(own)] = list(own.values())
            model[tree] = (self.forests[self.tops[tree].forest], self.tops[tree].nodes(), of, self.tops[tree].path[0])
        features, rule = self.features, self.rule

        def update(batch: dict, sums: np.ndarray, top: np.ndarray) -> None:
            rows = Rows(batch, features)
            for forest, nodes, of, path in model.values():
                train = np.flatnonzero(rows.training(forest))
                w = weights(rows, train, path, rule)
                train, w = train[w > 0], w[w > 0]
                slot = of[kernel.walk(nodes, rows.x[train], np.zeros(len(train), int), [UNLIMITED])[0]]
                at = np.flatnonzero(slot >= 0)
                if len(at):
                    add(slot[at], rows.x[train[at]], rows.columns[forest.tokenizer][train[at]], w[at], sums, top)

        return sum_over(self.narrow, self.columns, update, shape, peaks, floor=-np.inf)

    def stats(self, open_nodes: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items, weight, sum and square sum per node; smallest and largest value per node and feature."""
        many, width = len(open_nodes), len(self.features)

        def add(slot, x, y, w, sums, top):
            for j, v in enumerate((np.ones(len(y)), w, w * y, w * y * y)):
                sums[:, j] += np.bincount(slot, v, many)
            both, order = top.reshape(2, many, width), np.argsort(slot, kind="stable")
            by_slot = slot.take(order)
            starts = np.flatnonzero(np.concatenate([[True], by_slot[1:] != by_slot[:-1]]))
            here = by_slot.take(starts)
            for f in range(width):
                v = x[:, f].take(order)
                both[0, here, f] = np.maximum(both[0, here, f], -np.minimum.reduceat(v, starts))
                both[1, here, f] = np.maximum(both[1, here, f], np.maximum.reduceat(v, starts))

        sums, top = self.over(open_nodes, (many, 4), 2 * many * width, add)
        both = top.reshape(2, many, width)
        return sums, -both[0], both[1]

    def random_cuts(self, nodes: list[tuple[int, int]], stats: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, float]]:
        many, width = low.shape
        paths = np.array([self.tops[t].path[n] for t, n in nodes], np.uint64)
        cut = low + (high - low) * kernel.draws(paths, width)

        def add(slot, x, y, w, sums, top):
            goes_left = x <= cut[slot]
            for f in range(width):
                at = goes_left[:, f]
                for j, v in enumerate((np.ones(len(y)), w, w * y)):
                    sums[:, f, j] += np.bincount(slot[at], v[at], many)

        sums, _ = self.over(nodes, (many, width, 3), 1, add)
        leaf = np.array([self.forests[self.tops[t].forest].leaf for t, _ in nodes])[:, None]
        count = sums[:, :, 0]
        ok = (low < high) & (count >= leaf) & (stats[:, :1] - count >= leaf)
        gain = np.where(ok, kernel.score(sums[:, :, 2], sums[:, :, 1], stats[:, 2:3], stats[:, 1:2]), -np.inf)
        feature = np.argmax(gain, axis=1)
        return [(int(f), float(cut[i, f])) if gain[i, f] > -np.inf else (-1, 0.0) for i, f in enumerate(feature)]

    def best_cuts(self, nodes: list[tuple[int, int]], stats: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, float]]:
        """The best cut of each node, found by bins whose bound reaches the best gain so far."""
        best: list[tuple[float, int, float]] = [(-np.inf, -1, 0.0)] * len(nodes)
        # slot, feature, from, to, and what lies below: items, weight, sum
        todo = [(s, f, low[s, f], high[s, f], 0.0, 0.0, 0.0) for s in range(len(nodes)) for f in range(low.shape[1]) if low[s, f] < high[s, f]]
        while todo:
            now, todo = todo[:WINDOWS], todo[WINDOWS:]
            by_slot: dict[int, list[int]] = {}
            for i, window in enumerate(now):
                by_slot.setdefault(window[0], []).append(i)
            many = len(now)

            def add(slot, x, y, w, sums, top, now=now, by_slot=by_slot, many=many):
                peaks = top.reshape(many, BINS, 4)
                for s in np.unique(slot).tolist():
                    own = slot == s
                    for i in by_slot[s]:
                        _, f, a, b, *_ = now[i]
                        v = x[own, f]
                        at = (v >= a) & (v <= b)
                        v, ys, ws = v[at], y[own][at], w[own][at]
                        place = np.minimum(((v - a) * (BINS / (b - a))).astype(int), BINS - 1)
                        for j, z in enumerate((np.ones(len(v)), ws, ws * ys)):
                            sums[i, :, j] += np.bincount(place, z, BINS)
                        for j, z in enumerate((-v, v, -ys, ys)):
                            np.maximum.at(peaks[i, :, j], place, z)

            used = sorted(by_slot)
            wrapped = lambda slot, *rest, used=np.array(used): add(used[slot], *rest)
            sums, top = self.over([nodes[s] for s in used], (many, BINS, 3), many * BINS * 4, wrapped)
            peaks = top.reshape(many, BINS, 4)
            bounds = []
            for (s, f, _, _, n0, w0, s0), bins, peak in zip(now, sums, peaks, strict=True):
                count, weight, total, _ = stats[s]
                leaf = self.forests[self.tops[nodes[s][0]].forest].leaf
                full = np.flatnonzero(bins[:, 0])
                for k, i in enumerate(full):
                    n1, w1, s1 = n0 + bins[i, 0], w0 + bins[i, 1], s0 + bins[i, 2]
                    x0, x1, y0, y1 = -peak[i, 0], peak[i, 1], -peak[i, 2], peak[i, 3]
                    if k + 1 < len(full) and n1 >= leaf and count - n1 >= leaf:
                        gain = float(kernel.score(s1, w1, total, weight))
                        cut = float(kernel.midpoint(x1, -peak[full[k + 1], 0]))
                        if (-gain, f, cut) < (-best[s][0], *(best[s][1:] if best[s][1] >= 0 else (UNLIMITED, 0.0))):
                            best[s] = (gain, f, cut)
                    if x0 < x1 and n1 - 1 >= leaf and count - n0 - 1 >= leaf:
                        bounds.append((_bound(w0, s0, bins[i, 1], bins[i, 2], y0, y1, total, weight), (s, f, x0, x1, n0, w0, s0)))
                    n0, w0, s0 = n1, w1, s1
            todo += [window for bound, window in bounds if bound >= best[window[0]][0] * (1 - 1e-12)]
            todo = [w for w in todo if w[2] < w[3]]
        return [(f, c) for _, f, c in best]


def _bound(w0, s0, w, s, y0, y1, total, weight) -> float:
    """The gain that no cut inside a bin exceeds: gain is convex in (weight, sum) on the left, so its greatest value over all that the bin allows is at a corner."""
    corners = [(0.0, 0.0), (w, s)]
    if y1 > y0:
        a, b = (w * y1 - s) / (y1 - y0), (s - w * y0) / (y1 - y0)
        corners += [(a, a * y0), (b, b * y1)]
    top = -np.inf
    for u, v in corners:
        lw, ls = w0 + u, s0 + v
        left = ls * ls / lw if lw > 0 else 0.0
        right = (total - ls) ** 2 / (weight - lw) if weight - lw > 0 else 0.0
        top = max(top, left + right)
    return top


def _tops(narrow: DataFrame, features, forests, trees: list[tuple[int, int]], rule: str, seed: int, block: int) -> tuple[list[Top], list[tuple[int, int]]]:
    """The tops of the given trees (forest, number), and the (tree, node) of each piece below them."""
    tops = [Top(f, t, path=[forests[f].path(rule, seed, t)]) for f, t in trees]
    passes = _Passes(narrow, features, forests, tops, rule, seed)
    pieces: list[tuple[int, int]] = []
    todo = [(i, 0) for i in range(len(tops))]
    while todo:
        now, todo = todo[:SLOTS], todo[SLOTS:]
        stats, low, high = passes.stats(now)
        split = []
        for i, (tree, node) in enumerate(now):
            top, (count, weight, total, square) = tops[tree], stats[i]
            forest = forests[top.forest]
            top.n[node], top.value[node] = int(count), total / weight if weight else float("nan")
            if 0 < count <= block:
                top.goes[node] = len(pieces)
                pieces.append((tree, node))
            elif count >= 2 * forest.leaf and weight * square > total * total and top.level[node] < forest.depth:
                split.append(i)
        if split:
            choose = passes.best_cuts if rule == BEST else passes.random_cuts
            for i, (feature, cut) in zip(split, choose([now[i] for i in split], stats[split], low[split], high[split]), strict=True):
                if feature >= 0:
                    tree, node = now[i]
                    todo += [(tree, n) for n in tops[tree].split(node, feature, cut)]
    return tops, pieces


_SENT = "piece long, held boolean, forest int, first int, key long, y double, w double, x array<double>, sums array<double>"


def _sent(narrow: DataFrame, features, forests, tops, pieces, depths, sizes, rule) -> DataFrame:
    """Items on their way to the pieces, and held-out rows with what the tops say of them; those that end in a top have piece -1."""
    units = {(f, t): a for f, a, b in _units(forests, sizes) for t in range(a, b)}
    shared = narrow.sparkSession.sparkContext.broadcast([(t.forest, units[t.forest, t.tree], t.nodes(), np.array(t.goes), t.path[0]) for t in tops])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = Rows(as_columns(batch), features)
            for number, first, nodes, goes, path in shared.value:
                forest = forests[number]
                y = rows.columns[forest.tokenizer]
                for held in (False, True):
                    at = np.flatnonzero(rows.held(forest) if held else rows.training(forest))
                    w = np.zeros(len(at)) if held else weights(rows, at, path, rule)
                    at, w = (at, w) if held else (at[w > 0], w[w > 0])
                    if not len(at):
                        continue
                    ends = kernel.walk(nodes, rows.x[at], np.zeros(len(at), int), [*depths, UNLIMITED])
                    piece = goes[ends[-1]]
                    # what a top says holds where it stops above the piece or there is none
                    sums = np.stack([np.where((piece >= 0) & (nodes.level[e] < d) & (goes[e] >= 0), np.nan, nodes.value[e]) for d, e in zip(depths, ends, strict=False)], axis=1)
                    if not held:
                        at, w, piece, sums = at[piece >= 0], w[piece >= 0], piece[piece >= 0], sums[piece >= 0]
                    many = len(at)
                    lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(many + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))  # noqa: B023, E731
                    full = lambda v: pa.array(np.full(many, v, np.int32))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(piece.astype(np.int64)), pa.array(np.full(many, held)), full(number), full(first), pa.array(rows.columns["__key"][at].astype(np.int64)), pa.array(y[at]), pa.array(w), lists(rows.x[at]), lists(sums)],
                        names=["piece", "held", "forest", "first", "key", "y", "w", "x", "sums"],
                    )

    return narrow.mapInArrow(run, _SENT)


_PIECE = "piece long, feature array<int>, cut array<double>, left array<int>, value array<double>, n array<long>, level array<int>"


def _finished(sent: DataFrame, forests, tops, pieces, depths, rule, keep: bool) -> DataFrame:
    """Grow the pieces, each in one task. ``keep``: the nodes of each piece; else the scores of its held-out rows."""
    roots = [(forests[tops[t].forest], tops[t].path[n], tops[t].level[n]) for t, n in pieces]
    shared = sent.sparkSession.sparkContext.broadcast(roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        current, nodes = None, None

        def grown() -> Nodes:
            whole = pa.Table.from_batches(waiting)
            x = _matrix(whole.column("x").combine_chunks())
            forest, path, level = shared.value[current]
            one = np.array
            return kernel.grow(x, whole.column("y").to_numpy(), whole.column("w").to_numpy(), np.zeros(len(x), int), one([path], np.uint64), one([level]), one([forest.leaf]), one([forest.depth]), rule)

        for batch in batches:
            piece, held = batch.column("piece").to_numpy(), batch.column("held").to_numpy(zero_copy_only=False)
            change = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (held[1:] != held[:-1])])) if len(piece) else np.zeros(0, int)
            for a, b in zip(change.tolist(), [*change[1:].tolist(), len(piece)], strict=True):
                part = batch.slice(a, b - a)
                if piece[a] != current:
                    if keep and waiting:
                        yield _piece_row(current, grown())
                    current, nodes, waiting[:] = int(piece[a]), None, []
                if not held[a]:
                    waiting.append(part)
                    continue
                if keep:
                    continue
                if nodes is None:
                    nodes = grown()
                sums = _matrix(part.column("sums"))
                for j, at in enumerate(kernel.walk(nodes, _matrix(part.column("x")), np.zeros(part.num_rows, int), depths)):
                    sums[:, j] = np.where(np.isnan(sums[:, j]), nodes.value[at], sums[:, j])
                yield _scores(part.column("forest")[0].as_py(), part.column("first")[0].as_py(), part.column("key").to_numpy(), part.column("y").to_numpy(), sums)
        if keep and waiting:
            yield _piece_row(current, grown())

    dealt = sent.where("piece >= 0").repartition("piece").sortWithinPartitions("piece", "held")
    return dealt.mapInArrow(run, _PIECE if keep else _SCORE)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).copy()


def _piece_row(piece: int, nodes: Nodes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([piece]), *_node_lists(nodes)], names=[c.split()[0] for c in _PIECE.split(", ")])


def _node_lists(nodes: Nodes) -> list[pa.Array]:
    kinds = (("feature", pa.int32()), ("cut", pa.float64()), ("left", pa.int32()), ("value", pa.float64()), ("n", pa.int64()), ("level", pa.int32()))
    return [pa.array([getattr(nodes, f)], pa.list_(k)) for f, k in kinds]


def _scored_by_passes(narrow, features, forests, units, depths, sizes, rule, seed, block) -> DataFrame:
    narrow = materialize(narrow, "tree-rows")
    trees = [(f, t) for f, a, b in units for t in range(a, b)]
    found: DataFrame | None = None
    for i in range(0, len(trees), SWEEP):
        tops, pieces = _tops(narrow, features, forests, trees[i : i + SWEEP], rule, seed, block)
        sent = materialize(_sent(narrow, features, forests, tops, pieces, depths, sizes, rule), "tree-items")  # read twice
        ended = sent.where("held and piece < 0").select("forest", "first", "key", "y", "sums")
        scores = materialize(ended.union(_finished(sent, forests, tops, pieces, depths, rule, False)), "tree-scores")
        found = scores if found is None else found.union(scores)
    return found


# --- what the estimators call -----------------------------------------------------------


def cross_validate(
    table: DataFrame,
    targets: Sequence[str],
    grid: Sequence[TreeConfig],
    rule: str,
    features: Sequence[str] = tuple(SELECTED_FEATURES),
    scopes: Sequence[str] = tuple(SCOPES),
    folds: Sequence[int] | None = None,
    seed: int = SEED,
    block: int = BLOCK,
    key: str = "doc_id",
) -> DataFrame:
    """Held-out predictions ``config_id, config, tokenizer, scope, fold, key, y, yhat`` of every configuration.

    ``table`` has the key, is_english, fold, the targets (null: the row takes no part) and the features, none of them null. A cell
    without training rows has no prediction. Results do not depend on ``block`` or the partitioning.
    """
    spark, features = table.sparkSession, list(features)
    if folds is None:
        folds = sorted(r["fold"] for r in table.select("fold").distinct().collect())
    sizes = sorted({c.n_estimators for c in grid})
    depths = sorted({c.depth for c in grid})
    leaves = sorted({c.min_samples_leaf for c in grid})
    forests = [Forest(t, s, f, l, sizes[-1], depths[-1]) for f, t, s, l in itertools.product(folds, targets, scopes, leaves)]
    units = _units(forests, sizes)
    narrow = narrow_rows(table, targets, features, key)
    if table.count() <= block:
        scores = _scored_in_block(narrow, features, forests, units, depths, rule, seed)
    else:
        scores = _scored_by_passes(narrow, features, forests, units, depths, sizes, rule, seed, block)
    parts = [
        (i, first, number, c.name, f.tokenizer, f.scope, f.fold, depths.index(c.depth) + 1, c.n_estimators)
        for i, first, last in units for f in [forests[i]] for number, c in enumerate(grid) if c.min_samples_leaf == f.leaf and last <= c.n_estimators
    ]
    use = local_table(spark, parts, "forest int, first int, config_id int, config string, tokenizer string, scope string, fold int, at int, trees int")
    cell = ["config_id", "config", "tokenizer", "scope", "fold"]
    used = scores.join(use, ["forest", "first"])
    sums = used.groupBy(*cell, F.col("key").alias(key)).agg(F.first("y").alias("y"), (F.sum(F.expr("element_at(sums, at)")) / F.first("trees")).alias("yhat"))
    return sums.select(*cell, key, "y", "yhat")


MODEL = (
    "tokenizer string, scope string, fold int, config string, trees int, tree int, piece long, "
    "feature array<int>, cut array<double>, left array<int>, value array<double>, n array<long>, level array<int>, goes array<long>"
)


def fit(
    table: DataFrame,
    chosen: Sequence[tuple[str, str, TreeConfig]],
    rule: str,
    features: Sequence[str] = tuple(SELECTED_FEATURES),
    fold: int = NO_FOLD,
    seed: int = SEED,
    block: int = BLOCK,
    key: str = "doc_id",
) -> DataFrame:
    """Stored trees (``MODEL``), a row per tree (piece -1) and per piece below it, of each chosen (tokenizer, scope, configuration).

    They are those of a search over the same rows. With ``fold`` its rows do not train.
    """
    spark, features = table.sparkSession, list(features)
    forests = [Forest(t, s, fold, c.min_samples_leaf, c.n_estimators, c.depth) for t, s, c in chosen]
    names = [c.name for _, _, c in chosen]
    narrow = narrow_rows(table, list(dict.fromkeys(t for t, _, _ in chosen)), features, key)
    columns = [c.split()[0] for c in MODEL.split(", ")]

    def row(forest: int, tree: int, nodes: Nodes, goes: np.ndarray) -> pa.RecordBatch:
        f = forests[forest]
        head = [pa.array([f.tokenizer]), pa.array([f.scope]), pa.array([f.fold], pa.int32()), pa.array([names[forest]]), pa.array([f.trees], pa.int32()), pa.array([tree], pa.int32()), pa.array([-1])]
        return pa.RecordBatch.from_arrays([*head, *_node_lists(nodes), pa.array([goes], pa.list_(pa.int64()))], names=columns)

    if table.count() <= block:
        shared = _block_rows(narrow, features)
        units = _units(forests, [])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = Rows(*shared.value)
            for unit in itertools.chain.from_iterable(b.column(0).to_pylist() for b in batches):
                number, first, last = units[unit]
                if not rows.training(forests[number]).any():
                    continue
                for tree in range(first, last):
                    nodes = _grown(rows, forests[number], [tree], rule, seed)
                    yield row(number, tree, nodes, np.full(len(nodes.n), -1))

        return materialize(spark.range(0, len(units), 1, len(units)).mapInArrow(run, MODEL), "trees")

    narrow = materialize(narrow, "tree-rows")
    trees = [(i, t) for i, f in enumerate(forests) for t in range(f.trees)]
    found: DataFrame | None = None
    for i in range(0, len(trees), SWEEP):
        tops, pieces = _tops(narrow, features, forests, trees[i : i + SWEEP], rule, seed, block)
        sent = _sent(narrow, features, forests, tops, pieces, [UNLIMITED], [], rule)
        heads = pa.Table.from_batches([row(t.forest, t.tree, t.nodes(), np.array(t.goes)) for t in tops])
        heads = spark.createDataFrame(heads, MODEL)
        of = [(p, *[getattr(forests[tops[t].forest], c) for c in ("tokenizer", "scope", "fold")], names[tops[t].forest], forests[tops[t].forest].trees, tops[t].tree) for p, (t, _) in enumerate(pieces)]
        of = local_table(spark, of, "piece long, tokenizer string, scope string, fold int, config string, trees int, tree int")
        below = _finished(sent, forests, tops, pieces, [UNLIMITED], rule, True).join(of, "piece").withColumn("goes", F.lit(None).cast("array<long>"))
        both = materialize(heads.union(below.select(*columns)), "trees")
        found = both if found is None else found.union(both)
    return found


def _slices(model: DataFrame) -> Iterator[list]:
    """Stored trees in slices of about ``MODEL_NODES`` nodes; a tree's top is in every slice with one of its pieces."""
    sizes = model.select("tokenizer", "scope", "fold", "config", "tree", "piece", F.size("feature").alias("size")).orderBy("tokenizer", "scope", "fold", "config", "tree", "piece")
    kept, total = [], 0
    for r in sizes.toLocalIterator():
        kept.append(tuple(r)[:6])
        total += r["size"]
        if total >= MODEL_NODES:
            yield kept
            kept, total = [], 0
    if kept:
        yield kept


def _forests(model: DataFrame, chosen: list) -> list[tuple[tuple, list]]:
    """Trees of one slice by forest: (tokenizer, scope, fold, config, trees) and (top, piece of each leaf, pieces, whether its own values count) each."""
    where = "tokenizer string, scope string, fold int, config string, tree int, piece long"
    wanted = {(*c[:5], -1) for c in chosen} | set(chosen)
    own = {c for c in chosen if c[5] == -1}
    slice_rows = F.broadcast(local_table(model.sparkSession, sorted(wanted), where))
    stored = model.join(slice_rows, [c.split()[0] for c in where.split(", ")], "left_semi").collect()
    tops = {tuple(r)[:4] + (r["tree"],): r for r in stored if r["piece"] == -1}
    pieces: dict[tuple, dict[int, Nodes]] = {}
    for r in stored:
        if r["piece"] >= 0:
            pieces.setdefault((*tuple(r)[:4], r["tree"]), {})[r["piece"]] = _read_nodes(r)
    forests: dict[tuple, list] = {}
    for k, r in sorted(tops.items()):
        forests.setdefault((*k[:4], r["trees"]), []).append((_read_nodes(r), np.array(r["goes"]), pieces.get(k, {}), (*k, -1) in own))
    return list(forests.items())


def one_slice(model: DataFrame) -> list[tuple[tuple, list]] | None:
    """The forests of a stored model that is no larger than one slice, else None."""
    slices = _slices(model)
    chosen = next(slices, [])
    return _forests(model, chosen) if next(slices, None) is None else None


def totals(rows: Rows, forests: list[tuple[tuple, list]]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """Cell, places of the rows it scores, and what the trees at hand add to their prediction."""
    for cell, grown in forests:
        tokenizer, scope, fold, _, trees = cell
        forest = Forest(tokenizer, scope, fold, 0, trees, 0)
        at = np.flatnonzero(rows.inside(forest) if fold == NO_FOLD else rows.held(forest))
        if not len(at):
            continue
        x, total = rows.x[at], np.zeros(len(at))
        for nodes, goes, below, whole in grown:
            end = kernel.walk(nodes, x, np.zeros(len(at), int), [UNLIMITED])[0]
            piece = goes[end]
            total += np.where((piece < 0) & whole, nodes.value[end], 0.0)
            for number in np.unique(piece[piece >= 0]).tolist():
                if number in below:
                    here = np.flatnonzero(piece == number)
                    leaf = kernel.walk(below[number], x[here], np.zeros(len(here), int), [UNLIMITED])[0]
                    total[here] += below[number].value[leaf]
        yield cell, at, total / trees


def predict(table: DataFrame, model: DataFrame, features: Sequence[str] = tuple(SELECTED_FEATURES), key: str = "doc_id") -> DataFrame:
    """``tokenizer, scope, fold, config, key, y, yhat`` of the rows in scope of each stored forest (with a fold: of the rows of that fold).

    A slice of the model goes to the tasks that hold the rows; one slice needs no shuffle, several are added up by row.
    """
    spark, features = table.sparkSession, list(features)
    cells = ["tokenizer", "scope", "fold", "config"]
    targets = sorted(r[0] for r in model.select("tokenizer").distinct().collect())
    narrow = narrow_rows(table, targets, features, key)
    parts = []
    for chosen in _slices(model):
        shared = spark.sparkContext.broadcast(_forests(model, chosen))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = Rows(as_columns(batch), features)
                for (tokenizer, scope, fold, config, _), at, yhat in totals(rows, shared.value):
                    many = len(at)
                    named = [pa.array([v] * many, k) for v, k in ((tokenizer, pa.string()), (scope, pa.string()), (fold, pa.int32()), (config, pa.string()))]
                    yield pa.RecordBatch.from_arrays([*named, pa.array(rows.columns["__key"][at].astype(np.int64)), pa.array(rows.columns[tokenizer][at]), pa.array(yhat)], names=[*cells, "key", "y", "yhat"])

        parts.append(narrow.mapInArrow(run, "tokenizer string, scope string, fold int, config string, key long, y double, yhat double"))
    if not parts:
        return spark.createDataFrame([], f"tokenizer string, scope string, fold int, config string, {key} long, y double, yhat double")
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    if len(parts) > 1:
        out = out.groupBy(*cells, "key").agg(F.first("y").alias("y"), F.sum("yhat").alias("yhat"))
    return out.withColumnRenamed("key", key)


def _read_nodes(r) -> Nodes:
    return Nodes(np.array(r["feature"]), np.array(r["cut"]), np.array(r["left"]), np.array(r["value"]), np.array(r["n"]), np.array(r["level"]), np.zeros(len(r["n"]), int))


def summarized(predictions: DataFrame) -> DataFrame:
    """Mean and deviation over the folds of every metric, and the rank by mean R2, of each configuration of a search."""
    keys = ["tokenizer", "scope", "config_id", "config"]
    by_fold = metrics.regression_metrics(materialize(predictions, "predictions"), [*keys, "fold"])
    summary = metrics.summarize(metrics.to_long(by_fold, [*keys, "fold"]), keys)
    wide = summary.groupBy(*keys).pivot("metric", metrics.METRICS).agg(F.first("mean").alias("mean"), F.first("std_pop").alias("std"))
    return selection.rank_configs(wide, ["tokenizer", "scope"], "r2_mean")


def grid_search(
    table: DataFrame, targets: Sequence[str], grid: Sequence[TreeConfig], rule: str, features: Sequence[str] = tuple(SELECTED_FEATURES), **options
) -> tuple[DataFrame, DataFrame]:
    """The ranked configurations of every (tokenizer, scope), and the stored trees of each winner, refitted on all rows of its cell.

    The first in grid order wins a tie. ``options`` go to :func:`cross_validate`; seed, block and key also to :func:`fit`.
    """
    ranked = materialize(summarized(cross_validate(table, targets, grid, rule, features, **options)), "ranking")
    best = selection.best_config(ranked, ["tokenizer", "scope"], score="r2_mean").orderBy("tokenizer", "scope")
    winners = [(r["tokenizer"], r["scope"], grid[r["config_id"]]) for r in best.collect()]  # a row per cell of the grid
    shared = {k: v for k, v in options.items() if k in ("seed", "block", "key")}
    return ranked, fit(table, winners, rule, features, **shared)


def save(model: DataFrame, path: str) -> str:
    model.write.mode("overwrite").parquet(path)
    return path


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL).parquet(path)

