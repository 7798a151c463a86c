"""Growing many regression trees at once over rows in memory, level by level and without a loop over nodes.

``BEST`` tries every cut between two values of every feature (random forests); ``RANDOM`` draws one cut per feature and node (extremely
randomized trees). Both take the split with the largest drop of squared error that leaves a full leaf on either side; of equal ones the
first feature, then the smallest cut. Nodes have running numbers, so depth has no limit. Draws come from a hash of the path, so a tree does not depend on
what else grows beside it, and a forest of fewer or shallower trees is part of the larger one.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np

BEST, RANDOM = "best", "random"
UNLIMITED = 2**31 - 1
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
#: Chance of at most 0, 1, 2, ... copies of a row in a bootstrap sample: the Poisson distribution of mean one.
_AT_MOST = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, elementwise."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers from 0 to below 1."""
    return (x >> np.uint64(11)) * 2.0**-53


def root_path(*identity: object) -> int:
    """The path hash of a root: what its tree is, whatever the grid around it."""
    return int.from_bytes(hashlib.blake2b(repr(identity).encode(), digest_size=8).digest(), "little")


def child_paths(paths: np.ndarray) -> np.ndarray:
    """Path hashes of the left and the right child of each node, one after the other."""
    with np.errstate(over="ignore"):
        both = np.stack([paths * np.uint64(2), paths * np.uint64(2) + np.uint64(1)], axis=1)
        return mix(both.ravel() + np.uint64(_GOLD))


def draws(paths: np.ndarray, features: int) -> np.ndarray:
    """A uniform number per node and feature."""
    salt = mix(np.arange(1, features + 1, dtype=np.uint64) * np.uint64(_GOLD))
    return unit(mix(paths[:, None] ^ salt[None, :]))


def bootstrap(keys: np.ndarray, path: int) -> np.ndarray:
    """How often a row is in the sample of a tree; keys are hashes of the rows."""
    return np.searchsorted(_AT_MOST, unit(mix(keys ^ mix(np.array([path], np.uint64)))), side="right").astype(float)


@dataclass
class Nodes:
    """Flat trees: a node without a feature (-1) is a leaf; children are ``left`` and ``left + 1``."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    n: np.ndarray
    level: np.ndarray
    root: np.ndarray


def score(left_sum, left_weight, total, weight):
    """What a split explains: larger is better."""
    with np.errstate(divide="ignore", invalid="ignore"):
        right_sum = total - left_sum
        return left_sum * left_sum / left_weight + right_sum * right_sum / (weight - left_weight)


def midpoint(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    cut = low + (high - low) / 2
    return np.where(cut < high, cut, low)


def _varying(x: np.ndarray) -> dict[int, np.ndarray]:
    """Columns with two values at least, by feature; no other can be cut anywhere."""
    columns = {f: np.ascontiguousarray(x[:, f]) for f in range(x.shape[1])}
    return {f: column for f, column in columns.items() if len(column) and column.min() < column.max()}


def _interleaved(turn: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where the items of each node stand in all those of the left nodes (turn 1) followed by all those of the right ones (turn 2)."""
    starts, right = np.zeros(len(sizes), int), turn == 2
    for own, before in ((~right, 0), (right, int(sizes[~right].sum()))):
        starts[own] = before + np.cumsum(sizes[own]) - sizes[own]
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _moved(order: np.ndarray, side: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Places in ``order``, by parent, of the items that go on, now by node and otherwise as they were; those that end here (side 0) are left out."""
    way = side.take(order)
    return np.concatenate([np.flatnonzero(way == 1), np.flatnonzero(way == 2)]).take(places)


class _Best:
    """Items ordered by node and value, kept for each feature from level to level."""

    def __init__(self, x: np.ndarray, node: np.ndarray, wy: np.ndarray, w: np.ndarray):
        self.columns = _varying(x)
        self.both = wy + 1j * w  # summed up in one go
        self.order = {f: np.argsort(column) for f, column in self.columns.items()}
        if len(node) and node.max() > 0:
            self.order = {f: order[np.argsort(node[order], kind="stable")] for f, order in self.order.items()}

    def choose(self, side, turn, sizes, total, weight, leaf, paths):
        ends = np.cumsum(sizes)
        starts, groups, places = ends - sizes, np.repeat(np.arange(len(sizes)), sizes), _interleaved(turn, sizes)
        place = np.arange(1, len(groups) + 1)
        full = ((place >= np.repeat(starts + leaf, sizes)) & (place <= np.repeat(ends - leaf, sizes)))[:-1]
        top, feature, cut = np.full(len(sizes), -np.inf), np.full(len(sizes), -1), np.zeros(len(sizes))
        for f, column in self.columns.items():
            order = self.order[f] = self.order[f].take(_moved(self.order[f], side, places))
            xs = column.take(order)
            at = np.flatnonzero(full & (xs[1:] != xs[:-1]))
            if not len(at):
                continue
            of = groups.take(at)
            sums = np.cumsum(self.both.take(order))
            left = sums.take(at) - np.where(starts > 0, sums[starts - 1], 0.0).take(of)
            gain = score(left.real, left.imag, total.take(of), weight.take(of))
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            best = np.full(len(sizes), -np.inf)
            best[of[first]] = np.maximum.reduceat(gain, first)
            equal = np.flatnonzero(gain == best.take(of))[::-1]
            chosen = np.zeros(len(sizes), int)
            chosen[of[equal]] = at[equal]  # the first of equal ones is written last
            better = np.flatnonzero(best > top)
            top[better], feature[better] = best[better], f
            cut[better] = midpoint(xs[chosen[better]], xs[chosen[better] + 1])
        return feature, cut


class _Random:
    """Items and their values ordered by node."""

    def __init__(self, x: np.ndarray, node: np.ndarray, wy: np.ndarray, w: np.ndarray):
        self.order = order = np.argsort(node, kind="stable")
        self.columns = {f: column.take(order) for f, column in _varying(x).items()}
        self.features, self.wy, self.w = x.shape[1], wy.take(order), w.take(order)
        self.equal = bool((w == 1).all())

    def choose(self, side, turn, sizes, total, weight, leaf, paths):
        moved = _moved(self.order, side, _interleaved(turn, sizes))
        starts, groups = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        self.order, self.wy = self.order.take(moved), self.wy.take(moved)
        if not self.equal:
            self.w = self.w.take(moved)
        part = draws(paths, self.features)
        top, feature, cut = np.full(len(sizes), -np.inf), np.full(len(sizes), -1), np.zeros(len(sizes))
        for f, column in self.columns.items():
            xs = self.columns[f] = column.take(moved)
            low, high = np.minimum.reduceat(xs, starts), np.maximum.reduceat(xs, starts)
            cuts = low + (high - low) * part[:, f]
            goes_left = np.flatnonzero(xs <= np.repeat(cuts, sizes))
            of = groups.take(goes_left)
            count = np.bincount(of, minlength=len(sizes))
            left_weight = count if self.equal else np.bincount(of, self.w.take(goes_left), len(sizes))
            ok = (low < high) & (count >= leaf) & (sizes - count >= leaf)
            gain = np.where(ok, score(np.bincount(of, self.wy.take(goes_left), len(sizes)), left_weight, total, weight), -np.inf)
            better = gain > top
            top[better], feature[better], cut[better] = gain[better], f, cuts[better]
        return feature, cut


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, node: np.ndarray, paths: np.ndarray, level: np.ndarray, leaf: np.ndarray, depth: np.ndarray, rule: str) -> Nodes:
    """Grow below each root: items (a row of ``x``, its target, its weight) start in the root ``node`` of theirs.

    Every root has a path, a level to start from, a smallest leaf (in items) and a largest depth. Items with weight 0 must not be given.
    """
    roots = len(paths)
    parts: list[Nodes] = []
    wy = w * y
    wyy = wy * y
    state = (_Best if rule == BEST else _Random)(x, node, wy, w)
    flat, width = np.ascontiguousarray(x).ravel(), x.shape[1]
    items, side = np.arange(len(x)), np.ones(len(x), np.uint8)  # items of the level's nodes, lying in ``node``; 0: ended, 1: in a root or left node, 2: in a right one
    turn = np.ones(roots, int)
    first, root = 0, np.arange(roots)  # running number of the level's first node; the root of each of its nodes
    while len(paths):
        groups = len(paths)
        sizes = np.bincount(node, minlength=groups)
        weight, total = np.bincount(node, w.take(items), groups), np.bincount(node, wy.take(items), groups)
        square = np.bincount(node, wyy.take(items), groups)
        with np.errstate(invalid="ignore", divide="ignore"):
            value = total / weight
        wanted = (sizes >= 2 * leaf) & (weight * square > total * total) & (level < depth)
        feature, cut = np.full(groups, -1), np.zeros(groups)
        now = np.flatnonzero(wanted)
        if len(now):
            kept = wanted.take(node)
            side[items.take(np.flatnonzero(~kept))] = 0
            kept = np.flatnonzero(kept)
            items, node = items.take(kept), (np.cumsum(wanted) - 1).take(node.take(kept))
            feature[now], cut[now] = state.choose(side, turn[now], sizes[now], total[now], weight[now], leaf[now], paths[now])
        split = np.flatnonzero(feature >= 0)
        left = np.full(groups, -1)
        left[split] = first + groups + 2 * np.arange(len(split))
        parts.append(Nodes(feature, cut, left, value, sizes, level, root))
        if not len(split):
            break
        goes_on = feature[now] >= 0
        kept = goes_on.take(node)
        side[items.take(np.flatnonzero(~kept))] = 0
        kept = np.flatnonzero(kept)
        items, node = items.take(kept), node.take(kept)
        right = flat.take(items * width + feature[now].take(node)) > cut[now].take(node)
        side[items] = 1 + right
        node, turn = (2 * np.cumsum(goes_on) - 2).take(node) + right, np.tile([1, 2], len(split))
        paths, level = child_paths(paths[split]), np.repeat(level[split] + 1, 2)
        leaf, depth, root = np.repeat(leaf[split], 2), np.repeat(depth[split], 2), np.repeat(root[split], 2)
        first += groups
    return Nodes(*(np.concatenate([getattr(p, f) for p in parts]) for f in Nodes.__dataclass_fields__)) if parts else Nodes(*[np.zeros(0, int)] * 7)


def walk(nodes: Nodes, x: np.ndarray, node: np.ndarray, depths: list[int]) -> list[np.ndarray]:
    """The node of each item when its tree is cut at each of the ``depths`` (ascending)."""
    out = []
    node = node.copy()
    moving = np.arange(len(node))
    for depth in depths:
        while True:
            at = node[moving]
            moving = moving[(nodes.feature[at] >= 0) & (nodes.level[at] < depth)]
            if not len(moving):
                break
            at = node[moving]
            node[moving] = nodes.left[at] + (x[moving, nodes.feature[at]] > nodes.cut[at])
        out.append(node.copy())
        moving = np.flatnonzero(nodes.feature[node] >= 0)
    return out
