"""Near-duplicate documents by DartMinHash signatures, banded joining and exact verification.

Signatures: every element (a shingle of five words) has darts in the plane of weight and rank. The plane is cut into cells of unit
area (weight intervals double, rank intervals shrink alike); how many darts a cell holds, where they stick and to
which coordinate they belong follow from hashes of element and cell only. A document keeps the darts below its weights and
below a rank that grows until each coordinate has one; the dart of smallest rank is the coordinate's value. Two documents agree
on a coordinate with the probability of their weighted Jaccard similarity, and the cost is that of the elements plus
that of the darts, not their product.

Joining: equal shingle sets are one node, whatever their number. In each bucket the node that meets most others (the likely
original of a group of edited copies) is compared with the other members. Members of buckets that still hold several
components are then joined exactly across components: two sets as similar as wanted share one of their rarest shingles,
at a place that leaves room for the overlap (prefix and position filters). Copies that were edited apart have rare
shingles of their own, so a group of thousands gives few candidates. All links are verified on the whole shingle sets, stored as 32-bit ids (in two texts of 600 words each, two different shingles share an id once in ten
thousand pairs), and classes are the connected components of the verified links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import join_by_share, mix, slices, text_bytes, without

WORDS = 5
BANDS, ROWS = 30, 5
#: Cells thrown at a time inside a task.
CELLS = 1 << 18
#: Elements signed at a time inside a task.
ELEMENTS = 1 << 16
_EMPTY = np.uint64(2**64 - 1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 2**64) for i in range(8)], dtype=np.uint64)
#: Chance of at most 0, 1, 2, ... darts in a cell: the Poisson distribution of mean one.
_AT_MOST = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit ids of the shingles; a text of fewer words is one shingle, one without words has none."""
    hashes = np.frombuffer(b"".join([xxhash.xxh3_64_digest(w) for w in text.split()]), dtype=">u8").astype(np.uint64)
    if not len(hashes):
        return hashes
    n = max(1, len(hashes) - words + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for i in range(min(words, len(hashes))):
            total += hashes[i : i + n] * _POWERS[i]
    return np.unique(mix(total))


def _throw(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, reach: np.ndarray, k: int, values: np.ndarray) -> None:
    """Throw the darts of all elements below their weights and their owners' ranks; lowers ``values`` (owner x k, flat)."""
    levels = 1 + np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64)
    at = np.repeat(np.arange(len(elements)), levels)
    level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    wide = np.maximum(low, 1.0)
    columns = np.maximum(1, np.ceil(reach[owner[at]] * wide)).astype(np.int64)
    ends = np.cumsum(columns)
    first = 0
    while first < len(at):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + CELLS, side="right")))
        n = columns[first:last]
        row = np.repeat(np.arange(first, last), n)
        column = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        with np.errstate(over="ignore"):
            cell = mix(mix(elements[at[row]] + level[row].astype(np.uint64) * _POWERS[1]) + column.astype(np.uint64) * _GOLD)
        count = np.searchsorted(_AT_MOST, (cell >> np.uint64(11)) * 2.0**-53, side="right")
        dart = np.repeat(np.arange(len(row)), count)
        number = np.arange(len(dart)) - np.repeat(np.cumsum(count) - count, count)
        with np.errstate(over="ignore"):
            one = mix(cell[dart] + (number.astype(np.uint64) + np.uint64(1)) * _POWERS[2])
            two = mix(one + _GOLD)
        row, column = row[dart], column[dart]
        height = low[row] + wide[row] * ((one >> np.uint64(32)) * 2.0**-32)
        rank = (column + (one & np.uint64(0xFFFFFFFF)) * 2.0**-32) / wide[row]
        who = owner[at[row]]
        ok = (height < weights[at[row]]) & (rank < reach[who])
        place = who[ok] * k + ((two[ok] >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        value = rank[ok].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | (two[ok] & np.uint64(0xFFFFFFFF))
        np.minimum.at(values, place, value)
        first = last


def signatures(sets: list[np.ndarray], weights: list[np.ndarray] | None, k: int) -> np.ndarray:
    """One row of ``k`` values per set. Weights (default one each) are positive; an empty set keeps the empty value.

    Sets are signed a few at a time, as many as hold ``ELEMENTS`` elements; a larger one alone.
    """
    if not sets:
        return np.zeros((0, k), np.uint64)
    ends = np.cumsum([len(s) for s in sets])
    done, first = [], 0
    while first < len(sets):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + ELEMENTS, side="right")))
        done.append(_signed(sets[first:last], weights and weights[first:last], k))
        first = last
    return np.concatenate(done)


def _signed(sets: list[np.ndarray], weights: list[np.ndarray] | None, k: int) -> np.ndarray:
    values = np.full(len(sets) * k, _EMPTY)
    todo = [i for i, s in enumerate(sets) if len(s)]
    darts = k * math.log(k) + 3 * k
    while todo:
        sizes = [len(sets[i]) for i in todo]
        owner = np.repeat(np.array(todo), sizes)
        elements = np.concatenate([sets[i] for i in todo])
        weight = np.concatenate([weights[i] for i in todo]).astype(float) if weights else np.ones(len(elements))
        total = np.bincount(owner, weight, minlength=len(sets))
        _throw(elements, weight, owner, darts / np.maximum(total, 1e-12), k, values)
        grid = values.reshape(-1, k)
        todo = [i for i in todo if (grid[i] == _EMPTY).any()]
        darts *= 2
    return values.reshape(-1, k)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    with np.errstate(over="ignore"):
        key = np.zeros((len(signature), bands), np.uint64) + np.arange(bands, dtype=np.uint64) * _GOLD
        for i in range(rows):
            key = mix(key + parts[:, :, i] * _POWERS[i])
    return key.view(np.int64)


def _mark() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, mark (MD5 of the text), set_low, set_high (hash of the shingle set), n, keys (bucket of each band) and shingles of texts with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, marks, sets = [], [], []
            for doc, mark, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "text")), strict=True):
                own = shingles(text)
                if len(own):
                    ids.append(doc)
                    marks.append(mark)
                    sets.append(own)
            if not ids:
                continue
            keys = band_keys(signatures(sets, None, bands * rows), bands, rows)
            small = [np.unique((x >> np.uint64(32)).astype(np.uint32)) for x in sets]
            digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(s.tobytes()) for s in sets]), "<i8").reshape(-1, 2)
            offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(marks, pa.string()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array([len(s) for s in small], pa.int64()),
                    pa.ListArray.from_arrays(offsets([bands] * len(ids)), pa.array(keys.ravel())),
                    pa.ListArray.from_arrays(offsets([len(s) for s in small]), pa.array(np.concatenate(small).view(np.int32))),
                ],
                names=["doc_id", "mark", "set_low", "set_high", "n", "keys", "shingles"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark().alias("mark"), text_bytes()).mapInArrow(
        run, "doc_id long, mark string, set_low long, set_high long, n long, keys array<long>, shingles array<int>"
    )


def components(edges: DataFrame, name: str) -> DataFrame:
    """id, label (smallest id of the component) for every node of ``edges`` (a, b): smallest label of the neighbours, then of the
    label's own label, until nothing changes. Labels are tables in the shared folder."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name)
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), name)
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        better = materialize(labels.join(near, "id").select("id", "label", F.least("label", "near").alias("next")), name)
        up = better.select(F.col("id").alias("next"), F.col("next").alias("up"))
        jumped = materialize(better.join(up, "next", "left").select("id", F.coalesce(F.least("next", "up"), "next").alias("label"), (F.least("next", "up") != F.col("label")).alias("moved")), name)
        labels = jumped.select("id", "label")
        if jumped.where("moved").isEmpty():
            return labels


def shingle_sets(known: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, n, shingles of the documents in ``ids``, stored. The join is by merging at every size: the sets are the large side."""
    return materialize(known.select("doc_id", "n", "shingles").hint("merge").join(ids.distinct(), "doc_id", "left_semi"), "sets")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least this Jaccard similarity."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    share = F.size(F.array_intersect("sa", "sb"))
    # a set whose size is too far off cannot be similar: tested before the arrays are compared
    near = F.least("na", "nb") >= F.greatest("na", "nb") * similarity - 1e-9
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return both.where(near).where(share >= (F.col("na") + F.col("nb") - share) * similarity - 1e-9).select("a", "b").distinct()


def prefix_pairs(sets: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b), of different labels, that may be similar: all that are, and few others.

    Shingles are put in order of their frequency among these sets. Sets of similarity t have a common shingle
    among the first n - ceil(t n) + 1 of each; and from the first common one on, the shorter rest must still hold the overlap t / (1 + t) (na + nb).
    """
    each = sets.select("doc_id", "n", F.explode("shingles").alias("s"))
    common = each.groupBy("s").agg(F.count("*").alias("f")).where("f > 1")
    ranked = each.join(common.hint("merge"), "s").groupBy("doc_id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("f", "s"))).alias("order"))
    # shingles that no other set has come first; they take places but cannot match
    alone = F.col("n") - F.size("order")
    length = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1
    cut = ranked.select("doc_id", "n", alone.alias("alone"), F.slice("order", F.lit(1), F.greatest(length - alone, F.lit(0)).cast("int")).alias("order"))
    first = cut.join(labels.hint("merge"), "doc_id").select("doc_id", "n", "label", "alone", F.posexplode("order").alias("i", "e"))
    first = materialize(first.select("doc_id", "n", "label", (F.col("alone") + F.col("i")).alias("place"), F.col("e.s").alias("s")), "prefixes")
    other = first.select("s", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("label").alias("other"), F.col("place").alias("pb"))
    n, nb = F.col("n"), F.col("nb")
    room = F.least(n - F.col("place"), nb - F.col("pb")) >= F.ceil((n + nb) * (similarity / (1 + similarity)) - 1e-9)
    sizes = F.least(n, nb) >= F.greatest(n, nb) * similarity - 1e-9
    found = first.join(other.hint("merge"), "s").where((F.col("doc_id") < F.col("b")) & (F.col("label") != F.col("other")) & sizes & room)
    return found.select(F.col("doc_id").alias("a"), "b").distinct()


_LEAST = -(1 << 63)  # stands for a missing id


def _classified(docs: DataFrame, similarity: float, bands: int, rows: int) -> DataFrame:
    """doc_id (a missing one is ``_LEAST``), mark, class_id, class_docs, top of the rows with a word: ``top`` names the class's first (doc_id, mark).

    Nodes are shingle sets, named by the row that stands for them, so rows of one id and several texts are different nodes.
    """
    filled = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("doc_id"), "text")
    known = materialize(sketches(filled, bands, rows).withColumn("row", F.monotonically_increasing_id()), "sketches")
    copies = known.groupBy("set_low", "set_high").agg(F.min(F.struct("doc_id", "mark", "row")).alias("top"), F.count("*").alias("docs"))
    copies = materialize(copies.select("set_low", "set_high", F.struct("top.doc_id", "top.mark").alias("top"), F.col("top.row").alias("id"), "docs"), "copies")
    known_sets = known.select(F.col("row").alias("doc_id"), "n", "shingles")
    narrow = known.select(F.col("row").alias("id"), "n", "keys")
    nodes = materialize(narrow.hint("merge").join(copies.select("id"), "id", "left_semi"), "nodes")

    buckets = nodes.select("id", F.posexplode("keys").alias("band", "key"))
    shared = buckets.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(buckets.hint("merge").join(shared, ["band", "key"]), "members")
    meets = members.groupBy("id").agg(F.sum("size").alias("met"))
    leaders = members.join(meets, "id").groupBy("band", "key").agg(F.max(F.struct("met", F.bitwise_not("id").alias("turned"))).alias("top"))
    leaders = leaders.select("band", "key", F.bitwise_not("top.turned").alias("b"))
    first = members.join(leaders, ["band", "key"]).where("id <> b").select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()
    tried = materialize(first, "tried")
    ends = tried.select(F.col("a").alias("doc_id")).union(tried.select(F.col("b").alias("doc_id")))
    links = materialize(verified(tried, shingle_sets(known_sets, ends), similarity), "links")
    labels = components(links, "labels")

    # a bucket of two is done; in larger ones, members of different components may still be similar
    own = members.where("size > 2").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = own.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band", "key")
    open_ends = materialize(own.join(mixed, ["band", "key"]).select(F.col("id").alias("doc_id"), "label").distinct(), "open")
    sets = shingle_sets(known_sets, open_ends.select("doc_id"))
    rest = materialize(prefix_pairs(sets, open_ends, similarity).join(tried, ["a", "b"], "left_anti"), "rest")
    more = materialize(verified(rest, sets, similarity), "links")
    if not more.isEmpty():
        labels = components(links.union(more), "labels")

    labelled = materialize(copies.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")).select("set_low", "set_high", "top", "docs", "label"), "classes")
    classes = labelled.groupBy("label").agg(F.min("top").alias("first"), F.sum("docs").alias("class_docs"), F.count("*").alias("rows"))
    classes = join_by_share(labelled.drop("top"), materialize(classes, "classes"), ["label"], "rows", labelled.count())
    classes = materialize(classes.select("set_low", "set_high", F.col("first").alias("top"), "class_docs", "docs"), "classes")
    rows_of = known.select("doc_id", "mark", "set_low", "set_high")
    return join_by_share(rows_of, classes, ["set_low", "set_high"], "docs", known.count()).select("doc_id", "mark", F.col("top.doc_id").alias("class_id"), "class_docs", "top")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), class_docs (its rows) for every row of ``docs`` (doc_id, text).

    Words are what white space (ASCII) separates. Equal shingle sets have similarity one, so repeated rows and exact copies share
    a class. A text of one to four words is one shingle. Null texts and texts without a word are near to nothing: each
    is a class of its own. Null ids count as the smallest id (class_id null). Rows of one id and several texts may lie in several classes. An
    empty table gives none. Two texts at similarity s share a bucket with probability 1-(1-s^rows)^bands: 0.999993 at 0.8 with the defaults.
    """
    docs = docs.select("doc_id", "text")
    classed = _classified(docs, similarity, bands, rows).select("doc_id", "class_id", "class_docs")
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))
    blank = docs.where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select(
        own.alias("doc_id"), own.alias("class_id"), F.lit(1).cast("long").alias("class_docs")
    )
    whole = lambda c: F.nullif(F.col(c), F.lit(_LEAST)).alias(c)
    return classed.union(blank).select(whole("doc_id"), whole("class_id"), "class_docs")


def keep_first(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One row of each class, all columns: that of the smallest doc_id (null first), then of the smallest MD5 of its text; any one of rows that
    repeat both. Rows without a word all stay. Rows of one id and texts of several classes are told apart."""
    own = ["__id", "__mark", "__fate"]
    docs = without(docs, own)
    classes = materialize(_classified(docs, similarity, BANDS, ROWS).select("doc_id", "mark", "top"), "classified")
    seen = classes.groupBy(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).agg(F.count("*").alias("n"), F.first("top").alias("top"))
    stays = (F.col("top.doc_id") == F.col("__id")) & (F.col("top.mark") == F.col("__mark"))
    fate = seen.select("__id", "__mark", F.when(~stays, "gone").when(F.col("n") > 1, "once").alias("__fate")).where("__fate is not null")
    marked = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)), "__mark": _mark()})
    marked = marked.join(materialize(fate, "fates"), ["__id", "__mark"], "left").where("__fate is null or __fate = 'once'").select(*docs.columns, *own)
    repeated = marked.where("__fate = 'once'").dropDuplicates(["__id", "__mark"])
    return marked.where("__fate is null").union(repeated).drop(*own)
