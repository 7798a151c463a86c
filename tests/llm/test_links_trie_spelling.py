"""SimHash links, prefix trie and spelling variants against brute force, and their defined cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tokengauge.llm import prefix_trie, simhash, spelling

CLASH = ", n long, fp long, component_id string, rows long, form string, wid long, part long, depth string"


def clashing(spark, rows, schema):
    return spark.createDataFrame([(*r, 1, 2, "c", 3, "f", 4, 5, "d") for r in rows], schema + CLASH)


def unsigned(x):
    return x % 2**64


def components(fps):
    """Smallest index within reach, over links of at most three bits."""
    x, label = np.array(fps, np.uint64), np.arange(len(fps))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new[new]


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    ones = Counter(j for s in shingles for j in range(64) if xxhash.xxh64_intdigest(s, seed=42) >> j & 1)
    return sum(1 << j for j in range(64) if 2 * ones[j] > len(shingles))


@pytest.mark.parametrize("free", [list(range(64)), list(range(3, 40)), [1, 5, 9, 13], []])
@pytest.mark.parametrize("radius", [1, 3])
def test_every_pair_within_the_radius_meets(free, radius):
    rng, masks = random.Random(len(free)), simhash.covering(free, radius)
    for _ in range(500):
        differing = sum(1 << p for p in rng.sample(free, min(radius, len(free))))
        assert any(m & differing == 0 for m in masks)


def fingerprints_around(centres, weak, each, seed=1):
    """Groups that differ in the same few positions, as copies do, so that whole groups share buckets."""
    rng, out = np.random.default_rng(seed), []
    for centre in rng.integers(0, 2**63, centres, dtype=np.uint64).tolist():
        places = rng.choice(64, weak, replace=False).tolist()
        out += [centre ^ sum(1 << p for p in places if rng.random() < 0.4) for _ in range(each)]
    return list(dict.fromkeys(out + rng.integers(0, 2**63, 200, dtype=np.uint64).tolist()))


def test_linked_equals_all_pairs():
    fps = fingerprints_around(4, 16, 300)
    label, want = simhash.linked(np.array(fps, np.uint64), 0), components(fps)
    assert len({*zip(label.tolist(), want.tolist(), strict=True)}) == len(set(want.tolist())) == len(set(label.tolist()))


@pytest.mark.parametrize("limit, share", [(1 << 16, 2000), (20, 2000), (60, 0)])
def test_links_of_split_buckets_equal_all_pairs(spark, monkeypatch, limit, share):
    """Small limits: large buckets are dealt out again, from the counts of slots or (share 0) from the scan alone."""
    monkeypatch.setattr(simhash, "SHARE", share)
    fps = fingerprints_around(3, 14, 250)
    nodes = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, i) for i, f in enumerate(fps)], "fp long, doc long")
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    at = {f: i for i, f in enumerate(fps)}
    for r in simhash.links(nodes, limit=limit).collect():
        a, b = sorted((root(at[unsigned(r["a"])]), root(at[unsigned(r["b"])])))
        label[b] = a
    assert [root(i) for i in range(len(fps))] == components(fps).tolist()


def simhash_wanted(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    label = components(fps).tolist()
    low = {c: min((rows[i][0] for i in range(len(rows)) if label[i] == c and rows[i][0] is not None), default=None) for c in set(label)}
    return sorted(((i, f"{f:016x}", low[c]) for (i, _), f, c in zip(rows, fps, label, strict=True)), key=repr)


def test_simhash_cases(spark):
    text = " ".join(f"word{i % 37}x{i}" for i in range(120))
    rows = [
        (9, text), (4, text.upper()), (4, "other text of a few words"), (7, text.replace("word5x5", "changed")), (7, text), (7, text), (None, text),
        (20, None), (21, ""), (19, " \n\t\x0b"), (30, "one"), (29, "ONE"), (31, "one two"), (None, "alone and without any id"),
        (40, "é É ñ x"), (41, "y " * 30_000), (42, "z" * 200_000), (-3, "minus"),
    ]
    got = simhash.near_duplicates(clashing(spark, rows, "doc_id long, text string").repartition(3))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == simhash_wanted(rows)
    assert simhash.near_duplicates(clashing(spark, rows, "doc_id long, text string").limit(0)).count() == 0


def test_simhash_of_the_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=repr) == simhash_wanted([tuple(r) for r in docs.collect()])


def test_fingerprint_of_a_text_in_parts(monkeypatch):
    from tokengauge.llm import common

    texts = ["a b c d e", "long words " * 50, "x" * 300 + " y z", " \n lead and trail \n", "one " + "two" * 40]
    want = [simhash.fingerprint(t.encode()) for t in texts]
    monkeypatch.setattr(common, "PART_BYTES", 3)
    assert [simhash.fingerprint(t.encode()) for t in texts] == want == [plain_fingerprint(t) for t in texts]


# --- prefix trie ----------------------------------------------------------------------


def trie_wanted(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    made = {}
    for c, turns in by.items():
        turns.sort()
        h = zlib.crc32(str(c).encode()) % 9
        source = c - (c % 5 if c >= 0 else -(-c % 5))
        made[c] = [t[3:] for t in sorted(by.get(source, []))[:h]] + [t[3:] for t in turns[h:]]
    members, kids = defaultdict(list), defaultdict(set)
    for c, path in made.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    for node in members:
        if node:
            kids[node[:-1]].add(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    ends = {n: ",".join(str(c) for c in sorted(m) if len(made[c]) == len(n)) for n, m in members.items()}
    return sorted(
        (
            (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest())
            for n, m in members.items()
        ),
        key=repr,
    )


TURN = "conv_id long, turn long, role string, text string"


def conversations():
    rng, rows = random.Random(3), []
    for c in [*range(-20, 100), 2**40]:
        if c % 7 == 3:  # some sources of a group are absent
            continue
        for t in range(300 if c == 50 else rng.choice([1, 2, 5, 9, 20])):
            turn = rng.choice([None, t, t]) if c % 11 == 0 else t
            role = rng.choice(["u", None, "a"]) if c % 3 == 0 else "u"
            rows.append((c, turn, role, rng.choice([None, "", "é" * t, "same"]) if c % 2 else f"x{t}"))
    rows += [(c, t, "u", f"common {t}") for c in range(200, 260) for t in range(12)]
    return rows + [(None, 1, "u", "no conversation")] + rows[5:9] + [(300, 0, "u", "long " * 100_000)]


@pytest.mark.parametrize("options", [{}, {"fan": 2, "block": 7, "queue": 3}, {"fan": 4, "block": 64, "queue": 1}])
def test_trie_equals_plain_trie(spark, options):
    """Small classes, blocks and queues: several rounds, chained blocks and spilled messages."""
    rows = conversations()
    got = prefix_trie.trie(clashing(spark, rows, TURN).drop("depth").repartition(5), **options)
    assert sorted(map(tuple, got.collect()), key=repr) == trie_wanted(rows)


def test_trie_cases(spark):
    rows = conversations()
    frame = spark.createDataFrame(rows, TURN)
    assert prefix_trie.trie(frame.limit(0)).count() == 0 == prefix_trie.trie(frame.where("conv_id is null")).count()
    one = [r for r in rows if r[0] == 50]
    assert sorted(map(tuple, prefix_trie.trie(frame.where("conv_id = 50")).collect()), key=repr) == trie_wanted(one)


def test_digests_across_chunks_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    ends = spark.range(-500, 500).selectExpr("0L as depth", "id % 2 * 0L as p1", "abs(id) % 3 as p2", "id as conv_id").repartition(6)
    got = {r["p2"]: r["digest"] for r in prefix_trie.end_digests(ends).collect()}
    assert got == {k: hashlib.sha256(",".join(str(i) for i in range(-500, 500) if abs(i) % 3 == k).encode()).hexdigest() for k in range(3)}


def test_spilling_queue_equals_sums():
    rng, queue, want = random.Random(1), prefix_trie.SpillingQueue(5), Counter()
    keys = [(-d, rng.randrange(9), 0) for d in range(40, 0, -1) for _ in range(12)]
    for i, key in enumerate(rng.sample(keys, len(keys))):
        queue.push(key, (i, 1))
        want[key] += i
    for key in sorted({*keys, (0, 0, 0)}):
        assert sum(a for a, _ in queue.take(key)) == want[key]


# --- spelling -------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling_wanted(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and one_edit(v, w)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v), default=None) for w, vs in near.items()}
    form = {w: b if b is not None and n[b] >= 2 * n[w] else None for w, b in best.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), k, len(near[w]), n.get(form[w])) for w, k in n.items()), key=repr)


def spelled():
    rng = random.Random(1)
    base = ["hello", "helo", "hellos", "aabbb", "aabb", "aabbbb", "aaaaa", "aaaaaa", "Éclair", "éclair", "eclair", "straße", "STRASSE", "×" * 5]
    base += ["x" * 63, "x" * 64, "x" * 65, "x" * 66, "y" * 64 + "z", "y" * 63 + "zz", "y" * 65, "ab" * 300, "ab" * 299 + "a", "ab" * 299 + "ac"]
    rows = []
    for i in range(250):
        words = []
        for _ in range(30):
            w = rng.choice(base) if rng.random() < 0.5 else "".join(rng.choice("abé") for _ in range(rng.randint(4, 8)))
            if rng.random() < 0.2:
                j = rng.randrange(len(w))
                w = w[:j] + rng.choice("abcé") + w[j + rng.randint(0, 1) :]
            words.append(w)
        rows.append((i if i % 50 else None, " ".join(words) + rng.choice([". ", "\n", "1"])))
    return [*rows, rows[3], (1, None), (2, ""), (3, "!! 12"), (4, " ".join(["z" * 3000] * 3))]


@pytest.mark.parametrize("longest", [64, 6])
def test_variants_equal_all_pairs(spark, longest):
    """With ``longest`` 6 nearly all prefixes go as fingerprints."""
    rows = spelled()
    got = spelling.variants(clashing(spark, rows, "doc_id long, text string").repartition(4), longest=longest)
    assert sorted(map(tuple, got.collect()), key=repr) == spelling_wanted(rows)


def test_variants_of_nothing(spark):
    rows = clashing(spark, [(1, None), (2, ""), (3, "ab ab ab"), (4, "rarely")], "doc_id long, text string")
    assert spelling.variants(rows).count() == 0 == spelling.variants(rows.limit(0)).count()
