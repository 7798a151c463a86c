"""Near copies where ids and texts repeat, against a plain rendition; the pipeline on awkward input."""

import hashlib
from collections import Counter

import corpus_pipeline
from tokengauge.llm import minhash

A = " ".join(f"alpha{i}" for i in range(60))
A2 = A.replace("alpha30", "changed")
B = " ".join(f"beta{i}" for i in range(60))
B2 = B.replace("beta7", "changed")
C = " ".join(f"gamma{i}" for i in range(60))


def shingles(text):
    words = text.split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def plain_classes(rows):
    """(doc_id, class_id, class_docs) of every row, by all pairs of rows."""
    sets = [shingles(t or "") for _, t in rows]
    label = list(range(len(rows)))
    near = lambda a, b: bool(a and b) and len(a & b) >= 0.8 * len(a | b)
    while True:
        new = [min([label[i], *(label[j] for j in range(len(rows)) if near(sets[i], sets[j]))]) for i in range(len(rows))]
        if new == label:
            break
        label = new
    least = lambda i: (i is not None, i or 0)
    first = {c: min((rows[i][0] for i in range(len(rows)) if label[i] == c), key=least) for c in set(label)}
    size = Counter(label)
    return Counter((i, first[c], size[c]) for (i, _), c in zip(rows, label, strict=True))


CASES = [
    [(5, A), (5, B), (3, B2), (7, A2)],
    [(9, A), (9, A), (9, A2), (4, C), (4, C)],
    [(None, A), (2, A), (None, B), (1, B2), (None, C), (None, C)],
    [(1, None), (1, ""), (2, " \n"), (2, " \n"), (3, "one two"), (3, "one two"), (4, "one"), (5, A * 50)],
]


def test_classes_of_repeated_ids_and_texts(spark):
    for rows in CASES:
        got = minhash.near_duplicates(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, class_docs int, mark string"))
        assert Counter(map(tuple, got.collect())) == plain_classes(rows)


def test_keep_first_loses_no_text(spark):
    def kept(rows):
        frame = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, mark long")
        out = minhash.keep_first(frame)
        assert out.columns == frame.columns
        return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)

    assert kept(CASES[0]) == sorted([(3, B2), (5, A)], key=repr)
    first = min(A, A2, key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert kept(CASES[1]) == sorted([(9, first), (4, C)], key=repr)
    assert kept(CASES[2]) == sorted([(None, A), (None, B), (None, C)], key=repr)
    assert kept(CASES[3]) == sorted([(1, None), (1, ""), (2, " \n"), (2, " \n"), (3, "one two"), (4, "one"), (5, A * 50)], key=repr)


def write(spark, folder, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "hot", len(t or "")) for i, t in rows], schema).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, i % 2, int(i % 7 == 0)) for i, _ in rows if i is not None and i % 3 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline_on_awkward_tables(spark, tmp_path):
    rows = [r for case in CASES for r in case] + [(100 + i, f"{A} tail {i}\nshared line of more than twenty signs\n{'word ' * i}") for i in range(9)] + [(50, None), (None, None), (51, "x" * 50_000)]
    write(spark, tmp_path / "full", rows)
    write(spark, tmp_path / "empty", [])
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{tmp_path}/full/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, f"{tmp_path}/full"), "stage")
        assert docs.columns == names
    packed = corpus_pipeline.run(spark, f"{tmp_path}/full")
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(packed.columns)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
