"""The operators of the llm subpackage on small inputs: edge cases, and brute force where SQL has no twin."""

import hashlib
import zlib
from collections import Counter
from html.parser import HTMLParser
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tokengauge.llm import ann, bpe, html_wrapper, licenses, line_dedup, minhash, ordinal, packing, quality_rules, toxicity

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG = "the quick brown fox jumps over the lazy dog while rain falls on grey stone roofs near the old river bank and people walk home slowly"
WORD_LIST = LONG.split()[:8] + ["rain", "falls"]
EDGE = [
    (1, LONG), (2, LONG), (2, LONG), (3, None), (4, ""), (5, " \n\t "), (None, LONG + " again"), (6, "x" * 30_000), (7, "l " * 20_000),
    (8, "Ünïcode <|endoftext|> í ŀ 漢字  　 don't\r\n\x0b\x0c end"), (9, "shared line that is long enough\nshared line that is long enough\nown"),
    (10, "  SHARED line that is long enough\t\nother"), (11, "shared line that is long enough"), (12, "one two three"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src", 7, 0.5, "clash") for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, n_lines string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


def test_bpe_equals_library(docs, empty, corpus):
    library = Tokenizer.from_file(WORDS)
    for source in (docs, corpus):
        texts = Counter((r["doc_id"], r["text"] or "") for r in source.select("doc_id", "text").collect())
        want = Counter()
        for (i, t), n in texts.items():
            ids = library.encode(t, add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False)
            want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += n
        assert Counter(map(tuple, bpe.digests(source, WORDS).collect())) == want
    assert bpe.digests(empty, WORDS).count() == 0


def test_bpe_chunks_anywhere():
    """Very short chunks, so that most words are cut and repaired; both kinds of vocabulary."""
    texts = [t or "" for _, t in EDGE if len(t or "") < 5000] + ["a\n\n b", "tail  ", "\n\n", "x \n y", "no gap at the end\n"]
    for path, gaps in ((WORDS, False), (public_tokenizers.path("byte_bpe_50k.json"), True)):
        encoder, library = bpe.Encoder(path, gaps, cut_bits=2), Tokenizer.from_file(path)
        for _ in range(2):  # the second time from the kept chunks
            got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([t.encode() for t in texts])]
            assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_quality_counts_and_verdicts(docs, empty, corpus):
    import re

    for source in (docs, corpus):
        got = Counter(map(tuple, quality_rules.judge(source).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()))
        want = Counter()
        for r in source.select("doc_id", "text").collect():
            t = r["text"] or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
            covered = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
            lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
            want[r["doc_id"], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed] += 1
        assert got == want
    assert quality_rules.judge(empty).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, None}


def test_quality_sentences_and_function_words(docs, corpus):
    import re

    spelled = {y for x in quality_rules.FUNCTION_WORDS for y in (x, x.capitalize(), x.upper())}
    for source in (docs, corpus):
        for r in quality_rules.measures(source.select("text")).select("text", "__m.*").collect():
            w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
            lines = [x for x in (r["text"] or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            ended = sum(bool(re.search("[.!?:;…][\"'»”)\\]]*[\x20\x09-\x0D]*$", x)) for x in lines)
            assert (r["n_function"], r["n_sentences"], r["n_ended"]) == (sum(x in spelled for x in w), sum(bool(re.search("[.!?…][\"'»”)\\]]*$", x)) for x in w), ended)


def test_quality_variety_holds_at_every_length(spark):
    rng = np.random.default_rng(1)
    salad = lambda n: " ".join(WORD_LIST[i] for i in rng.integers(0, 10, n))
    prose = lambda n: " ".join(f"{WORD_LIST[i % 10]}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in (rng.pareto(0.8, n) * 40).astype(int) % 6760)
    texts = [f(n) for f in (salad, prose) for n in (1999, 2000, 2001, 2002, 20_000)]
    rows = quality_rules.measures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = [r[1] for r in sorted(rows.select("doc_id", F.array(*quality_rules.votes())).collect())]
    place = [quality_rules.RULES.index(x) for x in ("variety", "flow")]
    assert [[v[i] for i in place] for v in got] == [[-1, 0]] * 5 + [[0, got[5][place[1]]]] * 5


def _plain_em(rows, rules, rounds):
    """Rows (votes, n): share of good, weights of the rules."""
    b, w = 0.5, [[np.log(4.0)] * 2 for _ in range(rules)]
    for _ in range(rounds):
        p = [1 / (1 + (1 - b) / b * np.exp(-sum(w[j][0] if x > 0 else -w[j][1] if x < 0 else 0 for j, x in enumerate(v)))) for v, _ in rows]
        good, total = sum(n * q for (_, n), q in zip(rows, p)), sum(n for _, n in rows)
        new = []
        for j in range(rules):
            pair = []
            for vote in (1, -1):
                on_good = sum(n * q for (v, n), q in zip(rows, p) if v[j] == vote)
                on_bad = sum(n * (1 - q) for (v, n), q in zip(rows, p) if v[j] == vote)
                rates = (on_good + (8 if vote > 0 else 2)) / (good + 10), (on_bad + (2 if vote > 0 else 8)) / (total - good + 10)
                pair.append(max(0, np.log(rates[0] / rates[1]) * vote) if on_good + on_bad else np.log(4.0))
            new.append(pair)
        b, w = (good + 5) / (total + 10), new
    return b, w


def test_quality_estimate_is_plain_em(spark):
    rows = [([-1, -1, 0], 30), ([-1, 0, 0], 20), ([0, 0, 1], 100), ([-1, 0, 1], 5), ([0, 0, 0], 9)]
    share, weights = quality_rules.estimate(spark.createDataFrame(rows, "__votes array<int>, n long"), 3, rounds=25, tolerance=0)
    want_share, want = _plain_em(rows, 3, 25)
    assert np.isclose(share, want_share, atol=1e-9) and np.allclose(weights, want, atol=1e-9)
    assert quality_rules.estimate(spark.createDataFrame([], "__votes array<int>, n long"), 2) == (0.5, [(np.log(0.8 / (1 - 0.8)),) * 2] * 2)


def test_quality_worthless_rule_is_found_out_and_a_bad_vote_overruled(spark):
    # two rules agree on 30,000 good and 10,000 bad documents; the third votes bad on a tenth of either
    rows = [([1, 1, 0], 27_000), ([1, 1, -1], 3000), ([-1, -1, 0], 9000), ([-1, -1, -1], 1000), ([1, -1, 0], 400), ([0, 1, -1], 300)]
    patterns = spark.createDataFrame(rows, "__votes array<int>, n long")
    share, weights = quality_rules.estimate(patterns, 3)
    assert 0.7 < share < 0.8 and weights[2][1] < 0.1 < 2 < min(weights[0] + weights[1])

    def good(balance, w):
        return {tuple(r[0]) for r in patterns.withColumn("p", quality_rules.posterior(balance, w)).where("p >= 0.5").select("__votes").collect()}

    assert {(1, 1, -1), (0, 1, -1)} <= good(share, weights)  # all-must-pass drops both
    assert (0, 1, -1) not in good(0.4, [(1.0, 1.0)] * 3)  # so do equal accuracies


def test_quality_verdict_follows_labels_not_all_must_pass(spark, sf):
    """Labels are no input of the rules. Every document that fails a rule alone and is labelled good stays."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    voted, p_good = quality_rules._judged(docs, ["doc_id"])
    rows = voted.select("doc_id", p_good.alias("p"), F.exists("__votes", lambda v: v < 0).alias("any")).join(labels, "doc_id").collect()
    assert len(rows) > 50 and np.mean([(r["p"] >= 0.5) == bool(r["quality"]) for r in rows]) > 0.95
    kept = voted.select(p_good.alias("p"), F.exists("__votes", lambda v: v < 0).alias("any")).collect()
    assert any(r["any"] and r["p"] >= 0.5 for r in kept) and any(r["any"] and r["p"] < 0.5 for r in kept)


def components(sets, similarity):
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_duplicates_equal_all_pairs(spark, corpus):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in rng.integers(0, 400, 120)]
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    for k in range(120):  # copies edited apart: near to the original or not, mostly not to each other
        words = list(base)
        for at in rng.integers(0, len(words), rng.integers(0, 6)):
            words[at] = f"e{k}{at}"
        rows.append((10_000 + k, " ".join(words)))
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == components(sets, 0.8)


def test_near_duplicates_edges(docs, empty):
    got = Counter((r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(docs).collect())
    same = [i for i, t in EDGE]
    assert sum(got.values()) == len(same)
    # a null id is the smallest: its near copy takes the class of the null id
    assert got[1, None] == 1 and got[2, None] == 2 and got[None, None] == 1
    assert all(got[i, i] for i in (3, 4, 5, 6, 7, 8, 9, 11, 12))
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {None, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12}


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.uniform(0.5, 9, 300), rng.uniform(0.5, 9, 300)
    s = minhash.signatures([ids, ids], [a, b], 2000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - want) < 0.04
    assert (minhash.signatures([ids[:0]], None, 8) == 2**64 - 1).all()


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 24)).round(2)
    x[100:400] = x[0]  # equal vectors: ties go to the smaller id
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[5].tolist()), (700, None), (701, [0.0] * 24), (702, [float("nan")] * 24), (703, [None] * 24), (704, [1.0]), (None, x[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 700, 20))
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        best = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and np.allclose([f[2] for f in found], s[[f[1] for f in found]])
        hit += len({f[1] for f in found} & set(best))
    assert hit >= 0.98 * 20 * len(got)
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(df.where("vec_id in (0, 20, 41)"), F.col("vec_id") % 20 == 0).count() == 4


def test_ordinal(spark, docs, empty, corpus, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = ordinal.train(corpus, ordinal.grades(labels))
    assert model.thresholds == sorted(model.thresholds)
    rated = ordinal.rate(docs, model)
    assert rated.count() == len(EDGE) and rated.where("tail_probability is null or expected_grade not between 0 and 2").count() == 0
    assert ordinal.rate(empty, model).count() == 0
    assert ordinal.fit([], []).tails("a b").shape == (2,)
    good = ordinal.fit(["fine words here"] * 20 + ["BAD! BAD! ***"] * 20, [2] * 20 + [0] * 20)
    assert good.tails("other fine words")[0] > 0.5 > good.tails("BAD! OH! ***")[0]


def test_licences_in_wrapped_and_long_paragraphs(spark):
    model = licenses.fit(["some plain words about the weather", "the version of events was released"] * 20)
    wrapped = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction"
    bsd = "Redistribution and use in source and binary forms, with or without\r\nmodification, are permitted provided that the following conditions are met:"
    lgpl = "This program is free software; you can redistribute it and/or modify it under the terms of\nthe GNU Lesser General Public License"
    filler = "plain words about the weather " * 40
    texts = [
        wrapped, "Head\n\n" + bsd, lgpl, "Released under the MIT License or the Apache License, Version 2.0",
        f"{filler} released under the BSD license {filler} licensed under the Apache License, Version 2.0 {filler}",
        "a\n \t\nAll rights reserved\n\n\nReleased under the MIT License\n",
    ]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).sort("doc_id").collect()
    assert [r["families"] for r in got] == ["MIT", "BSD", "LGPL", "Apache,MIT", "Apache,BSD", "MIT,Proprietary"]
    assert [(r["n_paragraphs"], r["n_licences"]) for r in got] == [(1, 1), (2, 1), (1, 1), (1, 2), (1, 2), (3, 2)]


def test_licence_classifier_decides_and_templates_confirm():
    model = licenses.fit(["some plain words about the weather", "the version of events was released"] * 20)
    named = lambda t, m=model: sorted(licenses.families(licenses.words(t), m, 0.5))
    texts = {
        "licensed under the GNU Lesser General Public License version 3": ["LGPL"],
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": ["CC-BY-NC"],
        "Permission to use, copy, modify, and distribute this software for any purpose is hereby granted": ["ISC"],
        "the general public can use the public library under the terms of the city": [],
        "you may not obtain a copy of the fish except at the river": [],
    }
    assert {t: named(t) for t in texts} == texts

    class Flat:  # the classifier switched off: every family as probable as any other
        def probabilities(self, w):
            return np.full(len(licenses.FAMILIES), 1 / len(licenses.FAMILIES))

    assert sum(named(t, Flat()) != f for t, f in texts.items()) >= 2


def test_licence_sample_is_whole_and_bounded(spark):
    long = "\n\n".join(f"plain words about the weather end{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    rows = [(1, long, "x"), (1, "same id", "x"), (2, None, "x"), (None, "no id", "x"), (3, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    got = licenses.sample_windows(docs)
    assert len(got) == 301 and sum(w.startswith("end") for x in got for w in x.split()) == 300
    assert sorted(licenses.sample_windows(docs.repartition(5), most=7)) == sorted(licenses.sample_windows(docs, most=7))
    assert licenses.sample_windows(docs.limit(0)) == []


def test_licences(docs, empty):
    model = licenses.fit(["some plain words about the weather", "the version of events was released"] * 20)
    lines = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "All rights reserved.", "This work is licensed under the GNU General Public License, version 3.", "All rivers are reserved for fish and the license of poets"]
    spark = docs.sparkSession
    got = licenses.scan(spark.createDataFrame([(i, "plain words\n" + t) for i, t in enumerate(lines)], "doc_id long, text string"), model)
    assert [r["families"] for r in got.orderBy("doc_id").collect()] == ["MIT", "CC-BY-NC", "Proprietary", "GPL", ""]
    assert licenses.scan(docs, model).where("n_licences > 0").count() == 0
    assert licenses.scan(empty, model).count() == 0


def test_toxicity(spark, docs, empty, sf, corpus):
    texts = ["you are a stupid scum"] * 30 + ["the women walked home", "jews and muslims talked", "rain falls on stone"] * 30
    model = toxicity.fit(texts, [1] * 30 + [0] * 90)
    assert model.score("what stupid scum") > 0.5 > model.score("women talked")
    assert abs(model.score("the muslims walked") - model.score("the christians walked")) < 0.01
    scored = toxicity.score_documents(docs, model)
    assert scored.columns == [c for c in docs.columns if c != "score"] + ["score"] and scored.count() == len(EDGE)
    assert scored.where("score is null or score not between 0 and 1").count() == 0
    assert toxicity.score_documents(empty, model).count() == 0
    assert toxicity.fit([], []).score("a") < 0.5
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.scores(corpus, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_line_dedup_edges(docs, empty):
    done = line_dedup.dedup_lines(docs)
    assert done.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in done.collect()}
    assert got[9] == ("own", 3, 2) and got[10] == ("other", 2, 1) and got[11] == ("shared line that is long enough", 1, 0)
    assert got[3] == ("", 1, 0) and got[4] == ("", 1, 0) and got[5] == (" \n\t ", 2, 0)
    assert got[1] == (LONG, 1, 0)  # two documents only: rows of one id are one document
    assert line_dedup.dedup_lines(empty).count() == 0


def test_perfect_hash():
    h = np.random.default_rng(0).integers(-(2**62), 2**62, (5000, 2))
    h[1, 0] = h[0, 0]  # equal first halves
    sizes, bits = line_dedup.build(h)
    ranks = np.cumsum(bits) - bits
    assert sorted(line_dedup.slots(h, sizes, bits, ranks)) == list(range(5000))


PAGE = '<html><head><title>t</title></head><body><div class="cookie-notice">Accept</div><header>Site</header><nav><ul><li>a<li>b</ul></nav>{}<aside>more</aside><footer>f</footer></body></html>'
PAGES = [
    (1, "http://h.org/1", PAGE.format("<article><h1>T &amp; x</h1><p>one<br>two <b>three</b><p>four<div class=comments><p>bad</div></article>"), "T & x\n\none two three\n\nfour"),
    (2, "http://h.org/2", PAGE.format("<article><h1>U</h1><p>five <script>var a='<p>'</script>six</article>"), "U\n\nfive six"),
    (3, "http://g.org/", PAGE.format("<div id=x><p>" + "long words " * 20 + "</p><form>q<input></form><p>end</p></div>"), ("long words " * 20).strip() + "\n\nend"),
    (4, None, None, ""), (5, None, "", ""), (None, "http://h.org/2", PAGE.format("<article><p>cut of"), "cut of"),
]


def test_html(spark):
    df = spark.createDataFrame([(*p[:3], "x") for p in PAGES], "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_wrapper.extract(df).collect()}
    assert got == {i: (t, len(t)) for i, _, _, t in PAGES}
    assert html_wrapper.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("page, text", [
    ("<html><head><meta charset=x><body><div><p>one</p></div>", "one"),
    ("<head><title>t</title>one", "one"),
    ("<form id=f><div><p>one</p><p>two</p></div><nav>x</nav></form>", "one two"),
    ("<body><nav><a>x</a><div><p>one and two</p></div></body>", "x one and two"),
    ("<nav>x</nav><form>q</form><p>one and two</p>", "one and two"),
    ('<article>a<svg class="i"/><p>one</p><svg><text>no</text></svg><iframe src="x" /><p>two</p><template/>b</article>', "a one two b"),
    ("a < b and more", "a < b and more"), ("<article><p>one <di", "one"),
])
def test_html_reads_whole_pages(page, text):
    found = html_wrapper.blocks(page)
    assert " ".join(t for p, t, _ in found if "!" not in p) == text


def _texts(spark, pages):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    return [r["text"] for r in sorted(html_wrapper.extract(df).collect(), key=lambda r: r["page_id"])]


def _story(i):
    return " ".join(hashlib.md5(f"{i} {j}".encode()).hexdigest()[:5] for j in range(20))


class PlainPage(HTMLParser):
    """Text of the article elements of a page, for pages whose furniture has tags or plain class names of its own."""

    def __init__(self, page):
        super().__init__()
        self.blocks, self.now, self.open = [], "", []
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        if " ".join(self.now.split()):
            self.blocks.append(" ".join(self.now.split()))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.now += " "
        elif tag not in ("b", "a", "i", "em", "strong", "span", "code"):
            self.flush()
            if tag not in ("p", "li", "img", "hr", "input", "meta", "link"):
                bad = tag in ("nav", "aside", "footer", "form", "script", "style", "head") or dict(attrs).get("class") in ("ad", "comments", "cookie", "share", "related")
                self.open.append((tag, bad))

    def handle_endtag(self, tag):
        if tag in ("p", "li"):
            self.flush()
        elif any(t == tag for t, _ in self.open):
            self.flush()
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.open) and not any(bad for _, bad in self.open):
            self.now += data


def test_html_equals_plain_rendition(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r["page_id"]: "\n\n".join(PlainPage(r["html"] or "").blocks) for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract(pages).collect()}
    assert len(got) > 10 and got == want


def test_html_keeps_all_of_an_article(spark):
    inside = "<h2>Summary</h2><p>{}</p><p>Our reporters checked this story with two sources.</p><div class=x>More of us</div>"
    story = lambda i: f"Summary\n\n{_story(i)}\n\nOur reporters checked this story with two sources."
    notice = "<div class=c12><h4>We value</h4><p>your privacy</p></div>"
    pages = [(f"http://a.org/{i}", f"<body>{notice}<article><h1>T{i}</h1>{inside.format(_story(i))}</article>{notice}</body>") for i in range(40)]
    pages += [(f"http://m.org/{i}", f"<body><main><h1>T{i}</h1>{inside.format(_story(i + 50))}{notice}</main></body>") for i in range(20)]
    pages += [(f"http://p.org/{i}", f"<body>{notice}<div class=t><h1>T{i}</h1>{inside.format(_story(i + 80))}</div></body>") for i in range(20)]
    got = _texts(spark, pages)
    assert got[:40] == [f"T{i}\n\n{story(i)}\n\nMore of us" for i in range(40)]
    # outside articles, elements that hold nothing of the page's own go as a whole; headings and paragraphs beside others stay
    assert got[40:] == [f"T{i}\n\n{story(i + 50)}" for i in range(20)] + [f"T{i}\n\n{story(i + 80)}" for i in range(20)]
    # without the host's other pages nothing is known of the notice
    assert _texts(spark, pages[40:41]) == [f"T0\n\n{story(50)}\n\nMore of us\n\nWe value\n\nyour privacy"]


@pytest.mark.parametrize("depth", [10, 59, 60, 61, 300, 5000])
def test_html_deep_and_long_pages(depth):
    around = "<div>" * depth + "{}" + "</div>" * depth
    page = "menu " + around.format("<nav><p>x</p></nav><article><header><h1>t</h1></header><p>one</p><aside>no</aside>" + "<p>two</p>" * 3000 + "</article>plain")
    found = html_wrapper.blocks(page)
    assert [t for p, t, _ in found if html_wrapper.kind(p) == "article"] == ["t", "one"] + ["two"] * 3000
    assert [t for p, t, _ in found if html_wrapper.kind(p) == "furniture"] == ["x", "no"]
    assert html_wrapper.HostWrapper().text(found).startswith("t\n\none\n\ntwo")


def test_html_template_texts_are_left_out(spark):
    box = '<div class=c12>We value your privacy</div><div class=c3><a href=x>One</a> <a href=y>Two</a></div>'
    pages = [(f"http://h.org/{i}", f"<body><main><p>{_story(i)}</p>{box}</main></body>") for i in range(12)]
    pages += [(f"http://h.org/p{i}", f"<body><div><div><p>{_story(i + 50)}</p>{box}</div></div></body>") for i in range(12)]
    pages += [(f"http://copies.org/{i}", f"<main><p>{_story(99)}</p>{box}</main>") for i in range(12)]
    pages += [("http://h.org/none", f"<body><main>{box}</main></body>")]
    got = _texts(spark, pages)
    assert got[:24] == [_story(i) for i in range(12)] + [_story(i + 50) for i in range(12)]
    assert got[24:] == [_story(99) + "\n\nWe value your privacy\n\nOne Two"] * 12 + ["We value your privacy\n\nOne Two"]


def test_html_without_article_keeps_siblings(spark):
    links = "".join(f"<li><a href={j}>some other story {j}</a></li>" for j in range(4))
    pages = [(f"http://h.org/{i}", f"<body><h1>Title {i}</h1><p>Lead {i}</p><div class=text><p>{_story(i)}</p><p><a href=x>see {i}</a></p></div><div class=b>box {i}</div><ul>{links}{i}</ul></body>") for i in range(2)]
    pages += [("http://one.org/", "<body><h1>Title</h1><p>Lead</p><div class=text>" + _story(7) + "</div></body>")]
    got = _texts(spark, pages)
    assert got == [f"Title {i}\n\nLead {i}\n\n{_story(i)}\n\nsee {i}\n\nbox {i}\n\n{i}" for i in range(2)] + [f"Title\n\nLead\n\n{_story(7)}"]


def test_wrapper_of_a_host_is_bounded(spark):
    pages = [(f"http://h.org/{i}", f'<div class="post-{i}"><h1>t{i}</h1><p>text {i}</p></div><div id="u{i:06x}f{i}"><p>c</p></div><div class="{chr(97 + i % 26)}{chr(97 + i // 26)}">r</div>') for i in range(300)]
    df = spark.createDataFrame(pages, "url string, text string").select("url", F.col("text").cast("binary")).repartition(7)
    got = html_wrapper.infer(df).collect()
    assert len(got) == 1 and got[0]["wrapper"].count("div.post-#") == 1 and len(got[0]["wrapper"]) < 200
    assert html_wrapper.plain_name("comment-77") == html_wrapper.plain_name("comment-8") != html_wrapper.plain_name("post-8")


def test_wrapper_has_optional_and_repeated_groups():
    trees = [html_wrapper.page_tree(html_wrapper.blocks(f"<div><h1>a</h1>{p}</div>")) for p in ("<p>b</p>", "<p>b</p><p>c</p><ul><li>x</ul>")]
    assert html_wrapper.expression(html_wrapper.merge(*trees)) == "<div> <h1> # (<p> #)+ (<ul> <li> #)?"


def test_packing(docs, empty):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = packing.pack_documents(docs, RANKS, limit=64, group_docs=5, keep_ids=True)
    rows = packed.collect()
    used = {}
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    want = Counter()
    for i, t in EDGE:
        want[i] += len(library.encode(t or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += r["length"]
    assert got == want
    whole = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in sorted((r for r in rows if r["doc_id"] == 8), key=lambda r: r["start"])])
    assert whole.tolist() == library.encode(dict(EDGE)[8], add_special_tokens=False).ids + [0]
    assert packing.pack_documents(empty, RANKS).count() == 0
    for r in packing.sequences(packed, 64).collect():
        n = r["n_tokens"]
        assert len(r["ids"]) == 4 * (n if n & (n - 1) == 0 else 64)


def test_first_fit_decreasing_equals_plain_search():
    lengths = np.random.default_rng(3).integers(1, 100, 300)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    room: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        at = next((j for j, r in enumerate(room) if r >= lengths[i]), len(room))
        if at == len(room):
            room.append(100)
        assert (bins[i], offsets[i]) == (at, 100 - room[at])
        room[at] -= lengths[i]


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    source = spark.read.parquet(f"{sf}/documents.parquet")
    docs = source
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == source.columns, name
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == ids
