"""Licence scans: a paragraph classifier over word n-grams with an unknown class, confirmed by comparison with templates.

A multinomial logistic regression is trained on the statements below, varied by leaving out, adding and cutting words, against paragraphs of
the corpus and shuffled licence words as the unknown class; a temperature fitted on held-out variants calibrates it.
Paragraphs end at blank lines and are read in overlapping windows. The classifier ranks the families of a window: the most probable one that is more probable
than unknown is reported if a template confirms it, that is, if most of one of its statements is found again; what its statements explain is then
taken out and the rest is judged anew, so that a window reports all families it names. Templates alone cannot tell families whose
statements share most of their words; they keep out what merely sounds like a licence.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes
from .toxicity import Sparse

# Short statements by which texts name their licence.
STATEMENTS = {
    "MIT": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "Apache": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache org licenses"],
    "GPL": ["this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"],
    "LGPL": ["licensed under the gnu lesser general public license", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"],
    "AGPL": ["licensed under the gnu affero general public license", "under the terms of the gnu affero general public license as published by the free software foundation"],
    "BSD": ["released under the bsd license", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "MPL": ["this source code form is subject to the terms of the mozilla public license", "licensed under the mozilla public license version 2 0"],
    "ISC": ["released under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "CC-BY": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "CC-BY-SA": ["licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license"],
    "CC-BY-NC": ["licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "CC-BY-ND": ["licensed under cc by nd 4 0", "licensed under a creative commons attribution noderivatives 4 0 international license"],
    "Public-Domain": ["dedicated to the public domain under cc0", "this is free and unencumbered software released into the public domain"],
    "Proprietary": ["all rights reserved", "no part of this publication may be reproduced or distributed without the prior written permission of the publisher"],
}
FAMILIES = [*STATEMENTS, "unknown"]
# Ways to begin a statement, put before training variants of any family.
OPENINGS = ["this work is", "this program is", "this file is", "the source code is", "this software is distributed and", "the data are made available and"]
#: Words that alone say nothing about a licence.
COMMON = frozenset("a an and any as at be by for from in is it may no not of on one or that the this to under with you your without all part any must than was are they or".split())
BITS = 18
#: Words of a window, and from one window to the next; a statement is shorter than what two windows share.
WINDOW, STEP = 64, 32
#: Share of a statement's word pairs that confirms the classifier.
CONFIRM = 0.6
_BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_WORD = re.compile(r"[^\W\d_]+|\d+")
UNKNOWN = len(FAMILIES) - 1


def words(paragraph: str) -> list[str]:
    """Lower-case words; a number counts as one word, 0."""
    return ["0" if w[0].isdigit() else w for w in _WORD.findall(paragraph.lower())]


def ngrams(w: list[str]) -> list[str]:
    return [x for x in w if x not in COMMON and x != "0"] + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)] + [f"{a} {b} {c}" for a, b, c in zip(w, w[1:], w[2:], strict=False)]


_TEMPLATES = {family: [words(s) for s in statements] for family, statements in STATEMENTS.items()}
#: n-grams of the statements: all that the classifier looks at. Words of a paragraph are tested against the single ones first.
VOCABULARY = {g: i for i, g in enumerate(sorted({g for t in _TEMPLATES.values() for w in t for g in ngrams(w)}))}
#: Words that only the statements of one family have.
_OWN = {f: {x for w in t for x in w} - {x for g, u in _TEMPLATES.items() if g != f for w in u for x in w} for f, t in _TEMPLATES.items()}
_TELLING = frozenset(g for g in VOCABULARY if " " not in g)


def _row(w: list[str]) -> dict[int, float]:
    return {VOCABULARY[g]: 1.0 for g in ngrams(w) if g in VOCABULARY}


class Model:
    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.weights, self.bias, self.temperature = weights, bias, temperature

    def probabilities(self, w: list[str]) -> np.ndarray:
        z = (self.bias + self.weights[list(_row(w))].sum(0)) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def share(family: str, w: list[str]) -> float:
    """The largest share of a statement's word pairs that the paragraph has; a statement of up to four words counts whole or not at
    all, and one with words that no other family's statements have needs half of these."""
    own, seen = set(zip(w, w[1:], strict=False)), set(w)
    shares = [0.0]
    for t in _TEMPLATES.get(family, ()):
        pairs, telling = set(zip(t, t[1:], strict=False)), _OWN[family].intersection(t)
        found = len(pairs & own) / len(pairs)
        shares.append(found if (len(t) > 4 or found == 1) and 2 * len(telling & seen) >= len(telling) else 0.0)
    return max(shares)


def confirmed(family: str, w: list[str], least: float = CONFIRM) -> bool:
    """One of the family's statements is in the paragraph: at least this share of its word pairs (all pairs of a statement of up to four words)."""
    return share(family, w) >= least


def families(w: list[str], model: Model, least: float) -> dict[str, float]:
    """Families that a window names, with their probabilities against unknown. The most probable confirmed family goes first, and the words
    that its statements explain together with both neighbours are taken out. After the first, at least half of a statement must be in what is left."""
    found: dict[str, float] = {}
    left = list(w)
    while not _TELLING.isdisjoint(left):
        p = model.probabilities(left)
        rest = 0.5 if found else CONFIRM
        for i in np.argsort(-p[:UNKNOWN], kind="stable"):
            family, chance = FAMILIES[i], float(p[i] / (p[i] + p[UNKNOWN]))
            if chance < least:
                return found
            if family not in found and share(family, left) >= rest and confirmed(family, w):
                break
        else:
            return found
        found[family] = chance
        own = {x for t in _TEMPLATES[family] for x in zip(t, t[1:], strict=False)}
        explained = [x in own for x in zip(left, left[1:], strict=False)]
        left = ["" if any(explained[max(0, i - 1) : i + 1]) and all(explained[max(0, i - 1) : i + 1]) else x for i, x in enumerate(left)]
    return found


def windows(w: list[str]) -> list[list[str]]:
    return [w[i : i + WINDOW] for i in range(0, max(1, len(w) - STEP), STEP)]


def variants(rng: np.random.Generator, filler: list[str], each: int) -> list[tuple[list[str], int]]:
    """Training paragraphs: statements with words lost, cut at the ends or begun in another way, filler around them, and licence words
    without order as unknown."""
    telling = sorted(_TELLING)
    openings = [words(x) for x in OPENINGS]
    out: list[tuple[list[str], int]] = []
    around = lambda: [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, 12))]
    for label, family in enumerate(STATEMENTS):
        for t in _TEMPLATES[family]:
            for i in range(each):
                kept = [w for w in t if i == 0 or len(t) <= 5 or rng.random() > 0.08]
                if i % 3 == 1 and len(t) > 5 and _OWN[family].intersection(kept) <= set(kept[: 1 + len(kept) * 2 // 3]):
                    kept = kept[: 1 + len(kept) * 2 // 3]
                elif i % 3 == 2 and len(t) > 5:
                    kept = openings[i // 3 % len(openings)] + kept[kept.index("licensed") if "licensed" in kept[:4] else 0 :]
                out.append(((around() if i else []) + kept + (around() if i else []), label))
    for _ in range(each * len(STATEMENTS)):
        loose = [telling[i] for i in rng.integers(0, len(telling), rng.integers(1, 5))]
        mixed = loose + around()
        out.append(([mixed[i] for i in rng.permutation(len(mixed))], UNKNOWN))
    return out


def _loss(z: np.ndarray, y: np.ndarray, t: float) -> float:
    z = z / t
    top = z.max(1)
    return float((np.log(np.exp(z - top[:, None]).sum(1)) + top - z[np.arange(len(y)), y]).mean())


def fit(plain: list[str], each: int = 60, ridge: float = 0.05, rounds: int = 300, seed: int = 3) -> Model:
    """Train on variants of the statements and on ``plain`` windows of the corpus that hold no statement (unknown)."""
    rng = np.random.default_rng(seed)
    own = [w for w in map(words, plain) if w and not any(confirmed(f, w, 0.5) for f in STATEMENTS)]
    filler = [w for p in own for w in p] or ["lorem", "ipsum"]
    rows = variants(rng, filler, each) + [(w, UNKNOWN) for w in own]
    held = rng.random(len(rows)) < 0.2

    def table(which: np.ndarray) -> tuple[Sparse, np.ndarray]:
        picked = [rows[i] for i in np.flatnonzero(which)]
        maps = [_row(w) for w, _ in picked]
        return Sparse([np.array(list(m), np.int64) for m in maps], [np.array(list(m.values()), float) for m in maps]), np.array([y for _, y in picked])

    def scores(s: Sparse, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.stack([s.times(w[:, k]) for k in range(len(FAMILIES))], 1) + b

    x, y = table(~held)
    size, kinds, n = len(VOCABULARY), len(FAMILIES), len(y)
    step = 1 / (x.back(0.5 * np.bincount(x.row, x.val, minlength=n), size, absolute=True) + ridge + 0.5)
    w, v, b = np.zeros((size, kinds)), np.zeros((size, kinds)), np.zeros(kinds)
    b[UNKNOWN] = 2.0
    target = np.eye(kinds)[y]
    for i in range(rounds):
        momentum = i / (i + 3)
        at = w + momentum * v
        z = scores(x, at, b)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        error = p - target
        grad = np.stack([x.back(error[:, k], size) for k in range(kinds)], 1) + ridge * at
        new = at - step[:, None] * grad
        b -= error.mean(0)
        v, w = new - w, new
    hx, hy = table(held)
    z = scores(hx, w, b)
    grid = np.geomspace(0.25, 4, 33)
    best = grid[int(np.argmin([_loss(z, hy, t) for t in grid]))] if len(hy) else 1.0
    return Model(w, b, float(best))


def sample_windows(docs: DataFrame, documents: int = 1000, most: int = 10_000) -> list[str]:
    """Windows to train on: of the texts whose ids come first in the order of a hash, at most ``documents`` ids, all windows of
    all paragraphs are read, and the first ``most`` of them in the order of a hash are taken. Only ids and then
    single windows are sorted, so tasks and the driver hold bounded rows. Rows without an id or a text are not sampled."""
    told = docs.where("text is not null and doc_id is not null")
    ids = told.select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().orderBy("h", "doc_id").limit(documents).select("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                paragraphs = map(words, _BLANK.split(text.decode("utf-8", "replace").replace("\r\n", "\n")))
                parts = [" ".join(part) for w in paragraphs if w for part in windows(w)]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string())], names=["part"])

    texts = told.join(F.broadcast(ids), "doc_id", "left_semi").select(text_bytes())
    parts = texts.mapInArrow(run, "part string").orderBy(F.xxhash64("part"), "part").limit(most)
    return parts.toArrow().column("part").to_pylist()


def scan(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_paragraphs, n_licences, families (sorted, joined by commas), top_family,
    top_probability of its surest paragraph.

    Paragraphs end at blank lines; ``n_licences`` counts the families that each of them names. A null or empty text has none; without a licence the family is unknown and the
    probability is that of unknown for a paragraph without licence words. Repeated rows give equal results; other columns are not read.
    """
    telling = _TELLING
    calm = float(model.probabilities([])[UNKNOWN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                paragraphs = [x for x in _BLANK.split(text.decode("utf-8", "replace").replace("\r\n", "\n")) if x.strip()]
                found: dict[str, float] = {}
                n = 0
                for paragraph in paragraphs:
                    w = words(paragraph)
                    if telling.isdisjoint(w):
                        continue
                    named: dict[str, float] = {}
                    for part in windows(w):
                        for family, p in families(part, model, least).items():
                            named[family] = max(named.get(family, 0.0), p)
                    n += len(named)
                    for family, p in named.items():
                        found[family] = max(found.get(family, 0.0), p)
                top = max(sorted(found), key=found.get) if found else "unknown"
                rows.append((len(paragraphs), n, ",".join(sorted(found)), top, found.get(top, calm)))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_paragraphs", "n_licences", "families", "top_family", "top_probability"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text_bytes()).mapInArrow(run, f"doc_id {kind}, n_paragraphs long, n_licences long, families string, top_family string, top_probability double")


def scan_documents(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    return scan(docs, fit(sample_windows(docs)))
