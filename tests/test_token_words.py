"""Counting by word: the same counts as whole texts, and a word that comes again is not tokenized again."""

import random

import pandas as pd
import pytest

from tests.test_tokens import expected
from tokengauge.functions import tokens
from tokengauge.functions.tokens import Vocabulary, WordCounts, count_batch, default_vocabularies, separable

ODD = [
    " ", "  ", "\n", "\n ", "\t  b", "  x", "a ́b", "▁ a", "a ▁", "ᄀ ᅡ", "Σ İ", "x\x1c y", "don't WON'T 's",
    "café CAFÉ 12 3.5", "<|endoftext|> </s> <0x0A>", "漢字 \U0001f600 ​ z", " lead", "trail ", "a  b   c", "\x00 a", "ﬁ ①",
]


def texts():
    draw = random.Random(5)
    parts = [*ODD, "the", "quick", "fox,", "jumps.", "\nOver", "42", "'ll", " ", " ", " "]
    return [None, "", *ODD, *["".join(draw.choices(parts, k=draw.randint(1, 30))) for _ in range(300)], " ".join(draw.choices(parts, k=5000))]


@pytest.mark.parametrize("piece, kept", [(1 << 22, 600_000), (40, 50)])  # long texts cut, tables that overflow
def test_same_as_whole_texts(monkeypatch, piece, kept):
    monkeypatch.setattr(tokens, "PIECE_CHARS", piece)
    monkeypatch.setattr(tokens, "WORDS_KEPT", kept)
    monkeypatch.setattr(tokens, "_by_word", {})
    monkeypatch.setattr(tokens, "_loaded", {})
    found = default_vocabularies()
    assert all(separable(v) for v in found.values())
    rows = texts()
    for (name, v), got in zip(found.items(), count_batch(pd.Series(rows, dtype=object), list(found.values()))):
        whole = {t: expected(name, t) for t in rows[:60] + rows[-1:]}
        assert [int(n) for t, n in zip(rows, got) if t in whole] == [whole[t] for t in rows if t in whole], name


def test_a_word_is_tokenized_once(monkeypatch):
    v = default_vocabularies()["word_bpe_49k"]
    asked = []
    real = tokens._counter(v)
    monkeypatch.setitem(tokens._loaded, v, lambda batch: asked.extend(batch) or real(batch))
    words = WordCounts([v])
    assert words.count(["one two two", "two one"] * 50).sum() == 250
    words.count(["two two two"])
    assert asked.count("two") <= 2 and len(asked) <= 4  # as a beginning and within, not 152 times


def test_other_vocabularies_get_whole_texts():
    first = default_vocabularies()["byte_bpe_50k"]
    other = Vocabulary("other", "ranks", first.path, r"\s+|\S+")
    assert not separable(other)
    import public_tokenizers

    assert not separable(Vocabulary("gaps", "json", public_tokenizers.path("byte_bpe_50k.json")))
    row = pd.Series(["a b  c", None, ""], dtype=object)
    assert count_batch(row, [other, first])[0].tolist() == [tokens._counter(other)(["a b  c"])[0], 0, 0]
