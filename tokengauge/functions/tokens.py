"""Token counts under named vocabularies: the one place where text leaves the JVM.

One Arrow UDF counts under all requested vocabularies, so a text crosses to
Python once. Vocabularies load once per Python worker; special tokens are never
added, and their spelling inside a text counts as ordinary text. Where no token reaches
across a space, a text is the sum of its words, and a worker tokenizes a word once.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Split applied before the merges of a rank file (fixed value).
PRE_SPLIT = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer on disk. ``kind`` is ``ranks``, ``json`` or ``sentencepiece``."""

    name: str
    kind: str
    path: str
    pattern: str = PRE_SPLIT

    def resolve(self) -> str | None:
        """The file on this machine: its own path, or the copy shipped with the job."""
        if os.path.exists(self.path):
            return self.path
        shipped = SparkFiles.get(os.path.basename(self.path))
        return shipped if os.path.exists(shipped) else None


def default_vocabularies() -> dict[str, Vocabulary]:
    """Vocabularies of the ``public_tokenizers`` package, by name."""
    import public_tokenizers

    files = {
        "byte_bpe_50k": ("ranks", "byte_bpe_50k.tiktoken"),
        "byte_bpe_multi_50k": ("ranks", "byte_bpe_multi_50k.tiktoken"),
        "word_bpe_49k": ("json", "word_bpe_49k.json"),
        "piece_bpe_32k": ("sentencepiece", "piece_bpe_32k.model"),
    }
    return {n: Vocabulary(n, k, public_tokenizers.path(f)) for n, (k, f) in files.items()}


def ship(spark: SparkSession, vocabularies: Mapping[str, Vocabulary]) -> None:
    """Send vocabulary files to every executor (for clusters that lack them)."""
    for v in vocabularies.values():
        spark.sparkContext.addFile(v.path)


#: Characters of text that a tokenizer gets at once, about; a longer single text goes alone or with the few before it.
PIECE_CHARS = 4 << 20

_loaded: dict[Vocabulary, Callable[[list[str]], list[int]]] = {}

#: Words a worker keeps at most, whatever the corpus; a full table keeps what came again. Longer words are not kept.
WORDS_KEPT, LONGEST_WORD = 600_000, 100
#: Text that normalization leaves alone but for its case, and the pieces that a separable ``json`` vocabulary then splits it into.
_PLAIN = re.compile("[\\t\\n\\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^ \\t\\n\\ra-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: How a byte-level vocabulary writes the other bytes.
_OTHERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def _by_piece(model, whole: Callable[[list[str]], list[int]]) -> Callable[[list[str]], list[int]]:
    """Counts of texts from the merges of their pieces, kept by piece; texts that need normalization go through the tokenizer."""
    kept: dict[str, int] = {}

    def merged(piece: str) -> int:
        n = len(model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(_OTHERS)))
        if len(kept) >= WORDS_KEPT:
            kept.clear()
        if len(piece) <= LONGEST_WORD:
            kept[piece] = n
        return n

    def count(texts: list[str]) -> list[int]:
        out, odd = [], []
        for i, text in enumerate(texts):
            if _PLAIN.fullmatch(text):
                out.append(sum(kept.get(p) or merged(p) for p in _PIECES.findall(text.lower())))
            else:
                out.append(0)
                odd.append(i)
        if odd:
            for i, n in zip(odd, whole([texts[i] for i in odd])):
                out[i] = n
        return out

    return count


def _load(v: Vocabulary) -> Callable[[list[str]], list[int]]:
    path = v.resolve()
    if path is None:
        raise FileNotFoundError(f"vocabulary {v.name}: {v.path}")
    if v.kind == "ranks":
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f)}
        enc = tiktoken.Encoding(v.name, pat_str=v.pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    if v.kind == "json":
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        whole = lambda texts: [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        return _by_piece(tok.model, whole) if separable(v) else whole
    if v.kind == "sentencepiece":
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in sp.encode(texts, num_threads=1)]
    raise ValueError(f"unknown vocabulary kind {v.kind!r}")


def _counter(v: Vocabulary) -> Callable[[list[str]], list[int]]:
    if v not in _loaded:
        _loaded[v] = _load(v)
    return _loaded[v]


# --- counting by word: most words of a corpus come again, and their counts are kept -------------------------

#: A space between two characters that nobody takes for white space. No token of a separable vocabulary reaches across.
_SPLIT = re.compile("(?<=[^\\s\u180e\u200b\u2060\ufeff\u2581]) (?=[^\\s\u180e\u200b\u2060\ufeff\u2581])")
#: What a ``json`` vocabulary does before its merges if white space only separates words: no token holds any.
_WORD_NORMALIZERS = (
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
)
_WORD_SPLIT = {
    "type": "Split",
    "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
    "behavior": "Removed",
    "invert": True,
}


def separable(v: Vocabulary) -> bool:
    """Whether the count of a text is the sum of the counts of its parts, cut where ``_SPLIT`` says.

    Told from the file, not from trials: the known splitting rule of rank files; words without white space; pieces
    that hold white space at their beginning only. Any other vocabulary gets whole texts.
    """
    if v.kind == "ranks":  # the space goes with the word after it
        return v.pattern == PRE_SPLIT
    if v.kind == "json":
        with open(v.resolve(), encoding="utf-8") as f:
            rules = json.load(f)
        normalizer, split = rules.get("normalizer") or {}, rules.get("pre_tokenizer") or {}
        return (
            rules.get("truncation") is None
            and rules.get("padding") is None
            and all(t.get("special") for t in rules.get("added_tokens") or [])
            and rules["model"].get("type") == "BPE"
            and rules["model"].get("dropout") is None
            and normalizer.get("type") == "Sequence"
            and all(n in _WORD_NORMALIZERS for n in normalizer["normalizers"])
            and split.get("type") == "Sequence"
            and split["pretokenizers"][0] == _WORD_SPLIT
            and all(s.get("type") == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in split["pretokenizers"][1:])
        )
    if v.kind == "sentencepiece":  # the space before a word is the prefix that every text gets
        try:
            from sentencepiece import sentencepiece_model_pb2
        except ImportError:
            return False
        model = sentencepiece_model_pb2.ModelProto()
        with open(v.resolve(), "rb") as f:
            model.ParseFromString(f.read())
        trainer, normal = model.trainer_spec, model.normalizer_spec
        return (
            trainer.model_type == trainer.BPE
            and trainer.byte_fallback
            and not trainer.treat_whitespace_as_suffix
            and not normal.precompiled_charsmap
            and not normal.normalization_rule_tsv
            and normal.add_dummy_prefix
            and not normal.remove_extra_whitespaces
            and normal.escape_whitespaces
            and all(p.type != p.USER_DEFINED and p.type != p.UNUSED and "\u2581" not in p.piece.lstrip("\u2581") for p in model.pieces)
        )
    return False


class WordCounts:
    """Counts of texts under separable vocabularies, word by word; a distinct word is tokenized once while it is kept."""

    def __init__(self, vocabularies: Sequence[Vocabulary]):
        self.vocabularies = list(vocabularies)
        self._clear(WORDS_KEPT)

    def _clear(self, size: int) -> None:
        self.at: dict[str, int] = {}
        self.used = 0
        self.hits = np.zeros(size, np.int64)
        self.counts = np.zeros((size, len(self.vocabularies)), np.int64)

    def _make_room(self, keys: set[str]) -> set[str]:
        """Keep words that came again, at most half a table of them; what is now unknown of ``keys``."""
        again = [(w, i) for w, i in self.at.items() if self.hits[i] > 1][: WORDS_KEPT // 2]
        rows, old = np.array([i for _, i in again], np.int64), (self.counts, self.hits)
        new = keys.difference(w for w, _ in again)
        self._clear(max(WORDS_KEPT, len(again) + len(new)))
        self.at = {w: i for i, (w, _) in enumerate(again)}
        self.used = len(again)
        self.counts[: self.used], self.hits[: self.used] = old[0][rows], old[1][rows] // 2
        return new

    def _learn(self, keys: set[str]) -> list[str]:
        """Tokenize the words of ``keys`` that are not known, and return them."""
        unknown = keys.difference(self.at)
        if self.used + len(unknown) > len(self.counts):
            unknown = self._make_room(keys)
        new = list(unknown)
        if new:
            # a key that begins with a space is the beginning of a text, without that space
            plain = [w.removeprefix(" ") for w in new]
            spaced = [w[1:] if w[0] == " " else " " + w for w in new]
            rows = slice(self.used, self.used + len(new))
            for i, v in enumerate(self.vocabularies):
                self.counts[rows, i] = _counter(v)(spaced if v.kind == "ranks" else plain)
            self.at.update(zip(new, range(rows.start, rows.stop)))
            self.used = rows.stop
        return new

    def _sums(self, parts: list[tuple[str, bool]]) -> np.ndarray:
        """Counts of parts of texts; the flag says that a part begins its text."""
        keys: list[str] = []
        starts = []
        for part, first in parts:
            starts.append(len(keys))
            words = _SPLIT.split(part)
            if first:
                words[0] = " " + words[0]
            keys += words
        new = self._learn(set(keys))
        rows = np.fromiter(map(self.at.__getitem__, keys), np.int64, len(keys))
        self.hits += np.bincount(rows, minlength=len(self.hits))
        for w in new:
            if len(w) > LONGEST_WORD:
                del self.at[w]
        return np.add.reduceat(self.counts[rows], starts, axis=0)

    def count(self, texts: Sequence[str | None]) -> np.ndarray:
        """One row per text, one column per vocabulary; null and empty texts count 0."""
        out = np.zeros((len(texts), len(self.vocabularies)), np.int64)
        parts: list[tuple[str, bool]] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if parts:
                np.add.at(out, owners, self._sums(parts))
            parts.clear(), owners.clear()
            size = 0

        for i, text in enumerate(texts):
            start = 0
            while text and start < len(text):  # a long text is cut between words
                cut = _SPLIT.search(text, start + PIECE_CHARS) if len(text) - start > PIECE_CHARS else None
                end = cut.start() if cut else len(text)
                parts.append((text[start:end], start == 0))
                owners.append(i)
                size += end - start
                start = cut.end() if cut else end
                if size >= PIECE_CHARS:
                    flush()
        flush()
        return out


_by_word: dict[tuple[Vocabulary, ...], tuple[list[Vocabulary], WordCounts]] = {}


def count_batch(texts: pd.Series, vocabularies: Sequence[Vocabulary]) -> list[np.ndarray]:
    """Counts of a batch, one array per vocabulary: by word where that is the same, else by whole texts."""
    key = tuple(vocabularies)
    if key not in _by_word:
        apart = [v for v in key if separable(v)]
        _by_word[key] = apart, WordCounts(apart)
    apart, words = _by_word[key]
    found = dict(zip(apart, words.count([t if isinstance(t, str) else None for t in texts]).T)) if apart else {}
    whole = [v for v in key if v not in found]
    if whole:
        # long texts go to the tokenizers a few at a time, whatever the Arrow batch holds
        piece = texts.str.len().fillna(0).cumsum().to_numpy() // PIECE_CHARS
        pieces = [p for _, p in texts.groupby(piece)] or [texts]
        found |= {v: np.concatenate([_count(p, v).to_numpy() for p in pieces]) for v in whole}
    return [found[v] for v in key]


def _count(texts: pd.Series, v: Vocabulary) -> pd.Series:
    """Counts of one batch of whole texts; null and empty texts count 0."""
    counts = pd.Series(0, index=texts.index, dtype="int64")
    filled = texts.notna() & (texts != "")
    if filled.any():
        counts[filled] = _counter(v)(texts[filled].tolist())
    return counts


def add_token_counts(
    df: DataFrame,
    vocabularies: Mapping[str, Vocabulary] | None = None,
    content: str = "content",
    missing: str = "error",
) -> DataFrame:
    """Append one ``bigint`` count column per vocabulary (its key is the column name).

    ``missing`` says what to do with a vocabulary whose file is not found:
    ``error`` stops, ``zero`` fills the column with 0, ``skip`` leaves it out.
    """
    vocabularies = default_vocabularies() if vocabularies is None else dict(vocabularies)
    absent = [] if missing == "error" else [n for n, v in vocabularies.items() if v.resolve() is None]
    found = {n: v for n, v in vocabularies.items() if n not in absent}
    if missing == "error":
        for v in found.values():
            if v.resolve() is None:
                raise FileNotFoundError(f"vocabulary {v.name}: {v.path}")
    kept = df.columns
    if found:
        names, specs = list(found), list(found.values())

        @F.pandas_udf(", ".join(f"`{n}` bigint" for n in names))
        def count_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                yield pd.DataFrame(dict(zip(names, count_batch(texts, specs))), index=texts.index)

        df = df.withColumn("__tokens", count_tokens(F.col(content).cast("string")))
    columns = [F.col(c) for c in kept]
    for name in vocabularies:
        if name in found:
            columns.append(F.col(f"__tokens.`{name}`").alias(name))
        elif missing == "zero":
            columns.append(F.lit(0).cast("bigint").alias(name))
    return df.select(*columns)
