"""Quality rules as weak supervision, with DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0). Some know only junk, some only clean text, and some look at evidence of their
own (function words, line ends, line and sentence lengths, vowels) and vote either way, so rules overlap and contradict each other. Votes
of all documents are counted by pattern (at most three to the power of the number of rules, whatever the corpus);
expectation-maximisation over that small table estimates the share of good documents and, for each rule, how often it casts each vote
on good and on bad documents. The ratio of the two is the vote's weight: a rule that votes alike on both weighs nothing. A document's posterior
probability of being good follows from its votes, so a bad vote can be overruled and no rule is a veto.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import without

#: The six ASCII white-space characters; inside a character class.
GAPS = r"\x20\x09-\x0D"
SYMBOLS = r"#*$%&|<>"
#: Words of a window that counts as repeated.
WINDOW = 8
#: Up to here the variety of a text is its share of distinct words.
VARIETY_WORDS = 2000

#: The first eight vote bad or abstain, the next two vote good or abstain, the others vote either way.
RULES = [
    "symbols", "dup_lines", "repeats", "capitals", "word_length", "letters", "variety", "marks", "prose", "flow",
    "function_words", "line_ends", "line_length", "sentences", "vowels",
]

# Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = (
    "the of and to in a is that for it was on are as with this by from "
    "le la les de des du et un une en que qui est dans pour pas "
    "der die das und zu den mit von ist nicht ein eine auf dem "
    "el los las y por con para es no del se"
).split()


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


#: Belief before any votes are seen: the chance that a vote is right, and the share of good documents.
START, BALANCE = 0.8, 0.5
MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_letters", "n_marks", "n_distinct",
    "n_function", "n_ended", "n_sentences", "n_vowels",
]
_OWN = ["__t", "__w", "__l", "__h1", "__h2", "__h4", "__h", "__s", "__p", "__repeat", "__m", "__votes"]


def _none() -> Column:
    return F.array().cast("array<long>")


def _joined(hashes: str, step: int) -> Column:
    """Hash of element i together with element i + step."""
    n = F.size(hashes)
    both = F.zip_with(F.slice(hashes, 1, n - step), F.slice(hashes, step + 1, n - step), lambda a, b: F.xxhash64(a, b))
    return F.when(n > step, both).otherwise(_none())


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__m``, the counts that rules look at. Windows are compared by a 64-bit hash of their words."""
    docs = without(docs, _OWN)
    w, h, s, p = (F.col(x) for x in ("__w", "__h", "__s", "__p"))
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.withColumns({
        "__t": text,
        "__w": F.filter(F.split(text, f"[{GAPS}]+"), lambda x: x != ""),
        "__l": F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{GAPS}]")),
    })
    # Hashes of 2, 4 and 8 consecutive words, each from two of half the length. Windows of eight are only built
    # for texts in which four consecutive words occur twice.
    hashed = (
        split.withColumn("__h1", F.transform(w, lambda x: F.xxhash64(x)))
        .withColumn("__h2", _joined("__h1", 1))
        .withColumn("__h4", _joined("__h2", 2))
        .withColumn("__h", F.when(F.size(F.array_distinct("__h4")) < F.size("__h4"), _joined("__h4", 4)).otherwise(_none()))
    )
    # Starts of windows that occur twice or more, in order; the words they cover are counted by the gaps between starts.
    by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    same = lambda e, k: F.coalesce(F.get(s, k)["x"] == e["x"], F.lit(False))
    starts = F.sort_array(
        F.filter(F.transform(s, lambda e, k: F.when(same(e, k - 1) | same(e, k + 1), e["i"])), lambda i: i.isNotNull())
    )
    gaps = F.transform(p, lambda i, k: F.least(F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW)), F.lit(WINDOW)))
    found = (
        hashed.withColumn("__s", F.when(F.size(F.array_distinct(h)) < F.size(h), by_hash))
        .withColumn("__p", F.when(s.isNotNull(), starts))
        .withColumn("__repeat", F.when(p.isNotNull(), F.aggregate(gaps, F.lit(0), lambda a, x: a + x)).otherwise(0))
    )
    spelled = [form for x in FUNCTION_WORDS for form in (x, x.capitalize(), x.upper())]
    left = lambda pattern: F.length(F.regexp_replace("__t", pattern, ""))
    counts = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": left(f"[^{SYMBOLS}]+"),
        "n_lines": F.size("__l"),
        "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")),
        "n_repeat_words": F.col("__repeat"),
        "n_capitals": left(r"[^\p{Lu}]+"),
        "n_letters": left(r"[^\p{L}]+"),
        "n_marks": left(r"[^!?]+"),
        "n_distinct": F.size(F.array_distinct(w)),
        "n_function": F.size(F.filter("__h1", lambda x: x.isin([F.xxhash64(F.lit(f)) for f in spelled]))),
        "n_ended": F.size(F.filter("__l", lambda x: x.rlike(f"[.!?:;…][\"'»”)\\]]*[{GAPS}]*$"))),
        "n_sentences": F.regexp_count("__t", F.lit(f"[.!?…][\"'»”)\\]]*+(?![^{GAPS}])")),
        "n_vowels": left(r"(?i)[^aeiouyàáâäèéêëìíîïòóôöùúûüœæ]+"),
    }
    return found.select(*docs.columns, F.struct(*[counts[m].cast("long").alias(m) for m in MEASURES]).alias("__m"))


def votes() -> list[Column]:
    """One column per rule, in the order of ``RULES``. A rule abstains where a text is too short for it or its measure lies between its limits."""
    c = lambda name: F.col(f"__m.{name}")
    symbols = _share(c("n_symbols"), c("word_chars"))
    dup = F.when(c("n_lines") >= 4, _share(c("n_dup_lines"), c("n_lines"))).otherwise(0.0)
    repeats = _share(c("n_repeat_words"), c("n_words"))
    capitals = F.when(c("n_letters") >= 40, _share(c("n_capitals"), c("n_letters"))).otherwise(0.0)
    length = _share(c("word_chars"), c("n_words"))
    letters = F.when(c("word_chars") >= 40, _share(c("n_letters"), c("word_chars"))).otherwise(1.0)
    # Distinct words grow more slowly than words: beyond VARIETY_WORDS, about as their square root.
    n = c("n_words").cast("double")
    variety = _share(c("n_distinct"), F.least(n, F.sqrt(VARIETY_WORDS * n)))
    marks = _share(c("n_marks"), c("n_words"))
    enough = c("n_words") >= 20
    bad = [
        symbols > 0.03, dup > 0.2, enough & (repeats > 0.1), capitals > 0.3, enough & ~length.between(2, 20), letters < 0.8,
        enough & (variety < 0.25), enough & (marks > 0.2),
    ]
    good = [
        enough & (symbols < 0.01) & (capitals < 0.2) & (marks < 0.1) & length.between(3, 12),
        enough & (dup < 0.1) & (repeats < 0.05) & (variety > 0.4),
    ]
    function, ended = _share(c("n_function"), c("n_words")), _share(c("n_ended"), c("n_lines"))
    line, sentence, vowels = _share(c("n_words"), c("n_lines")), _share(c("n_words"), c("n_sentences")), _share(c("n_vowels"), c("n_letters"))
    lines, spoken = c("n_lines") >= 3, c("n_letters") >= 40
    either = [
        (enough & (function > 0.08), enough & (function < 0.02)),
        (lines & (ended > 0.6), lines & (ended < 0.2)),
        (lines & line.between(6, 400), lines & (line < 3)),
        (enough & sentence.between(4, 60), enough & ((c("n_sentences") == 0) | (sentence < 2) | (sentence > 200))),
        (spoken & vowels.between(0.25, 0.6), spoken & ~vowels.between(0.15, 0.7)),
    ]
    one_sided = [F.when(x, -1).otherwise(0) for x in bad] + [F.when(x, 1).otherwise(0) for x in good]
    return [x.cast("int") for x in one_sided + [F.when(g, 1).when(b, -1).otherwise(0) for g, b in either]]


def posterior(balance: float, weights: list[tuple[float, float]]) -> Column:
    """Probability of good, for a share ``balance`` of good documents and the weights (of a good vote, of a bad vote) of the rules,
    each the logarithm of how much oftener the right class gets that vote."""
    odds = F.lit(math.log(balance / (1 - balance)))
    for j, (good, bad) in enumerate(weights):
        vote = F.element_at("__votes", j + 1)
        odds = odds + F.when(vote == 1, good).when(vote == -1, -bad).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def estimate(
    patterns: DataFrame, rules: int, balance: float = BALANCE, start: float = START, strength: float = 10.0, rounds: int = 60, tolerance: float = 1e-6
) -> tuple[float, list[tuple[float, float]]]:
    """Share of good documents and the rules' weights, by expectation-maximisation over the pattern table (__votes, n); only sums
    come back to the driver.

    E: posterior of each pattern. M: how often a rule casts a vote on documents of either class, both smoothed by
    ``strength`` votes of the starting belief; the share of good documents likewise. Abstaining says nothing. A vote that is
    as frequent on the wrong class as on the right one weighs nothing; none is turned round, which also keeps the two classes from
    changing places. A vote that is never cast keeps its starting weight.
    """
    first = math.log(start / (1 - start))
    weights = [(first, first)] * rules
    for _ in range(rounds):
        p = posterior(balance, weights)
        sums = [F.sum(F.col("n") * F.col("p")).alias("good"), F.sum("n").alias("all")]
        for j in range(rules):
            for vote in (1, -1):
                cast = F.element_at("__votes", j + 1) == vote
                sums += [F.sum(F.when(cast, F.col("n") * F.col("p"))).alias(f"g{j}_{vote}"), F.sum(F.when(cast, F.col("n"))).alias(f"n{j}_{vote}")]
        good, total, *got = [float(x or 0) for x in patterns.withColumn("p", p).agg(*sums).first()]
        ratio = (total - good + strength) / (good + strength)
        new = []
        for j in range(rules):
            right, votes_good, wrong, votes_bad = got[4 * j : 4 * j + 4]
            up = (right + strength * start) / (votes_good - right + strength * (1 - start)) * ratio
            down = (votes_bad - wrong + strength * start) / (wrong + strength * (1 - start)) / ratio
            new.append((max(0.0, math.log(up)) if votes_good else first, max(0.0, math.log(down)) if votes_bad else first))
        share = (good + strength * BALANCE) / (total + strength)
        moved = max([abs(share - balance)] + [abs(x - y) for a, b in zip(weights, new, strict=True) for x, y in zip(a, b, strict=True)])
        balance, weights = share, new
        if moved < tolerance:
            break
    return balance, weights


def base_failed() -> Column:
    words = F.col("__m.n_words")
    return (words < 20) | (100 * F.col("__m.n_repeat_words") > 30 * words)


def _judged(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, Column]:
    """Columns ``keep`` of ``docs`` with ``__m`` and ``__votes``, stored once, and the posterior probability as a column of it."""
    voted = materialize(measures(docs).select(*keep, "__m", F.array(*votes()).alias("__votes")), "votes")
    patterns = materialize(voted.groupBy("__votes").agg(F.count("*").alias("n")).coalesce(1), "patterns")
    return voted, posterior(*estimate(patterns, len(RULES)))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row for each row of ``docs``: doc_id, counts, ``base_failed``, ``p_good`` and ``kept``.

    A null or empty text has no words and fails the base rules. Repeated rows are judged alike, null ids pass through, an
    empty table gives an empty table; other columns of ``docs`` are not read.
    """
    voted, p_good = _judged(docs.select("doc_id", "text"), ["doc_id"])
    counts = [F.col(f"__m.{m}").alias(m) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return voted.select(
        "doc_id", *counts, base_failed().alias("base_failed"), p_good.alias("p_good"),
        (~base_failed() & (p_good >= threshold)).alias("kept"),
    )


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that the rules keep, with all their columns. Cases as in ``judge``; nothing is joined."""
    keep = without(docs, _OWN).columns
    voted, p_good = _judged(docs, keep)
    return voted.where(~base_failed() & (p_good >= threshold)).select(*keep)
