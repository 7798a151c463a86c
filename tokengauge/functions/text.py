"""The seventeen text features as Catalyst expressions (no Python on the data path).

Expressions are SQL text: one parse per layer, where building the same tree call
by call from Python costs a second of driver time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokengauge.functions import patterns as p

FEATURES = [
    "char_count", "word_count", "whitespace_count", "has_non_ascii", "avg_word_length",
    "whitespace_ratio", "alnum_special_ratio", "digit_proportion", "uppercase_proportion",
    "max_word_length", "min_word_length", "code_markup_count", "url_email_count",
    "social_media_count", "punctuation_proportion", "stopword_proportion", "language_count",
]
SELECTED_FEATURES = [
    "char_count", "word_count", "avg_word_length", "max_word_length", "code_markup_count",
    "url_email_count", "punctuation_proportion",
]
REGULARIZED_FEATURES = [
    "char_count", "word_count", "social_media_count", "code_markup_count", "max_word_length",
    "language_count", "whitespace_ratio", "url_email_count", "min_word_length",
    "avg_word_length", "alnum_special_ratio", "stopword_proportion",
]
EPS = "1e-6D"

# Runs of one of these scripts shrink to one character before scripts are looked
# up. Leaving a script out costs time only.
_RUN_SCRIPTS = [
    "Cyrillic", "Han", "Hiragana", "Katakana", "Hangul", "Arabic", "Hebrew", "Greek",
    "Devanagari", "Bengali", "Tamil", "Telugu", "Thai", "Georgian", "Armenian", "Ethiopic",
]
_NO_HITS = "cast(array() as array<string>)"


def literal(text: str) -> str:
    """A SQL literal that takes no escapes (patterns hold no single quote)."""
    if "'" in text:
        raise ValueError("pattern holds a quote; write it as \\x27")
    return f"r'{text}'"


def as_text(content: str, null_text: str | None = "None") -> Column:
    """Content as text; a null reads as ``null_text`` (``None`` keeps it null)."""
    text = F.col(content).cast("string")
    return text if null_text is None else F.coalesce(text, F.lit(null_text))


def matches(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {literal(pattern)}, 0)"


def count_matches(text: str, pattern: str) -> str:
    return f"regexp_count({text}, {literal(pattern)})"


def strip(text: str, pattern: str) -> str:
    return f"regexp_replace({text}, {literal(pattern)}, '')"


def blank_out(text: str, pattern: str, hits: str) -> str:
    """Replace every match by as many spaces as it has characters."""
    return f"""if(size({hits}) > 0, array_join(zip_with(split({text}, {literal(pattern)}, -1), {hits},
        (piece, hit) -> concat(piece, repeat(' ', coalesce(length(hit), 0)))), ''), {text})"""


def hits_if(guard: str, text: str, pattern: str) -> str:
    """Matches, looked for only in texts that hold what every match needs."""
    return f"if({guard}, {matches(text, pattern)}, {_NO_HITS})"


def gap_word_count(content: str) -> Column:
    """Runs of white space plus one: at least 1, also for an empty or null text."""
    runs = count_matches(content, p.WS + "+")
    return F.expr(f"cast(coalesce({runs}, 0) + 1 as bigint)")


def pretoken_count(content: str) -> Column:
    return F.expr(f"cast({count_matches(content, p.PRETOKEN)} as bigint)")


def _layers() -> list[dict[str, str]]:
    """Layers of columns; each layer reads the ones before, so a piece is computed once."""
    runs = "|".join(rf"(\p{{Is{s}}})\p{{Is{s}}}+" for s in _RUN_SCRIPTS)
    first_of_run = "".join(f"${i + 1}" for i in range(len(_RUN_SCRIPTS)))
    scripts = ", ".join(
        f"rlike(__fch, {literal(rf'\p{{Is{s}}}')})" for s in p.UNICODE_SCRIPTS if s != "Latin"
    )
    stopwords = ", ".join(f"'{w}'" for w in p.STOPWORDS)
    not_latin = strip("__t", r"[\x00-\x7f\p{IsLatin}\p{IsCommon}\p{IsInherited}]+")
    punctuation = f"[{p.PUNCTUATION_CLASS}]"
    return [
        {
            "char_count": "cast(length(__t) as bigint)",
            "has_non_ascii": "octet_length(__t) <> length(__t)",
            "__rest": strip("__t", "[a-zA-Z0-9]+"),
            "__lens": f"filter(transform(split(__t, {literal(p.WS + '+')}), w -> length(w)), n -> n > 0)",
            "__low": "lower(__t)",
            "__h1": hits_if("contains(__t, '```') or contains(__t, '~~~')", "__t", p.FENCED_CODE),
            "__a1": hits_if("contains(__t, '@')", "__t", p.MENTION),
        },
        {
            # what is not white space is in a word
            "whitespace_count": "char_count - aggregate(__lens, 0L, (sum, n) -> sum + n)",
            "__c1": blank_out("__t", p.FENCED_CODE, "__h1"),
            "__m1": blank_out("__t", p.MENTION, "__a1"),
            "__sw": f"filter(split({strip('__low', punctuation + '+')}, {literal(p.WS + '+')}), w -> w <> '')",
            "__for": f"if(has_non_ascii, regexp_replace({not_latin}, {literal(runs)}, '{first_of_run}'), '')",
            "word_count": "cast(size(__lens) as bigint)",
        },
        {
            "__h2": hits_if("contains(__c1, '`')", "__c1", p.INLINE_CODE),
            "__a2": hits_if("contains(__m1, '#')", "__m1", p.HASHTAG),
            "__fch": "if(__for <> '', array_join(array_distinct(split(__for, '')), ''), '')",
        },
        {
            "__c2": blank_out("__c1", p.INLINE_CODE, "__h2"),
            "__m2": blank_out("__m1", p.HASHTAG, "__a2"),
        },
        {"__h3": hits_if("contains(__c2, '<')", "__c2", p.HTML_TAG)},
        {"__c3": blank_out("__c2", p.HTML_TAG, "__h3")},
        {"__h4": hits_if("contains(__c3, '](')", "__c3", p.MARKDOWN_LINK)},
        {"__c4": blank_out("__c3", p.MARKDOWN_LINK, "__h4")},
        {
            "__chars": f"char_count + {EPS}",
            "__alnum": "length(__t) - length(__rest)",
            "max_word_length": "cast(coalesce(array_max(__lens), 0) as bigint)",
            "min_word_length": "cast(coalesce(array_min(__lens), 0) as bigint)",
            "code_markup_count": f"""cast(size(__h1) + size(__h2) + size(__h3) + size(__h4)
                + if(contains(__c4, '#'), {count_matches('__c4', p.HEADING)}, 0) as bigint)""",
            "url_email_count": f"""cast(
                if(contains(__t, '://') or contains(__low, 'www.'), {count_matches('__t', p.URL)}, 0)
                + if(contains(__t, '@'), {count_matches('__t', p.EMAIL)}, 0) as bigint)""",
            "social_media_count": f"""cast(size(__a1) + size(__a2)
                + if(rlike(__m2, '[a-z][A-Z]'), {count_matches('__m2', p.CAMEL_CASE)}, 0) as bigint)""",
            "language_count": f"""cast(if(rlike(__t, {literal(r'\p{IsLatin}')}), 1, 0)
                + if(__fch <> '', size(filter(array({scripts}), found -> found)), 0) as bigint)""",
            "__stop": f"size(filter(__sw, w -> w in ({stopwords})))",
        },
        {
            "avg_word_length": f"char_count / (word_count + {EPS})",
            "whitespace_ratio": "whitespace_count / __chars",
            "alnum_special_ratio": f"__alnum / (char_count - whitespace_count + {EPS})",
            "digit_proportion": f"{count_matches('__t', p.DIGIT)} / __chars",
            "uppercase_proportion": f"{count_matches('__t', '[A-Z]')} / __chars",
            "punctuation_proportion": f"{count_matches('__rest', punctuation)} / __chars",
            "stopword_proportion": "if(size(__sw) > 0, __stop / size(__sw), 0.0D)",
        },
    ]


def add_features(
    df: DataFrame,
    features: Sequence[str] = FEATURES,
    content: str = "content",
    null_text: str = "None",
) -> DataFrame:
    """Append the named features to ``df`` (a batch or a streaming DataFrame).

    Features that are not named are pruned from the plan by the optimizer.
    """
    unknown = set(features) - set(FEATURES)
    if unknown:
        raise ValueError(f"unknown features: {sorted(unknown)}")
    kept = df.columns
    df = df.withColumn("__t", as_text(content, null_text))
    for layer in _layers():
        df = df.selectExpr("*", *[f"{sql} as {name}" for name, sql in layer.items()])
    return df.select(*kept, *features)
