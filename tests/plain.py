"""The feature definitions once more in plain Python, independent of the package's expressions."""

import random
import re
import string

import regex

from tokengauge.functions.patterns import STOPWORDS, UNICODE_SCRIPTS

# fixed values: the patterns in their Python form
BACK_SPACED = [
    re.compile(r"```.*?```|~~~.*?~~~", re.S),
    re.compile(r"`[^`\n]+`"),
    re.compile(r"<\s*/?\s*[a-zA-Z][^>]*?>"),
    re.compile(r"!\[[^\]]*\]\([^\)]*\)|\[[^\]]+\]\([^\)]+\)"),
]
HEADING = re.compile(r"(?m)^\s{0,3}#{1,6}\s+")
URL = re.compile(r"(?i)\b(?:https?://|www\.)[^\s<>\"'\)\]\},;:]+")
EMAIL = re.compile(r"(?i)\b(?:mailto:)?[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}\b")
MENTION = re.compile(r"(?<!\S)@[\w.]{1,50}")
HASHTAG = re.compile(r"(?<!\S)#\w{1,200}")
CAMEL = re.compile(r"\b[a-z]+[A-Z][A-Za-z0-9]*\b")


def markup(s):
    total = 0
    for pattern in BACK_SPACED:
        s, n = pattern.subn(lambda m: " " * len(m.group()), s)
        total += n
    return total + sum(1 for _ in HEADING.finditer(s))


def social(s):
    total = 0
    for pattern in (MENTION, HASHTAG):
        s, n = pattern.subn(lambda m: " " * len(m.group()), s)
        total += n
    return total + sum(1 for _ in CAMEL.finditer(s))


def count(pattern, s):
    return sum(1 for _ in re.finditer(pattern, s))


def features(content):
    s = "None" if content is None else content
    words = s.split()
    chars, eps = len(s), 1e-6
    alnum = sum(c in string.ascii_letters + string.digits for c in s)
    special = count(r"[^a-zA-Z0-9\s]", s)
    spaces = count(r"\s", s)
    plain = "".join(c for c in s.lower() if c not in string.punctuation).split()
    return {
        "char_count": chars,
        "word_count": len(words),
        "whitespace_count": spaces,
        "has_non_ascii": any(ord(c) > 127 for c in s),
        "avg_word_length": chars / (len(words) + eps),
        "whitespace_ratio": spaces / (chars + eps),
        "alnum_special_ratio": alnum / (alnum + special + eps),
        "digit_proportion": count(r"\d", s) / (chars + eps),
        "uppercase_proportion": count(r"[A-Z]", s) / (chars + eps),
        "punctuation_proportion": sum(c in string.punctuation for c in s) / (chars + eps),
        "max_word_length": max(map(len, words), default=0),
        "min_word_length": min(map(len, words), default=0),
        "code_markup_count": markup(s),
        "url_email_count": len(URL.findall(s)) + len(EMAIL.findall(s)),
        "social_media_count": social(s),
        "language_count": sum(bool(regex.search(rf"\p{{Script={x}}}", s)) for x in UNICODE_SCRIPTS),
        "stopword_proportion": sum(w in STOPWORDS for w in plain) / len(plain) if plain else 0.0,
    }


def gap_words(content):
    return count(r"\s+", "None" if content is None else content) + 1


HAND_MADE = [
    None, "", " \n\t", "a\x1cb\u00a0c\u2003d\r\ne", "```x\n# y``` \n# h", "`a`# t", "`ab`# t", "`a` # t",
    '<a href="x">[l](u)</a> ![i](s)', "@me x@y #tag camelCase \u00e9aB", "@a#tag @b.c",
    "http://a.b/c:80 www.x.y, mailto:q_1@x-y.org .a@b.co", "Don't THE the", "\u0416 \u6f22 \u30a2 a \u0663",
    "\U0001f600a", "\u017fwww.a.b HTTP\u017f://x a@b.\u212aom", "\u00e9www.x.y \u00e9a@b.co", "a\u0300b aB\u0300 aB9_ aB",
    "\u6f22\u5b57\u304b\u306a\u30ab\u30bf \u041f\u0440\u0438\u0432\u0435\u0442 \u0645\u0631\u062d\u0628\u0627 \u0e2a\u0e27\u0e31 \u05e9 \u13a0 \u1e00",
    "~~~a~~~```b```", "x\n   ## y\n    # z\n####### q\r# r\x85# s\u2028# t", "\ufeffa b", "1\u00b2\u00bd\u0967", "\u0130I\u0131i THE\u0307",
]
PIECES = [
    "```", "~~~", "`", "<", ">", "/", "a", "B", "<b>", "</i >", "![", "](", ")", "[", "#", "## ", "\n", "\r\n", "\x1c",
    " ", "  ", "\t", "@", "@me", "#tag", "camelCase", "http://", "www.", "x.org", "mailto:", "a.b@c.de", ".", ",", ";",
    "\u00e9", "\u0663", "\u0416", "\u6f22", "\u30a2", "\u00a0", "\u2028", "\x85", "_", "9", "the", "The", "don't", "-", "'", "\"", "\u017f", "\U0001f600",
]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 25))) for _ in range(n)]
