"""Character classes, patterns and word lists of the text features.

Java regular expressions are not Python ones: ``\\s``, ``\\w``, ``\\d`` and
``\\b`` are ASCII-only and ``(?m)^`` also breaks at a carriage return. The
classes here are spelled out so that the features mean the same as in Python.
"""

# White space of str.split() and of a Unicode \s (29 code points).
WS_CLASS = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{WS_CLASS}]"
NOT_WS = f"[^{WS_CLASS}]"
# Unicode \w, and the two word boundaries around a word character.
WORD = r"[\p{L}\p{N}_]"
WORD_START = f"(?<!{WORD})"
WORD_END = f"(?!{WORD})"
ANY_BOUNDARY = f"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"
DIGIT = r"\p{Nd}"

# --- fixed values: must equal the values the results are defined by ---------

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

UNICODE_SCRIPTS = """
    Adlam Ahom Anatolian_Hieroglyphs Arabic Armenian Avestan Balinese Bamum Bassa_Vah Batak
    Bengali Bhaiksuki Bopomofo Brahmi Braille Buginese Buhid Canadian_Aboriginal Carian Cham
    Cherokee Coptic Cuneiform Cypriot Cyrillic Devanagari Dogra Duployan Egyptian_Hieroglyphs
    Elbasan Ethiopic Georgian Glagolitic Gothic Grantha Greek Gujarati Gurmukhi Hangul Han
    Hanunoo Hatran Hebrew Hiragana Imperial_Aramaic Inscriptional_Pahlavi Inscriptional_Parthian
    Javanese Kaithi Kannada Katakana Kayah_Li Kharoshthi Khmer Khojki Khudawadi Lao Latin Lepcha
    Limbu Linear_B Lisu Lycian Lydian Malayalam Mandaic Manichaean Meetei_Mayek Mende_Kikakui
    Meroitic_Cursive Meroitic_Hieroglyphs Miao Modi Mongolian Mro Multani Myanmar Nabataean
    New_Tai_Lue Nko Nushu Ogham Ol_Chiki Old_Hungarian Old_Italic Old_North_Arabian Old_Permic
    Old_Persian Old_Sogdian Old_South_Arabian Old_Turkic Oriya Osage Osmanya Pahawh_Hmong
    Palmyrene Phags_Pa Phoenician Psalter_Pahlavi Rejang Runic Samaritan Saurashtra Sharada
    Siddham SignWriting Sinhala Sora_Sompeng Soyombo Sundanese Syloti_Nagri Syriac Tagalog
    Tagbanwa Tai_Le Tai_Tham Tai_Viet Takri Tamil Telugu Thaana Thai Tibetan Tifinagh Ugaritic
    Vai Yi
""".split()

STOPWORDS = """
    a about above after again against all am an and any are as at be because been before being
    below between both but by can did do does doing down during each few for from further had
    has have having he her here hers herself him himself his how i if in into is it its itself
    just me more most my myself no nor not now of off on once only or other our ours ourselves
    out over own s same she should so some such t than that the their theirs them themselves
    then there these they this those through to too under until up very was we were what when
    where which while who whom why will with you your yours yourself yourselves
""".split()

URL = rf"""(?iu){WORD_START}(?:https?://|www\.)[^{WS_CLASS}<>\x22\x27\)\]\}},;:]+"""
EMAIL = (
    rf"(?iu){ANY_BOUNDARY}(?:mailto:)?[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{{2,}}{WORD_END}"
)
MENTION = rf"(?<!{NOT_WS})@[\p{{L}}\p{{N}}_.]{{1,50}}"
HASHTAG = rf"(?<!{NOT_WS})#{WORD}{{1,200}}"
CAMEL_CASE = rf"{WORD_START}[a-z]++[A-Z][A-Za-z0-9]*+{WORD_END}"

FENCED_CODE = r"(?s)```.*?```|~~~.*?~~~"
INLINE_CODE = r"`[^`\n]+`"
HTML_TAG = rf"<{WS}*/?{WS}*[a-zA-Z][^>]*+>"
MARKDOWN_LINK = r"!\[[^\]]*\]\([^\)]*\)|\[[^\]]+\]\([^\)]+\)"
HEADING = rf"(?md)^{WS}{{0,3}}#{{1,6}}{WS}+"

# --- end of fixed values ------------------------------------------------------

# as \xNN, so that no character needs escaping in a class or in a SQL literal
PUNCTUATION_CLASS = "".join(f"\\x{ord(c):02x}" for c in PUNCTUATION)

# Pre-token pieces: the split that byte-level vocabularies make before merging.
PRETOKEN = rf" ?\p{{L}}+| ?\p{{N}}+| ?[^{WS_CLASS}\p{{L}}\p{{N}}]+"
