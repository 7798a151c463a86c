"""The registered queries of this subpackage, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, html_wrapper, licenses, line_dedup, minhash, ordinal, packing, prefix_trie, quality_rules, simhash, spelling, toxicity
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return ann.nearest(vectors, F.col("vec_id") % 20 == 0)


def op5_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.select(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(read(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract(read(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read(spark, sf_dir, "conversations"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = [
        op1_bpe, op2_quality_rules, op3_minhash, op4_hilbert, op5_ordinal, op6_licences, op7_toxicity, op8_line_dedup, op9_html, op10_packing,
        op11_simhash, op12_prefix_trie, op13_spelling,
    ]
    return {f.__name__: f for f in found}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT r, doc_id, id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM docs
), keyed AS (
  SELECT *, translate(trim(line, {_GAPS}), '{_UPPER}', '{_LOWER}') AS k FROM lines
), shared AS (
  SELECT k, max(id) AS holder FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT id) >= 3
), marked AS (
  SELECT keyed.*, coalesce(holder <> id, false) AS gone FROM keyed LEFT JOIN shared ON keyed.k = shared.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""


def _crc32(byte_list: str) -> str:
    """SQL for the CRC-32 of a list of bytes, by the table of its generator."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(str(i))
    step = f"xor(list_extract([{', '.join(table)}], (xor(a, b) & 255) + 1)::bigint, a >> 8)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {byte_list}), lambda a, b: {step}), 4294967295::bigint)"


def _bytes(text: str) -> str:
    return f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint)"


PREFIX_TRIE = f"""
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), marked AS (
  SELECT *, md5(length(role)::varchar || ':' || role || text) AS mark, strlen(text) AS bytes FROM turns
), own AS (
  SELECT conv_id, mark, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) AS pos FROM marked
), ids AS (
  SELECT c, {_crc32(_bytes("c::varchar"))} % 9 AS h FROM (SELECT DISTINCT conv_id AS c FROM own)
), parts AS (
  SELECT c, 0 AS part, pos, mark, bytes FROM ids JOIN own ON own.conv_id = c - c % 5 AND pos <= h
  UNION ALL SELECT c, 1, pos, mark, bytes FROM ids JOIN own ON own.conv_id = c AND pos > h
), placed AS (
  SELECT c, bytes, row_number() OVER w AS d, string_agg(mark, '') OVER w AS path FROM parts WINDOW w AS (PARTITION BY c ORDER BY part, pos)
), members AS (
  SELECT c, d, path, bytes FROM placed UNION ALL SELECT c, 0, '', 0 FROM ids
), lengths AS (
  SELECT c, max(d) AS length FROM members GROUP BY c
), nodes AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(c::varchar, ',' ORDER BY c) FILTER (d = length), '')) AS ends
  FROM members JOIN lengths USING (c) GROUP BY path, d
), ups AS (
  SELECT child.path, up.conv_id AS parent, up.path AS up FROM nodes child JOIN nodes up ON up.d = child.d - 1 AND up.path = left(child.path, 32 * (child.d - 1)::int)
), kids AS (
  SELECT up AS path, count(*) AS children FROM ups GROUP BY up
), totals AS (
  SELECT top.path, sum(CASE WHEN kids.children IS NULL THEN 1 ELSE 0 END)::bigint AS leaves, sum((below.n - 1) * below.bytes)::bigint AS saved
  FROM nodes top JOIN nodes below ON starts_with(below.path, top.path) LEFT JOIN kids ON kids.path = below.path GROUP BY top.path
)
SELECT conv_id, d::bigint AS depth, parent AS parent_conv_id, n AS n_convs, coalesce(children, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens, ends AS ends_sha256
FROM nodes JOIN totals USING (path) LEFT JOIN kids USING (path) LEFT JOIN ups USING (path)
"""

SPELLING = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::varchar, '') AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents
), once AS (
  SELECT doc, run, count(*) AS n, {_crc32(_bytes("doc || ':' || run"))} AS h FROM runs GROUP BY doc, run
), damaged AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) ELSE run END AS word, n FROM once
), words AS (
  SELECT word, sum(n)::bigint AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), lacks AS (
  SELECT word, n, i, left(word, i::int) || substr(word, i::int + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM lacks a JOIN lacks b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT lacks.word, words.word, words.n FROM lacks JOIN words ON words.word = lacks.rest
  UNION SELECT words.word, lacks.word, lacks.n FROM lacks JOIN words ON words.word = lacks.rest
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS top FROM near GROUP BY word
), forms AS (
  SELECT words.word, CASE WHEN top >= 2 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN top END AS form_n
  FROM words LEFT JOIN best USING (word)
), roots AS (
  SELECT word, word AS root FROM forms WHERE form IS NULL
  UNION ALL SELECT forms.word, roots.root FROM forms JOIN roots ON forms.form = roots.word
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_line_dedup": LINE_DEDUP, "op12_prefix_trie": PREFIX_TRIE, "op13_spelling": SPELLING}
