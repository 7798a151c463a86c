"""SQL twins of the queries, for DuckDB over the same tables.

RE2 has no look-around and an ASCII word boundary, so the twins state the same
rules another way: the character before a match is matched too, camel case is
tested on whole words.
"""

from __future__ import annotations

from tokengauge.functions import patterns as p
from tokengauge.functions.text import REGULARIZED_FEATURES, SELECTED_FEATURES
from tokengauge.plans import best_params
from tokengauge.plans.regularized import PENALTIES
from tokengauge.sources.corpus import LANGUAGES

WS_CLASS = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WS = f"[{WS_CLASS}]"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
PRETOKEN = rf" ?\p{{L}}+| ?\p{{N}}+| ?[^{WS_CLASS}\p{{L}}\p{{N}}]+"
PUNCT = p.PUNCTUATION.replace("'", "''")

URL = rf"(?i)(?:^|{NOT_WORD})(?:https?://|www\.)[^{WS_CLASS}<>\x22\x27\)\]\}},;:]+"
EMAIL = r"(?i)\b(?:mailto:)?[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}\b"
MENTION = rf"(?:^|{WS})@[\p{{L}}\p{{N}}_.]{{1,50}}"
HASHTAG = rf"(?:^|{WS})#{WORD}{{1,200}}"
CAMEL = "[a-z]+[A-Z][A-Za-z0-9]*"
TAG = rf"<{WS}*/?{WS}*[a-zA-Z][^>]*?>"
HEADING = rf"(?m)^{WS}{{0,3}}#{{1,6}}{WS}+"

ALL_TEXTS = """
texts as (
  select 'documents' as origin, doc_id as id, 0::bigint as part, text as content from documents
  union all select 'pages', page_id, 0::bigint, html from pages
  union all select 'urls', page_id, 0::bigint, url from pages
  union all select 'conversations', conv_id, turn, text from conversations
  union all select 'benchmark', item_id, 0::bigint, text from benchmark
)"""


def hits(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def blank(text: str, pattern: str) -> str:
    """Every match replaced by as many spaces: pieces and matches put together again."""
    return f"""array_to_string(list_transform(
      list_zip(string_split_regex({text}, '{pattern}'), regexp_extract_all({text}, '{pattern}')),
      lambda z: z[1] || repeat(' ', coalesce(length(z[2]), 0))), '')"""


SPACED = {
    "fence": p.FENCED_CODE,
    "inline": p.INLINE_CODE,
    "tag": TAG,
    "link": p.MARKDOWN_LINK,
}
LANGUAGE_COUNT = " + ".join(rf"regexp_matches(content, '\p{{{s}}}')::int" for s in p.UNICODE_SCRIPTS)
STOPWORDS = ", ".join(f"'{w}'" for w in p.STOPWORDS)

# stages of the markup and social counts, each reading the one before
STAGED = f"""
staged1 as (
  select *, {blank('content', SPACED['fence'])} as c1, {hits('content', SPACED['fence'])} as n1,
    regexp_replace(content, '{MENTION}', ' ', 'g') as m1, {hits('content', MENTION)} as k1 from texts),
staged2 as (
  select *, {blank('c1', SPACED['inline'])} as c2, {hits('c1', SPACED['inline'])} as n2,
    regexp_replace(m1, '{HASHTAG}', ' ', 'g') as m2, {hits('m1', HASHTAG)} as k2 from staged1),
staged3 as (select *, {blank('c2', SPACED['tag'])} as c3, {hits('c2', SPACED['tag'])} as n3 from staged2),
staged4 as (select *, {blank('c3', SPACED['link'])} as c4, {hits('c3', SPACED['link'])} as n4 from staged3),
base as (
  select *,
    length(content) as char_count,
    list_filter(string_split_regex(content, '{WS}+'), lambda w: w <> '') as words,
    list_filter(string_split_regex(translate(lower(content), '{PUNCT}', ''), '{WS}+'), lambda w: w <> '') as plain
  from staged4)"""

TEXT_SQL = {
    "char_count": "char_count::bigint",
    "word_count": "len(words)::bigint",
    "whitespace_count": f"{hits('content', WS)}::bigint",
    "has_non_ascii": r"regexp_matches(content, '[^\x00-\x7F]')",
    "avg_word_length": "char_count::double / (len(words)::double + 1e-6)",
    "whitespace_ratio": f"{hits('content', WS)}::double / (char_count::double + 1e-6)",
    "alnum_special_ratio": (
        f"{hits('content', '[a-zA-Z0-9]')}::double / ({hits('content', '[a-zA-Z0-9]')}::double + "
        f"{hits('content', f'[^a-zA-Z0-9{WS_CLASS}]')}::double + 1e-6)"
    ),
    "digit_proportion": rf"{hits('content', chr(92) + 'p{Nd}')}::double / (char_count::double + 1e-6)",
    "uppercase_proportion": f"{hits('content', '[A-Z]')}::double / (char_count::double + 1e-6)",
    "max_word_length": "coalesce(list_max(list_transform(words, lambda w: length(w))), 0)::bigint",
    "min_word_length": "coalesce(list_min(list_transform(words, lambda w: length(w))), 0)::bigint",
    "code_markup_count": f"(n1 + n2 + n3 + n4 + {hits('c4', HEADING)})::bigint",
    "url_email_count": f"({hits('content', URL)} + {hits('content', EMAIL)})::bigint",
    "social_media_count": (
        f"(k1 + k2 + len(list_filter(string_split_regex(m2, '{NOT_WORD}+'), "
        f"lambda w: regexp_full_match(w, '{CAMEL}'))))::bigint"
    ),
    "punctuation_proportion": (
        f"(length(content) - length(translate(content, '{PUNCT}', '')))::double / (char_count::double + 1e-6)"
    ),
    "stopword_proportion": (
        f"case when len(plain) > 0 then len(list_filter(plain, lambda w: w in ({STOPWORDS})))::double "
        "/ len(plain)::double else 0.0::double end"
    ),
    "language_count": f"({LANGUAGE_COUNT})::bigint",
}


def text_sql(features: list[str]) -> str:
    columns = ", ".join(f"{TEXT_SQL[f]} as {f}" for f in features)
    return f"with {ALL_TEXTS}, {STAGED} select origin, id, part, {columns} from base"


GAP_WORDS = f"({hits('text', WS + '+')} + 1)"
PRETOKENS = hits("text", PRETOKEN)
WORDS = f"len(list_filter(string_split_regex(text, '{WS}+'), lambda w: w <> ''))"
FOLD = "((row_number() over (order by md5('42:' || doc_id::varchar)) - 1) % 10)::int"
SCOPES = "unnest(case when lang = 'en' then ['all', 'english'] else ['all'] end) as scope"
LANGUAGE = "case lang " + " ".join(f"when '{k}' then '{v}'" for k, v in LANGUAGES.items()) + " else lang end"
TINY = "2.220446049250313e-16::double"

DOCS = f"""
docs as (
  select doc_id, lang, length(text)::double as char_count, {WORDS}::double as word_count,
    length(text)::double / ({WORDS}::double + 1e-6) as avg_word_length, {PRETOKENS}::double as y, {FOLD} as fold
  from documents),
scoped as (select *, {SCOPES} from docs)"""


def fits(config: str = "char_count", ridge: float = 0.0) -> str:
    """Held-out predictions of one-feature least squares (``ridge`` on the z-scored feature)."""
    return f"""
fit as (
  select s.scope, f.fold,
    covar_pop(s.y, s.{config}) / var_pop(s.{config}) * count(*) / (count(*) + {ridge}) as a,
    avg(s.y) as y_mean, avg(s.{config}) as x_mean
  from scoped s join (select distinct fold from docs) f on s.fold <> f.fold
  group by s.scope, f.fold),
pred as (
  select s.doc_id, s.scope, s.fold, s.y, fit.y_mean + fit.a * (s.{config} - fit.x_mean) as yhat
  from scoped s join fit on s.scope = fit.scope and s.fold = fit.fold)"""


def _soft(model: str, alpha: float, l1_ratio: float) -> str:
    """Held-out predictions of one z-scored feature under an L1 and an L2 penalty: the soft threshold."""
    return f"""
with {DOCS},
sums as (
  select s.scope, f.fold, avg(s.y) as y_mean, avg(s.char_count) as x_mean, stddev_pop(s.char_count) as sx,
    covar_pop(s.y, s.char_count) / stddev_pop(s.char_count) as c
  from scoped s join (select distinct fold from docs) f on s.fold <> f.fold
  group by s.scope, f.fold),
fit as (
  select *, sign(c) * greatest(abs(c) - {alpha * l1_ratio}, 0) / (1 + {alpha * (1 - l1_ratio)}) / sx as a from sums)
select '{model}' as model, 'pretoken' as tokenizer, s.scope, s.fold, s.doc_id, round(s.y, 4) as y,
  round(fit.y_mean + a * (s.char_count - x_mean), 4) as yhat
from scoped s join fit on s.scope = fit.scope and s.fold = fit.fold"""


def _two_features(ridge: float) -> str:
    """Held-out predictions of ridge on two z-scored features: two equations, solved by determinants."""
    return f"""
with {DOCS},
sums as (
  select s.scope, f.fold, avg(s.y) as y_mean, avg(char_count) as m1, avg(word_count) as m2,
    stddev_pop(char_count) as s1, stddev_pop(word_count) as s2, corr(char_count, word_count) as r,
    covar_pop(s.y, char_count) / stddev_pop(char_count) as c1, covar_pop(s.y, word_count) / stddev_pop(word_count) as c2,
    1 + {ridge} / count(*) as d
  from scoped s join (select distinct fold from docs) f on s.fold <> f.fold
  group by s.scope, f.fold),
fit as (
  select *, (d * c1 - r * c2) / (d * d - r * r) / s1 as a1, (d * c2 - r * c1) / (d * d - r * r) / s2 as a2 from sums)
select 'ridge_10' as model, 'pretoken' as tokenizer, s.scope, s.fold, s.doc_id, round(s.y, 4) as y,
  round(fit.y_mean + a1 * (s.char_count - m1) + a2 * (s.word_count - m2), 4) as yhat
from scoped s join fit on s.scope = fit.scope and s.fold = fit.fold"""


SHARD_OUT = f"""
shards as (
  select 'documents.parquet' as fold, text from documents union all select 'conversations.parquet', text from conversations
  union all select 'benchmark.parquet', text from benchmark),
points as (select 'all' as scope, fold, length(text)::double as x, {PRETOKENS}::double as y from shards),
fit as (
  select f.fold, regr_slope(y, x) as a, regr_intercept(y, x) as b
  from points s join (select distinct fold from points) f on s.fold <> f.fold group by f.fold),
pred as (select scope, s.fold, y, a * x + b as yhat from points s join fit on s.fold = fit.fold)"""

METRICS = f"""
med as (
  select scope, fold, quantile_cont(abs(y - yhat), 0.5) as median_ae, quantile_cont(y, 0.5) as median_y
  from pred group by scope, fold),
metrics as (
  select 'ols' as model, 'pretoken' as tokenizer, scope, fold, count(*) as n,
    1 - avg((y - yhat) * (y - yhat)) / var_pop(y) as r2,
    avg(abs(y - yhat)) as mae,
    avg((y - yhat) * (y - yhat)) as mse,
    max(median_ae) as median_ae,
    avg(abs(y - yhat) / greatest(abs(y), {TINY})) as mape,
    max(abs(y - yhat)) as max_error,
    1 - avg(abs(y - yhat)) / avg(abs(y - median_y)) as d2_abs,
    sqrt(avg((y - yhat) * (y - yhat))) as rmse
  from pred join med using (scope, fold) group by scope, fold)"""
NAMES = ["r2", "mae", "mse", "median_ae", "mape", "max_error", "d2_abs", "rmse"]
ROUNDED = ", ".join(f"round({m}, 4) as {m}" for m in NAMES)


def _candidates() -> str:
    """Mean R2 over folds of each one-feature configuration."""
    parts = []
    for i, c in enumerate(["char_count", "word_count", "avg_word_length"]):
        parts.append(f"""
          select 'ols' as model, {i} as config_id, '{c}' as config, 'pretoken' as tokenizer, scope, avg(r2) as mean_r2
          from (
            with {fits(c)}
            select scope, fold, 1 - avg((y - yhat) * (y - yhat)) / var_pop(y) as r2 from pred group by scope, fold
          ) group by scope""")
    return f"{DOCS}, summary as ({' union all '.join(parts)})"


def _values() -> str:
    def lit(v):
        return "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in best_params.rows())
    return (
        f"(values {body}) as b(model, tokenizer, scope, n_estimators, max_depth, min_samples_leaf, "
        "activation, alpha, hidden)"
    )


def _scaler() -> str:
    parts = []
    for c in ["char_count", "word_count", "y"]:
        name = "pretoken" if c == "y" else c
        parts.append(
            f"select scope, fold, '{name}' as feature, count(*) as n, round(avg({c}), 4) as mean, "
            f"round(case when stddev_pop({c}) = 0 then 1.0 else stddev_pop({c}) end, 4) as scale "
            "from scoped group by scope, fold"
        )
    return f"with {DOCS} " + " union all ".join(parts)


def _moments() -> str:
    names = {"char_count": "char_count", "word_count": "word_count", "pretoken": "y"}
    columns = [f"sum({c}) as sum_{n}" for n, c in names.items()]
    items = list(names.items())
    for i, (a, ca) in enumerate(items):
        columns += [f"sum({ca} * {cb}) as sum_{a}__{b}" for b, cb in items[i:]]
    return f"with {DOCS} select scope, fold, count(*) as n, {', '.join(columns)} from scoped group by scope, fold"


def _predictions(model: str, ridge: float) -> str:
    return (
        f"with {DOCS}, {fits('char_count', ridge)} select '{model}' as model, 'pretoken' as tokenizer, scope, fold, "
        "doc_id, round(y, 4) as y, round(yhat, 4) as yhat from pred"
    )


def oracle_sql() -> dict[str, str]:
    ratio = f"{PRETOKENS}::double / {GAP_WORDS}::double"
    sql = {
        "scan_project": "select doc_id, lang, n_chars from documents",
        "shard_union": f"with {ALL_TEXTS} select origin, id, part, length(content)::bigint as char_count from texts",
        "features_read": f"""
            select d.doc_id, length(text)::bigint as char_count, {WORDS}::bigint as word_count, quality, 'English' as language
            from documents d join labels l on d.doc_id = l.doc_id
            where lang = 'en' and quality is not null""",
        "conversation_prompts": f"""
            select conv_id, turn, length(text)::bigint as char_count, {WORDS}::bigint as word_count,
              {hits('text', WS)}::bigint as whitespace_count,
              length(text)::double / ({WORDS}::double + 1e-6) as avg_word_length
            from conversations where role = 'user'""",
        "scope_counts": f"""
            select scope, count(*) as n, sum(n_chars)::bigint as chars
            from (select n_chars, {SCOPES} from documents) group by scope""",
        "dropna_target": """
            select d.doc_id, l.quality, d.n_chars from documents d left join labels l on d.doc_id = l.doc_id
            where l.quality is not null and d.n_chars is not null""",
        "iqr_filter": f"""
            with r as (select doc_id, {SCOPES}, {ratio} as ratio from documents),
            q as (select scope, quantile_cont(ratio, 0.25) as q1, quantile_cont(ratio, 0.75) as q3 from r group by scope)
            select scope, doc_id, ratio from r join q using (scope)
            where ratio between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)""",
        "targets_long": f"""
            select doc_id, 'pretoken' as tokenizer, {PRETOKENS}::bigint as target from documents
            union all select doc_id, 'gap_words', {GAP_WORDS}::bigint from documents""",
        "ratio_profile": f"""
            with r as (select {LANGUAGE} as language, {ratio} as ratio, {PRETOKENS}::double / nullif(length(text), 0)::double as per_char from documents)
            select 'pretoken' as tokenizer, language, count(*) as n, round(avg(ratio), 6) as per_word, round(avg(per_char), 6) as per_char,
              round(quantile_cont(ratio, 0.25), 6) as p25, round(quantile_cont(ratio, 0.5), 6) as p50, round(quantile_cont(ratio, 0.75), 6) as p75
            from r group by language""",
        "f_gap_word_count": f"""
            with {ALL_TEXTS} select origin, id, part, ({hits('content', WS + '+')} + 1)::bigint as gap_word_count from texts""",
        "kfold_assign": f"select doc_id, {FOLD} as fold from documents",
        "group_fold": "select source as fold, count(*) as n, sum(n_chars)::bigint as chars from documents group by source",
        "scaler_fit": _scaler(),
        "fold_moments": _moments(),
        "predict_ols": _predictions("ols", 0.0),
        "ridge_univariate_cv": _predictions("ridge_10", 10.0),
        "lasso_univariate_cv": _soft("lasso_0.01", 0.01, 1.0),
        "elasticnet_univariate_cv": _soft("elasticnet_0.01", 0.01, 0.5),
        "ridge_two_feature_cv": _two_features(10.0),
        "shard_out_cv": f"with {SHARD_OUT}, {METRICS} select model, tokenizer, scope, fold, n, {ROUNDED} from metrics",
        "huber_optimality": f"""
            with {DOCS} select 'pretoken' as tokenizer, scope, count(*) as n, round(avg(char_count), 4) as x_mean,
              round(stddev_pop(char_count), 4) as x_scale, round(avg(y), 4) as y_mean, round(stddev_pop(y), 4) as y_scale, true as optimal
            from scoped group by scope""",
        "stream_features": f"""
            with texts as (select doc_id, text as content from documents), {STAGED}
            select doc_id, {", ".join(f"{TEXT_SQL[f]} as {f}" for f in SELECTED_FEATURES)} from base""",
        "penalized_optimality": f"""
            with scoped as (select {SCOPES} from documents)
            select model, scope, feature, n, 0.0::double as left_over
            from (select scope, count(*) as n from scoped group by scope)
            cross join (select unnest({[p.name for p in PENALTIES]}) as model)
            cross join (select unnest({list(REGULARIZED_FEATURES)}) as feature)""",
        "stream_fit": f"""
            with texts as (
              select text from documents union all select text from conversations union all select text from benchmark),
            points as (
              select coalesce(length(text), 4)::double as x1, case when text is null then 1 else {WORDS} end::double as x2,
                case when text is null then 1 else {PRETOKENS} end::double as y from texts),
            penalties as (select unnest(['ols', 'ridge_10']) as model, unnest([0, 10]) as penalty),
            sums as (
              select model, count(*) as n, avg(y) as y0, avg(x1) as m1, avg(x2) as m2, stddev_pop(x1) as s1, stddev_pop(x2) as s2,
                corr(x1, x2) as r, covar_pop(y, x1) / stddev_pop(x1) as c1, covar_pop(y, x2) / stddev_pop(x2) as c2, 1 + max(penalty) / count(*) as d
              from points cross join penalties group by model),
            fit as (
              select *, (d * c1 - r * c2) / (d * d - r * r) / s1 as a1, (d * c2 - r * c1) / (d * d - r * r) / s2 as a2 from sums)
            select model, n, unnest(['intercept', 'char_count', 'word_count']) as feature,
              unnest([round(y0 - a1 * m1 - a2 * m2, 4), round(a1, 4), round(a2, 4)]) as value from fit""",
        "metrics": f"with {DOCS}, {fits()}, {METRICS} select model, tokenizer, scope, fold, n, {ROUNDED} from metrics",
        "report_wide": f"with {DOCS}, {fits()}, {METRICS} select model, tokenizer, scope, fold, {ROUNDED} from metrics",
        "cv_summary": f"""
            with {DOCS}, {fits()}, {METRICS},
            long as ({' union all '.join(f"select model, tokenizer, scope, '{m}' as metric, {m} as value from metrics" for m in NAMES)})
            select model, tokenizer, scope, metric, round(avg(value), 4) as mean, round(stddev_pop(value), 4) as std_pop,
              round(stddev_samp(value), 4) as std_samp, count(value) as folds
            from long group by model, tokenizer, scope, metric""",
        "rank_configs": f"""
            with {_candidates()}
            select model, config_id, config, tokenizer, scope, round(mean_r2, 6) as mean_r2,
              (rank() over (partition by model, tokenizer, scope order by mean_r2 desc))::int as rank
            from summary""",
        "best_config": f"""
            with {_candidates()},
            ranked as (select *, row_number() over (partition by model, tokenizer, scope order by mean_r2 desc, config_id) as r from summary)
            select model, tokenizer, scope, config_id, round(mean_r2, 6) as mean_r2 from ranked where r = 1""",
        "best_params_lookup": f"""
            with cells as (select scope, count(*) as n_rows from (select {SCOPES} from documents) group by scope)
            select b.model, b.tokenizer, b.scope, c.n_rows, b.n_estimators::int as n_estimators, b.max_depth::int as max_depth,
              b.min_samples_leaf::int as min_samples_leaf, b.activation, b.alpha::double as alpha, b.hidden
            from cells c join {_values()} on c.scope = b.scope""",
    }
    from tokengauge.registry import TEXT_QUERIES

    for name, features in TEXT_QUERIES.items():
        sql[name] = text_sql(features)
    return sql


