import base64

import pytest
import public_tokenizers as vocabularies

from tokengauge.functions.tokens import Vocabulary, add_token_counts, default_vocabularies

TEXTS = ["", None, "Hello world", "a <|endoftext|> b </s>", "\u6f22\u5b57 caf\u00e9 \U0001f600", "x" * 300, "  two  spaces\n"]


def expected(name, text):
    if not text:
        return 0
    if name == "word_bpe_49k":
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(vocabularies.path("word_bpe_49k.json"))
        t.encode_special_tokens = True
        return len(t.encode(text, add_special_tokens=False).ids)
    if name == "piece_bpe_32k":
        import sentencepiece

        return len(sentencepiece.SentencePieceProcessor(model_file=vocabularies.path("piece_bpe_32k.model")).encode(text))
    import tiktoken

    with open(vocabularies.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return len(enc.encode_ordinary(text))


def test_counts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, content string").repartition(3)
    out = add_token_counts(df)
    assert out.columns == ["id", "content", *default_vocabularies()]
    for r in out.collect():
        for name in default_vocabularies():
            assert r[name] == expected(name, TEXTS[r["id"]]), (name, TEXTS[r["id"]])


def test_text_crosses_to_python_once(spark):
    df = spark.createDataFrame([(1, "a")], "id long, content string")
    plan = add_token_counts(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("count_tokens(") == 1


def test_missing_vocabulary(spark):
    df = spark.createDataFrame([(1, "a")], "id long, content string")
    both = {
        "piece_bpe_32k": default_vocabularies()["piece_bpe_32k"],
        "gone": Vocabulary("gone", "json", "/no/such/file.json"),
    }
    with pytest.raises(FileNotFoundError):
        add_token_counts(df, both)
    assert add_token_counts(df, both, missing="zero").collect()[0]["gone"] == 0
    assert add_token_counts(df, both, missing="skip").columns == ["id", "content", "piece_bpe_32k"]
