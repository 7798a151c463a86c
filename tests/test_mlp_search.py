"""The search of the perceptron as a query: every vocabulary, scope and fold."""

from tokengauge import registry
from tokengauge.functions.tokens import default_vocabularies
from tokengauge.plans import mlp
from tokengauge.sources import schemas


def test_search_covers_every_vocabulary(spark, tmp_path, monkeypatch):
    texts = [" ".join(f"word{i * j % 7}" for j in range(3 + i % 11)) for i in range(40)]
    rows = [(i, t, "en" if i % 2 else "de", "web", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, schemas.DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(mlp, "mlp_grid", lambda: [mlp.MLPConfig((2,))])
    found = registry.queries()["mlp_cv"](spark, str(tmp_path)).select("tokenizer", "scope", "fold").distinct().collect()
    assert {tuple(r) for r in found} == {(t, s, f) for t in default_vocabularies() for s in ("all", "english") for f in range(10)}
    assert len(default_vocabularies()) == 4
