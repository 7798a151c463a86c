"""Explicit schemas: nothing is inferred from files."""

from pyspark.sql import types as T

_L, _S, _I = T.LongType(), T.StringType(), T.IntegerType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in columns.items()])


DOCUMENTS = _schema(doc_id=_L, text=_S, lang=_S, source=_S, n_chars=_L)
PAGES = _schema(page_id=_L, url=_S, html=_S)
CONVERSATIONS = _schema(conv_id=_L, turn=_L, role=_S, text=_S)
BENCHMARK = _schema(item_id=_L, text=_S)
LABELS = _schema(doc_id=_L, quality=_I, toxic=_I)
# shards as written by the enrichment stage
CORPUS = _schema(doc_id=_L, content=_S, language=_S, source=_S)
