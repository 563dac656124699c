import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                     # names the operators use inside
                     *[T.StructField(n, T.StringType()) for n in ("row", "key", "runs", "size", "score", "plan", "sid", "root", "rank")]])


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang[, source]]) with further columns of clashing names."""
    def build(rows):
        out = []
        for r in rows:
            d, t, lang, source = (*r, *[None] * (4 - len(r)))
            out.append((d, t, lang, source, len(t) if t is not None else None, *["x"] * 9))
        return spark.createDataFrame(out, DOCS)
    return build


@pytest.fixture(scope="session")
def vectors(spark):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType())])
    return lambda rows: spark.createDataFrame([(*r, "x") for r in rows], schema)
