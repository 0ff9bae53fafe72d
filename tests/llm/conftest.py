import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from texts: ids in order, or (id, text) pairs, with extra columns whose names clash with internal ones."""

    def make(texts, lang="en", extra=False):
        rows = [(k, t) if not isinstance(t, tuple) else t for k, t in enumerate(texts)]
        full = [(i, t, lang, "s", len(t or "")) for i, t in rows]
        docs = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for c in ("component", "kind", "u", "v", "key", "gone", "spans", "score", "x", "h", "id", "count", "first", "start", "n"):
                docs = docs.withColumn(c, F.lit(c))
        return docs

    return make
