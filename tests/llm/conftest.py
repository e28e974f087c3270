import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, extra=""):
    """A documents table of ``(doc_id, text)`` or ``(doc_id, text, source)``."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture
def docs(spark):
    return lambda rows: docs_of(spark, rows)


@pytest.fixture
def odd(spark):
    """Rows with nulls, empty and very long texts, repeated rows and columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    long = " ".join(f"word{k % 977} other{k % 13}" for k in range(40_000))
    rows = [(1, None), (2, ""), (3, "   \n\n "), (4, long), (4, long), (5, "short"), (None, None), (None, "text without id"), (6, "a" * 5000), (7, None, None)]
    df = docs_of(spark, rows)
    names = ["n_words", "score", "key", "t", "h", "root", "rep", "gone", "pos", "class_id", "kept", "spans", "label", "a", "b", "node", "y", "x"]
    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
