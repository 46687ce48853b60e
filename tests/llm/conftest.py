import pytest

#: Names that the operators use inside; they must not clash with columns that are carried along or ignored.
CLASHES = "id string, row int, kind string, start int, k1 int, bh int, score double, seg int, h1 int, _x int, digest string, h int, source string"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table with awkward extra columns."""

    def build(rows, extra=True):
        df = spark.createDataFrame([(i, t, lang) for i, t, lang in rows], "doc_id long, text string, lang string")
        if not extra:
            return df
        from pyspark.sql import functions as F

        for part in CLASHES.split(", "):
            name, kind = part.split()
            df = df.withColumn(name, F.lit("1").cast(kind))
        return df

    return build


#: Nulls, empty and very long texts, ties and repeated rows.
ODD = [(1, None, None), (2, "", "en"), (3, "a", None), (None, "the quick brown fox jumps over the lazy dog", "en"), (5, "x" * 30_000, "en"), (6, "the quick brown fox jumps over the lazy dog", "en"), (6, "the quick brown fox jumps over the lazy dog", "en"), (7, "ü 🙂 \t\n\r z ▁ _  ", "de"), (8, "word " * 30_000, "en"), (9, " ", "en")]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
