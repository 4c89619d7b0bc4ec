import pytest

#: Columns that operators use inside, with other types than theirs: none of them may matter.
CLASHING = {"h": 1.5, "w": "x", "row": True, "n": "n", "label": 3, "band": "b", "host": 7, "block": "c", "digest": 0.5, "kept": "no", "source": 9, "score": "s"}


@pytest.fixture
def documents(spark):
    """documents(rows): a table of (doc_id, text) with columns of clashing names, over several partitions."""
    from pyspark.sql import functions as F

    def make(rows, **columns):
        df = spark.createDataFrame([tuple(r) for r in rows], "doc_id bigint, text string").repartition(3)
        for name, value in (CLASHING | columns).items():
            df = df.withColumn(name, value if hasattr(value, "alias") else F.lit(value))
        return df

    return make


@pytest.fixture
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, a very long text, and rows that share or lack an id."""
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (None, "one two three four five six"), (None, None), (5, "é" * 40), (6, "word " * 30_000), (7, "a b c d e f g h"), (7, "a b c d e f g i"), (8, "tab\tform\x0cfeed\x0bend\r\nlast")]
