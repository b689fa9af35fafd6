import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use inside
        T.StructField("id", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("name", T.StringType()),
    ]
)

LONG = " ".join(f"word{i * 7919 % 4001}" for i in range(30_000))
PASSAGE = " ".join(f"common{i}" for i in range(40))
EDGE_TEXTS = [
    None,
    "",
    "   \n\t ",
    "one",
    "two words",
    "a b c",
    "a b c",
    "élan vital ça où",
    "x" * 5000,
    LONG,
    LONG,
    PASSAGE + " left over here and there",
    "other start of it " + PASSAGE,
    PASSAGE,
    "same line\n" * 40,
    "Licensed under CC BY-NC 4.0.\nplain line with several words in it",
    "日本語の文章がここにあります。" * 20,
    "tab\tand\x0bvertical\x0cfeed\r\nend",
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, clashing column names."""
    rows = [(i, t, None if i % 3 else "en", [None, "b", "a", ""][i % 4], None, "id", None, "n") for i, t in enumerate(EDGE_TEXTS)]
    rows += [rows[3], rows[9], (None, "a b c", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
