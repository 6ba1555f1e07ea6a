import pytest
from pyspark.sql import functions as F

ODD_DOCS = [
    (1, "Alpha beta\n  Gamma\n\nalpha BETA\n", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \t ", "en", None),
    (5, "Alpha beta", "en", "a"),
    (5, "Alpha beta", "en", "a"),
    (5, "another text under the same id", "en", "b"),
    (None, "a text without an id, alpha beta gamma", "en", "b"),
    (None, None, None, "b"),
    (6, "one " * 30000 + "two", "en", "b"),
    (7, "Äpfel ÄPFEL äpfel naïve x1y2", "de", "ü"),
]
DOCS = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids, clashing columns."""
    return spark.createDataFrame(ODD_DOCS, DOCS).withColumns(
        {
            "n_chars": F.length("text").cast("bigint"),
            "_id": F.lit("x"),
            "_key": F.lit(1),
            "rep": F.lit(2),
            "key": F.lit(3),
            "keep": F.lit(None).cast("binary"),
            "score": F.lit(0.5),
            "start": F.lit(4),
            "a.b": F.lit("dot"),
        }
    )


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("doc_id = 0")
