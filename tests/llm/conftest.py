import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = "every one of these words is part of a passage that more than one document of this corpus holds in full here"
ODD = [
    (1, "one two three four five six seven", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, "b"),
    (4, "   \n\t ", "en", None),
    (5, "one two three four five six seven", "en", "a"),
    (6, PASSAGE + " and then goes its own way", "en", "b"),
    (7, "Before it: " + PASSAGE + " " + PASSAGE, "de", "b"),
    (None, PASSAGE + " without any id", "en", "c"),
    (9, "ünï çödé 🎉 " * 40 + "mail a.b@c.example or +1 (017) 555-7713 now", "fr", "c"),
    (10, "x" * 3000 + " " + "9" * 3000, "en", "c"),
    (11, " ".join(f"word{i % 97} thing{i % 89}" for i in range(6000)), "en", "d"),
    (12, "Released under the MIT License. " + "the of and to in is it that for " * 30, "en", "d"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, copies, repeated rows and clashing extra columns."""
    docs = frame(spark, [*ODD, ODD[5], ODD[5], ODD[7]])
    extra = ("n_words", "kept", "fp", "size", "shard", "spans", "fixed", "_in", "_id", "_th", "_found", "found", "ctx", "busy", "id", "th", "label", "stats", "key", "h")
    return docs.withColumns({c: F.lit("kept as it is") for c in extra})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest table of the driver, whole."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
