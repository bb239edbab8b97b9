from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def few_partitions(spark: SparkSession):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(6000))

# Nulls everywhere, empty and blank texts, one very long text, ties, and a row that occurs three times.
ODD = [
    (1, "the cat sat on the mat and looked at the moon over the quiet river", "en", "a", 66),
    (1, "the cat sat on the mat and looked at the moon over the quiet river", "en", "a", 66),
    (1, "the cat sat on the mat and looked at the moon over the quiet river", "en", "a", 66),
    (2, None, "en", "a", None),
    (3, "", None, "b", 0),
    (None, "mail bob@example.org or call +1 (555) 010-9999 now", "en", None, 50),
    (None, None, None, None, None),
    (4, " \t\n\r ", "xx-YY", "b", 5),
    (5, LONG, "en", "a", len(LONG)),
    (6, "Ünïcödé 漢字 😀 text with 192.168.0.1 and 4539 1488 0343 6467 in it", "de", "", 60),
]


@pytest.fixture
def odd(spark):
    """Documents of every difficult kind, with extra columns whose names operators might like to use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, DOCS)
    clash = ("size", "key", "h", "fp", "mix_source", "mix_copy", "language_key", "pii_key", "pii_spans", "quality_row", "kept", "part", "keep_id__", "simhash_key__", "simhash_row", "own_id", "n", "line_row")
    return df.withColumns({name: F.lit("extra") for name in clash})


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)
