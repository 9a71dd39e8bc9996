import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", ".."))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


ODD = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here " * 3, "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog and runs far away from here " * 3, "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \n\t ", "en", None),
    (6, "äöü ß " * 40 + "ende", "de", "a"),
    (7, "x" * 300_000, "en", "a"),
    (8, "one two", None, "b"),
    (8, "one two", None, "b"),
    (None, "a row without an id that has a few words more than five", "en", "a"),
    (9, "123 456 !!", "en", "c"),
    (10, "line one has words\nline one has words\nline one has words\n" * 5, "en", "c"),
    (11, "<|endoftext|> \x1c odd   separators \x85 and 한글 \U0001f600", "en", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank, very long and repeated rows, and columns whose names clash with results."""
    rows = [(*r, 7, "x", 1) for r in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_words int, key string, part int")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.filter("false")
