import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, and columns whose names the operators use."""
    same = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen " * 20
    rows = [
        (1, same, "en", "a", 1), (2, same, "en", "a", 1), (2, same, "en", "a", 1), (3, same + "end", "en", None, None),
        (None, None, None, None, None), (4, "", "de", "b", 0), (5, " \t\n ", "de", "b", 4), (6, None, "de", "b", None),
        (7, "ein wort", None, "c", 8), (None, same, "en", "c", 2), (8, "wörter " * 30_000, "de", "c", 1), (9, "x", "fr", "é", 1),
        (10, "x", "fr", "é", 1), (11, "12 345 !!", "fr", "d", 9), (12, "😀 ſ ß İ", "de", "d", 7), (13, "a\x00b c", "en", "d", 5),
    ]
    df = spark.createDataFrame(rows, DOCS)
    clash = {"fp": "7", "tag": "'t'", "size": "1", "copies": "2", "target": "3", "score": "0.5", "drawn_by": "1", "ids": "array(1)", "_size": "1", "part": "0",
             "component_id": "5", "a b": "1"}
    return df.selectExpr("*", *(f"{v} AS `{k}`" for k, v in clash.items()))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
