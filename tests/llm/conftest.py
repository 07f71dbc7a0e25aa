import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    if not os.path.isdir(SF):
        pytest.skip("needs the driver's tables")
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


#: Nulls in each column, empty, blank, long and repeated texts, repeated and missing ids, a column that clashes.
ODD = [
    (1, None, "en", 0), (2, "", "en", 0), (3, "   ", None, 0), (4, "one", "en", 3), (5, "one two three", "en", 13), (None, "a text without an id " * 3, "en", 1),
    (6, "The same text stands here twice, with enough words to make shingles.", "en", 1), (7, "The same text stands here twice, with enough words to make shingles.", None, 1), (7, "The same text stands here twice, with enough words to make shingles.", None, 1),
    (8, "word " * 30_000, "en", 1), (9, "x" * 120_000, "en", 1), (10, "é▁ü\\u0000 日本 \\n\\n- @ . +1 " * 50, "en", 1), (11, "1" * 5_000 + "." + "a" * 3_000 + "@b", "en", 1), (None, None, None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """documents with a further column named as an operator's own."""
    return spark.createDataFrame([(*r, "clash") for r in ODD], "doc_id bigint, text string, lang string, n_chars bigint, _id string").withColumnRenamed("_id", "_text")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
