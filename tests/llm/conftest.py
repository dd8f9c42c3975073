import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, bucket string, fp string, code string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, ties, whole copies, a long text, and further
    columns that are called like the operators' own."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    texts = [
        (1, f"{base}\n{base}\nlast line here\n"), (2, f"{base}\n{base}\nlast line here\nmore"), (3, None), (4, ""), (5, " \t\n"), (6, "one two"), (7, base), (7, base), (8, base.upper()),
        (None, "no id at all, but some words to keep"), (None, None), (9, "word " * 5000), (10, "größe ▁ \U0001f600 ﬀ\x00 end\r\nx"), (11, "Under the MIT License. Apache License, Version 2.0 cc-by-nc"), (12, "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0\nx"),
    ]
    rows = [(i, t, None if n % 3 == 0 else "en", None if n % 4 == 0 else "s", None, "x", "y", "z", "c") for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
