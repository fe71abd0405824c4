import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    return SF


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, and columns named as the operators' own."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(6000))
    rows = [
        (1, long, "a"), (1, long, "a"), (2, None, "a"), (None, "a null id with a text of its own", None), (None, None, None), (3, "", "b"), (4, " \t\n ", "b"),
        (5, "one", "b"), (6, "one", None), (7, "same words " * 40, "c"), (8, "same words " * 40, "c"), (9, "idiot mail to a.b@c.example.com token=abcdef123456", "c"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("size", "slot", "score", "key", "tag", "sig", "n", "copies", "lang", "spans", "doc", "target", "at"):
        d = d.selectExpr("*", f"'x' AS {c}")
    return d


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
