from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def corpus(spark):
    """(doc_id, text, source) of the smallest documents table."""
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]


LONG = "lorem ipsum dolor sit amet " * 40_000
PARA = " ".join(f"w{i}" for i in range(60))
AWKWARD = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t", None, "a", 3), (4, PARA, "en", "a", 100), (4, PARA, "en", "a", 100), (5, PARA, "en", None, 100), (None, PARA, "fr", "b", 7), (4, "another text of the same id", "en", "a", 5),
    (6, LONG, "en", "b", len(LONG)), (7, "üß 漢字 🙂\x00 end", "de", "b", 3), (8, "one\ntwo\nthree\nfour", "en", "a", 1), (9, "zero\none\ntwo\nthree\nfive", "en", "a", 1),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, shared ids; with extra columns that clash with names used inside."""
    extra = "doc string, body string, key string, root string, c0 string, hash string, keep string, text_ string"
    names = [c.split()[0] for c in extra.split(", ")]
    rows = [(*r, *names) for r in AWKWARD]
    return spark.createDataFrame(rows, f"{SCHEMA}, {extra}").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
