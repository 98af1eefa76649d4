"""Python kernels hold a part of a batch at once, whatever its rows and texts, and lose nothing of it."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa
import pytest

from fieldspark.operators import segment
from fieldspark.operators.batches import slices
from fieldspark.plans.engine import call
from fieldspark.plans.extractors import RuleExtractor

SIZE = 1 << 15


class Found(Exception):
    pass


def kernel(monkeypatch, df, make):
    """The function that make(df) gives to mapInArrow."""

    def stop(self, fn, schema, *more):
        raise Found(fn)

    with monkeypatch.context() as m:
        m.setattr(type(df), "mapInArrow", stop)
        with pytest.raises(Found) as found:
            make(df)
    return found.value.args[0]


def most_mb(fn, *columns) -> tuple[float, int]:
    """The MB that fn takes for one batch of these columns at most, its output left aside, and the rows that come out."""
    batch, rows = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [str(i) for i in range(len(columns))]), 0
    tracemalloc.start()
    for out in fn(iter([batch])):
        rows += out.num_rows
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6, rows


def test_slices_are_whole_rows():
    texts = ["a" * 5, None, "", "é" * 4, "b" * 30, "c", "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["0", "1"])
    got = [x.column(1).to_pylist() for x in slices(iter([batch, batch.slice(7), batch.slice(5)]), 1, 13)]
    assert got == [["a" * 5, None, "", "é" * 4], ["b" * 30], ["c", "d"], ["c", "d"]]


@pytest.mark.parametrize("n", [1, 60])
def test_tokens_of_many_and_of_long_texts(spark, monkeypatch, n):
    df = spark.createDataFrame([(1, "a")], "id long, text string")
    text = "ab, c\n" * (30 * SIZE // n // 6)
    mb, rows = most_mb(kernel(monkeypatch, df, lambda d: segment.token_rows(d, ["id"])), [*range(n)], [text] * n)
    assert rows == n * 5 * (30 * SIZE // n // 6)
    assert mb < 40  # 150 MB if tokens of all texts, or of a whole one, are held


def test_chunks_of_many_texts(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a")], "id long, text string")
    mb, rows = most_mb(kernel(monkeypatch, df, lambda d: segment.pack(d, ["id"], size=1000)), [*range(400)], ["abcd efg. " * 2500] * 400, [1000] * 400)
    assert rows == 400 * 26 and mb < 8  # the texts alone have 10 MB, and their chunks too


def test_calls_of_many_texts(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a")], "id long, text string")
    schema = {"type": "object", "properties": {"email": {"type": "string"}}}
    mb, rows = most_mb(kernel(monkeypatch, df, lambda d: call(d, ["id"], RuleExtractor(), schema)), [*range(400)], ["abcd efg. " * 2500] * 400, ["Go."] * 400, [None] * 400)
    assert rows == 400 and mb < 5  # the texts alone have 10 MB
