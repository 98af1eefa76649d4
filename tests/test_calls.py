"""What a call costs besides the extractor's own work: threads, compiled schemas, looked up fields."""

from __future__ import annotations

import time

import pyarrow as pa
import pytest
from test_batches import kernel

from fieldspark import catalog
from fieldspark.plans import engine, extractors
from fieldspark.plans.config import Config
from fieldspark.plans.extractors import CallableExtractor, ask

SCHEMA = {"type": "object", "properties": {"a": {"type": "string"}, "b": {"type": "string"}}}


def counted(monkeypatch, module, name) -> list:
    made, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *args: made.append(args) or real(*args))
    return made


def test_calls_share_a_thread(monkeypatch):
    made = counted(monkeypatch, extractors, "ThreadPoolExecutor")
    assert [ask(CallableExtractor(lambda t, s, p: {"a": t}), str(i), SCHEMA, "Go.", Config()).data for i in range(20)] == [{"a": str(i)} for i in range(20)]
    assert len(made) <= 1


def test_a_call_after_a_late_one_has_a_free_thread():
    slow = CallableExtractor(lambda t, s, p: time.sleep(float(t)) or {"a": t})
    began = time.perf_counter()
    with pytest.raises(TimeoutError, match="no answer within"):
        ask(slow, "3", SCHEMA, "Go.", Config(timeout_secs=0.1, max_retries=1))
    assert ask(slow, "0", SCHEMA, "Go.", Config(timeout_secs=2, max_retries=1)).data == {"a": "0"}
    assert time.perf_counter() - began < 2


def test_schemas_are_compiled_once(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a", ["a"])], "id long, text string, paths array<string>")
    run = kernel(monkeypatch, df, lambda d: engine.call(d, ["id"], CallableExtractor(lambda t, s, p: {k: t for k in s["properties"]}), SCHEMA, paths_column="paths"))
    made = counted(monkeypatch, engine, "compiled"), counted(monkeypatch, extractors, "compiled")
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(["x"] * 40), pa.array(["Go."] * 40), pa.array([["a"], ["b"], ["a", "b"], None] * 10)], ["0", "1", "2", "3"])
    answers = [x for out in run(iter([batch])) for x in out.column(1).to_pylist()]
    assert answers == ['{"a": "x"}', '{"b": "x"}', '{"a": "x", "b": "x"}', '{"a": "x", "b": "x"}'] * 10
    assert len(made[0]) + len(made[1]) == 4


def test_requests_look_up_each_field_once(spark):
    plan = catalog.queries()["prompt_known"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get") == 12  # six leaves, once for what is known and once for what is missing
