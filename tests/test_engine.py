from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from fieldspark import cli
from fieldspark.functions.mime import mime_of
from fieldspark.operators import mapper
from fieldspark.plans.config import Config, load
from fieldspark.plans.engine import Engine, extra_keys
from fieldspark.plans.extractors import CallableExtractor, RuleExtractor, ask
from fieldspark.sources import files
from fieldspark.streaming import landing

TEXT = {"type": "string"}
SCHEMA = {"type": "object", "properties": {"email": TEXT, "license": TEXT, "contact": {"type": "object", "properties": {"ipv4": TEXT, "phone": TEXT}}}}
ROWS = [(1, "Mail a@b.org now. Host 10.0.0.1 is up. Licensed under CC BY 4.0."), (2, "Nothing here."), (3, None)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


def records(result):
    return {r.doc_id: json.loads(r.data) for r in result.data.collect()}


def test_rules_and_report(spark, docs):
    config = Config(adaptive=False, provenance=True, pricing='{"rules": {"input_per_1k": 1, "output_per_1k": 2}}')
    out = Engine(spark, config=config).extract(docs, SCHEMA)
    got = records(out)
    assert got[1]["email"] == "a@b.org" and got[1]["license"] == "Licensed under CC BY 4.0" and got[1]["contact"]["ipv4"] == "10.0.0.1"
    assert got[2].get("email") is None and 3 not in got  # a null text has no chunk, so nothing is asked
    report = {r.doc_id: r for r in out.report.collect()}
    assert report[1].n_calls == 1 and report[1].n_failed == 0 and report[1].cost_usd > 0
    traced = {(r.doc_id, r.field): r.citation for r in out.provenance.collect()}
    assert traced[1, "email"].startswith("Mail a@b.org now.")


def test_second_pass_fills_nested_gaps(spark, docs):
    def shy(text, schema, prompt):
        data, _ = RuleExtractor().extract(text, schema, prompt)
        return data if "Still missing" in prompt else {"email": data.get("email")}

    out = Engine(spark, CallableExtractor(shy), Config(missing_threshold=0.2)).extract(docs, SCHEMA)
    got = records(out)
    assert got[1]["contact"] == {"ipv4": "10.0.0.1"} and got[1]["email"] == "a@b.org" and got[1]["license"]
    assert {r.doc_id: r.n_calls for r in out.report.collect()} == {1: 2, 2: 2}


def test_items_retry_and_dedup(spark, docs):
    schema = {"type": "array", "items": {"type": "object", "properties": {"name": TEXT, "n": {"type": "integer"}}, "required": ["name"]}}

    def lists(text, schema, prompt):
        again = "earlier attempt" in prompt
        return {"items": [{"name": "A", "n": 1}, {"name": " a "}, *([{"name": "B"}] if again else [])], "extraction_metadata": {"items_found": 2, "extraction_complete": again, "completeness_confidence": 0.5 if not again else 1.0, "reason": "cut"}}

    out = Engine(spark, CallableExtractor(lists), Config(completeness_retry=True)).extract(docs, schema)
    rows = out.data.where("doc_id = 1").orderBy("item").collect()
    assert [json.loads(r.data)["name"] for r in rows] == ["A", "B"] and [r.item for r in rows] == [0, 1] and not rows[0].faults


def test_failures_are_rows(spark, docs):
    def broken(text, schema, prompt):
        if "Mail" in text:
            raise ValueError("no")
        return {"email": "x@y.zz"}

    out = Engine(spark, CallableExtractor(broken), Config(adaptive=False, multipass=True, passes=2)).extract(docs, SCHEMA)
    assert records(out) == {1: {}, 2: {"email": "x@y.zz", "contact": None, "license": None}} or records(out)[2]["email"] == "x@y.zz"
    assert {(r.doc_id, r.error.type) for r in out.errors.collect()} == {(1, "ValueError")}
    with pytest.raises(Exception, match="no"):
        Engine(spark, CallableExtractor(broken), Config(adaptive=False, fail_fast=True)).extract(docs, SCHEMA)


def test_ask_retries_and_validates():
    calls, waits = [], []

    class Moody:
        def extract(self, text, schema, prompt):
            calls.append(prompt)
            if len(calls) == 1:
                raise TimeoutError
            return ({"a": 1} if len(calls) < 3 else {"a": "x"}), {"requests": 1, "input_tokens": 5}

    a = ask(Moody(), "t", {"type": "object", "properties": {"a": TEXT}, "required": ["a"]}, "p", Config(), waits.append)
    assert (a.data, a.attempts, a.rounds, a.warnings, a.usage["input_tokens"], len(waits)) == ({"a": "x"}, 3, 1, [], 10, 1)
    assert "Correct the earlier answer" in calls[2]

    class Never:
        def extract(self, text, schema, prompt):
            raise ConnectionError("down")

    with pytest.raises(ConnectionError):
        ask(Never(), "t", {"type": "object"}, "p", Config(max_retries=3), waits.append)
    assert len(waits) == 3
    bad = ask(CallableExtractor(lambda *_: {}), "t", {"type": "object", "required": ["a"]}, "p", Config(max_validation_rounds=1))
    assert bad.warnings == ["a: required"] and bad.rounds == 1


def test_timeout():
    import time

    with pytest.raises(TimeoutError, match="no answer"):
        ask(CallableExtractor(lambda *_: time.sleep(0.5)), "t", {"type": "object"}, "p", Config(timeout_secs=0.05, max_retries=1))


def test_chunks_follow_the_budget(spark):
    text = "A sentence of some words. " * 8000
    docs = spark.createDataFrame([(1, text), (2, "short.")], "doc_id long, text string")
    chunks = Engine(spark, config=Config(model="gpt-4")).chunks(docs, "doc_id", SCHEMA).collect()
    assert sum(r.doc_id == 1 for r in chunks) > 10 and "".join(r.text for r in sorted(chunks, key=lambda r: r.chunk_id) if r.doc_id == 1) == text


def test_improvements(spark):
    data = spark.createDataFrame([('{"extra": {"vat": 1, "iban": 2}}',), ('{"extra": {"vat": 3}}',), ("{}",)], "data string")
    assert {r.key: r.n for r in extra_keys(data).collect()} == {"vat": 2, "iban": 1}


def test_map_with_errors(spark):
    df = spark.createDataFrame([(i,) for i in range(6)], "i long").withColumn("x", F.col("i"))
    rows = {r.i: r for r in mapper.map_with_errors(df, ["i"], "x", lambda x: 10 // (x - 2)).collect()}
    assert rows[4].result == "5" and rows[2].error.type == "ZeroDivisionError" and "Traceback" in rows[2].error.traceback
    with pytest.raises(Exception, match="ZeroDivision"):
        mapper.map_with_errors(df, ["i"], "x", lambda x: 1 // x, fail_fast=True).collect()
    assert "and 2 more" in str(mapper.ProcessingError([f"e{i}" for i in range(7)]))


def test_config():
    found = load({"FIELDSPARK_PASSES": "5", "FIELDSPARK_MULTIPASS": "true", "FIELDSPARK_MISSING_THRESHOLD": "0.4"})
    assert (found.passes, found.multipass, found.missing_threshold) == (5, True, 0.4) and found.but(multipass=False, model=None).multipass is False
    with pytest.raises(ValueError):
        Config(passes=0)


def workbook() -> bytes:
    out = io.BytesIO()
    head = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="One"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t></t></si><si><t>two</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", head + '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="B2"><v>7</v></c><c r="D2" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "b.xlsx").write_bytes(workbook())
    (tmp_path / "d.png").write_bytes(b"\x89PNG")
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("x/same.txt", "first")
        z.writestr("y/same.txt", "second")
        z.writestr("dir/", "")
    paths = [str(tmp_path / n) for n in ("c.zip", "a.txt", "b.xlsx", "d.png")]
    parts = files.parts(files.read_files(spark, paths)).orderBy("file_ord", "member_ord").collect()
    assert [r.kind for r in parts] == ["text", "text", "text", "text", "image"] and parts[0].path.endswith("c.zip!x/same.txt")
    assert "second" in parts[1].text and "caf\xe9" in parts[2].text and "### One\n\t\ttwo\n\t7\t\tin" in parts[3].text and parts[4].content == b"\x89PNG"
    flat = files.flattened(files.parts(files.read_files(spark, paths)).withColumn("g", F.lit(1)), "g").first()
    assert flat.text.index("first") < flat.text.index("second") < flat.text.index("### One") and [p.mime for p in flat.payloads] == ["image/png"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.read_files(spark, str(tmp_path / "none.txt"))
    assert files.cell_place("BC12") == (12, 55) and files.cell_place("?") == (1, 1) and mime_of("nope") == "application/octet-stream"


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    (tmp_path / "s.json").write_text(json.dumps(SCHEMA))
    (tmp_path / "a.txt").write_text("Write to a@b.org.")
    (tmp_path / "b.txt").write_text("Write to c@d.org.")
    assert cli.main(["extract", str(tmp_path / "a.txt"), "--schema", str(tmp_path / "s.json")]) == 0
    assert json.loads(capsys.readouterr().out)["data"]["email"] == "a@b.org"
    assert cli.main(["batch", str(tmp_path / "a.txt"), str(tmp_path / "b.txt"), "--schema", str(tmp_path / "s.json")]) == 0
    assert {v["data"]["email"] for v in json.loads(capsys.readouterr().out).values()} == {"a@b.org", "c@d.org"}
    with pytest.raises(SystemExit):
        cli.main(["extract", "x"])


def test_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.txt").write_text("Write to a@b.org.")
    engine, out = Engine(spark, config=Config(adaptive=False)), str(tmp_path / "out")
    for name in ("b", "c"):
        landing.extract_stream(landing.landing_texts(spark, str(inbox)), engine, SCHEMA, out, str(tmp_path / "cp")).awaitTermination()
        (inbox / f"{name}.txt").write_text(f"Write to {name}@b.org.")
    got = {json.loads(r.data).get("email") for r in spark.read.parquet(out).collect()}
    assert got == {"a@b.org", "b@b.org"}


def test_second_pass_of_a_deep_schema(spark, docs):
    schema, value = {"type": "object", "properties": {"leaf": TEXT, "other": TEXT}}, {"leaf": "x"}
    for k in range(7):
        schema, value = {"type": "object", "properties": {f"n{k}": schema}}, {f"n{k}": value}
    out = Engine(spark, CallableExtractor(lambda text, schema, prompt: value)).extract(docs.where("doc_id = 1"), schema)
    got = records(out)[1]
    for k in reversed(range(7)):
        got = got[f"n{k}"]
    assert got["leaf"] == "x"


def test_files_keep_the_order_of_their_paths(spark, tmp_path, monkeypatch):
    for name in ("data.txt", "a.txt", "x/a.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("HOME", str(tmp_path))
    rows = files.read_files(spark, ["data.txt", "a.txt", "~/x/a.txt"]).orderBy("file_ord").collect()
    assert [bytes(r.content).decode() for r in rows] == ["data.txt", "a.txt", "x/a.txt"]


def test_broken_archives_are_told(spark, tmp_path):
    (tmp_path / "bad.zip").write_bytes(b"PK no archive")
    row = files.parts(files.read_files(spark, [str(tmp_path / "bad.zip")])).first()
    assert "BadZipFile" in row.error and row.text is None and bytes(row.content) == b"PK no archive"


def test_too_many_failed_passes(spark):
    from fieldspark.plans.engine import MultiPassError

    def fails(text, schema, prompt):
        if "bad" in text and "Pass 1 " not in prompt:
            raise ValueError("no")
        return {"a": text}

    df = spark.createDataFrame([(1, "good"), (2, "bad")], "doc_id long, text string")
    schema = {"type": "object", "properties": {"a": {"type": "string"}}}
    run = lambda **how: Engine(spark, CallableExtractor(fails), Config(multipass=True, max_workers=2, max_retries=1, **how)).extract(df, schema)
    out = run()
    assert {r.doc_id: r.data for r in out.data.collect()} == {1: '{"a":"good"}', 2: '{"a":"bad"}'}
    assert {r.doc_id: r.n_failed_passes for r in out.report.collect()} == {1: 0, 2: 2}
    assert [r.doc_id for r in run(fail_threshold=1).data.collect()] == [1]
    with pytest.raises(MultiPassError) as raised:
        run(fail_threshold=0, fail_fast=True)
    assert raised.value.failed == 1 and [r.doc_id for r in raised.value.result.data.collect()] == [1]


def test_chunks_are_told_their_place(spark):
    seen = lambda text, schema, prompt: {"a": [prompt.split("\n")[0][:40]]}
    df = spark.createDataFrame([(1, "One. " * 40), (2, "Two.")], "doc_id long, text string")
    schema = {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "string"}}}}
    words = lambda text: F.length(text) * 1000
    engine = Engine(spark, CallableExtractor(seen), Config(adaptive=False, max_workers=2), counter=words)
    got = {r.doc_id: json.loads(r.data)["a"] for r in engine.extract(df, schema, "Go.", least=50).data.collect()}
    assert len(got[2]) == 1 and "part" not in got[2][0]
    assert len(got[1]) == 5 and all(x.startswith(f"This is part {i + 1} of about") for i, x in enumerate(got[1]))


def test_retries_read_the_pages_around_what_was_found(spark):
    """Only the chunk with an item and its neighbours are read again, and the one that was unsure."""

    def lists(text, schema, prompt):
        again = "earlier attempt" in prompt
        items = [{"name": w} for w in text.split() if w.startswith("item") or (again and w.startswith("late"))]
        return {"items": items, "extraction_metadata": {"items_found": len(items), "extraction_complete": again or "item" not in text, "completeness_confidence": 1.0, "reason": "r"}}

    pages = [f"--- PAGE {n} --- {w} filler." for n, w in enumerate(("late1", "late2", "item3", "late4", "late5"), 1)]
    df = spark.createDataFrame([(1, " ".join(pages))], "doc_id long, text string")
    schema = {"type": "array", "items": {"type": "object", "properties": {"name": {"type": "string"}}}}
    words = lambda text: F.length(text) * 1000
    engine = Engine(spark, CallableExtractor(lists), Config(completeness_retry=True, max_workers=2), counter=words)
    got = [json.loads(r.data)["name"] for r in engine.extract(df, schema, least=30).data.collect()]
    assert sorted(got) == ["item3", "late2", "late4"]


def test_wide_schemas_by_size(spark):
    seen = lambda text, schema, prompt: {k: str(len(schema["properties"])) for k in schema["properties"]}
    schema = {"type": "object", "properties": {f"x{i}": {"type": "string"} for i in range(22)}}
    df = spark.createDataFrame([(1, "short"), (2, "long " * 11_000)], "doc_id long, text string")
    out = Engine(spark, CallableExtractor(seen), Config(adaptive=False, max_workers=2)).extract(df, schema)
    assert {r.doc_id: {*json.loads(r.data).values()} for r in out.data.collect()} == {1: {"22"}, 2: {"15", "7"}}


def test_batch_and_improvements(spark):
    df = spark.createDataFrame([(1, 0, "a.txt", "x"), (1, 1, "b.txt", "y"), (2, 0, "c.txt", "z")], "group_id long, file_ord int, path string, text string")
    say = lambda text, schema, prompt: {"a": "1", "extra": {"colour": "red"}}
    told = []
    schema = {"type": "object", "properties": {"a": {"type": "string"}}}
    out = Engine(spark, CallableExtractor(say), Config(adaptive=False, max_workers=2)).batch_improved(df, schema, lambda p: told.append(p) or {"prompt": "better"}, "Go.")
    assert out["improved_user_prompt"] == "better" and out["improved_schema"] == schema and '"colour": 2' in told[0]


def test_json_logs():
    import io

    from fieldspark.logs import setup_logging

    out = io.StringIO()
    log = setup_logging("INFO", out)
    log.info("read %d files", 3, extra={"run": "r1"})
    log.debug("not shown")
    line = json.loads(out.getvalue())
    assert (line["message"], line["run"], line["level"]) == ("read 3 files", "r1", "info")
