from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.functions.paths import items_of, quoted, unquoted, value_at, with_value
from fieldspark.operators import merge, provenance, usage, voting
from fieldspark.operators.completeness import missing_fields
from fieldspark.operators.dedup import key_fields
from fieldspark.plans import prompts
from fieldspark.plans import schema as S
from fieldspark.plans.validate import compiled, empty_required, error_column, pruned
from fieldspark.queries.schemas import CUSTOMER, ORDER

TEXT = {"type": "string"}
PERSON = {"type": "object", "properties": {"name": TEXT, "age": {"type": "integer"}, "city": TEXT, "email": TEXT}, "required": ["name", "age"]}


def test_checks():
    assert S.check(PERSON) == []
    assert len(S.check({})) == 2 and len(S.check({"type": "object", "properties": {"a": 1}})) == 1
    for bad in ([], {"type": "array"}, {"type": "object", "properties": []}):
        with pytest.raises(ValueError):
            S.check(bad)


def test_references():
    schema = {"type": "object", "properties": {"a": {"$ref": "#/$defs/A"}}, "$defs": {"A": {"type": "object", "properties": {"x": TEXT}}}}
    assert S.inlined(schema) == {"type": "object", "properties": {"a": {"type": "object", "properties": {"x": TEXT}}}}
    schema["$defs"]["A"]["properties"]["again"] = {"$ref": "#/$defs/A"}
    with pytest.raises(ValueError, match="recursive"):
        S.inlined(schema)


def test_shapes():
    nested = {"type": "object", "properties": {f"s{i}": {"type": "object", "properties": {"f": {"type": "object", "properties": {f"x{k}": TEXT for k in range(5)}}}} for i in range(10)}}
    assert S.complexity(nested) == {"fields": 50, "depth": 3, "is_array": False, "score": pytest.approx(0.4)}
    assert S.complexity({"type": "array", "items": PERSON})["fields"] == 4
    assert [*S.leaves(CUSTOMER)] == ["name", "segment", "contact.phone", "contact.email", "account.balance", "account.nation"]
    assert "required" not in json.dumps(S.optional(CUSTOMER)) and S.unwrapped({"items": 3}) == []
    assert S.wrapped({"type": "array", "items": TEXT})["properties"]["items"]["items"] == TEXT
    assert S.split_report({"items": [1], "extraction_metadata": {"items_found": 1}}) == ([1], {"items_found": 1})
    assert S.completeness(PERSON) is PERSON
    assert set(S.with_extra(PERSON)["properties"]) == {*PERSON["properties"], "extra"}


def test_split_and_groups():
    parts = S.split(PERSON, 3)
    assert [[*p["properties"]] for p in parts] == [["name", "age", "city"], ["email"]]
    assert parts[0]["required"] == ["name", "age"] and "required" not in parts[1]
    assert S.split({"type": "object"}) == [{"type": "object"}]
    wide = {"type": "object", "properties": {f"amount_{i}": TEXT for i in range(20)} | {"claim_id": TEXT, "zzz": TEXT}}
    assert [(k, len(g["properties"])) for k, g in S.field_groups(wide).items()] == [("claim", 1), ("financial_1", 15), ("financial_2", 5), ("other", 1)]


def test_focused():
    got = S.focused(PERSON, ["age", "email"])
    assert [*got["properties"]] == ["age", "email"] and "required" not in got
    got = S.focused(CUSTOMER, ["contact.email", "account.nation"])
    assert got["properties"]["contact"]["properties"] == {"email": TEXT}
    with pytest.warns(UserWarning):
        assert S.focused(PERSON, ["nope"])["properties"] == {}


def test_spark_types():
    t = S.spark_type({"type": "object", "properties": {"a": {"type": ["integer", "null"]}, "b": {"anyOf": [TEXT, {"type": "null"}]}, "c": {"type": "array", "items": {"type": "number"}}, "d": {"type": "object"}, "e": {"anyOf": [TEXT, {"type": "integer"}]}}})
    assert [f.dataType for f in t] == [T.LongType(), T.StringType(), T.ArrayType(T.DoubleType()), T.MapType(T.StringType(), T.VariantType()), T.VariantType()]


def test_pydantic_models():
    pydantic = pytest.importorskip("pydantic")

    class Thing(pydantic.BaseModel):
        name: str
        size: int | None = None

    assert S.to_schema(Thing)["properties"]["name"]["type"] == "string"
    assert S.cast_from_model(S.cast_to_model(Thing, {"name": "x"})) == {"name": "x", "size": None}
    assert compiled(S.output_schema(Thing))({"name": "x", "size": None}) == []


@pytest.mark.parametrize(
    ("schema", "good", "bad"),
    [
        ({"type": "integer"}, [3, 3.0], [3.5, True, "3"]), ({"type": "number", "minimum": 1, "exclusiveMaximum": 5, "multipleOf": 0.5}, [1, 4.5], [0, 5, 1.2]), ({"enum": ["a", None]}, ["a", None], ["b"]), ({"const": 1}, [1], [True, 2]),
        ({"type": "string", "minLength": 2, "maxLength": 3, "pattern": "^a"}, ["ab"], ["a", "abcd", "bc"]), ({"type": "array", "items": TEXT, "minItems": 1, "maxItems": 2, "uniqueItems": True}, [["a"], ["a", "b"]], [[], ["a", "a"], [1], ["a", "b", "c"]]),
        ({"type": "object", "properties": {"a": TEXT}, "required": ["a"], "additionalProperties": False}, [{"a": "x"}], [{}, {"a": 1}, {"a": "x", "b": 1}]), ({"anyOf": [TEXT, {"type": "null"}]}, ["x", None], [1]),
        ({"oneOf": [{"type": "number"}, {"minimum": 5}]}, [1], [7]), ({"allOf": [{"minimum": 1}, {"maximum": 2}]}, [1], [3]), ({"not": {"type": "string"}}, [1], ["x"]),
    ],
)
def test_validator(schema, good, bad):
    check = compiled(schema)
    assert not any(check(v) for v in good) and all(check(v) for v in bad)


def test_unknown_keywords_are_errors():
    for bad in ({"dependentRequired": {}}, {"type": "text"}, {"properties": {"a": {"$ref": "#/other"}}}):
        with pytest.raises(ValueError):
            compiled(bad)


def test_required_and_pruned():
    assert empty_required({"name": "", "city": None}, PERSON) == ["name", "age"]
    assert empty_required([{"a": ""}], {"items": {"required": ["a"]}}) == ["0.a"]
    assert pruned({"name": "", "city": None, "email": "x"}, PERSON) == {"name": "", "email": "x"}


def test_error_column_agrees_with_the_validator(spark):
    rows = [{"id": 1, "status": "O", "price": 5000, "priority": "1-U"}, {"id": 1.5, "status": "P", "price": 1, "priority": "x" * 9}, {"status": "F", "price": "5"}, {"id": 3.0, "status": "O"}, []]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "i int, r string").select("i", error_column(F.parse_json("r"), ORDER).alias("e"))
    check = compiled(ORDER)
    for r in df.collect():
        assert sorted(r.e) == sorted(check(rows[r.i]))


def test_paths(spark):
    df = spark.createDataFrame([(json.dumps({"a": {"b": "x\n\"q\"", "n": None}, "l": [1]}),)], "r string")
    v = F.parse_json("r")
    got = df.select(value_at(v, "a.b").alias("b"), unquoted(value_at(v, "a.b")).alias("u"), value_at(v, "a.n").alias("n"), value_at(v, "a.x").alias("x"), value_at(v, "l.a").alias("l"), with_value(F.col("r"), "l.z", F.lit("5")).alias("w"), items_of(F.lit('{"items": [1, 2]}'), "int").alias("i"), items_of(F.lit('{"items": 2}'), "int").alias("j"), quoted(unquoted(value_at(v, "a.b"))).alias("q")).first()
    assert (got.n, got.x, got.l, got.i, got.j) == ("null", None, None, [1, 2], []) and got.u == 'x\n"q"' and got.q == got.b
    assert json.loads(got.w) == {"a": {"b": 'x\n"q"', "n": None}, "l": {"z": 5}}


def test_missing_is_strict(spark):
    ten = {"type": "object", "properties": {f"f{i}": TEXT for i in range(10)}}
    df = spark.createDataFrame([(n, json.dumps({f"f{i}": "x" if i >= n else "" for i in range(10)})) for n in (1, 3, 4)], "n int, r string")
    got = {r.n: r.m for r in df.select("n", missing_fields(F.parse_json("r"), S.missable(ten), None, 0.3).alias("m")).collect()}
    assert got == {1: [], 3: [], 4: ["f0", "f1", "f2", "f3"]}


def test_merge_of_mixed_types(spark):
    rows = [(1, 1, "k", '"a"'), (1, 2, "k", "[1]"), (1, 3, "k", "[2,3]"), (1, 1, "o", '{"x":1,"y":2}'), (1, 2, "o", '{"y":3}'), (1, 1, "e", "[]"), (1, 2, "e", '""'), (1, 1, "z", "0")]
    df = spark.createDataFrame(rows, "doc long, round long, key string, value string")
    by = lambda d: {r.key: r.value for r in d.collect()}
    assert by(merge.merge(df, ["doc", "key"], "first")) == {"k": '"a"', "o": '{"x":1,"y":2}', "e": '""', "z": "0"}
    assert by(merge.merge(df, ["doc", "key"], "concat")) == {"k": "[1,2,3]", "o": '{"y":3}', "z": "0"}
    assert by(merge.merge(df, ["doc", "key"], "prefer_longer"))["k"] == "[2,3]"
    chunks = {r.key: (r.value, r.source_chunks) for r in merge.merge_chunks(df, ["doc", "key"], "round").collect()}
    assert chunks["k"] == ('"a"', [1]) and json.loads(chunks["o"][0]) == {"x": 1, "y": 3} and chunks["o"][1] == [1, 2]
    with pytest.raises(ValueError):
        merge.merge(df, ["doc", "key"], "other")


def test_votes(spark):
    rows = [(1, 1, "f1", '""'), (1, 2, "f1", '"v"'), (1, 3, "f1", '"w"'), (1, 1, "f2", '"a"'), (1, 2, "f2", '"b"'), (1, 3, "f2", '"b"'), (2, 1, "f1", '""')]
    df = spark.createDataFrame(rows, "doc long, pass long, key string, value string")
    by = lambda s: {(r.doc, r.key): r.value for r in voting.vote(df, "doc", s).collect()}
    assert by("union") == {(1, "f1"): '"v"', (1, "f2"): '"a"', (2, "f1"): '""'}
    assert by("intersection") == {(1, "f2"): '"b"', (2, "f1"): '""'}
    assert by("majority") == {(1, "f1"): '"v"', (1, "f2"): '"b"', (2, "f1"): '""'}
    with pytest.raises(ValueError):
        voting.vote(df, "doc", "other")


def test_provenance(spark):
    df = spark.createDataFrame([(1, "f", 0, 0.8), (1, "f", 1, 0.95), (1, "g", 0, 0.9), (1, "g", 1, 0.9)], "doc long, field string, ord long, confidence double")
    got = {r.field: (r.ord, r.confidence) for r in provenance.merge_provenance(df, ["doc", "field"], "ord").collect()}
    assert got == {"f": (1, 0.95), "g": (0, 0.9)}
    with pytest.raises(Exception, match="confidence must lie"):
        df.select(provenance.checked_confidence(F.col("confidence") + 1)).collect()
    one = spark.createDataFrame([("The  Amount is 5",)], "t string").select(provenance.citation(F.col("t"), F.lit("AMOUNT"), 3).alias("a"), provenance.citation(F.col("t"), F.lit("none")).alias("b"), provenance.citation(F.col("t"), F.lit("")).alias("c")).first()
    assert (one.a, one.b, one.c) == ("...e Amount is...", None, None)


def test_prices_and_keys():
    assert usage.parse_prices("not json") == {} and usage.parse_prices('{"m": {"input_per_1k": 1, "output_per_1k": "2"}, "n": {}}') == {"m": (1.0, 2.0)}
    assert key_fields({"name": TEXT, "id": TEXT, "x": TEXT}) == ["id", "name"] and key_fields({"x": TEXT, "y": {"type": "number"}}) == ["x"] and key_fields({}) == []


def test_prompts():
    text = prompts.focused_prompt({f"k{i}": "v" * 60 for i in range(20)}, ["b.y", "a", "b.x"], "Do it")
    assert text.count("- k") == 15 and "v" * 47 + "..." in text and "- b: b.x, b.y" in text
    assert "Excerpt: e" in prompts.full_prompt("u", [("e", {"a": 1}), {"b": 2}]) and prompts.full_prompt() == prompts.SYSTEM
