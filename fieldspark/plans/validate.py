"""Checking records against a JSON Schema: a validator for extractors, and Column forms for the common cases.

A documented subset of Draft 2020-12; a keyword outside of it is an error when the schema is compiled, so
nothing is silently left unchecked.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldspark.functions.emptiness import required_empty
from fieldspark.functions.paths import bound, value_at
from fieldspark.plans.schema import Schema, inlined

_NOTES = {"$schema", "$id", "$defs", "$comment", "title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly"}
_KNOWN = _NOTES | set("type properties required items enum const minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength pattern minItems maxItems uniqueItems additionalProperties anyOf oneOf allOf not".split())
_TYPES: dict[str, Callable[[Any], bool]] = {
    "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None, "array": lambda v: isinstance(v, list), "object": lambda v: isinstance(v, dict),
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool), "integer": lambda v: isinstance(v, int | float) and not isinstance(v, bool) and v == int(v),
}
_LIMITS: dict[str, tuple[str, Callable[[Any, Any], bool]]] = {
    "minimum": ("number", lambda v, x: v >= x), "maximum": ("number", lambda v, x: v <= x), "exclusiveMinimum": ("number", lambda v, x: v > x), "exclusiveMaximum": ("number", lambda v, x: v < x), "multipleOf": ("number", lambda v, x: abs(v / x - round(v / x)) < 1e-9),
    "minLength": ("string", lambda v, x: len(v) >= x), "maxLength": ("string", lambda v, x: len(v) <= x), "pattern": ("string", lambda v, x: re.search(x, v) is not None),
    "minItems": ("array", lambda v, x: len(v) >= x), "maxItems": ("array", lambda v, x: len(v) <= x), "uniqueItems": ("array", lambda v, x: not x or len({_canonical(i) for i in v}) == len(v)),
}


def _canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True)


def _kinds(schema: Schema) -> list[str]:
    kind = schema.get("type", [])
    return kind if isinstance(kind, list) else [kind]


def _check_keywords(node: Any, at: str) -> None:
    if not isinstance(node, dict):
        if not isinstance(node, bool):
            raise ValueError(f"{at}: a schema must be a dict or a boolean")
        return
    if "$ref" in node:
        raise ValueError(f"{at}: only references to $defs, without other keywords, can be checked")
    if unknown := set(node) - _KNOWN:
        raise ValueError(f"{at}: unknown keywords {sorted(unknown)}")
    for kind in _kinds(node):
        if kind not in _TYPES:
            raise ValueError(f"{at}: unknown type {kind!r}")
    inner = [*node.get("properties", {}).items(), *((k, x) for k in ("anyOf", "oneOf", "allOf") for x in node.get(k, [])), *((k, node[k]) for k in ("items", "not", "additionalProperties") if k in node)]
    for name, x in inner:
        _check_keywords(x, f"{at}.{name}")


def compiled(schema: Schema) -> Callable[[Any], list[str]]:
    """A function that lists what is wrong with a value, as "path: reason"."""
    root = inlined(schema)
    _check_keywords(root, "$")

    def errors(v: Any, s: Any, at: str) -> Iterator[str]:
        if isinstance(s, bool):
            if not s:
                yield f"{at}: nothing is allowed here"
            return
        if (kinds := _kinds(s)) and not any(_TYPES[k](v) for k in kinds):
            yield f"{at}: not of type {' or '.join(kinds)}"
            return
        if "enum" in s and _canonical(v) not in {_canonical(x) for x in s["enum"]}:
            yield f"{at}: not one of the listed values"
        if "const" in s and _canonical(v) != _canonical(s["const"]):
            yield f"{at}: not the constant"
        for word, (kind, ok) in _LIMITS.items():
            if word in s and _TYPES[kind](v) and not ok(v, s[word]):
                yield f"{at}: violates {word} {s[word]!r}"
        if isinstance(v, dict):
            fields = s.get("properties", {})
            yield from (f"{at}.{k}: required" for k in s.get("required", []) if k not in v)
            for k, x in v.items():
                yield from errors(x, fields[k] if k in fields else s.get("additionalProperties", True), f"{at}.{k}")
        if isinstance(v, list) and "items" in s:
            for i, x in enumerate(v):
                yield from errors(x, s["items"], f"{at}[{i}]")
        for x in s.get("allOf", []):
            yield from errors(v, x, at)
        for word, ok in (("anyOf", lambda n: n > 0), ("oneOf", lambda n: n == 1)):
            if word in s and not ok(sum(not any(errors(v, x, at)) for x in s[word])):
                yield f"{at}: violates {word}"
        if "not" in s and not any(errors(v, s["not"], at)):
            yield f"{at}: violates not"

    return lambda value: [*errors(value, root, "$")]


def pruned(value: Any, schema: Schema) -> Any:
    """value without the optional keys that hold null or an empty string."""
    if isinstance(value, list):
        return [pruned(x, schema.get("items", {})) for x in value]
    if not isinstance(value, dict):
        return value
    need, fields = schema.get("required", []), schema.get("properties", {})
    return {k: pruned(x, fields.get(k, {})) for k, x in value.items() if k in need or x not in (None, "")}


def empty_required(value: Any, schema: Schema, prefix: str = "") -> list[str]:
    """Dotted paths of required fields that are missing, null or an empty string; list positions are steps."""
    if isinstance(value, list):
        return [p for i, x in enumerate(value) for p in empty_required(x, schema.get("items", {}), f"{prefix}{i}.")]
    if not isinstance(value, dict):
        return []
    out = [prefix + k for k in schema.get("required", []) if value.get(k) in (None, "")]
    for k, s in schema.get("properties", {}).items():
        if value.get(k) not in (None, ""):
            out += empty_required(value[k], s, f"{prefix}{k}.")
    return out


def _required_paths(schema: Schema, prefix: str = "") -> Iterator[tuple[str, str]]:
    """(path, path of the object that requires it), in the order of ``empty_required``."""
    for k in schema.get("required", []):
        yield prefix + k, prefix[:-1]
    for k, s in schema.get("properties", {}).items():
        if isinstance(s, dict) and s.get("properties"):
            yield from _required_paths(s, f"{prefix}{k}.")


def empty_required_column(record: Column, schema: Schema) -> Column:
    """``empty_required`` of a VARIANT, but for fields inside lists; stays in Catalyst."""

    def checks(r: Column) -> Column:
        out = [F.lit(None).cast("string")]
        for path, above in _required_paths(inlined(schema)):
            there = F.lit(True) if not above else F.coalesce(value_at(r, above).startswith("{"), F.lit(False))
            out.append(F.when(there & required_empty(value_at(r, path)), F.lit(path)))
        return F.array(*out)

    return F.filter(bound(record, checks), lambda p: p.isNotNull())


_SHAPES = {"string": r'^"', "integer": r"^-?\d+(\.0+)?$", "number": r"^-?\d", "boolean": r"^(true|false)$", "null": r"^null$", "array": r"^\[", "object": r"^\{"}
_COLUMN_WORDS = _NOTES | set("type properties required enum minimum maximum minLength maxLength pattern".split())


def error_column(record: Column, schema: Schema) -> Column:
    """array<string>: what is wrong with a VARIANT, for schemas of nested objects and plain limits; other keywords are an error here.

    Patterns are Java's.
    """
    root = inlined(schema)
    found = bound(record, lambda r: _errors(r, root))
    return F.filter(found, lambda e: e.isNotNull())


def _errors(record: Column, root: Schema) -> Column:
    """array<string> with a null for each test that passes; each field is looked up once for all its tests."""
    parts: list[Column] = [F.array(F.lit(None).cast("string"))]

    def walk(node: Schema, path: str) -> None:
        if unknown := set(node) - _COLUMN_WORDS:
            raise ValueError(f"${path}: no Column form for {sorted(unknown)}; use compiled()")
        value = value_at(record, path[1:]) if path else F.to_json(record)
        parts.append(bound(value, lambda v: _field_errors(v, node, f"${path}")))
        if need := node.get("required", []):
            gone = lambda v: F.array(*[F.when(v.startswith("{") & value_at(record, f"{path}.{k}"[1:]).isNull(), F.lit(f"${path}.{k}: required")) for k in need])
            parts.append(bound(F.coalesce(value, F.lit("")), gone))
        for name, inner in node.get("properties", {}).items():
            walk(inner, f"{path}.{name}")

    walk(root, "")
    return F.flatten(F.array(*parts))


def _field_errors(v: Column, node: Schema, path: str) -> Column:
    there, typed, out = v.isNotNull(), F.lit(True), [F.lit(None).cast("string")]
    if kinds := _kinds(node):
        typed = v.rlike("|".join(_SHAPES[k] for k in kinds))
        out.append(F.when(there & ~typed, F.lit(f"{path}: not of type {' or '.join(kinds)}")))
    text = F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")
    string, number = v.startswith('"'), v.rlike(_SHAPES["number"])
    amount = F.when(number, v).try_cast("double")
    tests = {"minimum": lambda x: number & (amount < x), "maximum": lambda x: number & (amount > x), "minLength": lambda x: string & (F.length(text) < x), "maxLength": lambda x: string & (F.length(text) > x), "pattern": lambda x: string & ~text.rlike(x)}
    for word, broken in tests.items():
        if word in node:
            out.append(F.when(there & typed & broken(node[word]), F.lit(f"{path}: violates {word} {node[word]!r}")))
    if "enum" in node:
        out.append(F.when(there & typed & ~v.isin([json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in node["enum"]]), F.lit(f"{path}: not one of the listed values")))
    return F.array(*out)
