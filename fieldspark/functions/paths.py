"""Values at dotted paths of JSON records, as JSON text so that their types stay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.emptiness import empty_placeholder


def json_path(path: str) -> str:
    return "$" + "".join("['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']" for p in path.split("."))


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once, however often fn names it; a plain Column would be copied to each place."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def value_at(record: Column, path: str) -> Column:
    """JSON text of the value at a path of a VARIANT; null if a step is missing or isn't an object."""
    return F.to_json(F.try_variant_get(record, json_path(path), "variant"))


def quoted(text: Column) -> Column:
    """JSON text of a string; null for a null."""
    return F.when(text.isNotNull(), F.regexp_replace(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', "$1"))


def unquoted(value: Column) -> Column:
    """The string that a JSON text stands for; other values as they are, null for JSON null."""
    return F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")


def long_form(df: DataFrame, keys: list[str], record: str, paths: list[str]) -> DataFrame:
    """(keys, ord, path, value): one row for each path of each record; value is null where nothing is."""
    parsed = df.select(*keys, F.try_parse_json(F.col(record)).alias("_v"))
    each = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(p).alias("path"), value_at(F.col("_v"), p).alias("value")) for i, p in enumerate(paths)])
    return parsed.select(*keys, F.inline(each))


def successful_leaves(record: Column, paths: list[str]) -> Column:
    """array<struct<path, value>>: the given leaves of a VARIANT that hold a value, no placeholder, in order; values as plain text."""
    rows = bound(record, lambda r: F.array(*[F.struct(F.lit(p).alias("path"), value_at(r, p).alias("value")) for p in paths]))
    there = F.filter(rows, lambda x: ~empty_placeholder(x["value"]))
    return F.transform(there, lambda x: F.struct(x["path"].alias("path"), unquoted(x["value"]).alias("value")))


def with_value(record: Column, path: str, value: Column) -> Column:
    """JSON text of an object's text with the value (JSON text) set at a path; steps that aren't objects are replaced."""
    head, _, rest = path.partition(".")
    top = F.coalesce(F.from_json(record, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    inner = with_value(F.to_json(F.try_element_at(top, F.lit(head))), rest, value) if rest else value
    kept = F.map_filter(top, lambda k, _: k != head)
    return F.to_json(F.map_concat(kept, F.create_map(F.lit(head), F.try_parse_json(inner))))


def items_of(wrapped: Column, item: str) -> Column:
    """The list under "items" of a JSON text, as array of a type; empty if it isn't a list."""
    return F.coalesce(F.from_json(wrapped, f"items array<{item}>")["items"], F.array().cast(f"array<{item}>"))


def report_of(wrapped: Column) -> Column:
    """struct<items_found, extraction_complete, completeness_confidence, reason> under "extraction_metadata" of a JSON text; its fields are null if there is none."""
    kinds = "items_found bigint, extraction_complete boolean, completeness_confidence double, reason string"
    return F.from_json(F.coalesce(F.get_json_object(wrapped, "$.extraction_metadata"), F.lit("{}")), kinds)
