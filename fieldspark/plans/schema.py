"""JSON Schemas on the driver: checking, inlining, projecting, splitting and grouping; and as a table of fields."""

from __future__ import annotations

import copy
import warnings
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Schema = dict[str, Any]

#: Groups of field names, in order; a field joins the first group one of whose parts its name holds. Names and parts are
#: those of the published behaviour, which parity needs; within a group they are in the order of the alphabet.
GROUPS: list[tuple[str, str]] = [
    ("claimant", "claimant_ customer_ insured_"), ("claim", "claim_id claim_number claim_status claim_submission"), ("incident", "damage_ incident_ loss_"), ("policy", "coverage_ deductible policy_"),
    ("financial", "amount cost payment price"), ("adjuster", "adjuster_ inspector_ reviewer_"), ("vendor", "contractor_ supplier_ vendor_"), ("dates", "_date _time created_at last_updated"),
    ("contact", "address contact email phone"), ("status", "check flag state status"), ("metadata", "attachments comments data_quality notes system_"),
]
GROUP_FIELDS = 15


def is_model(x: object) -> bool:
    """Whether x is a Pydantic model class."""
    return isinstance(x, type) and hasattr(x, "model_json_schema")


def to_schema(x: object) -> Schema:
    """The JSON Schema of a Pydantic model class, or a schema as it is."""
    return x.model_json_schema() if is_model(x) else x


def inlined(schema: Schema) -> Schema:
    """schema with references to its own $defs replaced by what they name. Recursive definitions are an error."""
    defs = schema.get("$defs", {})

    def walk(node: Any, open_: tuple[str, ...]) -> Any:
        if isinstance(node, list):
            return [walk(x, open_) for x in node]
        if not isinstance(node, dict):
            return node
        ref = node.get("$ref")
        if len(node) == 1 and isinstance(ref, str) and ref.startswith("#/$defs/") and (name := ref[8:]) in defs:
            if name in open_:
                raise ValueError(f"recursive definition: {' -> '.join([*open_, name])}")
            return walk(defs[name], (*open_, name))
        return {k: walk(v, open_) for k, v in node.items() if k != "$defs" or open_}

    return walk(schema, ())


def check(schema: Any) -> list[str]:
    """Warnings about an object schema; what can't be used raises ValueError."""
    if not isinstance(schema, dict):
        raise ValueError("a schema must be a dict")
    if schema.get("type", "object") != "object":
        raise ValueError(f"the root must be an object, not {schema['type']!r}")
    said = [f"no {k!r} at the root" for k in ("type", "properties") if k not in schema]
    fields = schema.get("properties", {})
    if not isinstance(fields, dict):
        raise ValueError("properties must be a dict")
    return said + [f"field {k!r} isn't described by a dict" for k, v in fields.items() if not isinstance(v, dict)]


def with_extra(schema: Schema) -> Schema:
    """schema with an open object ``extra`` for whatever else is found; nothing else may be added."""
    kept = {k: v for k, v in schema.items() if k in ("$schema", "$id", "$defs", "title", "description", "required")}
    bag = {"type": "object", "additionalProperties": True, "description": "Facts that the other fields have no room for"}
    return kept | {"type": "object", "properties": {**schema.get("properties", {}), "extra": bag}, "additionalProperties": False}


def output_schema(x: object, extra: bool = False) -> Schema:
    """What an extractor is asked for: checked, augmented if wished, and without references."""
    schema = to_schema(x)
    if is_array(schema):
        return inlined(schema)
    for said in check(schema):
        warnings.warn(said, stacklevel=2)
    return inlined(with_extra(schema) if extra else schema)


def is_array(schema: Schema) -> bool:
    return schema.get("type") == "array"


def wrapped(schema: Schema) -> Schema:
    """A root array as an object with ``items``, since records are objects; others as they are."""
    return {"type": "object", "properties": {"items": schema}, "required": ["items"], **({"$defs": schema["$defs"]} if "$defs" in schema else {})} if is_array(schema) else schema


def unwrapped(data: Any) -> list:
    found = data.get("items") if isinstance(data, dict) else None
    return found if isinstance(found, list) else []


def optional(schema: Schema) -> Schema:
    """schema without ``required``, in nested objects too (not inside lists): a chunk rarely holds every field."""
    out = {k: v for k, v in schema.items() if k != "required"}
    if isinstance(fields := out.get("properties"), dict):
        out["properties"] = {k: optional(v) if isinstance(v, dict) and v.get("type") == "object" else v for k, v in fields.items()}
    return out


def _part(schema: Schema, names: list[str], title: str) -> Schema:
    fields = schema["properties"]
    out = {k: schema[k] for k in ("$schema", "$defs") if k in schema}
    out |= {"type": "object", "properties": {n: fields[n] for n in names}, "title": title}
    if need := [n for n in schema.get("required", []) if n in names]:
        out["required"] = need
    return out


def split(schema: Schema, size: int = 3) -> list[Schema]:
    """schema in consecutive groups of ``size`` properties."""
    if not isinstance(schema, dict):
        raise ValueError("a schema must be a dict")
    names = [*fields] if isinstance(fields := schema.get("properties"), dict) else []
    if not names:
        return [schema]
    return [_part(schema, names[i : i + size], f"{schema.get('title', 'Record')}_Round{i // size + 1}") for i in range(0, len(names), size)]


def metadata(schema: Schema) -> dict:
    fields, need = schema.get("properties", {}), schema.get("required", [])
    return {"title": schema.get("title"), "n_properties": len(fields), "properties": [*fields], "n_required": len(need), "required": [*need]}


def group_of(name: str) -> str:
    return next((g for g, parts in GROUPS if any(p in name.lower() for p in parts.split())), "other")


def group_column(name: Column) -> Column:
    """``group_of`` for a column of names."""
    out = F.lit("other")
    for g, parts in reversed(GROUPS):
        hit = F.lit(False)
        for p in parts.split():
            hit = hit | F.lower(name).contains(p)
        out = F.when(hit, g).otherwise(out)
    return out


def field_groups(schema: Schema, most: int = GROUP_FIELDS) -> dict[str, Schema]:
    """schema by kinds of fields; a group of more than ``most`` fields is cut into numbered ones."""
    by: dict[str, list[str]] = {g: [] for g in [*(g for g, _ in GROUPS), "other"]}
    for name in schema.get("properties", {}):
        by[group_of(name)].append(name)
    out = {}
    for g, names in by.items():
        parts = [names[i : i + most] for i in range(0, len(names), most)]
        out |= {g if len(parts) == 1 else f"{g}_{i + 1}": _part(schema, p, f"{schema.get('title', 'Record')}_{g}") for i, p in enumerate(parts)}
    return out


def _is_object(node: Any) -> bool:
    return isinstance(node, dict) and node.get("type") == "object"


def leaves(schema: Schema, prefix: str = "") -> Iterator[str]:
    """Dotted paths of all fields that aren't objects with fields of their own."""
    for name, node in schema.get("properties", {}).items():
        path = f"{prefix}{name}"
        if _is_object(node) and node.get("properties"):
            yield from leaves(node, f"{path}.")
        else:
            yield path


def missable(schema: Schema) -> list[str]:
    """The leaves that can be missing: all but objects without fields."""
    return [p for p in leaves(schema) if not _is_object(field(schema, p))]


def count_leaves(schema: Schema) -> int:
    return sum(1 for _ in leaves(schema)) if _is_object(schema) and schema.get("properties") else 1


def depth(schema: Schema) -> int:
    """Nested levels of objects; 1 for a flat one."""
    return 1 + max((depth(n) for n in schema.get("properties", {}).values() if _is_object(n) and n.get("properties")), default=0)


def complexity(schema: Schema) -> dict:
    """fields, depth, whether the root is a list (whose items then count), and a score of 0 to 1."""
    array = is_array(schema)
    node = schema.get("items", {}) if array else schema
    n, d = count_leaves(node), depth(node)
    return {"fields": n, "depth": d, "is_array": array, "score": (min(n / 100, 1.0) + min(d / 10, 1.0)) / 2}


def field(schema: Schema, path: str) -> Schema | None:
    """The description of the field at a path."""
    node: Any = schema
    for name in path.split("."):
        node = node.get("properties", {}).get(name) if isinstance(node, dict) else None
    return node


def focused(schema: Schema, paths: list[str]) -> Schema:
    """schema with only the fields at the given paths, none of them required; unknown paths are left out with a warning."""
    if not _is_object(schema):
        return schema
    out = {k: copy.deepcopy(v) for k, v in schema.items() if k not in ("properties", "required")} | {"properties": {}}
    for path in paths:
        found = field(schema, path)
        if found is None:
            warnings.warn(f"no field {path!r}", stacklevel=2)
            continue
        at, node = out, schema
        *above, name = path.split(".")
        for step in above:
            node = node["properties"][step]
            at = at["properties"].setdefault(step, {k: v for k, v in node.items() if k not in ("properties", "required")} | {"properties": {}})
        at["properties"][name] = copy.deepcopy(found)
    return out


def completeness(schema: Schema) -> Schema:
    """A root array with a report on how complete it is; others as they are."""
    if not is_array(schema):
        return schema
    report = {
        "items_found": {"type": "integer"}, "extraction_complete": {"type": "boolean"}, "reason": {"type": "string"},
        "completeness_confidence": {"type": "number", "minimum": 0, "maximum": 1},
    }
    return {"type": "object", "properties": {"items": schema, "extraction_metadata": {"type": "object", "properties": report, "required": [*report]}}, "required": ["items", "extraction_metadata"]}


def split_report(data: Any) -> tuple[list, dict]:
    """Items and report of an answer to a ``completeness`` schema."""
    report = data.get("extraction_metadata") if isinstance(data, dict) else None
    return unwrapped(data), report if isinstance(report, dict) else {}


_SCALARS = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}


def spark_type(schema: Schema) -> T.DataType:
    """The Spark type of a schema without references; a null alternative only makes it nullable, other unions are VARIANT."""
    options = [x for x in schema.get("anyOf", []) if x.get("type") != "null"]
    if len(options) == 1:
        return spark_type(options[0])
    kind = schema.get("type")
    if isinstance(kind, list):
        rest = [k for k in kind if k != "null"]
        kind = rest[0] if len(rest) == 1 else None
    if kind in _SCALARS:
        return _SCALARS[kind]
    if kind == "array":
        return T.ArrayType(spark_type(schema.get("items", {})))
    if kind == "object":
        fields = schema.get("properties")
        return T.StructType([T.StructField(k, spark_type(v)) for k, v in fields.items()]) if fields else T.MapType(T.StringType(), T.VariantType())
    return T.VariantType()


def fields_table(spark: SparkSession, schema: Schema) -> DataFrame:
    """(path, parent, depth, ord, json_type, required, is_leaf): one row for each field."""
    rows: list[tuple] = []

    def walk(node: Schema, prefix: str, level: int) -> None:
        for name, f in node.get("properties", {}).items():
            inner = _is_object(f) and bool(f.get("properties"))
            rows.append((prefix + name, prefix[:-1] or None, level, len(rows), str(f.get("type", "any")), name in node.get("required", []), not inner))
            if inner:
                walk(f, f"{prefix}{name}.", level + 1)

    walk(inlined(schema), "", 1)
    return spark.createDataFrame(rows, "path string, parent string, depth int, ord int, json_type string, required boolean, is_leaf boolean")


def cast_to_model(model: type, data: Any) -> Any:
    return model.model_validate(data)


def cast_from_model(record: Any) -> Any:
    return record.model_dump() if hasattr(record, "model_dump") else record
