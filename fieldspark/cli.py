"""python -m fieldspark extract FILE... | batch GROUP...: records as JSON. A group is files with commas between."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from pathlib import Path

from pyspark.sql import functions as F

from fieldspark.plans.config import load
from fieldspark.plans.engine import Engine, Result
from fieldspark.session import local_session
from fieldspark.sources.files import parts, read_files


def load_model(name: str) -> type:
    """The class that module:Class or module.Class names."""
    module, _, attribute = name.partition(":") if ":" in name else name.rpartition(".")
    try:
        return getattr(importlib.import_module(module), attribute)
    except (ImportError, AttributeError, ValueError) as e:
        raise argparse.ArgumentTypeError(f"no such class: {name}") from e


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fieldspark", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("extract", "batch"):
        c = commands.add_parser(name)
        c.add_argument("files", nargs="+")
        what = c.add_mutually_exclusive_group(required=True)
        what.add_argument("--schema", help="file with a JSON Schema")
        what.add_argument("--pydantic-model", type=load_model, help="module:Class")
        c.add_argument("--prompt", default="")
        c.add_argument("--examples", help="file with a JSON list of examples")
        c.add_argument("--include-extra", action="store_true")
        c.add_argument("--model")
        c.add_argument("--out", help="folder for the records, reports and errors as JSON lines; without it they are printed")
        if name == "batch":
            c.add_argument("--max-concurrency", type=int)
    return p


def shown(result: Result, group: str) -> dict:
    data: dict[str, list] = {}
    for row in result.data.toLocalIterator():
        data.setdefault(str(row[group]), []).append(json.loads(row["data"]))
    report = {str(r[group]): {k: v for k, v in r.asDict().items() if k != group} for r in result.report.toLocalIterator()}
    return {g: {"data": d[0] if len(d) == 1 else d, "report": report.get(g)} for g, d in data.items()}


def main(args: list[str] | None = None) -> int:
    found = parser().parse_args(args)
    schema = found.pydantic_model or json.loads(Path(found.schema).read_text())
    examples = json.loads(Path(found.examples).read_text()) if found.examples else None
    groups = [found.files] if found.command == "extract" else [f.split(",") for f in found.files]
    config = load().but(model=found.model, max_concurrency=getattr(found, "max_concurrency", None))
    spark = local_session()
    files = None
    for i, paths in enumerate(groups):
        rows = parts(read_files(spark, paths)).withColumn("group_id", F.lit(i))
        files = rows if files is None else files.unionByName(rows)
    result = Engine(spark, config=config).batch(files, schema, found.prompt, examples=examples, extra=found.include_extra)
    if found.out:  # nothing is gathered on the driver
        for name in ("data", "report", "errors"):
            getattr(result, name).write.mode("overwrite").json(f"{found.out}/{name}")
        return 0
    out = shown(result, "group_id")
    json.dump(out["0"] if found.command == "extract" and "0" in out else out, sys.stdout, indent=2, ensure_ascii=False, default=str)
    print()
    return 0
