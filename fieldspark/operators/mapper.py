"""A function over rows, with each row's error beside its result."""

from __future__ import annotations

import json
import traceback
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR = "struct<type:string,message:string,traceback:string,item:string>"
_ERROR = pa.struct([("type", pa.string()), ("message", pa.string()), ("traceback", pa.string()), ("item", pa.string())])
REPR_CHARS = 200


class ProcessingError(RuntimeError):
    """Some rows failed. Shows the first five."""

    def __init__(self, errors: list[str]):
        self.errors = errors
        more = f"\n... and {len(errors) - 5} more" if len(errors) > 5 else ""
        super().__init__("\n".join(errors[:5]) + more)


def describe(error: BaseException, item: object) -> dict[str, str]:
    text = repr(item)
    return {"type": type(error).__name__, "message": str(error), "traceback": "".join(traceback.format_exception(error)), "item": text[:REPR_CHARS]}


def map_with_errors(df: DataFrame, keys: list[str], column: str, fn: Callable[[Any], Any], result: str = "result", fail_fast: bool = False, workers: int | None = None) -> DataFrame:
    """keys, result (JSON text of what fn returns, null at failures) and error (null where it worked).

    Rows keep no order; keys tell them apart. fail_fast fails the job at the first error. workers: tasks
    in which the rows are spread; by default they stay in their partitions.
    """
    plain = df.select(*keys, F.col(column).alias("_item"))
    if workers:
        plain = plain.repartition(workers)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema[:-1]), f"`{result}` string", f"error {ERROR}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results, errors = [], []
            for item in batch.column(len(keys)).to_pylist():
                try:
                    results.append(json.dumps(fn(item), default=str))
                    errors.append(None)
                except Exception as e:
                    if fail_fast:
                        raise
                    results.append(None)
                    errors.append(describe(e, item))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(results, pa.string()), pa.array(errors, _ERROR)], [*keys, result, "error"])

    return plain.mapInArrow(run, schema)


def counts(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, total, succeeded, failed)."""
    return df.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))
