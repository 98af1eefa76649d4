"""Combining repeated passes over a document: (doc, pass, key, value) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.emptiness import empty_pass

STRATEGIES = ("union", "first_non_empty", "highest_confidence", "intersection", "majority")


def vote(df: DataFrame, doc: str, strategy: str = "union", pass_no: str = "pass", key: str = "key", value: str = "value", confidence: str | None = None) -> DataFrame:
    """(doc, key, value) by strategy.

    union and first_non_empty take a key's first value; highest_confidence the one of most ``confidence``
    (without such a column, the first); intersection needs a value in every pass of the document and
    majority in more than half: both take the most frequent value, of equally frequent ones the one
    seen first. A document with one pass is returned as it is.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; choose one of {', '.join(STRATEGIES)}")
    # a document's passes are counted on their own, one row for each document; that isn't the shuffle of its values
    there = ~empty_pass(F.col(value))
    passes = df.groupBy(doc).agg(F.count_distinct(pass_no).alias("_passes"))
    if strategy in ("intersection", "majority"):
        counted = df.groupBy(doc, key, value).agg(F.count("*").alias("_n"), F.min(pass_no).alias("_first"))
        best = F.max_by(F.when(there, F.col(value)), F.when(there, F.struct("_n", -F.col("_first"))))
        merged = counted.groupBy(doc, key).agg(best.alias("_v"), F.sum(F.when(there, F.col("_n")).otherwise(0)).alias("_have"), F.max_by(value, "_first").alias("_only"))
        enough = F.col("_have") == F.col("_passes") if strategy == "intersection" else F.col("_have") * 2 > F.col("_passes")
    else:
        at = F.when(there, F.struct(F.coalesce(F.col(confidence), F.lit(0.0)), -F.col(pass_no)) if confidence and strategy == "highest_confidence" else F.struct(-F.col(pass_no)))
        merged = df.groupBy(doc, key).agg(F.max_by(F.when(there, F.col(value)), at).alias("_v"), F.count_if(there).alias("_have"), F.max_by(value, pass_no).alias("_only"))
        enough = F.col("_have") > 0
    one = F.col("_passes") == 1
    return merged.join(passes, doc).where(one | enough).select(doc, key, F.when(one, F.col("_only")).otherwise(F.col("_v")).alias(value))
