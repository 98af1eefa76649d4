"""Merging partial records: (doc, round, key, value) rows with JSON text values to (doc, key, value).

first, last and the first non-empty of a pass are plain aggregates with a partial step; only the strategies
that join values collect them, ordered by round. All shuffle once, by document and key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldspark.functions.emptiness import empty_blank, empty_placeholder, empty_strict, falsy

Empty = Callable[[Column], Column]


def _kind(v: Column) -> Column:
    return F.substring(v, 1, 1)


def _glued(a: Column, b: Column, between: str, hollow: str) -> Column:
    """Two JSON strings, lists or objects as one; either may be ``hollow``."""
    whole = F.concat(F.substring(a, F.lit(1), F.length(a) - 1), F.lit(between), F.substring(b, F.lit(2), F.length(b)))
    return F.when(a == hollow, b).when(b == hollow, a).otherwise(whole)


def _length(v: Column) -> Column:
    text = F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")
    return F.when(_kind(v) == '"', F.length(text)).otherwise(F.json_array_length(v))


def _concat(acc: Column, v: Column) -> Column:
    both = F.concat(_kind(acc), _kind(v))
    return F.when(both == '""', _glued(acc, v, " ", "")).when(both == "[[", _glued(acc, v, ",", "[]")).otherwise(v)


def _longer(acc: Column, v: Column) -> Column:
    sized = _kind(acc).isin('"', "[") & _kind(v).isin('"', "[")
    return F.when(sized & (_length(v) <= _length(acc)), acc).otherwise(v)


def _overlay(acc: Column, v: Column) -> Column:
    """Objects: the later one's keys win, one level deep."""
    kinds = "map<string,variant>"
    a, b = F.from_json(acc, kinds), F.from_json(v, kinds)
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b))


def _chunk_step(acc: Column, v: Column) -> Column:
    both = F.concat(_kind(acc), _kind(v))
    return F.when(both == "[[", _glued(acc, v, ",", "[]")).when(both == "{{", _overlay(acc, v)).otherwise(acc)


def _folded(df: DataFrame, keys: list[str], round_: str, value: str, empty: Empty, step: Callable[[Column, Column], Column]) -> DataFrame:
    kept = df.where(~empty(F.col(value)))
    rows = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(round_).alias("r"), F.col(value).alias("v")))).alias("_rows"))
    out = F.aggregate("_rows", F.lit(None).cast("string"), lambda acc, x: F.when(acc.isNull(), x["v"]).otherwise(step(acc, x["v"])))
    return rows.select(*keys, out.alias(value), F.transform("_rows", lambda x: x["r"]).alias("_rounds"))


def merge_first(df: DataFrame, keys: list[str], round_: str = "round", value: str = "value", empty: Empty = empty_strict) -> DataFrame:
    """The first value that isn't empty; a key that never has one keeps its last empty value."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.coalesce(F.min_by(F.when(~empty(v), v), F.when(~empty(v), F.col(round_))), F.max_by(v, round_)).alias(value))


def merge_groups(df: DataFrame, keys: list[str], round_: str = "round", value: str = "value", key: str = "key") -> DataFrame:
    """Results of field groups: as merge_first, zero and false are empty, and keys that begin with _ are left out."""
    return merge_first(df.where(~F.col(key).startswith("_")), keys, round_, value, falsy)


def merge(df: DataFrame, keys: list[str], strategy: str, round_: str = "round", value: str = "value") -> DataFrame:
    """Conflicting values by strategy: first, last, concat or prefer_longer. Keys without a value are absent, but for first.

    concat joins strings by a blank and lists end to end; prefer_longer keeps the earlier of equally long
    ones; both take the later value of other pairs.
    """
    v = F.col(value)
    if strategy == "first":
        return merge_first(df, keys, round_, value)
    if strategy == "last":
        return df.where(~empty_strict(v)).groupBy(*keys).agg(F.max_by(v, round_).alias(value))
    steps = {"concat": _concat, "prefer_longer": _longer}
    if strategy not in steps:
        raise ValueError(f"unknown strategy {strategy!r}; choose first, last, concat or prefer_longer")
    return _folded(df, keys, round_, value, empty_strict, steps[strategy]).select(*keys, value)


def merge_chunks(df: DataFrame, keys: list[str], chunk: str = "chunk", value: str = "value") -> DataFrame:
    """Chunks of a document: lists end to end, objects overlaid, else the first value. With the source_chunks that count."""
    out = _folded(df, keys, chunk, value, empty_blank, _chunk_step)
    many = _kind(F.col(value)).isin("[", "{")
    return out.select(*keys, value, F.when(many, F.col("_rounds")).otherwise(F.slice("_rounds", 1, 1)).alias("source_chunks"))


def merge_items(df: DataFrame, doc: str, chunk: str, pos: str) -> DataFrame:
    """Items of a root array from all chunks in order, with their index in the merged list."""
    return df.withColumn("item", F.row_number().over(W.partitionBy(doc).orderBy(chunk, pos)) - 1)


def merge_report(df: DataFrame, doc: str, key: str = "key", round_: str = "round", value: str = "value") -> DataFrame:
    """(doc, key, first_round, n_rounds): where each key first has a value, and in how many rounds."""
    return df.where(~empty_strict(F.col(value))).groupBy(doc, key).agg(F.min(round_).alias("first_round"), F.count_distinct(round_).alias("n_rounds"))


def keys_per_round(df: DataFrame, doc: str, key: str = "key", round_: str = "round", value: str = "value") -> DataFrame:
    """(doc, round, n_keys, keys): the keys that have a value in each round."""
    return df.where(~empty_strict(F.col(value))).groupBy(doc, round_).agg(F.count("*").alias("n_keys"), F.array_sort(F.collect_list(key)).alias("keys"))


def merge_passes(first: DataFrame, second: DataFrame, on: list[str], targets: Column, value: str = "value") -> DataFrame:
    """The first pass with those target paths of the second that have a value."""
    both = first.select(*on, F.col(value).alias("_a")).join(second.select(*on, F.col(value).alias("_b")), on, "full")
    take = F.coalesce(targets, F.lit(False)) & ~empty_placeholder(F.col("_b"))
    return both.select(*on, F.when(take, F.col("_b")).otherwise(F.col("_a")).alias(value), (take & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("updated"))
