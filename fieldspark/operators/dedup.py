"""Items of a list without repeats, by key fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY_NAMES = "id lender name legal_name entity account account_number borrower party counterparty identifier company organization".split()


def key_fields(properties: dict[str, dict]) -> list[str]:
    """The fields that tell items apart: those of the usual names, else all strings."""
    named = [k for k in KEY_NAMES if k in properties]
    return named or [k for k, p in properties.items() if isinstance(p, dict) and p.get("type") == "string"]


def normal_key(value: Column, present: Column | None = None) -> Column:
    """How a key field is compared: lower case, no white space around; null as the word none, absent as nothing."""
    text = F.lower(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("none")), r"(?U)^\s+|\s+$", ""))
    return text if present is None else F.when(present, text).otherwise("")


def dedup_items(df: DataFrame, doc: str, order: list[str], keys: list[Column]) -> DataFrame:
    """df with the first item, by ``order``, of each key of each document. Without keys, df."""
    if not keys:
        return df
    named = df.withColumns({f"_k{i}": k for i, k in enumerate(keys)})
    first = W.partitionBy(doc, *[f"_k{i}" for i in range(len(keys))]).orderBy(*order)
    return named.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").select(*df.columns)


def dedup_stats(df: DataFrame, doc: str, keys: list[Column]) -> DataFrame:
    """(doc, original, unique_items, removed), without sorting anything."""
    out = df.groupBy(doc).agg(F.count("*").alias("original"), F.count_distinct(F.struct(*keys)).alias("unique_items"))
    return out.withColumn("removed", F.col("original") - F.col("unique_items"))
