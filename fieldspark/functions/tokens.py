"""Token estimates and how many chunks a document needs; plain arithmetic on columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Context limits; the longest key that a model's name holds decides.
LIMITS = {
    1_000_000: ("gemini-1.5-flash", "gemini-1.5-pro"), 200_000: ("claude-3-haiku", "claude-3-opus", "claude-3-sonnet", "claude-3-5-sonnet"),
    128_000: ("gpt-4-turbo", "gpt-4o", "gpt-4o-mini"), 32_000: ("gemini-pro",), 16_385: ("gpt-3.5-turbo",), 8_192: ("gpt-4",),
}
DEFAULT_LIMIT = 100_000
#: Share of a model's limit that a call may use, and tokens that every call needs besides.
BUDGET, OVERHEAD = 0.3, 1000


def count_tokens(text: Column, counter: Callable[[Column], Column] | None = None) -> Column:
    """Tokens by a counter of the caller's (a tokenizer's UDF, say), else a quarter of the characters, which needs no vocabulary."""
    return (F.floor(F.length(text) / 4) if counter is None else counter(text)).cast("long")


def file_tokens(kind: Column, text: Column, size: Column, model: Column) -> Column:
    """By kind of file: text by its characters, images a fixed number, all else by its bytes; 0 for a missing file."""
    by_size = F.floor(size / 4).cast("long")
    image = F.when(F.lower(model).contains("claude"), 1600).otherwise(765).cast("long")
    return F.when(kind.isin("text", "pdf"), F.coalesce(count_tokens(text), by_size)).when(kind == "image", image).otherwise(F.coalesce(by_size, F.lit(0)))


def limits_table(spark: SparkSession) -> DataFrame:
    """(key, model_limit), one row for each known model."""
    return spark.createDataFrame([(k, v) for v, keys in LIMITS.items() for k in keys], "key string, model_limit long")


def model_limit(model: Column) -> Column:
    """The limit of a model by the longest key in its name."""
    out = F.lit(DEFAULT_LIMIT).cast("long")
    for key, limit in sorted(((k, v) for v, keys in LIMITS.items() for k in keys), key=lambda x: len(x[0])):
        out = F.when(F.lower(model).contains(key), limit).otherwise(out)
    return out


def estimate(df: DataFrame, file: Column, schema: Column, prompt: Column, examples: Column, model: Column, array_schema: bool = False, budget: float = BUDGET) -> DataFrame:
    """df with file_tokens, total_tokens, model_limit, effective_limit, utilization, needs_chunking and recommended_chunks.

    A root-array schema is always chunked, in two at least.
    """
    extra = schema + prompt + examples + F.lit(OVERHEAD)
    out = df.withColumns({"file_tokens": file, "_extra": extra, "model_limit": model_limit(model)})
    out = out.withColumns({"total_tokens": F.col("file_tokens") + F.col("_extra"), "effective_limit": F.floor(F.col("model_limit") * F.lit(budget)).cast("long")})
    room = F.col("effective_limit") - F.col("_extra")
    needs = F.col("total_tokens") > F.col("effective_limit")
    parts = F.when(~needs | (room <= 0), F.lit(1).cast("long")).otherwise(F.greatest(F.lit(2).cast("long"), F.floor(F.col("file_tokens") / room).cast("long") + 1))
    return out.select(
        *df.columns, "file_tokens", "total_tokens", "model_limit", "effective_limit", (F.col("total_tokens") / F.col("model_limit")).alias("utilization"),
        (F.lit(True) if array_schema else needs).alias("needs_chunking"), (F.greatest(F.lit(2).cast("long"), parts) if array_schema else parts).alias("recommended_chunks"),
    )


def chunk_fields(n_fields: Column, doc_size: Column, least: int = 30, none_below: int = 20, large: int = 50_000) -> Column:
    """Whether a schema is better extracted group by group."""
    return (n_fields >= least) | ((n_fields > none_below) & (doc_size > large))
