"""Usage and cost of calls."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prices are broadcast up to so many models; more are joined by a shuffle.
BROADCAST_MODELS = 100_000


def usage_totals(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of requests, tool_calls, input_tokens and output_tokens; total_tokens is the sum of the last two."""
    sums = {c: F.sum(F.coalesce(F.col(c), F.lit(0))) for c in ("requests", "tool_calls", "input_tokens", "output_tokens") if c in df.columns}
    out = df.groupBy(*keys).agg(*[s.alias(c) for c, s in sums.items()])
    return out.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


def summed_cost(df: DataFrame, keys: list[str], cost: str = "cost_usd") -> DataFrame:
    """(keys, cost): the cost of several passes; passes without a price don't count, and it is null if none has one."""
    return df.groupBy(*keys).agg(F.sum(cost).alias(cost))


def parse_prices(text: str | None) -> dict[str, tuple[float, float]]:
    """{model: (price of 1000 input tokens, of 1000 output tokens)}; what can't be read is left out."""
    try:
        entries = json.loads(text or "{}").items()
    except (ValueError, AttributeError):
        return {}
    out = {}
    for model, entry in entries:
        try:
            out[model] = tuple(float(entry[f"{side}_per_1k"]) for side in ("input", "output"))
        except (KeyError, TypeError, ValueError):
            continue
    return out


def price_table(spark: SparkSession, prices: dict[str, tuple[float, float]]) -> DataFrame:
    return spark.createDataFrame([(m, a, b) for m, (a, b) in prices.items()], "model string, in_per_1k double, out_per_1k double")


def with_cost(df: DataFrame, prices: dict[str, tuple[float, float]], model: str = "model") -> DataFrame:
    """df with cost_usd; null for models without a price."""
    table = price_table(df.sparkSession, prices).withColumnRenamed("model", model)
    priced = df.join(F.broadcast(table) if len(prices) <= BROADCAST_MODELS else table, model, "left")
    cost = F.col("input_tokens") / 1000 * F.col("in_per_1k") + F.col("output_tokens") / 1000 * F.col("out_per_1k")
    return priced.select(*df.columns, cost.alias("cost_usd"))
