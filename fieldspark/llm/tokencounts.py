"""Operator 2, token counts: the exact histogram of encoded lengths and its suffix sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspark.llm.bpe import SLICE, VOCABULARY, Encoder, shipped
from fieldspark.llm.shared import as_bytes, col, read, slices, small


def _count(coder_of: Callable[[], Encoder]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of()
        for batch in small(batches):
            texts = batch.column(0).drop_null()
            raw = as_bytes(texts)
            for i, j in slices(raw, SLICE):
                yield pa.RecordBatch.from_arrays([pa.array(coder.encode(raw[i:j], counts_only=True)[0])], ["tokens"])

    return count


def length_histogram(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(tokens, docs): how many documents have each encoded length. Null texts have none and are left out."""
    lengths = df.select(col(text).cast("string")).mapInArrow(_count(shipped(df.sparkSession, vocabulary)), "tokens bigint")
    return lengths.groupBy("tokens").agg(F.count("*").alias("docs"))


def length_report(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each encoded length L that occurs, with what a context limit of L means for the corpus.

    docs: documents of exactly L tokens; docs_over and tokens_over: those longer than L and their tokens;
    truncated_total: tokens left if each document is cut to L, exact as sum(min(length, L)); lost: tokens
    cut off; total_docs and total_tokens; share: the part of the documents that is no longer than L, so
    the q-quantile of the lengths is the least L with share >= q. For a limit between two lengths a < b,
    truncated_total is that of a plus (limit - a) * docs_over of a: see ``totals_at``.

    Only the histogram, one row for each distinct length, is sorted by the window.
    Nulls: null texts are left out. Empty texts have length 0. Very long texts are encoded whole. Repeated
    rows count each time. Ties: documents of the same length share a row, so there are none. An empty
    table gives no rows. Only the text column is read, so other columns can't clash.
    """
    after = Window.orderBy("tokens").rowsBetween(1, Window.unboundedFollowing)
    every = Window.orderBy("tokens").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    h = length_histogram(df, text, vocabulary).withColumn("mass", F.col("tokens") * F.col("docs"))
    h = h.select(
        "tokens", "docs", F.coalesce(F.sum("docs").over(after), F.lit(0)).alias("docs_over"), F.coalesce(F.sum("mass").over(after), F.lit(0)).alias("tokens_over"),
        F.sum("docs").over(every).alias("total_docs"), F.sum("mass").over(every).alias("total_tokens"),
    )
    lost = F.col("tokens_over") - F.col("tokens") * F.col("docs_over")
    return h.select("*", (F.col("total_tokens") - lost).alias("truncated_total"), lost.alias("lost"), (1 - F.col("docs_over") / F.col("total_docs")).alias("share"))


def totals_at(report: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, truncated_total, docs_over) for any context limits, exact, from a ``length_report``."""
    spark = report.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(x,) for x in sorted(set(limits))], "`limit` bigint"))
    below = report.join(wanted, F.col("tokens") <= F.col("limit")).groupBy("limit").agg(F.max_by(F.struct("tokens", "docs_over", "truncated_total"), "tokens").alias("r"))
    whole = report.agg(F.max("total_docs").alias("n"))
    return wanted.join(below, "limit", "left").crossJoin(F.broadcast(whole)).where(F.col("n").isNotNull()).select(
        "limit",
        F.coalesce(F.col("r.truncated_total") + (F.col("limit") - F.col("r.tokens")) * F.col("r.docs_over"), F.col("limit") * F.col("n")).alias("truncated_total"),
        F.coalesce("r.docs_over", "n").alias("docs_over"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lengths of all documents."""
    return length_report(read(spark, sf_dir, "documents"))
