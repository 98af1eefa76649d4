"""From documents to training tokens: five stages, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame;
all but the last return the columns of documents.

Odd cases go through the stages as follows. A null, empty or blank text ends in the first, as nothing is left of
it. Very long texts are taken whole. Rows that repeat in id and text go or stay together until near_dedup, which
treats them as one document, so they come out as often as they went in. Ties go to the least (doc_id, text hash),
null ids first. An empty table gives an empty result in every stage. Further columns pass through all stages but
the last, which keeps doc_id, lang and source.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fieldspark.llm import bpe, decontaminate, linededup, quality, simhash
from fieldspark.llm.shared import read
from fieldspark.session import shared_folder, ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, and the documents that they deplete, null and blank texts among them; repeated rows share their fate."""
    return quality.quality_rules(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and documents of which nothing is left; a null text passes, the least doc_id keeps a run."""
    return linededup.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least doc_id; null and blank texts pass."""
    return simhash.near_dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts pass, and an empty benchmark takes none."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens and offsets of what is left, a row for each row; a null text has nulls, an empty one no tokens."""
    return bpe.encode(docs, keep=["doc_id", "lang", "source"])


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

#: SimHash, edit matching and BPE can't be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents in sf_dir."""
    ship_package(spark)
    folder, docs = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", read(spark, sf_dir, "documents")
    done: list[str] = []
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        for old in done:  # what has been read by a later stage is no longer needed
            _remove(spark, old)
        done, docs = [path], spark.read.parquet(path)
    return docs
