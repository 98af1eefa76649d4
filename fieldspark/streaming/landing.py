"""Beyond parity: files that land in a folder are extracted as they come, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldspark.operators.segment import pack
from fieldspark.plans.engine import Engine
from fieldspark.sources.files import as_text

FILES = "path string, modificationTime timestamp, length long, content binary"


def landing_texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """A stream of (path, arrived, text)."""
    raw = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).load(folder)
    return raw.select("path", F.col("modificationTime").alias("arrived"), as_text(F.col("content")).alias("text"))


def chunk_stream(texts: DataFrame, size: int = 10_000) -> DataFrame:
    """The chunks of a stream of texts; packing needs one document only, so no state is kept."""
    return pack(texts, ["path", "arrived"], "text", size)


def arrivals(texts: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window, n_files, chars): arrivals by event time; what comes later than the watermark is dropped."""
    return texts.withWatermark("arrived", late).groupBy(F.window("arrived", window).alias("w")).agg(F.count("*").alias("n_files"), F.sum(F.length("text")).alias("chars"))


def extract_stream(texts: DataFrame, engine: Engine, schema: dict, out: str, checkpoint: str, prompt: str = "") -> StreamingQuery:
    """Records of each micro-batch, written as Parquet in a folder of the batch's number, so a batch that is run again replaces its own."""

    def each(batch: DataFrame, number: int) -> None:
        engine.extract(batch, schema, prompt, doc="path").data.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return texts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
