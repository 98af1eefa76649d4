"""Session helpers shared by queries, tests and the bench."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: str = "8", shuffle: int = 8, memory: str = "12g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    ship_package()
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession | None = None) -> None:
    """Let Python workers import this package, wherever the driver was started from."""
    def joined(old: str) -> str:
        parts = [p for p in old.split(os.pathsep) if p]
        return os.pathsep.join(parts if ROOT in parts else [ROOT, *parts])

    if spark is None:
        os.environ["PYTHONPATH"] = joined(os.environ.get("PYTHONPATH", ""))
    else:
        env = spark.sparkContext.environment
        env["PYTHONPATH"] = joined(env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that the cluster names in spark.checkpoint.dir; a temporary one on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="fieldspark-")
