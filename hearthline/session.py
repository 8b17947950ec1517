"""Session settings the pipeline relies on, and shared-storage staging."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


_FIRST_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
NO_LIMIT = str(2**31 - 1)


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings: UTC session clock, adaptive execution, fine shuffles.

    Adaptive execution joins small partitions of a shuffle, but doesn't split the large ones of an
    aggregate or a window. So a shuffle begins with many: what a task holds is then set by the
    advisory size, not by the input.

    Arrow batches end by their number of rows alone: a limit in bytes is worked out anew for every row,
    which takes longer than the rest of its way to Python. Rows of telemetry are small.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    if spark.conf.get(_FIRST_PARTITIONS, None) is None:
        named = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set(_FIRST_PARTITIONS, str(max(named, min(16 * named, 1000))))
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, NO_LIMIT)
    return spark


def first_partitions(spark: SparkSession) -> int:
    """Partitions that a shuffle begins with."""
    return int(spark.conf.get(_FIRST_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("hearthline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


_folder: str | None = None


def use_folder(path: str | None) -> None:
    """Name the shared folder for sessions without ``spark.checkpoint.dir``."""
    global _folder
    _folder = path


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, else the one named by ``use_folder``."""
    named = spark.conf.get("spark.checkpoint.dir", None) or _folder
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share, or name one with use_folder")
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/hearthline/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to shared storage once and continue from the written table.

    For a frame with several consumers this replaces repeated computation by one write,
    cuts lineage, and survives lost executors; readers still prune columns.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
