"""Helpers that several operators share: tables, shared scratch space, staged frames."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from hearthline.session import ARROW_BYTES, NO_LIMIT

_own_folder: str | None = None


ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_ROWS = 2000  # whole texts are large rows: batches of Spark's default length crowd the workers
BATCH_BYTES = 4 << 20  # a run of long texts ends a batch sooner; a longer text is a batch of its own


def _text_batches(spark: SparkSession) -> None:
    if int(spark.conf.get(ARROW)) > ARROW_ROWS or int(spark.conf.get(ARROW)) <= 0:
        spark.conf.set(ARROW, str(ARROW_ROWS))
    if spark.conf.get(ARROW_BYTES, None) in (None, "", NO_LIMIT):
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the session's Arrow batches are kept short enough for whole texts."""
    _text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors reach.

    Only a single-machine session without the setting gets a folder of its own; on a
    cluster the setting is required.
    """
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="llm-")
    return _own_folder


def scratch(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/llm/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder once and read from there.

    Cuts the lineage: a lost executor costs no more than rereading files.
    """
    _text_batches(df.sparkSession)
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def drop_staged(*frames: DataFrame) -> None:
    """Delete staged frames that no later step reads."""
    for df in frames:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/llm/" not in folder:
                raise ValueError(f"{folder} isn't a staged frame")
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
