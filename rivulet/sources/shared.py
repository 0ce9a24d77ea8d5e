"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rivulet.errors import EngineError

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Most bytes of one Arrow batch handed to Python: bounds a worker's memory whatever the text lengths are.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ``BATCH_BYTES``, unless the session has its own bound."""
    if spark.conf.get(_BATCH_BYTES) == "67108864b":  # the default; a user's own choice stands
        spark.conf.set(_BATCH_BYTES, f"{BATCH_BYTES}b")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a local one only where all is one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise EngineError("spark.checkpoint.dir must name a folder that all executors share")
    return found or "/tmp/rivulet-checkpoints"


def _file(spark: SparkSession, path: str):
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark._jsc.hadoopConfiguration()), file


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file, and whether it was not there yet: of several writers one gets it."""
    files, file = _file(spark, path)
    return files.createNewFile(file)


def discard(spark: SparkSession, path: str) -> None:
    files, file = _file(spark, path)
    files.delete(file, True)


def write_once(df: DataFrame, path: str, **options: str) -> None:
    """Write Parquet, and drop the shuffle files of the writing job when it ends."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(compression="zstd", **options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut in a way that outlives executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/rivulet/{label}-{uuid.uuid4().hex}"
    write_once(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
