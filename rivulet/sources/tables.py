"""Tables on shared storage, through Spark's own readers and writers.

A versioned table is a directory of immutable Parquet snapshots and a log of changes, both partitioned by version, so
earlier versions, replays and tails are partition filters. A version counts once its row in the ``commits`` table is
written, which is the last step; what a failed writer left is not listed there and is ignored.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.errors import OutOfWindow, UnknownTable
from rivulet.sources.shared import claim

READERS = ("parquet", "orc", "csv", "json", "text", "avro")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema=None, **options) -> DataFrame:
    if kind not in READERS:
        raise UnknownTable(f"no reader for {kind}")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commits(self) -> DataFrame:
        """(version, tx_ts) of what is committed."""
        try:
            return self.spark.read.schema("version long, tx_ts timestamp").parquet(f"{self.path}/commits").dropDuplicates(["version"])
        except AnalysisException:
            return self.spark.createDataFrame([], "version long, tx_ts timestamp")

    def latest(self) -> int:
        return self.commits().agg(F.max("version")).first()[0] or 0

    def commit(self, rows: DataFrame, changes: DataFrame | None = None) -> int:
        """Write the next version. Its number is claimed first, so writers at the same time get different ones; the number of a
        writer that failed is never used again."""
        version = self.latest() + 1
        while not claim(self.spark, f"{self.path}/claims/{version}"):
            version += 1
        rows.write.mode("overwrite").parquet(f"{self.path}/snapshots/version={version}")
        if changes is not None:
            changes.write.mode("overwrite").parquet(f"{self.path}/changes/version={version}")
        stamp = self.spark.range(1).select(F.lit(version).cast("long").alias("version"), F.current_timestamp().alias("tx_ts"))
        stamp.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return version

    def snapshot(self, version: int | None = None, timestamp=None) -> DataFrame:
        """The live table, or an earlier one; newer than the newest is the live one."""
        seen = self.commits()
        if version is not None:
            seen = seen.where(F.col("version") <= version)
        if timestamp is not None:
            seen = seen.where(F.col("tx_ts") <= F.lit(timestamp))
        found = seen.agg(F.max("version")).first()[0]
        if found is None:
            raise OutOfWindow("nothing is committed at that point")
        try:
            return self.spark.read.parquet(f"{self.path}/snapshots/version={found}")
        except AnalysisException as e:
            raise OutOfWindow(f"version {found} is no longer retained") from e

    def changes(self, after: int = 0) -> DataFrame:
        """The log of later versions, in whole."""
        log = self.spark.read.option("basePath", f"{self.path}/changes").parquet(f"{self.path}/changes")
        return log.where(F.col("version") > after).join(self.commits().select("version"), "version", "left_semi")

    def copy_to(self, path: str) -> None:
        """A backup: the live snapshot and the whole log under another root, as its first version."""
        try:
            log = self.changes()
        except AnalysisException:
            log = None  # nothing was logged
        VersionedTable(self.spark, path).commit(self.snapshot(), log if log is None else log.withColumnRenamed("version", "of_version"))


def put_blobs(df: DataFrame, column: str, path: str) -> DataFrame:
    """Rows with a content hash in place of the payload; new payloads are appended to the side table by hash."""
    spark = df.sparkSession
    hashed = df.withColumn("_hash", F.sha2(column, 256))
    payloads = hashed.select("_hash", F.col(column).alias("payload")).dropDuplicates(["_hash"])
    try:
        payloads = payloads.join(spark.read.parquet(path).select("_hash"), "_hash", "left_anti")
    except AnalysisException:
        pass  # the first payloads
    payloads.write.mode("append").parquet(path)
    return hashed.drop(column).withColumnRenamed("_hash", column)


def get_blobs(df: DataFrame, column: str, path: str) -> DataFrame:
    blobs = df.sparkSession.read.parquet(path)
    return df.join(blobs, df[column] == blobs["_hash"], "left").drop("_hash")
