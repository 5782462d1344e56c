"""A keyed store of rows as Parquet, and results kept by name and version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigwright.runtime import shared_dir


class KeyedStore:
    """Rows of one table by key: the last value put for a key counts."""

    def __init__(self, spark: SparkSession, path: str, key: str = "gid"):
        self.spark, self.path, self.key = spark, path, key

    def put(self, rows: DataFrame, version: int = 0) -> None:
        """Adds rows, sorted by key so that reads by key skip row groups; larger versions replace smaller ones."""
        rows.withColumn("__version", F.lit(version)).repartitionByRange(self.key).sortWithinPartitions(self.key).write.mode("append").parquet(self.path)

    def _live(self) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        columns = [c for c in rows.columns if c not in (self.key, "__version")]
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*columns), "__version").alias("r"))
        return newest.select(self.key, "r.*")

    def get(self, key) -> DataFrame:
        return self._live().filter(F.col(self.key) == key)

    def scan(self, low=None, high=None) -> DataFrame:
        """Rows in order of keys, from low and below high where given."""
        rows = self._live()
        if low is not None:
            rows = rows.filter(F.col(self.key) >= low)
        if high is not None:
            rows = rows.filter(F.col(self.key) < high)
        return rows.orderBy(self.key)

    def with_sequence(self) -> DataFrame:
        """Rows of genes that have a sequence."""
        return self.scan().filter("has_seq")


def remembered(spark: SparkSession, name: str, version: int, make: Callable[[], DataFrame], folder: str | None = None) -> DataFrame:
    """The result of make(), written under name and version the first time and read afterwards; the copy of the
    version before is removed."""
    folder = folder or f"{shared_dir(spark)}/remembered"
    path = lambda v: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}-{v}")
    files = path(version).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}-{version}/_SUCCESS")):
        make().write.mode("overwrite").parquet(path(version).toString())
    # only now is there something in its place
    files.delete(path(version - 1), True)
    return spark.read.parquet(path(version).toString())


def total_size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files below a folder, in any store that Spark reads; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first().n
