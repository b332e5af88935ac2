"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one where that is unset, as in local tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        at = f"{tempfile.gettempdir()}/veridelta-shared"
    return at


class Tables:
    """Tables written during one operator; survive lost executors, and are deleted when the driver ends if not before."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.at = f"{folder(spark)}/veridelta-{uuid.uuid4().hex}"
        self.n = 0
        fs, path = self._path(self.at)
        fs.mkdirs(path)  # only what exists is noted for deletion
        fs.deleteOnExit(path)

    def _path(self, at: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it again: cuts its lineage and fixes its rows."""
        self.n += 1
        at = f"{self.at}/{self.n}"
        df.write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._veridelta_path = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for t in tables:
            fs, path = self._path(t._veridelta_path)
            fs.delete(path, True)
