"""Tables that are written once to the folder which the driver and all executors share, and read back from there.

A summary that several detectors start from is computed once, lineage ends at its files, and a lost executor costs no more than its
running tasks.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


class Store:
    """Stored tables of one run. ``drop`` deletes them all when nothing reads them any more."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = f"{root or shared_folder(spark)}/summaries-{uuid.uuid4().hex}"
        self.written = 0

    def put(self, df: DataFrame, name: str = "table") -> DataFrame:
        self.written += 1
        path = f"{self.root}/{self.written}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.drop()


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written and read back, in a store of its own."""
    return Store(df.sparkSession).put(df, name)
