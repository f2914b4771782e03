"""History of look-ups that is kept between runs: each day's is added once, hunts read only the buckets they ask for.

A history is a folder of Parquet tables, ``batch=<name>/bucket=<n>/``. A batch is what one run adds, folded by ``incidents.history``.
Counts add up and times combine, so batches are never rewritten when another comes, and a hunt may read some of them only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .incidents import history, hits_of_findings, key_hits

KEYS = ("field", "key", "depth", "subject")
HITS = ("finding_id", "subject")
_NAME = re.compile(r"[A-Za-z0-9_-]+")
_SCHEMA = "field string, key string, depth int, subject string, events long, first_seen double, last_seen double, batch string, bucket int"


def _added(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("events").alias("events"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def merge_hits(before: DataFrame, more: DataFrame) -> DataFrame:
    """Hits of the same findings in two disjoint parts of a history as the hits in both together."""
    return _added(before.unionByName(more), HITS)


class History:
    """A kept history below ``path``, in ``buckets`` by field and key; the number stays that of the first batch.

    Adding a batch again replaces it, so a run that was cut off is repeated without counting anything twice. A key that very many
    subjects share fills a bucket; the rebalanced write splits it over tasks and files.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def bucket(self, field: Column, key: Column) -> Column:
        return F.pmod(F.xxhash64(field, key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, path: str) -> None:
        placed = rows.select(*KEYS, "events", "first_seen", "last_seen").withColumn("bucket", self.bucket(F.col("field"), F.col("key")))
        spread = placed.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "field", "key")
        spread.write.partitionBy("bucket").mode("overwrite").parquet(path)

    def add(self, batch: str, **logs: DataFrame) -> None:
        """Fold ``logs`` (the tables that ``incidents.history`` takes) and keep them as ``batch``; earlier batches aren't read."""
        if not _NAME.fullmatch(batch):
            raise ValueError("a batch is named by letters, digits, - and _")
        self._write(history(**logs), f"{self.path}/batch={batch}")

    def rows(self, batches: list[str] | None = None) -> DataFrame:
        """All kept rows, or those of some batches; the other batches' files aren't opened."""
        kept = self.spark.read.schema(_SCHEMA).option("basePath", self.path).parquet(self.path)
        return kept if batches is None else kept.where(F.col("batch").isin(batches))

    def compacted(self, path: str, batch: str = "all") -> History:
        """A history at ``path`` whose one batch is all of this one folded."""
        if path.rstrip("/") == self.path:
            raise ValueError("a history can't be folded into itself")
        out = History(self.spark, path, self.buckets)
        out._write(_added(self.rows(), KEYS), f"{out.path}/batch={batch}")
        return out

    def hunt(self, pivots: DataFrame, batches: list[str] | None = None) -> DataFrame:
        """``incidents.hunt`` over the kept rows."""
        return hits_of_findings(pivots, self.key_hits(pivots, batches))

    def key_hits(self, pivots: DataFrame, batches: list[str] | None = None) -> DataFrame:
        """``incidents.key_hits`` over the kept rows. Only buckets of the pivots are read: their numbers, at most ``buckets`` of
        them, come to the driver and prune the scan."""
        hit = pivots.select(self.bucket(F.col("field"), F.col("value")).alias("bucket")).distinct().collect()
        return key_hits(pivots, self.rows(batches).where(F.col("bucket").isin([r.bucket for r in hit])))
