"""Addresses against nested networks as a merge of two sorted sides: one look-up an address, however many prefix lengths a feed has.

Networks nest or are disjoint, so they cut the addresses into elementary ranges, in each of which one network is the innermost.
Networks and addresses are dealt out together by ranges of their keys. A network that reaches into later ranges is told to these: at any
place no more networks are open than there are prefix lengths. Within a range a stack turns the networks into elementary ranges in
one pass, and the addresses find theirs by binary search.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.shared import Store

# Functions travel to the executors with their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Addresses and networks of a range, about.
ROWS_OF_RANGE = 1_000_000
#: Longer than any key and the mark behind it.
KEY_BYTES = 34


def ordered_key(key: Column) -> Column:
    """Keys of both families in one order."""
    return F.concat(F.when(F.length(key) == 8, "4").otherwise("6"), key)


def elementary_ranges(first: list[bytes], last: list[bytes], bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(where each elementary range begins, the innermost network there or -1), for networks in any order.

    A range behind a network begins at its last key with a mark, which no key lies between.
    """
    begins: list[bytes] = []
    inner: list[int] = []
    around: list[int] = []

    def close(before: bytes | None) -> None:
        while around and (before is None or last[around[-1]] < before):
            begins.append(last[around.pop()] + b"!")
            inner.append(around[-1] if around else -1)

    for i in sorted(range(len(first)), key=lambda i: (first[i], bits[i])):
        close(first[i])
        around.append(i)
        begins.append(first[i])
        inner.append(i)
    close(None)
    return np.array(begins, f"S{KEY_BYTES}"), np.array(inner, np.int64)


def networks(indicators: DataFrame) -> DataFrame:
    """``key, last, prefix, indicator, indicator_kind``: first and last key of each network or single address of a feed, each once."""
    host, stated = F.split_part("value", F.lit("/"), F.lit(1)), F.split_part("value", F.lit("/"), F.lit(2)).try_cast("int")
    keyed = indicators.where("kind in ('ip', 'cidr')").select("value", "kind", stated.alias("stated"), S.address_key(host).alias("own")).where("own is not null")
    sized = keyed.select("value", "kind", F.coalesce("stated", 4 * F.length("own")).alias("prefix"), "own")
    based = sized.select("value", "kind", "prefix", S.network_key(F.col("own"), F.col("prefix")).alias("base")).where("base is not null")
    named = F.min_by(F.struct(F.col("value").alias("indicator"), F.col("kind").alias("indicator_kind")), F.struct(F.col("kind") != "ip", "value"))
    one = based.groupBy("base", "prefix").agg(named.alias("hit"))
    return one.select(ordered_key(F.col("base")).alias("key"), ordered_key(S.network_last(F.col("base"), F.col("prefix"))).alias("last"), F.col("prefix").cast("int").alias("prefix"), "hit.indicator", "hit.indicator_kind")


def match_ranges(addresses: DataFrame, indicators: DataFrame, column: str = "value", store: Store | None = None, rows_of_range: int = ROWS_OF_RANGE) -> DataFrame:
    """Distinct addresses of either family with the innermost indicator that holds them: ``column, indicator, indicator_kind, prefix``.

    The driver sees the first key of each range. What isn't an address has no row; nor has an address that no network holds.
    """
    spark = addresses.sparkSession
    store = store or Store(spark)
    none = F.lit(None).cast("string")
    seen = store.put(addresses.select(F.col(column).alias("value")).distinct().select("value", ordered_key(S.address_key(F.col("value"))).alias("key")).where("key is not null"), "addresses")
    nets = store.put(networks(indicators), "networks")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + (seen.count() + nets.count()) // rows_of_range)
    both = nets.withColumn("value", none).unionByName(seen.select("key", none.alias("last"), F.lit(None).cast("int").alias("prefix"), none.alias("indicator"), none.alias("indicator_kind"), "value"))
    placed = store.put(both.repartitionByRange(ranges, "key").withColumn("part", F.spark_partition_id()), "ranges")
    firsts = placed.groupBy("part").agg(F.min("key").alias("first")).collect()
    bounds = F.array(*[F.struct(F.lit(r["part"]).alias("part"), F.lit(r["first"]).alias("first")) for r in firsts]) if firsts else F.array().cast("array<struct<part:int,first:string>>")
    reached = F.explode(F.filter(bounds, lambda b: (b["first"] > F.col("key")) & (b["first"] <= F.col("last")))).alias("b")
    reaching = placed.where("last is not null").select(*[c for c in placed.columns if c != "part"], reached).withColumn("part", F.col("b.part")).drop("b")

    def look_up(rows: pa.Table) -> pa.Table:
        is_net = rows.column("last").is_valid()
        nets, asked = rows.filter(is_net), rows.filter(pc.invert(is_net))
        begins, inner = elementary_ranges([k.encode() for k in nets.column("key").to_pylist()], [k.encode() for k in nets.column("last").to_pylist()], nets.column("prefix").to_pylist())
        keys = np.array([k.encode() for k in asked.column("key").to_pylist()], f"S{KEY_BYTES}")
        at = np.searchsorted(begins, keys, "right") - 1
        found = np.where(at >= 0, inner[np.maximum(at, 0)], -1) if len(begins) else np.full(len(keys), -1)
        kept = np.flatnonzero(found >= 0)
        hit = nets.take(pa.array(found[kept]))
        return pa.table({"value": asked.column("value").take(pa.array(kept)), **{c: hit.column(c) for c in ("indicator", "indicator_kind", "prefix")}})

    hits = placed.unionByName(reaching.select(*placed.columns)).groupBy("part").applyInArrow(look_up, "value string, indicator string, indicator_kind string, prefix int")
    return hits.withColumnRenamed("value", column)
