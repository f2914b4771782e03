"""Exact quantiles by group, however large a group is: selection by refining histograms.

Groups of few values are aggregated as they are. In any other, nothing is sorted or held: a group's values are counted in cells of a weakly rising function of the value, which partial aggregation does before any shuffle.
Running counts over a group's cells tell which cells hold the wanted ranks; only their values are counted again, by value, or in finer
cells first where they are many. A cell of one value needs no look inside. So a group that has most rows of a
table is never one task's sort, nor held in memory; its cells are a few hundred for each power of two that its values span.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Store

#: Cells for each power of two, in the first histogram, and of equal width, in a finer one.
STEPS, FINE_CELLS = 256, 4096
#: More than the cells from 1 down to the smallest number.
OFFSET = 1 << 19
#: Values of a group that an aggregation may hold at once.
MOST_HELD = 100_000
#: Groups of more values than this are few enough to be broadcast.
FEW_FROM = 10_000


def first_cell(value: Column) -> Column:
    """A whole number that never falls while the value rises."""
    size = F.floor(F.log2(F.abs(value)) * STEPS) + OFFSET
    return F.when(value > 0, size).when(value < 0, -size).otherwise(0).cast("long")


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which NULL equals itself; the keys' columns stay once."""
    renamed = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    joined = left.join(renamed, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_{k}" for k in keys])


def few(groups: DataFrame, most: int) -> DataFrame:
    """A row or some for each group of more than ``most`` values: where that is many values, such groups are few, and the values needn't be shuffled to meet them."""
    return F.broadcast(groups) if most >= FEW_FROM else groups


def group_quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], sizes: DataFrame | None = None, most: int = MOST_HELD, rounds: int = 1, store: Store | None = None) -> DataFrame:
    """``keys``, ``n`` and a column for each of ``shares``: linearly interpolated quantiles of the measured values, exact.

    A NULL key is a group like any other; groups without a measured value have no row. Groups of more than ``most`` values go through
    histograms; ``sizes`` (``keys, n``) tells them apart where it is known already. ``rows`` is read several times: store what is
    costly to make. Where all groups are of one kind, nothing is read for the other.
    """
    store = store or Store(rows.sparkSession)
    data = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    sizes = store.put(data.groupBy(*keys).agg(F.count("*").alias("n")), "sizes") if sizes is None else sizes
    large = few(sizes.where(F.col("n") > most).select(*keys), most)
    sift = not large.isEmpty()
    both = sift and not sizes.where(F.col("n") <= most).isEmpty()
    sifted = sifted_quantiles(same(data, large, keys, "left_semi") if both else data, keys, shares, rounds, most, store) if sift else None
    if sift and not both:
        return sifted
    held = same(data, large, keys, "left_anti") if both else data
    q = F.percentile("v", F.array(*[F.lit(s) for s in shares.values()]))
    out = held.groupBy(*keys).agg(F.count("*").alias("n"), q.alias("q")).select(*keys, "n", *[F.col("q")[i].alias(name) for i, name in enumerate(shares)])
    return out.unionByName(sifted) if both else out


def sifted_quantiles(data: DataFrame, keys: list[str], shares: dict[str, float], rounds: int = 1, most: int = 0, store: Store | None = None, held: int = MOST_HELD) -> DataFrame:
    """As ``group_quantiles``, of groups of any size, or of more than ``most`` values, from rows ``keys, v``.

    The picked cells are stored, so that rows are read once to count them and once to look inside. A cell of up to ``held`` values is
    counted by value at once; one of more is cut into finer cells first, up to ``rounds`` times.
    """
    store = store or Store(data.sparkSession)

    def place(share: float) -> Column:
        return F.lit(share) * (F.col("n") - 1)

    ranks = [r for s in shares.values() for r in (F.floor(place(s)), F.ceil(place(s)))]
    wanted = reduce(Column.__or__, [(r >= F.col("begin")) & (r < F.col("upto")) for r in ranks])
    cell, own = [*keys, "cell"], Window.partitionBy(*keys)

    def by_value(cells: DataFrame) -> DataFrame:
        last = same(data.select(*cell, "v"), few(cells.select(*cell, "n", F.col("begin").alias("before")), most), cell)
        last = last.groupBy(*cell, "n", "before", "v").agg(F.count("*").alias("c"))
        upto = F.col("before") + F.sum("c").over(Window.partitionBy(*cell).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        return last.withColumn("upto", upto).select(*keys, "n", (F.col("upto") - F.col("c")).alias("begin"), "upto", "v")

    data = data.withColumn("cell", first_cell(F.col("v")))
    counted = data.groupBy(*cell).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    upto = F.sum("c").over(own.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    picked = counted.withColumns({"n": F.sum("c").over(own), "upto": upto}).withColumn("begin", F.col("upto") - F.col("c")).where(wanted)
    known = []
    for finer in range(rounds, -1, -1):
        picked = store.put(picked, "cells")
        known.append(picked.where("lo = hi").select(*keys, "n", "begin", "upto", F.col("lo").alias("v")))
        inner, wide = picked.where("lo < hi"), picked.where((F.col("lo") < F.col("hi")) & (F.col("c") > held))
        if finer == 0 or wide.isEmpty():
            known.append(by_value(inner))
            break
        known.append(by_value(inner.where(F.col("c") <= held)))
        inside = same(data.select(*cell, "v"), few(wide.select(*cell, "n", F.col("begin").alias("before"), "lo", "hi"), most), cell)
        fine = F.least(F.lit(FINE_CELLS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * FINE_CELLS)).cast("long")
        data = inside.select(*keys, "v", F.struct("cell", fine.alias("fine")).alias("cell"), "n", "before")
        counted = data.groupBy(*cell, "n", "before").agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.col("before") + F.sum("c").over(Window.partitionBy(*keys, "cell.cell").orderBy("cell.fine").rowsBetween(Window.unboundedPreceding, 0))
        picked = counted.withColumn("upto", upto).withColumn("begin", F.col("upto") - F.col("c")).where(wanted)

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("begin")) & (rank < F.col("upto")), F.col("v")))

    ends = {name: (at(F.floor(place(s))), at(F.ceil(place(s)))) for name, s in shares.items()}
    found = reduce(DataFrame.unionByName, known).groupBy(*keys, "n").agg(*[c.alias(f"_{name}_{i}") for name, pair in ends.items() for i, c in enumerate(pair)])
    between = {name: F.col(f"_{name}_0") + (F.col(f"_{name}_1") - F.col(f"_{name}_0")) * (place(s) - F.floor(place(s))) for name, s in shares.items()}
    return found.select(*keys, "n", *[c.alias(name) for name, c in between.items()])
