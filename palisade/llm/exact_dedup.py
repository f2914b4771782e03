"""Exact deduplication by an extendible-hash index kept in shared files (DataFrame functions only).

The index maps the 64-bit hash of a text to *entries*, one for each distinct text. Directory slots are the leading bits of
the hash. A bucket that holds more than its capacity is split by one more bit; where a bucket needs more bits than the
directory has, the directory doubles. The capacity grows with the table, so that a directory has at most 2 ** 20 slots and
may be broadcast.

1. Every text is sent to its bucket through the directory. Owner tasks hold contiguous ranges of slots. Within a bucket
   the texts of one hash are put in order and each is compared, byte by byte, with the one before it: an equal one is a copy, a
   different one a collision and the next entry of the hash's chain. The owners write the index: bucket, hash, place in
   the chain, digest, number of copies.
2. Every document is looked up in the index by hash and SHA-256 of its text.

A hash that more than a hundred-thousandth of the rows have (at least ``HOT_ROWS``) is hot: there are fewer than 100,000 of
these, whatever the table. Copies of hot texts collapse on the map side before they go to their bucket, and their documents
are looked up by a broadcast, so a text that fills a third of the table is no task's burden. Only scalars (counts, a flag)
come to the driver.

Defined edge cases: a null text counts as empty; a null id is smaller than any id; of rows that repeat both id and text,
exactly one is kept; texts of any length are compared whole; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions, stored, table, texts_of

BUCKET_CAPACITY = 4096
#: Buckets that an even spread needs, at most: beyond it the capacity grows.
MOST_BUCKETS = 1 << 16
#: Bits by which the first histogram is finer than the depth that an even spread needs.
SPARE_BITS = 4
HOT_ROWS = 1000


def _slot(key: Column, bits: int) -> Column:
    """The leading ``bits`` bits of a 64-bit key, as a non-negative number."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def build_directory(keys: DataFrame, bucket_capacity: int = BUCKET_CAPACITY) -> tuple[DataFrame, int]:
    """Buckets ``(prefix, depth, entries)`` of an extendible hash over ``keys.key``, and the directory's global depth.

    ``keys`` has one row per entry. Splitting works on a histogram with few rows per bucket, not on the entries.
    """
    total = keys.count()
    bucket_capacity = max(bucket_capacity, -(-total // MOST_BUCKETS))
    depth = max(0, math.ceil(math.log2(max(1, total / bucket_capacity))))
    fine = depth + SPARE_BITS
    counts = stored(keys.groupBy(_slot(F.col("key"), fine).alias("cell")).agg(F.count("*").alias("entries")), "cells")

    def at(cells: DataFrame, bits: int) -> DataFrame:
        prefix = F.shiftright(F.col("cell"), fine - bits).alias("prefix")
        return cells.groupBy(prefix).agg(F.sum("entries").alias("entries")).withColumn("depth", F.lit(bits))

    done: list[DataFrame] = []
    open_cells = counts
    while True:
        buckets = at(open_cells, depth)
        over = F.col("entries") > bucket_capacity
        if depth == fine:  # a chain may exceed a bucket: more bits of the histogram can't split it
            done.append(buckets)
            break
        done.append(buckets.where(~over))
        full = buckets.where(over).select("prefix")
        if full.isEmpty():
            break
        open_cells = open_cells.withColumn("prefix", F.shiftright(F.col("cell"), fine - depth)).join(full, "prefix", "left_semi").select("cell", "entries")
        depth += 1
    directory = done[0]
    for more in done[1:]:
        directory = directory.unionByName(more)
    return directory, depth


def directory_slots(directory: DataFrame, depth: int, owners: int = 1) -> DataFrame:
    """The doubled directory: 2**depth slots ``(slot, bucket, owner)``; slots of a shallow bucket share it.

    Owners have contiguous ranges of slots, with about as many entries each.
    """
    span = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(depth) - F.col("depth"))
    first = F.col("prefix") * span
    upto = F.sum("entries").over(Window.orderBy(first).rowsBetween(Window.unboundedPreceding, 0))  # a row a bucket, so one task can
    total = F.sum("entries").over(Window.partitionBy())
    owned = directory.withColumn("owner", F.floor((upto - F.col("entries")) * owners / total))
    return owned.select(F.explode(F.sequence(first, first + span - 1)).alias("slot"), F.concat_ws("/", "depth", "prefix").alias("bucket"), "owner")


def chained_entries(routed: DataFrame) -> DataFrame:
    """Entries ``key, chain, bucket, text_sha256, group_size`` of ``routed (owner, bucket, key, text, copies)``.

    Rows lie with their owner. Of a bucket's texts with one hash, in order, each is compared with the one before it.
    """
    w = Window.partitionBy("owner", "bucket", "key").orderBy("text")
    other = F.coalesce(F.col("text") != F.lag("text").over(w), F.lit(True))
    judged = routed.withColumn("other", other).withColumn("chain", F.sum(F.col("other").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    light = judged.select("owner", "bucket", "key", "chain", "copies", F.when(F.col("other"), F.sha2("text", 256)).alias("digest"))
    return light.groupBy("owner", "bucket", "key", "chain").agg(F.max("digest").alias("text_sha256"), F.sum("copies").alias("group_size")).drop("owner")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_capacity: int = BUCKET_CAPACITY, hash_of: Callable[[str], Column] = F.xxhash64, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per document: ``row_id, doc_id, keep_id, group_size, kept, key, chain, bucket, text_sha256``.

    Of equal texts the row with the largest id stays. ``row_id`` tells repeated rows apart.
    """
    scratch, parts = Scratch(docs.sparkSession), shuffle_partitions(docs.sparkSession)
    base = texts_of(docs, id_col, text_col).withColumn("key", hash_of("text").cast("long"))
    rows = scratch.store(base.select("doc_id", F.monotonically_increasing_id().alias("row_id"), "key", F.sha2("text", 256).alias("text_sha256")), "rows")

    by_key = scratch.store(rows.groupBy("key").agg(F.count("*").alias("rows")), "keys")
    directory, depth = build_directory(by_key, bucket_capacity)
    slots = scratch.store(directory_slots(directory, depth, 4 * parts), "directory")
    total = by_key.agg(F.sum("rows")).first()[0] or 0
    least = max(hot_rows, total // 100_000)
    hot = by_key.where(F.col("rows") > least).select("key")  # fewer than 100,000 keys
    any_hot = not hot.isEmpty()

    texts = base.select("key", "text")
    entries = texts.join(F.broadcast(hot), "key", "left_anti").withColumn("copies", F.lit(1).cast("long"))
    if any_hot:
        entries = entries.unionByName(texts.join(F.broadcast(hot), "key", "left_semi").groupBy("key", "text").agg(F.count("*").alias("copies")))
    routed = entries.withColumn("slot", _slot(F.col("key"), depth)).join(F.broadcast(slots), "slot").drop("slot").repartition(parts, "owner")
    index = scratch.store(chained_entries(routed), "index")

    best = F.max(F.struct(F.col("doc_id").alias("keep_id"), F.col("row_id").alias("keep_row"))).alias("best")
    found = index.join(rows.groupBy("key", "text_sha256").agg(best), ["key", "text_sha256"])
    found = scratch.store(found.select("key", "text_sha256", "best.*", "group_size", "chain", "bucket"), "entries")
    known = rows.join(F.broadcast(hot), "key", "left_anti").join(found, ["key", "text_sha256"])
    if any_hot:
        few = F.broadcast(found.join(F.broadcast(hot), "key", "left_semi"))
        known = known.unionByName(rows.join(few, ["key", "text_sha256"]))
    return known.select("row_id", "doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "key", "chain", "bucket", "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_capacity: int = BUCKET_CAPACITY) -> DataFrame:
    """``docs`` without the rows whose text another kept row has; all columns stay."""
    judged = stored(exact_groups(docs, id_col, text_col, bucket_capacity).select("doc_id", "keep_id", "key", "kept"), "judged")
    heads = judged.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("doc_id", "key").agg(F.count("*").alias("rows"))
    groups = stored(heads.select("doc_id", "key", (F.col("rows") > 1).alias("repeated")), "kept")
    text_key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    on = docs[id_col].eqNullSafe(groups["doc_id"]) & (text_key == groups["key"])
    out = docs.join(groups, on, "left_semi")
    repeated = groups.where("repeated").select("doc_id", "key")
    if repeated.isEmpty():
        return out
    # Rows that repeat both id and text: one of each stays.
    again = docs[id_col].eqNullSafe(repeated["doc_id"]) & (text_key == repeated["key"])
    return out.join(repeated, again, "left_anti").unionByName(docs.join(repeated, again, "left_semi").dropDuplicates([id_col, text_col]))


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the row that stays for its text."""
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
