"""Structured Streaming: mergeable summaries, windows, sessions, de-duplication, per-host novelty, enrichment, late rows.

Counts, sums and times that are emitted here add up exactly, so the batch detectors can score the merged summaries; distinct counts
merge as sketches. Medians stay in batch.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions import scalars as S
from ..operators.intel import match_domains
from ..operators.ranges import match_ranges
from ..schema import with_event_time
from ..sources.shared import Store
from ..sources.text import numbered

# Functions travel to the executors with their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def tail_lines(spark: SparkSession, path: str) -> DataFrame:
    """New lines of the files below ``path``, for the row-local parsers; their numbers are NULL (see ``tail_numbered``)."""
    return spark.readStream.option("recursiveFileLookup", True).text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("source_file"), F.lit(None).cast("long").alias("source_line"))


def tail_numbered(spark: SparkSession, path: str, parse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, **options) -> StreamingQuery:
    """The parsed lines of new files below ``path``, with true line numbers, in a folder for each batch below ``out``.

    A file stream hands out a file whole, in one batch, so a batch's own splits number its lines; each file is scanned once. A batch that
    is run again replaces its folder.
    """
    lines = spark.readStream.options(**{"recursiveFileLookup": True, **options}).text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_start"))

    def write(rows: DataFrame, batch: int) -> None:
        with Store(rows.sparkSession) as store:
            raw = store.put(rows.withColumn("_id", F.monotonically_increasing_id()), "lines")
            parse(numbered(raw)).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def pair_summaries(connections: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling partial summaries of pairs: counts and sums add up, minima and maxima combine."""
    rows = with_event_time(connections).withWatermark("event_time", late)
    both = F.col("orig_bytes").isNotNull() & F.col("resp_bytes").isNotNull()
    out = rows.groupBy(F.window("event_time", width), "src_ip", "dst_ip", "dst_port").agg(
        F.count("*").alias("flows"), F.sum("orig_bytes").alias("bytes_out"), F.count("orig_bytes").alias("measured_flows"), F.count_if(both).alias("both_flows"),
        F.sum(F.when(both, F.col("orig_bytes"))).alias("both_out"), F.sum(F.when(both, F.col("resp_bytes"))).alias("both_in"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
    )
    return out.select(F.col("window.start").alias("window_start"), *[c for c in out.columns if c != "window"])


def merge_pairs(parts: DataFrame) -> DataFrame:
    """Partial summaries of any number of windows as one summary per pair."""
    adds = ("flows", "bytes_out", "measured_flows", "both_flows", "both_out", "both_in")
    return parts.groupBy("src_ip", "dst_ip", "dst_port").agg(*[F.sum(c).alias(c) for c in adds], F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def sliding_fanout(connections: DataFrame, width: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes", least: int = 50) -> DataFrame:
    """Approximate distinct destinations in sliding windows."""
    rows = with_event_time(connections).withWatermark("event_time", late)
    out = rows.groupBy(F.window("event_time", width, slide), "src_ip", "dst_port").agg(F.approx_count_distinct("dst_ip").alias("destinations"), F.count("*").alias("flows"))
    return out.select(F.col("window.start").alias("window_start"), "src_ip", "dst_port", "destinations", "flows").where(F.col("destinations") >= least)


#: Registers of a sketch as a power of two: a relative error of about 0.8 per cent.
SKETCH_BITS = 14


def fanout_sketches(connections: DataFrame, keys: Sequence[str] = ("src_ip", "dst_port"), width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling partial summaries that count distinct destinations, too: a sketch merges, as counts and times do."""
    rows = with_event_time(connections).withWatermark("event_time", late)
    out = rows.groupBy(F.window("event_time", width), *keys).agg(F.hll_sketch_agg("dst_ip", F.lit(SKETCH_BITS)).alias("sketch"), F.count("*").alias("flows"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return out.select(F.col("window.start").alias("window_start"), *[c for c in out.columns if c != "window"])


def merge_sketches(parts: DataFrame, keys: Sequence[str] = ("src_ip", "dst_port")) -> DataFrame:
    """Partial summaries of any windows as one per group, with the estimated number of destinations over all of them."""
    merged = parts.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("flows").alias("flows"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return merged.withColumn("destinations", F.hll_sketch_estimate("sketch")).drop("sketch")


def burst_sessions(connections: DataFrame, gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Flows of a pair that follow each other within ``gap``, as one row."""
    rows = with_event_time(connections).withWatermark("event_time", late)
    out = rows.groupBy(F.session_window("event_time", gap), "src_ip", "dst_ip", "dst_port").agg(F.count("*").alias("flows"), F.sum("orig_bytes").alias("bytes"), F.min("ts").alias("ts"))
    return out.drop("session_window")


def first_alerts(alerts: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first alert of each source and signature within the watermark."""
    return with_event_time(alerts).withWatermark("event_time", late).dropDuplicatesWithinWatermark(["src_ip", "signature"])


def novel_destinations(connections: DataFrame, late: str = "10 minutes", horizon: float = 30 * 86400.0) -> DataFrame:
    """Each pair's first flow within ``horizon`` seconds, with the time since its source was first seen.

    A source's state is a value (its first and last flow) and a map of its destinations, of which a batch reads and writes the entries it
    meets and no others. A timer at the earliest end of a horizon drops the destinations that were not seen for it, or, where the source was
    silent for it, all of the source: state is bounded by what happens within the horizon. State of this kind needs the RocksDB provider, which
    is set for the session.
    """
    connections.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # a second later, so that a flow at time 0 isn't behind the first watermark, which is 0
    timed = with_event_time(connections).withColumn("event_time", F.col("event_time") + F.expr("interval 1 second"))
    rows = timed.withWatermark("event_time", late).select("src_ip", "dst_ip", "ts", "event_time").where("src_ip is not null and dst_ip is not null")
    columns = ["src_ip", "dst_ip", "first_seen", "since_source"]

    class Novelty(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.source = handle.getValueState("source", "first double, latest double, timer long")
            self.last = handle.getMapState("last", "dst_ip string", "last double")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            seen = pd.concat(list(rows)).groupby("dst_ip")["ts"].agg(["min", "max"]).sort_values("min")
            first, latest, timer = self.source.get() if self.source.exists() else (float("inf"), float("-inf"), None)
            first, latest = min(first, float(seen["min"].min())), max(latest, float(seen["max"].max()))
            new = []
            for dst, began, ended in seen.itertuples():
                last = self.last.getValue((dst,))[0] if self.last.containsKey((dst,)) else None
                if last is None or last < began - horizon:
                    new.append((key[0], dst, began, began - first))
                if last is None or ended > last:
                    self.last.updateValue((dst,), (ended,))
            if timer is None:
                timer = self.wake(float(seen["max"].min()), timerValues)
            self.source.update((first, latest, timer))
            yield pd.DataFrame(new, columns=columns)

        def wake(self, earliest: float, timers) -> int:
            at = max(int((earliest + horizon) * 1000), timers.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(at)
            return at

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now = timerValues.getCurrentWatermarkInMs() / 1000
            first, latest, _ = self.source.get()
            if latest + horizon <= now:
                self.source.clear()
                self.last.clear()
            else:
                kept = []
                for dst, last in [(k[0], v[0]) for k, v in self.last.iterator()]:
                    if last + horizon <= now:
                        self.last.removeKey((dst,))
                    else:
                        kept.append(last)
                self.source.update((first, latest, self.wake(min(kept), timerValues)))
            yield pd.DataFrame([], columns=columns)

        def close(self) -> None:
            pass

    return rows.groupBy("src_ip").transformWithStateInPandas(Novelty(), "src_ip string, dst_ip string, first_seen double, since_source double", "append", "eventTime")


def enrich(rows: DataFrame, indicators: DataFrame, statements: DataFrame | None = None, store: Store | None = None) -> DataFrame:
    """Rows with what static tables know: ``indicator, indicator_kind`` of their destination or, where they have one, their query; ``src_host``.

    Distinct values are matched, addresses in ranges and names with their parent zones, and joined back once; no side is broadcast by
    force. ``statements`` are of ``applied_assets``.
    """
    store = store or Store(rows.sparkSession)
    named = "query" in rows.columns
    value = F.array_join(S.labels(F.col("query")), ".") if named else F.col("dst_ip")
    keyed = rows.withColumn("_value", value)
    if named:
        hits = match_domains(keyed.select(F.col("_value").alias("value")).where("value <> ''"), indicators).select(F.col("value").alias("_value"), "indicator", F.lit("domain").alias("indicator_kind"))
    else:
        hits = match_ranges(keyed.select(F.col("_value").alias("value")).where("value is not null"), indicators, store=store).select(F.col("value").alias("_value"), "indicator", "indicator_kind")
    out = keyed.join(hits, "_value", "left").select(*rows.columns, "indicator", "indicator_kind")
    if statements is None:
        return out
    assets = statements.where("applies").select(F.col("address").alias("_address"), F.col("hostname").alias("src_host"))
    return out.join(assets, F.col("src_ip") == F.col("_address"), "left").drop("_address")


def write_enriched(stream: DataFrame, indicators: DataFrame, path: str, checkpoint: str, statements: DataFrame | None = None) -> StreamingQuery:
    """Each batch of a stream of connections or look-ups, enriched, in a folder of its own below ``path``: a batch that is run again replaces it."""

    def write(rows: DataFrame, batch: int) -> None:
        with Store(rows.sparkSession) as store:
            enrich(store.put(rows, "batch"), indicators, statements, store).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def write_with_late_rows(stream: DataFrame, path: str, checkpoint: str, late: float = 600.0) -> StreamingQuery:
    """Rows in ``path/rows``, those that came over ``late`` seconds behind the latest row of earlier batches in ``path/late``.

    Nothing is dropped. A batch's own folders and its mark, the latest time so far, are named by its number, and it reads the mark of the
    batch before; so a batch that is run again after a restart says the same of each row, and replaces what it wrote.
    """

    def mark(spark: SparkSession, batch: int) -> float | None:
        if batch < 0:
            return None
        return spark.read.schema("latest double").parquet(f"{path}/marks/batch={batch}").first()["latest"]

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        with Store(spark) as store:
            kept = store.put(rows, "batch")
            before = mark(spark, batch - 1)
            behind = F.lit(False) if before is None else F.coalesce(F.col("ts") < before - late, F.lit(False))
            kept.where(behind).write.mode("overwrite").parquet(f"{path}/late/batch={batch}")
            kept.where(~behind).write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
            latest = kept.agg(F.greatest(F.max("ts").cast("double"), F.lit(before).cast("double")).alias("latest"))
            latest.write.mode("overwrite").parquet(f"{path}/marks/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


class DroppedRows(StreamingQueryListener):
    """Adds up, over all batches of all queries, the rows that stateful operators dropped behind the watermark: ``counts`` by query id.

    Rows count as they reach the operator: late rows that a partial sum has merged are one.
    """

    def __init__(self) -> None:
        self.counts: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        key = str(event.progress.id)
        self.counts[key] = self.counts.get(key, 0) + sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def dropped_rows(query: StreamingQuery) -> int:
    """How many rows came behind the watermark, over the progress that the query remembers."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])


def with_lateness(connections: DataFrame, name: str, late: float = 600.0) -> DataFrame:
    """The stream as it is; each batch's progress has, under ``name``, its rows, first and last time, and whether it is ``wide``: these lie over ``late`` seconds apart.

    Sums over the batch alone, so it costs no state.
    """
    return connections.observe(name, F.count(F.lit(1)).alias("records"), F.min("ts").alias("first"), F.max("ts").alias("last"), (F.max("ts") - F.min("ts") > late).alias("wide"))
