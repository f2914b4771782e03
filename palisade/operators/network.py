"""Detectors over connections and alerts: fan-out, alert triage, egress, beaconing.

Detectors over connections start from one summary, ``pair_totals``, which may be stored once for all of them. Every group is
reduced by partial aggregation before it is shuffled; series are windowed only for candidate pairs that pass the summary's gates, and
in chunks of time where a pair has many rows. Medians come from ``selection``. No list of a group is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.shared import Store
from .findings import to_findings, with_samples
from .selection import MOST_HELD, few, group_quantiles, same


def first_locator(df: DataFrame) -> Column:
    """File and line of a group's first row."""
    if not {"source_file", "source_line"} <= set(df.columns):
        return F.lit(None).cast("struct<source_file:string,source_line:bigint>").alias("artifact")
    return F.min_by(F.struct(F.col("source_file"), F.col("source_line").cast("long").alias("source_line")), F.struct("ts", "source_file", "source_line")).alias("artifact")


def first_place(df: DataFrame) -> Column:
    """``first_at``: time, file and line of a group's first row; the least one of merged groups is that of all their rows."""
    if not {"source_file", "source_line"} <= set(df.columns):
        return F.min(F.lit(None).cast("struct<ts:double,source_file:string,source_line:bigint>")).alias("first_at")
    return F.min(F.struct(F.col("ts").cast("double").alias("ts"), "source_file", F.col("source_line").cast("long").alias("source_line"))).alias("first_at")


def with_first_place(scored: DataFrame, totals: DataFrame, keys: list[str], rows: DataFrame | None = None) -> DataFrame:
    """Scored groups, which the caps have made few, with the ``artifact`` where each began: the first place of the totals that it merged, or, where totals hold none, of its ``rows``."""
    source, place = (totals, F.min("first_at").alias("first_at")) if "first_at" in totals.columns else (rows, first_place(rows))
    mine = source.join(F.broadcast(scored.select(*keys).distinct()), keys, "left_semi")  # as many rows as the caps let through
    first = mine.groupBy(*keys).agg(place)
    return scored.join(first, keys, "left").withColumn("artifact", locator()).drop("first_at")


def locator() -> Column:
    """File and line of ``first_at``."""
    at = F.col("first_at")
    return F.when(at.isNotNull(), F.struct(at["source_file"].alias("source_file"), at["source_line"].alias("source_line")))


PAIR = ["src_ip", "dst_ip", "dst_port"]
#: Up to this many first rows of a group Spark drops the others before it shuffles (its windowGroupLimitThreshold).
GROUP_LIMIT = 1000


def detector_rows(connections: DataFrame) -> DataFrame:
    """Of connections the columns that detectors read."""
    return connections.select(*[c for c in (*PAIR, "ts", "orig_bytes", "resp_bytes", "service", "source_file", "source_line") if c in connections.columns])


def pair_totals(connections: DataFrame, keys: list[str] = PAIR, places: bool = True) -> DataFrame:
    """(src, dst, port), each of which may be NULL, or fewer ``keys``: flows, bytes, times and first place, from which all detectors over connections start.

    Sums over flows with both byte counts stand apart, so that a missing direction isn't read as 0. Totals of parts of a capture merge.
    Without ``places`` all totals are numbers, which Spark adds up in a hash table; a first place makes it sort the rows twice.
    """
    both = F.col("orig_bytes").isNotNull() & F.col("resp_bytes").isNotNull()
    return connections.groupBy(*keys).agg(
        F.count("*").alias("flows"), F.count("ts").alias("timed_flows"), F.sum("orig_bytes").alias("bytes_out"), F.count("orig_bytes").alias("measured_flows"), F.count_if(both).alias("both_flows"),
        F.sum(F.when(both, F.col("orig_bytes"))).alias("both_out"), F.sum(F.when(both, F.col("resp_bytes"))).alias("both_in"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), *([first_place(connections)] if places else []),
    )


# ---------------------------------------------------------------- fan-out


@dataclass(frozen=True)
class FanoutParams:
    min_destinations: int = 50
    breadth_scale: float = 250.0
    revisit_scale: float = 12.0
    breadth_weight: float = 0.55
    non_revisiting_weight: float = 0.45
    min_score: float = 0.55
    high_score: float = 0.85
    excluded_ports: tuple[int, ...] = (53, 123)
    top: int = 200


def score_fanout(destinations: Column, flows: Column, p: FanoutParams = FanoutParams()) -> tuple[Column, dict[str, Column]]:
    parts = {"breadth": S.saturating(destinations, p.breadth_scale), "non_revisiting": 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), flows / destinations - 1) / p.revisit_scale)}
    return S.geometric_mean([(parts["breadth"], p.breadth_weight), (parts["non_revisiting"], p.non_revisiting_weight)]), parts


def fanout_groups(pairs: DataFrame, p: FanoutParams = FanoutParams()) -> DataFrame:
    """(src, port) with enough destinations, from pair totals: one busy source was spread over its destinations before."""
    kept = pairs.dropna(subset=PAIR).where(~F.col("dst_port").isin(*p.excluded_ports))
    groups = kept.groupBy("src_ip", "dst_port").agg(F.count("*").alias("destinations"), F.sum("flows").alias("flows"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return groups.where(F.col("destinations") >= p.min_destinations)


def score_fanout_pairs(pairs: DataFrame, p: FanoutParams = FanoutParams()) -> DataFrame:
    score, parts = score_fanout(F.col("destinations"), F.col("flows"), p)
    scored = fanout_groups(pairs, p).withColumns({**parts, "score": score}).where(F.col("score") >= p.min_score)
    return scored.orderBy(F.desc(F.bround("score", 9)), "src_ip", "dst_port").limit(p.top)


def score_fanouts(connections: DataFrame, p: FanoutParams = FanoutParams()) -> DataFrame:
    return score_fanout_pairs(pair_totals(connections), p)


def detect_fanout(connections: DataFrame, p: FanoutParams = FanoutParams(), samples: int = 0, pairs: DataFrame | None = None, store: Store | None = None) -> DataFrame:
    pairs = pair_totals(connections) if pairs is None else pairs
    scored = (store or Store(connections.sparkSession)).put(score_fanout_pairs(pairs, p), "fanouts")  # read for their places, too
    scored = with_first_place(scored, pairs, ["src_ip", "dst_port"], connections)
    scored = with_samples(scored, connections, ["src_ip", "dst_port"], samples)
    severity = F.when(F.col("score") >= p.high_score, "high").otherwise("medium")
    summary = F.format_string("%s contacted %d destinations on port %d", "src_ip", "destinations", "dst_port")
    return to_findings(scored, "scans", F.col("src_ip"), "port", F.col("dst_port"), severity, "fanout@1", {k: F.col(k) for k in ("breadth", "non_revisiting")}, "fanout", summary, {"destinations": F.col("destinations"), "flows": F.col("flows")})


# ---------------------------------------------------------------- alert triage


@dataclass(frozen=True)
class AlertParams:
    min_alerts: int = 3
    common_hosts: int = 50
    common_rarity: float = 0.05
    weights: tuple[float, float, float] = (0.45, 0.30, 0.25)
    min_score: float = 0.45
    medium_score: float = 0.75
    top: int = 200


def alert_clusters(alerts: DataFrame) -> DataFrame:
    """(src, signature): alerts, first id and category by time, most severe rating, targets (NULL counts as one)."""
    kept = alerts.dropna(subset=["src_ip", "signature"])
    order = F.struct("ts", "source_file", "source_line")
    targets = (F.count_distinct("dst_ip") + F.max(F.col("dst_ip").isNull().cast("int"))).alias("targets")
    return kept.groupBy("src_ip", "signature").agg(F.count("*").alias("alerts"), F.min_by("signature_id", order).alias("signature_id"), F.min_by("category", order).alias("category"), F.min("severity").alias("stated"), targets, F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), first_locator(kept))


def score_alert_cluster(hosts: Column, stated: Column, category: Column, p: AlertParams = AlertParams()) -> tuple[Column, dict[str, Column]]:
    rare = S.rarity(hosts)
    parts = {
        "signature_rarity": F.when(hosts >= p.common_hosts, F.least(rare, F.lit(p.common_rarity))).otherwise(rare),
        "stated_severity": S.severity_score(stated),
        "category_weight": S.category_weight(category),
    }
    return S.geometric_mean(list(zip(parts.values(), p.weights))), parts


def score_alerts(alerts: DataFrame, p: AlertParams = AlertParams(), store: Store | None = None) -> DataFrame:
    clusters = (store or Store(alerts.sparkSession)).put(alert_clusters(alerts), "clusters")  # read for their signatures, too
    spread = clusters.where(F.col("signature_id").isNotNull()).groupBy("signature_id").agg(F.count_distinct("src_ip").alias("hosts"))
    joined = clusters.join(spread, "signature_id", "left").withColumn("hosts", F.coalesce("hosts", F.lit(1)))
    score, parts = score_alert_cluster(F.col("hosts"), F.col("stated"), F.col("category"), p)
    scored = joined.where(F.col("alerts") >= p.min_alerts).withColumns({**parts, "score": score}).where(F.col("score") >= p.min_score)
    return scored.orderBy(F.desc(F.bround("score", 9)), F.desc("alerts"), "src_ip", "signature").limit(p.top)


def detect_alerts(alerts: DataFrame, p: AlertParams = AlertParams(), samples: int = 0, store: Store | None = None) -> DataFrame:
    scored = with_samples(score_alerts(alerts, p, store), alerts, ["src_ip", "signature"], samples)
    severity = F.when(F.col("score") >= p.medium_score, "medium").otherwise("low")
    summary = F.format_string("%d alerts of %s from %s", "alerts", "signature", "src_ip")
    return to_findings(scored, "triggered_signature", F.col("src_ip"), "signature", F.col("signature"), severity, "alerts@1", {k: F.col(k) for k in ("signature_rarity", "stated_severity", "category_weight")}, "alert_cluster", summary, {k: F.col(k) for k in ("alerts", "hosts", "targets", "category", "signature_id")})


# ---------------------------------------------------------------- egress


@dataclass(frozen=True)
class EgressParams:
    weights: tuple[float, float, float, float] = (0.30, 0.28, 0.24, 0.18)
    ratio_ramp: tuple[float, float] = (0.5, 0.9)
    min_coverage: float = 0.5
    deviation_scale: float = 3.5
    min_peers: int = 5
    min_span: float = 3600.0
    min_bytes: int = 1_000_000
    exfil_score: float = 0.70
    volume_score: float = 0.45
    volume_deviation: float = 0.5
    rare_bytes: int = 100_000
    rare_flows: int = 5
    rare_hosts: int = 2
    rare_score: float = 0.30
    top: int = 200
    top_rare: int = 25


def egress_totals(pairs: DataFrame) -> DataFrame:
    """(src, dst) sums over ports, of pairs with any measured flow."""
    added = ("flows", "bytes_out", "measured_flows", "both_flows", "both_out", "both_in")
    kept = pairs.dropna(subset=["src_ip", "dst_ip"])
    return kept.groupBy("src_ip", "dst_ip").agg(*[F.sum(c).alias(c) for c in added], F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def score_transfer(bytes_out: Column, flows: Column, both_flows: Column, both_out: Column, both_in: Column, median_out: Column, mad_out: Column, peers: Column, hosts: Column, first_seen: Column, host_first: Column, host_last: Column, p: EgressParams = EgressParams()) -> tuple[Column, dict[str, Column]]:
    """Of one (src, dst): a ratio needs flows with both byte counts, a deviation enough peers, novelty a long enough record of the host."""
    ratio = both_out / F.nullif(both_out + both_in, F.lit(0))
    z = F.when(peers >= p.min_peers, S.robust_deviation(bytes_out, median_out, mad_out, peers))
    span = host_last - host_first
    parts = {
        "egress_ratio": F.when(both_flows / flows >= p.min_coverage, S.ramp(ratio, *p.ratio_ramp)),
        "volume_deviation": F.when(z.isNotNull(), S.saturating(z, p.deviation_scale)),
        "destination_rarity": S.rarity(hosts),
        "novelty": F.when(span >= p.min_span, (first_seen - host_first) / span),
    }
    return S.geometric_mean(list(zip(parts.values(), p.weights))), parts


def _middles_by_window(totals: DataFrame) -> DataFrame:
    """``totals`` with their source's number, times, median and MAD: one shuffle and one sort, for sources that a task can window."""
    of_src = Window.partitionBy("src_ip")
    median = lambda value: F.percentile(value, F.lit(0.5)).over(of_src)
    pairs = totals.withColumns({"peers": F.count("*").over(of_src), "host_first": F.min("first_seen").over(of_src), "host_last": F.max("last_seen").over(of_src), "median_out": median("bytes_out")})
    return pairs.withColumn("off", F.abs(F.col("bytes_out") - F.col("median_out"))).withColumn("mad_out", median("off")).drop("off")


def _middles_by_selection(totals: DataFrame, store: Store) -> DataFrame:
    """The same for sources of any size: medians are selected, nothing of a source is sorted or windowed."""
    center = store.put(group_quantiles(totals, ["src_ip"], "bytes_out", {"median_out": 0.5}, store=store), "centers")
    off = totals.join(center, "src_ip").select("src_ip", F.abs(F.col("bytes_out") - F.col("median_out")).alias("off"))
    spread = group_quantiles(off, ["src_ip"], "off", {"mad_out": 0.5}, sizes=center, store=store).drop("n")
    times = totals.groupBy("src_ip").agg(F.min("first_seen").alias("host_first"), F.max("last_seen").alias("host_last"))
    return totals.join(times.join(center.withColumnRenamed("n", "peers"), "src_ip").join(spread, "src_ip"), "src_ip")


def score_transfers(transfers: DataFrame, p: EgressParams = EgressParams(), store: Store | None = None, most: int = MOST_HELD) -> DataFrame:
    """Every pair with enough bytes: components, score and the strongest claim they support, before the caps.

    A source with more than ``most`` destinations is no task's window: its medians are selected. Destinations' hosts come first, and from
    a small stored table, so that scores stand where their source was windowed: its claims are compared there without another shuffle.
    """
    store = store or Store(transfers.sparkSession)
    totals = store.put(transfers.where("measured_flows > 0"), "transfers")
    totals = totals.join(store.put(totals.groupBy("dst_ip").agg(F.count("*").alias("hosts")), "hosts"), "dst_ip")
    large = totals.groupBy("src_ip").agg(F.count("*").alias("n")).where(F.col("n") > most).select("src_ip")
    if large.isEmpty():
        return _claims(_middles_by_window(totals), p)
    selected = _middles_by_selection(store.put(totals.join(large, "src_ip", "left_semi"), "large"), store)
    return _claims(_middles_by_window(totals.join(large, "src_ip", "left_anti")).unionByName(selected), p)


def score_pair_transfers(pairs: DataFrame, p: EgressParams = EgressParams(), store: Store | None = None, most: int = MOST_HELD) -> DataFrame:
    """``score_transfers`` of stored pair totals, which are dealt by source once: there ports are added up and the source is windowed.

    Only the names of the pairs are shuffled besides, to count destinations' hosts. A source with more than ``most`` rows is dealt by
    pair, and its medians are selected; there are few.
    """
    store = store or Store(pairs.sparkSession)
    rows = pairs.dropna(subset=["src_ip", "dst_ip"])
    met = rows.where("measured_flows > 0").select("src_ip", "dst_ip").distinct()
    hosts = store.put(met.groupBy("dst_ip").agg(F.count("*").alias("hosts")), "hosts")
    large = store.put(rows.groupBy("src_ip").agg(F.count("*").alias("n")).where(F.col("n") > most).select("src_ip"), "sources")

    def totals(of: DataFrame) -> DataFrame:
        return egress_totals(of).where("measured_flows > 0").join(hosts, "dst_ip")

    if large.isEmpty():
        return _claims(_middles_by_window(totals(rows.repartition("src_ip"))), p)
    selected = _middles_by_selection(store.put(totals(rows.join(few(large, most), "src_ip", "left_semi")), "large"), store)
    return _claims(_middles_by_window(totals(rows.join(few(large, most), "src_ip", "left_anti").repartition("src_ip"))).unionByName(selected), p)


def _claims(middles: DataFrame, p: EgressParams) -> DataFrame:
    """Components, score and claim of pairs that stand beside their source's medians."""
    cols = {c: F.col(c) for c in ("bytes_out", "flows", "both_flows", "both_out", "both_in", "median_out", "mad_out", "peers", "hosts", "first_seen", "host_first", "host_last")}
    _, parts = score_transfer(**cols, p=p)
    scored = S.computed_once(S.computed_once(middles, parts), {"score": S.geometric_mean(list(zip(map(F.col, parts), p.weights)))})
    big = F.col("bytes_out") >= p.min_bytes
    claim = (
        F.when(big & F.col("egress_ratio").isNotNull() & (F.col("score") >= p.exfil_score), "exfiltrates_to")
        .when(big & F.col("volume_deviation").isNotNull() & (F.col("volume_deviation") >= p.volume_deviation) & (F.col("score") >= p.volume_score), "transfers_anomalous_volume")
        .when((F.col("bytes_out") >= p.rare_bytes) & (F.col("flows") >= p.rare_flows) & (F.col("hosts") <= p.rare_hosts) & (F.col("score") >= p.rare_score), "contacts_rare_destination")
    )
    return scored.withColumn("claim", claim).where("claim is not null")


def score_egress(connections: DataFrame, p: EgressParams = EgressParams()) -> DataFrame:
    totals = pair_totals(connections.dropna(subset=["src_ip", "dst_ip"]), ["src_ip", "dst_ip"])
    return score_transfers(totals.drop("first_at"), p)


def strongest_claims(scored: DataFrame, p: EgressParams = EgressParams()) -> DataFrame:
    """Each source's strongest band only, then the caps: ``top`` claims, ``top_rare`` of the weakest band."""
    band = S.mapped(F.col("claim"), {"exfiltrates_to": 3, "transfers_anomalous_volume": 2, "contacts_rare_destination": 1})
    ranked = scored.withColumn("band", band).withColumn("best", F.max("band").over(Window.partitionBy("src_ip"))).where("band = best").drop("best")
    order = [F.desc("band"), F.desc(F.bround("score", 9)), F.asc("src_ip"), F.asc("dst_ip")]
    most = max(p.top, p.top_rare)
    if most > GROUP_LIMIT:
        return ranked.where("band > 1").orderBy(*order).limit(p.top).unionByName(ranked.where("band = 1").orderBy(*order).limit(p.top_rare))
    # both caps in one pass: each task gives on no more than its first of either kind
    first = ranked.withColumn("place", F.row_number().over(Window.partitionBy(F.col("band") > 1).orderBy(*order))).where(F.col("place") <= most)
    return first.where(F.col("place") <= F.when(F.col("band") > 1, p.top).otherwise(p.top_rare)).drop("place")


def detect_egress(connections: DataFrame, p: EgressParams = EgressParams(), samples: int = 0, pairs: DataFrame | None = None, store: Store | None = None, claims: DataFrame | None = None) -> DataFrame:
    """``claims``: what ``strongest_claims`` gives for ``pairs``, where the caller has it already."""
    largest = (F.desc_nulls_last("orig_bytes"), "ts", "source_file", "source_line")
    store = store or Store(connections.sparkSession)
    pairs = store.put(pair_totals(connections), "pairs") if pairs is None else pairs
    if claims is None:  # stored: they are read for their places and again as findings
        claims = store.put(strongest_claims(score_pair_transfers(pairs, p, store), p), "claims")
    scored = with_first_place(claims, pairs, ["src_ip", "dst_ip"], connections)
    scored = with_samples(scored, connections, ["src_ip", "dst_ip"], samples, largest)
    severity = S.mapped(F.col("claim"), {"exfiltrates_to": "critical", "transfers_anomalous_volume": "medium", "contacts_rare_destination": "low"})
    names = ("egress_ratio", "volume_deviation", "destination_rarity", "novelty")
    summary = F.format_string("%s sent %d bytes to %s", "src_ip", "bytes_out", "dst_ip")
    return to_findings(scored, F.col("claim"), F.col("src_ip"), "ip", F.col("dst_ip"), severity, "egress@1", {k: F.col(k) for k in names}, "transfer", summary, {k: F.col(k) for k in ("bytes_out", "flows", "hosts", "peers", *names)})


# ---------------------------------------------------------------- beaconing


@dataclass(frozen=True)
class BeaconParams:
    weights: tuple[float, ...] = (0.26, 0.12, 0.20, 0.18, 0.12, 0.12)
    min_checkins: int = 24
    min_span: float = 3600.0
    period: tuple[float, float] = (1.0, 86400.0)
    interval_scale: float = 0.6
    payload_scale: float = 0.5
    persistence_scale: float = 15.0
    excluded_ports: tuple[int, ...] = (53, 123)
    excluded_services: tuple[str, ...] = ("dns", "ntp")
    min_score: float = 0.72
    critical_score: float = 0.90
    top: int = 200
    bins: int = 64
    max_time_bins: int = 200_000
    #: A pair with more rows than this is worked on in chunks of time.
    chunk_rows: int = 100_000


#: Bins that .8 to 1.2 periods may be, and bins of a pair that are one task's window.
LAGS, PART_BINS = range(2, 6), 4096
BEACON_PARTS = ("interval_regularity", "schedule_floor", "payload_uniformity", "periodicity", "persistence", "destination_rarity")


def timed_pairs(pairs: DataFrame) -> DataFrame:
    """Pair totals as a beacon sees them: rows with a time only."""
    return pairs.dropna(subset=["src_ip", "dst_ip"]).where("timed_flows > 0").select(*PAIR, F.col("timed_flows").alias("flows"), "first_seen", "last_seen")


def timed_totals(connections: DataFrame) -> DataFrame:
    """Of the pair totals what beacons need."""
    return connections.groupBy(*PAIR).agg(F.count("ts").alias("timed_flows"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def destination_hosts(summary: DataFrame) -> DataFrame:
    return summary.groupBy("dst_ip").agg(F.count_distinct("src_ip").alias("hosts"))


def ordered(series: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """``series`` in order within chunks, by one shuffle: each row's ``earlier`` time, the bytes ``sent`` and rows ``measured`` before it, and the whole chunk's.

    Differences of running sums are the bytes of any run of rows, so that no later step puts all rows in order again.
    """
    own = Window.partitionBy(*keys, "chunk")
    w = own.orderBy("ts", "tie")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    sent = lambda over: F.coalesce(F.sum("orig_bytes").over(over), F.lit(0).cast("long"))
    return series.select(
        *keys, "chunk", "chunks", "ts", "tie", "orig_bytes", F.lag("ts").over(w).alias("earlier"), sent(before).alias("sent"), F.count("orig_bytes").over(before).alias("measured"),
        sent(own).alias("all_sent"), F.count("orig_bytes").over(own).alias("all_measured"), F.max("ts").over(own).alias("last"),
    )


def chunk_borders(series: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """``keys, chunk, before``: the last time before each further chunk of a pair. They are as few as ``chunk_rows`` goes into the rows."""
    chunks = series.where("chunks > 1 and earlier is null").select(*keys, "chunk", "last")
    return chunks.withColumn("before", F.lag("last").over(Window.partitionBy(*keys).orderBy("chunk"))).where("before is not null").drop("last")


def with_gaps(rows: DataFrame, borders: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """``gap`` to the row before of the pair, which for a chunk's first row lies before the border."""
    return same(rows, F.broadcast(borders), [*keys, "chunk"], "left").withColumn("gap", F.col("ts") - F.coalesce("earlier", "before")).drop("before")


def gap_thresholds(gaps: DataFrame, store: Store, p: BeaconParams = BeaconParams(), keys: list[str] = PAIR) -> DataFrame:
    """Otsu's split of each pair's log10 gaps: ``threshold``, where at least 8 gaps span a decade and both sides weigh 10 %.

    Only bins that hold gaps exist as rows: an empty bin repeats its neighbour's split and never comes first. What is told of pairs is
    stored, so that its size is known and the gaps aren't shuffled to meet it where it is small.
    """
    logs = gaps.where("gap > 0").select(*keys, F.log10("gap").alias("x"))
    ends = logs.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).where((F.col("n") >= 8) & (F.col("hi") - F.col("lo") >= 1))
    ends = store.put(ends, "ends")
    width = (F.col("hi") - F.col("lo")) / p.bins
    binned = same(logs, ends, keys).withColumn("bin", F.least(F.lit(p.bins - 1), F.floor((F.col("x") - F.col("lo")) / width)).cast("int"))
    counts = binned.groupBy(*keys, "n", "lo", "hi", "bin").agg(F.count("*").alias("c"))
    center = F.col("lo") + (F.col("bin") + 0.5) * width
    w = Window.partitionBy(*keys)
    run = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    moved = counts.withColumn("center", center).withColumns({"mass": F.sum("c").over(run) / F.col("n"), "moment": F.sum(F.col("c") * F.col("center")).over(run) / F.col("n"), "mean": F.sum(F.col("c") * F.col("center")).over(w) / F.col("n")})
    spread = F.pow(F.col("mean") * F.col("mass") - F.col("moment"), 2) / F.nullif(F.col("mass") * (1 - F.col("mass")), F.lit(0.0))
    best = moved.withColumn("between", spread).where(F.col("between").isNotNull()).groupBy(*keys).agg(F.max_by(F.struct("center", "mass"), F.struct(F.bround("between", 12), -F.col("bin"))).alias("b"))
    split = same(logs, store.put(best.select(*keys, "b.center"), "splits"), keys).groupBy(*keys).agg(F.first("center").alias("center"), F.avg((F.col("x") <= F.col("center")).cast("double")).alias("below"))
    return split.where(F.col("below").between(0.1, 0.9)).select(*keys, F.pow(F.lit(10.0), F.col("center")).alias("threshold"))


def checkins(series: DataFrame, borders: DataFrame, thresholds: DataFrame, store: Store, keys: list[str] = PAIR) -> DataFrame:
    """Rows of pairs with a threshold coalesced into bursts: ``keys, ts, bytes, gap``, one row per check-in with its start, its byte sum and the gap to the start before.

    Of other pairs each row is a check-in, as it is. Only rows that start a burst are shuffled: its bytes are those sent before the next
    start less those sent before its own. What a burst has in further chunks, up to the next start, is told by a row for each chunk
    of the pairs that have several.
    """
    gaps = with_gaps(series, borders, keys)
    single = same(gaps, thresholds, keys, "left_anti").select(*keys, "ts", F.col("orig_bytes").cast("double").alias("bytes"), "gap")
    marked = same(gaps, thresholds, keys)
    starts = marked.where(F.col("gap").isNull() | (F.col("gap") > F.col("threshold"))).select(*keys, "chunk", "chunks", "ts", "tie", "sent", "measured", "all_sent", "all_measured")
    w = Window.partitionBy(*keys, "chunk").orderBy("ts", "tie")
    first = F.lag("ts").over(w).isNull() & (F.col("chunks") > 1)
    within = starts.select(
        *keys, "chunk", "ts", F.lag("ts").over(w).alias("earlier"), ((F.col("chunks") > 1) & F.lead("ts").over(w).isNull()).alias("open"),
        *[F.when(first, F.col(c)).alias(f"head_{c}") for c in ("sent", "measured")], *[(F.coalesce(F.lead(c).over(w), f"all_{c}") - F.col(c)).alias(c) for c in ("sent", "measured")],
    )
    bursts = store.put(within, "bursts")

    by = [*keys, "chunk"]
    chunks = same(series.where("chunks > 1 and earlier is null"), thresholds, keys, "left_semi").select(*by, "all_sent", "all_measured")
    chunks = same(same(chunks, bursts.where("head_sent is not null").select(*by, "head_sent", "head_measured"), by, "left"), bursts.where("open").select(*by, F.col("ts").alias("last_start")), by, "left")
    upto = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.col("head_sent").isNotNull().cast("int")
    chunks = chunks.withColumns({"begun": F.sum(begins).over(upto), "before": F.last("last_start", ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, -1))}).withColumn("owner", F.col("begun") - begins)
    more = chunks.groupBy(*keys, F.col("owner").alias("begun")).agg(*[F.sum(F.coalesce(f"head_{c}", f"all_{c}")).alias(f"more_{c}") for c in ("sent", "measured")])
    edges = same(chunks.where("head_sent is not null").select(*by, "begun", "before"), more, [*keys, "begun"], "left").drop("begun")

    placed = same(bursts, F.broadcast(store.put(edges, "edges")), by, "left")  # rows of chunked pairs only
    sent, measured = (F.col(c) + F.when(F.col("open"), F.coalesce(f"more_{c}", F.lit(0).cast("long"))).otherwise(0) for c in ("sent", "measured"))
    placed = placed.select(*keys, "ts", F.when(measured > 0, sent).cast("double").alias("bytes"), (F.col("ts") - F.coalesce("earlier", "before")).alias("gap"))
    return store.put(single.unionByName(placed), "checkins")


def spreads(measures: DataFrame, store: Store, keys: list[str] = PAIR, most: int = MOST_HELD) -> DataFrame:
    """``keys, what``: count ``n``, ``median``, lower quartile ``q25`` and ``mad`` of ``value``, from rows ``keys, what, value``."""
    by = [*keys, "what"]
    center = store.put(group_quantiles(measures, by, "value", {"median": 0.5, "q25": 0.25}, most=most, store=store), "centers")
    off = same(measures.where("value is not null"), center.select(*by, "median"), by).select(*by, F.abs(F.col("value") - F.col("median")).alias("off"))
    return same(center, group_quantiles(off, by, "off", {"mad": 0.5}, sizes=center, most=most, store=store).drop("n"), by)


def _named_spread(spread: DataFrame, what: str, prefix: str, keys: list[str] = PAIR) -> DataFrame:
    return spread.where(F.col("what") == what).select(*keys, *[F.col(c).alias(f"{prefix}_{c}") for c in ("n", "median", "q25", "mad")])


def periodicity(events: DataFrame, periods: DataFrame, p: BeaconParams = BeaconParams(), keys: list[str] = PAIR) -> DataFrame:
    """Best autocorrelation of each pair's counts in time bins, for lags of .8 to 1.2 periods; only filled bins are rows.

    A bin is a fourth to a half of the period, so these lags are among ``LAGS``. Stretches of bins are dealt once, each with the first
    bins of the next one, and every lag is a frame of the same window.
    """
    span = F.col("e_last") - F.col("e_first")
    base = F.when(2.5 * F.col("gap_mad") > F.col("gap_median") / 2, None).otherwise(F.least(F.greatest(2.5 * F.col("gap_mad"), F.col("gap_median") / 4), F.col("gap_median") / 2))
    raw = F.floor(span / base) + 1
    res = F.when(raw > p.max_time_bins, F.when(span / p.max_time_bins <= F.col("gap_median") / 2, span / p.max_time_bins)).otherwise(base)
    grid = periods.where((F.col("checkins") >= 8) & (span > 0)).withColumn("res", res).where(F.col("res") > 0).withColumn("bins", F.least(F.floor(span / F.col("res")) + 1, F.lit(p.max_time_bins)).cast("long"))
    lo = F.greatest(F.lit(1), F.bround(0.8 * F.col("gap_median") / F.col("res")).cast("long"))
    hi = F.least(F.bround(1.2 * F.col("gap_median") / F.col("res")).cast("long"), F.col("bins") - 1)
    grid = grid.select(*keys, "e_first", "res", "bins", lo.alias("lo"), hi.alias("hi")).where("hi >= lo")
    placed = same(events.select(*keys, "ts"), grid, keys).withColumn("bin", F.least(F.floor((F.col("ts") - F.col("e_first")) / F.col("res")).cast("long"), F.col("bins") - 1))
    part = F.floor(F.col("bin") / PART_BINS).cast("int")
    halo = F.when((part > 0) & (F.col("bin") % PART_BINS < LAGS.stop), part - 1)
    dealt = placed.select(*keys, "bins", "lo", "hi", "bin", F.explode(F.array_compact(F.array(part, halo))).alias("part")).repartition(*keys, "part")
    counts = dealt.groupBy(*keys, "part", "bins", "lo", "hi", "bin").agg(F.count("*").cast("double").alias("c"))
    w = Window.partitionBy(*keys, "part").orderBy("bin")
    ahead = counts.withColumns({f"c{k}": F.coalesce(F.sum("c").over(w.rangeBetween(k, k)), F.lit(0.0)) for k in LAGS}).where(part == F.col("part"))
    c, lag_sums = F.col("c"), []
    for k in LAGS:
        lag_sums += [F.sum(c * F.col(f"c{k}")).alias(f"cross{k}"), F.sum(F.when(F.col("bin") < F.col("bins") - k, c).otherwise(0.0)).alias(f"head{k}"), F.sum(F.when(F.col("bin") >= k, c).otherwise(0.0)).alias(f"tail{k}")]
    sums = ahead.groupBy(*keys, "bins", "lo", "hi").agg(F.sum("c").alias("total"), F.sum(c * c).alias("squares"), *lag_sums)
    mean = F.col("total") / F.col("bins")
    under = F.col("squares") - F.col("bins") * mean * mean
    at = [F.when(F.lit(k).between(F.col("lo"), F.col("hi")), F.col(f"cross{k}") - mean * (F.col(f"head{k}") + F.col(f"tail{k}")) + (F.col("bins") - k) * mean * mean) for k in LAGS]
    best = F.when(under > 0, F.greatest(*at) / under).otherwise(0.0)
    return sums.select(*keys, F.least(F.lit(1.0), F.greatest(F.lit(0.0), best)).alias("periodicity"))


def score_pair(checkins: Column, span: Column, gap_n: Column, gap_median: Column, gap_q25: Column, gap_mad: Column, size_n: Column, size_median: Column, size_mad: Column, periodicity: Column, hosts: Column, p: BeaconParams = BeaconParams()) -> tuple[Column, dict[str, Column]]:
    """Of one (src, dst, port), from its gaps and sizes; ``periodicity`` is the best autocorrelation near the period, NULL if unmeasured."""
    one, gaps, expected = F.lit(1.0), gap_n.cast("double"), span / gap_median
    floor = F.when(gap_n < 4, 0.0).otherwise((gap_median - gap_q25) / gap_median)
    parts = {
        "interval_regularity": 1 - F.least(one, S.dispersion(gap_median, gap_mad) / p.interval_scale),
        "schedule_floor": 1 - F.least(one, floor / p.interval_scale),
        "payload_uniformity": F.when(size_n >= 3, 1 - F.least(one, S.dispersion(size_median, size_mad) / p.payload_scale)),
        "periodicity": periodicity,
        "persistence": F.least(gaps, expected) / F.greatest(gaps, expected) * S.saturating(checkins, p.persistence_scale),
        "destination_rarity": S.rarity(hosts),
    }
    return S.geometric_mean(list(zip(parts.values(), p.weights))), parts


def candidate_series(connections: DataFrame, candidates: DataFrame, p: BeaconParams, keys: list[str] = PAIR) -> DataFrame:
    """``keys, ts, orig_bytes, tie, chunk, chunks`` of the candidates' rows. A pair is cut into as many chunks of time as its rows need.

    ``keys`` are what candidates know their pair by: its addresses and port, or a number of theirs.
    """
    kept = connections.dropna(subset=["ts", "src_ip", "dst_ip"])
    if "service" in connections.columns:
        kept = kept.where(F.col("service").isNull() | ~F.lower("service").isin(*p.excluded_services))
    tie = F.col("source_line") if "source_line" in connections.columns else F.lit(0)
    chunks = F.ceil(F.col("flows") / p.chunk_rows)
    cut = candidates.select(*dict.fromkeys([*PAIR, *keys]), "first_seen", (F.col("last_seen") - F.col("first_seen")).alias("span"), chunks.alias("chunks"))
    share = (F.col("ts") - F.col("first_seen")) / F.col("span")
    chunk = F.least(F.col("chunks") - 1, F.floor(share * F.col("chunks"))).cast("int")
    return same(kept.select(*PAIR, "ts", "orig_bytes", tie.alias("tie")), cut, PAIR).select(*keys, "ts", "orig_bytes", "tie", chunk.alias("chunk"), F.col("chunks").cast("int").alias("chunks"))


def score_beacon_pairs(pairs: DataFrame, connections: DataFrame, p: BeaconParams = BeaconParams(), store: Store | None = None) -> DataFrame:
    """Scored beacons. The candidates' series and their check-ins are read several times, so they are stored.

    Candidates are numbered, and everything about their series is told by the number, not by two addresses and a port. All rows are
    shuffled once, to be ordered, and those that start a burst of several once more.
    """
    store, keys = store or Store(connections.sparkSession), ["pair"]
    summary = timed_pairs(pairs)
    open_port = F.col("dst_port").isNull() | ~F.col("dst_port").isin(*p.excluded_ports)
    candidates = summary.where((F.col("flows") >= p.min_checkins) & (F.col("last_seen") - F.col("first_seen") >= p.min_span) & open_port)
    candidates = store.put(candidates.withColumn("pair", F.monotonically_increasing_id()), "candidates")  # stored, so a pair keeps its number
    series = store.put(ordered(candidate_series(connections, candidates, p, keys), keys), "series")
    borders = store.put(chunk_borders(series, keys), "borders")
    thresholds = store.put(gap_thresholds(with_gaps(series, borders, keys), store, p, keys), "thresholds")
    events = checkins(series, borders, thresholds, store, keys)
    counts = events.groupBy(*keys).agg(F.count("*").alias("checkins"), F.min("ts").alias("e_first"), F.max("ts").alias("e_last")).where(F.col("checkins") >= p.min_checkins)
    measure = F.explode(F.array(F.struct(F.lit("gap").alias("what"), F.when(F.col("gap") > 0, F.col("gap")).alias("value")), F.struct(F.lit("size").alias("what"), F.col("bytes").alias("value"))))
    spread = store.put(spreads(events.select(*keys, measure.alias("m")).select(*keys, "m.*"), store, keys), "spreads")
    stats = same(same(counts, _named_spread(spread, "gap", "gap", keys), keys), _named_spread(spread, "size", "size", keys), keys, "left")
    stats = stats.where((F.col("gap_n") >= 3) & F.col("gap_median").between(*p.period))
    stats = store.put(same(stats, candidates.select(*keys, *PAIR, "first_seen", "last_seen"), keys), "stats")
    hosts = destination_hosts(summary.join(stats.select("dst_ip").distinct(), "dst_ip", "left_semi"))  # of what beacons contact only
    joined = same(stats.join(hosts, "dst_ip"), periodicity(events, stats, p, keys), keys, "left")
    cols = {c: F.col(c) for c in ("checkins", "gap_n", "gap_median", "gap_q25", "gap_mad", "size_n", "size_median", "size_mad", "periodicity", "hosts")}
    score, parts = score_pair(**cols, span=F.col("last_seen") - F.col("first_seen"), p=p)
    scored = joined.withColumns({**parts, "score": score})
    return scored.where(F.col("score") >= p.min_score).orderBy(F.desc(F.bround("score", 9)), *PAIR).limit(p.top)


def score_beacons(connections: DataFrame, p: BeaconParams = BeaconParams(), store: Store | None = None) -> DataFrame:
    store = store or Store(connections.sparkSession)
    return score_beacon_pairs(store.put(timed_totals(connections), "pairs"), connections, p, store)


def detect_beacons(connections: DataFrame, p: BeaconParams = BeaconParams(), samples: int = 0, pairs: DataFrame | None = None, store: Store | None = None) -> DataFrame:
    severity = F.when(F.col("score") >= p.critical_score, "critical").otherwise("high")
    summary = F.format_string("%s contacts %s every %.1f s", "src_ip", "dst_ip", "gap_median")
    scored = with_samples(score_beacons(connections, p, store) if pairs is None else score_beacon_pairs(pairs, connections, p, store), connections, PAIR, samples)
    return to_findings(scored, "beacons_to", F.col("src_ip"), "ip", F.col("dst_ip"), severity, "beaconing@1", {k: F.col(k) for k in BEACON_PARTS}, "beacon", summary, {**{k: F.col(k) for k in ("checkins", "gap_median", "hosts", "dst_port")}, **{k: F.col(k) for k in BEACON_PARTS}})
