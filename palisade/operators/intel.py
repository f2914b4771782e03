"""Indicators and assets: dimensions, matching joins, intel findings, shared infrastructure.

Matching never loops over a feed: an address is tried against the distinct prefix lengths in use where these are few, and looked up
in elementary ranges where they are many (``ranges``); a name is tried against its own parent zones. Each is an equi-join. The dimension side is left to the optimizer's size estimate; nothing forces a broadcast
of a feed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.shared import Store
from .findings import GRAMMAR, to_findings
from .names import lookup_totals
from .network import locator, pair_totals
from .ranges import match_ranges

#: Prefix lengths of a feed that an address is tried against one by one.
FEW_LENGTHS = 8


@dataclass(frozen=True)
class IntelParams:
    half_life_days: float = 180.0
    max_age_days: int = 730
    undated_cap: float = 0.35
    unprovenanced: float = 0.25
    floor: float = 0.10
    medium_score: float = 0.50
    per_indicator: int = 10
    top: int = 200
    top_links: int = 50
    breadth: tuple[int, int] = (2, 5)
    resolution_cap: float = 0.95
    netblock_score: float = 0.50


# ---------------------------------------------------------------- dimensions


def normalised_indicators(raw: DataFrame) -> DataFrame:
    """``raw`` (value, confidence, added, feed, source_file, source_line) with kind and one spelling; rejects left out.

    Of duplicates the best provenanced stays: with a confidence, then the higher one, then dated, then the newest, then by
    file and line.
    """
    known = raw.withColumn("kind", S.indicator_kind(F.col("value"))).where("kind is not null").withColumn("value", S.normal_indicator(F.col("value"), F.col("kind")))
    w = Window.partitionBy("kind", "value").orderBy(F.col("confidence").desc_nulls_last(), F.col("added").desc_nulls_last(), "source_file", "source_line")
    return known.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def rejected_indicators(raw: DataFrame) -> DataFrame:
    return raw.where(S.indicator_kind(F.col("value")).isNull()).select("source_file", "source_line", "value")


def indicator_counts(indicators: DataFrame) -> DataFrame:
    return indicators.groupBy("kind").agg(F.count("*").alias("indicators"))


def best_assets(raw: DataFrame) -> DataFrame:
    """One statement (address, hostname, stated, source_file, source_line) per address: dated, newest, by file, by line."""
    w = Window.partitionBy("address").orderBy(F.col("stated").desc_nulls_last(), "source_file", "source_line")
    return raw.withColumn("address", F.trim("address")).withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def staleness(stated: Column, start: Column, end: Column, stale: int = 90, expired: int = 730) -> Column:
    """How far a mapping's date may be trusted for a capture from ``start`` to ``end`` (dates)."""
    age = F.datediff(start, stated)
    return (
        F.when(stated.isNull(), "undated").when(start.isNull(), "unknown_window").when(end.isNotNull() & (stated > end), "stated_after_capture").when(age > expired, "expired").when(age > stale, "stale").otherwise("current")
    )


def capture_window(*tables: DataFrame) -> DataFrame:
    """One row: the first and last ``ts`` of all tables, and their dates."""
    parts = [t.agg(F.min("ts").alias("a"), F.max("ts").alias("b")) for t in tables]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    ends = union.agg(F.min("a").alias("window_start"), F.max("b").alias("window_end"))
    return ends.withColumns({"start_date": S.utc_date(F.col("window_start")), "end_date": S.utc_date(F.col("window_end"))})


def applied_assets(assets: DataFrame, window: DataFrame) -> DataFrame:
    """Statements with their ``staleness`` and ``applies``: an expired one renames nothing."""
    joined = best_assets(assets).crossJoin(F.broadcast(window.select("start_date", "end_date")))  # one row
    return joined.withColumn("staleness", staleness(F.col("stated"), F.col("start_date"), F.col("end_date"))).withColumn("applies", F.col("staleness") != "expired").drop("start_date", "end_date")


def coverage(assets: DataFrame, window: DataFrame, *tables: DataFrame) -> DataFrame:
    """One row: statements loaded, applied and dropped; source addresses observed and matched; the matched share."""
    statements = applied_assets(assets, window)
    seen = tables[0].select("src_ip")
    for t in tables[1:]:
        seen = seen.union(t.select("src_ip"))
    seen = seen.where("src_ip is not null").distinct()
    loaded = statements.agg(F.count("*").alias("loaded"), F.count_if("applies").alias("applied")).withColumn("dropped", F.col("loaded") - F.col("applied"))
    matched = seen.join(statements.where("applies").select(F.col("address").alias("src_ip"), F.lit(1).alias("hit")), "src_ip", "left").agg(F.count("*").alias("observed"), F.count("hit").alias("matched"))
    return loaded.crossJoin(F.broadcast(matched)).withColumn("fraction", F.coalesce(F.try_divide("matched", "observed"), F.lit(0.0)))  # one row each


def name_subjects(findings: DataFrame, statements: DataFrame) -> DataFrame:
    """Findings whose address subject an applied statement names speak of the host, and link the statement as evidence.

    Only where the grammar lets the predicate speak of a host: an indicator's match stays one of the address.
    """
    s = statements.where("applies").select(F.col("address").alias("_address"), F.col("hostname").alias("_hostname"), "staleness", F.col("source_file").alias("_file"), F.col("source_line").alias("_line"))
    joined = findings.join(s, (F.col("subject_type") == "ip") & F.col("predicate").isin(*[p for p, subjects, *_ in GRAMMAR if "host" in subjects]) & (F.col("subject") == F.col("_address")), "left")
    found = F.col("_hostname").isNotNull()
    payload = F.to_json(F.struct(F.col("_address").alias("address"), F.col("_hostname").alias("hostname"), F.col("staleness")))
    link = F.struct(S.content_id("ev", F.lit("asset_inventory"), payload).alias("id"), F.lit("asset_inventory").alias("kind"), F.concat_ws(" ", "_address", F.lit("is"), "_hostname").alias("summary"), payload.alias("payload"), F.struct(F.col("_file").alias("source_file"), F.col("_line").cast("long").alias("source_line")).alias("artifact"), F.array().cast("array<struct<source_file:string,source_line:bigint>>").alias("samples"))
    kept = [c for c in findings.columns if c not in ("subject", "subject_type", "evidence")]
    return joined.select(*kept, F.when(found, "host").otherwise(F.col("subject_type")).alias("subject_type"), F.when(found, F.col("_hostname")).otherwise(F.col("subject")).alias("subject"), F.when(found, F.concat("evidence", F.array(link))).otherwise(F.col("evidence")).alias("evidence")).select(*findings.columns)


# ---------------------------------------------------------------- matching joins


def match_addresses(addresses: DataFrame, indicators: DataFrame, column: str = "value") -> DataFrame:
    """Distinct addresses, IPv4 or IPv6, with the indicator that names them: the address itself, else the longest network.

    Adds ``indicator, indicator_kind, prefix``. The networks' distinct prefix lengths (162 at most) make the candidates.
    """
    host, stated = F.split_part("value", F.lit("/"), F.lit(1)), F.split_part("value", F.lit("/"), F.lit(2)).try_cast("int")
    keyed = indicators.where("kind in ('ip', 'cidr')").select("value", "kind", stated.alias("_stated"), S.address_key(host).alias("_key")).distinct()
    digits = F.length("_key")
    nets = keyed.select(digits.alias("_digits"), F.coalesce("_stated", 4 * digits).alias("_bits"), S.network_key(F.col("_key"), F.coalesce("_stated", 4 * digits)).alias("_base"), F.struct(F.col("value").alias("indicator"), F.col("kind").alias("indicator_kind"), F.coalesce("_stated", 4 * digits).alias("prefix")).alias("hit"))
    bits = nets.where("_digits is not null").groupBy("_digits").agg(F.collect_set("_bits").alias("lengths"))  # two rows of at most 33 and 129 numbers
    seen = addresses.select(column).distinct().select(column, S.address_key(F.col(column)).alias("_key")).distinct().withColumn("_digits", F.length("_key"))
    tried = seen.join(F.broadcast(bits), "_digits").select(column, "_key", "_digits", F.explode("lengths").alias("_bits"))
    tried = tried.withColumn("_base", S.network_key(F.col("_key"), F.col("_bits")))
    hits = tried.join(nets, ["_digits", "_bits", "_base"])
    return hits.groupBy(column).agg(F.max_by("hit", F.struct("_bits", F.col("hit.indicator_kind") == "ip")).alias("hit")).select(column, "hit.*")


def parent_zones(name: Column) -> Column:
    """The name and its parents down to two labels, as (zone, depth)."""
    parts = S.labels(name)
    n = F.size(parts)
    return F.transform(F.when(n >= 2, F.sequence(F.lit(0), n - 2)).otherwise(F.array(F.lit(0))), lambda d: F.struct(F.array_join(F.slice(parts, d + 1, n), ".").alias("zone"), d.alias("depth")))


def match_domains(names: DataFrame, indicators: DataFrame, column: str = "value") -> DataFrame:
    """Distinct names with the nearest indicator: the name itself, else its closest parent zone; never a bare top level."""
    zones = names.select(column).distinct().select(column, F.explode(parent_zones(F.col(column))).alias("z")).select(column, "z.*").where("zone <> ''")
    hits = zones.join(indicators.where("kind = 'domain'").select(F.col("value").alias("zone")), "zone")
    return hits.groupBy(column).agg(F.min_by("zone", "depth").alias("indicator"), F.min("depth").alias("depth")).withColumn("exact", F.col("depth") == 0)


def match_hashes(processes: DataFrame, indicators: DataFrame) -> DataFrame:
    feed = indicators.where("kind = 'file_hash'").select(F.col("value").alias("_hash"), F.col("value").alias("indicator"))
    return processes.join(feed, F.lower(F.trim("sha256")) == F.col("_hash")).drop("_hash")


# ---------------------------------------------------------------- observed values


def sightings(pairs: DataFrame, lookups: DataFrame) -> DataFrame:
    """``kind, value, role, peer, events, first_seen, last_seen``: each place of a pair's or a look-up's totals where an address or a name stands. Totals are read several times: from a store."""

    seen = ["first_seen", "last_seen", *(["first_at"] if "first_at" in pairs.columns and "first_at" in lookups.columns else [])]
    # either end by itself: a reader of values alone reads a column at a time, and a join with some values comes before any row is made
    ends = [pairs.select(F.lit("ip").alias("kind"), F.col(value).alias("value"), F.lit(role).alias("role"), F.col(peer).alias("peer"), F.col("flows").alias("events"), *seen) for value, role, peer in (("dst_ip", "destination", "src_ip"), ("src_ip", "source", "dst_ip"))]
    return ends[0].unionByName(ends[1]).unionByName(_lookup_sightings(lookups, seen)).where("value is not null and value <> ''")


def _place(kind: str, value: Column, role: str, peer: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(role).alias("role"), F.col(peer).alias("peer"))


def _lookup_sightings(lookups: DataFrame, seen: list[str]) -> DataFrame:
    answers = F.transform(F.filter(F.transform(F.split(F.coalesce("answers", F.lit("")), ";"), lambda a: F.trim(a)), lambda a: S.is_ipv4(a) | a.rlike(S.IPV6_SHAPE)), lambda a: _place("ip", S.canonical_ipv6(a), "answer", "src_ip"))
    return lookups.select(F.explode(F.concat(F.array(_place("domain", F.array_join(S.labels(F.col("query")), "."), "query", "src_ip")), answers)).alias("s"), F.col("queries").alias("events"), *seen).select("s.*", "events", *seen)


def folded(rows: DataFrame) -> DataFrame:
    """(kind, value) of sightings: events add up over roles, peers take the largest role's, roles are kept as a list."""
    times = [F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), *([F.min("first_at").alias("first_at")] if "first_at" in rows.columns else [])]
    pairs = rows.groupBy("kind", "value", "role", "peer").agg(F.sum("events").alias("events"), *times)
    roles = pairs.groupBy("kind", "value", "role").agg(F.sum("events").alias("events"), F.count("*").alias("peers"), *times)
    return roles.groupBy("kind", "value").agg(F.sum("events").alias("events"), F.max("peers").alias("peers"), *times, F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


def observed_values(connections: DataFrame, dns: DataFrame, places: bool = False) -> DataFrame:
    """With ``places`` each value has its ``first_at``, too."""
    dropped, store = () if places else ("first_at",), Store(connections.sparkSession)
    return folded(sightings(store.put(pair_totals(connections).drop(*dropped), "pairs"), store.put(lookup_totals(dns).drop(*dropped), "lookups")))


def matches(values: DataFrame, indicators: DataFrame, store: Store | None = None) -> DataFrame:
    """``kind, value, indicator, indicator_kind`` of the distinct ``values (kind, value)`` that a feed names.

    An address is tried against each prefix length of the feed, or, where there are more than ``FEW_LENGTHS``, looked up in ranges.
    """
    lengths = indicators.where("kind in ('ip', 'cidr')").select(F.contains("value", F.lit(":")), F.split_part("value", F.lit("/"), F.lit(2))).distinct().limit(FEW_LENGTHS + 1).count()
    addresses = values.where("kind = 'ip'")
    matched = match_addresses(addresses, indicators) if lengths <= FEW_LENGTHS else match_ranges(addresses, indicators, store=store)
    ips = matched.select(F.lit("ip").alias("kind"), "value", "indicator", "indicator_kind")
    names = match_domains(values.where("kind = 'domain'"), indicators).select(F.lit("domain").alias("kind"), "value", "indicator", F.lit("domain").alias("indicator_kind"))
    return ips.unionByName(names)


def matched_values(connections: DataFrame, dns: DataFrame, indicators: DataFrame, store: Store | None = None, places: bool = False) -> DataFrame:
    """Observed values that a feed names. With ``places`` each has its ``first_at``, too."""
    dropped = () if places else ("first_at",)
    store = store or Store(connections.sparkSession)
    pairs, lookups = store.put(pair_totals(connections).drop(*dropped), "pairs"), store.put(lookup_totals(dns).drop(*dropped), "lookups")
    return matched_sightings(sightings(pairs, lookups), indicators, store)


def matched_sightings(rows: DataFrame, indicators: DataFrame, store: Store) -> DataFrame:
    """The sightings' values that a feed names, with its indicators.

    Values are matched first, on their own; then only those that are named are folded by role and peer, of which nearly every
    sighting has its own. ``rows`` are read twice: from stored totals, as a rule.
    """
    values, feed = store.put(rows.select("kind", "value").distinct(), "observed"), store.put(indicators.select("kind", "value"), "feed")
    hits = store.put(matches(values, feed, store), "hits")
    named = rows.join(hits.select("kind", "value"), ["kind", "value"], "left_semi")
    return store.put(folded(named).join(hits, ["kind", "value"]), "matched")


def score_match(confidence: Column, age_days: Column, p: IntelParams = IntelParams()) -> Column:
    """Declared confidence times age; an undated indicator is capped, one without a confidence has little."""
    base = F.coalesce(confidence, F.lit(p.unprovenanced))
    return F.when(age_days.isNull(), F.least(base, F.lit(p.undated_cap))).otherwise(S.half_life(base, age_days, p.half_life_days))


def score_matches(matched: DataFrame, indicators: DataFrame, p: IntelParams = IntelParams()) -> DataFrame:
    """Values that a feed names: declared confidence times age; traffic volume never enters."""
    feed = indicators.select(F.col("value").alias("indicator"), F.col("kind").alias("indicator_kind"), "confidence", "added")
    joined = matched.join(feed, ["indicator", "indicator_kind"])
    age = F.when(F.col("added").isNotNull(), F.greatest(F.datediff(S.utc_date(F.col("first_seen")), F.col("added")), F.lit(0)))
    scored = joined.withColumn("age_days", age).withColumn("score", score_match(F.col("confidence"), F.col("age_days"), p))
    return scored.where((F.col("score") >= p.floor) & (F.col("age_days").isNull() | (F.col("age_days") <= p.max_age_days)))


def capped_matches(scored: DataFrame, p: IntelParams = IntelParams()) -> DataFrame:
    """The busiest values of each indicator, with the true number of its values, then the cap over all."""
    w = Window.partitionBy("indicator", "indicator_kind")
    ranked = scored.withColumns({"place": F.row_number().over(w.orderBy(F.desc("events"), "value")), "indicator_values": F.count("*").over(w)})
    return ranked.where(F.col("place") <= p.per_indicator).drop("place").orderBy(F.desc(F.bround("score", 9)), "kind", "value").limit(p.top)


def with_value_places(scored: DataFrame, connections: DataFrame, lookups: DataFrame) -> DataFrame:
    """Scored values, which the caps have made few, with ``first_at``: where each was first seen, among the single rows of connections and the look-ups' totals."""
    at = F.struct(F.col("ts").cast("double").alias("ts"), "source_file", F.col("source_line").cast("long").alias("source_line")).alias("first_at")
    ends = [connections.select(F.lit("ip").alias("kind"), F.col(c).alias("value"), at) for c in ("src_ip", "dst_ip")]
    seen = ends[0].unionByName(ends[1]).unionByName(_lookup_sightings(lookups, ["first_at"]).select("kind", "value", "first_at")).join(F.broadcast(scored.select("kind", "value")), ["kind", "value"], "left_semi")
    return scored.join(seen.groupBy("kind", "value").agg(F.min("first_at").alias("first_at")), ["kind", "value"], "left")


def detect_intel(connections: DataFrame, dns: DataFrame, indicators: DataFrame, p: IntelParams = IntelParams(), matched: DataFrame | None = None, store: Store | None = None, lookups: DataFrame | None = None) -> DataFrame:
    """``matched`` may come without first places; with the ``lookups`` that it was made from they are looked up for what is claimed."""
    matched = matched_values(connections, dns, indicators, store, places=True) if matched is None else matched
    scored = capped_matches(score_matches(matched, indicators, p), p)
    if "first_at" not in scored.columns and lookups is not None and "first_at" in lookups.columns and {"source_file", "source_line"} <= set(connections.columns):
        scored = with_value_places((store or Store(indicators.sparkSession)).put(scored, "matches"), connections, lookups)
    if "first_at" in scored.columns:
        scored = scored.withColumn("artifact", locator())
    severity = F.when(F.col("score") >= p.medium_score, "medium").otherwise("low")
    summary = F.format_string("%s matches indicator %s", "value", "indicator")
    return to_findings(scored, "matches_threat_intel", F.col("value"), None, None, severity, "intel@1", {"declared_confidence": F.col("score")}, "indicator_match", summary, {k: F.col(k) for k in ("indicator", "indicator_kind", "confidence", "age_days", "events", "peers", "roles")}, subject_type=F.col("kind"))


# ---------------------------------------------------------------- shared infrastructure


def shared_resolution(dns: DataFrame, flagged: DataFrame, p: IntelParams = IntelParams()) -> DataFrame:
    """(flagged name, other name, answer, breadth): names that resolve to one address, one end flagged.

    ``flagged``: (value, indicator). An address with more names than the breadth allows is hosting, not a link; it is counted
    before any name is paired, so pairs are at most breadth squared per address. Two names of one indicator are no link.
    """
    answers = dns.select("ts", F.array_join(S.labels(F.col("query")), ".").alias("name"), F.explode(F.split("answers", ";")).alias("answer")).withColumn("answer", F.trim("answer")).where("answer <> '' and name <> ''")
    names = answers.groupBy("answer", "name").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    narrow = names.groupBy("answer").agg(F.count("*").alias("breadth")).where(F.col("breadth").between(*p.breadth))
    marked = names.join(narrow, "answer").join(flagged.select(F.col("value").alias("name"), "indicator"), "name", "left")
    a = marked.where("indicator is not null").select("answer", "breadth", F.col("name").alias("anchor"), F.col("indicator").alias("anchor_indicator"), F.col("first_seen").alias("a_first"), F.col("last_seen").alias("a_last"))
    b = marked.select("answer", F.col("name").alias("other"), F.col("indicator").alias("other_indicator"), "first_seen", "last_seen")
    pairs = a.join(b, "answer").where((F.col("anchor") != F.col("other")) & (F.col("other_indicator").isNull() | (F.col("other_indicator") != F.col("anchor_indicator"))))
    pairs = pairs.where(F.col("other_indicator").isNull() | (F.col("anchor") < F.col("other")))  # both flagged: once
    one = pairs.groupBy("anchor", "other").agg(F.min_by(F.struct("answer", "breadth"), F.struct("breadth", "answer")).alias("via"), F.min(F.least("a_first", "first_seen")).alias("first_seen"), F.max(F.greatest("a_last", "last_seen")).alias("last_seen"))
    return one.select("anchor", "other", "via.answer", "via.breadth", "first_seen", "last_seen").withColumn("score", F.least(F.lit(p.resolution_cap), 2 / F.col("breadth")))


def shared_netblocks(flagged: DataFrame, p: IntelParams = IntelParams()) -> DataFrame:
    """(address, address, /24): flagged IPv4 addresses of one /24 that different indicators name.

    The lowest address of each indicator is an anchor and is linked with each address of the others, so a block has at most
    256 times 256 links; a pair of two anchors is linked once, from the lower one.
    """
    net = flagged.where("kind = 'ip'").withColumn("number", S.ipv4_number(F.col("value"))).where("number is not null").withColumn("network24", S.ipv4_network(F.col("number"), 24))
    lowest = Window.partitionBy("network24", "indicator", "indicator_kind")
    marked = net.withColumn("is_anchor", F.col("number") == F.min("number").over(lowest)).select("network24", "value", "number", F.struct("indicator", "indicator_kind").alias("by"), "first_seen", "last_seen", "is_anchor")
    a = marked.where("is_anchor").select("network24", F.col("value").alias("anchor"), F.col("number").alias("a_number"), F.col("by").alias("a_by"), F.col("first_seen").alias("a_first"), F.col("last_seen").alias("a_last"))
    linked = a.join(marked.withColumnRenamed("value", "other"), "network24").where(F.col("a_by") != F.col("by")).where(~F.col("is_anchor") | (F.col("a_number") < F.col("number")))
    return linked.select("anchor", "other", S.dotted(F.col("network24")).alias("network24"), F.least("a_first", "first_seen").alias("first_seen"), F.greatest("a_last", "last_seen").alias("last_seen"), F.lit(p.netblock_score).alias("score"))


def address_anchored(dns: DataFrame, flagged: DataFrame, p: IntelParams = IntelParams()) -> DataFrame:
    """(flagged address, name, breadth): names that resolve to an address which is itself flagged, by another indicator than theirs.

    ``flagged``: (kind, value, indicator). As in ``shared_resolution`` an address of more names than the breadth allows is no link.
    """
    answers = dns.select("ts", F.array_join(S.labels(F.col("query")), ".").alias("name"), F.explode(F.split("answers", ";")).alias("answer")).withColumn("answer", S.canonical_ipv6(F.trim("answer"))).where("answer <> '' and name <> ''")
    own = flagged.where("kind = 'ip'").select(F.col("value").alias("answer"), F.col("indicator").alias("anchor_indicator"))
    names = answers.join(own, "answer").groupBy("answer", "anchor_indicator", "name").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    narrow = names.groupBy("answer").agg(F.count("*").alias("breadth")).where(F.col("breadth").between(*p.breadth))
    marked = names.join(narrow, "answer").join(flagged.where("kind = 'domain'").select(F.col("value").alias("name"), "indicator"), "name", "left")
    kept = marked.where(F.col("indicator").isNull() | (F.col("indicator") != F.col("anchor_indicator")))
    return kept.select(F.col("answer").alias("anchor"), F.col("name").alias("other"), "answer", "breadth", "first_seen", "last_seen").withColumn("score", F.least(F.lit(p.resolution_cap), 2 / F.col("breadth")))


def name_objects(findings: DataFrame, names: DataFrame) -> DataFrame:
    """Findings whose object is an address that ``names (address, domain)`` knows speak of the domain, if the grammar lets them. Of several, the first by name."""
    one = names.groupBy(F.col("address").alias("_address")).agg(F.min(F.lower("domain")).alias("_domain"))
    joined = findings.join(one, (F.col("object_type") == "ip") & F.col("predicate").isin(*[p for p, _, objects, *_ in GRAMMAR if objects and "domain" in objects]) & (F.col("object") == F.col("_address")), "left")
    found = F.col("_domain").isNotNull()
    kept = [c for c in findings.columns if c not in ("object", "object_type")]
    return joined.select(*kept, F.when(found, "domain").otherwise(F.col("object_type")).alias("object_type"), F.coalesce("_domain", "object").alias("object")).select(*findings.columns)


def observed_names(dns: DataFrame) -> DataFrame:
    """``address, domain``: the name each answer belongs to, where it is one name only."""
    answers = dns.select(F.array_join(S.labels(F.col("query")), ".").alias("domain"), F.explode(F.split("answers", ";")).alias("address")).withColumn("address", S.canonical_ipv6(F.trim("address")))
    known = answers.where((S.is_ipv4(F.col("address")) | F.col("address").rlike(S.IPV6_SHAPE)) & (F.col("domain") != ""))
    return known.groupBy("address").agg(F.min("domain").alias("domain"), F.max("domain").alias("_last")).where(F.col("domain") == F.col("_last")).drop("_last")


def detect_infrastructure(connections: DataFrame, dns: DataFrame, indicators: DataFrame, p: IntelParams = IntelParams(), matched: DataFrame | None = None, lookups: DataFrame | None = None, store: Store | None = None) -> DataFrame:
    store = store or Store(indicators.sparkSession)
    matched = matched_values(connections, dns, indicators, store) if matched is None else matched
    matched = store.put(score_matches(matched, indicators, p), "flagged")
    # what answered which name is read from the look-ups' totals, twice for their first and last time
    if lookups is None:
        lookups = store.put(lookup_totals(dns).drop("first_at"), "lookups")
    timed = lookups.select("query", "answers", F.explode(F.array("first_seen", "last_seen")).alias("ts"))
    names = shared_resolution(timed, matched.where("kind = 'domain'"), p)
    anchored = address_anchored(timed, matched, p)
    blocks = shared_netblocks(matched, p)
    a = to_findings(names.orderBy(F.desc("score"), "anchor", "other").limit(p.top_links), "shares_infrastructure_with", F.col("anchor"), "domain", F.col("other"), F.lit("info"), "intel@1", {"narrowness": F.col("score")}, "shared_resolution", F.format_string("%s and %s resolve to %s", "anchor", "other", "answer"), {"answer": F.col("answer"), "breadth": F.col("breadth")}, subject_type="domain")
    c = to_findings(anchored.orderBy(F.desc("score"), "anchor", "other").limit(p.top_links), "shares_infrastructure_with", F.col("anchor"), "domain", F.col("other"), F.lit("info"), "intel@1", {"narrowness": F.col("score")}, "shared_resolution", F.format_string("%s resolves to the flagged %s", "other", "anchor"), {"answer": F.col("answer"), "breadth": F.col("breadth")})
    b = to_findings(blocks.orderBy("anchor", "other").limit(p.top_links), "shares_infrastructure_with", F.col("anchor"), "ip", F.col("other"), F.lit("info"), "intel@1", {"netblock": F.col("score")}, "shared_netblock", F.format_string("%s and %s lie in %s/24", "anchor", "other", "network24"), {"network24": F.col("network24")})
    return a.unionByName(c).unionByName(b).orderBy(F.desc("score"), "subject", "object").limit(p.top_links)
