"""Detectors over DNS and TLS: tunnelling, algorithmic domains, rare client fingerprints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.shared import Store
from .findings import to_findings, with_samples
from .network import first_place, locator

# ---------------------------------------------------------------- DNS tunnelling

#: Query types that carry more payload than an address lookup.
HIGH_CAPACITY_TYPES = ("TXT", "NULL", "CNAME", "MX", "SRV", "10", "16")


@dataclass(frozen=True)
class TunnelParams:
    weights: tuple[float, float, float, float] = (0.40, 0.25, 0.25, 0.10)
    entropy_ramp: tuple[float, float] = (3.2, 4.6)
    cardinality_scale: float = 200.0
    length_scale: float = 40.0
    min_queries: int = 50
    min_distinct: int = 30
    min_length: int = 8
    min_score: float = 0.62
    critical_score: float = 0.85
    top: int = 200


def lookup_totals(dns: DataFrame) -> DataFrame:
    """(src, query, answers), each of which may be NULL: queries, codes, times and first place, from which all detectors over DNS start."""
    none = F.lit(None).cast("string")
    rows = dns.withColumns({c: none for c in ("qtype", "rcode", "answers") if c not in dns.columns})
    nx = F.upper("rcode").isin("NXDOMAIN", "3")
    return rows.groupBy("src_ip", "query", "answers").agg(
        F.count("*").alias("queries"), F.count_if(F.coalesce(F.upper("qtype").isin(*HIGH_CAPACITY_TYPES), F.lit(False))).alias("high"), F.count("rcode").alias("known"), F.count_if(nx).alias("nx"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), first_place(rows),
    )


def tunnel_zones(lookups: DataFrame, p: TunnelParams = TunnelParams()) -> DataFrame:
    """(src, zone) sums; entropy and length over distinct subdomains, shares over all queries. Names aren't collected."""
    rows = lookups.dropna(subset=["src_ip", "query"]).withColumn("zone", S.registered_domain(F.col("query"))).where("zone <> ''")
    rows = rows.withColumn("sub", S.subdomain_of(F.col("query"), F.col("zone")))
    subs = rows.groupBy("src_ip", "zone", "sub").agg(F.sum("queries").alias("queries"), F.sum("high").alias("high"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min("first_at").alias("first_at"))
    long = F.length("sub") >= p.min_length
    measured = subs.withColumn("entropy", F.when(long, S.byte_entropy(F.col("sub"))))
    zones = measured.groupBy("src_ip", "zone").agg(
        F.sum("queries").alias("queries"), F.sum("high").alias("high"), F.count_if(long).alias("distinct_names"), F.avg("entropy").alias("mean_entropy"), F.avg(F.when(long, F.length("sub"))).alias("mean_length"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min("first_at").alias("first_at"),
    )
    return zones.where((F.col("queries") >= p.min_queries) & (F.col("distinct_names") >= p.min_distinct))


def score_zone(mean_entropy: Column, distinct_names: Column, mean_length: Column, high: Column, queries: Column, p: TunnelParams = TunnelParams()) -> tuple[Column, dict[str, Column]]:
    """Of one (src, zone): no types of high capacity is no measure of them."""
    share = high / queries
    parts = {
        "label_entropy": S.ramp(mean_entropy, *p.entropy_ramp),
        "subdomain_cardinality": S.saturating(distinct_names, p.cardinality_scale),
        "query_length": S.saturating(mean_length, p.length_scale),
        "qtype_skew": F.when(share > 0, F.least(F.lit(1.0), 2 * share)),
    }
    return S.geometric_mean(list(zip(parts.values(), p.weights))), parts


def score_tunnels(dns: DataFrame, p: TunnelParams = TunnelParams()) -> DataFrame:
    return score_tunnel_lookups(lookup_totals(dns), p)


def score_tunnel_lookups(lookups: DataFrame, p: TunnelParams = TunnelParams()) -> DataFrame:
    score, parts = score_zone(*[F.col(c) for c in ("mean_entropy", "distinct_names", "mean_length", "high", "queries")], p)
    scored = tunnel_zones(lookups, p).withColumns({**parts, "score": score}).where(F.col("score") >= p.min_score)
    return scored.orderBy(F.desc(F.bround("score", 9)), "src_ip", "zone").limit(p.top)


def detect_tunnels(dns: DataFrame, p: TunnelParams = TunnelParams(), samples: int = 0, lookups: DataFrame | None = None) -> DataFrame:
    zoned = dns.withColumn("zone", S.registered_domain(F.col("query")))
    scored = with_samples(score_tunnel_lookups(lookup_totals(dns) if lookups is None else lookups, p).withColumn("artifact", locator()), zoned, ["src_ip", "zone"], samples)
    names = ("label_entropy", "subdomain_cardinality", "query_length", "qtype_skew")
    severity = F.when(F.col("score") >= p.critical_score, "critical").otherwise("high")
    summary = F.format_string("%s queried %d names below %s", "src_ip", "distinct_names", "zone")
    return to_findings(scored, "tunnels_dns_over", F.col("src_ip"), "domain", F.col("zone"), severity, "dns_tunnel@1", {k: F.col(k) for k in names}, "dns_zone", summary, {k: F.col(k) for k in ("queries", "distinct_names", "mean_entropy", "mean_length")})


# ---------------------------------------------------------------- bigram model

ALPHABET = 37  # a-z, 0-9 and the hyphen
SMOOTHING = 0.5


def _bigrams(text: Column) -> Column:
    clean = F.regexp_replace(F.lower(text), "[^a-z0-9-]", "")
    return F.transform(F.sequence(F.lit(1), F.length(clean) - 1), lambda i: F.substr(clean, i, F.lit(2)))


def fit_bigrams(words: DataFrame, column: str = "word") -> DataFrame:
    """``(bigram, surprise, unseen, typical)``: at most 37 squared rows, with the two anchors on each.

    ``typical`` is the model's own mean surprise, ``unseen`` the surprise of a pair that never occurred.
    """
    # words repeat, so they are counted first, and only distinct ones are cleaned and cut into pairs
    spelt = words.groupBy(F.col(column).alias("spelt")).agg(F.count("*").alias("times"))
    distinct = spelt.groupBy(F.regexp_replace(F.lower("spelt"), "[^a-z0-9-]", "").alias("word")).agg(F.sum("times").alias("times")).where(F.length("word") >= 2)
    counts = distinct.select(F.explode(_bigrams(F.col("word"))).alias("bigram"), "times").groupBy("bigram").agg(F.sum("times").alias("c"))
    # at most 37 squared rows from here on, which one aggregation holds: the words are read once
    table = counts.agg(F.array_sort(F.collect_list(F.struct("bigram", "c"))).alias("rows"), F.sum("c").alias("total"), F.count("*").alias("seen"))
    denominator = F.col("total") + SMOOTHING * ALPHABET * ALPHABET

    def chance(c: Column) -> Column:
        return (c + SMOOTHING) / denominator

    known = F.aggregate("rows", F.lit(0.0), lambda total, r: total - chance(r["c"]) * F.log2(chance(r["c"])))
    rest = SMOOTHING / denominator
    anchored = table.withColumns({"unseen": -F.log2(rest), "typical": known - (ALPHABET * ALPHABET - F.col("seen")) * rest * F.log2(rest)})
    return anchored.select(F.explode("rows").alias("r"), "unseen", "typical", denominator.alias("d")).select("r.bigram", (-F.log2((F.col("r.c") + SMOOTHING) / F.col("d"))).alias("surprise"), "unseen", "typical")


def improbability(labels: DataFrame, model: DataFrame, column: str = "label") -> DataFrame:
    """``(label, improbability)`` of distinct labels: mean surprise between the model's anchors; NULL for one character."""
    distinct = labels.select(column).distinct()
    kept = distinct.where(F.length(F.regexp_replace(F.lower(F.col(column)), "[^a-z0-9-]", "")) >= 2)
    # one row that holds the whole model, at most 37 squared entries: labels meet it once, and no bigram is a row of its own
    one = model.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bigram", "surprise")))).alias("m"), F.max("unseen").alias("u"), F.max("typical").alias("n"))
    joined = kept.crossJoin(F.broadcast(one)).withColumn("pairs", _bigrams(F.col(column)))
    mean = F.aggregate("pairs", F.lit(0.0), lambda total, b: total + F.coalesce(F.try_element_at("m", b), F.col("u"))) / F.size("pairs")
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (mean - F.col("n")) / (F.col("u") - F.col("n"))))
    return joined.select(column, clipped.alias("improbability"))


# ---------------------------------------------------------------- algorithmic domains


@dataclass(frozen=True)
class DgaParams:
    weights: tuple[float, float, float] = (0.34, 0.56, 0.10)
    min_label: int = 6
    min_labels: int = 12
    min_queries: int = 30
    nxdomain_ramp: tuple[float, float] = (0.10, 0.70)
    min_coverage: float = 0.5
    run_ramp: tuple[float, float] = (4.0, 9.0)
    digit_ramp: tuple[float, float] = (0.15, 0.50)
    min_score: float = 0.65
    high_score: float = 0.85
    per_family: int = 3
    top: int = 100


def score_domain(label: Column, improbability: Column, family_queries: Column, family_known: Column, family_nx: Column, p: DgaParams = DgaParams()) -> tuple[Column, dict[str, Column]]:
    """Of one label, with its family's codes: a rate needs codes of enough queries."""
    rate = F.when(family_known / family_queries >= p.min_coverage, family_nx / family_known)
    parts = {
        "nxdomain_rate": S.ramp(rate, *p.nxdomain_ramp),
        "bigram_improbability": improbability,
        "structure": S.soft_or(S.ramp(S.longest_consonant_run(label), *p.run_ramp), S.ramp(S.digit_ratio(label), *p.digit_ramp)),
    }
    return S.geometric_mean(list(zip(parts.values(), p.weights))), parts


def score_domains(dns: DataFrame, model: DataFrame, p: DgaParams = DgaParams(), store: Store | None = None) -> DataFrame:
    return score_domain_lookups(lookup_totals(dns).drop("first_at"), model, p, store)


def score_domain_lookups(lookups: DataFrame, model: DataFrame, p: DgaParams = DgaParams(), store: Store | None = None) -> DataFrame:
    """The best labels of each family. The labels' counts and the model are read several times, so they are stored."""
    store = store or Store(lookups.sparkSession)
    model = store.put(model, "bigrams")
    rows = lookups.dropna(subset=["src_ip", "query"]).withColumn("name", S.registered_domain(F.col("query"))).where(F.contains("name", F.lit(".")))
    rows = rows.withColumns({"label": S.first_label(F.col("name")), "suffix": S.after_first_label(F.col("name"))}).where(F.length("label") >= p.min_label)
    first = [F.min("first_at").alias("first_at")] if "first_at" in rows.columns else []
    by_label = rows.groupBy("src_ip", "suffix", "label").agg(*[F.sum(c).alias(c) for c in ("queries", "known", "nx")], (F.sum("known") > F.sum("nx")).alias("resolved"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), *first)
    by_label = store.put(by_label, "labels")
    family = by_label.groupBy("src_ip", "suffix").agg(F.count("*").alias("labels"), F.sum("queries").alias("family_queries"), F.sum("known").alias("family_known"), F.sum("nx").alias("family_nx"))
    family = family.where((F.col("labels") >= p.min_labels) & (F.col("family_queries") >= p.min_queries))
    joined = store.put(by_label.join(family, ["src_ip", "suffix"]), "families")
    joined = joined.join(improbability(joined, model), "label", "left")
    score, parts = score_domain(*[F.col(c) for c in ("label", "improbability", "family_queries", "family_known", "family_nx")], p)
    scored = joined.withColumns({**parts, "score": score}).where(F.col("score") >= p.min_score)
    w = Window.partitionBy("src_ip", "suffix").orderBy(F.desc("resolved"), F.desc(F.bround("score", 9)), "label")
    best = scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= p.per_family)
    return best.orderBy(F.desc(F.bround("score", 9)), "src_ip", "suffix", "label").limit(p.top)


def detect_domains(dns: DataFrame, model: DataFrame, p: DgaParams = DgaParams(), samples: int = 0, lookups: DataFrame | None = None, store: Store | None = None) -> DataFrame:
    named = dns.withColumn("_name", S.registered_domain(F.col("query"))).withColumns({"label": S.first_label(F.col("_name")), "suffix": S.after_first_label(F.col("_name"))})
    scored = with_samples(score_domain_lookups(lookup_totals(dns) if lookups is None else lookups, model, p, store).withColumn("artifact", locator()), named, ["src_ip", "suffix", "label"], samples)
    names = ("nxdomain_rate", "bigram_improbability", "structure")
    severity = F.when(F.col("score") >= p.high_score, "high").otherwise("medium")
    name = F.concat_ws(".", "label", "suffix")
    summary = F.format_string("%s looked up %d labels below %s", "src_ip", "labels", "suffix")
    return to_findings(scored, "resolves_algorithmic_domain", F.col("src_ip"), "domain", name, severity, "dga@1", {k: F.col(k) for k in names}, "domain_family", summary, {k: F.col(k) for k in ("labels", "family_queries", "resolved")})


# ---------------------------------------------------------------- TLS fingerprints


@dataclass(frozen=True)
class TlsParams:
    weights: tuple[float, float] = (0.65, 0.35)
    min_estate: int = 10
    min_sessions: int = 3
    max_hosts: int = 2
    estate_scale: float = 50.0
    min_score: float = 0.70
    top: int = 20


def session_totals(ssl: DataFrame) -> DataFrame:
    """(src, fingerprint, dst), each of which may be NULL: sessions, times and first place."""
    return ssl.groupBy("src_ip", "ja3", "dst_ip").agg(F.count("*").alias("sessions"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), first_place(ssl))


def score_fingerprint(hosts: Column, estate: Column, p: TlsParams = TlsParams()) -> tuple[Column, dict[str, Column]]:
    parts = {"fingerprint_rarity": S.rarity(hosts), "estate_support": S.saturating(estate, p.estate_scale)}
    return S.geometric_mean(list(zip(parts.values(), p.weights))), parts


def score_fingerprints(ssl: DataFrame, p: TlsParams = TlsParams()) -> DataFrame:
    return score_fingerprint_sessions(session_totals(ssl), p)


def score_fingerprint_sessions(sessions: DataFrame, p: TlsParams = TlsParams()) -> DataFrame:
    """A session without a fingerprint is unmeasured: it counts for the estate, but forms no group."""
    rows = sessions.where("src_ip is not null")
    estate = rows.agg(F.count_distinct("src_ip").alias("estate")).where(F.col("estate") >= p.min_estate)
    known = rows.where(F.trim("ja3") != "")
    groups = known.groupBy("src_ip", "ja3").agg(F.sum("sessions").alias("sessions"), F.count("dst_ip").alias("servers"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min("first_at").alias("first_at"))
    hosts = groups.groupBy("ja3").agg(F.count("*").alias("hosts")).where(F.col("hosts") <= p.max_hosts)
    joined = groups.where(F.col("sessions") >= p.min_sessions).join(hosts, "ja3").crossJoin(F.broadcast(estate))  # one row
    score, parts = score_fingerprint(F.col("hosts"), F.col("estate"), p)
    scored = joined.withColumns({**parts, "score": score}).where(F.col("score") >= p.min_score)
    return scored.orderBy(F.desc(F.bround("score", 9)), "src_ip", "ja3").limit(p.top)


def detect_fingerprints(ssl: DataFrame, p: TlsParams = TlsParams(), samples: int = 0, sessions: DataFrame | None = None) -> DataFrame:
    scored = with_samples(score_fingerprint_sessions(session_totals(ssl) if sessions is None else sessions, p).withColumn("artifact", locator()), ssl, ["src_ip", "ja3"], samples)
    summary = F.format_string("%s presented a client fingerprint of %d hosts", "src_ip", "hosts")
    return to_findings(scored, "presents_rare_tls_fingerprint", F.col("src_ip"), "tls_fingerprint", F.col("ja3"), F.lit("medium"), "tls@1", {k: F.col(k) for k in ("fingerprint_rarity", "estate_support")}, "tls_client", summary, {k: F.col(k) for k in ("sessions", "servers", "hosts", "estate")})
