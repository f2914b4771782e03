"""Incidents: findings grouped by subject, ranked by what corroborates what."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.findings import DERIVED, GRAMMAR, SUPPORTING, to_findings, with_finding_id
from ..sources.shared import Store

UNARY = tuple(p for p, _, objects, *_ in GRAMMAR if objects is None)


@dataclass(frozen=True)
class CorrelationParams:
    supporting: tuple[str, ...] = SUPPORTING
    derived: tuple[str, ...] = DERIVED
    step: float = 0.5
    most: float = 2.5
    same_clock_floor: float = 1.0
    cross_clock_floor: float = 300.0
    attach_unary: bool = True

    def __post_init__(self):
        if set(self.derived) & set(self.supporting):
            raise ValueError("a predicate is either supporting or derived")


def subject_key() -> Column:
    return S.entity_id(F.col("subject_type"), F.col("subject"))


def object_key() -> Column:
    return S.entity_id(F.col("object_type"), F.col("object"))


def members(findings: DataFrame, p: CorrelationParams = CorrelationParams()) -> DataFrame:
    """Findings with the ``incident`` they belong to (their subject's key), after following objects to unary subjects.

    A unary finding joins every incident that names its subject as an object. Where each finding of a group joined
    others, the group doesn't stand alone.
    """
    own = findings.withColumn("incident", subject_key())
    if not p.attach_unary:
        return own
    unary = F.col("predicate").isin(*UNARY)
    naming = own.where(F.col("object").isNotNull()).select(F.col("incident").alias("target"), object_key().alias("named")).distinct()
    moved = own.where(unary).join(naming, (F.col("incident") == F.col("named")) & (F.col("target") != F.col("incident")))
    anchored = own.join(moved.select("finding_id").distinct(), "finding_id", "left_anti").select("incident").distinct()
    added = moved.withColumn("incident", F.col("target")).select(*own.columns)
    return own.unionByName(added).join(anchored, "incident", "left_semi").select(*own.columns)


def rank(grouped: DataFrame, p: CorrelationParams = CorrelationParams()) -> DataFrame:
    """One row per incident: priority, severity, corroborating behaviours, title, rationale, rank."""
    strongest = grouped.groupBy("incident", "predicate").agg(F.max("score").alias("strongest"), F.count("*").alias("findings"), F.max(S.severity_rank(F.col("severity"))).alias("severity_rank"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    evidential, corroborates = ~F.col("predicate").isin(*p.derived), ~F.col("predicate").isin(*p.derived, *p.supporting)
    doubt = F.product(F.when(evidential, 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("strongest")))).otherwise(1.0))
    lines = F.array_sort(F.collect_list(F.concat_ws(" ", "predicate", F.format_number(F.col("strongest"), 2))))  # a predicate each: 18 at most
    out = strongest.groupBy("incident").agg(
        (1 - doubt).alias("confidence"), F.count_if(corroborates).alias("behaviours"), F.sum("findings").alias("findings"), F.max("severity_rank").alias("severity_rank"),
        F.max_by("predicate", F.struct(evidential.cast("int"), "strongest", "predicate")).alias("headline"), F.array_join(lines, "; ").alias("rationale"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )
    out = out.withColumn("multiplier", S.corroboration(F.col("behaviours"), p.step, p.most)).withColumn("priority", F.col("confidence") * F.col("multiplier"))
    out = out.withColumn("severity", S.mapped(F.col("severity_rank"), {v: k for k, v in S.SEVERITY_RANKS.items()})).withColumn("title", F.concat_ws(" ", F.split_part("incident", F.lit(":"), F.lit(2)), F.replace("headline", F.lit("_"), F.lit(" "))))
    return out.withColumn("incident_id", S.content_id("in", F.col("incident"), F.col("rationale")))


def queue_order() -> list[Column]:
    return [F.desc(F.bround("priority", 9)), F.desc("severity_rank"), F.asc("incident")]


def ranked_queue(incidents: DataFrame, n: int) -> DataFrame:
    """The first ``n`` incidents with their place in the queue."""
    top = incidents.orderBy(*queue_order()).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*queue_order())))  # n rows


def queue_summary(incidents: DataFrame) -> DataFrame:
    """Incidents by severity, and how many of them have more than one behaviour."""
    return incidents.groupBy("severity").agg(F.count("*").alias("incidents"), F.count_if(F.col("behaviours") >= 2).alias("corroborated"))


def sequence(grouped: DataFrame, p: CorrelationParams = CorrelationParams(), with_incident: bool = False) -> DataFrame:
    """``precedes`` findings between adjacent behaviours of an incident, each represented by its earliest finding.

    No claim where the clocks can't carry it (1 s on one source, 300 s across sources), or where both behaviours speak of
    the same entity. The chain has at most a link for each pair of neighbouring predicates.
    """
    dated = grouped.where(F.col("first_seen").isNotNull() & ~F.col("predicate").isin(*p.derived))
    first = Window.partitionBy("incident", "predicate").orderBy("first_seen", F.desc("score"), "object", "subject", "finding_id")
    heads = dated.withColumn("place", F.row_number().over(first)).where("place = 1")
    sources = F.array_distinct(F.filter(F.transform("evidence", lambda e: e["artifact"]["source_file"]), lambda s: s.isNotNull()))
    node = heads.select("incident", "predicate", "finding_id", "score", "first_seen", sources.alias("sources"), F.col("evidence")[0]["artifact"].alias("place"), F.coalesce("object_type", "subject_type").alias("node_type"), F.coalesce("object", "subject").alias("node"))
    w = Window.partitionBy("incident").orderBy("first_seen", "predicate")
    nxt = F.lead(F.struct("predicate", "finding_id", "score", "first_seen", "sources", "place", "node_type", "node")).over(w)
    pairs = node.withColumn("later", nxt).where("later is not null")
    joint = F.array_sort(F.array_union("sources", F.col("later.sources")))
    floor = F.when(F.size(joint) == 1, p.same_clock_floor).otherwise(p.cross_clock_floor)
    pairs = pairs.withColumns({"separation": F.col("later.first_seen") - F.col("first_seen"), "floor": floor, "clocks": F.array_join(joint, ",")})
    other = S.entity_id(F.col("node_type"), F.col("node")) != S.entity_id(F.col("later.node_type"), F.col("later.node"))
    kept = pairs.where(other & (F.col("separation") >= F.col("floor"))).withColumn("last_seen", F.col("later.first_seen")).withColumn("score", F.least("score", F.col("later.score")))
    summary = F.format_string("%s began, and %s followed after %.1f s", F.col("predicate"), F.col("later.predicate"), F.col("separation"))
    payload = {"from": F.col("finding_id"), "to": F.col("later.finding_id"), "gap": F.bround("separation", 1), "floor": F.col("floor"), "clocks": F.col("clocks")}
    # the link points back to where either behaviour was first seen
    kept = kept.withColumns({"artifact": F.col("place"), "samples": F.array_distinct(F.array("place", "later.place"))})
    found = to_findings(kept.withColumn("_predicate", F.col("predicate")), "precedes", F.col("node"), F.col("later.node_type"), F.col("later.node"), F.lit("info"), "correlator@1", {"weaker": F.col("score")}, "temporal_order", summary, payload, subject_type=F.col("node_type"), keep=["incident"] if with_incident else ())
    return found


def link_chains(grouped: DataFrame, p: CorrelationParams = CorrelationParams()) -> DataFrame:
    """``sequence``'s findings as members of the incident that they order, with ids: columns of ``grouped``."""
    return with_finding_id(sequence(grouped, p, with_incident=True)).select(*grouped.columns)


def correlate(findings: DataFrame, p: CorrelationParams = CorrelationParams(), store: Store | None = None) -> tuple[DataFrame, DataFrame]:
    """(incidents, findings with their incident) of findings from any number of detectors.

    The findings are read several times, and they are few (detectors cap them), so they are stored instead of detected anew.
    """
    if "finding_id" not in findings.columns:
        findings = with_finding_id(findings)
    findings = (store or Store(findings.sparkSession)).put(findings, "findings")
    grouped = members(findings, p)
    return rank(grouped, p), grouped


def incident_entities(grouped: DataFrame) -> DataFrame:
    """Distinct entities of each incident: its findings' subjects and objects."""
    both = grouped.select("incident", subject_key().alias("entity")).union(grouped.where(F.col("object").isNotNull()).select("incident", object_key()))
    return both.distinct()


def incident_evidence(grouped: DataFrame) -> DataFrame:
    """Distinct evidence of each incident, with the place it points back to."""
    rows = grouped.select("incident", F.explode("evidence").alias("e")).select("incident", F.col("e.id").alias("evidence_id"), F.col("e.kind").alias("kind"), F.col("e.summary").alias("summary"), F.col("e.artifact.source_file").alias("source_file"), F.col("e.artifact.source_line").alias("source_line"))
    return rows.dropDuplicates(["incident", "evidence_id"])


def verified_claims(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``incident, claim_id, text`` of the ``claims (claim_id, incident, text, ...)`` that ``check_claims`` found grounded."""
    return claims.join(verdicts.where("verdict = 'grounded'").select("claim_id"), "claim_id", "left_semi").select("incident", "claim_id", "text")


def in_reading_order(grouped: DataFrame, p: CorrelationParams = CorrelationParams()) -> DataFrame:
    """Findings with their ``place`` in the incident: measured ones by confidence, then derived ones by time, then by id."""
    derived = F.col("predicate").isin(*p.derived)
    w = Window.partitionBy("incident").orderBy(derived, F.when(derived, F.col("first_seen")).otherwise(0.0), F.desc("score"), "finding_id")
    return grouped.withColumn("place", F.row_number().over(w))


def spread_sample(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """At most ``k`` rows of each group: the first, the last and evenly between, in the given order."""
    w = Window.partitionBy(*keys)
    numbered = df.withColumns({"_rn": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    spots = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / max(1, k - 1)).cast("long"))
    return numbered.where((F.col("_n") <= k) | F.array_contains(spots, F.col("_rn").cast("long"))).drop("_rn", "_n")


# ---------------------------------------------------------------- hunts

#: How each predicate's entity is looked up in a history table (field, match).
PIVOTS = {
    "beacons_to": ("dst", "exact"), "exfiltrates_to": ("dst", "exact"), "contacts_rare_destination": ("dst", "exact"), "transfers_anomalous_volume": ("dst", "exact"),
    "tunnels_dns_over": ("domain", "suffix"), "resolves_algorithmic_domain": ("domain", "exact"), "scans": ("dst_port", "exact"),
    "presents_rare_tls_fingerprint": ("ja3", "exact"), "executes_rare_process": ("image", "suffix"), "exhibits_anomalous_lineage": ("image", "suffix"), "triggered_signature": ("signature", "exact"),
}


def pivots(findings: DataFrame) -> DataFrame:
    """``finding_id, incident?, predicate, field, value, match, excluded``: what a finding offers to look up, if anything."""
    unary = F.col("predicate").isin(*UNARY)
    by = F.when(unary, F.when(F.col("subject_type") == "ip", "dst").when(F.col("subject_type") == "domain", "domain"))
    match = F.when(unary, "exact")
    for predicate, (field, how) in PIVOTS.items():
        is_it = (F.col("predicate") == predicate) & F.col("object").isNotNull()
        if predicate == "scans":
            is_it = is_it & (F.col("object_type") == "port")
        own = F.when(F.col("object_type") == "domain", "domain").otherwise(field) if field == "dst" else F.lit(field)
        by, match = by.when(is_it, own), match.when(is_it, how)
    stated = F.filter("evidence", lambda e: e["kind"] == "asset_inventory")
    address = F.get_json_object(F.try_element_at(stated, F.lit(1))["payload"], "$.address")
    image = F.col("predicate").isin("executes_rare_process", "exhibits_anomalous_lineage")
    excluded = F.when(unary, None).when(image, F.col("subject")).when(F.col("subject_type") == "ip", F.col("subject")).otherwise(address)
    kept = [c for c in ("finding_id", "incident", "score") if c in findings.columns]
    value = F.lower(F.when(unary, F.col("subject")).otherwise(F.col("object")))
    return findings.select(*kept, "predicate", by.alias("field"), value.alias("value"), match.alias("match"), excluded.alias("excluded")).where("field is not null")


def distinct_pivots(p: DataFrame) -> DataFrame:
    """One look-up per incident and pivot: that of the most confident finding."""
    w = Window.partitionBy("incident", "field", "value").orderBy(F.desc("score"), "finding_id")
    return p.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def sighted(connections: DataFrame | None = None, dns: DataFrame | None = None, ssl: DataFrame | None = None, alerts: DataFrame | None = None, processes: DataFrame | None = None) -> DataFrame:
    """``field, key, depth, subject, ts``: a row for each key by which a row of the logs can be found.

    A name is found below each of its parent zones, an image by its base name, so suffix look-ups are equi-joins.
    """
    from ..operators.intel import parent_zones

    parts = []
    if connections is not None:
        both = F.array(F.struct(F.lit("dst").alias("field"), F.lower("dst_ip").alias("key")), F.struct(F.lit("dst_port").alias("field"), F.col("dst_port").cast("string").alias("key")))
        parts.append(connections.select("src_ip", "ts", F.explode(both).alias("f")).select("f.field", "f.key", F.lit(0), "src_ip", "ts"))
    if dns is not None:
        parts.append(dns.select("src_ip", "ts", F.explode(parent_zones(F.col("query"))).alias("z")).select(F.lit("domain"), F.col("z.zone"), F.col("z.depth"), F.col("src_ip"), "ts"))
    if ssl is not None:
        parts.append(ssl.select(F.lit("ja3"), F.lower("ja3"), F.lit(0), F.col("src_ip"), "ts"))
    if alerts is not None:
        parts.append(alerts.select(F.lit("signature"), F.lower("signature"), F.lit(0), F.col("src_ip"), "ts"))
    if processes is not None:
        parts.append(processes.select(F.lit("image"), S.image_name(F.col("image")), F.lit(0), F.col("host"), "ts"))
    out = parts[0].toDF("field", "key", "depth", "subject", "ts")
    for part in parts[1:]:
        out = out.unionByName(part.toDF("field", "key", "depth", "subject", "ts"))
    return out.where("key is not null and key <> '' and subject is not null")


def history(connections: DataFrame | None = None, dns: DataFrame | None = None, ssl: DataFrame | None = None, alerts: DataFrame | None = None, processes: DataFrame | None = None) -> DataFrame:
    """``field, key, depth, subject, events, first_seen, last_seen``: how often each subject can be found by each key of ``sighted``.

    Counts add up and times combine, so a summary can be kept and added to.
    """
    return sighted(connections, dns, ssl, alerts, processes).groupBy("field", "key", "depth", "subject").agg(F.count("*").alias("events"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


LOOKUP = ("field", "value", "match")


def key_hits(p: DataFrame, rows: DataFrame) -> DataFrame:
    """``field, value, match, subject, events, first_seen, last_seen``: who meets what the pivots look up, whichever finding asks.

    ``rows`` are of ``history``, or of ``sighted``, which are then folded only where a pivot asks for them. Pivots are as few as the
    findings, which detectors cap, so they are broadcast.
    """
    if "events" not in rows.columns:
        rows = rows.select("field", "key", "depth", "subject", F.lit(1).cast("long").alias("events"), F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"))
    asked = p.select(F.col("field").alias("_field"), "value", "match").distinct()
    near = rows.join(F.broadcast(asked), (F.col("field") == F.col("_field")) & (F.col("key") == F.col("value")) & ((F.col("match") == "suffix") | (F.col("depth") == 0)))
    return added_hits(near)


def added_hits(hits: DataFrame) -> DataFrame:
    """Hits of the same look-ups in disjoint parts of a history as the hits in all of them."""
    return hits.groupBy(*LOOKUP, "subject").agg(F.sum("events").alias("events"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def hits_of_findings(p: DataFrame, hits: DataFrame) -> DataFrame:
    """``key_hits`` for each finding that asks for them, without its own subject. A finding has one look-up, so nothing is added up here:
    what findings share is repeated only in the result."""
    asking = p.select("finding_id", *LOOKUP, "excluded").distinct()
    met = hits.join(F.broadcast(asking), list(LOOKUP)).where(F.col("excluded").isNull() | (F.lower("excluded") != F.lower("subject")))
    return met.select("finding_id", "subject", "events", "first_seen", "last_seen")


def hunt(p: DataFrame, rows: DataFrame) -> DataFrame:
    """Per finding and other subject: events, first and last time."""
    return hits_of_findings(p, key_hits(p, rows))


# ---------------------------------------------------------------- evaluation


def truth_match(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """One row: true and false positives, false negatives, precision, recall, F1 of found keys against labelled ones."""
    a = found.select(*keys).distinct().withColumn("_found", F.lit(1))
    b = truth.select(*keys).distinct().withColumn("_true", F.lit(1))
    both = a.join(b, keys, "full_outer")
    counts = both.agg(F.count_if(F.col("_found").isNotNull() & F.col("_true").isNotNull()).alias("tp"), F.count_if(F.col("_true").isNull()).alias("fp"), F.count_if(F.col("_found").isNull()).alias("fn"))
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": precision, "recall": recall, "f1": F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def truth_match_by(found: DataFrame, truth: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``truth_match`` for each value of ``by`` (a predicate, a family), which both sides have."""
    a = found.select(by, *keys).distinct().withColumn("_found", F.lit(1))
    b = truth.select(by, *keys).distinct().withColumn("_true", F.lit(1))
    both = a.join(b, [by, *keys], "full_outer").groupBy(by)
    counts = both.agg(F.count_if(F.col("_found").isNotNull() & F.col("_true").isNotNull()).alias("tp"), F.count_if(F.col("_true").isNull()).alias("fp"), F.count_if(F.col("_found").isNull()).alias("fn"))
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": precision, "recall": recall, "f1": F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def family_match(found: DataFrame, truth: DataFrame, keys: list[str], family: str = "family") -> DataFrame:
    """One row: families of which any member was found, found keys of no family, families of which none was.

    A family counts once, however many of its members are named. ``truth`` has ``keys`` and the family of each.
    """
    of_key = truth.select(*keys, family).distinct()
    hit = found.select(*keys).distinct().join(of_key, keys, "left")
    named = hit.agg(F.count_distinct(family).alias("tp"), F.count_if(F.col(family).isNull()).alias("fp"))
    one = named.crossJoin(F.broadcast(of_key.agg(F.count_distinct(family).alias("families")))).withColumn("fn", F.col("families") - F.col("tp"))  # one row each
    return one.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", "families")}).drop("families")


def infected_subjects(documented: DataFrame | None, labelled: DataFrame) -> DataFrame:
    """Subjects that count as infected: documented ones that a label confirms; without documentation, all labelled ones."""
    sources = labelled.select("subject").distinct()
    return sources if documented is None else sources.join(documented.select("subject").distinct(), "subject", "left_semi")


def labelled_beacon_place(beacons: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: confidence of the strongest of ``beacons (subject, object, score)`` on a labelled pair, its place among all.

    The place is one more than the number of stronger beacons, so nothing is sorted.
    """
    labelled = pairs.select("subject", "object").distinct()
    best = beacons.join(labelled, ["subject", "object"], "left_semi").agg(F.max("score").alias("best_confidence"))
    ahead = beacons.join(F.broadcast(best), beacons["score"] > best["best_confidence"]).agg(F.count("*").alias("ahead"))  # one row
    return best.crossJoin(F.broadcast(ahead)).select("best_confidence", F.when(F.col("best_confidence").isNotNull(), F.col("ahead") + 1).alias("best_beacon_place"))


def capture_evaluation(incidents: DataFrame, beacons: DataFrame, pairs: DataFrame, infected: DataFrame, hours: float) -> DataFrame:
    """One row: best place of an infected subject, precision of beacon pairs, the best beacon on a labelled pair, beacons an hour.

    ``beacons (subject, object, score)`` against labelled ``pairs (subject, object)``; labels are joined only here.
    """
    best = subject_ranks(incidents, infected).agg(F.min("place").alias("best_infected_place"))
    labelled = pairs.select("subject", "object").distinct().withColumn("labelled", F.lit(True))
    one = beacons.join(labelled, ["subject", "object"], "left").agg(F.count("*").alias("beacons"), F.count("labelled").alias("on_labelled"))
    one = one.withColumns({"pair_precision": F.coalesce(F.try_divide("on_labelled", "beacons"), F.lit(1.0)), "beacons_per_hour": F.col("beacons") / hours})
    return one.crossJoin(F.broadcast(best)).crossJoin(F.broadcast(labelled_beacon_place(beacons, pairs)))  # one row each


def subject_ranks(incidents: DataFrame, subjects: DataFrame) -> DataFrame:
    """The place in the queue of each labelled subject.

    Incidents are counted by thousandths of priority, of which there are few; only within the cells of the labelled subjects
    they are put in order. No global sort, and no pairs.
    """
    placed = incidents.select("incident", "severity_rank", "priority", F.floor(F.bround("priority", 9) * 1000).alias("cell_p"))
    want = placed.join(subjects.select(S.entity_id(F.lit("ip"), F.col("subject")).alias("incident")).distinct(), "incident", "left_semi")
    cells = placed.groupBy("cell_p").agg(F.count("*").alias("n"))
    before = cells.select("cell_p", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("cell_p")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # some thousands of rows
    near = placed.join(want.select("cell_p").distinct(), "cell_p", "left_semi")
    w = Window.partitionBy("cell_p").orderBy(*queue_order())
    ordered = near.withColumn("within", F.row_number().over(w)).join(want.select("incident"), "incident", "left_semi").join(before, "cell_p")
    return ordered.select(F.col("incident").alias("subject"), (F.col("before") + F.col("within")).alias("place"))


# ---------------------------------------------------------------- claims


def check_claims(claims: DataFrame, citable: DataFrame) -> DataFrame:
    """``claim_id, verdict``: no citation, unresolved citation, entity absent from what is cited, or grounded.

    ``claims (claim_id, text, cites array)``, ``citable (id, text)``: addresses, names and ports in the claim must occur in the
    texts that it cites.
    """

    def entities(text: Column) -> Column:
        low = F.lower(text)
        ips = F.regexp_extract_all(low, F.lit(r"\b((?:[0-9]{1,3}\.){3}[0-9]{1,3})\b"), F.lit(1))
        names = F.regexp_extract_all(low, F.lit(r"\b((?:[a-z0-9-]+\.)+[a-z]{2,})\b"), F.lit(1))
        ports = F.transform(F.regexp_extract_all(low, F.lit(r"\bport ([0-9]{1,5})\b"), F.lit(1)), lambda x: F.concat(F.lit("port "), x))
        return F.array_distinct(F.concat(ips, names, ports))

    named = claims.select("claim_id", entities(F.col("text")).alias("named"), F.coalesce("cites", F.array().cast("array<string>")).alias("cites"))
    cited = named.select("claim_id", F.explode_outer("cites").alias("id")).join(citable.select("id", entities(F.col("text")).alias("known")).withColumn("there", F.lit(1)), "id", "left")
    known = cited.groupBy("claim_id").agg(F.count("id").alias("n_cites"), F.count("there").alias("n_there"), F.flatten(F.collect_list("known")).alias("known"))
    joined = named.join(known, "claim_id")
    missing = F.array_except("named", "known")
    verdict = F.when(F.col("n_cites") == 0, "no_citation").when(F.col("n_there") < F.col("n_cites"), "unresolved_citation").when(F.size(missing) > 0, "ungrounded_entity").otherwise("grounded")
    return joined.select("claim_id", verdict.alias("verdict"), F.array_join(F.array_sort(missing), ",").alias("missing"))


def context_pack(rows: DataFrame, budget: int, group: str = "incident", cost: str = "cost", order: list[Column] | None = None) -> DataFrame:
    """The prefix of each group, in order, whose running cost stays within the budget."""
    w = Window.partitionBy(group).orderBy(*(order or [F.desc("score"), F.asc("finding_id")])).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running_cost", F.sum(cost).over(w)).where(F.col("running_cost") <= budget)


def briefs(grouped: DataFrame, budget: int, most: int = 12, p: CorrelationParams = CorrelationParams()) -> DataFrame:
    """``incident, part, place, finding_id, text, cost``: what fits a budget of each incident, in reading order.

    First the findings' own lines (``part`` 0), at most ``most``, up to the first that doesn't fit; then, with what is left, the
    evidence lines of these findings (``part`` 1), up to the first that doesn't fit. A finding is never left out for the sake of
    a measurement. A line costs a fourth of its characters.
    """
    read = in_reading_order(grouped, p).where(F.col("place") <= most)
    line = F.format_string("%s: %s %s %s (%s)", F.col("finding_id"), F.col("subject"), F.col("predicate"), F.coalesce("object", F.lit("-")), F.format_number("score", 2))
    cost = F.ceil(F.length("text") / 4).cast("long")
    w = Window.partitionBy("incident").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    heads = read.select("incident", "place", "finding_id", line.alias("text"), "evidence").withColumn("cost", cost)
    heads = heads.withColumn("running", F.sum("cost").over(w)).where(F.col("running") <= budget)
    lines = F.array_join(F.transform("evidence", lambda e: F.concat_ws(" ", e["kind"], F.get_json_object(e["payload"], "$"))), "\n")
    detail = heads.withColumn("spent", F.max("running").over(Window.partitionBy("incident"))).select("incident", "place", "finding_id", lines.alias("text"), "spent").withColumn("cost", cost)
    detail = detail.withColumn("running", F.col("spent") + F.sum("cost").over(w)).where(F.col("running") <= budget)
    kept = ["incident", "part", "place", "finding_id", "text", "cost"]
    return heads.withColumn("part", F.lit(0)).select(*kept).unionByName(detail.withColumn("part", F.lit(1)).select(*kept))
