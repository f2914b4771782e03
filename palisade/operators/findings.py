"""Findings: one row per claim, with evidence that points back to a file and a line."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import FINDING_COLUMNS

ACTOR, NET = ("host", "ip"), ("ip", "domain")
ANY = ("host", "ip", "domain", "url", "user", "process", "file_hash", "signature", "port", "tls_fingerprint")
#: Predicate, subject types, object types (None: no object), default severity, techniques.
GRAMMAR = (
    ("beacons_to", ACTOR, NET, "high", ("T1071", "T1573", "T1008")),
    ("tunnels_dns_over", ACTOR, ("domain",), "high", ("T1071.004", "T1048.003")),
    ("exfiltrates_to", ACTOR, NET, "critical", ("T1041", "T1030")),
    ("scans", ACTOR, ("host", "ip", "port"), "medium", ("T1046", "T1595")),
    ("contacts_rare_destination", ACTOR, NET, "low", ("T1071",)),
    ("transfers_anomalous_volume", ACTOR, NET, "medium", ("T1030",)),
    ("presents_rare_tls_fingerprint", ACTOR, ("tls_fingerprint",), "medium", ("T1071.001",)),
    ("resolves_algorithmic_domain", ACTOR, ("domain",), "medium", ("T1568.002",)),
    ("attacks_web_endpoint", ("ip",), ("url",), "high", ("T1190", "T1059")),
    ("enumerates_web_paths", ("ip",), ("host", "url"), "low", ("T1595.003",)),
    ("executes_rare_process", ("host",), ("process",), "medium", ("T1059",)),
    ("exhibits_anomalous_lineage", ("host",), ("process",), "high", ("T1059", "T1055")),
    ("authentication_anomaly", ("user",), ("host",), "medium", ("T1078", "T1110")),
    ("establishes_persistence", ("host",), ("process", "file_hash"), "high", ("T1547", "T1053")),
    ("triggered_signature", ACTOR, ("signature",), "info", ()),
    ("matches_threat_intel", ("ip", "domain", "file_hash", "url"), None, "medium", ()),
    ("shares_infrastructure_with", NET, NET, "info", ()),
    ("precedes", ANY, ANY, "info", ()),
)
#: Supporting predicates raise an incident's confidence but are no second behaviour; derived ones do neither.
SUPPORTING = ("shares_infrastructure_with", "contacts_rare_destination", "transfers_anomalous_volume", "presents_rare_tls_fingerprint", "matches_threat_intel")
DERIVED = ("precedes",)


def grammar(spark: SparkSession) -> DataFrame:
    """The 18 predicates as a table: a constant, so it may be broadcast."""
    rows = [(p, list(s), list(o) if o else None, sev, list(t), p not in SUPPORTING + DERIVED, p not in DERIVED) for p, s, o, sev, t in GRAMMAR]
    return spark.createDataFrame(rows, "predicate string, subject_types array<string>, object_types array<string>, default_severity string, techniques array<string>, corroborates boolean, evidential boolean")


def to_findings(scored: DataFrame, predicate: str | Column, subject: Column, object_type: str | Column | None, obj: Column | None, severity: Column, detector: str, components: Mapping[str, Column], kind: str, summary: Column, payload: Mapping[str, Column] | None = None, subject_type: str | Column = "ip", first: str = "first_seen", last: str = "last_seen", keep: Sequence[str] = ()) -> DataFrame:
    """Scored rows as findings, with columns to ``keep`` behind theirs. A component that wasn't measured stays NULL in ``components``; payloads name it, too."""
    as_col = lambda x: F.lit(x) if isinstance(x, str) or x is None else x
    none = F.lit(None).cast("string")
    parts = F.create_map(*[c for k, v in components.items() for c in (F.lit(k), F.bround(v.cast("double"), 4))])
    # a NULL value must stay in the payload, so it isn't left to to_json, which drops it
    entries = [F.concat(F.to_json(F.array(F.lit(k))).substr(F.lit(2), F.lit(len(k) + 2)), F.lit(":"), F.coalesce(F.regexp_replace(F.to_json(F.array(v.cast("string"))), r"^\[|\]$", ""), F.lit("null"))) for k, v in sorted((payload or {}).items())]
    text = F.concat(F.lit("{"), F.array_join(F.array(*entries), ",") if entries else F.lit(""), F.lit("}"))
    cols = set(scored.columns)
    artifact = F.col("artifact") if "artifact" in cols else F.lit(None).cast("struct<source_file:string,source_line:bigint>")
    samples = F.col("samples") if "samples" in cols else F.array().cast("array<struct<source_file:string,source_line:bigint>>")
    evidence = F.array(F.struct(S.content_id("ev", F.lit(kind), text).alias("id"), F.lit(kind).alias("kind"), summary.alias("summary"), text.alias("payload"), F.coalesce(artifact, F.struct(F.lit("<aggregate>").alias("source_file"), F.lit(0).cast("long").alias("source_line"))).alias("artifact"), samples.alias("samples")))
    return scored.select(
        as_col(predicate).alias("predicate"), as_col(subject_type).alias("subject_type"), subject.cast("string").alias("subject"),
        (as_col(object_type) if object_type is not None else none).alias("object_type"), (obj.cast("string") if obj is not None else none).alias("object"),
        F.bround(F.col("score"), 4).alias("score"), severity.alias("severity"), F.lit(detector).alias("detector"),
        F.col(first).alias("first_seen"), F.col(last).alias("last_seen"), parts.alias("components"), evidence.alias("evidence"), *keep,
    ).select(*FINDING_COLUMNS, *keep)


def spread_places(n: Column, k: int) -> Column:
    """Of the numbers 0..n-1 at most ``k``: the first, the last and evenly between."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(max(1, k) - 1)), lambda i: F.bround(i * (n - 1) / max(1, k - 1)).cast("long")))


def with_samples(scored: DataFrame, rows: DataFrame, keys: list[str], k: int = 5, order: tuple = ("ts", "source_file", "source_line")) -> DataFrame:
    """``scored`` with ``samples``: places of at most ``k`` of each group's rows, spread over their order.

    Only rows of scored groups are numbered, so this comes after the caps.
    """
    if k <= 0:
        return scored.withColumn("samples", F.array().cast("array<struct<source_file:string,source_line:bigint>>"))
    named = {c: f"_{c}" for c in keys}
    wanted = scored.select(*[F.col(c).alias(named[c]) for c in keys]).distinct()
    same = [F.col(c).eqNullSafe(F.col(named[c])) for c in keys]
    w = Window.partitionBy(*keys)
    near = rows.join(wanted, same, "left_semi").withColumns({"_rn": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    taken = near.where(F.array_contains(spread_places(F.col("_n"), k), F.col("_rn").cast("long")))
    place = F.struct(F.col("_rn"), F.col("source_file"), F.col("source_line").cast("long").alias("source_line"))
    lists = taken.groupBy(*[F.col(c).alias(named[c]) for c in keys]).agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: F.struct(x["source_file"].alias("source_file"), x["source_line"].alias("source_line"))).alias("samples"))  # k places each
    return scored.join(lists, same, "left").drop(*named.values())


def with_finding_id(findings: DataFrame) -> DataFrame:
    """``finding_id`` of the claim and its evidence's ids: equal content, equal id."""
    ids = F.array_join(F.array_sort(F.transform("evidence", lambda e: e["id"])), ",")
    return findings.withColumn("finding_id", S.content_id("fi", F.col("predicate"), S.entity_id(F.col("subject_type"), F.col("subject")), S.entity_id(F.col("object_type"), F.col("object")), ids))


def check_grammar(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings that the grammar admits, the others with a ``reason``)."""
    g = F.broadcast(grammar(findings.sparkSession).select("predicate", "subject_types", "object_types", F.lit(True).alias("known")))
    unary = F.col("object_types").isNull()
    reason = (
        F.when(F.col("known").isNull(), "unknown predicate")
        .when(~F.array_contains("subject_types", F.col("subject_type")) | F.col("subject_type").isNull(), "subject type")
        .when(unary & F.col("object").isNotNull(), "object of a unary predicate")
        .when(~unary & F.col("object").isNull(), "no object")
        .when(~unary & ~F.coalesce(F.array_contains("object_types", F.col("object_type")), F.lit(False)), "object type")
        .when(F.coalesce(F.size("evidence"), F.lit(0)) < 1, "no evidence")
        .when(F.col("score").isNull() | ~F.col("score").between(0, 1), "confidence outside 0..1")
    )
    judged = findings.join(g, "predicate", "left").withColumn("reason", reason)
    return judged.where("reason is null").select(*findings.columns), judged.where("reason is not null").select(*findings.columns, "reason")
