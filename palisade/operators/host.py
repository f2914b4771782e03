"""Detectors over process creations: rare images and odd lineage, gated by what the estate can support."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .findings import to_findings, with_samples
from .network import first_place, locator


@dataclass(frozen=True)
class HostParams:
    process_weights: tuple[float, float, float] = (0.50, 0.34, 0.16)
    lineage_weights: tuple[float, float, float] = (0.38, 0.38, 0.24)
    min_hosts: int = 5
    min_executions: int = 200
    max_singleton_share: float = 0.50
    execution_scale: float = 8.0
    min_parent_samples: int = 20
    min_breadth_hosts: int = 2
    process_score: float = 0.60
    lineage_score: float = 0.62
    per_host: int = 5
    top: int = 60
    ancestry: int = 4


def process_triples(processes: DataFrame) -> DataFrame:
    """(host, parent, image): executions; a NULL parent is a tree's root and a group of its own.

    Paths repeat, so they are counted first, and only distinct ones are taken apart.
    """
    rows = processes.where("host is not null and image is not null")
    paths = rows.groupBy("host", "parent_image", "image").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), first_place(rows))
    named = paths.withColumns({"image_name": S.image_name(F.col("image")), "parent_name": S.image_name(F.col("parent_image"))}).where("image_name is not null")
    merged = named.groupBy("host", "parent_name", "image_name").agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max(S.path_anomaly(F.col("image"))).alias("path_anomaly"), F.min("first_at").alias("first_at"))
    return merged.withColumn("artifact", locator()).drop("first_at")


def estate_baseline(triples: DataFrame, p: HostParams = HostParams()) -> DataFrame:
    """One row: what the estate holds, and ``gate``, why it can't support a claim of rarity (NULL: it can)."""
    images = triples.groupBy("image_name").agg(F.count_distinct("host").alias("hosts")).agg(F.count("*").alias("images"), F.count_if(F.col("hosts") == 1).alias("singletons"))
    totals = triples.agg(F.count_distinct("host").alias("hosts"), F.coalesce(F.sum("n"), F.lit(0)).alias("executions"), (F.max("last_seen") - F.min("first_seen")).alias("span_seconds"))
    share = F.coalesce(F.try_divide("singletons", "images"), F.lit(1.0))
    gate = (
        F.when(F.col("hosts") < p.min_hosts, F.format_string(f"%d hosts report processes, of {p.min_hosts} needed", "hosts"))
        .when(F.col("executions") < p.min_executions, F.format_string(f"%d executions, of {p.min_executions} needed", "executions"))
        .when(share > p.max_singleton_share, F.format_string("%.0f of 100 images are on one host only", share * 100))
    )
    return totals.crossJoin(F.broadcast(images)).withColumn("singleton_share", share).withColumn("gate", gate)  # one row each


def _image_hosts(triples: DataFrame) -> DataFrame:
    return triples.groupBy("image_name").agg(F.count_distinct("host").alias("image_hosts"))


def _presence(triples: DataFrame) -> DataFrame:
    """Hosts on which a name is seen in either role."""
    both = triples.select("host", F.col("image_name").alias("name")).union(triples.select("host", F.col("parent_name").alias("name"))).where("name is not null")
    return both.groupBy("name").agg(F.count_distinct("host").alias("present_hosts"))


def prevalence_ceiling(p: HostParams) -> int:
    """The most hosts an image can have and still reach the score with all else at 1: a bound to filter by early."""
    rare = p.process_score ** (1 / p.process_weights[0])
    return math.floor(1 / (rare * rare) + 1e-9)


def score_process(image_hosts: Column, path_anomaly: Column, executions: Column, p: HostParams = HostParams()) -> tuple[Column, dict[str, Column]]:
    parts = {"image_prevalence": S.rarity(image_hosts), "path_anomaly": path_anomaly, "execution_prevalence": 1 - S.saturating(executions, p.execution_scale)}
    return S.geometric_mean(list(zip(parts.values(), p.process_weights))), parts


def score_edge(pair_hosts: Column, parent_hosts: Column, child_hosts: Column, pair_executions: Column, parent_executions: Column, p: HostParams = HostParams()) -> tuple[Column, dict[str, Column]]:
    """Of one (parent, image): breadth needs an end that several hosts have, surprisal enough children of the parent."""

    def breadth(hosts: Column) -> Column:
        return F.when(hosts >= p.min_breadth_hosts, 1 - pair_hosts / hosts)

    chance = F.when(parent_executions >= p.min_parent_samples, pair_executions / parent_executions)
    parts = {"parent_breadth": breadth(parent_hosts), "child_breadth": breadth(child_hosts), "child_surprisal": S.surprisal(chance)}
    return S.geometric_mean(list(zip(parts.values(), p.lineage_weights))), parts


def score_processes(processes: DataFrame, p: HostParams = HostParams()) -> DataFrame:
    return score_process_triples(process_triples(processes), p)


def score_process_triples(triples: DataFrame, p: HostParams = HostParams()) -> DataFrame:
    """Every (host, image) rare enough, before the caps."""
    gate = estate_baseline(triples, p).where("gate is null").select("hosts")
    rare = _image_hosts(triples).where(F.col("image_hosts") <= prevalence_ceiling(p))
    runs = triples.groupBy("host", "image_name").agg(F.sum("n").alias("executions"), F.max("path_anomaly").alias("path_anomaly"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min_by("artifact", F.struct("first_seen", "parent_name")).alias("artifact"))
    joined = runs.join(rare, "image_name").crossJoin(F.broadcast(gate))  # one row, or none: no claim
    score, parts = score_process(F.col("image_hosts"), F.col("path_anomaly"), F.col("executions"), p)
    return joined.withColumns({**parts, "score": score}).where(F.col("score") >= p.process_score)


def capped(scored: DataFrame, p: HostParams, *tie: str) -> DataFrame:
    """The best of each host, then the best of all."""
    order = [F.desc(F.bround("score", 9)), *[F.asc(t) for t in tie]]
    ranked = scored.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy(*order))).where(F.col("place") <= p.per_host)
    return ranked.orderBy(*order, "host").limit(p.top)


def score_lineage(processes: DataFrame, p: HostParams = HostParams()) -> DataFrame:
    return score_lineage_triples(process_triples(processes), p)


def score_lineage_triples(triples: DataFrame, p: HostParams = HostParams()) -> DataFrame:
    """Every (host, parent, image) odd enough whose image isn't claimed as rare on that host, before the caps."""
    gate = estate_baseline(triples, p).where("gate is null").select("hosts")
    pairs = triples.where("parent_name is not null")
    edges = pairs.groupBy("parent_name", "image_name").agg(F.count_distinct("host").alias("pair_hosts"), F.sum("n").alias("pair_executions"))
    edges = edges.withColumn("parent_executions", F.sum("pair_executions").over(Window.partitionBy("parent_name")))
    presence = _presence(triples)
    joined = pairs.join(edges, ["parent_name", "image_name"])
    joined = joined.join(presence.withColumnsRenamed({"name": "parent_name", "present_hosts": "parent_hosts"}), "parent_name", "left")
    joined = joined.join(presence.withColumnsRenamed({"name": "image_name", "present_hosts": "child_hosts"}), "image_name", "left")

    score, parts = score_edge(*[F.col(c) for c in ("pair_hosts", "parent_hosts", "child_hosts", "pair_executions", "parent_executions")], p)
    scored = joined.withColumns({**parts, "score": score}).where("(parent_breadth is not null or child_breadth is not null)").where(F.col("score") >= p.lineage_score)
    claimed = score_process_triples(triples, p).select("host", "image_name")
    return scored.join(claimed, ["host", "image_name"], "left_anti").crossJoin(F.broadcast(gate.select(F.lit(True).alias("open")))).drop("open")  # one row, or none


def ancestry(processes: DataFrame, levels: int = 4) -> DataFrame:
    """``(process_guid, chain, truncated)``: image names of up to ``levels`` parents, nearest first.

    A guid that is reported twice counts with its first row; a guid met before on the way up ends the chain.
    """
    known = processes.where("process_guid is not null").groupBy("process_guid").agg(F.min_by(F.struct("image", "parent_guid"), F.struct("ts", "source_file", "source_line")).alias("r"))
    known = known.select("process_guid", S.image_name(F.col("r.image")).alias("name"), F.col("r.parent_guid").alias("parent_guid"))
    up = known.select(F.col("process_guid").alias("up_guid"), F.col("name").alias("up_name"), F.col("parent_guid").alias("up_parent"))
    now = known.select("process_guid", F.array("process_guid").alias("met"), F.array().cast("array<string>").alias("chain"), F.col("parent_guid").alias("next"))
    for _ in range(levels):
        step = now.join(up, (F.col("next") == F.col("up_guid")) & ~F.array_contains("met", F.col("next")), "left")
        found = F.col("up_guid").isNotNull()
        now = step.select("process_guid", F.when(found, F.array_append("met", F.col("up_guid"))).otherwise(F.col("met")).alias("met"), F.when(found, F.array_append("chain", F.coalesce("up_name", F.lit("?")))).otherwise(F.col("chain")).alias("chain"), F.when(found, F.col("up_parent")).alias("next"))
    return now.select("process_guid", "chain", (F.col("next").isNotNull() & ~F.array_contains("met", F.col("next"))).alias("truncated"))


def command_samples(scored: DataFrame, processes: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """``scored`` with ``commands``: at most ``k`` distinct command lines of each group, the first seen first, and ``user``: the first one.

    Each command line is folded to its first time before any is numbered, so a group is never collected.
    """
    if "command_line" not in processes.columns:
        return scored.withColumns({"commands": F.array().cast("array<string>"), "user": F.lit(None).cast("string")})
    named = processes.withColumns({"image_name": S.image_name(F.col("image")), "parent_name": S.image_name(F.col("parent_image"))})
    near = named.join(scored.select(*keys).distinct(), keys, "left_semi")
    lines = near.where("command_line <> ''").groupBy(*keys, "command_line").agg(F.min(F.struct("ts", "source_line")).alias("first"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("first", "command_line"))
    taken = lines.withColumn("place", place).where(F.col("place") <= k).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "command_line"))), lambda x: x["command_line"]).alias("commands"))  # k lines each
    users = near.where("user <> ''").groupBy(*keys).agg(F.min_by("user", F.struct("ts", "source_line")).alias("user"))
    return scored.join(taken, keys, "left").join(users, keys, "left").withColumn("commands", F.coalesce("commands", F.array().cast("array<string>")))


def _host_evidence(scored: DataFrame, processes: DataFrame, keys: list[str], samples: int) -> DataFrame:
    named = processes.withColumns({"image_name": S.image_name(F.col("image")), "parent_name": S.image_name(F.col("parent_image"))})
    return with_samples(command_samples(scored, processes, keys), named, keys, samples)


def detect_processes(processes: DataFrame, p: HostParams = HostParams(), samples: int = 0, triples: DataFrame | None = None) -> DataFrame:
    scored = _host_evidence(capped(score_process_triples(process_triples(processes) if triples is None else triples, p), p, "image_name"), processes, ["host", "image_name"], samples)
    names = ("image_prevalence", "path_anomaly", "execution_prevalence")
    summary = F.format_string("%s ran %s, seen on %d hosts", "host", "image_name", "image_hosts")
    return to_findings(scored, "executes_rare_process", F.col("host"), "process", F.col("image_name"), F.lit("medium"), "host@1", {k: F.col(k) for k in names}, "rare_process", summary, {"executions": F.col("executions"), "image_hosts": F.col("image_hosts"), "user": F.col("user"), "commands": F.array_join("commands", "\n")}, subject_type="host")


def detect_lineage(processes: DataFrame, p: HostParams = HostParams(), samples: int = 0, triples: DataFrame | None = None) -> DataFrame:
    scored = _host_evidence(capped(score_lineage_triples(process_triples(processes) if triples is None else triples, p), p, "parent_name", "image_name"), processes, ["host", "parent_name", "image_name"], samples)
    names = ("parent_breadth", "child_breadth", "child_surprisal")
    summary = F.format_string("%s started %s on %s", "parent_name", "image_name", "host")
    return to_findings(scored, "exhibits_anomalous_lineage", F.col("host"), "process", F.col("image_name"), F.lit("high"), "host@1", {k: F.col(k) for k in names}, "lineage", summary, {**{k: F.col(k) for k in ("parent_name", "pair_hosts", "pair_executions", "user")}, "commands": F.array_join("commands", "\n")}, subject_type="host")
