"""Readiness of the telemetry: one row per check, so that a silent detector can be told from one with nothing to say."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import host, intel, names


def _row(df: DataFrame, check: str, state, amount: str) -> DataFrame:
    return df.select(F.lit(check).alias("check"), state.alias("state"), F.col(amount).cast("long").alias("amount"))


def tls_state(ssl: DataFrame, p: names.TlsParams = names.TlsParams()) -> DataFrame:
    known = F.trim(F.coalesce("ja3", F.lit(""))) != ""
    one = ssl.agg(F.count("*").alias("sessions"), F.count_if(known).alias("fingerprinted"), F.count_distinct("src_ip").alias("estate"))
    state = F.when(F.col("sessions") == 0, "no_sessions").when(F.col("fingerprinted") == 0, "no_fingerprints").when(F.col("estate") < p.min_estate, "estate_too_small").otherwise("ready")
    return _row(one, "tls", state, "fingerprinted")


def host_state(processes: DataFrame, p: host.HostParams = host.HostParams()) -> DataFrame:
    one = host.estate_baseline(host.process_triples(processes), p)
    state = F.when(F.col("executions") == 0, "no_processes").when(F.col("gate").isNotNull(), "baseline_insufficient").otherwise("ready")
    return _row(one, "host", state, "executions")


def indicator_state(raw: DataFrame) -> DataFrame:
    from ..functions.scalars import indicator_kind

    one = raw.agg(F.count("*").alias("lines"), F.count(indicator_kind(F.col("value"))).alias("usable"), F.count("confidence").alias("provenanced"))
    state = F.when(F.col("lines") == 0, "no_feed").when(F.col("usable") == 0, "nothing_usable").when(F.col("provenanced") == 0, "unprovenanced").otherwise("ready")
    return _row(one, "indicators", state, "usable")


def asset_state(assets: DataFrame, window: DataFrame) -> DataFrame:
    one = intel.applied_assets(assets, window).agg(F.count("*").alias("loaded"), F.count_if("applies").alias("applied"))
    state = F.when(F.col("loaded") == 0, "no_register").when(F.col("applied") == 0, "all_expired").otherwise("ready")
    return _row(one, "assets", state, "applied")


def report(ssl: DataFrame, processes: DataFrame, indicators: DataFrame, assets: DataFrame, window: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [tls_state(ssl), host_state(processes), indicator_state(indicators), asset_state(assets, window)])
