"""From folders of logs to a queue of incidents in one call.

Logs are scanned and parsed once and kept in the run's store, indicators and assets are brought to one form, the detectors run over
shared summaries, findings are named, correlated, put in order and linked in time, and what comes out is written where it is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intel, names
from ..sources import text
from ..sources.shared import Store
from . import incidents
from .detectors import REGISTRY, Detector, Telemetry, detect_all

TELEMETRY = ("connections", "dns", "ssl", "alerts", "processes")


@dataclass(frozen=True)
class Result:
    """Tables of a run. They live in ``store`` until it is dropped."""

    tables: dict[str, DataFrame]
    findings: DataFrame
    rejected: DataFrame
    queue: DataFrame
    grouped: DataFrame  # findings with their incident, with those of ``precedes``
    statements: DataFrame
    statistics: DataFrame
    store: Store = field(repr=False)

    def write(self, path: str) -> None:
        text.write_findings(self.findings, f"{path}/findings")
        text.write_queue(self.queue, f"{path}/queue")
        self.rejected.write.mode("overwrite").parquet(f"{path}/rejected")
        self.grouped.write.mode("overwrite").parquet(f"{path}/incident_findings")
        self.statistics.write.mode("overwrite").parquet(f"{path}/statistics")


def run(
    spark: SparkSession, paths: str | Sequence[str], words: DataFrame | None = None, detectors: Sequence[Detector] = REGISTRY, correlation: incidents.CorrelationParams = incidents.CorrelationParams(), capture_start: float = 0.0, store: Store | None = None
) -> Result:
    """``words (word)`` fit the model of names; without them algorithmic domains stay unmeasured.

    A table of which there is no file is empty: its detectors find nothing. Addresses are named by the asset register, where its
    statements still apply to the capture, and destinations by the names they were resolved from.
    """
    store = store or Store(spark)
    parsed = text.load(spark, list([paths] if isinstance(paths, str) else paths), capture_start, store=store)
    tables = {name: store.put(df, name) for name, df in parsed.items()}
    window = store.put(intel.capture_window(*[tables[t] for t in TELEMETRY]), "window")
    statements = store.put(intel.applied_assets(tables["assets"].where("address is not null"), window), "statements")
    bigrams = None if words is None else store.put(names.fit_bigrams(words), "bigrams")
    telemetry = Telemetry(*[tables[t] for t in TELEMETRY], intel.normalised_indicators(tables["indicators"]), bigrams, statements, intel.observed_names(tables["dns"]), rows=tables["connections"])
    admitted, rejected = detect_all(telemetry, detectors, store)
    findings = store.put(admitted, "findings")
    queue, grouped = incidents.correlate(findings, correlation, store)
    links = incidents.link_chains(grouped, correlation)
    coverage = intel.coverage(tables["assets"].where("address is not null"), window, *[tables[t] for t in ("connections", "dns", "ssl", "alerts")])
    statistics = text.run_statistics(spark, {t: tables[t] for t in TELEMETRY}, findings, queue, coverage)
    return Result(tables, findings, store.put(rejected, "rejected"), store.put(queue, "queue"), store.put(grouped.unionByName(links), "grouped"), statements, store.put(statistics.withColumn("detectors", F.lit(len(detectors))), "statistics"), store)
