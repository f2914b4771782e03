"""The detectors behind one interface, and a run over all of them.

A run starts from shared summaries (``summarised``): each table is read once and reduced to the totals that its detectors have in
common, which are written to the shared folder. A detector that must see single rows (beaconing its candidates' series, evidence its places and
samples) reads the table again, and only for what passed the summaries' gates; connections are stored for that, unless the caller has done so.

A detector is anything with a name, a version and ``detect(telemetry)``; a caller adds its own to ``REGISTRY``'s. Findings name
their detector as ``name@version``, and go through the grammar before they are given out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import host, intel, names, network
from ..operators.findings import check_grammar, with_finding_id
from ..schema import FINDING_COLUMNS
from ..sources.shared import Store


@dataclass(frozen=True)
class Telemetry:
    """The tables of a capture; what a sensor doesn't give is None, and its detectors stay silent."""

    connections: DataFrame | None = None
    dns: DataFrame | None = None
    ssl: DataFrame | None = None
    alerts: DataFrame | None = None
    processes: DataFrame | None = None
    indicators: DataFrame | None = None  # normalised
    bigrams: DataFrame | None = None  # of ``names.fit_bigrams``
    statements: DataFrame | None = None  # of ``intel.applied_assets``: subjects are named by them
    names: DataFrame | None = None  # ``address, domain``, as of ``intel.observed_names``: objects are named by them
    rows: DataFrame | None = None  # connections that are read from a store; ``summarised`` stores them where the caller hasn't
    # what ``summarised`` adds
    pairs: DataFrame | None = None
    lookups: DataFrame | None = None
    sessions: DataFrame | None = None
    triples: DataFrame | None = None
    matched: DataFrame | None = None
    store: Store | None = None

    @property
    def single_rows(self) -> DataFrame | None:
        """Connections, from a store if they are there."""
        return self.connections if self.rows is None else self.rows


def summarised(telemetry: Telemetry, store: Store) -> Telemetry:
    """The same tables with the summaries that several detectors start from, each computed once and stored."""
    t = telemetry
    made: dict[str, DataFrame] = {}
    if t.connections is not None:
        made["rows"] = store.put(network.detector_rows(t.connections), "connections") if t.rows is None else t.rows
        # where each pair began is looked up behind the caps, for the few that are claimed: totals without it are hashed, not sorted
        made["pairs"] = store.put(network.pair_totals(made["rows"], places=False), "pairs")
    if t.dns is not None:
        made["lookups"] = store.put(names.lookup_totals(t.dns), "lookups")
    if t.ssl is not None:
        made["sessions"] = store.put(names.session_totals(t.ssl), "sessions")
    if t.processes is not None:
        made["triples"] = store.put(host.process_triples(t.processes), "triples")
    if t.indicators is not None:
        made["indicators"] = store.put(t.indicators, "indicators")
        if "pairs" in made and "lookups" in made:
            made["matched"] = intel.matched_sightings(intel.sightings(made["pairs"], made["lookups"]), made["indicators"], store)
    return replace(t, **made, store=store)


@runtime_checkable
class Detector(Protocol):
    name: str
    version: str

    def detect(self, telemetry: Telemetry) -> DataFrame | None:
        """Findings (``FINDING_COLUMNS``), or None where a table it needs is absent."""


@dataclass(frozen=True)
class TableDetector:
    """A detector made of functions of the telemetry; ``steps`` pairs the tables a function needs with the function."""

    name: str
    steps: Sequence[tuple[tuple[str, ...], Callable[[Telemetry], DataFrame]]]
    version: str = "1"

    def detect(self, telemetry: Telemetry) -> DataFrame | None:
        parts = []
        for needs, run in self.steps:
            if all(getattr(telemetry, n) is not None for n in needs):
                parts.append(run(telemetry))
        return reduce(DataFrame.unionByName, parts).withColumn("detector", F.lit(qualified(self))) if parts else None


def qualified(detector: Detector) -> str:
    return f"{detector.name}@{detector.version}"


def registry(beacons=network.BeaconParams(), fanout=network.FanoutParams(), egress=network.EgressParams(), tunnels=names.TunnelParams(), alerts=network.AlertParams(), matches=intel.IntelParams(), tls=names.TlsParams(), dga=names.DgaParams(), hosts=host.HostParams(), samples: int = 5) -> tuple[Detector, ...]:
    """The eight detectors with their parameters; ``samples`` rows are named as evidence of each finding that has rows of its own."""
    return (
        TableDetector("beaconing", [(("connections",), lambda t: network.detect_beacons(t.single_rows, beacons, samples, t.pairs, t.store))]),
        TableDetector("fanout", [(("connections",), lambda t: network.detect_fanout(t.single_rows, fanout, samples, t.pairs, t.store))]),
        TableDetector("egress", [(("connections",), lambda t: network.detect_egress(t.single_rows, egress, samples, t.pairs, t.store))]),
        TableDetector("dns_tunnel", [(("dns",), lambda t: names.detect_tunnels(t.dns, tunnels, samples, t.lookups))]),
        TableDetector("alerts", [(("alerts",), lambda t: network.detect_alerts(t.alerts, alerts, samples, t.store))]),
        TableDetector("intel", [
            (("connections", "dns", "indicators"), lambda t: intel.detect_intel(t.single_rows, t.dns, t.indicators, matches, t.matched, t.store, t.lookups)),
            (("connections", "dns", "indicators"), lambda t: intel.detect_infrastructure(t.single_rows, t.dns, t.indicators, matches, t.matched, t.lookups, t.store)),
        ]),
        TableDetector("tls_dga", [
            (("ssl",), lambda t: names.detect_fingerprints(t.ssl, tls, samples, t.sessions)),
            (("dns", "bigrams"), lambda t: names.detect_domains(t.dns, t.bigrams, dga, samples, t.lookups, t.store)),
        ]),
        TableDetector("host", [
            (("processes",), lambda t: host.detect_processes(t.processes, hosts, samples, t.triples)),
            (("processes",), lambda t: host.detect_lineage(t.processes, hosts, samples, t.triples)),
        ]),
    )


REGISTRY = registry()


def detect_all(telemetry: Telemetry, detectors: Sequence[Detector] = REGISTRY, store: Store | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings with their ids, rejected ones with a reason) of all detectors that have the tables they need.

    Subjects and objects are named before the ids are made, so that what one host does is one incident, whatever it is called by.
    Findings are few, as detectors cap them; each detector's are stored when they are found, so what comes after reads files only. A
    ``store`` of the caller's may be dropped when the findings have been used.
    """
    tables = [t for t in (getattr(telemetry, n) for n in ("connections", "dns", "ssl", "alerts", "processes")) if t is not None]
    if not tables:
        raise ValueError("no detector has the tables it needs")
    if telemetry.store is None:
        telemetry = summarised(telemetry, store or Store(tables[0].sparkSession))
    parts = [telemetry.store.put(found.select(*FINDING_COLUMNS), "findings") for d in detectors if (found := d.detect(telemetry)) is not None]
    if not parts:
        raise ValueError("no detector has the tables it needs")
    found = reduce(DataFrame.unionByName, parts)
    if telemetry.statements is not None:
        found = intel.name_subjects(found, telemetry.statements)
    if telemetry.names is not None:
        found = intel.name_objects(found, telemetry.names)
    admitted, rejected = check_grammar(found)
    return with_finding_id(admitted), rejected
