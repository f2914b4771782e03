"""One call from a folder of logs to a queue of incidents; column scorers on plain values."""

import json
import math

import pytest
from pyspark.sql import functions as F

from palisade.operators import host, intel, names, network
from palisade.plans import detectors
from palisade.plans.run import run

CONN = "#fields\tts\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\torig_bytes\tresp_bytes\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("logs")
    beacon = [f"{1_700_000_000 + 600 * k}\t10.0.0.1\t4000\t9.9.9.9\t443\ttcp\t100\t50\n" for k in range(60)]
    scan = [f"{1_700_040_000 + k}\t10.0.0.1\t4000\t10.9.{k // 200}.{k % 200}\t445\ttcp\t1\t1\n" for k in range(300)]
    (at / "conn.log").write_text(CONN + "".join(beacon + scan))
    dns = [{"ts": 1_700_000_000 + k, "id.orig_h": "10.0.0.1", "query": "c2.evil.example", "answers": ["9.9.9.9"]} for k in range(3)]
    (at / "dns.log").write_text("".join(json.dumps(r) + "\n" for r in dns))
    (at / "feed.ioc").write_text("# name: feed\nevil.example added=2023-11-01 confidence=90%\nnonsense\n")
    (at / "estate.inv").write_text("10.0.0.1 laptop-1 stated=2023-10-01\n10.0.0.2 old stated=2015-01-01\n")
    return str(at)


def test_folder_to_incidents(spark, folder, tmp_path):
    got = run(spark, folder, detectors=detectors.registry(samples=2))
    found = {(r.predicate, r.subject_type, r.subject, r.object) for r in got.findings.collect()}
    assert found == {("beacons_to", "host", "laptop-1", "c2.evil.example"), ("scans", "host", "laptop-1", "445"), ("matches_threat_intel", "domain", "c2.evil.example", None)}
    queue = got.queue.collect()
    assert [r.incident for r in queue] == ["host:laptop-1"] and queue[0].behaviours == 2 and queue[0].findings == 3  # the match joined its beacon's incident
    grouped = got.grouped.collect()
    chain = [r for r in grouped if r.predicate == "precedes"]
    assert chain and all(r.incident == "host:laptop-1" and r.finding_id for r in chain)
    places = {(s.source_file.rsplit("/", 1)[1], s.source_line) for r in chain for s in r.evidence[0].samples}
    assert ("conn.log", 62) in places and all(n > 0 for _, n in places)  # where the scan's first line stands
    assert {e.kind for r in got.findings.collect() if r.predicate == "scans" for e in r.evidence} == {"fanout", "asset_inventory"}
    one = got.statistics.first()
    assert (one.records_ingested, one.findings_emitted, one.incidents_emitted, one.assets.loaded, one.assets.dropped, one.detectors) == (363, 3, 1, 2, 1, 8)
    got.write(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "queue")).count() == 1 and spark.read.parquet(str(tmp_path / "out" / "findings")).count() == 3
    got.store.drop()


def test_empty_folder(spark, tmp_path):
    (tmp_path / "conn.log").write_text(CONN)
    got = run(spark, str(tmp_path))
    assert got.findings.count() == got.queue.count() == got.grouped.count() == 0 and got.statistics.first().records_ingested == 0


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_column_scorers(spark):
    """Each scorer's parts from the formulas, and a part that isn't measured leaves the mean."""

    def check(scorer, args, want, weights):
        score, parts = scorer(*[F.lit(a).cast("double") if a is None or isinstance(a, float) else F.lit(a) for a in args])
        got = [value(spark, c) for c in parts.values()]
        assert got == pytest.approx(want)
        known = [(w, g) for w, g in zip(weights, got) if g is not None]
        mean = math.exp(sum(w * math.log(max(g, 0.01)) for w, g in known) / sum(w for w, _ in known))
        assert value(spark, score) == pytest.approx(min(1.0, mean))

    sat = lambda v, t: 1 - math.exp(-v / t)
    check(network.score_fanout, [300.0, 600.0], [sat(300, 250), 1 - 1 / 12], (0.55, 0.45))
    check(network.score_alert_cluster, [64, 1, "Not Suspicious Traffic"], [0.05, 1.0, 0.10], (0.45, 0.30, 0.25))
    check(network.score_transfer, [9e6, 10.0, 10.0, 9e6, 1e6, 1e6, 5e5, 8, 4, 7200.0, 0.0, 14400.0], [1.0, sat(8e6 / (1.4826 * 5e5), 3.5), 0.5, 0.5], (0.30, 0.28, 0.24, 0.18))
    check(network.score_transfer, [9e6, 10.0, 4.0, 9e6, 1e6, 1e6, 0.0, 8, 1, 5.0, 0.0, 10.0], [None, None, 1.0, None], (0.30, 0.28, 0.24, 0.18))
    check(network.score_pair, [50, 3000.0, 49, 60.0, 57.0, 3.0, 50, 100.0, 0.0, 0.5, 4], [1 - 0.05 / 0.6, 1 - 0.05 / 0.6, 1.0, 0.5, 49 / 50 * sat(50, 15), 0.5], network.BeaconParams.weights)
    check(network.score_pair, [50, 3000.0, 3, 60.0, 57.0, 3.0, 2, 100.0, 0.0, None, 4], [1 - 0.05 / 0.6, 1.0, None, None, 3 / 50 * sat(50, 15), 0.5], network.BeaconParams.weights)
    check(names.score_zone, [3.9, 100.0, 20.0, 0.0, 80.0], [0.5, sat(100, 200), sat(20, 40), None], (0.40, 0.25, 0.25, 0.10))
    check(names.score_domain, ["bcdfghjkl1", 0.7, 100.0, 40.0, 30.0], [None, 0.7, 1.0], (0.34, 0.56, 0.10))
    check(names.score_domain, ["abcdef", 0.7, 100.0, 50.0, 20.0], [0.5, 0.7, 0.0], (0.34, 0.56, 0.10))
    check(names.score_fingerprint, [4, 50.0], [0.5, sat(50, 50)], (0.65, 0.35))
    check(host.score_process, [4, 0.55, 8], [0.5, 0.55, 1 - sat(8, 8)], (0.50, 0.34, 0.16))
    check(host.score_edge, [1.0, 4.0, 1.0, 1.0, 64.0], [0.75, None, 1.0], (0.38, 0.38, 0.24))
    assert value(spark, intel.score_match(F.lit(0.8), F.lit(180))) == pytest.approx(0.4)
    assert value(spark, intel.score_match(F.lit(None).cast("double"), F.lit(None).cast("int"))) == pytest.approx(0.25)
    assert value(spark, intel.score_match(F.lit(0.9), F.lit(None).cast("int"))) == pytest.approx(0.35)
