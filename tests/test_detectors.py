"""Registry, samples, links, enrichment, evaluation and streams on small literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from palisade import schema
from palisade.functions import scalars as S
from palisade.operators import findings as fi
from palisade.operators import host, intel, names
from palisade.plans import detectors, incidents
from palisade.streaming import summaries

from .test_telemetry import conn, one


@pytest.mark.parametrize("text, short", [("2001:DB8:0:0:1:0:0:1", "2001:db8::1:0:0:1"), ("0:0:0:0:0:0:0:0", "::"), ("::ffff:1.2.3.4", "::ffff:102:304"), ("1:0:0:2:0:0:0:3", "1:0:0:2::3"), ("fe80::1%eth0", "fe80::1%eth0"), ("1:2:3", "1:2:3"), ("10.0.0.1", "10.0.0.1"), ("2001:db8::0001", "2001:db8::1"), ("::1", "::1"), ("1::", "1::")])
def test_ipv6_spelling(spark, text, short):
    assert one(spark, S.canonical_ipv6(F.lit(text))) == short


def test_addresses_of_both_families(spark):
    raw = spark.createDataFrame([("2001:0DB8::/32", 1), ("2001:db8:1::/49", 2), ("2001:db8:1::9", 3), ("10.0.0.0/9", 4), ("::/0", 5)], "value string, source_line long").selectExpr("value", "cast(null as double) confidence", "cast(null as date) added", "'f' source_file", "source_line")
    feed = intel.normalised_indicators(raw)
    seen = spark.createDataFrame([("2001:db8:1:7fff::1",), ("2001:db8:1:8000::1",), ("2001:db8:1::9",), ("10.127.0.1",), ("10.128.0.1",), ("fe80::1",), ("word",)], "value string")
    got = {r.value: r.indicator for r in intel.match_addresses(seen, feed).collect()}
    assert got == {"2001:db8:1:7fff::1": "2001:db8:1::/49", "2001:db8:1:8000::1": "2001:db8::/32", "2001:db8:1::9": "2001:db8:1::9", "10.127.0.1": "10.0.0.0/9", "fe80::1": "::/0"}
    c = conn(spark, [(5.0, "10.0.0.1", "2001:db8:1::9", 80, 1, 1, "f", 1)])
    d = schema.conform(spark.createDataFrame([(7.0, "10.0.0.1", "a.example", "2001:0db8:1::9;text")], "ts double, src_ip string, query string, answers string"), schema.DNS)
    found = {r.value: r for r in intel.matched_values(c, d, feed).collect()}
    assert (found["2001:db8:1::9"].roles, found["2001:db8:1::9"].events) == ("answer,destination", 2) and found["10.0.0.1"].roles == "source"


def test_netblock_links(spark):
    flagged = spark.createDataFrame([("ip", "10.0.0.9", "a", "ip"), ("ip", "10.0.0.10", "a", "ip"), ("ip", "10.0.0.100", "b", "cidr"), ("ip", "10.0.0.200", "b", "cidr"), ("ip", "10.0.1.1", "c", "ip")], "kind string, value string, indicator string, indicator_kind string").withColumns({"first_seen": F.lit(1.0), "last_seen": F.lit(2.0)})
    got = {(r.anchor, r.other) for r in intel.shared_netblocks(flagged).collect()}
    assert got == {("10.0.0.9", "10.0.0.100"), ("10.0.0.9", "10.0.0.200"), ("10.0.0.100", "10.0.0.10")}


def test_flagged_address_anchors_names(spark):
    d = schema.conform(spark.createDataFrame([(1.0, "h", "a.example", "9.9.9.9"), (2.0, "h", "b.example", "9.9.9.9;8.8.8.8")], "ts double, src_ip string, query string, answers string"), schema.DNS)
    flagged = spark.createDataFrame([("ip", "9.9.9.9", "x"), ("domain", "b.example", "x")], "kind string, value string, indicator string")
    assert [(r.anchor, r.other, r.breadth) for r in intel.address_anchored(d, flagged).collect()] == [("9.9.9.9", "a.example", 2)]
    assert {r.address: r.domain for r in intel.observed_names(d).collect()} == {"8.8.8.8": "b.example"}


def test_registry_finds_with_samples(spark):
    rows = [(float(i), "10.0.0.1", f"10.9.{i // 200}.{i % 200}", 445, 1, 1, "f", i) for i in range(300)]
    found, rejected = detectors.detect_all(detectors.Telemetry(connections=conn(spark, rows)))
    scan = found.where("predicate = 'scans'").first()
    assert scan.detector == "fanout@1" and [s.source_line for s in scan.evidence[0].samples] == [0, 75, 150, 224, 299]
    assert rejected.count() == 0 and all(isinstance(d, detectors.Detector) for d in detectors.REGISTRY) and len(detectors.REGISTRY) == 8
    with pytest.raises(ValueError):
        detectors.detect_all(detectors.Telemetry())

    class Own:
        name, version = "own", "7"

        def detect(self, telemetry):
            return fi.to_findings(telemetry.connections.limit(1).withColumns({"score": F.lit(0.5), "first_seen": F.col("ts"), "last_seen": F.col("ts")}), "scans", F.col("src_ip"), "port", F.col("dst_port"), F.lit("low"), detectors.qualified(self), {}, "own", F.lit(""))

    assert detectors.detect_all(detectors.Telemetry(connections=conn(spark, rows)), [Own()])[0].first().detector == "own@7"


def test_command_samples(spark):
    p = schema.conform(spark.createDataFrame([(3.0, "h", "C:\\a.exe", "z", "u2"), (1.0, "h", "C:\\A.exe", "y", None), (2.0, "h", "c:/a.exe", "y", "u1"), (4.0, "h", "a.exe", "", "u3"), (5.0, "h", "a.exe", "w", ""), (6.0, "h", "a.exe", "v", "")], "ts double, host string, image string, command_line string, user string"), schema.PROCESSES)
    scored = spark.createDataFrame([("h", "a.exe"), ("g", "a.exe")], "host string, image_name string")
    got = {r.host: (r.commands, r.user) for r in host.command_samples(scored, p, ["host", "image_name"]).collect()}
    assert got == {"h": (["y", "z", "w"], "u1"), "g": ([], None)}


def test_hashes_and_counts(spark):
    p = schema.conform(spark.createDataFrame([("h", " ABC ")], "host string, sha256 string"), schema.PROCESSES)
    feed = spark.createDataFrame([("file_hash", "abc"), ("domain", "x.example")], "kind string, value string")
    assert intel.match_hashes(p, feed).first().indicator == "abc"
    assert {r.kind: r.indicators for r in intel.indicator_counts(feed).collect()} == {"file_hash": 1, "domain": 1}
    raw = spark.createDataFrame([("word", "f", 1), ("10.0.0.1", "f", 2)], "value string, source_file string, source_line long")
    assert [r.value for r in intel.rejected_indicators(raw).collect()] == ["word"]
    assert one(spark, S.printable(F.lit("a\x00b\u200bc"))) == "abc"


def test_places_without_a_sort(spark):
    rows = [(f"ip:{k}", (k * 37 % 100) / 50, k % 4) for k in range(200)]
    ranked = spark.createDataFrame(rows, "incident string, priority double, severity_rank int")
    order = sorted(rows, key=lambda r: (-round(r[1], 9), -r[2], r[0]))
    want = {r[0]: k for k, r in enumerate(order, 1)}
    got = incidents.subject_ranks(ranked, spark.createDataFrame([(str(k),) for k in range(0, 200, 7)], "subject string"))
    assert {r.subject: r.place for r in got.collect()} == {f"ip:{k}": want[f"ip:{k}"] for k in range(0, 200, 7)}
    assert "CartesianProduct" not in got._jdf.queryExecution().toString()


def test_evaluation(spark):
    pairs = spark.createDataFrame([("a", "x"), ("b", "x")], "subject string, object string")
    beacons = spark.createDataFrame([("a", "x", 0.6), ("c", "x", 0.9), ("d", "y", 0.6)], "subject string, object string, score double")
    ranked = spark.createDataFrame([("ip:a", 0.5, 1), ("ip:z", 0.9, 1)], "incident string, priority double, severity_rank int")
    infected = incidents.infected_subjects(spark.createDataFrame([("a",), ("q",)], "subject string"), pairs)
    r = incidents.capture_evaluation(ranked, beacons, pairs, infected, 2.0).first()
    assert (r.best_infected_place, r.pair_precision, r.best_confidence, r.best_beacon_place, r.beacons_per_hour) == (2, pytest.approx(1 / 3), 0.6, 2, 1.5)
    assert incidents.infected_subjects(None, pairs).count() == 2
    truth = spark.createDataFrame([("f1", "k1"), ("f1", "k2"), ("f2", "k3")], "family string, k string")
    f = incidents.family_match(spark.createDataFrame([("k1",), ("k2",), ("k9",)], "k string"), truth, ["k"]).first()
    assert (f.tp, f.fp, f.fn) == (1, 1, 1)
    by = {r.p: (r.tp, r.fp, r.fn) for r in incidents.truth_match_by(spark.createDataFrame([("a", 1), ("b", 1)], "p string, k int"), spark.createDataFrame([("a", 1), ("a", 2)], "p string, k int"), ["k"], "p").collect()}
    assert by == {"a": (1, 0, 1), "b": (0, 1, 0)}


def _found(spark, rows):
    """(subject, predicate, object type, object, score, first) as findings."""
    base = spark.createDataFrame(rows, "subject string, predicate string, otype string, obj string, score double, first_seen double").withColumn("last_seen", F.col("first_seen"))
    return fi.with_finding_id(fi.to_findings(base, F.col("predicate"), F.col("subject"), F.col("otype"), F.col("obj"), F.lit("low"), "d@1", {}, "row", F.lit("s"), {"o": F.col("obj")}))


def test_reading_order_pivots_evidence_and_briefs(spark):
    found = _found(spark, [("10.0.0.1", "scans", "port", "80", 0.5, 1.0), ("10.0.0.1", "beacons_to", "ip", "9.9.9.9", 0.9, 2.0), ("10.0.0.1", "exfiltrates_to", "ip", "9.9.9.9", 0.7, 3.0), ("10.0.0.1", "precedes", "ip", "9.9.9.9", 0.95, 4.0)])
    _, grouped = incidents.correlate(found)
    order = [r.predicate for r in incidents.in_reading_order(grouped).orderBy("place").collect()]
    assert order == ["beacons_to", "exfiltrates_to", "scans", "precedes"]
    pivots = incidents.distinct_pivots(incidents.pivots(grouped))
    assert {(r.field, r.value): r.score for r in pivots.collect()} == {("dst", "9.9.9.9"): 0.9, ("dst_port", "80"): 0.5}
    assert incidents.incident_evidence(grouped).count() == 2  # equal evidence counts once
    cost = math.ceil(len("fi_0123456789abcdef: 10.0.0.1 beacons_to 9.9.9.9 (0.90)") / 4)
    two = incidents.briefs(grouped, 3 * cost).orderBy("part", "place").collect()
    assert [(r.part, r.place) for r in two][:2] == [(0, 1), (0, 2)] and sum(r.cost for r in two) <= 3 * cost and any(r.part == 1 for r in incidents.briefs(grouped, 1000).collect())
    claims = spark.createDataFrame([("c1", "ip:10.0.0.1", "t"), ("c2", "ip:10.0.0.1", "u")], "claim_id string, incident string, text string")
    verdicts = spark.createDataFrame([("c1", "grounded"), ("c2", "no_citation")], "claim_id string, verdict string")
    assert [r.claim_id for r in incidents.verified_claims(claims, verdicts).collect()] == ["c1"]


# ---------------------------------------------------------------- streams


def streamed(spark, tmp_path, batches, build, mode="append"):
    """The rows that a stream over files of JSON lines gives out, a file a batch."""
    import json

    (tmp_path / "in").mkdir()
    fields = "ts double, src_ip string, dst_ip string, dst_port int, orig_bytes long, resp_bytes long, signature string"
    source = spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(tmp_path / "in"))
    query = build(source).writeStream.format("memory").queryName(f"t{abs(hash(str(tmp_path)))}").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for k, rows in enumerate(batches):
            (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
            query.processAllAvailable()
        return query, spark.sql(f"select * from {query.name}").collect()
    finally:
        query.stop()


def flow(ts, src="a", dst="x", port=80, n=1, sig=None):
    return {"ts": ts, "src_ip": src, "dst_ip": dst, "dst_port": port, "orig_bytes": n, "resp_bytes": n, "signature": sig}


def test_novel_destinations_expire(spark, tmp_path):
    batches = [[flow(100.0), flow(160.0, dst="y"), flow(170.0)], [flow(200.0), flow(260.0, dst="z")], [flow(5000.0), flow(5001.0, dst="z")]]
    _, got = streamed(spark, tmp_path, batches, lambda s: summaries.novel_destinations(s, horizon=1000.0))
    assert sorted((r.dst_ip, r.first_seen, r.since_source) for r in got if r.first_seen < 1000) == [("x", 100.0, 0.0), ("y", 160.0, 60.0), ("z", 260.0, 160.0)]
    assert sorted(r.dst_ip for r in got if r.first_seen > 1000) == ["x", "z"]  # forgotten after the horizon


def test_enriched_stream(spark, tmp_path):
    feed = intel.normalised_indicators(spark.createDataFrame([("10.0.0.0/8", 1), ("10.1.0.0/16", 2), ("2001:db8::/32", 3), ("10.1.2.3", 4)], "value string, source_line long").selectExpr("value", "0.5D confidence", "cast(null as date) added", "'f' source_file", "source_line"))
    statements = spark.createDataFrame([("a", "host-a", True), ("b", "host-b", False)], "address string, hostname string, applies boolean")
    rows = [flow(1.0, dst="10.9.9.9"), flow(2.0, dst="10.1.9.9"), flow(3.0, dst="10.1.2.3"), flow(4.0, src="b", dst="2001:db8::7"), flow(5.0, dst="9.9.9.9")]
    fields = "ts double, src_ip string, dst_ip string, dst_port int, orig_bytes long, resp_bytes long, signature string"
    source = spark.createDataFrame([[r[k.split()[0]] for k in fields.split(", ")] for r in rows], fields)
    source.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a restart adds nothing
        query = summaries.write_enriched(spark.readStream.schema(fields).parquet(str(tmp_path / "in")), feed, str(tmp_path / "out"), str(tmp_path / "cp"), statements)
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == len(rows) and {r.dst_ip: (r.indicator, r.src_host) for r in got} == {"10.9.9.9": ("10.0.0.0/8", "host-a"), "10.1.9.9": ("10.1.0.0/16", "host-a"), "10.1.2.3": ("10.1.2.3", "host-a"), "2001:db8::7": ("2001:db8::/32", None), "9.9.9.9": (None, "host-a")}


def test_windows_sessions_and_late_rows(spark, tmp_path):
    batches = [[flow(float(k), dst=str(k)) for k in range(60)], [flow(20_000.0)], [flow(5.0), flow(20_001.0)], [flow(40_000.0)]]
    query, got = streamed(spark, tmp_path, batches, lambda s: summaries.sliding_fanout(s, least=50))
    assert {r.src_ip for r in got} == {"a"} and all(abs(r.destinations - 60) <= 6 for r in got) and len(got) == 4
    assert summaries.dropped_rows(query) >= 1


def test_bursts_and_first_alerts(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    _, got = streamed(spark, tmp_path / "a", [[flow(1.0), flow(11.0), flow(100.0)], [flow(20_000.0)], [flow(30_000.0)]], summaries.burst_sessions)
    assert sorted((r.ts, r.flows) for r in got)[:2] == [(1.0, 2), (100.0, 1)]
    _, got = streamed(spark, tmp_path / "b", [[flow(1.0, sig="s"), flow(2.0, sig="t")], [flow(3.0, sig="s")]], summaries.first_alerts)
    assert sorted(r.signature for r in got) == ["s", "t"]


def test_tail_and_lateness(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("one\ntwo\n")
    query = summaries.tail_lines(spark, str(tmp_path / "logs")).writeStream.format("memory").queryName("tail").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        assert sorted(r.line for r in spark.sql("select line from tail").collect()) == ["one", "two"]
    finally:
        query.stop()
    (tmp_path / "s").mkdir()
    query, _ = streamed(spark, tmp_path / "s", [[flow(1.0), flow(700.0)]], lambda s: summaries.with_lateness(s, "lateness"))
    seen = [p["observedMetrics"]["lateness"] for p in query.recentProgress if p["numInputRows"]]
    assert seen[0]["records"] == 2 and seen[0]["wide"]


def test_names_of_two_label_suffixes(spark):
    d = schema.conform(spark.createDataFrame([(float(k), "h", f"{'x' * 9}{k}é.shop.example.co.uk", "TXT") for k in range(60)], "ts double, src_ip string, query string, qtype string"), schema.DNS)
    z = names.tunnel_zones(names.lookup_totals(d)).first()
    assert (z.zone, z.distinct_names) == ("example.co.uk", 60) and z.mean_entropy > one(spark, S.byte_entropy(F.lit("x" * 9 + "0shop")))
