"""Telemetry operators on small literal rows; expected values are worked out from the formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade import schema
from palisade.functions import scalars as S
from palisade.operators import host, intel, names, network
from palisade.operators.findings import check_grammar, grammar, to_findings, with_finding_id
from palisade.plans import incidents
from palisade.streaming import summaries


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def conn(spark, rows):
    return schema.conform(spark.createDataFrame(rows, "ts double, src_ip string, dst_ip string, dst_port int, orig_bytes long, resp_bytes long, source_file string, source_line long"), schema.CONNECTIONS)


# ---------------------------------------------------------------- functions


@pytest.mark.parametrize("name, zone", [("a.b.example.com", "example.com"), ("A.Example.CO.UK.", "example.co.uk"), ("co.uk", "co.uk"), ("x", "x"), ("a..b.c", "b.c"), ("", "")])
def test_registered_domain(spark, name, zone):
    assert one(spark, S.registered_domain(F.lit(name))) == zone


def test_strings(spark):
    assert one(spark, S.subdomain_of(F.lit("a.b.example.com"), F.lit("example.com"))) == "ab"
    assert one(spark, S.longest_consonant_run(F.lit("xkcd1bcdaei"))) == 4
    assert one(spark, S.longest_consonant_run(F.lit("aei"))) == 0
    assert one(spark, S.byte_entropy(F.lit("aabb"))) == pytest.approx(1.0)
    assert one(spark, S.byte_entropy(F.lit("éé"))) == pytest.approx(1.0)  # bytes, not characters
    assert one(spark, S.image_name(F.lit("C:/A\\B.EXE"))) == "b.exe"
    assert one(spark, S.image_name(F.lit("C:\\"))) is None
    assert [one(spark, S.path_anomaly(F.lit(p))) for p in ("C:\\Users\\x.exe", "c:/windows/system32/a", "C:\\Windows\\a", "D:\\a", None)] == [1.0, 0.15, 0.30, 0.55, None]
    assert [one(spark, S.category_weight(F.lit(c))) for c in ("Not Suspicious Traffic", "A Network Trojan was detected", "suspicious login", None, "odd")] == [0.10, 1.0, 0.55, 0.40, 0.40]


def test_scores_skip_what_is_unmeasured(spark):
    mean = S.geometric_mean([(F.lit(0.5), 0.6), (F.lit(None).cast("double"), 0.4)])
    assert one(spark, mean) == pytest.approx(0.5)
    assert one(spark, S.geometric_mean([(F.lit(0.0), 0.5), (F.lit(1.0), 0.5)])) == pytest.approx(0.1)
    assert one(spark, S.geometric_mean([(F.lit(None).cast("double"), 1.0)])) is None
    assert one(spark, S.robust_deviation(F.lit(9.0), F.lit(1.0), F.lit(0.0), F.lit(5))) is None
    assert one(spark, S.dispersion(F.lit(0.0), F.lit(1.0))) == 1.0


@pytest.mark.parametrize("value, kind", [("http://x/y", "url"), ("a" * 32, "file_hash"), ("10.0.0.0/8", "cidr"), ("evil.example/a", "url"), ("10.0.0.1", "ip"), ("2001:db8::1", "ip"), ("2001:db8::/32", "cidr"), ("evil.example.", "domain"), ("word", None), ("a/b", None), ("", None), ("300.1.1.1", "domain")])
def test_indicator_kind(spark, value, kind):
    assert one(spark, S.indicator_kind(F.lit(value))) == kind


def test_dates_and_addresses(spark):
    assert [str(one(spark, S.parse_date(F.lit(t)))) for t in ("2024-03-01", "2024/03/01", "01/03/2024", "2024-03-01T05:06:07Z", "soon")] == ["2024-03-01"] * 4 + ["None"]
    assert [one(spark, S.confidence(F.lit(t))) for t in ("0.85", "85%", "4.2", "x")] == [0.85, 0.85, None, None]
    assert one(spark, S.dotted(S.ipv4_network(S.ipv4_number(F.lit("10.1.2.77")), 27))) == "10.1.2.64"
    assert one(spark, S.canonical_ipv6(F.lit("2001:0db8:0::0001"))) == "2001:db8::1"


def test_conform(spark):
    got = schema.conform(spark.createDataFrame([("x", "7")], "ts string, dst_port string"), schema.CONNECTIONS).first()
    assert (got.ts, got.dst_port, got.uid) == (None, 7, None) and len(got) == 16


# ---------------------------------------------------------------- detectors


def test_fanout(spark):
    rows = [(float(i), "10.0.0.1", f"10.9.{i // 200}.{i % 200}", 445, 1, 1, "f", i) for i in range(300)] + [(1.0, "10.0.0.2", "10.9.0.1", 53, 1, 1, "f", 900)]
    got = network.detect_fanout(conn(spark, rows)).collect()
    expected = math.exp(0.55 * math.log(1 - math.exp(-300 / 250)) + 0.45 * math.log(1.0))
    assert [(r.subject, r.object, r.predicate) for r in got] == [("10.0.0.1", "445", "scans")] and got[0].score == pytest.approx(expected, abs=1e-4)
    assert got[0].evidence[0].artifact.source_line == 0


def test_egress_bands(spark):
    rows = []
    for d in range(8):
        rows += [(3600.0 * d + k, "10.0.0.1", f"1.1.1.{d}", 443, 200_000 + d * 1000, 200_000, "f", d * 10 + k) for k in range(6)]
    rows += [(40_000.0, "10.0.0.1", "9.9.9.9", 443, 50_000_000, 1000, "f", 500)]
    got = {(r.subject, r.object): r for r in network.detect_egress(conn(spark, rows)).collect()}
    assert got["10.0.0.1", "9.9.9.9"].predicate == "exfiltrates_to" and len(got) == 1
    blind = conn(spark, [(*r[:5], None, *r[6:]) for r in rows])  # one direction only: no claim on direction
    kinds = {r.predicate for r in network.detect_egress(blind).collect()}
    assert "exfiltrates_to" not in kinds


def brute_beacon(ts, sizes, hosts):
    """The components of one pair by NumPy, as the formulas have them."""
    ts = np.array(ts)
    gaps = np.diff(ts)
    gaps = gaps[gaps > 0]
    median, q25 = np.median(gaps), np.percentile(gaps, 25)
    mad = np.median(np.abs(gaps - median))
    size_median = np.median(sizes)
    size_mad = np.median(np.abs(np.array(sizes) - size_median))
    span = ts[-1] - ts[0]
    res = min(max(2.5 * mad, median / 4), median / 2)
    n = int(span / res) + 1
    bins = np.bincount(np.minimum(((ts - ts[0]) / res).astype(int), n - 1), minlength=n) - len(ts) / n
    lags = range(max(1, round(0.8 * median / res)), min(round(1.2 * median / res), n - 1) + 1)
    best = max((bins[: n - k] * bins[k:]).sum() / (bins * bins).sum() for k in lags)
    cover = min(len(gaps), span / median) / max(len(gaps), span / median)
    parts = [1 - min(1, mad / median / 0.6), 1 - min(1, (median - q25) / median / 0.6), 1 - min(1, size_mad / size_median / 0.5), min(1, max(0, best)), cover * (1 - math.exp(-len(ts) / 15)), 1 / math.sqrt(hosts)]
    weights = network.BeaconParams.weights
    return parts, math.exp(sum(w * math.log(max(p, 0.01)) for p, w in zip(parts, weights)))


@pytest.mark.parametrize("jitter", [0, 3, 9])
def test_beaconing(spark, jitter):
    rng = np.random.default_rng(jitter)
    ts = np.cumsum(60 + rng.integers(-jitter, jitter + 1, 120)).astype(float)
    sizes = (500 + rng.integers(0, 9, 120)).tolist()
    rows = [(float(t), "10.0.0.1", "9.9.9.9", 443, int(s), 1, "f", k) for k, (t, s) in enumerate(zip(ts, sizes))]
    rows += [(float(k * k), "10.0.0.2", "9.9.9.9", 443, 10, 1, "f", 1000 + k) for k in range(30)]
    got = [r for r in network.score_beacons(conn(spark, rows), network.BeaconParams(min_score=0.0)).collect() if r.src_ip == "10.0.0.1"][0]
    parts, score = brute_beacon(ts, sizes, 2)
    assert [got[p] for p in network.BEACON_PARTS] == pytest.approx(parts, abs=1e-9) and got.score == pytest.approx(score)


def test_bursts_are_one_checkin(spark):
    rows = [(600.0 * k + 0.5 * j, "10.0.0.1", "9.9.9.9", 443, 100, 1, "f", 10 * k + j) for k in range(40) for j in range(3)]
    got = network.score_beacons(conn(spark, rows), network.BeaconParams(min_score=0.0)).first()
    assert got.checkins == 40 and got.gap_median == pytest.approx(600.0)


def test_dns_tunnel_and_types(spark):
    rows = [(float(i), "10.0.0.1", f"{i:04x}{'abcdefghijklmnop'[i % 16]}zq{i * 7919 % 9973:05d}.t.evil.example", "TXT") for i in range(80)]
    rows += [(float(i), "10.0.0.2", "www.example.com", "A") for i in range(80)]
    dns = schema.conform(spark.createDataFrame(rows, "ts double, src_ip string, query string, qtype string"), schema.DNS)
    got = names.score_tunnels(dns, names.TunnelParams(min_score=0.0)).collect()
    assert [(r.src_ip, r.zone, r.distinct_names, r.qtype_skew) for r in got] == [("10.0.0.1", "evil.example", 80, 1.0)]


def test_bigram_model_prefers_its_language(spark):
    words = spark.createDataFrame([(w,) for w in ["banana", "bandana", "cabana", "canada"] * 30], "word string")
    labels = spark.createDataFrame([("banana",), ("xqzjkv",), ("x",)], "label string")
    got = {r.label: r.improbability for r in names.improbability(labels, names.fit_bigrams(words)).collect()}
    assert got["banana"] < 0.2 < 0.9 < got["xqzjkv"] and "x" not in got


def test_host_gate_and_ancestry(spark):
    few = spark.createDataFrame([("h1", "C:\\a.exe", None, 1.0, "g1", None)], "host string, image string, parent_image string, ts double, process_guid string, parent_guid string")
    assert host.estate_baseline(host.process_triples(few)).first().gate.startswith("1 hosts") and host.score_processes(few).count() == 0
    rows = [("h", f"C:\\{n}.exe", 1.0, n, p) for n, p in (("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("f", "e"), ("x", "y"), ("y", "x"), ("z", "gone"))]
    got = {r.process_guid: (r.chain, r.truncated) for r in host.ancestry(spark.createDataFrame(rows, "host string, image string, ts double, process_guid string, parent_guid string").withColumns({"source_file": F.lit("f"), "source_line": F.lit(1)})).collect()}
    assert got["f"] == (["e.exe", "d.exe", "c.exe", "b.exe"], True) and got["b"] == (["a.exe"], False) and got["x"] == (["y.exe"], False) and got["z"] == ([], False)


def test_longest_prefix_and_nearest_zone(spark):
    feed = spark.createDataFrame([("10.0.0.0/8",), ("10.1.0.0/16",), ("10.1.2.3",), ("evil.example",), ("a.evil.example",)], "value string").withColumn("kind", S.indicator_kind(F.col("value")))
    seen = spark.createDataFrame([("10.9.9.9",), ("10.1.9.9",), ("10.1.2.3",), ("11.0.0.1",), ("x.a.evil.example",), ("evil.example",), ("notevil.example",)], "value string")
    assert {r.value: r.indicator for r in intel.match_addresses(seen, feed).collect()} == {"10.9.9.9": "10.0.0.0/8", "10.1.9.9": "10.1.0.0/16", "10.1.2.3": "10.1.2.3"}
    assert {r.value: (r.indicator, r.exact) for r in intel.match_domains(seen, feed).collect()} == {"x.a.evil.example": ("a.evil.example", False), "evil.example": ("evil.example", True)}


def test_staleness(spark):
    day = lambda t: F.lit(t).cast("date")
    got = [one(spark, intel.staleness(day(t), day("2024-06-01"), day("2024-06-02"))) for t in (None, "2024-05-01", "2024-01-01", "2020-01-01", "2024-07-01")]
    assert got == ["undated", "current", "stale", "expired", "stated_after_capture"]


# ---------------------------------------------------------------- findings and incidents


def findings(spark, rows):
    base = spark.createDataFrame(rows, "predicate string, subject_type string, subject string, object_type string, object string, score double, first_seen double, file string").withColumn("last_seen", F.col("first_seen")).withColumn("artifact", F.struct(F.col("file").alias("source_file"), F.lit(1).cast("long").alias("source_line")))
    return with_finding_id(to_findings(base, F.col("predicate"), F.col("subject"), F.col("object_type"), F.col("object"), F.lit("high"), "t@1", {"c": F.col("score")}, "k", F.lit("s"), {"object": F.col("object")}, subject_type=F.col("subject_type")))


BEACON = ("beacons_to", "ip", "10.0.0.1", "ip", "9.9.9.9", 0.8, 100.0, "conn")


def test_grammar(spark):
    assert grammar(spark).count() == 18
    good, bad = check_grammar(findings(spark, [BEACON, ("beacons_to", "user", "u", "ip", "9.9.9.9", 0.5, 1.0, "f"), ("invented", "ip", "a", None, None, 0.5, 1.0, "f"), ("matches_threat_intel", "ip", "9.9.9.9", None, None, 1.5, 1.0, "f"), ("scans", "ip", "a", "domain", "b", 0.5, 1.0, "f")]))
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == ["confidence outside 0..1", "object type", "subject type", "unknown predicate"]


def test_ids_are_of_content(spark):
    a, b = findings(spark, [BEACON]).first().finding_id, findings(spark, [BEACON]).first().finding_id
    assert a == b != findings(spark, [(*BEACON[:4], "9.9.9.8", *BEACON[5:])]).first().finding_id


def test_priority_and_attachment(spark):
    rows = [BEACON, ("beacons_to", "ip", "10.0.0.1", "ip", "9.9.9.8", 0.5, 90.0, "conn"), ("scans", "ip", "10.0.0.1", "port", "445", 0.6, 5000.0, "conn"), ("matches_threat_intel", "ip", "9.9.9.9", None, None, 0.5, 10.0, "conn"), ("matches_threat_intel", "ip", "8.8.8.8", None, None, 0.5, 10.0, "conn")]
    ranked, grouped = incidents.correlate(findings(spark, rows))
    got = {r.incident: r for r in ranked.collect()}
    assert set(got) == {"ip:10.0.0.1", "ip:8.8.8.8"}
    assert got["ip:10.0.0.1"].priority == pytest.approx((1 - 0.2 * 0.4 * 0.5) * 1.5) and got["ip:10.0.0.1"].behaviours == 2
    assert [r.place for r in incidents.ranked_queue(ranked, 10).orderBy("place").collect()] == [1, 2]
    chain = [(r.subject, r.object, r.score) for r in incidents.sequence(grouped).orderBy("first_seen").collect()]
    assert chain == [("9.9.9.9", "9.9.9.8", 0.5), ("9.9.9.8", "445", 0.5)]
    place = {r.subject: r.place for r in incidents.subject_ranks(ranked, spark.createDataFrame([("8.8.8.8",), ("1.1.1.1",)], "subject string")).collect()}
    assert place == {"ip:8.8.8.8": 2}


def test_hunt(spark):
    found = findings(spark, [BEACON, ("tunnels_dns_over", "ip", "10.0.0.1", "domain", "evil.example", 0.7, 1.0, "dns")])
    c = conn(spark, [(1.0, s, "9.9.9.9", 443, 1, 1, "f", 1) for s in ("10.0.0.1", "10.0.0.2", "10.0.0.2")])
    d = spark.createDataFrame([(5.0, "10.0.0.3", "x.y.evil.example"), (6.0, "10.0.0.4", "notevil.example")], "ts double, src_ip string, query string")
    p = incidents.pivots(found)
    got = sorted((r.subject, r.events) for r in incidents.hunt(p, incidents.history(c, dns=d)).collect())
    assert got == [("10.0.0.2", 2), ("10.0.0.3", 1)]


def test_claims(spark):
    claims = spark.createDataFrame([("a", "10.0.0.1 on port 443", ["e1"]), ("b", "x", None), ("c", "x", ["nope"]), ("d", "evil.example at 10.0.0.9", ["e1"])], "claim_id string, text string, cites array<string>")
    citable = spark.createDataFrame([("e1", "10.0.0.1 talks on port 443")], "id string, text string")
    got = {r.claim_id: (r.verdict, r.missing) for r in incidents.check_claims(claims, citable).collect()}
    assert got == {"a": ("grounded", ""), "b": ("no_citation", ""), "c": ("unresolved_citation", ""), "d": ("ungrounded_entity", "10.0.0.9,evil.example")}


def test_context_pack(spark):
    rows = spark.createDataFrame([("i", "f1", 0.9, 5), ("i", "f2", 0.8, 6), ("i", "f3", 0.7, 1)], "incident string, finding_id string, score double, cost int")
    assert [r.finding_id for r in incidents.context_pack(rows, 11).collect()] == ["f1", "f2"]


def test_subjects_are_named_by_the_register(spark):
    window = intel.capture_window(spark.createDataFrame([(1_717_200_000.0,)], "ts double"))
    assets = spark.createDataFrame([("10.0.0.1", "alpha", "2024-05-01", "a", 1), ("10.0.0.1", "beta", "2024-05-20", "a", 2), ("10.0.0.2", "old", "2019-01-01", "a", 3)], "address string, hostname string, stated string, source_file string, source_line long").withColumn("stated", F.col("stated").cast("date"))
    got = intel.name_subjects(findings(spark, [BEACON, ("scans", "ip", "10.0.0.2", "port", "1", 0.5, 1.0, "f")]), intel.applied_assets(assets, window)).collect()
    assert sorted((r.subject_type, r.subject, len(r.evidence)) for r in got) == [("host", "beta", 2), ("ip", "10.0.0.2", 1)]


# ---------------------------------------------------------------- streaming


def test_stream_summaries_equal_batch(spark, tmp_path):
    rows = conn(spark, [(float(k * 97 % 9000), f"10.0.0.{k % 3}", f"9.9.9.{k % 5}", 443, k, None if k % 4 else k, "f", k) for k in range(200)] + [(90_000.0, "10.0.0.9", "9.9.9.9", 1, 1, 1, "f", 999)])
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = summaries.pair_summaries(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(120)
    got = {tuple(r) for r in summaries.merge_pairs(spark.read.parquet(str(tmp_path / "out"))).collect()}
    want = {tuple(r) for r in summaries.merge_pairs(summaries.pair_summaries(rows.where("ts < 80000"))).collect()}
    assert got == want  # the last window stays open


def test_stream_novelty_and_alerts(spark, tmp_path):
    rows = conn(spark, [(float(k), "10.0.0.1", f"9.9.9.{k % 3}", 443, 1, 1, "f", k) for k in range(30)])
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = summaries.novel_destinations(stream).writeStream.format("memory").queryName("novel").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.dst_ip, r.first_seen, r.since_source) for r in spark.table("novel").collect()) == [("9.9.9.0", 0.0, 0.0), ("9.9.9.1", 1.0, 1.0), ("9.9.9.2", 2.0, 2.0)]
