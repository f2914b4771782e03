"""Shared summaries, exact quantiles of groups of any size, series in chunks, and the run over all detectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade import schema
from palisade.functions import scalars as S
from palisade.operators import intel, names, network, selection
from palisade.plans import detectors
from palisade.sources.shared import Store, stored

from .test_telemetry import conn


def groups():
    rng = np.random.default_rng(5)
    rows = [("hot", 443, float(v)) for v in rng.lognormal(3, 4, 4000)]  # most rows of the table
    rows += [("ties", None, float(v)) for v in rng.integers(-3, 4, 500)]
    rows += [("one", None, 2.5), ("two", 1, -1e300), ("two", 1, 1e-320), ("same", 1, 7.0), ("same", 1, 7.0), ("same", 1, 7.0), ("none", 1, None), (None, None, 0.0), (None, None, -0.0), (None, None, 5.0)]
    return rows + [("near", 1, 1 + k * 2.0**-52) for k in range(9)]


@pytest.mark.parametrize(("most", "rounds"), [(0, 1), (0, 2), (100, 0), (100_000, 1)])
def test_quantiles_of_groups(spark, most, rounds):
    rows = groups()
    df = spark.createDataFrame(rows, "src string, port int, x double").repartition(4)
    shares = {"median": 0.5, "low": 0.25, "most": 1.0, "odd": 0.37}
    got = {(r.src, r.port): r for r in selection.group_quantiles(df, ["src", "port"], "x", shares, most=most, rounds=rounds).collect()}
    want = {}
    for s, p, x in rows:
        if x is not None:
            want.setdefault((s, p), []).append(x)
    assert set(got) == set(want)
    for key, values in want.items():
        assert got[key].n == len(values)
        for name, share in shares.items():
            assert got[key][name] == pytest.approx(np.quantile(values, share), rel=1e-12, abs=1e-300), (key, name)


def test_large_groups_are_not_sorted_or_held(spark):
    df = stored(spark.createDataFrame(groups(), "src string, port int, x double"))
    plan = selection.group_quantiles(df, ["src"], "x", {"median": 0.5}, most=50)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" in plan and "LeftAnti" in plan  # only of what is left of the large groups
    sifted = selection.sifted_quantiles(df.select("src", F.col("x").alias("v")), ["src"], {"median": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in sifted and "collect" not in sifted


def test_cells_rise_with_the_value(spark):
    values = sorted([0.0, -0.0, 1e-320, -1e-320, 1e308, -1e308, *np.random.default_rng(1).normal(0, 50, 300).tolist(), *(1 + np.arange(50) * 2.0**-50).tolist()])
    cells = [r.c for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(selection.first_cell(F.col("v")).alias("c")).collect()]
    assert cells == sorted(cells)


def bursts():
    rng = np.random.default_rng(11)
    rows, line = [], 0
    for src, port in (("10.0.0.1", 443), ("10.0.0.2", None), ("10.0.0.3", 80)):
        at = 0.0
        for _ in range(60):
            at += float(rng.integers(500, 700))
            for _ in range(int(rng.integers(1, 5))):
                rows.append((at, src, "9.9.9.9", port, int(rng.integers(100, 110)), 1, "f", line))
                at += float(rng.integers(0, 3))
                line += 1
    return rows


@pytest.mark.parametrize("chunk_rows", [3])
def test_chunks_change_nothing(spark, chunk_rows):
    c = conn(spark, bursts()).repartition(3)
    columns = [*network.PAIR, "checkins", "gap_median", "gap_mad", *network.BEACON_PARTS, "score"]
    whole, cut = (network.score_beacons(c, network.BeaconParams(min_score=0.0, chunk_rows=k)).select(*columns).orderBy("src_ip").collect() for k in (100_000, chunk_rows))
    assert len(whole) == 3 and all(60 <= r.checkins < 120 for r in whole)  # several rows a burst
    assert [list(map(str, r[:3])) for r in cut] == [list(map(str, r[:3])) for r in whole]
    for a, b in zip(cut, whole):
        assert list(a)[3:] == pytest.approx(list(b)[3:])


class Watched(Store):
    """A store that keeps what its tables were made by."""

    def put(self, df, name="table"):
        self.plans = {**getattr(self, "plans", {}), name: df._jdf.queryExecution().executedPlan().toString()}
        return super().put(df, name)


def test_series_are_shuffled_once(spark):
    """Joins with what is told of each pair, bursts and autocorrelation shuffled all rows a dozen times."""
    store = Watched(spark)
    rows = store.put(conn(spark, bursts()), "rows")
    found = network.score_beacons(rows, network.BeaconParams(min_score=0.0), store)
    plans = list(store.plans.values()) + [found._jdf.queryExecution().executedPlan().toString()]
    assert found.count() == 3
    by_chunk = [p for p in plans if "hashpartitioning(src_ip" in p and "chunk" in p.split("hashpartitioning(src_ip")[1].split(")")[0]]
    assert len(by_chunk) <= 2  # the series, and the starts of bursts
    assert not any("SortMergeJoin" in store.plans[name] for name in ("series", "ends", "splits", "bursts", "checkins"))


@pytest.mark.parametrize("most", [20, 100_000])
def test_transfers_of_pairs_are_dealt_by_source_once(spark, most):
    """Ports were added up in one shuffle, and the sums were stored and shuffled again to be windowed."""
    rng = np.random.default_rng(3)
    rows = [(float(rng.integers(0, 9000)), f"10.0.0.{k % 7 % 5}", f"9.9.{k % 3}.{rng.integers(0, 9)}", int(rng.integers(1, 4)), int(rng.integers(1, 3_000_000)) if k % 6 else None, int(rng.integers(1, 900_000)) if k % 4 else None, "f", k) for k in range(600)]
    rows += [(1.0, None, "9.9.9.9", 1, 5, 5, "f", 700), (1.0, "10.0.0.1", "9.9.9.8", 1, None, 5, "f", 701), (2.0, "10.0.0.1", "9.9.9.7", None, 2_000_000, 5, "f", 702), (3.0, "10.0.0.1", "9.9.9.7", 2, None, 5, "f", 703)]
    store, p = Store(spark), network.EgressParams(min_bytes=1, rare_bytes=1, min_peers=2, exfil_score=0.3, volume_score=0.1, rare_score=0.0, rare_flows=1)
    pairs = store.put(network.pair_totals(conn(spark, rows)), "pairs")
    new, old = network.score_pair_transfers(pairs, p, store, most), network.score_transfers(network.egress_totals(pairs), p, store, most)
    if most > 600:
        assert network.strongest_claims(new, p)._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(src_ip") == 1
    columns = sorted(old.columns)
    got, want = (sorted(map(tuple, df.select(*columns).collect()), key=str) for df in (new, old))
    assert sorted(new.columns) == columns and len(want) > 20
    for a, b in zip(got, want, strict=True):
        assert [x if x is None or isinstance(x, str) else pytest.approx(x) for x in b] == list(a)


@pytest.mark.parametrize("chunk_rows", [2, 5])
def test_a_burst_goes_on_over_chunks(spark, chunk_rows):
    """A burst of many rows fills chunks of its own; rows without bytes, and negative ones, count as they did."""
    rows, line = [], 0
    for k in range(40):
        for j in range(60 if k % 10 == 3 else 1 + k % 3):
            rows.append((1000.0 * k + 0.25 * j + k % 7, "10.0.0.1", "9.9.9.9", 443, None if (k % 5 == 0 or line % 4 == 1) else 100 + 7 * k - j, 1, "f", line))
            line += 1
    store = Store(spark)
    c, p = conn(spark, rows).repartition(3), network.BeaconParams(min_score=0.0, chunk_rows=chunk_rows)
    candidates = store.put(network.timed_pairs(network.timed_totals(c)))
    series = store.put(network.ordered(network.candidate_series(c, candidates, p)))
    borders = store.put(network.chunk_borders(series))
    found = network.checkins(series, borders, spark.createDataFrame([("10.0.0.1", "9.9.9.9", 443, 100.0)], "src_ip string, dst_ip string, dst_port int, threshold double"), store)
    want = []
    for ts, *_, size, _, _, _ in rows:
        if not want or ts - at > 100:
            want.append([ts, None, ts - want[-1][0] if want else None])
        at = ts
        if size is not None:
            want[-1][1] = (want[-1][1] or 0) + size
    assert [[r.ts, r.bytes, r.gap] for r in found.orderBy("ts").collect()] == want


def test_totals_merge(spark):
    """Totals of two parts of a capture, merged, are those of the whole."""
    c = conn(spark, [*bursts(), (5.0, None, "9.9.9.9", 1, None, 3, "a", 1), (None, "10.0.0.1", None, None, 4, None, "b", 2)])
    parts = [network.pair_totals(c.where(f"source_line % 2 = {k}")) for k in (0, 1)]
    added = ("flows", "timed_flows", "bytes_out", "measured_flows", "both_flows", "both_out", "both_in")
    merged = parts[0].unionByName(parts[1]).groupBy(*network.PAIR).agg(*[F.sum(k).alias(k) for k in added], F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min("first_at").alias("first_at"))
    key = lambda r: str(list(r)[:3])
    whole = network.pair_totals(c)
    assert sorted(map(tuple, merged.select(*whole.columns).collect()), key=key) == sorted(map(tuple, whole.collect()), key=key)


def capture(spark):
    rows = bursts() + [(float(i), "10.0.0.7", f"10.9.{i // 200}.{i % 200}", 445, 1, 1, "f", 10_000 + i) for i in range(300)]
    d = schema.conform(spark.createDataFrame([(float(k), "10.0.0.1", f"{'x' * 9}{k}.shop.example.org", "TXT", "9.9.9.9") for k in range(60)], "ts double, src_ip string, query string, qtype string, answers string"), schema.DNS)
    s = schema.conform(spark.createDataFrame([(float(k), f"10.0.0.{k % 20}", f"1.1.1.{k % 3}", "a" if k % 20 else "b") for k in range(100)], "ts double, src_ip string, dst_ip string, ja3 string"), schema.SSL)
    a = schema.conform(spark.createDataFrame([(float(k), "10.0.0.1", None, "sig", 7, "A Network Trojan was detected", 1) for k in range(5)], "ts double, src_ip string, dst_ip string, signature string, signature_id long, category string, severity int"), schema.ALERTS)
    p = schema.conform(spark.createDataFrame([(float(k), f"h{k % 9}", "C:\\odd.exe" if k == 5 else "C:\\Windows\\a.exe", "C:\\p.exe") for k in range(400)], "ts double, host string, image string, parent_image string"), schema.PROCESSES)
    feed = intel.normalised_indicators(spark.createDataFrame([("9.9.9.0/24", 0.9, None, "x.ioc", 1), ("example.org", 0.8, None, "x.ioc", 2)], "value string, confidence double, added date, source_file string, source_line long"))
    return detectors.Telemetry(conn(spark, rows), d, s, a, p, feed)


PARAMS = {"beacons": network.BeaconParams(min_score=0.1), "tunnels": names.TunnelParams(min_score=0.1), "samples": 3}


def test_one_run_equals_single_detectors(spark):
    t, registry, single = capture(spark), detectors.registry(**PARAMS), ("fanout", "egress", "dns_tunnel", "alerts", "intel", "tls_dga")
    with Store(spark) as store:
        found, rejected = detectors.detect_all(t, registry, store)
        got = found.select("predicate", "subject", "object", "score", "severity", "detector", "first_seen", "last_seen", F.col("evidence")[0]["artifact"].alias("artifact"), F.col("evidence")[0]["samples"].alias("samples")).collect()
        assert rejected.count() == 0 and len({r.predicate for r in got}) >= 5
        files = found.select("finding_id").inputFiles()
        assert files and all("/summaries-" in f and "-findings/" in f for f in files)  # what comes after reads findings only
        alone = [d.detect(t).select("predicate", "subject", "object", "score", "severity", "detector", "first_seen", "last_seen", F.col("evidence")[0]["artifact"].alias("artifact"), F.col("evidence")[0]["samples"].alias("samples")).collect() for d in registry if d.name in single]
    assert sorted(str(r) for r in got if r.detector.split("@")[0] in single) == sorted(str(r) for rows in alone for r in rows)
    scan = next(r for r in got if r.predicate == "scans")
    assert tuple(scan.artifact) == ("f", 10_000)


def test_each_table_is_read_once_for_its_summary(spark):
    """With what ``summarised`` stores, no detector but beaconing (its candidates' series) reads a telemetry table again."""
    t = capture(spark)
    with Store(spark) as store:
        s = detectors.summarised(t, store)
        alone = detectors.replace(s, **{n: getattr(t, n).where(F.raise_error(F.lit("read again")).isNotNull()) for n in ("connections", "dns", "ssl", "processes")})
        found = [d.detect(alone) for d in detectors.registry(samples=0) if d.name not in ("beaconing", "host")]
        assert sum(f.count() for f in found) > 0


def test_parts_of_a_score_are_written_once(spark):
    """As plain columns each part's formula stood in the plan again wherever the score or a filter named it."""
    df = spark.range(5).withColumn("x", F.col("id") * 1.0)
    once = S.computed_once(S.computed_once(df, {"part": F.exp("x")}), {"score": F.col("part") * F.col("part") + F.col("part")}).where("score > 2")
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert plan.upper().count("EXP(") == 1
    assert sorted(r.id for r in once.collect()) == [1, 2, 3, 4]


def test_claims_are_scored_once(spark, tmp_path):
    """The plan of the findings reads the stored claims; it held the windows of every source twice."""
    rows = [(float(i), f"10.0.0.{i % 3}", f"192.168.0.{i % 40}", 443, 30_000 + i % 7 * 1000, 100, "f", i) for i in range(400)]
    conn = spark.createDataFrame(rows, "ts double, src_ip string, dst_ip string, dst_port int, orig_bytes long, resp_bytes long, source_file string, source_line long")
    p = network.EgressParams(min_bytes=1, exfil_score=0.0)
    found = network.detect_egress(conn, p, store=Store(spark, str(tmp_path)))
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 120


def test_values_are_matched_before_they_are_folded(spark, tmp_path):
    pairs = spark.createDataFrame([(f"10.0.0.{i % 4}", f"192.168.0.{i % 9}", 440 + i % 3, 1, float(i), float(i)) for i in range(60)], "src_ip string, dst_ip string, dst_port int, flows long, first_seen double, last_seen double")
    lookups = spark.createDataFrame([("10.0.0.1", "a.example.org", "192.168.0.3", 2, 1.0, 2.0)], "src_ip string, query string, answers string, queries long, first_seen double, last_seen double")
    feed = spark.createDataFrame([("192.168.0.3", "ip"), ("10.0.0.0/31", "cidr"), ("example.org", "domain"), ("10.9.9.9", "ip")], "value string, kind string")
    rows = intel.sightings(pairs, lookups)
    got = intel.matched_sightings(rows, feed, Store(spark, str(tmp_path)))
    expected = intel.folded(rows).join(intel.matches(rows.select("kind", "value").distinct(), feed), ["kind", "value"])
    assert sorted(map(tuple, got.select(*expected.columns).collect())) == sorted(map(tuple, expected.collect())) and got.count() == 4
    assert not hasattr(intel, "matched_observed")
