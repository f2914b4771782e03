"""Streams against their batch versions: novelty by destination, sketches, late rows over a restart, true line numbers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.operators import intel, ranges
from palisade.sources import text
from palisade.sources.shared import Store
from palisade.streaming import summaries

from .test_detectors import flow, streamed
from .test_telemetry import conn

FIELDS = "ts double, src_ip string, dst_ip string, dst_port int, orig_bytes long, resp_bytes long, signature string"


def batch_novelty(batches, horizon):
    """What each batch finds new, in plain Python; nothing here is old enough to be dropped by a timer before it is asked for."""
    first, last, out = {}, {}, []
    for rows in batches:
        pairs = {}
        for r in rows:
            pairs.setdefault((r["src_ip"], r["dst_ip"]), []).append(r["ts"])
        for (src, _), ts in pairs.items():
            first[src] = min(first.get(src, min(ts)), min(ts))
        for (src, dst), ts in pairs.items():
            if (src, dst) not in last or last[src, dst] < min(ts) - horizon:
                out.append((src, dst, min(ts), min(ts) - first[src]))
            last[src, dst] = max(last.get((src, dst), max(ts)), max(ts))
    return sorted(out)


def test_novelty_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    batches = [[flow(float(1000 * b + int(rng.integers(0, 900))), src=f"s{int(rng.integers(0, 3))}", dst=f"d{int(rng.integers(0, 12))}") for _ in range(40)] for b in range(5)]
    _, got = streamed(spark, tmp_path, batches, lambda s: summaries.novel_destinations(s, horizon=1500.0))
    assert sorted((r.src_ip, r.dst_ip, r.first_seen, r.since_source) for r in got) == batch_novelty(batches, 1500.0)


@pytest.mark.parametrize("parts", [1, 7])
def test_sketches_merge(spark, parts):
    rows = conn(spark, [(float(k * 31 % 90_000), f"10.0.0.{k % 2}", f"9.{k % 2}.{k * 7 % 3000 // 250}.{k * 7 % 3000 % 250}", 443, 1, 1, "f", k) for k in range(20_000)])
    cut = [summaries.fanout_sketches(rows.where(f"source_line % {parts} = {p}")) for p in range(parts)]
    union = cut[0]
    for c in cut[1:]:
        union = union.unionByName(c)
    exact = {r.src_ip: r.n for r in rows.groupBy("src_ip").agg(F.count_distinct("dst_ip").alias("n")).collect()}
    got = summaries.merge_sketches(union).collect()
    assert sum(r.flows for r in got) == 20_000 and all(abs(r.destinations - exact[r.src_ip]) <= 0.03 * exact[r.src_ip] for r in got) and all(n >= 50 for n in exact.values())


def test_sketches_of_a_stream(spark, tmp_path):
    batches = [[flow(float(k), dst=str(k % 200)) for k in range(400)], [flow(3700.0 + k, dst=str(100 + k)) for k in range(200)], [flow(40_000.0)]]
    _, got = streamed(spark, tmp_path, batches, lambda s: summaries.fanout_sketches(s))
    merged = summaries.merge_sketches(spark.createDataFrame(got)).first()
    assert len(got) == 2 and merged.flows == 600 and abs(merged.destinations - 300) <= 9


def test_late_rows_go_to_a_table_once(spark, tmp_path):
    batches = [[flow(1000.0), flow(2000.0)], [flow(1399.0), flow(1400.0), flow(1401.0), flow(5000.0)], [flow(4500.0), flow(100.0)], [flow(4399.0, src="b")]]
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for k, rows in enumerate(batches):  # the query is stopped and started again for each
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
        query = summaries.write_with_late_rows(source, str(tmp_path / "out"), str(tmp_path / "cp"), late=600.0)
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    late, rows = (sorted(r.ts for r in spark.read.parquet(str(tmp_path / "out" / t)).collect()) for t in ("late", "rows"))
    assert late == [100.0, 1399.0, 4399.0]
    assert sorted(late + rows) == sorted(r["ts"] for b in batches for r in b)


def test_dropped_rows_are_counted_over_all_batches(spark, tmp_path):
    counter = summaries.DroppedRows()
    spark.streams.addListener(counter)
    try:
        batches = [[flow(float(k), dst=str(k)) for k in range(60)], [flow(20_000.0)], [flow(5.0), flow(20_001.0)], [flow(40_000.0)], [flow(6.0), flow(7.0, dst="q")]]
        query, _ = streamed(spark, tmp_path, batches, lambda s: summaries.pair_summaries(s))
        for _ in range(50):
            if counter.counts.get(str(query.id), 0) >= 3:
                break
            __import__("time").sleep(0.2)
        assert counter.counts[str(query.id)] == 3
    finally:
        spark.streams.removeListener(counter)


def test_tailed_lines_carry_their_numbers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        for k in range(2):
            (tmp_path / "in" / f"{k}.log").write_text("".join(f"{k} {i} {'x' * (i % 50)}\n" for i in range(1, 801)))
            query = summaries.tail_numbered(spark, str(tmp_path / "in"), lambda lines: lines, str(tmp_path / "out"), str(tmp_path / "cp"))
            try:
                query.processAllAvailable()
            finally:
                query.stop()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 1600 and all(int(r.line.split()[1]) == r.source_line for r in got)


# ---------------------------------------------------------------- address ranges


def feed(spark, values):
    rows = [(v, k) for k, v in enumerate(values)]
    return intel.normalised_indicators(spark.createDataFrame(rows, "value string, source_line long").selectExpr("value", "0.5D confidence", "cast(null as date) added", "'f' source_file", "source_line"))


def test_ranges_equal_prefix_lengths(spark):
    rng = np.random.default_rng(8)
    nets = ["0.0.0.0/0", "10.0.0.0/8", "10.1.0.0/16", "10.1.255.0/24", "10.1.255.255/32", "10.1.255.255", "255.255.255.255/32", "2001:db8::/32", "2001:db8::/33", "2001:db8:ffff:ffff:ffff:ffff:ffff:ffff", "::/0", "fe80::/10"]
    nets += [f"{int(rng.integers(1, 5))}.{int(rng.integers(0, 4))}.{int(rng.integers(0, 256))}.0/{int(rng.integers(1, 33))}" for _ in range(120)]
    seen = [f"{int(rng.integers(0, 6))}.{int(rng.integers(0, 5))}.{int(rng.integers(0, 256))}.{int(rng.integers(0, 256))}" for _ in range(500)]
    seen += ["10.1.255.255", "10.1.255.254", "10.2.0.0", "9.255.255.255", "255.255.255.255", "2001:db8::1", "2001:db8:8000::1", "2001:db9::", "2001:db8:ffff:ffff:ffff:ffff:ffff:ffff", "fe80::1", "febf::9", "fec0::1", "name.example", "", None]
    values, indicators = spark.createDataFrame([(v,) for v in seen], "value string").repartition(3), feed(spark, nets)
    want = {r.value: (r.indicator, r.indicator_kind, r.prefix) for r in intel.match_addresses(values, indicators).collect()}
    for size in (1_000_000, 40):  # few ranges, and many that networks reach across
        got = {r.value: (r.indicator, r.indicator_kind, r.prefix) for r in ranges.match_ranges(values, indicators, rows_of_range=size).collect()}
        assert got == want and len(want) > 400
    assert ranges.match_ranges(values, indicators.limit(0)).count() == ranges.match_ranges(values.limit(0), indicators).count() == 0
    with Store(spark) as store:
        plan = ranges.match_ranges(values, indicators, store=store)._jdf.queryExecution().optimizedPlan().toString()
        assert "lengths" not in plan and "Join" not in plan


def test_elementary_ranges():
    begins, inner = ranges.elementary_ranges([b"4a0", b"4a0", b"4a8", b"4c0"], [b"4af", b"4a7", b"4af", b"4c0"], [4, 8, 8, 12])
    at = lambda key: int(inner[np.searchsorted(begins, np.array([key], begins.dtype), "right")[0] - 1])
    assert [at(k) for k in (b"4a0", b"4a7", b"4a8", b"4af", b"4b0", b"4c0", b"4c1")] == [1, 1, 2, 2, -1, 3, -1]


def test_names_and_many_prefix_lengths(spark):
    """Look-ups are enriched by zones, and a feed of many lengths is matched in ranges."""
    f = feed(spark, ["evil.example", *[f"10.{k}.0.0/{8 + k}" for k in range(8, 20)]])
    rows = spark.createDataFrame([(1.0, "h", "a.evil.example"), (2.0, "h", "other.example")], "ts double, src_ip string, query string")
    assert {r.query: r.indicator for r in summaries.enrich(rows, f).collect()} == {"a.evil.example": "evil.example", "other.example": None}
    values = spark.createDataFrame([("ip", "10.9.1.1"), ("ip", "11.0.0.1"), ("domain", "x.evil.example")], "kind string, value string")
    assert {(r.value, r.indicator) for r in intel.matches(values, f).collect()} == {("10.9.1.1", "10.9.0.0/17"), ("x.evil.example", "evil.example")}


def test_header_lines_of_entry_files(spark):
    lines = spark.createDataFrame([("#  Name :  feed: one ", 1), ("# a remark", 2), ("# 9: no key", 3), ("#updated:2024-01-02", 4), ("# empty:", 5), ("10.0.0.1", 6), ("# name: late", 7)], "line string, source_line long").withColumn("source_file", F.lit("x.ioc"))
    (row,) = text.parse_indicators(lines).collect()
    assert (row.feed, str(row.added), row.value) == ("feed: one", "2024-01-02", "10.0.0.1")
