"""The run over all detectors at size: tables are joined, parsed and sorted no more often than it takes."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.operators import host, intel, network, selection
from palisade.plans import detectors, views
from palisade.sources.shared import Store

from .test_shared_run import PARAMS, Watched, bursts, capture, conn

SF = os.environ.get("SMOKE_SF_DIR", "/root/testdata/sf0.001")


def test_pair_totals_of_a_run_are_hashed(spark):
    """A first place in each pair's totals made Spark sort all rows by pair, before and after the shuffle."""
    store = Watched(spark)
    s = detectors.summarised(capture(spark), store)
    assert "HashAggregate" in store.plans["pairs"] and "SortAggregate" not in store.plans["pairs"]
    registry = detectors.registry(**PARAMS, egress=network.EgressParams(min_bytes=1, exfil_score=0.0))
    found = {d.name: d.detect(s).where("predicate <> 'shares_infrastructure_with'").select(F.col("evidence")[0]["artifact"].alias("a")).collect() for d in registry if d.name in ("fanout", "egress", "intel")}
    assert all(found.values()) and all(r.a.source_file == "f" for name in ("fanout", "egress") for r in found[name])


def test_connections_of_the_caller_are_not_stored_again(spark):
    t, store = capture(spark), Watched(spark)
    assert detectors.summarised(detectors.replace(t, rows=t.connections), store).rows is t.connections and "connections" not in store.plans
    assert detectors.summarised(t, store).rows is not t.connections and "connections" in store.plans


def test_first_places_of_matches(spark):
    """Of either end of a connection and of look-ups the earliest; as kept with each value's totals before."""
    t = capture(spark)
    found = [intel.detect_intel(t.connections, t.dns, t.indicators, m, matched).select("subject", "score", F.col("evidence")[0]["artifact"].alias("a")).collect() for m, matched in [(intel.IntelParams(), None)]]
    s = detectors.summarised(t, Store(spark))
    late = intel.detect_intel(s.rows, s.dns, s.indicators, intel.IntelParams(), s.matched, s.store, s.lookups).select("subject", "score", F.col("evidence")[0]["artifact"].alias("a")).collect()
    assert "first_at" not in s.matched.columns and sorted(map(str, late)) == sorted(map(str, found[0])) and len(late) >= 2


def test_both_flows_are_one_join(spark):
    flows = views.both_flows(spark, SF)
    assert flows._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
    stored = Store(spark).put(flows, "flows")
    both = views.all_connections(stored)
    assert "Join" not in both._jdf.queryExecution().optimizedPlan().toString()
    want = views.connections(spark, SF).unionByName(views.connections(spark, SF, dense=True))
    assert both.schema.names == want.schema.names and both.count() == want.count()
    assert both.exceptAll(want).isEmpty()


def test_series_are_told_by_number(spark):
    """Series were sorted, stored and joined by two addresses and a port; a NULL port is a pair of its own still."""
    store = Watched(spark)
    found = network.score_beacons(conn(spark, bursts()), network.BeaconParams(min_score=0.0), store).select(*network.PAIR).collect()
    assert "hashpartitioning(pair" in store.plans["series"] and "hashpartitioning(src_ip" not in store.plans["series"]
    assert {tuple(r) for r in found} == {("10.0.0.1", "9.9.9.9", 443), ("10.0.0.2", "9.9.9.9", None), ("10.0.0.3", "9.9.9.9", 80)}


@pytest.mark.parametrize("held", [0, 40, 100_000])
@pytest.mark.parametrize("rounds", [1, 2])
def test_cells_with_many_values_are_cut_finer(spark, held, rounds):
    rng = np.random.default_rng(8)
    values = {"wide": rng.uniform(1000, 1001, 500), "near": 1 + rng.integers(0, 9, 300) * 2.0**-52, "few": rng.lognormal(0, 3, 60), "one": np.array([4.0])}
    df = Store(spark).put(spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "src string, v double"))
    got = {r.src: r for r in selection.sifted_quantiles(df, ["src"], {"low": 0.25, "median": 0.5, "most": 1.0}, rounds, held=held).collect()}
    for k, vs in values.items():
        assert [got[k].n, got[k].low, got[k].median, got[k].most] == [len(vs), *(pytest.approx(np.quantile(vs, q), rel=1e-15) for q in (0.25, 0.5, 1.0))]


def test_nothing_is_read_for_small_groups_where_there_are_none(spark):
    """All groups being large, rows were read again for those that aren't, and cells were counted again to look inside."""
    df = Store(spark).put(spark.createDataFrame([(f"s{k % 3}", float(k)) for k in range(90)], "src string, x double"), "rows")
    found = selection.group_quantiles(df, ["src"], "x", {"median": 0.5}, most=10)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "LeftAnti" not in plan
    assert sorted((r.src, r.n, r["median"]) for r in found.collect()) == [("s0", 30, 43.5), ("s1", 30, 44.5), ("s2", 30, 45.5)]


def test_paths_are_counted_before_they_are_taken_apart(spark):
    rows = [(float(9 - k), "h1", image, parent, "f", k) for k, (image, parent) in enumerate([("C:\\Temp\\A.exe", "C:\\p.exe"), ("c:/temp/a.EXE", "C:/P.exe"), ("C:\\Windows\\a.exe", "p.exe"), ("C:\\Windows\\", "p.exe"), (None, "p.exe"), ("b.exe", None)])]
    triples = host.process_triples(spark.createDataFrame(rows, "ts double, host string, image string, parent_image string, source_file string, source_line long"))
    assert "image#" in triples._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[-1].split("]")[0]  # the inner grouping is by path
    got = {(r.parent_name, r.image_name): (r.n, r.first_seen, r.last_seen, tuple(r.artifact)) for r in triples.collect()}
    assert got == {("p.exe", "a.exe"): (3, 7.0, 9.0, ("f", 2)), (None, "b.exe"): (1, 4.0, 4.0, ("f", 5))}
