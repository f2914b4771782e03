"""Registered queries against their SQL in DuckDB on the smallest given tables."""

import math
import os
from collections import Counter

import pytest

import __spark_entry__ as entry
from palisade import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["det_fanout", "det_alerts", "det_tls", "det_egress", "det_dnstunnel", "det_rare_process", "det_lineage", "host_baseline", "process_ancestry", "intel_indicators", "det_intel", "beacon_gaps", "fn_names", "fn_addresses", "eval_truth", "src_conn_lines", "src_process_lines", "hunt_names", "hunt_incremental", "incident_briefs"]


def shown(v):
    return ("nan" if math.isnan(v) else f"{v:.9g}") if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con():
    import duckdb

    if not os.path.isdir(DATA):
        pytest.skip("the given tables aren't here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(map(shown, r)) for r in df.select(*cols).collect())
    want = Counter(tuple(map(shown, r)) for r in con.sql(f"select {', '.join(f'{chr(34)}{c}{chr(34)}' for c in cols)} from ({catalog.ORACLE_SQL[name]})").fetchall())
    assert got == want


def test_entry_and_registers(spark, con):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entry.entry(spark).columns) >= {"src_ip", "dst_port", "score"}


def test_labelled_pairs_and_claims_are_read_from_files(spark):
    """The evaluation reads both several times: each reading joined and scored the connections again."""
    from palisade import catalog
    from palisade.operators import network
    from palisade.sources.shared import Store

    rows = [(float(i), f"10.1.0.{i % 5}", f"192.168.0.{i % 7}", 443, 200_000, 10) for i in range(60)]
    connections = spark.createDataFrame(rows, "ts double, src_ip string, dst_ip string, dst_port int, orig_bytes long, resp_bytes long")
    claims, pairs = catalog._labelled(network.pair_totals(connections), Store(spark))
    for stored in (claims, pairs):
        assert "Exchange" not in stored._jdf.queryExecution().toString()
    assert {tuple(r) for r in pairs.collect()} == {(r[1], r[2]) for r in rows if (int(r[1].split(".")[3]) + int(r[2].split(".")[3])) % 7 == 0}
