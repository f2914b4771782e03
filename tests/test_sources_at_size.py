"""What only shows at size: costly parses are made once a row, one large file isn't one task's, addresses run out."""

import duckdb
import pytest

from palisade import catalog
from palisade.sources import text


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def lines(spark, rows):
    return spark.createDataFrame(rows, "line string, source_file string, source_line long")


def test_process_records_are_parsed_once(spark):
    line = '{"EventID": 1, "SourceName": "%s", "Hostname": "h", "hostname": "i", "Image": null, "IMAGE": "a.exe"}' % text.PROVIDER
    parsed = text.parse_processes(lines(spark, [(line, "s", 1)]))
    assert plan(parsed)[0].count("from_json") == 1
    assert [(r.host, r.image) for r in parsed.collect()] == [("h", "a.exe")]


def test_flow_lines_are_cut_once(spark):
    line = "2011-08-10 09:46:53.000\t1.0\tTCP\t10.0.0.1:1025\t->\t9.9.9.9:80\tPA_\t0\t4\t100\t1\tflow=From-Botnet"
    parsed = text.parse_netflow(lines(spark, [(line, "s", 1), (line.replace("2011", "x"), "s", 2)]))
    assert plan(parsed)[0].count("regexp_replace(line") == 1
    assert [(r.src_ip, r.src_port, r.dst_port, r.label) for r in parsed.collect()] == [("10.0.0.1", 1025, 80, "botnet")]


@pytest.mark.parametrize("parse", [text.parse_conn, text.parse_ssl, text.parse_dns])
def test_lines_of_a_file_stay_spread(spark, parse):
    rows = [("#fields\tts\tid.orig_h", "a.log", 0)] + [(f"{k}.5\t10.0.0.{k}", "a.log", k) for k in range(1, 5)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parsed = parse(lines(spark, rows))
        assert "SortMergeJoin" not in plan(parsed)[1]
        assert sorted((r.ts, r.src_ip) for r in parsed.collect()) == [(k + 0.5, f"10.0.0.{k}") for k in range(1, 5)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_assets_beyond_the_last_address_equal_their_sql(spark, tmp_path):
    customers = spark.createDataFrame([(k,) for k in (1, 63998, 64001, 70000, 90001)], "c_custkey long")
    customers.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    for name in ("lineitem", "orders", "events", "pages", "supplier"):
        con.execute(f"create view {name} as select * from read_parquet('/root/testdata/sf0.001/{name}.parquet')")
    con.execute(f"create view customer as select * from read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    want = con.execute(f"select address, hostname, stated, source_line from ({catalog.SRC_ASSET_SQL})").fetchall()
    got = [tuple(r) for r in catalog.src_asset_lines(spark, str(tmp_path)).select("address", "hostname", "stated", "source_line").collect()]
    assert sorted(got, key=lambda r: r[3]) == sorted(want, key=lambda r: r[3])
    assert {r[3] for r in got if r[0] is None} == {64001, 70000, 90001} - {r[3] for r in got if r[3] % 3 == 0}
