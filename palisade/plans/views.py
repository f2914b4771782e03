"""Telemetry tables projected from the given star-schema tables, and the same projections as SQL for comparison.

``VIEWS_SQL`` is a chain of common table expressions that DuckDB runs; each DataFrame function below yields the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _orders_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def _flow(dense: bool) -> list[Column]:
    """One connection of an order line, between many hosts or few."""
    cust, supp = F.col("o_custkey"), F.col("l_suppkey")
    src = _text("10.2.0.", cust % 50) if dense else _text("10.1.", F.floor(cust / 250), ".", cust % 250)
    dst = _text("192.168.9.", supp % 20) if dense else _text("192.168.", F.floor(supp / 250), ".", supp % 250)
    return [
        (S.epoch(F.col("l_shipdate")) + F.col("l_orderkey") % 86400).alias("ts"), src.alias("src_ip"), dst.alias("dst_ip"), (F.lit(443) if dense else 440 + F.col("l_linenumber")).cast("int").alias("dst_port"),
        F.floor("l_extendedprice").cast("long").alias("orig_bytes"), F.when(F.col("l_returnflag") != "N", F.floor(F.col("l_quantity") * 100).cast("long")).alias("resp_bytes"),
        F.lit("lineitem").alias("source_file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("source_line"),
    ]


def connections(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    return _orders_lines(spark, sf_dir).select(*_flow(dense))


def both_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order line the connection between many hosts and the one between few, side by side: to be stored, as a join is behind them."""
    dense = [c.alias(f"dense_{name}") for c, name in zip(_flow(True)[1:4], ("src_ip", "dst_ip", "dst_port"))]
    return _orders_lines(spark, sf_dir).select(*_flow(False), *dense)


def all_connections(flows: DataFrame) -> DataFrame:
    """Those between many hosts and those between few, of stored ``both_flows``."""
    usual, dense = (flows.select("ts", *[F.col(f"{kind}{c}").alias(c) for c in ("src_ip", "dst_ip", "dst_port")], "orig_bytes", "resp_bytes", "source_file", "source_line") for kind in ("", "dense_"))
    return usual.unionByName(dense)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What alerts, processes and sessions are made of; they take it stored, too, so that it is parsed once."""
    return read(spark, sf_dir, "events").select("event_id", S.epoch(F.col("ts")).alias("ts"), "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))


_SEVERITY = {"error": 1, "purchase": 2, "signup": 3, "click": 1}
_CATEGORY = {"error": "A Network Trojan was detected", "purchase": "Potential Corporate Privacy Violation", "signup": "Not Suspicious Traffic", "view": "Attempted Administrator Privilege Gain"}
_SIGNATURE_ID = {"error": 1000, "purchase": 2000, "signup": 3000, "view": 4000}


def alerts(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    e = _events(spark, sf_dir) if events is None else events
    host, kind = F.col("user_id") % 20, F.col("event_type")
    variant = (host * 3 + F.col("k") % 5) % 23
    return e.select("ts", _text("10.3.0.", host).alias("src_ip"), F.when(F.col("k") % 7 != 0, _text("10.9.0.", F.col("k") % 20)).alias("dst_ip"), _text(kind, " rule ", variant).alias("signature"), (S.mapped(kind, _SIGNATURE_ID) + variant).cast("long").alias("signature_id"), S.mapped(kind, _CATEGORY).alias("category"), S.mapped(kind, _SEVERITY).alias("severity"), F.lit("events").alias("source_file"), F.col("event_id").cast("long").alias("source_line"))


def processes(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    e, kind = _events(spark, sf_dir) if events is None else events, F.col("event_type")
    host = F.col("user_id") % 40
    image = (
        F.when(kind == "error", _text("C:\\Users\\u\\AppData\\Temp\\t", host * 3 + F.col("k") % 3, ".exe"))
        .when(kind == "view", F.lit("C:\\Windows\\System32\\svchost.exe")).when(kind == "click", _text("C:/Program Files/app/a", F.col("k") % 3, ".exe")).when(kind == "purchase", F.lit("C:\\Windows\\Explorer.EXE"))
    )
    return e.select("ts", _text("h", host).alias("host"), image.alias("image"), F.when(F.col("k") % 11 != 0, _text("C:\\Windows\\p", F.col("k") % 10 + host % 4 * 7, ".exe")).alias("parent_image"), F.col("event_id").cast("string").alias("process_guid"), (F.col("event_id") - 1 - F.col("k") % 50).cast("string").alias("parent_guid"), F.lit("events").alias("source_file"), F.col("event_id").cast("long").alias("source_line"))


def ssl(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    e, kind = _events(spark, sf_dir) if events is None else events, F.col("event_type")
    ja3 = F.when(kind == "signup", None).when(kind.isin("view", "click"), F.md5(F.lit("common"))).otherwise(F.md5(_text(F.col("user_id") % 75, "-", kind).cast("binary")))
    return e.select("ts", _text("10.5.0.", F.col("user_id")).alias("src_ip"), _text("172.16.0.", F.col("k") % 9).alias("dst_ip"), ja3.alias("ja3"), F.lit("events").alias("source_file"), F.col("event_id").cast("long").alias("source_line"))


def dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names below each page's site; a code for two of three; up to two answers."""
    page = F.col("page_id")
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    sub = F.left(F.md5(page.cast("string").cast("binary")), (8 + page % 20).cast("int"))
    return read(spark, sf_dir, "pages").where(host != "").select(
        (page * 10.0).alias("ts"), _text("10.4.0.", page % 2).alias("src_ip"), _text(sub, ".", host).alias("query"), F.when(page % 4 == 0, "TXT").otherwise("A").alias("qtype"),
        F.when(page % 3 == 0, "NXDOMAIN").when(page % 7 != 0, "NOERROR").alias("rcode"), F.when(page % 5 != 0, _text("192.168.0.", page % 40, ";192.168.1.", page % 90)).alias("answers"), F.lit("pages").alias("source_file"), page.cast("long").alias("source_line"),
    )


def generated_dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered names without meaning below three suffixes."""
    page = F.col("page_id")
    name = _text(F.left(F.md5(page.cast("string").cast("binary")), F.lit(12)), F.when(page % 3 == 0, ".com").when(page % 3 == 1, ".net").otherwise(".org"))
    return read(spark, sf_dir, "pages").select((page * 10.0).alias("ts"), _text("10.4.0.", page % 2).alias("src_ip"), name.alias("query"), F.when(page % 5 < 4, "NXDOMAIN").when(page % 7 != 0, "NOERROR").alias("rcode"), F.lit("pages").alias("source_file"), page.cast("long").alias("source_line"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English words, to fit the bigram model on."""
    docs = read(spark, sf_dir, "documents").where("lang = 'en' and text is not null")
    return docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("word"))


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed of addresses, networks and zones made of the suppliers."""
    s = F.col("s_suppkey")
    value = F.when(s % 3 == 0, _text("192.168.0.", s % 250)).when(s % 3 == 1, _text("192.168.", s % 2, ".", s % 8 * 32, "/27")).otherwise(F.element_at(F.array(F.lit("example.org"), F.lit("example.net"), F.lit("m.example.com"), F.lit("blog.ththan.example.net")), (s % 4 + 1).cast("int")))
    return read(spark, sf_dir, "supplier").select(value.alias("value"), F.when(s % 4 != 0, (50 + s % 50) / 100).alias("confidence"), F.when(s % 5 != 0, F.date_add(F.lit("1969-06-01").cast("date"), (s % 200).cast("int"))).alias("added"), F.lit("supplier").alias("source_file"), s.cast("long").alias("source_line"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return read(spark, sf_dir, "customer").where(c % 3 != 0).select(_text("10.1.", F.floor(c / 250), ".", c % 250).alias("address"), _text("host-", c).alias("hostname"), F.when(c % 4 != 0, F.date_add(F.lit("1993-06-01").cast("date"), (c % 900).cast("int"))).alias("stated"), F.lit("customer").alias("source_file"), c.cast("long").alias("source_line"))


def _case(column: str, values: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + " END"


VIEWS_SQL = f"""
ol AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
connections AS (SELECT epoch(l_shipdate) + l_orderkey % 86400 AS ts, '10.1.' || (o_custkey // 250) || '.' || (o_custkey % 250) AS src_ip, '192.168.' || (l_suppkey // 250) || '.' || (l_suppkey % 250) AS dst_ip, 440 + l_linenumber AS dst_port,
  CAST(floor(l_extendedprice) AS BIGINT) AS orig_bytes, CASE WHEN l_returnflag <> 'N' THEN CAST(floor(l_quantity * 100) AS BIGINT) END AS resp_bytes FROM ol),
dense AS (SELECT epoch(l_shipdate) + l_orderkey % 86400 AS ts, '10.2.0.' || (o_custkey % 50) AS src_ip, '192.168.9.' || (l_suppkey % 20) AS dst_ip, 443 AS dst_port,
  CAST(floor(l_extendedprice) AS BIGINT) AS orig_bytes, CASE WHEN l_returnflag <> 'N' THEN CAST(floor(l_quantity * 100) AS BIGINT) END AS resp_bytes FROM ol),
ev AS (SELECT event_id, epoch(ts) AS ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
al AS (SELECT *, user_id % 20 AS h, ((user_id % 20) * 3 + k % 5) % 23 AS v FROM ev),
alerts AS (SELECT ts, '10.3.0.' || h AS src_ip, CASE WHEN k % 7 <> 0 THEN '10.9.0.' || (k % 20) END AS dst_ip, event_type || ' rule ' || v AS signature, {_case('event_type', _SIGNATURE_ID)} + v AS signature_id,
  {_case('event_type', _CATEGORY)} AS category, {_case('event_type', _SEVERITY)} AS severity, event_id AS source_line FROM al),
pr AS (SELECT *, user_id % 40 AS h FROM ev),
processes AS (SELECT ts, 'h' || h AS host, CASE event_type WHEN 'error' THEN 'C:\\Users\\u\\AppData\\Temp\\t' || (h * 3 + k % 3) || '.exe' WHEN 'view' THEN 'C:\\Windows\\System32\\svchost.exe' WHEN 'click' THEN 'C:/Program Files/app/a' || (k % 3) || '.exe' WHEN 'purchase' THEN 'C:\\Windows\\Explorer.EXE' END AS image,
  CASE WHEN k % 11 <> 0 THEN 'C:\\Windows\\p' || (k % 10 + h % 4 * 7) || '.exe' END AS parent_image, CAST(event_id AS VARCHAR) AS process_guid, CAST(event_id - 1 - k % 50 AS VARCHAR) AS parent_guid FROM pr),
ssl AS (SELECT ts, '10.5.0.' || user_id AS src_ip, '172.16.0.' || (k % 9) AS dst_ip, CASE WHEN event_type = 'signup' THEN NULL WHEN event_type IN ('view', 'click') THEN md5('common') ELSE md5((user_id % 75) || '-' || event_type) END AS ja3 FROM ev),
pg AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages),
dns AS (SELECT page_id * 10.0 AS ts, '10.4.0.' || (page_id % 2) AS src_ip, left(md5(CAST(page_id AS VARCHAR)), 8 + page_id % 20) || '.' || host AS query, CASE WHEN page_id % 4 = 0 THEN 'TXT' ELSE 'A' END AS qtype,
  CASE WHEN page_id % 3 = 0 THEN 'NXDOMAIN' WHEN page_id % 7 <> 0 THEN 'NOERROR' END AS rcode, CASE WHEN page_id % 5 <> 0 THEN '192.168.0.' || (page_id % 40) || ';192.168.1.' || (page_id % 90) END AS answers FROM pg WHERE host <> ''),
gdns AS (SELECT page_id * 10.0 AS ts, '10.4.0.' || (page_id % 2) AS src_ip, left(md5(CAST(page_id AS VARCHAR)), 12) AS label, CASE page_id % 3 WHEN 0 THEN 'com' WHEN 1 THEN 'net' ELSE 'org' END AS suffix, CASE WHEN page_id % 5 < 4 THEN 'NXDOMAIN' WHEN page_id % 7 <> 0 THEN 'NOERROR' END AS rcode FROM pages),
indicators AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN '192.168.0.' || (s_suppkey % 250) WHEN 1 THEN '192.168.' || (s_suppkey % 2) || '.' || (s_suppkey % 8 * 32) || '/27' ELSE ['example.org', 'example.net', 'm.example.com', 'blog.ththan.example.net'][s_suppkey % 4 + 1] END AS value,
  CASE s_suppkey % 3 WHEN 0 THEN 'ip' WHEN 1 THEN 'cidr' ELSE 'domain' END AS kind, CASE WHEN s_suppkey % 4 <> 0 THEN (50 + s_suppkey % 50) / 100 END AS confidence, CASE WHEN s_suppkey % 5 <> 0 THEN DATE '1969-06-01' + CAST(s_suppkey % 200 AS INTEGER) END AS added, s_suppkey AS line FROM supplier),
assets AS (SELECT '10.1.' || (c_custkey // 250) || '.' || (c_custkey % 250) AS address, 'host-' || c_custkey AS hostname, CASE WHEN c_custkey % 4 <> 0 THEN DATE '1993-06-01' + CAST(c_custkey % 900 AS INTEGER) END AS stated, c_custkey AS line FROM customer WHERE c_custkey % 3 <> 0)
"""
