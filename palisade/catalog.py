"""Registered queries of the telemetry library and their SQL counterparts.

Each query projects a telemetry view from the given tables and runs one operator over the whole of it. Thresholds that are set
here suit the views; a detector's limits (top findings) are its feature.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import host, intel, names, network, ranges
from .operators.findings import check_grammar, with_finding_id
from .plans import detectors, incidents, readiness, views
from .plans.history import History
from .sources import text
from .sources.shared import Store, shared_folder
from .streaming import summaries

W = views.VIEWS_SQL


def _r(*cols: str) -> list:
    return [F.round(F.col(c).cast("double"), 4).alias(c) for c in cols]


def _rs(*cols: str) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), 4) AS {c}" for c in cols)


def _gm(parts: dict[str, float]) -> str:
    """SQL of the weighted geometric mean over measured parts."""
    top = " + ".join(f"CASE WHEN {p} IS NULL THEN 0 ELSE {w} * ln(greatest({p}, 0.01)) END" for p, w in parts.items())
    under = " + ".join(f"CASE WHEN {p} IS NULL THEN 0 ELSE {w} END" for p, w in parts.items())
    return f"least(1.0, greatest(0.0, exp(({top}) / nullif({under}, 0))))"


def _ramp(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(1.0, greatest(0.0, (({x}) - {lo}) / ({hi} - {lo}))) END"


def _sat(x: str, t: float) -> str:
    return f"(1 - exp(-greatest({x}, 0) / {t}))"


# ---------------------------------------------------------------- fan-out

FANOUT = network.FanoutParams(min_destinations=5, min_score=0.1)


def det_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.score_fanouts(views.connections(spark, sf_dir), FANOUT).select("src_ip", "dst_port", "destinations", "flows", *_r("first_seen", "last_seen", "breadth", "non_revisiting", "score"))


FANOUT_SQL = f"""
WITH {W}, g AS (SELECT src_ip, dst_port, count(DISTINCT dst_ip) AS destinations, count(*) AS flows, min(ts) AS first_seen, max(ts) AS last_seen FROM connections WHERE dst_port NOT IN (53, 123) GROUP BY ALL HAVING count(DISTINCT dst_ip) >= 5),
p AS (SELECT *, {_sat('destinations', 250)} AS breadth, 1 - least(1.0, greatest(0.0, flows / destinations - 1) / 12) AS non_revisiting FROM g),
s AS (SELECT *, {_gm({'breadth': 0.55, 'non_revisiting': 0.45})} AS score FROM p)
SELECT src_ip, dst_port, destinations, flows, {_rs('first_seen', 'last_seen', 'breadth', 'non_revisiting', 'score')} FROM (SELECT * FROM s WHERE score >= 0.1 ORDER BY score DESC, src_ip, dst_port LIMIT 200)
"""

# ---------------------------------------------------------------- alerts

ALERTS = network.AlertParams(min_score=0.2)


def det_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.score_alerts(views.alerts(spark, sf_dir), ALERTS).select("src_ip", "signature", "alerts", "hosts", "targets", *_r("signature_rarity", "stated_severity", "category_weight", "score"))


_WEIGHTS_SQL = "CASE WHEN category IS NULL THEN 0.4 " + " ".join(f"WHEN contains(lower(category), '{f}') THEN {w}" for f, w in S.CATEGORY_WEIGHTS) + " ELSE 0.4 END"
ALERTS_SQL = f"""
WITH {W}, c AS (SELECT src_ip, signature, count(*) AS alerts, arg_min(signature_id, (ts, source_line)) AS signature_id, arg_min(category, (ts, source_line)) AS category, min(severity) AS stated,
  count(DISTINCT dst_ip) + max(CAST(dst_ip IS NULL AS INTEGER)) AS targets, min(ts) AS first_seen FROM alerts GROUP BY ALL),
h AS (SELECT signature_id, count(DISTINCT src_ip) AS hosts FROM c WHERE signature_id IS NOT NULL GROUP BY 1),
j AS (SELECT c.*, coalesce(h.hosts, 1) AS hosts FROM c LEFT JOIN h USING (signature_id) WHERE alerts >= 3),
p AS (SELECT *, CASE WHEN hosts >= 50 THEN least(1 / sqrt(hosts), 0.05) ELSE 1 / sqrt(hosts) END AS signature_rarity, CASE stated WHEN 1 THEN 1.0 WHEN 2 THEN 0.6 WHEN 3 THEN 0.3 ELSE 0.4 END AS stated_severity, {_WEIGHTS_SQL} AS category_weight FROM j),
s AS (SELECT *, {_gm({'signature_rarity': 0.45, 'stated_severity': 0.30, 'category_weight': 0.25})} AS score FROM p)
SELECT src_ip, signature, alerts, hosts, targets, {_rs('signature_rarity', 'stated_severity', 'category_weight', 'score')} FROM (SELECT * FROM s WHERE score >= 0.2 ORDER BY score DESC, alerts DESC, src_ip, signature LIMIT 200)
"""

# ---------------------------------------------------------------- TLS

TLS = names.TlsParams(top=1000)


def det_tls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.score_fingerprints(views.ssl(spark, sf_dir), TLS).select("src_ip", "ja3", "sessions", "servers", "hosts", "estate", *_r("fingerprint_rarity", "estate_support", "score"))


TLS_SQL = f"""
WITH {W}, e AS (SELECT count(DISTINCT src_ip) AS estate FROM ssl),
g AS (SELECT src_ip, ja3, count(*) AS sessions, count(DISTINCT dst_ip) AS servers, min(ts) AS first_seen FROM ssl WHERE trim(ja3) <> '' GROUP BY ALL),
h AS (SELECT ja3, count(*) AS hosts FROM g GROUP BY 1 HAVING count(*) <= 2),
p AS (SELECT *, 1 / sqrt(hosts) AS fingerprint_rarity, {_sat('estate', 50)} AS estate_support FROM g JOIN h USING (ja3), e WHERE sessions >= 3 AND estate >= 10),
s AS (SELECT *, {_gm({'fingerprint_rarity': 0.65, 'estate_support': 0.35})} AS score FROM p)
SELECT src_ip, ja3, sessions, servers, hosts, estate, {_rs('fingerprint_rarity', 'estate_support', 'score')} FROM (SELECT * FROM s WHERE score >= 0.7 ORDER BY score DESC, src_ip, ja3 LIMIT 1000)
"""

# ---------------------------------------------------------------- egress

EGRESS = network.EgressParams(min_bytes=100_000, rare_bytes=20_000, rare_flows=1, rare_hosts=600, exfil_score=0.25, volume_score=0.2, top=400, top_rare=100)


def det_egress(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = network.strongest_claims(network.score_egress(views.connections(spark, sf_dir), EGRESS), EGRESS)
    return scored.select("src_ip", "dst_ip", "claim", "flows", "bytes_out", "hosts", "peers", *_r("egress_ratio", "volume_deviation", "destination_rarity", "novelty", "score"))


EGRESS_SQL = f"""
WITH {W}, q AS (SELECT src_ip, dst_ip, count(*) AS flows, CAST(sum(orig_bytes) AS BIGINT) AS bytes_out, count(orig_bytes) AS measured, count(resp_bytes) AS both_flows, sum(orig_bytes) FILTER (resp_bytes IS NOT NULL) AS both_out, sum(resp_bytes) AS both_in, min(ts) AS first_seen, max(ts) AS last_seen FROM connections GROUP BY ALL HAVING count(orig_bytes) > 0),
d AS (SELECT dst_ip, count(*) AS hosts FROM q GROUP BY 1),
m AS (SELECT src_ip, count(*) AS peers, median(bytes_out) AS med, min(first_seen) AS hf, max(last_seen) AS hl FROM q GROUP BY 1),
a AS (SELECT src_ip, median(abs(bytes_out - med)) AS mad FROM q JOIN m USING (src_ip) GROUP BY 1),
j AS (SELECT *, CASE WHEN peers >= 5 AND mad > 0 THEN (bytes_out - med) / (1.4826 * mad) END AS z FROM q JOIN d USING (dst_ip) JOIN m USING (src_ip) JOIN a USING (src_ip)),
p AS (SELECT *, CASE WHEN both_flows / flows >= 0.5 THEN {_ramp('both_out / nullif(both_out + both_in, 0)', 0.5, 0.9)} END AS egress_ratio, CASE WHEN z IS NOT NULL THEN {_sat('z', 3.5)} END AS volume_deviation, 1 / sqrt(hosts) AS destination_rarity, CASE WHEN hl - hf >= 3600 THEN (first_seen - hf) / (hl - hf) END AS novelty FROM j),
s AS (SELECT *, {_gm({'egress_ratio': 0.30, 'volume_deviation': 0.28, 'destination_rarity': 0.24, 'novelty': 0.18})} AS score FROM p),
c AS (SELECT *, CASE WHEN bytes_out >= 100000 AND egress_ratio IS NOT NULL AND score >= 0.25 THEN 'exfiltrates_to' WHEN bytes_out >= 100000 AND volume_deviation >= 0.5 AND score >= 0.2 THEN 'transfers_anomalous_volume' WHEN bytes_out >= 20000 AND flows >= 1 AND hosts <= 600 AND score >= 0.3 THEN 'contacts_rare_destination' END AS claim FROM s),
b AS (SELECT *, CASE claim WHEN 'exfiltrates_to' THEN 3 WHEN 'transfers_anomalous_volume' THEN 2 ELSE 1 END AS band FROM c WHERE claim IS NOT NULL),
k AS (SELECT * FROM b QUALIFY band = max(band) OVER (PARTITION BY src_ip)),
o AS ((SELECT * FROM k WHERE band > 1 ORDER BY band DESC, score DESC, src_ip, dst_ip LIMIT 400) UNION ALL (SELECT * FROM k WHERE band = 1 ORDER BY score DESC, src_ip, dst_ip LIMIT 100))
SELECT src_ip, dst_ip, claim, flows, bytes_out, hosts, peers, {_rs('egress_ratio', 'volume_deviation', 'destination_rarity', 'novelty', 'score')} FROM o
"""

# ---------------------------------------------------------------- DNS

TUNNEL = names.TunnelParams(min_queries=20, min_distinct=10, min_score=0.1)


def det_dnstunnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.score_tunnels(views.dns(spark, sf_dir), TUNNEL).select("src_ip", "zone", "queries", "distinct_names", *_r("label_entropy", "subdomain_cardinality", "query_length", "qtype_skew", "score"))


_ZONE = "array_to_string(list_slice(string_split(query, '.'), -2, -1), '.')"
TUNNEL_SQL = f"""
WITH {W}, r AS (SELECT src_ip, ts, {_ZONE} AS zone, replace(left(query, length(query) - length({_ZONE})), '.', '') AS sub, qtype IN ('TXT', 'NULL', 'CNAME', 'MX', 'SRV', '10', '16') AS high FROM dns),
u AS (SELECT src_ip, zone, sub, count(*) AS queries, count(*) FILTER (high) AS high FROM r GROUP BY ALL),
n AS (SELECT *, CASE WHEN length(sub) >= 8 THEN (SELECT entropy(x) FROM (SELECT unnest(string_split(sub, '')) AS x)) END AS h, CASE WHEN length(sub) >= 8 THEN length(sub) END AS len FROM u),
g AS (SELECT src_ip, zone, CAST(sum(queries) AS BIGINT) AS queries, sum(high) AS high, count(len) AS distinct_names, avg(h) AS mh, avg(len) AS ml FROM n GROUP BY ALL HAVING sum(queries) >= 20 AND count(len) >= 10),
p AS (SELECT *, {_ramp('mh', 3.2, 4.6)} AS label_entropy, {_sat('distinct_names', 200)} AS subdomain_cardinality, {_sat('ml', 40)} AS query_length, CASE WHEN high > 0 THEN least(1.0, 2 * high / queries) END AS qtype_skew FROM g),
s AS (SELECT *, {_gm({'label_entropy': 0.40, 'subdomain_cardinality': 0.25, 'query_length': 0.25, 'qtype_skew': 0.10})} AS score FROM p)
SELECT src_ip, zone, queries, distinct_names, {_rs('label_entropy', 'subdomain_cardinality', 'query_length', 'qtype_skew', 'score')} FROM (SELECT * FROM s WHERE score >= 0.1 ORDER BY score DESC, src_ip, zone LIMIT 200)
"""

DGA = names.DgaParams(min_score=0.3, per_family=20, top=1000)


def det_dga(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = names.fit_bigrams(views.words(spark, sf_dir))
    return names.score_domains(views.generated_dns(spark, sf_dir), model, DGA).select("src_ip", "suffix", "label", "labels", "family_queries", "resolved", *_r("nxdomain_rate", "bigram_improbability", "structure", "score"))


def fit_bigram_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.fit_bigrams(views.words(spark, sf_dir)).select("bigram", *_r("surprise", "unseen", "typical"))


_BIGRAMS = """
wd AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents WHERE lang = 'en' AND text IS NOT NULL),
bg AS (SELECT substr(w, i, 2) AS bigram, count(*) AS c FROM wd, unnest(range(1, length(w))) AS t(i) WHERE length(w) >= 2 GROUP BY 1),
tt AS (SELECT sum(c) + 0.5 * 1369 AS d, count(*) AS seen FROM bg),
mo AS (SELECT bigram, -log2((c + 0.5) / d) AS surprise, -((c + 0.5) / d) * log2((c + 0.5) / d) AS part, -log2(0.5 / d) AS unseen, 0.5 / d AS rest, seen FROM bg, tt),
an AS (SELECT sum(part) + (1369 - max(seen)) * max(rest) * max(unseen) AS typical FROM mo)
"""
BIGRAM_SQL = f"WITH {_BIGRAMS} SELECT bigram, {_rs('surprise', 'unseen', 'typical')} FROM mo, an"
DGA_SQL = f"""
WITH {W}, {_BIGRAMS}, l AS (SELECT src_ip, suffix, label, count(*) AS queries, count(rcode) AS known, count(*) FILTER (rcode = 'NXDOMAIN') AS nx, coalesce(bool_or(rcode <> 'NXDOMAIN'), false) AS resolved FROM gdns GROUP BY ALL),
f AS (SELECT src_ip, suffix, count(*) AS labels, CAST(sum(queries) AS BIGINT) AS family_queries, sum(known) AS fk, sum(nx) AS fn FROM l GROUP BY ALL HAVING count(*) >= 12 AND sum(queries) >= 30),
i AS (SELECT label, avg(coalesce(surprise, (SELECT max(unseen) FROM mo))) AS mean FROM (SELECT DISTINCT label FROM l) x, unnest(range(1, length(label))) AS t(k) LEFT JOIN mo ON mo.bigram = substr(label, k, 2) GROUP BY 1),
p AS (SELECT l.*, labels, family_queries, {_ramp('CASE WHEN fk / family_queries >= 0.5 THEN fn / fk END', 0.10, 0.70)} AS nxdomain_rate, least(1.0, greatest(0.0, (mean - typical) / ((SELECT max(unseen) FROM mo) - typical))) AS bigram_improbability,
  1 - (1 - least(1.0, greatest(0.0, (coalesce(list_max(list_transform(regexp_extract_all(label, '[b-df-hj-np-tv-z]+'), lambda x: length(x))), 0) - 4.0) / 5.0))) * (1 - least(1.0, greatest(0.0, (length(regexp_replace(label, '[^0-9]', '', 'g')) / length(label) - 0.15) / 0.35))) AS structure
  FROM l JOIN f USING (src_ip, suffix) JOIN i USING (label), an),
s AS (SELECT *, {_gm({'nxdomain_rate': 0.34, 'bigram_improbability': 0.56, 'structure': 0.10})} AS score FROM p),
k AS (SELECT * FROM s WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY src_ip, suffix ORDER BY resolved DESC, round(score, 9) DESC, label) <= 20)
SELECT src_ip, suffix, label, labels, family_queries, resolved, {_rs('nxdomain_rate', 'bigram_improbability', 'structure', 'score')} FROM k ORDER BY round(k.score, 9) DESC, src_ip, suffix, label LIMIT 1000
"""

# ---------------------------------------------------------------- host

HOST = host.HostParams(max_singleton_share=1.0, process_score=0.2, lineage_score=0.2, per_host=5, top=200)


def det_rare_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = host.capped(host.score_processes(views.processes(spark, sf_dir), HOST), HOST, "image_name")
    return scored.select("host", "image_name", "executions", "image_hosts", *_r("image_prevalence", "path_anomaly", "execution_prevalence", "score"))


def det_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = host.capped(host.score_lineage(views.processes(spark, sf_dir), HOST), HOST, "parent_name", "image_name")
    return scored.select("host", "parent_name", "image_name", "pair_hosts", "pair_executions", "parent_executions", "parent_hosts", "child_hosts", *_r("parent_breadth", "child_breadth", "child_surprisal", "score"))


def host_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = host.estate_baseline(host.process_triples(views.processes(spark, sf_dir)))
    return base.select("hosts", "executions", "images", "singletons", *_r("span_seconds", "singleton_share"), F.col("gate").isNull().alias("supported"))


def process_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host.ancestry(views.processes(spark, sf_dir)).select("process_guid", F.array_join("chain", ">").alias("chain"), "truncated")


_LOW = "lower(replace({c}, '/', '\\'))"
_NAME = "nullif(regexp_extract(lower(replace({c}, '/', '\\')), '([^\\\\]*)$', 1), '')"


def _within(folders) -> str:
    return " OR ".join(f"contains({_LOW.format(c='image')}, '{f}')" for f in folders)


_TRIPLES = f"""
px AS (SELECT *, {_NAME.format(c='image')} AS image_name, {_NAME.format(c='parent_image')} AS parent_name, CASE WHEN image IS NULL THEN NULL WHEN {_within(S.WRITABLE_FOLDERS)} THEN 1.0 WHEN {_within(S.SYSTEM_FOLDERS)} THEN 0.15 WHEN contains({_LOW.format(c='image')}, '\\windows\\') THEN 0.30 ELSE 0.55 END AS pa FROM processes),
tr AS (SELECT host, parent_name, image_name, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen, max(pa) AS pa FROM px WHERE image_name IS NOT NULL GROUP BY ALL),
ih AS (SELECT image_name, count(DISTINCT host) AS image_hosts FROM tr GROUP BY 1),
rp AS (SELECT host, image_name, CAST(sum(n) AS BIGINT) AS executions, max(pa) AS path_anomaly FROM tr GROUP BY ALL),
rq AS (SELECT *, 1 / sqrt(image_hosts) AS image_prevalence, 1 - {_sat('executions', 8)} AS execution_prevalence FROM rp JOIN ih USING (image_name)),
rs AS (SELECT *, {_gm({'image_prevalence': 0.50, 'path_anomaly': 0.34, 'execution_prevalence': 0.16})} AS score FROM rq),
rare AS (SELECT * FROM rs WHERE score >= 0.2 AND image_hosts <= {host.prevalence_ceiling(HOST)})
"""
PROCESS_SQL = f"""
WITH {W}, {_TRIPLES}, k AS (SELECT * FROM rare QUALIFY row_number() OVER (PARTITION BY host ORDER BY round(score, 9) DESC, image_name) <= 5)
SELECT host, image_name, executions, image_hosts, {_rs('image_prevalence', 'path_anomaly', 'execution_prevalence', 'score')} FROM k ORDER BY round(k.score, 9) DESC, image_name, host LIMIT 200
"""
LINEAGE_SQL = f"""
WITH {W}, {_TRIPLES}, pt AS (SELECT * FROM tr WHERE parent_name IS NOT NULL),
ed AS (SELECT parent_name, image_name, count(DISTINCT host) AS pair_hosts, CAST(sum(n) AS BIGINT) AS pair_executions FROM pt GROUP BY ALL),
ee AS (SELECT *, CAST(sum(pair_executions) OVER (PARTITION BY parent_name) AS BIGINT) AS parent_executions FROM ed),
pn AS (SELECT name, count(DISTINCT host) AS present FROM (SELECT host, image_name AS name FROM tr UNION ALL SELECT host, parent_name FROM tr) WHERE name IS NOT NULL GROUP BY 1),
j AS (SELECT pt.*, pair_hosts, pair_executions, parent_executions, a.present AS parent_hosts, b.present AS child_hosts FROM pt JOIN ee USING (parent_name, image_name) LEFT JOIN pn a ON a.name = parent_name LEFT JOIN pn b ON b.name = image_name),
p AS (SELECT *, CASE WHEN parent_hosts >= 2 THEN 1 - pair_hosts / parent_hosts END AS parent_breadth, CASE WHEN child_hosts >= 2 THEN 1 - pair_hosts / child_hosts END AS child_breadth, CASE WHEN parent_executions >= 20 THEN least(1.0, -log2(pair_executions / parent_executions) / 6) END AS child_surprisal FROM j),
s AS (SELECT *, {_gm({'parent_breadth': 0.38, 'child_breadth': 0.38, 'child_surprisal': 0.24})} AS score FROM p WHERE parent_breadth IS NOT NULL OR child_breadth IS NOT NULL),
f AS (SELECT s.* FROM s WHERE score >= 0.2 AND NOT EXISTS (SELECT 1 FROM rare r WHERE r.host = s.host AND r.image_name = s.image_name)),
k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY host ORDER BY round(score, 9) DESC, parent_name, image_name) <= 5)
SELECT host, parent_name, image_name, pair_hosts, pair_executions, parent_executions, parent_hosts, child_hosts, {_rs('parent_breadth', 'child_breadth', 'child_surprisal', 'score')} FROM k ORDER BY round(k.score, 9) DESC, parent_name, image_name, host LIMIT 200
"""
BASELINE_SQL = f"""
WITH {W}, {_TRIPLES}, a AS (SELECT count(DISTINCT host) AS hosts, CAST(sum(n) AS BIGINT) AS executions, max(last_seen) - min(first_seen) AS span_seconds FROM tr), b AS (SELECT count(*) AS images, count(*) FILTER (image_hosts = 1) AS singletons FROM ih)
SELECT hosts, executions, images, singletons, round(span_seconds, 4) AS span_seconds, round(singletons / images, 4) AS singleton_share, hosts >= 5 AND executions >= 200 AND singletons / images <= 0.5 AS supported FROM a, b
"""
ANCESTRY_SQL = f"""
WITH RECURSIVE {W}, kn AS (SELECT process_guid, {_NAME.format(c='image')} AS name, parent_guid FROM processes),
up AS (SELECT process_guid, [process_guid] AS met, CAST([] AS VARCHAR[]) AS chain, parent_guid AS nxt, 0 AS d FROM kn
  UNION ALL SELECT up.process_guid, list_append(met, nxt), list_append(chain, coalesce(kn.name, '?')), kn.parent_guid, d + 1 FROM up JOIN kn ON kn.process_guid = up.nxt WHERE d < 4 AND NOT list_contains(met, nxt)),
b AS (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY process_guid ORDER BY d DESC) = 1)
SELECT process_guid, array_to_string(chain, '>') AS chain, d = 4 AND nxt IS NOT NULL AND NOT list_contains(met, nxt) AS truncated FROM b
"""

# ---------------------------------------------------------------- intel and assets


INTEL = intel.IntelParams(max_age_days=20_000, half_life_days=9000.0)


def det_intel(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark)
    feed = store.put(intel.normalised_indicators(views.indicators(spark, sf_dir)), "feed")
    matched = intel.matched_values(views.connections(spark, sf_dir), views.dns(spark, sf_dir), feed, store)
    return intel.score_matches(matched, feed, INTEL).select("kind", "value", "indicator", "indicator_kind", "events", "peers", "roles", "age_days", *_r("score"))


def intel_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intel.normalised_indicators(views.indicators(spark, sf_dir)).select("kind", "value", *_r("confidence"), F.date_format("added", "yyyy-MM-dd").alias("added"))


_FEED = "fd AS (SELECT * FROM indicators QUALIFY row_number() OVER (PARTITION BY kind, value ORDER BY confidence DESC NULLS LAST, added DESC NULLS LAST, line) = 1)"
FEED_SQL = f"WITH {W}, {_FEED} SELECT kind, value, round(confidence, 4) AS confidence, strftime(added, '%Y-%m-%d') AS added FROM fd"


def _ipv4(x: str) -> str:
    return f"(CAST(split_part({x}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({x}, '.', 2) AS BIGINT) * 65536 + CAST(split_part({x}, '.', 3) AS BIGINT) * 256 + CAST(split_part({x}, '.', 4) AS BIGINT))"


_OBSERVED = """
an AS (SELECT ts, src_ip, unnest(string_split(answers, ';')) AS answer FROM dns),
ro AS (SELECT 'ip' AS kind, dst_ip AS value, src_ip AS peer, ts, 'destination' AS role FROM connections UNION ALL SELECT 'ip', src_ip, dst_ip, ts, 'source' FROM connections
  UNION ALL SELECT 'domain', query, src_ip, ts, 'query' FROM dns UNION ALL SELECT 'ip', answer, src_ip, ts, 'answer' FROM an),
rg AS (SELECT kind, value, role, count(*) AS events, count(DISTINCT peer) AS peers, min(ts) AS f, max(ts) AS l FROM ro GROUP BY ALL),
ob AS (SELECT kind, value, CAST(sum(events) AS BIGINT) AS events, max(peers) AS peers, min(f) AS first_seen, max(l) AS last_seen, string_agg(role, ',' ORDER BY role) AS roles FROM rg GROUP BY ALL)
"""
_MATCHED = f"""
nt AS (SELECT value, kind, CASE WHEN kind = 'ip' THEN 32 ELSE CAST(split_part(value, '/', 2) AS INTEGER) END AS bits, {_ipv4("split_part(value, '/', 1)")} AS base FROM fd WHERE kind IN ('ip', 'cidr')),
mi AS (SELECT ob.value, nt.value AS indicator, nt.kind AS indicator_kind FROM (SELECT value, {_ipv4('value')} AS num FROM ob WHERE kind = 'ip') ob JOIN nt ON num // (1 << (32 - bits)) = base // (1 << (32 - bits)) QUALIFY row_number() OVER (PARTITION BY ob.value ORDER BY bits DESC, nt.kind = 'ip' DESC) = 1),
md AS (SELECT ob.value, fd.value AS indicator, 'domain' AS indicator_kind FROM ob JOIN fd ON ob.kind = 'domain' AND fd.kind = 'domain' AND (ob.value = fd.value OR ends_with(ob.value, '.' || fd.value)) QUALIFY row_number() OVER (PARTITION BY ob.value ORDER BY length(fd.value) DESC) = 1),
mm AS (SELECT * FROM mi UNION ALL SELECT * FROM md)
"""
INTEL_SQL = f"""
WITH {W}, {_FEED}, {_OBSERVED}, {_MATCHED},
j AS (SELECT ob.*, indicator, indicator_kind, confidence, greatest(date_diff('day', added, CAST(DATE '1970-01-01' + INTERVAL 1 SECOND * first_seen AS DATE)), 0) AS age FROM ob JOIN mm USING (value) JOIN fd ON fd.value = indicator AND fd.kind = indicator_kind),
k AS (SELECT *, CASE WHEN added_null THEN NULL ELSE age END AS age_days FROM (SELECT j.*, (SELECT added IS NULL FROM fd WHERE fd.value = indicator AND fd.kind = indicator_kind) AS added_null FROM j)),
s AS (SELECT *, CASE WHEN age_days IS NULL THEN least(coalesce(confidence, 0.25), 0.35) ELSE coalesce(confidence, 0.25) * pow(0.5, age_days / 9000.0) END AS score FROM k)
SELECT kind, value, indicator, indicator_kind, events, peers, roles, CAST(age_days AS INTEGER) AS age_days, round(score, 4) AS score FROM s WHERE score >= 0.1 AND (age_days IS NULL OR age_days <= 20000)
"""


def asset_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    conn = views.connections(spark, sf_dir)
    window = intel.capture_window(conn, views.dns(spark, sf_dir), views.ssl(spark, sf_dir))
    return intel.coverage(views.assets(spark, sf_dir), intel.capture_window(conn), conn, views.dns(spark, sf_dir), views.ssl(spark, sf_dir)).crossJoin(F.broadcast(window.select("window_start", "window_end"))).select("loaded", "applied", "dropped", "observed", "matched", *_r("fraction", "window_start", "window_end"))


COVERAGE_SQL = f"""
WITH {W}, wi AS (SELECT CAST(DATE '1970-01-01' + INTERVAL 1 SECOND * min(ts) AS DATE) AS s, CAST(DATE '1970-01-01' + INTERVAL 1 SECOND * max(ts) AS DATE) AS e FROM connections),
st AS (SELECT address, stated, CASE WHEN stated IS NULL THEN true WHEN stated > e THEN true ELSE date_diff('day', stated, s) <= 730 END AS applies FROM assets, wi),
sr AS (SELECT src_ip FROM connections UNION SELECT src_ip FROM dns UNION SELECT src_ip FROM ssl),
w2 AS (SELECT min(ts) AS a, max(ts) AS b FROM (SELECT ts FROM connections UNION ALL SELECT ts FROM dns UNION ALL SELECT ts FROM ssl))
SELECT (SELECT count(*) FROM st) AS loaded, (SELECT count(*) FROM st WHERE applies) AS applied, (SELECT count(*) FROM st WHERE NOT applies) AS dropped, (SELECT count(*) FROM sr) AS observed, (SELECT count(*) FROM sr JOIN st ON address = src_ip WHERE applies) AS matched,
  round((SELECT count(*) FROM sr JOIN st ON address = src_ip WHERE applies) / (SELECT count(*) FROM sr), 4) AS fraction, round(a, 4) AS window_start, round(b, 4) AS window_end FROM w2
"""


def shared_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = intel.normalised_indicators(views.indicators(spark, sf_dir))
    dns = views.dns(spark, sf_dir)
    flagged = intel.match_domains(dns.select(F.col("query").alias("value")), feed)
    return intel.shared_resolution(dns, flagged, intel.IntelParams(breadth=(2, 9))).select("anchor", "other", "answer", "breadth", *_r("score"))


RESOLUTION_SQL = f"""
WITH {W}, {_FEED}, an AS (SELECT query AS name, unnest(string_split(answers, ';')) AS answer FROM dns), na AS (SELECT DISTINCT answer, name FROM an),
nb AS (SELECT answer, count(*) AS breadth FROM na GROUP BY 1 HAVING count(*) BETWEEN 2 AND 9),
fl AS (SELECT q.name, fd.value AS indicator FROM (SELECT DISTINCT query AS name FROM dns) q JOIN fd ON fd.kind = 'domain' AND (q.name = fd.value OR ends_with(q.name, '.' || fd.value)) QUALIFY row_number() OVER (PARTITION BY q.name ORDER BY length(fd.value) DESC) = 1),
mk AS (SELECT na.*, breadth, indicator FROM na JOIN nb USING (answer) LEFT JOIN fl USING (name)),
pr2 AS (SELECT a.name AS anchor, b.name AS other, a.answer, a.breadth FROM mk a JOIN mk b USING (answer) WHERE a.indicator IS NOT NULL AND a.name <> b.name AND (b.indicator IS NULL OR (b.indicator <> a.indicator AND a.name < b.name)))
SELECT anchor, other, answer, breadth, round(least(0.95, 2 / breadth), 4) AS score FROM pr2 QUALIFY row_number() OVER (PARTITION BY anchor, other ORDER BY breadth, answer) = 1
"""

# ---------------------------------------------------------------- beaconing


BEACONS = network.BeaconParams(min_score=0.05, period=(1.0, 1e9))


def det_beaconing(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark)
    conn = store.put(views.connections(spark, sf_dir, dense=True).select(*network.PAIR, "ts", "orig_bytes", "source_line"), "connections")  # joined once, read twice
    return network.score_beacons(conn, BEACONS, store).select(*network.PAIR, "checkins", *_r("gap_median", "gap_mad", *network.BEACON_PARTS, "score"))


def _spread_sql(rows: str, value: str, prefix: str) -> str:
    """Count, median, lower quartile and MAD of a value by pair, as common table expressions ``{prefix}q`` and ``{prefix}a``."""
    return f"""{prefix}q AS (SELECT {_P}, count(*) AS {prefix}n, median({value}) AS {prefix}m, quantile_cont({value}, 0.25) AS {prefix}25 FROM {rows} GROUP BY ALL),
{prefix}a AS (SELECT {_P}, median(abs({value} - {prefix}m)) AS {prefix}mad FROM {rows} JOIN {prefix}q USING ({_P}) GROUP BY ALL)"""


def _dispersion_sql(median: str, mad: str) -> str:
    return f"CASE WHEN {median} IS NULL OR abs({median}) < 1e-9 THEN 1.0 ELSE {mad} / abs({median}) END"


_P = "src_ip, dst_ip, dst_port"


def _beacon_sql(table: str) -> str:
    return f"""
WITH {W}, bs AS (SELECT {_P}, count(*) AS flows, min(ts) AS fs, max(ts) AS ls FROM {table} GROUP BY ALL), bh AS (SELECT dst_ip, count(DISTINCT src_ip) AS hosts FROM bs GROUP BY 1),
bc AS (SELECT * FROM bs WHERE flows >= 24 AND ls - fs >= 3600 AND dst_port NOT IN (53, 123)),
br AS (SELECT {_P}, ts, orig_bytes, row_number() OVER w AS rn, ts - lag(ts) OVER w AS gap FROM (SELECT * FROM {table} SEMI JOIN bc USING ({_P})) WINDOW w AS (PARTITION BY {_P} ORDER BY ts)),
bl AS (SELECT {_P}, log10(gap) AS x FROM br WHERE gap > 0),
be AS (SELECT {_P}, count(*) AS n, min(x) AS lo, max(x) AS hi FROM bl GROUP BY ALL HAVING count(*) >= 8 AND max(x) - min(x) >= 1),
bb AS (SELECT {_P}, n, lo, hi, least(63, CAST(floor((x - lo) / ((hi - lo) / 64)) AS INTEGER)) AS bin, count(*) AS c FROM bl JOIN be USING ({_P}) GROUP BY ALL),
bm AS (SELECT *, lo + (bin + 0.5) * ((hi - lo) / 64) AS center FROM bb),
bo AS (SELECT *, sum(c) OVER r / n AS mass, sum(c * center) OVER r / n AS moment, sum(c * center) OVER (PARTITION BY {_P}) / n AS mean FROM bm WINDOW r AS (PARTITION BY {_P} ORDER BY bin)),
bt AS (SELECT {_P}, arg_max(center, (round(spread, 12), -bin)) AS center FROM (SELECT *, pow(mean * mass - moment, 2) / nullif(mass * (1 - mass), 0) AS spread FROM bo) WHERE spread IS NOT NULL GROUP BY ALL),
th AS (SELECT {_P}, pow(10, center) AS threshold FROM (SELECT {_P}, any_value(center) AS center, avg(CASE WHEN x <= center THEN 1.0 ELSE 0.0 END) AS below FROM bl JOIN bt USING ({_P}) GROUP BY ALL) WHERE below BETWEEN 0.1 AND 0.9),
bu AS (SELECT *, sum(CASE WHEN threshold IS NULL OR gap IS NULL OR gap > threshold THEN 1 ELSE 0 END) OVER (PARTITION BY {_P} ORDER BY rn) AS burst FROM br LEFT JOIN th USING ({_P})),
ci AS (SELECT {_P}, burst, min(ts) AS ts, CAST(sum(orig_bytes) AS DOUBLE) AS bytes FROM bu GROUP BY ALL),
eg AS (SELECT *, ts - lag(ts) OVER (PARTITION BY {_P} ORDER BY burst) AS gap FROM ci), gp AS (SELECT * FROM eg WHERE gap > 0), sz AS (SELECT * FROM eg WHERE bytes IS NOT NULL),
ec AS (SELECT {_P}, count(*) AS checkins, min(ts) AS e0, max(ts) AS e1 FROM eg GROUP BY ALL HAVING count(*) >= 24),
{_spread_sql('gp', 'gap', 'g')}, {_spread_sql('sz', 'bytes', 's')},
sx AS (SELECT * FROM ec JOIN gq USING ({_P}) JOIN ga USING ({_P}) LEFT JOIN sq USING ({_P}) LEFT JOIN sa USING ({_P}) WHERE gn >= 3 AND gm BETWEEN 1 AND 1e9),
r0 AS (SELECT *, CASE WHEN 2.5 * gmad <= gm / 2 THEN least(greatest(2.5 * gmad, gm / 4), gm / 2) END AS base FROM sx WHERE e1 > e0),
r1 AS (SELECT *, CASE WHEN floor((e1 - e0) / base) + 1 > 200000 THEN CASE WHEN (e1 - e0) / 200000 <= gm / 2 THEN (e1 - e0) / 200000 END ELSE base END AS res FROM r0),
r2 AS (SELECT *, CAST(least(floor((e1 - e0) / res) + 1, 200000) AS BIGINT) AS bins FROM r1 WHERE res > 0),
r3 AS (SELECT {_P}, e0, res, bins, greatest(1, CAST(round_even(0.8 * gm / res, 0) AS BIGINT)) AS lo, least(CAST(round_even(1.2 * gm / res, 0) AS BIGINT), bins - 1) AS hi FROM r2),
pb AS (SELECT {_P}, bins, lo, hi, least(CAST(floor((ts - e0) / res) AS BIGINT), bins - 1) AS bin, count(*) AS c FROM eg JOIN r3 USING ({_P}) WHERE hi >= lo GROUP BY ALL),
pt AS (SELECT {_P}, sum(c) AS total, sum(c * c) AS squares FROM pb GROUP BY ALL),
pl2 AS (SELECT {_P}, bins, bin, c, unnest(range(lo, hi + 1)) AS lag FROM pb),
px2 AS (SELECT l.src_ip, l.dst_ip, l.dst_port, l.lag, l.bins, sum(l.c * coalesce(o.c, 0)) AS crossed, sum(CASE WHEN l.bin < l.bins - l.lag THEN l.c ELSE 0 END) AS head, sum(CASE WHEN l.bin >= l.lag THEN l.c ELSE 0 END) AS tail
  FROM pl2 l LEFT JOIN pb o ON l.src_ip = o.src_ip AND l.dst_ip = o.dst_ip AND l.dst_port = o.dst_port AND l.bin + l.lag = o.bin GROUP BY ALL),
pz AS (SELECT *, total / bins AS mu, squares - bins * (total / bins) * (total / bins) AS under FROM px2 JOIN pt USING ({_P})),
pd AS (SELECT {_P}, least(1.0, greatest(0.0, max(CASE WHEN under > 0 THEN (crossed - mu * (head + tail) + (bins - lag) * mu * mu) / under ELSE 0 END))) AS periodicity FROM pz GROUP BY ALL),
j AS (SELECT sx.*, periodicity, hosts, (ls - fs) / gm AS expected FROM sx JOIN bc USING ({_P}) JOIN bh USING (dst_ip) LEFT JOIN pd USING ({_P})),
q AS (SELECT {_P}, checkins, gm AS gap_median, gmad AS gap_mad, 1 - least(1.0, ({_dispersion_sql('gm', 'gmad')}) / 0.6) AS interval_regularity, 1 - least(1.0, CASE WHEN gn < 4 THEN 0 ELSE (gm - g25) / gm END / 0.6) AS schedule_floor,
  CASE WHEN sn >= 3 THEN 1 - least(1.0, ({_dispersion_sql('sm', 'smad')}) / 0.5) END AS payload_uniformity, periodicity, least(gn, expected) / greatest(gn, expected) * {_sat('checkins', 15)} AS persistence, 1 / sqrt(hosts) AS destination_rarity FROM j),
s AS (SELECT *, {_gm(dict(zip(network.BEACON_PARTS, network.BeaconParams.weights)))} AS score FROM q)
SELECT {_P}, checkins, {_rs('gap_median', 'gap_mad', *network.BEACON_PARTS, 'score')} FROM (SELECT * FROM s WHERE score >= 0.05 ORDER BY round(score, 9) DESC, {_P} LIMIT 200)
"""


BEACON_SQL = _beacon_sql("dense")


def _gap_spread(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    store = Store(spark)
    conn = views.connections(spark, sf_dir, dense=True)
    gaps = store.put(conn.withColumn("value", F.col("ts") - F.lag("ts").over(Window.partitionBy(*network.PAIR).orderBy("ts"))).where("value > 0").select(*network.PAIR, F.lit("gap").alias("what"), "value"), "gaps")
    return network.spreads(gaps, store, **options).select(*network.PAIR, F.col("n").alias("gap_n"), F.round("median", 4).alias("gap_median"), F.round("q25", 4).alias("gap_q25"), F.round("mad", 4).alias("gap_mad"))


def beacon_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, median, lower quartile and MAD of each pair's gaps."""
    return _gap_spread(spark, sf_dir)


def gap_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every pair as one of too many rows to hold: all quantiles come from histograms."""
    return _gap_spread(spark, sf_dir, most=0)


GAPS_SQL = f"""
WITH {W}, g AS (SELECT src_ip, dst_ip, dst_port, ts - lag(ts) OVER (PARTITION BY src_ip, dst_ip, dst_port ORDER BY ts) AS gap FROM dense), h AS (SELECT * FROM g WHERE gap > 0),
m AS (SELECT src_ip, dst_ip, dst_port, count(*) AS gap_n, median(gap) AS gap_median, quantile_cont(gap, 0.25) AS gap_q25 FROM h GROUP BY ALL)
SELECT src_ip, dst_ip, dst_port, gap_n, {_rs('gap_median', 'gap_q25')}, round(median(abs(gap - gap_median)), 4) AS gap_mad FROM h JOIN m USING (src_ip, dst_ip, dst_port) GROUP BY ALL
"""


def pair_summary_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming job's hourly partial summaries, merged: the same as one pass over everything."""
    parts = summaries.pair_summaries(views.connections(spark, sf_dir))
    return summaries.merge_pairs(parts).select("src_ip", "dst_ip", "dst_port", "flows", "bytes_out", "both_flows", *_r("first_seen", "last_seen"))


MERGED_SQL = f"WITH {W} SELECT src_ip, dst_ip, dst_port, count(*) AS flows, CAST(sum(orig_bytes) AS BIGINT) AS bytes_out, count(resp_bytes) AS both_flows, round(min(ts), 4) AS first_seen, round(max(ts), 4) AS last_seen FROM connections GROUP BY ALL"


def fanout_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct destinations of each port from merged hourly sketches, beside the exact number: within three per cent of it."""
    conn = views.connections(spark, sf_dir)
    merged = summaries.merge_sketches(summaries.fanout_sketches(conn, ["dst_port"]), ["dst_port"])
    exact = conn.groupBy("dst_port").agg(F.count_distinct("dst_ip").alias("exact"))
    return merged.join(exact, "dst_port").select("dst_port", "flows", "exact", (F.abs(F.col("destinations") - F.col("exact")) <= 0.03 * F.col("exact")).alias("close"))


SKETCH_SQL = f"WITH {W} SELECT dst_port, count(*) AS flows, count(DISTINCT dst_ip) AS exact, true AS close FROM connections GROUP BY 1"

# ---------------------------------------------------------------- incidents and hunts


def _findings(spark: SparkSession, sf_dir: str, store: Store | None = None, pairs: DataFrame | None = None, claims: DataFrame | None = None) -> DataFrame:
    """Stored ``pairs`` and egress ``claims`` of the same connections may be given."""
    conn, store = views.connections(spark, sf_dir), store or Store(spark)
    pairs = store.put(network.pair_totals(conn), "pairs") if pairs is None else pairs
    parts = [network.detect_fanout(conn, FANOUT, pairs=pairs, store=store), network.detect_egress(conn, EGRESS, pairs=pairs, store=store, claims=claims), network.detect_alerts(views.alerts(spark, sf_dir), ALERTS), names.detect_fingerprints(views.ssl(spark, sf_dir), TLS)]
    return store.put(with_finding_id(check_grammar(reduce(DataFrame.unionByName, parts))[0]), "findings")


def incident_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = incidents.correlate(_findings(spark, sf_dir))
    return found.select("incident", "behaviours", "findings", "severity", *_r("confidence", "multiplier", "priority"))


_ALL_FINDINGS = f"""
fi AS (SELECT 'scans' AS predicate, src_ip AS subject, CAST(dst_port AS VARCHAR) AS object, score, CASE WHEN score >= 0.85 THEN 3 ELSE 2 END AS sev FROM ({FANOUT_SQL})
  UNION ALL SELECT claim, src_ip, dst_ip, score, CASE claim WHEN 'exfiltrates_to' THEN 4 WHEN 'transfers_anomalous_volume' THEN 2 ELSE 1 END FROM ({EGRESS_SQL})
  UNION ALL SELECT 'triggered_signature', src_ip, signature, score, CASE WHEN score >= 0.75 THEN 2 ELSE 1 END FROM ({ALERTS_SQL})
  UNION ALL SELECT 'presents_rare_tls_fingerprint', src_ip, ja3, score, 2 FROM ({TLS_SQL}))
"""
INCIDENT_SQL = f"""
WITH {_ALL_FINDINGS}, g AS (SELECT 'ip:' || subject AS incident, predicate, max(score) AS top, count(*) AS n, max(sev) AS sev FROM fi GROUP BY ALL),
i AS (SELECT incident, 1 - product(1 - top) AS confidence, count(*) FILTER (predicate IN ('scans', 'exfiltrates_to', 'triggered_signature')) AS behaviours, CAST(sum(n) AS BIGINT) AS findings, max(sev) AS sev FROM g GROUP BY 1),
m AS (SELECT *, CAST(least(1 + 0.5 * greatest(behaviours - 1, 0), 2.5) AS DOUBLE) AS multiplier FROM i)
SELECT incident, behaviours, findings, ['info', 'low', 'medium', 'high', 'critical'][sev + 1] AS severity, round(confidence, 4) AS confidence, round(multiplier, 4) AS multiplier, round(confidence * multiplier, 4) AS priority FROM m
"""


def incident_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.queue_summary(incidents.correlate(_findings(spark, sf_dir))[0])


SUMMARY_SQL = f"SELECT severity, count(*) AS incidents, count(*) FILTER (behaviours >= 2) AS corroborated FROM ({INCIDENT_SQL}) GROUP BY 1"


SEQUENCE_SQL = f"""
WITH fi AS (SELECT 'scans' AS predicate, src_ip AS subject, 'port' AS type, CAST(dst_port AS VARCHAR) AS node, score, first_seen, 'lineitem' AS source FROM ({FANOUT_SQL})
  UNION ALL SELECT claim, src_ip, 'ip', dst_ip, score, first_seen, 'lineitem' FROM ({EGRESS_SQL.replace("SELECT src_ip, dst_ip, claim, flows", "SELECT first_seen, src_ip, dst_ip, claim, flows")})
  UNION ALL SELECT 'triggered_signature', src_ip, 'signature', signature, score, first_seen, 'events' FROM ({ALERTS_SQL.replace("SELECT src_ip, signature, alerts, hosts", "SELECT first_seen, src_ip, signature, alerts, hosts")})
  UNION ALL SELECT 'presents_rare_tls_fingerprint', src_ip, 'tls_fingerprint', ja3, score, first_seen, 'events' FROM ({TLS_SQL.replace("SELECT src_ip, ja3, sessions, servers, hosts, estate", "SELECT first_seen, src_ip, ja3, sessions, servers, hosts, estate")})),
hd AS (SELECT * FROM fi QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY first_seen, score DESC, node) = 1),
nx AS (SELECT *, lead(first_seen) OVER w AS later, lead(score) OVER w AS s2, lead(type) OVER w AS t2, lead(node) OVER w AS n2, lead(source) OVER w AS o2 FROM hd WINDOW w AS (PARTITION BY subject ORDER BY first_seen, predicate))
SELECT type AS subject_type, node AS subject, t2 AS object_type, n2 AS object, round(least(score, s2), 4) AS score, round(first_seen, 4) AS first_seen, round(later, 4) AS last_seen FROM nx
WHERE later - first_seen >= CASE WHEN source = o2 THEN 1 ELSE 300 END AND (type, lower(node)) <> (t2, lower(n2))
"""


def incident_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, grouped = incidents.correlate(_findings(spark, sf_dir))
    return incidents.sequence(grouped).select("subject_type", "subject", "object_type", "object", *_r("score", "first_seen", "last_seen"))


def hunt_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other subjects that meet what the findings name; per predicate and value, since ids are content hashes."""
    found = _findings(spark, sf_dir)
    p = incidents.pivots(found)
    rows = incidents.sighted(views.connections(spark, sf_dir), ssl=views.ssl(spark, sf_dir), alerts=views.alerts(spark, sf_dir))
    return _named_hits(incidents.hunt(p, rows), p)


HUNT_SQL = f"""
WITH {W}, {_ALL_FINDINGS}, pv AS (SELECT *, CASE predicate WHEN 'scans' THEN 'dst_port' WHEN 'triggered_signature' THEN 'signature' WHEN 'presents_rare_tls_fingerprint' THEN 'ja3' ELSE 'dst' END AS field, lower(object) AS value FROM fi),
hs AS (SELECT 'dst' AS field, dst_ip AS key, src_ip AS subject, ts FROM connections UNION ALL SELECT 'dst_port', CAST(dst_port AS VARCHAR), src_ip, ts FROM connections UNION ALL SELECT 'ja3', ja3, src_ip, ts FROM ssl WHERE ja3 IS NOT NULL UNION ALL SELECT 'signature', lower(signature), src_ip, ts FROM alerts)
SELECT predicate, pv.field, value, pv.subject AS excluded, hs.subject, count(*) AS events, round(min(ts), 4) AS first_seen, round(max(ts), 4) AS last_seen FROM pv JOIN hs ON pv.field = hs.field AND pv.value = hs.key AND pv.subject <> hs.subject GROUP BY ALL
"""


def _named_hits(hits: DataFrame, p: DataFrame) -> DataFrame:
    named = hits.join(F.broadcast(p.select("finding_id", "predicate", "field", "value", "excluded")), "finding_id")
    return named.select("predicate", "field", "value", "excluded", "subject", "events", *_r("first_seen", "last_seen"))


def hunt_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``hunt_history`` over a kept history: hunted once after its first quarter of days, then only in each quarter that is added."""
    p = Store(spark).put(incidents.pivots(_findings(spark, sf_dir)), "pivots")
    kept = History(spark, f"{shared_folder(spark)}/history-{uuid.uuid4().hex}")
    logs = {"connections": views.connections(spark, sf_dir), "ssl": views.ssl(spark, sf_dir), "alerts": views.alerts(spark, sf_dir)}
    hits = []
    for quarter in range(4):
        days = F.pmod(F.floor(F.col("ts") / 86400), F.lit(4)) == quarter
        kept.add(f"q{quarter}", **{name: rows.where(days) for name, rows in logs.items()})
        hits.append(kept.key_hits(p, [f"q{quarter}"]))
    return _named_hits(incidents.hits_of_findings(p, incidents.added_hits(reduce(DataFrame.unionByName, hits))), p)


def hunt_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other hosts below the zones of tunnels, and other hosts that run the images of rare processes and odd lineages."""
    dns, processes = views.dns(spark, sf_dir), views.processes(spark, sf_dir)
    parts = [names.detect_tunnels(dns, TUNNEL), host.detect_processes(processes, HOST), host.detect_lineage(processes, HOST)]
    found = Store(spark).put(with_finding_id(check_grammar(reduce(DataFrame.unionByName, parts))[0]), "findings")
    p = incidents.pivots(found)
    return _named_hits(incidents.hunt(p, incidents.sighted(dns=dns, processes=processes)), p)


HUNT_NAMES_SQL = f"""
WITH {W}, fi AS (SELECT 'tunnels_dns_over' AS predicate, 'domain' AS field, zone AS value, src_ip AS excluded FROM ({TUNNEL_SQL}) UNION ALL SELECT 'executes_rare_process', 'image', image_name, host FROM ({PROCESS_SQL})
  UNION ALL SELECT 'exhibits_anomalous_lineage', 'image', image_name, host FROM ({LINEAGE_SQL})),
hs AS (SELECT 'domain' AS field, query AS key, src_ip AS subject, ts FROM dns UNION ALL SELECT 'image', {_NAME.format(c='image')}, host, ts FROM processes),
hh AS (SELECT field, key, subject, count(*) AS n, min(ts) AS a, max(ts) AS b FROM hs WHERE key IS NOT NULL GROUP BY ALL),
fn AS (SELECT *, row_number() OVER () AS id FROM fi)
SELECT predicate, fn.field, value, excluded, subject, CAST(sum(n) AS BIGINT) AS events, round(min(a), 4) AS first_seen, round(max(b), 4) AS last_seen
FROM fn JOIN hh ON fn.field = hh.field AND (hh.key = value OR (fn.field = 'domain' AND ends_with(hh.key, '.' || value))) AND excluded <> subject GROUP BY id, predicate, fn.field, value, excluded, subject
"""

# ---------------------------------------------------------------- functions and evaluation


def fn_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = views.dns(spark, sf_dir).withColumn("zone", S.registered_domain(F.col("query")))
    return q.select("query", "zone", S.subdomain_of(F.col("query"), F.col("zone")).alias("sub"), S.first_label(F.col("query")).alias("label"), S.after_first_label(F.col("query")).alias("rest"), F.round(S.byte_entropy(F.col("query")), 4).alias("entropy"), S.longest_consonant_run(F.col("query")).alias("consonants"), F.round(S.digit_ratio(F.col("query")), 4).alias("digits"))


NAMES_SQL = f"""
WITH {W} SELECT query, {_ZONE} AS zone, replace(left(query, length(query) - length({_ZONE})), '.', '') AS sub, split_part(query, '.', 1) AS label, regexp_replace(query, '^[^.]*\\.', '') AS rest,
  round((SELECT entropy(x) FROM (SELECT unnest(string_split(query, '')) AS x)), 4) AS entropy, coalesce(list_max(list_transform(regexp_extract_all(query, '[b-df-hj-np-tv-z]+'), lambda x: length(x))), 0) AS consonants, round(length(regexp_replace(query, '[^0-9]', '', 'g')) / length(query), 4) AS digits FROM dns
"""


def fn_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.connections(spark, sf_dir).select(F.col("dst_ip").alias("address")).distinct().withColumn("number", S.ipv4_number(F.col("address")))
    return c.select("address", "number", S.dotted(S.ipv4_network(F.col("number"), 24)).alias("network24"), S.dotted(S.ipv4_network(F.col("number"), 27)).alias("network27"), S.indicator_kind(F.col("address")).alias("kind"))


ADDRESS_SQL = f"""
WITH {W}, a AS (SELECT DISTINCT dst_ip AS address, {_ipv4('dst_ip')} AS number, string_split(dst_ip, '.') AS p FROM connections)
SELECT address, number, p[1] || '.' || p[2] || '.' || p[3] || '.0' AS network24, p[1] || '.' || p[2] || '.' || p[3] || '.' || (CAST(p[4] AS INTEGER) // 32 * 32) AS network27, 'ip' AS kind FROM a
"""


def eval_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of "short text" as a mark of low quality, against the labels."""
    docs = views.read(spark, sf_dir, "documents").join(views.read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    found = docs.where(F.length("text") < 400).select("doc_id")
    truth = views.read(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    return incidents.truth_match(found, truth, ["doc_id"]).select("tp", "fp", "fn", *_r("precision", "recall", "f1"))


TRUTH_SQL = """
WITH f AS (SELECT DISTINCT doc_id FROM documents WHERE length(text) < 400 AND doc_id IN (SELECT doc_id FROM labels)), t AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0),
c AS (SELECT count(*) FILTER (f.doc_id IS NOT NULL AND t.doc_id IS NOT NULL) AS tp, count(*) FILTER (t.doc_id IS NULL) AS fp, count(*) FILTER (f.doc_id IS NULL) AS fn FROM f FULL JOIN t ON f.doc_id = t.doc_id)
SELECT tp, fp, fn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1 FROM c
"""


def _claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    turns = views.read(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "conv_id", "turn", "text")
    cites = F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).when(F.col("turn") % 3 == 1, F.array(F.concat_ws(":", "conv_id", F.col("turn") - 1))).otherwise(F.array(F.concat_ws(":", "conv_id", "turn"), F.concat_ws(":", F.col("conv_id"), F.col("turn") + 1000)))
    # of rows that repeat a turn, the least text
    one = turns.groupBy("id", "conv_id", "turn").agg(F.min("text").alias("text"))
    return one.select(F.col("id").alias("claim_id"), "text", cites.alias("cites")), one.select("id", "text")


def claims_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.check_claims(*_claims(spark, sf_dir))


def incident_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.incident_entities(incidents.correlate(_findings(spark, sf_dir))[1])


ENTITIES_SQL = f"""
WITH {_ALL_FINDINGS}, k AS (SELECT 'ip:' || subject AS incident, CASE predicate WHEN 'scans' THEN 'port:' WHEN 'triggered_signature' THEN 'signature:' WHEN 'presents_rare_tls_fingerprint' THEN 'tls_fingerprint:' ELSE 'ip:' END || lower(object) AS entity FROM fi)
SELECT incident, entity FROM k UNION SELECT incident, incident FROM k
"""


def spread_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five alerts of each source, spread over its time."""
    return incidents.spread_sample(views.alerts(spark, sf_dir).select("src_ip", "source_line"), ["src_ip"], ["source_line"], 5)


SPREAD_SQL = f"""
WITH {W}, n AS (SELECT src_ip, source_line, row_number() OVER (PARTITION BY src_ip ORDER BY source_line) - 1 AS rn, count(*) OVER (PARTITION BY src_ip) AS n FROM alerts)
SELECT src_ip, source_line FROM n WHERE n <= 5 OR list_contains(list_transform(range(0, 5), lambda i: CAST(round_even(i * (n - 1) / 4, 0) AS BIGINT)), rn)
"""


def readiness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = intel.capture_window(views.connections(spark, sf_dir))
    return readiness.report(views.ssl(spark, sf_dir), views.processes(spark, sf_dir), views.indicators(spark, sf_dir), views.assets(spark, sf_dir), window)


READINESS_SQL = f"""
SELECT 'tls' AS check, 'ready' AS state, (WITH {W} SELECT count(ja3) FROM ssl) AS amount
UNION ALL SELECT 'host', CASE WHEN supported THEN 'ready' ELSE 'baseline_insufficient' END, executions FROM ({BASELINE_SQL})
UNION ALL SELECT 'indicators', 'ready', (SELECT count(*) FROM supplier)
UNION ALL SELECT 'assets', 'ready', applied FROM ({COVERAGE_SQL})
"""


def queue_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 incidents of the queue: a limit that is the feature."""
    return incidents.ranked_queue(incidents.correlate(_findings(spark, sf_dir))[0], 50).select("place", "incident", "severity", *_r("priority"))


QUEUE_SQL = f"""
SELECT row_number() OVER (ORDER BY p DESC, sev DESC, incident) AS place, incident, severity, priority FROM (
  SELECT *, round(confidence * multiplier, 9) AS p FROM ({INCIDENT_SQL.replace("round(confidence, 4) AS confidence, round(multiplier, 4) AS multiplier", "confidence, multiplier, sev")}) ORDER BY p DESC, sev DESC, incident LIMIT 50)
"""


def _header(spark: SparkSession, fields: str, name: str) -> DataFrame:
    return spark.range(1).select(F.lit("#fields\t" + fields).alias("line"), F.lit(name).alias("source_file"), F.lit(0).cast("long").alias("source_line"))


def src_conn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The connections written as sensor log lines and parsed again."""
    c = views.connections(spark, sf_dir)
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("-"))
    names_ = ["ts", "src_ip", "dst_ip", "dst_port", "orig_bytes", "resp_bytes"]
    lines = c.select(F.concat_ws("\t", *[part(n) for n in names_]).alias("line"), F.lit("conn.log").alias("source_file"), "source_line")
    parsed = text.parse_conn(lines.unionByName(_header(spark, "ts\tid.orig_h\tid.resp_h\tid.resp_p\torig_bytes\tresp_bytes", "conn.log")))
    return parsed.select("src_ip", "dst_ip", "dst_port", "orig_bytes", "resp_bytes", "source_line", *_r("ts"))


SRC_CONN_SQL = f"WITH {W} SELECT '10.1.' || (o_custkey // 250) || '.' || (o_custkey % 250) AS src_ip, '192.168.' || (l_suppkey // 250) || '.' || (l_suppkey % 250) AS dst_ip, 440 + l_linenumber AS dst_port, CAST(floor(l_extendedprice) AS BIGINT) AS orig_bytes, CASE WHEN l_returnflag <> 'N' THEN CAST(floor(l_quantity * 100) AS BIGINT) END AS resp_bytes, l_orderkey * 10 + l_linenumber AS source_line, round(epoch(l_shipdate) + l_orderkey % 86400, 4) AS ts FROM ol"


def src_alert_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts written as event-log JSON and parsed again."""
    a = views.alerts(spark, sf_dir)
    stamp = F.date_format(F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    body = F.struct(stamp.alias("timestamp"), F.lit("alert").alias("event_type"), "src_ip", F.col("dst_ip").alias("dest_ip"), F.struct("signature_id", "signature", "category", "severity").alias("alert"))
    parsed = text.parse_alerts(a.select(F.to_json(body).alias("line"), "source_file", "source_line"))
    return parsed.select("src_ip", "dst_ip", "signature", "signature_id", "category", "severity", "source_line", F.floor("ts").cast("long").alias("second"))


SRC_ALERT_SQL = f"WITH {W} SELECT src_ip, dst_ip, signature, signature_id, category, severity, source_line, CAST(floor(ts) AS BIGINT) AS second FROM alerts"


def src_process_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The process creations written as event JSON and parsed again."""
    p = views.processes(spark, sf_dir)
    stamp = F.date_format(F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")), "yyyy-MM-dd HH:mm:ss.SSS")
    body = F.struct(F.lit(1).alias("EventID"), F.lit(text.PROVIDER).alias("SourceName"), stamp.alias("UtcTime"), F.col("host").alias("Hostname"), F.col("image").alias("Image"), F.col("parent_image").alias("ParentImage"), F.col("process_guid").alias("ProcessGuid"), F.concat(F.lit("MD5=0,SHA256="), F.sha2("process_guid", 256)).alias("Hashes"))
    parsed = text.parse_processes(p.select(F.to_json(body).alias("line"), "source_file", "source_line"))
    return parsed.select("host", "image", "parent_image", "process_guid", "sha256")


SRC_PROCESS_SQL = f"WITH {W} SELECT host, image, parent_image, process_guid, sha256(process_guid) AS sha256 FROM processes"


# ---------------------------------------------------------------- findings of all detectors, evidence, evaluation


def _telemetry(spark: SparkSession, sf_dir: str, connections: DataFrame | None = None, events: DataFrame | None = None) -> detectors.Telemetry:
    """``connections``, if given, and ``events`` are read from a store."""
    made = views.connections(spark, sf_dir) if connections is None else connections
    feed = intel.normalised_indicators(views.indicators(spark, sf_dir))
    return detectors.Telemetry(made, views.dns(spark, sf_dir), views.ssl(spark, sf_dir, events), views.alerts(spark, sf_dir, events), views.processes(spark, sf_dir, events), feed, rows=connections)


ALL = detectors.registry(beacons=BEACONS, fanout=FANOUT, egress=EGRESS, tunnels=TUNNEL, alerts=ALERTS, matches=INTEL, tls=TLS, dga=DGA, hosts=HOST, samples=0)


def _all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the eight detectors claim, through their registry: connections of both kinds in one run, generated names in a second."""
    store = Store(spark)
    flows, events = store.put(views.both_flows(spark, sf_dir), "flows"), store.put(views._events(spark, sf_dir), "events")
    usual, _ = detectors.detect_all(_telemetry(spark, sf_dir, views.all_connections(flows), events), ALL, store)
    generated = detectors.Telemetry(dns=views.generated_dns(spark, sf_dir), bigrams=names.fit_bigrams(views.words(spark, sf_dir)))
    other, _ = detectors.detect_all(generated, [d for d in ALL if d.name == "tls_dga"], store)
    return usual.unionByName(other)


def findings_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_findings(spark, sf_dir).select("predicate", "subject_type", "subject", "object_type", "object", "severity", "detector", *_r("score"))


def queue_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents of what all eight detectors claim."""
    found, _ = incidents.correlate(_all_findings(spark, sf_dir))
    return found.select("incident", "behaviours", "findings", "severity", *_r("confidence", "multiplier", "priority"))


def intel_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The busiest values of each indicator, at most three, with the number of all its values."""
    t = _telemetry(spark, sf_dir)
    scored = intel.score_matches(intel.matched_values(t.connections, t.dns, t.indicators), t.indicators, INTEL)
    return intel.capped_matches(scored, intel.IntelParams(per_indicator=3, top=500)).select("kind", "value", "indicator", "events", "indicator_values", *_r("score"))


CAPPED_SQL = f"""
SELECT kind, value, indicator, events, indicator_values, score FROM (SELECT *, row_number() OVER (PARTITION BY indicator, indicator_kind ORDER BY events DESC, value) AS place, count(*) OVER (PARTITION BY indicator, indicator_kind) AS indicator_values FROM ({INTEL_SQL.replace("round(score, 4) AS score FROM", "score AS raw, round(score, 4) AS score FROM")}))
WHERE place <= 3 ORDER BY round(raw, 9) DESC, kind, value LIMIT 500
"""


def netblock_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged addresses of one /24 that different indicators name."""
    t = _telemetry(spark, sf_dir)
    scored = intel.score_matches(intel.matched_values(t.connections, t.dns, t.indicators), t.indicators, INTEL)
    return intel.shared_netblocks(scored).select("anchor", "other", "network24", *_r("first_seen", "last_seen", "score"))


_FLAGGED = f"""
fs AS (SELECT value, indicator, indicator_kind, first_seen, last_seen FROM ({INTEL_SQL.replace("SELECT kind, value, indicator, indicator_kind,", "SELECT first_seen, last_seen, kind, value, indicator, indicator_kind,")}) WHERE kind = 'ip')
"""
NETBLOCK_SQL = f"""
WITH {_FLAGGED}, n AS (SELECT *, {_ipv4('value')} AS num, {_ipv4('value')} // 256 AS net FROM fs),
m AS (SELECT *, num = min(num) OVER (PARTITION BY net, indicator, indicator_kind) AS anchor FROM n)
SELECT a.value AS anchor, b.value AS other, regexp_replace(a.value, '[0-9]+$', '0') AS network24, round(least(a.first_seen, b.first_seen), 4) AS first_seen, round(greatest(a.last_seen, b.last_seen), 4) AS last_seen, 0.5 AS score
FROM m a JOIN m b ON a.net = b.net AND a.anchor AND (a.indicator, a.indicator_kind) <> (b.indicator, b.indicator_kind) AND (NOT b.anchor OR a.num < b.num)
"""


def _addresses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Addresses of both families against single addresses and networks of several lengths; other spellings on purpose."""
    o, s = F.col("l_orderkey"), F.col("l_suppkey")
    line = views.read(spark, sf_dir, "lineitem")
    hexed = lambda c: F.lower(F.hex(c.cast("long")))
    six = F.when(o % 3 == 0, F.concat(F.lit("2001:DB8:"), F.upper(hexed(s % 8)), F.lit("::"), hexed(o % 16))).when(o % 3 == 1, F.concat(F.lit("2001:db8:"), hexed(s % 8), F.lit(":0:0:0:0:0:"), hexed(o % 16))).otherwise(F.concat(F.lit("10.8."), s % 8, F.lit("."), o % 16))
    seen = line.select(six.alias("value")).distinct().select(S.canonical_ipv6(F.col("value")).alias("value"))
    sup = F.col("s_suppkey")
    raw = views.read(spark, sf_dir, "supplier").select(
        F.when(sup % 4 == 0, F.concat(F.lit("2001:db8:"), hexed(sup % 8), F.lit("::/48"))).when(sup % 4 == 1, F.concat(F.lit("2001:0db8:"), hexed(sup % 8), F.lit("::000"), hexed(sup % 16))).when(sup % 4 == 2, F.concat(F.lit("2001:db8:"), hexed(sup % 8), F.lit("::8/125"))).otherwise(F.concat(F.lit("10.8."), sup % 8, F.lit(".0/29"))).alias("value"),
        F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("date").alias("added"), F.lit("supplier").alias("source_file"), sup.cast("long").alias("source_line"),
    )
    return seen, intel.normalised_indicators(raw)


def match_ipv6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each address with its longest network, tried against every prefix length of the feed."""
    return intel.match_addresses(*_addresses(spark, sf_dir)).select("value", "indicator", "indicator_kind", "prefix")


def match_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a merge of addresses with the feed's elementary ranges."""
    return ranges.match_ranges(*_addresses(spark, sf_dir)).select("value", "indicator", "indicator_kind", "prefix")


IPV6_SQL = """
WITH v AS (SELECT DISTINCT l_orderkey % 3 = 2 AS four, l_suppkey % 8 AS a, l_orderkey % 16 AS b FROM lineitem),
f AS (SELECT DISTINCT s_suppkey % 4 AS k, s_suppkey % 8 AS a, s_suppkey % 16 AS b FROM supplier),
h AS (SELECT v.*, f.k, f.a AS fa, f.b AS fb, CASE k WHEN 0 THEN 48 WHEN 1 THEN 128 WHEN 2 THEN 125 ELSE 29 END AS prefix FROM v JOIN f ON v.a = f.a AND CASE k WHEN 0 THEN NOT four WHEN 1 THEN NOT four AND v.b = f.b WHEN 2 THEN NOT four AND v.b BETWEEN 8 AND 15 ELSE four AND v.b < 8 END),
t AS (SELECT *, CASE WHEN a = 0 THEN '2001:db8::' ELSE '2001:db8:' || printf('%x', a) || '::' END AS head FROM h),
n AS (SELECT DISTINCT CASE WHEN four THEN '10.8.' || a || '.' || b WHEN b = 0 THEN head ELSE head || printf('%x', b) END AS value, CASE k WHEN 0 THEN head || '/48' WHEN 1 THEN CASE WHEN fb = 0 THEN head ELSE head || printf('%x', fb) END WHEN 2 THEN head || '8/125' ELSE '10.8.' || a || '.0/29' END AS indicator, CASE WHEN k = 1 THEN 'ip' ELSE 'cidr' END AS indicator_kind, prefix FROM t)
SELECT value, indicator, indicator_kind, CAST(prefix AS INTEGER) AS prefix FROM n QUALIFY row_number() OVER (PARTITION BY value ORDER BY prefix DESC) = 1
"""


def incident_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents of egress and intelligence findings: a match joins every incident that names its address, and stands alone only if none does."""
    found, _ = detectors.detect_all(_telemetry(spark, sf_dir), [d for d in ALL if d.name in ("egress", "intel")])
    return incidents.members(found.where("predicate <> 'shares_infrastructure_with'")).groupBy("incident", "predicate").agg(F.count("*").alias("findings"))


ATTACHED_SQL = f"""
WITH e AS ({EGRESS_SQL}), i AS (SELECT kind, value FROM ({INTEL_SQL.replace("round(score, 4) AS score FROM", "score AS raw, round(score, 4) AS score, row_number() OVER (PARTITION BY indicator, indicator_kind ORDER BY events DESC, value) AS place FROM")}) WHERE place <= 10 ORDER BY round(raw, 9) DESC, kind, value LIMIT 200),
m AS (SELECT DISTINCT e.src_ip, i.value FROM i JOIN e ON i.kind = 'ip' AND e.dst_ip = i.value AND e.src_ip <> i.value)
SELECT incident, predicate, count(*) AS findings FROM (
  SELECT 'ip:' || src_ip AS incident, claim AS predicate FROM e UNION ALL SELECT 'ip:' || src_ip, 'matches_threat_intel' FROM m
  UNION ALL SELECT kind || ':' || value, 'matches_threat_intel' FROM i WHERE (kind || ':' || value) IN (SELECT 'ip:' || src_ip FROM e) OR NOT (kind = 'ip' AND value IN (SELECT value FROM m))) GROUP BY ALL
"""


W_ALL = W.replace("connections AS (SELECT epoch", "plain AS (SELECT epoch", 1).replace("gdns AS (", "connections AS (SELECT * FROM plain UNION ALL SELECT * FROM dense),\ngdns AS (", 1)


def _claims_sql(sql: str, predicate: str, subject_type: str, subject: str, object_type: str, obj: str, severity: str, detector: str) -> str:
    return f"SELECT {predicate} AS predicate, '{subject_type}' AS subject_type, {subject} AS subject, {object_type} AS object_type, {obj} AS object, {severity} AS severity, '{detector}@1' AS detector, round(score, 4) AS score FROM ({sql.replace(W, W_ALL)})"


_INTEL_RAW = INTEL_SQL.replace("SELECT kind, value, indicator, indicator_kind,", "SELECT score AS raw, first_seen, last_seen, kind, value, indicator, indicator_kind,")
_INTEL_TOP = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY indicator, indicator_kind ORDER BY events DESC, value) AS place FROM ({_INTEL_RAW})) WHERE place <= 10 ORDER BY round(raw, 9) DESC, kind, value LIMIT 200"
LINKS_SQL = f"""
WITH {W}, fx AS ({_INTEL_RAW}), an AS (SELECT query AS name, unnest(string_split(answers, ';')) AS answer FROM dns), na AS (SELECT DISTINCT answer, name FROM an),
nb AS (SELECT answer, count(*) AS breadth FROM na GROUP BY 1 HAVING count(*) BETWEEN 2 AND 5),
mk AS (SELECT na.*, breadth, indicator FROM na JOIN nb USING (answer) LEFT JOIN (SELECT value AS name, indicator FROM fx WHERE kind = 'domain') USING (name)),
ra AS (SELECT a.name AS anchor, b.name AS other, min(a.breadth) AS breadth FROM mk a JOIN mk b USING (answer) WHERE a.indicator IS NOT NULL AND a.name <> b.name AND (b.indicator IS NULL OR (b.indicator <> a.indicator AND a.name < b.name)) GROUP BY ALL),
aa AS (SELECT na.answer, fx.indicator AS own, name FROM na JOIN fx ON fx.kind = 'ip' AND fx.value = na.answer), ab AS (SELECT answer, count(*) AS breadth FROM aa GROUP BY 1 HAVING count(*) BETWEEN 2 AND 5),
rb AS (SELECT answer AS anchor, name AS other, breadth FROM aa JOIN ab USING (answer) LEFT JOIN (SELECT value AS name, indicator FROM fx WHERE kind = 'domain') USING (name) WHERE indicator IS NULL OR indicator <> own),
fn AS (SELECT *, {_ipv4('value')} AS num, {_ipv4('value')} // 256 AS net FROM fx WHERE kind = 'ip'), fm AS (SELECT *, num = min(num) OVER (PARTITION BY net, indicator, indicator_kind) AS anchor FROM fn),
rc AS (SELECT a.value AS anchor, b.value AS other FROM fm a JOIN fm b ON a.net = b.net AND a.anchor AND (a.indicator, a.indicator_kind) <> (b.indicator, b.indicator_kind) AND (NOT b.anchor OR a.num < b.num)),
u AS ((SELECT 'domain' AS st, anchor, 'domain' AS ot, other, least(0.95, 2 / breadth) AS score FROM ra ORDER BY score DESC, anchor, other LIMIT 50)
  UNION ALL (SELECT 'ip', anchor, 'domain', other, least(0.95, 2 / breadth) AS score FROM rb ORDER BY score DESC, anchor, other LIMIT 50) UNION ALL (SELECT 'ip', anchor, 'ip', other, 0.5 FROM rc ORDER BY anchor, other LIMIT 50))
SELECT * FROM u ORDER BY round(score, 4) DESC, anchor, other LIMIT 50
"""
_BANDS = "CASE claim WHEN 'exfiltrates_to' THEN 'critical' WHEN 'transfers_anomalous_volume' THEN 'medium' ELSE 'low' END"
FINDINGS_SQL = " UNION ALL ".join([
    _claims_sql(_beacon_sql("connections"), "'beacons_to'", "ip", "src_ip", "'ip'", "dst_ip", "CASE WHEN score >= 0.9 THEN 'critical' ELSE 'high' END", "beaconing"),
    _claims_sql(FANOUT_SQL, "'scans'", "ip", "src_ip", "'port'", "CAST(dst_port AS VARCHAR)", "CASE WHEN score >= 0.85 THEN 'high' ELSE 'medium' END", "fanout"),
    _claims_sql(EGRESS_SQL, "claim", "ip", "src_ip", "'ip'", "dst_ip", _BANDS, "egress"),
    _claims_sql(TUNNEL_SQL, "'tunnels_dns_over'", "ip", "src_ip", "'domain'", "zone", "CASE WHEN score >= 0.85 THEN 'critical' ELSE 'high' END", "dns_tunnel"),
    _claims_sql(ALERTS_SQL, "'triggered_signature'", "ip", "src_ip", "'signature'", "signature", "CASE WHEN score >= 0.75 THEN 'medium' ELSE 'low' END", "alerts"),
    _claims_sql(_INTEL_TOP, "'matches_threat_intel'", "' || kind || '", "value", "NULL", "NULL", "CASE WHEN score >= 0.5 THEN 'medium' ELSE 'low' END", "intel"),
    _claims_sql(LINKS_SQL, "'shares_infrastructure_with'", "' || st || '", "anchor", "ot", "other", "'info'", "intel"),
    _claims_sql(TLS_SQL, "'presents_rare_tls_fingerprint'", "ip", "src_ip", "'tls_fingerprint'", "ja3", "'medium'", "tls_dga"),
    _claims_sql(DGA_SQL, "'resolves_algorithmic_domain'", "ip", "src_ip", "'domain'", "label || '.' || suffix", "CASE WHEN score >= 0.85 THEN 'high' ELSE 'medium' END", "tls_dga"),
    _claims_sql(PROCESS_SQL, "'executes_rare_process'", "host", "host", "'process'", "image_name", "'medium'", "host"),
    _claims_sql(LINEAGE_SQL, "'exhibits_anomalous_lineage'", "host", "host", "'process'", "image_name", "'high'", "host"),
])
QUEUE_ALL_SQL = f"""
WITH fi AS ({FINDINGS_SQL}), k AS (SELECT *, row_number() OVER () AS id, subject_type || ':' || lower(subject) AS own, object_type || ':' || lower(object) AS named, list_position(['info', 'low', 'medium', 'high', 'critical'], severity) AS sev FROM fi),
mv AS (SELECT DISTINCT k.id, n.own AS target FROM k JOIN k n ON k.predicate = 'matches_threat_intel' AND n.object IS NOT NULL AND n.named = k.own AND n.own <> k.own),
al AS (SELECT own AS incident, k.* FROM k UNION ALL SELECT target, k.* FROM k JOIN mv USING (id)), st AS (SELECT DISTINCT own AS incident FROM k WHERE id NOT IN (SELECT id FROM mv)),
g AS (SELECT incident, predicate, max(score) AS top, count(*) AS n, max(sev) AS sev FROM al SEMI JOIN st USING (incident) GROUP BY ALL),
i AS (SELECT incident, 1 - product(1 - top) AS confidence, count(*) FILTER (predicate NOT IN ({', '.join(f"'{x}'" for x in incidents.SUPPORTING + incidents.DERIVED)})) AS behaviours, CAST(sum(n) AS BIGINT) AS findings, max(sev) AS sev FROM g GROUP BY 1),
m AS (SELECT *, CAST(least(1 + 0.5 * greatest(behaviours - 1, 0), 2.5) AS DOUBLE) AS multiplier FROM i)
SELECT incident, behaviours, findings, ['info', 'low', 'medium', 'high', 'critical'][sev] AS severity, round(confidence, 4) AS confidence, round(multiplier, 4) AS multiplier, round(confidence * multiplier, 4) AS priority FROM m
"""


def hunt_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One look-up for each incident and pivot, with the best score of the findings that ask for it."""
    _, grouped = incidents.correlate(_findings(spark, sf_dir))
    return incidents.distinct_pivots(incidents.pivots(grouped)).select("incident", "predicate", "field", "value", "match", "excluded", *_r("score"))


PIVOTS_SQL = f"""
WITH {_ALL_FINDINGS} SELECT 'ip:' || subject AS incident, predicate, CASE predicate WHEN 'scans' THEN 'dst_port' WHEN 'triggered_signature' THEN 'signature' WHEN 'presents_rare_tls_fingerprint' THEN 'ja3' ELSE 'dst' END AS field, lower(object) AS value, 'exact' AS match, subject AS excluded, round(max(score), 4) AS score FROM fi GROUP BY ALL
"""


def incident_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of each incident's findings in reading order."""
    _, grouped = incidents.correlate(_findings(spark, sf_dir))
    return incidents.in_reading_order(grouped).select("incident", F.col("place").cast("long").alias("place"), *_r("score"))


READING_SQL = f"WITH {_ALL_FINDINGS} SELECT 'ip:' || subject AS incident, row_number() OVER (PARTITION BY subject ORDER BY round(score, 4) DESC) AS place, round(score, 4) AS score FROM fi"


BRIEF_BUDGET, BRIEF_LINES = 120, 12


def incident_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings' lines that fit each incident's budget; ids are made of the claims alone here, so that SQL can make them, too."""
    claim = F.concat(F.lit("fi_"), F.left(F.md5(F.concat_ws("|", "predicate", "subject", "object").cast("binary")), F.lit(16)))
    _, grouped = incidents.correlate(_findings(spark, sf_dir).withColumn("finding_id", claim))
    return incidents.briefs(grouped, BRIEF_BUDGET, BRIEF_LINES).where("part = 0").select("incident", F.col("place").cast("long").alias("place"), "finding_id", "text", "cost")


BRIEFS_SQL = f"""
WITH {_ALL_FINDINGS}, li AS (SELECT 'ip:' || subject AS incident, 'fi_' || left(md5(predicate || '|' || subject || '|' || object), 16) AS finding_id, predicate, subject, object, round(score, 4) AS score FROM fi),
pl AS (SELECT *, row_number() OVER (PARTITION BY incident ORDER BY score DESC, finding_id) AS place, finding_id || ': ' || subject || ' ' || predicate || ' ' || object || ' (' || format('{{:.2f}}', score) || ')' AS text FROM li),
co AS (SELECT *, CAST(ceil(length(text) / 4) AS BIGINT) AS cost FROM pl WHERE place <= {BRIEF_LINES}),
ru AS (SELECT *, sum(cost) OVER (PARTITION BY incident ORDER BY place) AS running FROM co)
SELECT incident, place, finding_id, text, cost FROM ru WHERE running <= {BRIEF_BUDGET}
"""


def grammar_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims made of the events, most of them wrong in one way, and why each is rejected."""
    k, kind = F.col("k"), F.col("event_type")
    e = views._events(spark, sf_dir).where("k is not null")
    place = F.struct(F.lit("events").alias("source_file"), F.col("event_id").cast("long").alias("source_line"))
    proof = F.array(F.struct(F.lit("ev").alias("id"), F.lit("row").alias("kind"), F.lit("").alias("summary"), F.lit("{}").alias("payload"), place.alias("artifact"), F.array(place).alias("samples")))
    rows = e.select(
        "event_id", F.when(k % 6 == 0, "guesses").when(k % 6 == 1, "matches_threat_intel").otherwise("beacons_to").alias("predicate"), F.when(kind == "error", "user").otherwise("ip").alias("subject_type"), F.col("user_id").cast("string").alias("subject"),
        F.when(kind == "view", "port").when(kind != "click", "ip").alias("object_type"), F.when(kind != "click", "x").alias("object"), F.when(k % 6 == 2, 1.5).otherwise(0.5).alias("score"), F.when(k % 6 == 3, F.array().cast(proof_type)).otherwise(proof).alias("evidence"),
    )
    admitted, rejected = check_grammar(rows)
    return rejected.groupBy("predicate", "reason").agg(F.count("*").alias("claims")).unionByName(admitted.groupBy("predicate").agg(F.count("*").alias("claims")).withColumn("reason", F.lit("none")))


proof_type = "array<struct<id:string,kind:string,summary:string,payload:string,artifact:struct<source_file:string,source_line:bigint>,samples:array<struct<source_file:string,source_line:bigint>>>>"
REJECTS_SQL = f"""
WITH {W}, c AS (SELECT CASE k % 6 WHEN 0 THEN 'guesses' WHEN 1 THEN 'matches_threat_intel' ELSE 'beacons_to' END AS predicate, event_type, k % 6 AS m FROM ev WHERE k IS NOT NULL),
r AS (SELECT predicate, CASE WHEN predicate = 'guesses' THEN 'unknown predicate' WHEN event_type = 'error' THEN 'subject type' WHEN m = 1 AND event_type <> 'click' THEN 'object of a unary predicate' WHEN m > 1 AND event_type = 'click' THEN 'no object'
  WHEN m > 1 AND event_type = 'view' THEN 'object type' WHEN m = 3 THEN 'no evidence' WHEN m = 2 THEN 'confidence outside 0..1' ELSE 'none' END AS reason FROM c)
SELECT predicate, reason, count(*) AS claims FROM r GROUP BY ALL
"""


def _labelled(pairs: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """Egress claims, and the pairs (subject, object) that are labelled by their addresses' last numbers: both stored, as they are read several times."""
    claims = store.put(network.strongest_claims(network.score_pair_transfers(pairs, EGRESS, store), EGRESS), "claims")
    last = lambda c: F.split_part(c, F.lit("."), F.lit(4)).cast("int")
    labelled = pairs.select(F.col("src_ip").alias("subject"), F.col("dst_ip").alias("object")).where((last(F.col("subject")) + last(F.col("object"))) % 7 == 0).distinct()
    return claims, store.put(labelled, "labelled")


def _found(claims: DataFrame) -> DataFrame:
    """Egress claims as (subject, object, score, claim)."""
    return claims.select(F.col("src_ip").alias("subject"), F.col("dst_ip").alias("object"), F.round("score", 4).alias("score"), "claim")


def eval_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capture's measures against labels: places, pair precision, the best labelled pair."""
    store = Store(spark)
    totals = store.put(network.pair_totals(views.connections(spark, sf_dir)), "pairs")  # the connections are joined once
    claims, pairs = _labelled(totals, store)
    ranked, _ = incidents.correlate(_findings(spark, sf_dir, store, totals, claims))
    documented = views.read(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.concat(F.lit("10.1."), F.floor(F.col("c_custkey") / 250), F.lit("."), F.col("c_custkey") % 250).alias("subject"))
    one = incidents.capture_evaluation(ranked, _found(claims), pairs, incidents.infected_subjects(documented, pairs), 100.0)
    return one.select("beacons", "on_labelled", "best_infected_place", "best_beacon_place", *_r("pair_precision", "beacons_per_hour", "best_confidence"))


_PAIRS = "pl AS (SELECT DISTINCT src_ip AS subject, dst_ip AS object FROM connections WHERE (CAST(split_part(src_ip, '.', 4) AS INTEGER) + CAST(split_part(dst_ip, '.', 4) AS INTEGER)) % 7 = 0)"
CAPTURE_SQL = f"""
WITH {W}, {_PAIRS}, e AS (SELECT src_ip AS subject, dst_ip AS object, score FROM ({EGRESS_SQL})), b AS (SELECT e.*, pl.subject IS NOT NULL AS on_label FROM e LEFT JOIN pl USING (subject, object)),
q AS (SELECT incident, row_number() OVER (ORDER BY p DESC, sev DESC, incident) AS place FROM (SELECT *, round(confidence * multiplier, 9) AS p FROM ({INCIDENT_SQL.replace("round(confidence, 4) AS confidence, round(multiplier, 4) AS multiplier", "confidence, multiplier, sev")}))),
k AS (SELECT DISTINCT 'ip:10.1.' || (c_custkey // 250) || '.' || (c_custkey % 250) AS incident FROM customer WHERE c_custkey % 50 = 0 AND '10.1.' || (c_custkey // 250) || '.' || (c_custkey % 250) IN (SELECT subject FROM pl)),
m AS (SELECT max(score) FILTER (on_label) AS best FROM b)
SELECT count(*) AS beacons, count(*) FILTER (on_label) AS on_labelled, (SELECT min(place) FROM q JOIN k USING (incident)) AS best_infected_place, (SELECT CASE WHEN best IS NOT NULL THEN (SELECT count(*) FROM b WHERE score > best) + 1 END FROM m) AS best_beacon_place,
  round(count(*) FILTER (on_label) / count(*), 4) AS pair_precision, round(count(*) / 100.0, 4) AS beacons_per_hour, round((SELECT best FROM m), 4) AS best_confidence FROM b
"""


def eval_by_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of each egress claim; the label of a pair is the claim that its addresses ask for."""
    store = Store(spark)
    claims, pairs = _labelled(store.put(network.pair_totals(views.connections(spark, sf_dir)).drop("first_at"), "pairs"), store)
    found = _found(claims)
    last = F.split_part("object", F.lit("."), F.lit(4)).cast("int")
    truth = pairs.withColumn("claim", F.when(last % 3 == 0, "exfiltrates_to").when(last % 3 == 1, "transfers_anomalous_volume").otherwise("contacts_rare_destination"))
    return incidents.truth_match_by(found, truth, ["subject", "object"], "claim").select("claim", "tp", "fp", "fn", *_r("precision", "recall", "f1"))


BY_CLAIM_SQL = f"""
WITH {W}, {_PAIRS}, t AS (SELECT *, CASE CAST(split_part(object, '.', 4) AS INTEGER) % 3 WHEN 0 THEN 'exfiltrates_to' WHEN 1 THEN 'transfers_anomalous_volume' ELSE 'contacts_rare_destination' END AS claim FROM pl), f AS (SELECT DISTINCT claim, src_ip AS subject, dst_ip AS object FROM ({EGRESS_SQL})),
c AS (SELECT claim, count(*) FILTER (f.subject IS NOT NULL AND t.subject IS NOT NULL) AS tp, count(*) FILTER (t.subject IS NULL) AS fp, count(*) FILTER (f.subject IS NULL) AS fn FROM f FULL JOIN t USING (claim, subject, object) GROUP BY 1)
SELECT claim, tp, fp, fn, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 4) AS f1 FROM c
"""


def eval_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of generated names that were found, a family being a suffix and a source."""
    model = names.fit_bigrams(views.words(spark, sf_dir))
    found = names.score_domains(views.generated_dns(spark, sf_dir), model, DGA).select("src_ip", "suffix", "label")
    page = F.col("page_id")
    truth = views.read(spark, sf_dir, "pages").where(page % 2 == 0).select(F.lit("10.4.0.0").alias("src_ip"), F.when(page % 3 == 0, "com").when(page % 3 == 1, "net").otherwise("org").alias("suffix"), F.left(F.md5(page.cast("string").cast("binary")), F.lit(12)).alias("label"), F.concat(F.lit("f"), page % 12).alias("family"))
    return incidents.family_match(found, truth, ["src_ip", "suffix", "label"]).select("tp", "fp", "fn", *_r("precision", "recall"))


FAMILIES_SQL = f"""
WITH f AS (SELECT DISTINCT src_ip, suffix, label FROM ({DGA_SQL})), t AS (SELECT DISTINCT '10.4.0.0' AS src_ip, CASE page_id % 3 WHEN 0 THEN 'com' WHEN 1 THEN 'net' ELSE 'org' END AS suffix, left(md5(CAST(page_id AS VARCHAR)), 12) AS label, 'f' || (page_id % 12) AS family FROM pages WHERE page_id % 2 = 0),
c AS (SELECT count(DISTINCT family) AS tp, count(*) FILTER (family IS NULL) AS fp FROM f LEFT JOIN t USING (src_ip, suffix, label)), n AS (SELECT count(DISTINCT family) AS n FROM t)
SELECT tp, fp, n - tp AS fn, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(n, 0), 4) AS recall FROM c, n
"""


def evidence_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that stand for each egress claim: the largest, the smallest and three between."""
    found = network.detect_egress(views.connections(spark, sf_dir), EGRESS, samples=5)
    return found.select("subject", "object", F.explode(F.col("evidence")[0]["samples"]).alias("s")).select("subject", "object", "s.source_file", "s.source_line")


SAMPLES_SQL = f"""
WITH {W}, e AS (SELECT src_ip, dst_ip FROM ({EGRESS_SQL})), r AS (SELECT '10.1.' || (o_custkey // 250) || '.' || (o_custkey % 250) AS src_ip, '192.168.' || (l_suppkey // 250) || '.' || (l_suppkey % 250) AS dst_ip, CAST(floor(l_extendedprice) AS BIGINT) AS b, epoch(l_shipdate) + l_orderkey % 86400 AS ts, l_orderkey * 10 + l_linenumber AS line FROM ol),
n AS (SELECT r.*, row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY b DESC NULLS LAST, ts, line) - 1 AS rn, count(*) OVER (PARTITION BY src_ip, dst_ip) AS n FROM r JOIN e USING (src_ip, dst_ip))
SELECT src_ip AS subject, dst_ip AS object, 'lineitem' AS source_file, line AS source_line FROM n WHERE list_contains(list_transform(range(0, 5), lambda i: CAST(round_even(i * (n - 1) / 4, 0) AS BIGINT)), rn)
"""


def process_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three command lines of each rare process, the first seen first."""
    p = views.processes(spark, sf_dir).withColumns({"command_line": F.concat(F.lit("run "), F.col("source_line") % 5), "user": F.lit(None).cast("string")})
    scored = host.capped(host.score_processes(p, HOST), HOST, "image_name")
    return host.command_samples(scored, p, ["host", "image_name"]).select("host", "image_name", F.array_join("commands", "|").alias("commands"))


COMMANDS_SQL = f"""
WITH {W}, s AS (SELECT host, image_name FROM ({PROCESS_SQL})), x AS (SELECT host, {_NAME.format(c='image')} AS image_name, 'run ' || (CAST(process_guid AS BIGINT) % 5) AS c, min((ts, CAST(process_guid AS BIGINT))) AS f FROM processes GROUP BY ALL),
k AS (SELECT s.host, s.image_name, c, row_number() OVER (PARTITION BY s.host, s.image_name ORDER BY f, c) AS place FROM s JOIN x ON s.host = x.host AND s.image_name = x.image_name)
SELECT host, image_name, string_agg(c, '|' ORDER BY place) AS commands FROM k WHERE place <= 3 GROUP BY ALL
"""


def named_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Egress claims whose destination resolves from one name only speak of the name."""
    dns = views.dns(spark, sf_dir).withColumn("answers", F.concat(F.lit("192.168.0."), F.col("source_line") % 200))
    found = intel.name_objects(network.detect_egress(views.connections(spark, sf_dir), EGRESS), intel.observed_names(dns))
    return found.select("subject", "object_type", "object", *_r("score"))


OBJECTS_SQL = f"""
WITH {W}, n AS (SELECT '192.168.0.' || (page_id % 200) AS dst_ip, min(left(md5(CAST(page_id AS VARCHAR)), 8 + page_id % 20) || '.' || host) AS name FROM pg WHERE host <> '' GROUP BY 1 HAVING count(DISTINCT left(md5(CAST(page_id AS VARCHAR)), 8 + page_id % 20) || '.' || host) = 1)
SELECT src_ip AS subject, CASE WHEN name IS NULL THEN 'ip' ELSE 'domain' END AS object_type, coalesce(name, dst_ip) AS object, score FROM ({EGRESS_SQL}) LEFT JOIN n USING (dst_ip)
"""

def named_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans and egress in one run whose subjects are named by the asset register and whose objects by what was resolved."""
    conn = views.connections(spark, sf_dir)
    dns = views.dns(spark, sf_dir).withColumn("answers", F.concat(F.lit("192.168.0."), F.col("source_line") % 200))
    statements = intel.applied_assets(views.assets(spark, sf_dir), intel.capture_window(conn))
    telemetry = detectors.Telemetry(conn, statements=statements, names=intel.observed_names(dns))
    found, _ = detectors.detect_all(telemetry, [d for d in ALL if d.name in ("fanout", "egress")])
    return found.select("predicate", "subject_type", "subject", "object_type", "object", F.size("evidence").alias("evidence"), *_r("score"))


NAMED_SQL = f"""
WITH {W}, wi AS (SELECT CAST(DATE '1970-01-01' + INTERVAL 1 SECOND * min(ts) AS DATE) AS s, CAST(DATE '1970-01-01' + INTERVAL 1 SECOND * max(ts) AS DATE) AS e FROM connections),
st AS (SELECT address, hostname FROM assets, wi WHERE CASE WHEN stated IS NULL THEN true WHEN stated > e THEN true ELSE date_diff('day', stated, s) <= 730 END),
n AS (SELECT '192.168.0.' || (page_id % 200) AS dst_ip, min(left(md5(CAST(page_id AS VARCHAR)), 8 + page_id % 20) || '.' || host) AS name FROM pg WHERE host <> '' GROUP BY 1 HAVING count(DISTINCT left(md5(CAST(page_id AS VARCHAR)), 8 + page_id % 20) || '.' || host) = 1),
f AS (SELECT 'scans' AS predicate, src_ip, 'port' AS object_type, CAST(dst_port AS VARCHAR) AS object, score FROM ({FANOUT_SQL}) UNION ALL SELECT claim, src_ip, CASE WHEN name IS NULL THEN 'ip' ELSE 'domain' END, coalesce(name, dst_ip), score FROM ({EGRESS_SQL}) LEFT JOIN n USING (dst_ip))
SELECT predicate, CASE WHEN hostname IS NULL THEN 'ip' ELSE 'host' END AS subject_type, coalesce(hostname, src_ip) AS subject, object_type, object, CASE WHEN hostname IS NULL THEN 1 ELSE 2 END AS evidence, score FROM f LEFT JOIN st ON st.address = f.src_ip
"""

CLAIMS_SQL = r"""
WITH c AS (SELECT conv_id || ':' || turn AS id, any_value(conv_id) AS conv_id, any_value(turn) AS turn, min(text) AS text FROM conversations GROUP BY 1),
e AS (SELECT id, list_distinct(list_concat(list_concat(regexp_extract_all(lower(text), '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b'), regexp_extract_all(lower(text), '\b(?:[a-z0-9-]+\.)+[a-z]{2,}\b')), list_transform(regexp_extract_all(lower(text), '\bport ([0-9]{1,5})\b', 1), lambda x: 'port ' || x))) AS named FROM c),
k AS (SELECT c.id, c.turn, CASE c.turn % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS n, CASE c.turn % 3 WHEN 1 THEN c.conv_id || ':' || (c.turn - 1) WHEN 2 THEN c.id END AS a, CASE c.turn % 3 WHEN 2 THEN c.conv_id || ':' || (c.turn + 1000) END AS b FROM c),
j AS (SELECT k.id, n, CAST(x.id IS NOT NULL AS INTEGER) + CAST(y.id IS NOT NULL AS INTEGER) AS there, e.named, list_concat(coalesce(x.named, []), coalesce(y.named, [])) AS known FROM k JOIN e USING (id) LEFT JOIN e x ON x.id = k.a LEFT JOIN e y ON y.id = k.b),
m AS (SELECT *, list_sort(list_filter(named, lambda v: NOT list_contains(known, v))) AS missing FROM j)
SELECT id AS claim_id, CASE WHEN n = 0 THEN 'no_citation' WHEN there < n THEN 'unresolved_citation' WHEN len(missing) > 0 THEN 'ungrounded_entity' ELSE 'grounded' END AS verdict, array_to_string(missing, ',') AS missing FROM m
"""

# ---------------------------------------------------------------- more sources


def src_netflow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The connections written as labelled flows and parsed again."""
    c = views.connections(spark, sf_dir).withColumn("sport", 1024 + F.col("source_line") % 1000)
    stamp = F.date_format(F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")), "yyyy-MM-dd HH:mm:ss.SSS")
    label = F.when(F.col("dst_port") % 3 == 0, "flow=From-Botnet-V1").when(F.col("dst_port") % 3 == 1, "flow=Normal").otherwise("flow=Background")
    cols = [stamp, F.lit("0.5"), F.lit("TCP\t"), F.concat_ws(":", "src_ip", "sport"), F.lit("->"), F.concat_ws(":", "dst_ip", "dst_port"), F.lit("PA_"), F.lit("0"), F.lit("4"), F.col("orig_bytes").cast("string"), F.lit("1"), label]
    parsed = text.parse_netflow(c.select(F.concat_ws("\t", *cols).alias("line"), "source_file", F.lit(None).cast("long").alias("source_line")))
    return parsed.select("src_ip", "src_port", "dst_ip", "dst_port", "proto", "orig_bytes", "conn_state", "label", F.floor("ts").cast("long").alias("second"))


SRC_NETFLOW_SQL = f"""WITH {W} SELECT '10.1.' || (o_custkey // 250) || '.' || (o_custkey % 250) AS src_ip, CAST(1024 + (l_orderkey * 10 + l_linenumber) % 1000 AS INTEGER) AS src_port, '192.168.' || (l_suppkey // 250) || '.' || (l_suppkey % 250) AS dst_ip, 440 + l_linenumber AS dst_port, 'tcp' AS proto, CAST(floor(l_extendedprice) AS BIGINT) AS orig_bytes, 'PA_' AS conn_state,
CASE (440 + l_linenumber) % 3 WHEN 0 THEN 'botnet' WHEN 1 THEN 'normal' ELSE 'background' END AS label, CAST(floor(epoch(l_shipdate) + l_orderkey % 86400) AS BIGINT) AS second FROM ol"""


def src_dns_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names written in both sensor dialects and as passive DNS, and parsed again."""
    d = views.dns(spark, sf_dir)
    page = F.col("source_line")
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    tsv = d.where(page % 3 == 0).select(F.concat_ws("\t", dash("ts"), dash("src_ip"), dash("query"), dash("qtype"), F.lit("9"), dash("rcode"), F.replace(dash("answers"), F.lit(";"), F.lit(","))).alias("line"), F.lit("dns.log").alias("source_file"), "source_line")
    head = _header(spark, "ts\tid.orig_h\tquery\tqtype_name\tqtype_name\trcode_name\tanswers", "dns.log")
    body = F.to_json(F.struct("ts", F.col("src_ip").alias("id.orig_h"), "query", F.col("qtype").alias("qtype_name"), F.lit(1).alias("qtype"), F.col("rcode").alias("rcode_name"), F.split("answers", ";").alias("answers")))
    lines = tsv.unionByName(head).unionByName(d.where(page % 3 == 1).select(body.alias("line"), F.lit("dns.json.log").alias("source_file"), "source_line"))
    passive = d.where(page % 3 == 2).select(F.concat_ws("||", F.col("ts").cast("string"), "src_ip", F.lit("8.8.8.8"), F.lit("IN"), F.concat("query", F.lit(".")), "qtype", F.coalesce("answers", F.lit("")), F.lit("60"), F.lit("1")).alias("line"), F.lit("x.passivedns").alias("source_file"), "source_line")
    return text.parse_dns(lines).unionByName(text.parse_passivedns(passive)).select("src_ip", "query", "qtype", "rcode", F.nullif("answers", F.lit("")).alias("answers"), "source_line", *_r("ts"))


SRC_DNS_SQL = f"WITH {W} SELECT src_ip, query, qtype, CASE WHEN CAST(ts / 10 AS BIGINT) % 3 <> 2 THEN rcode END AS rcode, answers, CAST(ts / 10 AS BIGINT) AS source_line, round(CAST(ts AS DOUBLE), 4) AS ts FROM dns"


def src_ssl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The TLS sessions written as sensor log lines and parsed again."""
    s = views.ssl(spark, sf_dir).withColumn("ok", F.when(F.col("source_line") % 3 == 0, "T").when(F.col("source_line") % 3 == 1, "F").otherwise("-"))
    part = [F.coalesce(F.col(n).cast("string"), F.lit("-")) for n in ("ts", "src_ip", "dst_ip", "ja3", "ok")]
    lines = s.select(F.concat_ws("\t", *part).alias("line"), F.lit("ssl.log").alias("source_file"), "source_line")
    return text.parse_ssl(lines.unionByName(_header(spark, "ts\tid.orig_h\tid.resp_h\tja3\testablished", "ssl.log"))).select("src_ip", "dst_ip", "ja3", "established", "source_line")


SRC_SSL_SQL = f"WITH {W} SELECT '10.5.0.' || user_id AS src_ip, '172.16.0.' || (k % 9) AS dst_ip, CASE WHEN event_type = 'signup' THEN NULL WHEN event_type IN ('view', 'click') THEN md5('common') ELSE md5((user_id % 75) || '-' || event_type) END AS ja3, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS established, event_id AS source_line FROM ev"


def src_indicator_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed written as an indicator file with a header and rejects, and parsed again."""
    s = views.indicators(spark, sf_dir)
    k = F.col("source_line")
    attributes = F.concat_ws(" ", F.when(k % 7 == 0, F.lit("word")).otherwise(F.col("value")), F.when(F.col("added").isNotNull(), F.concat(F.lit("added="), F.col("added").cast("string"))), F.when(k % 2 == 0, F.concat(F.lit("confidence="), F.col("confidence").cast("string"))), F.lit("note=of supplier"))
    head = spark.range(3).select(F.element_at(F.array(F.lit("# name: feed one"), F.lit("# confidence: 40%"), F.lit("# a remark")), (F.col("id") + 1).cast("int")).alias("line"), F.lit("s.ioc").alias("source_file"), (F.col("id") - 3).alias("source_line"))
    parsed = text.parse_indicators(head.unionByName(s.select(attributes.alias("line"), F.lit("s.ioc").alias("source_file"), "source_line")))
    return parsed.select("value", "kind", F.date_format("added", "yyyy-MM-dd").alias("added"), "note", "feed", "source_line", *_r("confidence"))


SRC_INDICATOR_SQL = f"WITH {W} SELECT CASE WHEN line % 7 = 0 THEN 'word' ELSE value END AS value, CASE WHEN line % 7 <> 0 THEN kind END AS kind, strftime(added, '%Y-%m-%d') AS added, 'of supplier' AS note, 'feed one' AS feed, line AS source_line, round(CASE WHEN line % 2 = 0 AND confidence IS NOT NULL THEN confidence ELSE 0.4 END, 4) AS confidence FROM indicators"


def src_asset_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The asset register written as a file and parsed again; what is no address, as 10.1.256.0, is rejected: NULL."""
    a = views.assets(spark, sf_dir)
    lines = a.select(F.concat_ws(" ", "address", "hostname", F.when(F.col("stated").isNotNull(), F.concat(F.lit("stated="), F.col("stated").cast("string")))).alias("line"), F.lit("a.inv").alias("source_file"), "source_line")
    head = spark.range(1).select(F.lit("# stated: 2001-02-03").alias("line"), F.lit("a.inv").alias("source_file"), F.lit(-1).cast("long").alias("source_line"))
    return text.parse_assets(lines.unionByName(head)).select("address", "hostname", F.date_format("stated", "yyyy-MM-dd").alias("stated"), "source_line")


SRC_ASSET_SQL = f"WITH {W} SELECT CASE WHEN len(string_split(address, '.')) = 4 AND list_bool_and(list_transform(string_split(address, '.'), lambda x: coalesce(TRY_CAST(x AS INTEGER) BETWEEN 0 AND 255, false))) THEN address END AS address, hostname, coalesce(strftime(stated, '%Y-%m-%d'), '2001-02-03') AS stated, line AS source_line FROM assets"


QUERIES = {f.__name__: f for f in (det_fanout, findings_all, queue_all, incident_attached, match_ranges, fanout_sketches, named_findings, det_alerts, det_tls, det_egress, det_dnstunnel, det_dga, fit_bigram_model, det_rare_process, det_lineage, host_baseline, process_ancestry, det_intel, intel_indicators, asset_coverage, shared_resolution, det_beaconing, beacon_gaps, gap_selection, pair_summary_merged, incident_queue, incident_summary, incident_sequence, hunt_history, hunt_incremental, hunt_names, fn_names, fn_addresses, eval_truth, claims_check, readiness_report, queue_top, src_conn_lines, src_alert_lines, src_process_lines, incident_entities, spread_alerts, intel_capped, netblock_links, match_ipv6, hunt_pivots, incident_reading, incident_briefs, grammar_rejects, eval_capture, eval_by_claim, eval_families, evidence_samples, process_commands, named_objects, src_netflow_lines, src_dns_lines, src_ssl_lines, src_indicator_lines, src_asset_lines)}
ORACLE_SQL = {
    "det_fanout": FANOUT_SQL, "det_alerts": ALERTS_SQL, "det_tls": TLS_SQL, "det_egress": EGRESS_SQL, "det_dnstunnel": TUNNEL_SQL, "det_dga": DGA_SQL, "fit_bigram_model": BIGRAM_SQL,
    "det_rare_process": PROCESS_SQL, "det_lineage": LINEAGE_SQL, "host_baseline": BASELINE_SQL, "process_ancestry": ANCESTRY_SQL, "det_intel": INTEL_SQL, "intel_indicators": FEED_SQL,
    "asset_coverage": COVERAGE_SQL, "shared_resolution": RESOLUTION_SQL, "beacon_gaps": GAPS_SQL, "det_beaconing": BEACON_SQL, "findings_all": FINDINGS_SQL, "queue_all": QUEUE_ALL_SQL, "incident_attached": ATTACHED_SQL, "incident_sequence": SEQUENCE_SQL, "gap_selection": GAPS_SQL, "pair_summary_merged": MERGED_SQL, "incident_queue": INCIDENT_SQL, "incident_summary": SUMMARY_SQL,
    "hunt_history": HUNT_SQL, "hunt_incremental": HUNT_SQL, "hunt_names": HUNT_NAMES_SQL, "fn_names": NAMES_SQL, "fn_addresses": ADDRESS_SQL, "eval_truth": TRUTH_SQL,
    "readiness_report": READINESS_SQL, "queue_top": QUEUE_SQL, "src_conn_lines": SRC_CONN_SQL, "src_alert_lines": SRC_ALERT_SQL, "src_process_lines": SRC_PROCESS_SQL,
    "incident_entities": ENTITIES_SQL, "spread_alerts": SPREAD_SQL, "claims_check": CLAIMS_SQL, "intel_capped": CAPPED_SQL, "netblock_links": NETBLOCK_SQL, "match_ipv6": IPV6_SQL, "match_ranges": IPV6_SQL, "named_findings": NAMED_SQL, "fanout_sketches": SKETCH_SQL, 
    "hunt_pivots": PIVOTS_SQL, "incident_reading": READING_SQL, "incident_briefs": BRIEFS_SQL, "grammar_rejects": REJECTS_SQL, "eval_capture": CAPTURE_SQL, "eval_by_claim": BY_CLAIM_SQL, "eval_families": FAMILIES_SQL, "evidence_samples": SAMPLES_SQL,
    "process_commands": COMMANDS_SQL, "named_objects": OBJECTS_SQL, "src_netflow_lines": SRC_NETFLOW_SQL, "src_dns_lines": SRC_DNS_SQL, "src_ssl_lines": SRC_SSL_SQL, "src_indicator_lines": SRC_INDICATOR_SQL, "src_asset_lines": SRC_ASSET_SQL,
}
