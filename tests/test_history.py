"""Kept history: batches add up to the history of all rows, and hunts read only what they ask for."""

import random
import re

import pytest
from pyspark.sql import functions as F

from palisade.plans import incidents
from palisade.plans.history import History, merge_hits

CONN = "ts double, src_ip string, dst_ip string, dst_port int"
DNS = "ts double, src_ip string, query string"


@pytest.fixture(scope="module")
def logs(spark):
    rng = random.Random(5)
    # two thirds of all rows meet one destination
    conns = [(float(t), f"10.0.0.{rng.randrange(9)}", "9.9.9.9" if t % 3 else f"8.8.8.{rng.randrange(5)}", rng.choice([443, 53])) for t in range(600)]
    names = [(float(t), f"10.0.0.{rng.randrange(9)}", rng.choice(["a.evil.example", "x.a.evil.example", "notevil.example", "EVIL.example", None])) for t in range(90)]
    return spark.createDataFrame(conns, CONN), spark.createDataFrame(names, DNS), conns, names


@pytest.fixture(scope="module")
def pivots(spark):
    rows = [("f1", "beacons_to", "dst", "9.9.9.9", "exact", "10.0.0.1"), ("f2", "scans", "dst_port", "53", "exact", None), ("f3", "tunnels_dns_over", "domain", "evil.example", "suffix", "10.0.0.2"), ("f4", "beacons_to", "dst", "7.7.7.7", "exact", None)]
    return spark.createDataFrame(rows, "finding_id string, predicate string, field string, value string, match string, excluded string")


def shown(df):
    return sorted((r.finding_id, r.subject, r.events, r.first_seen, r.last_seen) for r in df.collect())


def by_hand(conns, names):
    out = {}

    def met(finding, subject, ts):
        n, a, b = out.get((finding, subject), (0, ts, ts))
        out[finding, subject] = (n + 1, min(a, ts), max(b, ts))

    for ts, src, dst, port in conns:
        if dst == "9.9.9.9" and src != "10.0.0.1":
            met("f1", src, ts)
        if port == 53:
            met("f2", src, ts)
    for ts, src, name in names:
        if name and (name.lower() == "evil.example" or name.lower().endswith(".evil.example")) and src != "10.0.0.2":
            met("f3", src, ts)
    return sorted((f, s, n, a, b) for (f, s), (n, a, b) in out.items())


def test_batches_add_up(spark, tmp_path, logs, pivots):
    c, d, conns, names = logs
    kept = History(spark, str(tmp_path / "kept"), 16)
    hits = None
    for day in range(3):
        kept.add(f"d{day}", connections=c.where(f"ts % 3 = {day}"), dns=d.where(f"ts % 3 = {day}"))
        new = kept.hunt(pivots, [f"d{day}"])
        hits = new if hits is None else merge_hits(hits, new)
    want = by_hand(conns, names)
    assert shown(hits) == shown(kept.hunt(pivots)) == shown(incidents.hunt(pivots, incidents.history(c, dns=d))) == want
    kept.add("d1", connections=c.where("ts % 3 = 1"), dns=d.where("ts % 3 = 1"))  # again: it replaces itself
    assert shown(kept.hunt(pivots)) == want
    one = kept.compacted(str(tmp_path / "one"))
    assert shown(one.hunt(pivots)) == want and one.rows().count() < kept.rows().count()
    assert not one.rows().groupBy("field", "key", "depth", "subject").count().where("count > 1").count()


def test_only_asked_buckets_and_batches_are_read(spark, tmp_path, logs, pivots):
    c, d, _, _ = logs
    kept = History(spark, str(tmp_path / "kept"), 64)
    for day in range(2):
        kept.add(f"d{day}", connections=c.where(f"ts % 2 = {day}"), dns=d.where(f"ts % 2 = {day}"))
    hunted = kept.hunt(pivots.where("finding_id = 'f1'"), ["d1"])
    assert re.search(r"PartitionFilters: \[[^\]]*batch[^\]]*bucket", hunted._jdf.queryExecution().toString())
    want = shown(hunted)
    bucket = spark.range(1).select(kept.bucket(F.lit("dst"), F.lit("9.9.9.9"))).head()[0]
    for file in (tmp_path / "kept").rglob("*.parquet"):  # what isn't asked for isn't opened
        if file.parent != tmp_path / "kept" / "batch=d1" / f"bucket={bucket}":
            file.write_bytes(b"none")
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    assert want and shown(kept.hunt(pivots.where("finding_id = 'f1'"), ["d1"])) == want


def test_edges(spark, tmp_path, logs, pivots):
    c, _, _, _ = logs
    kept = History(spark, str(tmp_path / "kept"), 4)
    kept.add("none", connections=c.where("false"))
    assert not kept.rows().count() and not shown(kept.hunt(pivots))
    assert not shown(kept.hunt(pivots.where("false")))
    with pytest.raises(ValueError):
        kept.add("../up", connections=c)
    with pytest.raises(ValueError):
        kept.compacted(kept.path + "/")
