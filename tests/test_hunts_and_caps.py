"""Caps of egress in one pass; hunts that don't shuffle a hit for each finding."""

from palisade.operators import network
from palisade.plans import incidents


def test_both_caps_in_one_pass(spark):
    rows = [("a", "x", "exfiltrates_to", 0.9), ("a", "y", "contacts_rare_destination", 0.95), ("b", "x", "transfers_anomalous_volume", 0.8), ("c", "x", "contacts_rare_destination", 0.5), ("d", "x", "contacts_rare_destination", 0.6)]
    scored = spark.createDataFrame(rows, "src_ip string, dst_ip string, claim string, score double")
    capped = network.strongest_claims(scored, network.EgressParams(top=1, top_rare=1))
    assert "Union" not in capped._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.src_ip for r in capped.collect()) == ["a", "d"]


def test_a_hunt_folds_before_findings_are_told_apart(spark):
    p = spark.createDataFrame([("f1", "dst_port", "80", "exact", "a"), ("f2", "dst_port", "80", "exact", "b")], "finding_id string, field string, value string, match string, excluded string")
    c = spark.createDataFrame([("a", "x", 80, 1.0), ("b", "x", 80, 2.0), ("b", "y", 80, 3.0), ("b", "y", 81, 4.0)], "src_ip string, dst_ip string, dst_port int, ts double")
    hits = incidents.hunt(p, incidents.sighted(c))
    want = [("f1", "b", 2, 2.0, 3.0), ("f2", "a", 1, 1.0, 1.0)]
    assert sorted(tuple(r) for r in hits.collect()) == want == sorted(tuple(r) for r in incidents.hunt(p, incidents.history(c)).collect())
    plan = hits._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [x for x in plan if "Aggregate [" in x and "finding_id" in x and "subject" in x]
