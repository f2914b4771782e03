"""The audit of filters against applying every order of them document by document."""

import re
from collections import defaultdict
from fractions import Fraction
from itertools import combinations, permutations
from math import factorial

from palisade.llm import filter_audit
from pyspark.sql import functions as F

ROWS = [
    (1, "word " * 250, "s1"), (2, "word " * 250, "s1"), (3, "AB cd & " * 3, "s1"), (4, None, None), (5, "", ""), (6, None, "s2"),
    (7, " ".join(f"w{i}" for i in range(300)), "s2"), (8, " ".join(f"w{i}" for i in range(300)), "s1"), (9, "é " * 199 + "É x", "s2"),
    (9, "x" * 50, "s2"), (9, "x" * 50, "s2"), (None, "x" * 50, "s2"), (None, "word " * 250, "s1"), (10, "x" * 50, "s1"), (11, "a\u0085b\t\x0bc\x1cd | " * 70, "s3"),
    *[(i, "hot & HOT", "s1") for i in range(100, 140)], *[(i, " ".join(f"L{j % (3 * i)}" for j in range(90 * i)), "s4") for i in range(20, 25)],
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, 0, 1), (101, 1, None), (102, None, 1), (None, 1, 1), (8, 1, 0), (9, 1, 1)]


def brute(rows, labels):
    """One dictionary per (part, order, step), by applying the filters in turn to each document."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = defaultdict(list)
    for i, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = i is not None and t in first and first[t] < i
        docs[part or ""].append((fails, i is not None and any(a == i and q == 1 for a, q, _ in labels), i is not None and any(a == i and x == 1 for a, _, x in labels)))
    out = {}
    for part, own in docs.items():
        total = defaultdict(int)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order):
                gone = [d for d in left if d[0][f]]
                stay = [d for d in left if not d[0][f]]
                total[f] += len(gone)
                row = [len(stay), len(gone), sum(d[0][f] for d in own) - len(gone), sum(d[0][f] and sum(d[0].values()) == 1 for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone)]
                out[part, "".join(order), step + 1] = row
                left = stay
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def test_every_order_and_step(spark):
    docs = spark.createDataFrame([(*r, "x", 1, True) for r in ROWS], "doc_id long, text string, source string, part string, mask int, first boolean").repartition(3)
    labels = spark.createDataFrame([(*r, "z") for r in LABELS], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.audit_filters(docs, labels)
    want = brute(ROWS, LABELS)
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got.collect()} == want
    assert got.count() == len(want) == 600 * 5
    none = filter_audit.audit_filters(docs, None)
    assert not none.where("good_lost <> 0 OR toxic_lost <> 0").count() and none.count() == len(want)
    assert filter_audit.audit_filters(docs.limit(0), labels).count() == 0
    assert not filter_audit.audit_filters(docs, labels.limit(0)).where("good_lost <> 0").count()


def test_other_filters(spark):
    """The operator takes any filters of a text; copies come last."""
    docs = spark.createDataFrame([(1, "aa", "s"), (2, "aa", "s"), (3, "b", "s"), (4, "", "s")], "doc_id long, text string, source string")
    got = filter_audit.audit_filters(docs, None, lambda t: {"A": F.length(t) < 1, "B": t.contains("a")}).collect()
    assert len(got) == 18
    by = {(r.filter_order, r.step): r for r in got}
    assert (by["BCA", 1].removed, by["BCA", 2].removed, by["BCA", 2].redundant, by["BCA", 3].removed, by["BCA", 3].kept) == (2, 0, 1, 1, 1)
    assert by["CBA", 1].shapley == 3 and by["ABC", 2].shapley == 9 and by["ABC", 1].shapley == 6


def test_least_squares_give_shapley_values():
    for n in range(1, 6):
        rows = filter_audit.shapley_weights(n)
        for i, row in enumerate(rows):
            for c, w in enumerate(row):  # the textbook's sum over coalitions
                s = c.bit_count()
                want = Fraction(factorial(s - 1) * factorial(n - s)) if c >> i & 1 else -Fraction(factorial(s) * factorial(n - s - 1))
                assert w == want
        assert all(sum(row[c] for row in rows) == 0 for c in range(1, (1 << n) - 1)) and len(list(combinations(range(n), 1))) == n
