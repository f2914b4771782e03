"""Audit of how filters of a corpus interact: every order of applying them, told from which documents fail which filters.

1. Each document becomes a mask of the filters that it fails. Masks are counted by part; a part has at most ``2 ** filters``
   of them, so whatever comes after works on counts.
2. For each part the removals of all coalitions of filters are tabulated: a coalition removes the documents that fail any of
   its filters. A step of an order removes the difference of two coalitions, the filters before it with and without its own.
3. Shapley values come from constrained least squares: among all additive games whose total is that of the removals, the one
   nearest to them when coalitions weigh as the Shapley kernel says. The normal equations with the constraint's multiplier are
   solved in rationals. They are linear in the removals, so they are solved once for each coalition's unit game and the
   solution is applied to every part; times the number of orders it is in whole numbers.

Texts are read once. Copies are told by SHA-256: the smallest id of each digest is found with partial sums on the map side, and a
document is compared with it by (id, digest), so that neither a text nor a part that a third of all rows share is one task's work.

Defined edge cases: a null text is empty, a null part is the empty string; a null id has no smaller one and is smaller than none, so
it neither is a copy nor makes one; rows that repeat an id are counted each, and aren't copies of one another; a document is good
(toxic) if any row of its id in the labels says 1; without labels nothing is; texts of any length are judged whole; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table

MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 2
SYMBOLS = "[#$%&*|]"


def quality_failures(text: Column) -> dict[str, Column]:
    """Failure of each filter that looks at one text: too few words, too repetitive, shouting, holding symbols."""
    words = F.array_remove(F.split(text, r"[ \t-\r]+"), "")
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > MAX_UPPER_PERCENT * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def failure_masks(docs: DataFrame, failures=quality_failures, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, doc_id, mask`` of each row: bit i for the i-th failure, the bit after the last one for a copy."""
    base = docs.select(F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = list(failures(F.col("text")).values())
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(found)), F.lit(0))
    rows = stored(base.select("part", "doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), bits.alias("bits")), "masks")
    firsts = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(firsts, ["doc_id", "digest"], "left").select("part", "doc_id", (F.col("bits") + F.when(copy, 1 << len(found)).otherwise(0)).alias("mask"))


def with_labels(masks: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Adds ``good`` and ``toxic``, 0 or 1."""
    if labels is None:
        return masks.withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return masks.join(known, "doc_id", "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("good", "toxic")})


def shapley_weights(players: int) -> list[list[int]]:
    """For each player the weights of the ``2 ** players`` coalition values in its Shapley value, times ``players!``."""
    n, games = players, 1 << players
    kernel = {s: Fraction(n - 1, comb(n, s) * s * (n - s)) for s in range(1, n)}
    weight = [kernel.get(c.bit_count(), Fraction(0)) for c in range(games)]
    inside = [[c >> i & 1 for i in range(n)] for c in range(games)]
    # One row for each player and one for the constraint; unknowns are the values and the constraint's multiplier.
    left = [[sum(weight[c] * inside[c][i] * inside[c][j] for c in range(games)) for j in range(n)] + [Fraction(1)] for i in range(n)]
    left.append([Fraction(1)] * n + [Fraction(0)])
    right = [[weight[c] * inside[c][i] for c in range(games)] for i in range(n)]
    for row in right:  # values count from the empty coalition's
        row[0] -= sum(row)
    right.append([Fraction(int(c == games - 1) - int(c == 0)) for c in range(games)])
    system = [a + b for a, b in zip(left, right)]
    for k in range(n + 1):
        pivot = next(r for r in range(k, n + 1) if system[r][k])
        system[k], system[pivot] = system[pivot], system[k]
        system[k] = [x / system[k][k] for x in system[k]]
        for r in range(n + 1):
            if r != k and system[r][k]:
                system[r] = [x - system[r][k] * y for x, y in zip(system[r], system[k])]
    whole = [[x * factorial(n) for x in row[n + 1 :]] for row in system[:n]]
    assert all(x.denominator == 1 for row in whole for x in row)
    return [[int(x) for x in row] for row in whole]


def coalition_removals(rows: DataFrame, filters: int) -> DataFrame:
    """One row per part: ``documents`` and arrays ``removed, good, toxic`` by coalition, from rows ``part, mask, good, toxic``."""
    counted = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    masks = counted.groupBy("part").agg(F.sum("n").alias("documents"), F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # at most 2 ** filters

    def removed(field: str) -> Column:
        def of(coalition: Column) -> Column:
            failing = F.filter("masks", lambda m: m["mask"].bitwiseAND(coalition) != 0)
            return F.aggregate(failing, F.lit(0).cast("long"), lambda total, m: total + m[field])

        return F.transform(F.sequence(F.lit(0), F.lit((1 << filters) - 1)), of)

    return masks.select("part", "documents", removed("n").alias("removed"), removed("good").alias("good"), removed("toxic").alias("toxic"))


def audit(rows: DataFrame, filters: str) -> DataFrame:
    """One row per part, order of ``filters`` (a letter each) and step, from rows ``part, mask, good, toxic``."""
    n = len(filters)
    everything = (1 << n) - 1
    orders = ["".join(o) for o in permutations(sorted(filters))]
    which = [filters.index(letter) for o in orders for letter in o]
    before = [sum(1 << filters.index(letter) for letter in o[:k]) for o in orders for k in range(n)]
    weights = shapley_weights(n)
    tabled = coalition_removals(rows, n)
    values = [sum((F.col("removed")[c] * w for c, w in enumerate(row) if w), F.lit(0).cast("long")) for row in weights]
    tabled = stored(tabled.withColumn("shapley", F.array(*values)), "coalitions")

    steps = tabled.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(len(which) - 1))))
    at = F.col("at")
    steps = steps.withColumns({"which": F.element_at(F.lit(which), at + 1), "had": F.element_at(F.lit(before), at + 1)})

    def value(field: str, coalition: Column) -> Column:
        return F.element_at(F.col(field), coalition + 1)

    had = F.col("had")
    own = F.element_at(F.lit([1 << i for i in range(n)]), F.col("which") + 1)
    after = had + own
    removed = value("removed", after) - value("removed", had)
    return steps.select(
        "part", F.element_at(F.lit(orders), F.floor(at / n).cast("int") + 1).alias("filter_order"), (at % n + 1).cast("int").alias("step"),
        (F.col("documents") - value("removed", after)).alias("kept"), removed.alias("removed"), (value("removed", own) - removed).alias("redundant"),
        (value("removed", F.lit(everything)) - value("removed", F.lit(everything) - own)).alias("unique_fails"),
        (value("good", after) - value("good", had)).alias("good_lost"), (value("toxic", after) - value("toxic", had)).alias("toxic_lost"),
        F.element_at(F.col("shapley"), F.col("which") + 1).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame | None, failures=quality_failures, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The audit of the text filters and, last, the removal of copies."""
    names = list(failures(F.lit("")))
    copies = chr(ord(max(names)) + 1)
    return audit(with_labels(failure_masks(docs, failures, id_col, text_col, part_col), labels), "".join(names) + copies)


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Every source of ``documents``, every order of five filters, every step."""
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts),
flags AS (SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM words),
marked AS (SELECT f.doc_id, f.part, map(['A', 'B', 'C', 'D', 'E'], [a, b, c, d, e]) AS fails,
    CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) + CAST(d AS INT) + CAST(e AS INT) AS n_fails,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id AND l.quality = 1) AS good,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id AND l.toxic = 1) AS toxic FROM flags f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
    WHERE p.x NOT IN (q.x, r.x, s.x, t.x) AND q.x NOT IN (r.x, s.x, t.x) AND r.x NOT IN (s.x, t.x) AND s.x <> t.x),
steps AS (SELECT filter_order, CAST(step AS INT) AS step, filter_order[step] AS x FROM orders, range(1, 6) r(step)),
judged AS (SELECT m.*, s.*, fails[s.x] AS failing,
    len(list_filter(range(1, s.step), lambda k: fails[s.filter_order[k]])) > 0 AS gone FROM marked m, steps s),
counted AS (SELECT part, filter_order, step, x, CAST(count(*) FILTER (NOT gone AND NOT failing) AS BIGINT) AS kept,
    CAST(count(*) FILTER (failing AND NOT gone) AS BIGINT) AS removed, count(*) FILTER (failing AND gone) AS redundant,
    count(*) FILTER (failing AND n_fails = 1) AS unique_fails, count(*) FILTER (failing AND NOT gone AND good) AS good_lost,
    count(*) FILTER (failing AND NOT gone AND toxic) AS toxic_lost FROM judged GROUP BY ALL)
SELECT * EXCLUDE (x), CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM counted
"""
