"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

Rows are told apart by their id: where rows repeat an id, a decision on one of them holds for all of them (but of equal
rows the exact deduplication keeps one). A null id is an id like any other, but no document without an id goes
as a near copy. Null texts count as empty: they have
the score of the bias, of all of them one stays, they link with nothing, hold no benchmark window and pack as the end id. Texts
of any length are worked on whole. Empty tables give empty results, and without labels nothing is toxic. Extra columns pass
through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import decontamination, exact_dedup, jaccard_join, packing, toxicity
from palisade.llm.common import stored, table


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches the threshold go."""
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return _without(docs, stored(scored.where(F.col("score") >= toxicity.THRESHOLD).select("doc_id"), "toxic"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    classes = stored(jaccard_join.jaccard_classes(docs).select("doc_id", "component_id"), "classes")
    return _without(docs, classes.where("component_id < doc_id").select("doc_id"))


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, stored(found.where(F.size("spans") > 0).select("doc_id"), "leaked"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces with their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaked),
    ("best-fit packing", pack_sequences),
]
#: A learnt score and the packing can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
