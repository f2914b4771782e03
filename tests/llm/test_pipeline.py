"""The pipeline's stages on a small table, each against what its operator says."""

import pytest

import corpus_pipeline
from palisade.llm import decontamination, toxicity

from .test_operators import brute_shingles, corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, passage = corpus(n=80)
    path = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, (t or "") + (" nastyfool" if i % 4 == 0 and t else ""), "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows if i < 60], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "benchmark"))
    columns, before = docs.columns, docs
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, folder)
        assert after.columns == columns
        ids = {r.doc_id for r in after.collect()}
        assert ids <= {r.doc_id for r in before.collect()}
        kept.append(ids)
        before = after
    model = toxicity.fit(docs, labels)
    assert kept[0] == {r.doc_id for r in toxicity.score(docs, model).collect() if r.score < toxicity.THRESHOLD}
    texts = [r.text for r in docs.collect() if r.doc_id in kept[1]]
    assert len(set(texts)) == len(texts) == len({r.text for r in docs.collect() if r.doc_id in kept[0]})
    sets = {r.doc_id: brute_shingles(r.text) for r in docs.collect() if r.doc_id in kept[1]}
    near = {i: {j for j in sets if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])} for i in sets}
    for _ in sets:  # each document's smallest reachable id, by repeated minima
        near = {i: set().union(n, *(near[j] for j in n)) for i, n in near.items()}
        if all(near[i] == set().union(*(near[j] for j in near[i])) for i in near):
            break
    assert kept[2] == {i for i in sets if i == min(near[i] | {i})} and len(kept[2]) < len(kept[1])
    assert all(not r.spans for r in decontamination.find_contamination(before, bench).collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, before, folder)
    assert {r.doc_id for r in packed.collect()} == kept[-1]
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == kept[-1]
