"""What the learnt operators train on, and the language model against an exact kernel ridge regression."""

import os
import random
import re
import subprocess
import sys

import numpy as np
import pytest

from palisade.llm import language_id, toxicity

PARTS = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ein"], "cc": ["eau", "oi", "ç"]}


def samples(n=24, seed=4):
    rng = random.Random(seed)
    return [(i, " ".join("".join(rng.choice(PARTS[lang]) for _ in range(3)) for _ in range(rng.randint(3, 20))), lang) for i, lang in enumerate(sorted(PARTS) * n)]


def grams(text):
    """Character grams of up to four, within words and with one blank at each end of a word."""
    out = set()
    for word in re.findall(r"[a-z\x80-\U0010ffff]+", text.lower()):
        bounded = f" {word} "
        out |= {word[i] for i in range(len(word))}
        for n in (2, 3, 4):
            out |= {bounded[i : i + n] for i in range(len(bounded) - n + 1)}
    return out


def test_equals_exact_kernel_ridge():
    """With every training text a landmark, the map is that of the whole kernel."""
    rows = samples()
    texts, langs = [t for _, t, _ in rows], [lang for *_, lang in rows]
    model = language_id.train_model(texts, langs, landmarks=3 * len(texts))
    new = [t for _, t, _ in samples(6, seed=11)]

    def kernel(a, b):
        return np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in map(grams, b)] for x in map(grams, a)])

    names = sorted(PARTS)
    own, other = kernel(texts, texts), kernel(new, texts)
    y = np.where(np.array(langs)[:, None] == np.array(names), 1.0, -1.0)
    n = len(texts)
    middle = np.eye(n) - 1 / n  # equal shares of the languages, so plain centring
    dual = np.linalg.solve(middle @ own @ middle + language_id.RIDGE * np.eye(n), y - y.mean(0))
    want = (other - own.mean(0)) @ middle @ dual + y.mean(0)
    got = model.kernels(new) @ model.weights + model.bias
    assert (got.argmax(1) == want.argmax(1)).all() and np.abs(got - want).max() < 0.03


def test_language_sample(spark):
    rows = [*samples(), (500, "mi" * 4000, "aa"), (501, None, "aa"), (None, "lo lo", "aa"), (3, "ka lo mi", "aa"), (3, "ka lo mi", "aa"), (3, "ka lo mi ka", "aa"), (3, "eau", "cc")]
    frame = spark.createDataFrame(rows, "id long, text string, lang string").where("id IS NOT NULL AND text IS NOT NULL").repartition(3)
    every = language_id.training_rows(frame, 100, 4 << 20, 400).collect()
    assert sorted((r.id, r.lang) for r in every) == sorted({(i, lang) for i, t, lang in rows if i is not None and t})
    assert [r.text for r in every if (r.id, r.lang) == (3, "aa")] == [min((t for i, t, lang in rows if i == 3 and lang == "aa"), key=len)]
    few = language_id.training_rows(frame, 5, 4 << 20, 400).collect()
    assert {lang: sum(r.lang == lang for r in few) for lang in PARTS} == dict.fromkeys(PARTS, 5)
    by_hash = sorted((r.h, r.id, r.lang) for r in every)
    assert {(r.id, r.lang) for r in few} == {(i, lang) for want in PARTS for _, i, lang in [k for k in by_hash if k[2] == want][:5]}
    small = language_id.training_rows(frame, 100, 1200, 400).collect()  # the long text, wherever its hash lies, takes no room
    assert {r.lang for r in small} == set(PARTS) and all(len(r.text.encode()) <= 150 for r in small)
    assert all(sum(len(r.text.encode()) for r in small if r.lang == lang) <= 1200 for lang in PARTS)
    with pytest.raises(ValueError):
        language_id.training_rows(frame, 5, 4 << 20, 2)


def test_language_parameters(spark):
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in samples()], "doc_id long, text string, lang string, lang_pred string, score double")
    few = language_id.fit(docs, features=10)
    assert few.landmarks.shape[1] == 10 < language_id.fit(docs).landmarks.shape[1]
    got = language_id.predict(docs, language_id.fit(docs)).collect()
    assert sum(r.lang_pred == dict((i, lang) for i, _, lang in samples())[r.doc_id] for r in got) == len(got)
    huge = docs.unionByName(docs.limit(0)).withColumn("text", docs["text"])
    assert language_id.fit(huge, max_bytes=8).langs == []


def test_toxicity_sample(spark):
    rows = [(i, f"text number {i}" + " bad" * (i % 2)) for i in range(60)]
    docs = spark.createDataFrame([*rows, *[(i, "long " * 5000) for i in range(60, 64)], (5, "repeated, longer text"), (6, rows[6][1]), (70, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(71)] + [(5, 1), (None, 1), (71, 2)], "doc_id long, toxic int")
    got = toxicity.training_rows(docs, labels, "doc_id", "text", "toxic", 100, 24 << 20).collect()
    import zlib

    learnt = [i for i in range(64) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted(r.id for r in got) == learnt
    small = toxicity.training_rows(docs, labels, "doc_id", "text", "toxic", 100, 400).collect()  # texts of over 50 bytes stay out
    assert {r.y for r in small} == {0, 1} and all(len(r.text) <= 50 for r in small) and all(sum(len(r.text) for r in small if r.y == y) <= 400 for y in (0, 1))
    few = toxicity.training_rows(docs, labels, "doc_id", "text", "toxic", 4, 24 << 20).collect()
    assert [sum(r.y == y for r in few) for y in (0, 1)] == [4, 4]


def test_training_gives_its_memory_back():
    """What training took stayed with the driver's Python, beside the JVM, for all stages that follow."""
    code = """
import re, random
import numpy as np
from palisade.llm import toxicity
mb = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
rng = random.Random(1)
words = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(20000)]
texts = [" ".join(rng.choices(words, k=800)) for _ in range(600)]
toxicity.LEAST_STEPS = 1
toxicity.train_model(texts[:8], np.arange(8) % 2, rounds=1)
before = mb()
model = toxicity.train_model(texts, np.arange(600) % 2, rounds=1)
print(mb() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=100, env=os.environ | {"OMP_NUM_THREADS": "1"})
    assert float(out.stdout) < 20, out


@pytest.mark.parametrize("block", [1 << 10, 1 << 14, 1 << 20])
def test_training_set_is_the_same_in_blocks_of_any_size(block, monkeypatch):
    texts = [f"alpha beta w{i % 7} gamma{i % 3} it's" for i in range(300)] + ["", "!", "omega " * 50]
    monkeypatch.setattr(toxicity, "TRAIN_BLOCK", block)
    data = toxicity.training_set(texts)
    grams = [tuple(data.grams[data.first[w] : data.first[w] + data.size[w]]) for w in data.word]
    whole = toxicity.segmented(texts)
    plain = [[] for _ in whole.word_share]
    for g, w in zip(whole.grams, whole.gram_word):
        plain[w].append(int(g))
    assert [sorted(g) for g in grams] == [sorted(g) for g in plain]
    assert data.segment.tolist() == whole.word_segment.tolist() and data.segment_text.tolist() == whole.segment_text.tolist()
    assert len(data.first) == len({tuple(sorted(g)) for g in plain})
