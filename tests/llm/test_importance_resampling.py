"""Importance resampling against plain Python: features, gains, weights, noise and the draw, one document at a time."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palisade.llm import importance_resampling as ir

from .test_operators import corpus, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def features(text, max_words):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, max_words + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, max_words, buckets, min_words, percent):
    def count(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, max_words))

    s, t = count(x for _, x in docs), count(target)
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        own = features(x, max_words)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(words(x)), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    fit = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = fit[: len(fit) * percent // 100]
    return Counter([(*r, k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in fit[len(drawn) :]] + [(*r, None) for r in rows if r[1] < min_words])


@pytest.fixture(scope="module")
def docs():
    rows, _ = corpus(n=70)
    rng = random.Random(9)
    more = [(300 + i, " ".join(rng.choice(["Alpha", "BETA", "naïve", "x-y", "日本", "ÀB", "ǅx", "K", "0"]) for _ in range(rng.randint(1, 60)))) for i in range(60)]
    return [*rows, *more, (None, "no id " * 30), (None, None), (310, more[10][1]), (310, more[10][1]), (400, "\u0000a\u007fb`c{d" * 9), (401, "word " * 5000), (402, "z" * 9000)]


@pytest.mark.parametrize(("max_words", "buckets", "percent"), [(1, 10000, 10), (2, 97, 50), (3, 1000, 100), (1, 7, 0)])
def test_resampling(spark, docs, max_words, buckets, percent, monkeypatch):
    monkeypatch.setattr(ir, "BLOCK_WORDS", 50)
    target = ["alpha beta, gamma", None, "", "Naïve x y 0 0 0", "abc abd"]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, n_words int")
    got = ir.resample(frame(spark, docs).repartition(3), bench, max_words=max_words, buckets=buckets, percent=percent)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == brute(docs, target, max_words, buckets, 20, percent)


def test_ties_of_scores(spark):
    """Equal scores are cut between ids, wherever the cut falls."""
    rows = spark.createDataFrame([(i, 25, 25, 0, 7 if i % 3 else 9) for i in range(200)] + [(None, 25, 25, 0, 7)], "doc_id long, n_words long, n_features long, weight long, score long").repartition(5)
    order = sorted(range(200), key=lambda i: (-(7 if i % 3 else 9), i))
    for drawn in (0, 1, 67, 68, 100, 200, 201):
        got = {r.doc_id: r["rank"] for r in ir.ranked_first(rows, rows["n_words"] >= 20, drawn).collect()}
        want = {i: k + 1 if k < drawn else None for k, i in enumerate([*order, None])}
        assert got == want


def test_empty_tables(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert ir.resample(frame(spark, []), bench).count() == 0
    got = ir.resample(frame(spark, docs), bench)
    assert Counter(tuple(r) for r in got.collect()) == brute(docs, [], 1, 10000, 20, 10)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=8))
def test_features_of_any_text(texts):
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    text, bucket, times, n_words = ir.features_of(np.frombuffer(b"".join(raw), np.uint8), bounds, 2, 1009)
    want = Counter((i, zlib.crc32(f.encode("utf-8", "surrogatepass")) % 1009) for i, t in enumerate(texts) for f in features(t, 2))
    assert dict(zip(zip(text.tolist(), bucket.tolist()), times.tolist())) == want
    assert n_words.tolist() == [len(words(t)) for t in texts]


def test_matrices_give_the_crc():
    rng = random.Random(3)
    parts = [rng.randbytes(rng.choice([0, 1, 2, 3, 7, 7, 7, 300])) for _ in range(400)]
    at = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    assert ir.crc32_columns(np.frombuffer(b"".join(parts), np.uint8), at[:-1], np.diff(at)).tolist() == [zlib.crc32(p) for p in parts]
