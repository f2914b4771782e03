"""Language identification by string kernels: blended-spectrum presence kernels, Nyström landmarks, ridge regression.

The kernel of two texts is the number of 1- to 4-grams of characters (within and around words) that both have, over the
geometric mean of how many each has. Landmarks are training texts; a text is mapped to its kernels with the landmarks times
the inverse root of their own kernel matrix, and a ridge regression for each language against the rest runs on that map.
Only grams of the landmarks can meet, so a batch of texts is a 0/1 matrix over these (over the ``features`` commonest of
them, if that parameter is given), and scoring is two matrix products.

Training texts are a bounded sample: at most ``per_lang`` of each language, those with the smallest hash of their id, with at
most ``max_bytes`` of text in a language, none of them over an eighth of that; the first ``LANDMARKS`` of all, dealt evenly to the languages, are the landmarks.
The sample takes two scans of the ids, whatever the number of languages. Scoring is row-local: one scan, no shuffle.

Defined edge cases: a null text or one without a letter is ``und`` with score 0; a letter that no landmark has counts for
nothing; of rows that repeat an id, the shortest one trains; a language with only oversized texts isn't learnt; without training texts everything is ``und``; more than ``max_langs``
languages are refused; a text of any length is scored whole (about 60 bytes of memory for each of its characters); an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, table, texts_of
from .toxicity import id_crc

GRAMS = (1, 2, 3, 4)
LANDMARKS = 160
PER_LANG, MAX_BYTES = 500, 4 << 20
#: A text of more than this part of ``max_bytes`` isn't learnt from: it would leave no room for others.
LARGEST_SHARE = 8
MAX_LANGS = 400
BUCKETS = 1 << 20
RIDGE = 0.1
#: Sharpness of the score's softmax over the regressions' values.
SHARP = 6.0
BLOCK_TEXTS, BLOCK_CHARS = 128, 1 << 20


def gram_hashes(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each gram length: (bucket, text number) of every gram. Runs of other than letters are one boundary."""
    low = [t.lower() for t in texts]
    raw = np.frombuffer(("\0" + "\0".join(low) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) + 1 for t in low])
    owner = np.concatenate(([0], owner)).astype(np.int32)
    letter = ((raw >= 97) & (raw <= 122)) | (raw > 127)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other sign behind a word stands for the boundary
    chars = np.where(letter, raw, np.uint32(1))[keep]
    owner = owner[keep]
    chars, owner = np.concatenate(([np.uint32(1)], chars)), np.concatenate((owner[:1], owner))
    h = chars.copy()
    edge = np.concatenate(([0], np.cumsum(chars == 1, dtype=np.int32)))
    for n in range(1, max(GRAMS) + 1):
        if n > 1:
            h = h[:-1] * np.uint32(0x01000193) + chars[n - 1 :]
        if n in GRAMS:
            m = len(h)
            if n > 2:  # boundaries only at the ends
                ok = np.flatnonzero(edge[n - 1 : n - 1 + m] == edge[1 : 1 + m])
            else:
                ok = np.flatnonzero(chars[:m] != 1) if n == 1 else np.arange(m)
            mixed = (h[ok] + np.uint32(n)) * np.uint32(0x9E3779B1)
            yield (mixed >> np.uint32(12)) & np.uint32(BUCKETS - 1), owner[ok + (n > 1)]


@dataclass
class LanguageModel:
    langs: list[str]
    column: np.ndarray  # of each bucket; features: it isn't one
    landmarks: np.ndarray  # landmarks by features, scaled by their own size
    weights: np.ndarray  # landmarks by languages
    bias: np.ndarray

    def presence(self, texts: list[str]) -> np.ndarray:
        n = self.landmarks.shape[1]
        m = np.zeros((len(texts), n + 1), np.float32)
        for bucket, owner in gram_hashes(texts):
            m[owner, self.column[bucket]] = 1
        return m[:, :n]

    def kernels(self, texts: list[str]) -> np.ndarray:
        m = self.presence(texts)
        return (m @ self.landmarks.T) / np.sqrt(np.maximum(m.sum(1, keepdims=True), 1))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        langs, scores = [], []
        block: list[str] = []

        def flush() -> None:
            if block:
                z = (self.kernels(block) @ self.weights + self.bias) * SHARP
                z = np.exp(z - z.max(1, keepdims=True))
                best = z.argmax(1)
                langs.extend(self.langs[i] for i in best)
                scores.append(z[np.arange(len(z)), best] / z.sum(1))
                block.clear()

        size = 0
        for t in texts:
            block.append(t)
            size += len(t)
            if len(block) >= BLOCK_TEXTS or size > BLOCK_CHARS:
                flush()
                size = 0
        flush()
        scores = np.concatenate(scores) if scores else np.zeros(0)
        for i, t in enumerate(texts):
            if not any(map(str.isalpha, t)):
                langs[i], scores[i] = "und", 0.0
        return langs, scores


def train_model(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, features: int | None = None, ridge: float = RIDGE) -> LanguageModel:
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros(BUCKETS, np.int32), np.zeros((0, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    each = max(1, landmarks // len(names))
    taken: dict[str, int] = {}
    marks = []
    for i, lang in enumerate(langs):
        if taken.setdefault(lang, 0) < each:
            taken[lang] += 1
            marks.append(i)
    found = np.zeros(BUCKETS, np.int64)
    for bucket, owner in gram_hashes([texts[i] for i in marks]):
        found += np.bincount(np.unique(owner.astype(np.int64) * BUCKETS + bucket) % BUCKETS, minlength=BUCKETS)
    chosen = np.lexsort((np.arange(BUCKETS), -found))[:features]
    chosen = chosen[found[chosen] > 0]
    column = np.full(BUCKETS, len(chosen), np.int32)
    column[chosen] = np.arange(len(chosen))
    model = LanguageModel(names, column, np.zeros((0, len(chosen)), np.float32), np.zeros((0, 0)), np.zeros(0))
    z = model.presence([texts[i] for i in marks])
    model.landmarks = z / np.sqrt(np.maximum(z.sum(1, keepdims=True), 1))
    own = model.landmarks @ model.landmarks.T
    values, vectors = np.linalg.eigh(own.astype(np.float64))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    phi = np.concatenate([model.kernels(texts[i : i + 64]) for i in range(0, len(texts), 64)]) @ root
    y = np.where(np.array(langs)[:, None] == np.array(names)[None], 1.0, -1.0)
    count = np.array([langs.count(n) for n in langs], float)
    w = (1 / count)[:, None]  # each language weighs the same
    w = w / w.mean()
    center, mean_y = (w * phi).mean(0), (w * y).mean(0)
    a, b = phi - center, y - mean_y
    solved = np.linalg.solve((w * a).T @ a + ridge * np.eye(a.shape[1]), (w * a).T @ b)
    model.weights = (root @ solved).astype(np.float32)
    model.bias = mean_y - center @ solved
    return model


def training_rows(rows: DataFrame, per_lang: int, max_bytes: int, max_langs: int) -> DataFrame:
    """``h, id, text, lang`` of a bounded sample of ``rows (id, text, lang)``, one row of an id in a language."""
    counts = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    if counts.limit(max_langs + 1).count() > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    # An id's hash lies below the limit for about four times as many ids as are wanted.
    limit = counts.select("lang", F.when(F.col("rows") <= 4 * per_lang, 2.0).otherwise(4.0 * per_lang / F.col("rows")).alias("share"))
    hashed = rows.select("id", "lang", F.octet_length("text").alias("size"), F.xxhash64("text").alias("key"), F.xxhash64("id").alias("h"))
    hashed = hashed.where(F.col("size") <= max_bytes // LARGEST_SHARE)
    near = hashed.join(F.broadcast(limit), "lang").where(F.col("h") / F.lit(2.0**64) + 0.5 < F.col("share"))  # at most max_langs rows
    one = near.groupBy("lang", "h", "id").agg(F.min(F.struct("size", "key")).alias("own"))
    w = Window.partitionBy("lang").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)
    kept = one.withColumns({"place": F.count("*").over(w), "upto": F.sum("own.size").over(w)}).where((F.col("place") <= per_lang) & (F.col("upto") <= max_bytes))
    picked = F.broadcast(kept.select("id", "lang", "h", "own.key"))  # at most max_langs * per_lang rows
    return rows.withColumn("key", F.xxhash64("text")).join(picked, ["id", "lang", "key"]).dropDuplicates(["id", "lang"]).select("h", "id", "text", "lang")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, max_bytes: int = MAX_BYTES, max_langs: int = MAX_LANGS, landmarks: int = LANDMARKS, features: int | None = None) -> LanguageModel:
    """From the texts that may be learnt from: ``docs`` has only those."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("id is not null and lang is not null and text is not null")
    got = training_rows(rows, per_lang, max_bytes, max_langs).toPandas().sort_values(["h", "id", "text"])
    return train_model(got["text"].tolist(), got["lang"].tolist(), landmarks, features)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of each row."""
    rows = texts_of(docs, id_col, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                langs, scores = model.predict(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its predicted language."""
    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(id_crc(F.col("doc_id")), F.lit(5))
    model = fit(docs.where(fold != 0))
    held_out = F.coalesce(fold == 0, F.lit(False))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
