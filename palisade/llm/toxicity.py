"""Toxicity: subword-bag embeddings, averaged, into a linear softmax; trained jointly in numpy.

A word's vector is the mean of the vectors of its character 3- to 5-grams (with word boundaries), so an unseen
misspelling shares most of them. The words of a segment (16 in a row) are averaged and go through a linear softmax; a
document's score is that of its most toxic segment, so that a few words aren't lost in a long text. Since averaging and
the softmax's argument are linear, a gram's logit ``vector @ weights`` is computed once after training and whole texts are
scored by table lookups on their character codes.

Training: labelled documents only, at most ``max_train`` of each class (those with the smallest hash of their id) with at most
``max_bytes`` of text (the bounds are these parameters), by stochastic gradient descent with per-row step sizes on the
driver. Everything else is row-local: one scan, no shuffle.

Defined edge cases: null and empty texts have no segment and get the score of the bias alone; a label that is null is no
label; of repeated labels of one document the larger counts, and of its repeated rows one trains; without any labels of both
classes every score is 0; a text of any length is scored whole (about 100 bytes of memory for each of its characters); an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, giving_back, slices, table, texts_of

GRAMS = (3, 4, 5)
BUCKETS = 1 << 17
SEGMENT = 16
#: Shorter segments are averaged as if they had so many words.
SEGMENT_LEAST = 8
DIM = 8
THRESHOLD = 0.7
MAX_TRAIN, MAX_BYTES = 3000, 24 << 20
#: A text of more than this part of ``max_bytes`` isn't learnt from.
LARGEST_SHARE = 8
#: A gram in fewer training texts keeps a zero vector: it can only be learnt by heart.
MIN_TEXTS = 8
#: Few training texts are gone through more often, up to so many steps in all.
LEAST_STEPS = 1500
#: Likewise one whose log odds of toxic texts are within so many standard errors of all texts'.
MIN_ODDS = 2.5
#: Characters that are worked on at once, in scoring and in training, which keeps less of them at a time on the driver.
BLOCK, TRAIN_BLOCK = 1 << 20, 1 << 18


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character codes of lower-cased texts, 0 where no word is (twice between texts), and each text's start."""
    low = [t.lower() for t in texts]
    starts = np.cumsum([2, *(len(t) + 2 for t in low[:-1])]) if low else np.zeros(0, np.int64)
    raw = np.frombuffer(("\0\0" + "\0\0".join(low) + "\0\0\0\0\0\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    word = (raw > 127) | ((raw >= 97) & (raw <= 122)) | ((raw >= 48) & (raw <= 57))
    inner = raw > 32  # one sign between two letters belongs to the word
    word[1:-1] |= inner[1:-1] & word[:-2] & word[2:]
    return np.where(word, raw, np.uint32(0)), np.asarray(starts, np.int64)


def word_grams(chars: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram buckets, the word each belongs to, the first position of each word)."""
    inside = chars != 0
    first = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    word_at = np.cumsum(inside & np.concatenate(([False], ~inside[:-1])), dtype=np.int32) - 1
    seps = np.concatenate(([0], np.cumsum(~inside, dtype=np.int32)))
    h = chars.astype(np.uint32)
    ids, words = [], []
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * np.uint32(0x01000193) + chars[n - 1 :]
        if n not in GRAMS:
            continue
        m = len(h)
        ok = np.flatnonzero(seps[n - 1 : n - 1 + m] == seps[1 : 1 + m])  # no boundary but at either end
        mixed = (h[ok] + np.uint32(n)) * np.uint32(0x9E3779B1)
        ids.append((mixed >> np.uint32(15)) & np.uint32(buckets - 1))
        words.append(word_at[ok + 1])
    return np.concatenate(ids), np.concatenate(words), first


@dataclass
class Segmented:
    """Segments of a batch of texts."""

    grams: np.ndarray
    gram_word: np.ndarray
    word_share: np.ndarray  # 1 / number of grams
    word_segment: np.ndarray
    segment_share: np.ndarray  # 1 / number of words averaged
    segment_text: np.ndarray
    texts: int


def segmented(texts: list[str], segment: int | None = SEGMENT) -> Segmented:
    """``segment`` None: each text is one segment."""
    chars, starts = codes(texts)
    grams, gram_word, first = word_grams(chars)
    text = np.searchsorted(starts, first, "right") - 1
    text_first = np.searchsorted(text, np.arange(len(texts)))
    place = np.arange(len(first)) - text_first[text] if len(first) else first
    begins = (place % (segment or 1 << 60) == 0) if len(first) else np.zeros(0, bool)
    of_word = np.cumsum(begins) - 1
    size = np.bincount(of_word, minlength=0) if len(first) else np.zeros(0)
    per_word = np.bincount(gram_word, minlength=len(first))
    return Segmented(grams, gram_word, 1 / np.maximum(per_word, 1), of_word, 1 / np.maximum(size, SEGMENT_LEAST), text[begins] if len(first) else text, len(texts))


def segment_means(s: Segmented, gram_values: np.ndarray) -> np.ndarray:
    words = np.bincount(s.gram_word, gram_values[s.grams], len(s.word_share)) * s.word_share
    return np.bincount(s.word_segment, words, len(s.segment_share)) * s.segment_share


def strongest(values: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the segment with the largest value of each text that has one, that text)."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((np.arange(len(values)), -values, text))
    head = np.concatenate(([True], text[order][1:] != text[order][:-1]))
    return order[head], text[order][head]


@dataclass
class ToxicityModel:
    """``gram_logits``: of each gram, the toxic logit less the clean one."""

    gram_logits: np.ndarray
    bias: float
    trained: bool = True
    segment: int | None = SEGMENT

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(texts))
        out = np.full(len(texts), self.bias)
        s = segmented(texts, self.segment)
        z = segment_means(s, self.gram_logits) + self.bias
        best, text = strongest(z, s.segment_text)
        out[text] = z[best]
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first[i] .. first[i] + size[i] - 1 of every i, in a row."""
    return np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())


@dataclass
class TrainingSet:
    """Texts as numbers of distinct words, and each distinct word's grams (``grams[first[w]:first[w] + size[w]]``)."""

    word: np.ndarray
    segment: np.ndarray
    segment_first: np.ndarray
    segment_size: np.ndarray
    segment_text: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    size: np.ndarray


def training_set(texts: list[str], segment: int | None = SEGMENT) -> TrainingSet:
    step, back = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    keys, segments, segment_texts, own_keys, own_grams, own_sizes = [], [], [], [], [], []
    begin, n, done = 0, 0, 0
    seen = np.zeros(0, np.uint64)
    for k, text in enumerate(texts):
        n += len(text)
        if n < TRAIN_BLOCK and k < len(texts) - 1:
            continue
        block = texts[begin : k + 1]
        s = segmented(block, segment)
        chars, _ = codes(block)
        powers = np.cumprod(np.full(len(chars), back, np.uint64))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((chars.astype(np.uint64) + np.uint64(77)) * np.uint64(0xBF58476D1CE4E5B9) * powers, dtype=np.uint64)))
        inside = np.concatenate((chars != 0, [False]))
        first = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        last = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        key = (sums[last] - sums[first]) * np.cumprod(np.full(len(chars) + 1, step, np.uint64))[first]
        own, where = np.unique(key, return_index=True)
        at = np.searchsorted(seen, own)
        fresh = np.concatenate((seen, own[-1:]))[at] != own if len(seen) else np.ones(len(own), bool)
        fresh |= at == len(seen)
        own, where = own[fresh], where[fresh]
        seen = np.insert(seen, at[fresh], own)
        wanted = np.zeros(len(key), bool)
        wanted[where] = True
        pick = np.flatnonzero(wanted[s.gram_word])
        pick = pick[np.argsort(key[s.gram_word[pick]], kind="stable")]
        own_keys.append(own)
        own_grams.append(s.grams[pick].astype(np.int32))
        own_sizes.append(np.bincount(s.gram_word, minlength=len(key))[where])
        keys.append(key)
        segments.append((s.word_segment + done).astype(np.int32))
        done += len(s.segment_share)
        segment_texts.append(s.segment_text + begin)
        begin, n = k + 1, 0
        del s, chars, powers, sums, inside, key, pick
    give_back()
    all_keys, size = np.concatenate(own_keys), np.concatenate(own_sizes)
    order = np.argsort(all_keys)
    distinct = all_keys[order]
    grams = np.concatenate(own_grams)
    own_grams.clear()
    for i, k in enumerate(keys):  # one by one, so that the keys aren't held twice
        keys[i] = order[np.searchsorted(distinct, k)].astype(np.int32)
    word = np.concatenate(keys)
    keys.clear()
    segment = np.concatenate(segments)
    segments.clear()
    count = np.bincount(segment)
    return TrainingSet(word, segment, np.concatenate(([0], np.cumsum(count)[:-1])), count, np.concatenate(segment_texts), grams, np.concatenate(([0], np.cumsum(size)[:-1])), size)


def gram_odds(data: TrainingSet, toxic: np.ndarray, block: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each gram, by the texts that have it: log odds ratio over its standard error, whether it's common, whether it tells."""
    counts = np.zeros((2, BUCKETS))
    of_text = data.segment_text.astype(np.int32)[data.segment]
    edges = np.searchsorted(of_text, np.arange(0, len(toxic) + block, block))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        word = data.word[a:b]
        there = np.zeros((block, BUCKETS), bool)
        there[np.repeat(of_text[a:b] - k * block, data.size[word]), data.grams[ranges(data.first[word], data.size[word])]] = True
        for c in (0, 1):
            own = np.flatnonzero(toxic[k * block : (k + 1) * block] == c)
            counts[c] += there[own].sum(0)
    with_, without = counts + 0.5, np.bincount(toxic, minlength=2)[:, None] - counts + 0.5
    odds = (np.log(with_ / without) * np.array([[-1], [1]])).sum(0) / np.sqrt((1 / with_ + 1 / without).sum(0))
    return odds, counts.sum(0) >= MIN_TEXTS, np.abs(odds) >= MIN_ODDS


def train_model(texts: list[str], toxic: np.ndarray, dim: int = DIM, rounds: int = 16, rate: float = 0.1, batch: int = 64, seed: int = 7, segment: int | None = SEGMENT, odds_start: bool = True) -> ToxicityModel:
    """Embeddings and softmax weights, jointly.

    A round picks each text's strongest segment under the present model, then descends along the gradients of these.
    ``segment`` None averages whole texts; without ``odds_start`` all vectors and weights start at random, and all common
    grams are learnt.
    """
    toxic = np.asarray(toxic, np.int64)
    if len(set(toxic.tolist())) < 2:
        return ToxicityModel(np.zeros(1, np.float32), 0.0, trained=False)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim))
    weights = rng.normal(0, 0.1, (dim, 2))
    bias = np.log(np.bincount(toxic, minlength=2) / len(toxic))
    row_sum, weight_sum, bias_sum = np.full(BUCKETS, 1e-4), np.full(weights.shape, 1e-4), np.full(2, 1e-4)
    data = training_set(texts, segment)
    give_back()
    odds, common, told = gram_odds(data, toxic)
    give_back()
    if odds_start:
        vectors *= 0.1
        vectors[:, 0] += 0.05 * np.clip(odds, -10, 10)
        weights[0] = (-0.5, 0.5)
        common &= told
    vectors[~common] = 0
    share = 1 / np.maximum(data.segment_size, SEGMENT_LEAST)
    scale = 8.0  # so that one word in a segment can decide
    for _ in range(max(rounds, -(-LEAST_STEPS * batch // len(texts)))):
        margin = scale * vectors @ (weights[:, 1] - weights[:, 0])
        of_word = np.add.reduceat(margin.astype(np.float32)[data.grams], data.first) / data.size  # each word has a gram
        z = np.bincount(data.segment, of_word[data.word], len(share)) * share
        best, text = strongest(z, data.segment_text)
        order = rng.permutation(len(best))
        for i in range(0, len(order), batch):
            own = best[order[i : i + batch]]
            y = toxic[text[order[i : i + batch]]]
            size = data.segment_size[own]
            word = data.word[ranges(data.segment_first[own], size)]
            of_text = np.repeat(np.arange(len(own)), size)
            gram_share = np.repeat(share[own][of_text] / np.maximum(data.size[word], 1) * scale, data.size[word])
            gram_text = np.repeat(of_text, data.size[word])
            used, at = np.unique(data.grams[ranges(data.first[word], data.size[word])], return_inverse=True)
            logits = vectors[used] @ weights
            z = np.stack([np.bincount(gram_text, logits[at, c] * gram_share, len(own)) for c in (0, 1)], 1) + bias
            e = np.exp(z - z.max(1, keepdims=True))
            slope = e / e.sum(1, keepdims=True)
            slope[np.arange(len(own)), y] -= 1
            pull = np.stack([np.bincount(at, slope[gram_text, c] * gram_share, len(used)) for c in (0, 1)], 1)
            to_vectors, to_weights, to_bias = pull @ weights.T, vectors[used].T @ pull, slope.sum(0) / len(own)
            row_sum[used] += (to_vectors**2).mean(1)
            weight_sum += to_weights**2
            bias_sum += to_bias**2
            vectors[used] -= rate * (to_vectors / np.sqrt(row_sum[used])[:, None]) * common[used][:, None]
            weights -= rate * to_weights / np.sqrt(weight_sum)
            bias -= rate * to_bias / np.sqrt(bias_sum)
    logits = scale * (vectors @ (weights[:, 1] - weights[:, 0]))
    del data
    give_back()
    return ToxicityModel(logits.astype(np.float32), float(bias[1] - bias[0]), segment=segment)


def id_crc(col: Column) -> Column:
    """crc32 of the id's decimal text."""
    return F.crc32(col.cast("string").cast("binary"))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_train: int, max_bytes: int) -> DataFrame:
    """``id, text, y`` of at most ``max_train`` labelled documents of each class, those whose id has the smallest hash.

    Of these, in the same order, as many as have ``max_bytes`` of text together; a text of over an eighth of that isn't learnt from, as
    it would leave no room for others. Of rows that repeat an id, the shortest one counts.
    """
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    marks = marks.where(F.pmod(id_crc(F.col("id")), F.lit(3)) != 1)
    order = [F.xxhash64("id"), F.col("id")]
    picked = [marks.where(F.col("y") == y).orderBy(*order).limit(max_train) for y in (0, 1)]
    picked = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * max_train rows of two numbers
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).join(picked, "id")
    own = F.struct(F.octet_length("text").alias("size"), F.xxhash64("text").alias("key"))
    one = rows.groupBy("id", "y").agg(F.min(own).alias("own")).where(F.col("own.size") <= max_bytes // LARGEST_SHARE)  # of each id the shortest text
    upto = F.sum("own.size").over(Window.partitionBy("y").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    kept = one.withColumn("upto", upto).where(F.col("upto") <= max_bytes).select("id", "own.key")
    return rows.join(F.broadcast(kept), (rows["id"] == kept["id"]) & (F.xxhash64("text") == kept["key"]), "left_semi").dropDuplicates(["id"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> ToxicityModel:
    rows = sorted(training_rows(docs, labels, id_col, text_col, label_col, max_train, max_bytes).select("id", "text", "y").collect())
    texts, toxic = [r["text"] for r in rows], np.array([r["y"] for r in rows], np.int64)
    del rows
    model = train_model(texts, toxic)
    del texts
    give_back()
    return model


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of each row."""
    rows = texts_of(docs, id_col, text_col)

    @giving_back
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, limit=BLOCK):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(b.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its toxicity."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.pmod(id_crc(F.col("doc_id")), F.lit(3)) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
