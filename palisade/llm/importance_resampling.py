"""Importance resampling of a corpus towards a target distribution, over hashed word features.

1. The features of a text are its runs of one to ``max_words`` words. Their buckets are CRCs of their bytes: a task gathers the distinct
   features of a block, groups those of one length into a matrix of bytes, updates the CRCs of all its rows column by column, and
   scatters the buckets back. Each document is stored as its buckets and how often each occurs.
2. Features of the corpus and of the target are counted by bucket, each task's counts first. A bucket's gain is the logarithm of how much
   likelier the target makes it, both counts smoothed by one; gains, like counts, are as many as there are buckets.
3. A document's weight is the mean gain of its features. Weight and Gumbel noise, which comes from the document's id, make its score, so
   that the highest scores are a draw without replacement in proportion to the weights' exponentials.
4. The cut-off comes from a histogram of the scores, which are whole numbers within bounds. Rows at or above it are put in order by
   ranges of (score, id), numbered within each range, and shifted by the sizes of the ranges before it.

Defined edge cases: a null text has no words, hence weight 0; a null id makes noise as an empty one and comes after all others
of its score; rows that repeat an id are drawn each (of equal rows any order will do); texts of any length are worked on whole, in
blocks of ``BLOCK_WORDS`` words; with no target or no corpus all counts are 0 and the formula still holds; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, slices, stored, table, text_bytes, texts_of

MAX_WORDS = 1
BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
#: Words of which features are made at once.
BLOCK_WORDS = 1 << 18
#: Gains and scores are in thousandths.
UNIT = 1000


def _crc_table() -> np.ndarray:
    """CRC of each byte by the reflected polynomial of zip and gzip."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1).astype(np.uint32)
    return crc


def _byte_map() -> np.ndarray:
    """Bytes of words, A-Z lower-cased; 0 for bytes between words."""
    out = np.zeros(256, np.uint8)
    for a in [*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]:
        out[a] = a
    out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1]
    return out


CRC_OF_BYTE = _crc_table()
WORD_BYTE = _byte_map()


def crc32_columns(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of each ``data[start : start + length]``: one matrix of bytes for each length, all its rows at once by column."""
    out = np.zeros(len(start), np.uint32)
    order = np.argsort(length, kind="stable")
    sizes, first = np.unique(length[order], return_index=True)
    for size, rows in zip(sizes.tolist(), np.split(order, first[1:])):
        for at in range(0, len(rows), max(1, (1 << 22) // max(size, 1))):  # a matrix of about 4 MB
            some = rows[at : at + max(1, (1 << 22) // max(size, 1))]
            matrix = data[start[some][:, None] + np.arange(size)]
            crc = np.full(len(some), 0xFFFFFFFF, np.uint32)
            for column in matrix.T:
                crc = CRC_OF_BYTE[(crc ^ column) & 0xFF] ^ (crc >> 8)
            out[some] = ~crc
    return out


def words_of(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts that lie end to end: their bytes with one blank after each, starts, ends and the text of each."""
    low = WORD_BYTE[raw]
    inside = np.zeros(len(low) + 2, np.bool_)
    inside[1:-1] = low != 0
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edges = bounds[1:-1]
    at_edge = edges[(edges > 0) & (edges < len(low))]
    begins[at_edge] = inside[1:-1][at_edge]  # a word ends where its text does
    ends[at_edge - 1] = inside[1:-1][at_edge - 1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    size = end - begin
    start = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    packed = np.full(int(size.sum()) + len(size), ord(" "), np.uint8)
    keep = np.ones(len(packed), np.bool_)
    keep[start + size] = False
    packed[keep] = low[low != 0]
    return packed, start, start + size, np.searchsorted(bounds, begin, "right") - 1


def features_of(raw: np.ndarray, bounds: np.ndarray, max_words: int = MAX_WORDS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, bucket, times)`` of the features of each text, sorted, and the number of words of each text."""
    data, start, end, of = words_of(raw, bounds)
    n_words = np.bincount(of, minlength=len(bounds) - 1)
    keys: list[np.ndarray] = []
    times: list[np.ndarray] = []
    for a in range(0, len(start), BLOCK_WORDS):
        for k in range(max_words):
            first = np.arange(a, min(a + BLOCK_WORDS, len(start) - k))
            first = first[of[first] == of[first + k]] if len(first) else first
            if not len(first):
                continue
            begin, size = start[first], end[first + k] - start[first]
            joined = np.concatenate(([0], np.cumsum(size)))
            flat = data[np.repeat(begin - joined[:-1], size) + np.arange(joined[-1])]
            features = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(joined), pa.py_buffer(flat)]).dictionary_encode()
            distinct = features.dictionary
            own, at = text_bytes(distinct)
            bucket = (crc32_columns(own, at[:-1], np.diff(at)) % np.uint32(buckets)).astype(np.int64)
            key, n = np.unique(of[first] * buckets + bucket[features.indices.to_numpy()], return_counts=True)
            keys.append(key)
            times.append(n)
    if not keys:
        none = np.zeros(0, np.int64)
        return none, none, none, n_words
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(back, np.concatenate(times)).astype(np.int64)  # below 2 ** 53, so exact
    return key // buckets, key % buckets, total, n_words


def hashed_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_words, n_features, buckets, times`` of each text; the last two are lists."""
    rows = texts_of(docs, id_col, text_col)

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                raw, bounds = text_bytes(b.column("text"))
                text, bucket, times, n_words = features_of(raw, bounds, max_words, buckets)
                ends = np.searchsorted(text, np.arange(b.num_rows + 1)).astype(np.int32)
                upto = np.concatenate(([0], np.cumsum(times)))
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x, pa.int64())) for x in (bucket, times)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(upto[ends[1:]] - upto[ends[:-1]], pa.int64()), *lists], names=["doc_id", "n_words", "n_features", "buckets", "times"])

    return rows.mapInArrow(hashed, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, buckets array<long>, times array<long>")


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket holds: a row per bucket comes to the driver."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            at, n = (c.flatten().to_numpy() for c in batch.columns)
            np.add.at(total, at, n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in features.select("buckets", "times").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths, rounded down, of the logarithm of how much likelier the target makes each bucket."""
    buckets = len(corpus)
    corpus_all, target_all = float(corpus.sum() + buckets), float(target.sum() + buckets)
    return np.array([math.floor(UNIT * math.log((t + 1.0) * corpus_all / ((s + 1.0) * target_all))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: object, seed: int = SEED) -> int:
    """Thousandths, rounded down, of the id's Gumbel noise."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-UNIT * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(features: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of each text."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, times = batch.column("buckets"), batch.column("times").flatten().to_numpy()
            n = batch.column("n_features").to_numpy()
            ends = np.concatenate(([0], np.cumsum(bucket.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            upto = np.concatenate(([0], np.cumsum(gain[bucket.flatten().to_numpy()] * times)))
            weight = (upto[ends[1:]] - upto[ends[:-1]]) // np.maximum(n, 1)
            total = weight + np.array([noise(i, seed) for i in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight), pa.array(total)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return features.mapInArrow(score, f"doc_id {features.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long, score long")


def ranked_first(rows: DataFrame, fit, drawn: int) -> DataFrame:
    """``rows`` with ``rank``: 1 to ``drawn`` for those of ``fit`` by falling score and rising id, else null."""
    none = F.lit(None).cast("long").alias("rank")
    least, above = None, 0
    for r in sorted(rows.where(fit).groupBy("score").count().collect(), key=lambda r: -r["score"]):  # scores have bounds
        if above >= drawn:
            break
        least, above = r["score"], above + r["count"]
    if least is None:
        return rows.select("*", none)
    high = F.coalesce(fit & (F.col("score") >= least), F.lit(False))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    sorted_rows = rows.where(high).repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = pa.array(np.arange(n, n + batch.num_rows, dtype=np.int64))
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), at], names=[*batch.schema.names, "part", "nth"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    numbered = stored(sorted_rows.mapInArrow(number, f"{fields}, part int, nth long"), "numbered")
    sizes = sorted((r["part"], r["count"]) for r in numbered.groupBy("part").count().collect())  # a row per range
    before, at = [], 0
    for part, n in sizes:
        before.append((part, at))
        at += n
    bases = rows.sparkSession.createDataFrame(before, "part int, base long")
    rank = F.col("base") + F.col("nth") + 1
    first = numbered.join(F.broadcast(bases), "part").select(*rows.columns, F.when(rank <= drawn, rank).alias("rank"))
    return first.unionByName(rows.where(~high).select("*", none))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS, buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_features, weight, score, rank`` (null unless drawn); ``target`` has a column ``text_col``."""
    features = stored(hashed_features(docs, id_col, text_col, max_words, buckets), "features")
    wanted = hashed_features(target.withColumn(id_col, F.lit(0)), id_col, text_col, max_words, buckets)
    gain = gains(bucket_counts(features, buckets), bucket_counts(wanted, buckets))
    rows = stored(scored(features, gain, seed), "scored")
    fit = F.col("n_words") >= min_words
    return ranked_first(rows, fit, rows.where(fit).count() * percent // 100)


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its weight towards ``benchmark``, and its rank if it is drawn."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = r"""
WITH RECURSIVE
texts AS (SELECT doc_id AS id, true AS corpus, text FROM documents UNION ALL SELECT item_id, false, text FROM benchmark),
words AS (SELECT id, corpus, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
counted AS (SELECT id, corpus, w, count(*) AS n FROM words GROUP BY ALL),
bits(b, k, c) AS (SELECT CAST(r AS BIGINT), 0, CAST(r AS BIGINT) FROM range(256) t(r)
    UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crcs AS (SELECT b, c FROM bits WHERE k = 8),
steps(w, h, k, c) AS (SELECT DISTINCT w, hex(encode(w)), 0, 4294967295 FROM counted
    UNION ALL SELECT w, h, k + 1, xor(t.c, s.c >> 8) FROM steps s JOIN crcs t
    ON t.b = xor(s.c & 255, 16 * (instr('0123456789ABCDEF', h[2 * k + 1]) - 1) + instr('0123456789ABCDEF', h[2 * k + 2]) - 1) WHERE 2 * k < length(h)),
buckets AS (SELECT w, xor(c, 4294967295) % 10000 AS bucket FROM steps WHERE 2 * k = length(h)),
hashed AS (SELECT id, corpus, bucket, sum(n) AS n FROM counted JOIN buckets USING (w) GROUP BY ALL),
sums AS (SELECT r AS bucket, coalesce(sum(n) FILTER (corpus), 0) AS s, coalesce(sum(n) FILTER (NOT corpus), 0) AS t
    FROM range(10000) b(r) LEFT JOIN hashed ON bucket = r GROUP BY r),
gained AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM sums),
weighed AS (SELECT id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS total FROM hashed JOIN gained USING (bucket) WHERE corpus GROUP BY id),
noisy AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(CASE WHEN total % n < 0 THEN total // n - 1 ELSE total // n END, 0) AS weight,
    list_sum(list_transform(range(1, 9), lambda k: CAST(instr('0123456789abcdef', substr(sha256('2024:' || doc_id), k, 1)) - 1 AS BIGINT) << CAST(4 * (8 - k) AS INT))) AS h
    FROM documents LEFT JOIN weighed ON id = doc_id),
scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM noisy),
ordered AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_features >= 20) AS many FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * many // 100 THEN r END AS rank FROM ordered
"""
