"""Substring deduplication by sliding spans of consecutive sentences.

A sentence ends with a run of ``.``, ``!``, ``?`` or line ends. A span is a run of at least ``MIN_SENTENCES`` sentences that
have words, with at least ``MIN_WORDS`` words. One starts at each sentence and takes as few of the following ones as it
needs; another ends at each sentence and takes as few of those before it. Together they cover every sentence of each
repeated run of that size. A text that holds no such run is one span. Spans are compared without regard to ASCII case and
white space, by a 128-bit hash: two independent sums of the bytes' random numbers times powers. Of the places where a span
occurs, in the order of id and position, all but the first are repeats, and every sentence that a repeat covers is removed.

Within a run of documents (``SLICE_BYTES``) only the first place of each span is shuffled, the others are known to be
repeats, so a span that a third of all documents share reaches its task as a row for each such run. There the places are
sorted and streamed: the first is kept, the others are given out. A second shuffle brings a document's repeats to it.

Defined edge cases: null and empty texts have no sentences; rows that repeat both id and text are one document for this
purpose and are treated alike; a null id comes first in the order; a text of any length is worked on whole, which takes about
60 bytes of memory for each of its bytes; an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table, text_bytes, texts_of

MIN_WORDS, MIN_SENTENCES = 20, 2
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*|[.!?\n]+")
#: Bytes that end a sentence, and bytes between words.
ENDS, BLANKS = b".!?\n", b" \t\n\x0b\x0c\r"

_BYTE = np.random.default_rng(20251103).integers(1 << 63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[:, 65:91] = _BYTE[:, 97:123]  # A-Z count as a-z
_STEP = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _among(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_END, _BLANK = _among(ENDS), _among(BLANKS)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def sentences(text: str | None) -> list[str]:
    """The sentences; together they are the text."""
    return SENTENCE.findall(text) if text else []


def spans(texts: pa.Array, min_words: int = MIN_WORDS, min_sentences: int = MIN_SENTENCES) -> tuple[np.ndarray, ...]:
    """(text, first sentence, sentence behind the last one, two hashes) of each span of the texts."""
    raw, edges = text_bytes(texts)
    n = len(raw)
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if not n:
        return none
    opening = np.zeros(n, bool)  # of sentences
    opening[edges[:-1][edges[:-1] < n]] = True
    end = _END[raw]
    opening[1:] |= end[:-1] & ~end[1:]
    word = ~_BLANK[raw]
    begins = word & opening
    begins[1:] |= word[1:] & ~word[:-1]
    sentence_at = np.flatnonzero(opening)
    text_of = np.searchsorted(edges, sentence_at, "right") - 1
    first_of = np.searchsorted(sentence_at, edges)  # each text's first sentence
    begin_at = np.flatnonzero(begins)
    of_word = np.searchsorted(sentence_at, begin_at, "right") - 1
    worded, words = np.unique(of_word, return_counts=True)  # sentences that have words
    if not len(worded):
        return none
    # Bytes with one blank before each word; the place of each sentence with words among them.
    blank = np.uint64(0x2545F4914F6CDD1D)
    kept = np.flatnonzero(word)
    place = np.arange(len(kept)) + np.searchsorted(begin_at, kept, "right")
    total = len(kept) + len(begin_at)
    start_at = place[np.searchsorted(kept, begin_at[np.concatenate(([0], np.cumsum(words)[:-1]))])] - 1
    stop_at = np.concatenate((start_at[1:], [total]))

    before = np.concatenate(([0], np.cumsum(words)))
    text = text_of[worded]
    last = np.searchsorted(text, text, "right") - 1  # the text's last sentence with words
    first = np.searchsorted(text, text, "left")
    k = np.arange(len(worded))
    ahead = np.maximum(np.searchsorted(before, before[:-1] + min_words) - 1, k + min_sentences - 1)
    back = np.minimum(np.searchsorted(before, before[1:] - min_words, "right") - 1, k - min_sentences + 1)
    small = (before[last + 1] - before[first] < min_words) | (last - first + 1 < min_sentences)
    pairs = [(k[ok], e[ok]) for e, ok in ((ahead, (ahead <= last) & ~small), (last, (k == first) & small))]
    ok = (back >= first) & ~small
    pairs.append((back[ok], k[ok]))
    a, z = np.unique(np.concatenate([np.stack(p, 1) for p in pairs]), axis=0).T
    hashes = []
    for which in (0, 1):
        values = np.full(total, blank, np.uint64)
        values[place] = _BYTE[which][raw[kept]]
        sums = np.zeros(total + 1, np.uint64)
        np.cumsum(values * _powers(pow(_STEP[which], -1, 1 << 64), total), dtype=np.uint64, out=sums[1:])
        h = (sums[stop_at[z]] - sums[start_at[a]]) * _powers(_STEP[which], total)[start_at[a]]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes.append((h ^ (h >> np.uint64(29))).view(np.int64))
    base = first_of[text[a]]
    return text[a], worded[a] - base, worded[z] + 1 - base, *hashes


def places(batch: pa.RecordBatch) -> np.ndarray:
    """Each row's place in the order of id and text hash (equal rows: equal places)."""
    keys = pa.table({"i": batch.column("doc_id"), "t": batch.column("tkey")})
    order = pc.sort_indices(keys, sort_keys=[("i", "ascending"), ("t", "ascending")], null_placement="at_start").to_numpy()
    ordered = keys.take(order)
    new = np.zeros(len(order), bool)
    for c in ("i", "t"):
        col = ordered[c].combine_chunks()
        a, b = col.slice(1), col.slice(0, max(0, len(col) - 1))
        same = pc.fill_null(pc.or_kleene(pc.equal(a, b), pc.and_(pc.is_null(a), pc.is_null(b))), False)
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def repeats(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash, id, text and position: the sure ones, and all but those at the first place of each hash."""
    columns = ["h1", "h2", "doc_id", "tkey", "start"]
    given = ["doc_id", "tkey", "start", "end"]
    last, later = None, False  # the row before, and whether it is given out
    for b in batches:
        sure = b.column("sure")
        if pc.any(sure).as_py():
            yield b.filter(sure).select(given)
            b = b.filter(pc.invert(sure))
        if not b.num_rows:
            continue
        equal = []
        for c in columns:
            col = b.column(c)
            before = pa.concat_arrays([last.column(c), col]).slice(0, len(col)) if last is not None else pa.concat_arrays([col.slice(0, 1), col]).slice(0, len(col))
            both_null = pc.and_(pc.is_null(col), pc.is_null(before))
            equal.append(pc.fill_null(pc.or_kleene(pc.equal(col, before), both_null), False).to_numpy(zero_copy_only=False))
        same_hash, same_place = equal[0] & equal[1], np.logical_and.reduce(equal)
        if last is None:
            same_hash[0] = same_place[0] = False
        # Given out from the first other place of a hash on.
        begins = np.flatnonzero(~same_hash)
        moved = np.cumsum(same_hash & ~same_place)
        group = np.cumsum(~same_hash)
        base = np.concatenate(([-1 if later else 0], moved[begins]))[group]
        out = moved > base
        yield b.select(given).filter(pa.array(out))
        last, later = b.slice(b.num_rows - 1), bool(out[-1])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_sentences: int = MIN_SENTENCES) -> DataFrame:
    """One row per document: ``doc_id, n_sentences, n_removed, n_spans, kept`` (the remaining text)."""
    rows = texts_of(docs, id_col, text_col).withColumn("tkey", F.xxhash64("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                at, start, end, h1, h2 = spans(b.column("text"), min_words, min_sentences)
                place = places(b)[at]
                order = np.lexsort((start, place, h2, h1))
                at, start, end, h1, h2, place = (x[order] for x in (at, start, end, h1, h2, place))
                new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))) if len(at) else np.zeros(0, bool)
                head = np.flatnonzero(new)[np.cumsum(new) - 1]  # the first place of the hash
                sure = (place != place[head]) | (start != start[head])
                # A sure repeat needs no company: its place stands for its hash.
                h1 = np.where(sure, (place * 1_000_003 + start) * np.int64(0x1E3779B97F4A7C15), h1)
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("tkey").take(take), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(h1), pa.array(h2), pa.array(sure)], names=["doc_id", "tkey", "start", "end", "h1", "h2", "sure"])

    found = rows.mapInArrow(emit, f"doc_id {id_type}, tkey long, start int, end int, h1 long, h2 long, sure boolean")
    repeated = found.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "doc_id", "tkey", "start").mapInArrow(repeats, f"doc_id {id_type}, tkey long, start int, end int")
    # A document has at most two repeats for each of its sentences.
    lists = repeated.groupBy(F.col("doc_id").alias("r_id"), F.col("tkey").alias("r_key")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("repeats"))
    joined = rows.join(lists, rows["doc_id"].eqNullSafe(lists["r_id"]) & (rows["tkey"] == lists["r_key"]), "left").select("doc_id", "text", "repeats")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                out: list[list] = [[], [], [], []]
                for t, spots in zip(b.column("text").to_pylist(), b.column("repeats").to_pylist()):
                    parts = sentences(t)
                    gone = np.zeros(len(parts) + 1, np.int64)
                    for s in spots or ():
                        gone[s["start"]] += 1
                        gone[s["end"]] -= 1
                    gone = np.cumsum(gone)[:-1] > 0
                    runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].any())
                    for col, v in zip(out, (len(parts), int(gone.sum()), runs, "".join(p for p, g in zip(parts, gone) if not g) if spots else t)):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], names=["doc_id", "n_sentences", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(cut, f"doc_id {id_type}, n_sentences long, n_removed long, n_spans long, kept string")


def op5_sentence_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with what sentence spans remove from it."""
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_sentences", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


_FOLDED = "translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?\\n]+[.!?\\n]*|[.!?\\n]+') AS p FROM documents),
s AS (SELECT r, doc_id, i, x, regexp_extract_all({_FOLDED}, '[^\\x20\\x09-\\x0D]+') AS w FROM (SELECT r, doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM d)),
k AS (SELECT r, doc_id, i, len(w) AS n, array_to_string(w, ' ') AS t, sum(len(w)) OVER o AS upto, row_number() OVER o AS q FROM s WHERE len(w) > 0 WINDOW o AS (PARTITION BY r ORDER BY i)),
f AS (SELECT r, doc_id, max(q) AS most, max(upto) AS total, list(t ORDER BY q) AS ts, list(i ORDER BY q) AS pos FROM k GROUP BY ALL),
g AS (SELECT *, total < {MIN_WORDS} OR most < {MIN_SENTENCES} AS small FROM f),
a1 AS (SELECT a.r, a.q AS s, greatest(b.q, a.q + {MIN_SENTENCES - 1}) AS e FROM (SELECT r, q, upto - n + {MIN_WORDS} AS goal FROM k) a ASOF JOIN k b ON a.r = b.r AND a.goal <= b.upto),
a2 AS (SELECT b.r, least(a.q, b.q - {MIN_SENTENCES - 1}) AS s, b.q AS e FROM (SELECT r, q, upto - {MIN_WORDS} AS goal FROM k) b ASOF JOIN (SELECT r, q, upto - n AS base FROM k) a ON a.r = b.r AND b.goal >= a.base),
u AS (SELECT DISTINCT r, s, e FROM (SELECT r, s, e FROM a1 UNION ALL SELECT r, s, e FROM a2) JOIN g USING (r) WHERE NOT small AND s >= 1 AND e <= most UNION ALL SELECT r, 1, most FROM g WHERE small),
v AS (SELECT u.r, doc_id, pos[s] AS i, pos[e] AS j, array_to_string(ts[s:e], ' ') AS span FROM u JOIN g USING (r)),
h AS (SELECT r, i, j, row_number() OVER (PARTITION BY span ORDER BY doc_id, i) AS nth FROM v),
x AS (SELECT DISTINCT r, q FROM (SELECT r, unnest(range(i, j + 1)) AS q FROM h WHERE nth > 1)),
m AS (SELECT s.r, s.i, s.x, x.q IS NOT NULL AS gone, lag(x.q IS NOT NULL, 1, false) OVER (PARTITION BY s.r ORDER BY s.i) AS before FROM s LEFT JOIN x ON x.r = s.r AND x.q = s.i),
b AS (SELECT r, count(*) AS n, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT before) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN b USING (r)
"""
