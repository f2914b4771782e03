"""Benchmark decontamination by an FM-index per shard of the training texts.

A shard is a run of documents with at most ``SLICE_BYTES`` of text (or one longer document). Its words are numbered by the
vocabulary of the benchmark's items (0: a word that no item has) while they are scanned; only runs of known words at least
as long as the shortest window can hold a window, so exactly these runs are indexed. The index is a suffix array's
Burrows-Wheeler transform in a wavelet tree with sampled suffix positions. All windows of the items are searched backwards
at once, their occurrences are located by walking to the next sampled position, and overlapping spans are merged.

The items travel with the tasks in blocks of at most ``BLOCK_BYTES`` of text; the driver holds two blocks at a time. A larger
benchmark makes several blocks, each with its own pass over the documents, whose finds are written to the shared folder in
between. There is no shuffle.

Defined edge cases: null and empty texts have no words and are clean; an item without words is ignored, one of fewer than
``window`` words is one window; repeated rows and items are judged each; a null item id is named ``null``; an empty
benchmark or an empty table of documents gives clean documents or no rows; a text of any length is one shard at most, which
takes about 60 bytes of memory for each of its words; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, giving_back, slices, table, texts_of

WINDOW = 10
#: Text of items that one pass takes. A window of it takes about 100 bytes of memory in a task.
BLOCK_BYTES = 4 << 20
SAMPLE = 8
#: On bytes whose A-Z are lower-cased: ASCII letters and digits, and everything beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []


def numbered(texts: Iterable[bytes | None], numbers: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(the known words' numbers of all texts with a 0 behind each text, how many words each text has)."""
    parts, sizes = [], []
    for text in texts:
        own = np.fromiter((numbers.get(m[0], 0) for m in WORD.finditer((text or b"").lower())), np.int32)
        parts += [own, np.zeros(1, np.int32)]
        sizes.append(len(own))
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.array(sizes, np.int64)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Of numbers, by prefix doubling."""
    n, k = len(s), 1
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        step = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = step
        if step[-1] == n - 1:
            return order
        k *= 2


class WaveletTree:
    """Rank of a number among the first i of a sequence, level by level of its bits."""

    def __init__(self, s: np.ndarray):
        self.bits = max(1, int(s.max()).bit_length()) if len(s) else 1
        self.ones, self.zeros = [], []
        for b in reversed(range(self.bits)):
            bit = (s >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))))
            self.zeros.append(len(s) - int(bit.sum()))
            s = np.concatenate((s[bit == 0], s[bit == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(i), i
        for b, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros):
            bit = (c >> b) & 1
            low = np.where(bit, zeros + ones[low], low - ones[low])
            high = np.where(bit, zeros + ones[high], high - ones[high])
        return high - low


class FMIndex:
    def __init__(self, s: np.ndarray, sample: int = SAMPLE):
        """``s``: numbers above 0 and a single 0 at the end."""
        sa = suffix_array(s)
        self.last = s[sa - 1]
        self.tree = WaveletTree(self.last)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(s))))  # how many are smaller
        sampled = sa % sample == 0
        self.sampled_before = np.concatenate(([0], np.cumsum(sampled)))
        self.sampled, self.positions = sampled, sa[sampled]
        self.n = len(s)

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of patterns of one length (a row each), searched backwards together."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for c in patterns.T[::-1]:
            known = c < len(self.before) - 1
            c = np.where(known, c, 0)
            low, high = self.before[c] + self.tree.rank(c, low), self.before[c] + self.tree.rank(c, high)
            high = np.where(known, high, low)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes, by steps to the left until a sampled one."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            hit = self.sampled[rows[todo]]
            done = todo[hit]
            out[done] = self.positions[self.sampled_before[rows[done]]] + steps[done]
            todo = todo[~hit]
            c = self.last[rows[todo]]
            rows[todo] = self.before[c] + self.tree.rank(c, rows[todo])
            steps[todo] += 1
        return out


class Items:
    """The windows of a block of items: numbered words, and the items that have each window."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        self.names = sorted({str(i) if i is not None else "null" for i, _ in items})
        name = {n: k for k, n in enumerate(self.names)}
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, text in items:
            ids = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)], np.int32)
            if len(ids):
                n = min(window, len(ids))
                found.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(ids, n), name[str(item) if item is not None else "null"]))
        #: Of each length: distinct windows, and the items of window w: ``owners[first[w]:first[w + 1]]``.
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in sorted(found):
            own, at = np.unique(np.concatenate([w for w, _ in found[n]]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack((at.ravel(), np.concatenate([np.full(len(w), k) for w, k in found[n]]))), axis=1)
            self.by_length.append((own, np.searchsorted(pairs[0], np.arange(len(own) + 1)), pairs[1]))
        self.shortest = min((p.shape[1] for p, *_ in self.by_length), default=0)

    def hits(self, texts: Iterable[bytes | None], all_words: bool = False) -> tuple[np.ndarray, list[list[int]], list[list[str]]]:
        """Of each text: how many words it has, its merged word spans (start, end, start, end, ...), the items found.

        With ``all_words`` the whole shard is indexed, not only the runs that can hold a window: the result is the same.
        """
        ids, sizes = numbered(texts, self.numbers)
        spans: list[list[int]] = [[] for _ in sizes]
        names: list[list[str]] = [[] for _ in sizes]
        starts = np.cumsum(sizes + 1) - sizes - 1
        known = np.concatenate(([False], ids > 0))
        first = np.flatnonzero(known[1:] & ~known[:-1])
        length = np.flatnonzero(known[:-1] & ~known[1:]) - first  # each text ends with a 0
        first, length = first[length >= self.shortest], length[length >= self.shortest]
        if all_words:
            first, length = np.zeros(1, np.int64), np.array([len(ids) - 1])
        if not self.shortest or not len(first) or not length.any():
            return sizes, spans, names
        total = length + 1  # a run and the 0 behind it
        at = np.repeat(first - np.concatenate(([0], np.cumsum(total)[:-1])), total) + np.arange(total.sum())
        index = FMIndex(np.concatenate((ids[at] + 1, [0])))
        edge = np.zeros(len(ids) + 1, np.int32)
        pairs = []  # (text, item), each once for a length
        for patterns, begin, owners in self.by_length:
            low, high = index.ranges(patterns + 1)
            count = high - low
            rows = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            place = at[index.locate(rows)]
            np.add.at(edge, place, 1)
            np.add.at(edge, place + patterns.shape[1], -1)
            text = np.searchsorted(starts, place, "right") - 1
            text, window = np.unique(np.stack((text, np.repeat(np.arange(len(count)), count))), axis=1)
            size = begin[window + 1] - begin[window]
            spot = np.repeat(begin[window] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            pairs.append(np.unique(np.stack((np.repeat(text, size), owners[spot])), axis=1))
        covered = np.concatenate(([False], np.cumsum(edge) > 0))
        begin, end = np.flatnonzero(covered[1:] & ~covered[:-1]), np.flatnonzero(covered[:-1] & ~covered[1:])
        for d, b, e in zip((np.searchsorted(starts, begin, "right") - 1).tolist(), begin.tolist(), end.tolist()):
            spans[d] += [b - int(starts[d]), e - int(starts[d])]
        for d, k in np.unique(np.concatenate(pairs, axis=1), axis=1).T.tolist():
            names[d].append(self.names[k])
        return sizes, spans, names


def item_blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """Blocks of (item id as text, text) whose texts have at most ``block_bytes`` (or that hold one item)."""
    block, size = [], 0
    for row in items.select(F.col(item_col).cast("string"), F.col(text_col)).toLocalIterator():
        n = len((row[1] or "").encode())
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: ``doc_id, n_words, spans array<long>, items array<string>``.

    ``spans`` has start and end of each merged run of hit words, alternating, counted in words.
    """
    rows = texts_of(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<long>"), "items": F.array().cast("array<string>")})
    scratch = Scratch(docs.sparkSession)

    def searcher(block: list[tuple[str | None, str | None]], last: bool):
        @giving_back
        def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(block, window)
            for batch in batches:
                for b in slices(batch):
                    n_words, spans, names = items.hits(b.column("text").cast(pa.binary()).to_pylist())
                    spans = [merge([*old, *new]) if old else new for old, new in zip(b.column("spans").to_pylist(), spans)]
                    names = [sorted({*old, *new}) if old else new for old, new in zip(b.column("items").to_pylist(), names)]
                    cols = {"doc_id": b.column("doc_id"), "text": b.column("text"), "n_words": pa.array(n_words, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int64())), "items": pa.array(names, pa.list_(pa.string()))}
                    if last:
                        del cols["text"]
                    yield pa.RecordBatch.from_pydict(cols)

        return search

    fields = "n_words long, spans array<long>, items array<string>"
    blocks = item_blocks(benchmark, item_col, item_text_col, block_bytes)
    block, before = next(blocks), None
    for following in blocks:
        rows = scratch.store(rows.mapInArrow(searcher(block, False), f"doc_id {id_type}, text string, {fields}"), "found")
        if before is not None:
            scratch.drop(before)
        block, before = following, rows
    return rows.mapInArrow(searcher(block, True), f"doc_id {id_type}, {fields}")


def merge(spans: list[int]) -> list[int]:
    """Spans as start, end, start, end, ...: sorted, overlapping and touching ones joined."""
    out: list[int] = []
    for start, end in sorted(zip(spans[::2], spans[1::2])):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the benchmark windows found in it."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    lengths = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", lengths.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS t(i) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM d, ns, unnest(range(1, greatest(len(w) - n + 2, 1))) AS t(i)),
h AS (SELECT r, i, n, item_id FROM dw JOIN iw USING (n, win)),
p AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, i, n FROM h) x, unnest(range(0, n)) AS t(k) GROUP BY r),
s AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN s USING (r)
"""
