"""Substring deduplication over UTF-8 bytes: maximal repeats of an enhanced suffix array, found on the repeated parts only.

Every string of ``LENGTH`` bytes has one *anchor*: of the short strings (``GRAM`` bytes) within it, the one with the least
hash. Successive strings with the same anchor are a *run*, so equal strings lie in runs with equal anchors.

1. Runs are shuffled by their anchor's hash and sorted by it, by the hash of their bytes and by place; the stream of a
   list is read once. Of runs with the same bytes, all but the first are repeats as they are: the inside of every copy ends
   here, and a string that a third of all documents share costs no memory. Of the same runs within a slice of documents
   only the first is shuffled by its anchor, so such a list has a row for each slice.
2. What is left are the first runs of anchors whose runs differ: the edges of repeated passages. Their bytes are fetched
   and dealt by anchor to blocks. In a block, an enhanced suffix array (order by prefix doubling, common prefixes from the
   rounds' ranks) is scanned with a stack: each interval of the common-prefix tree that is at least ``LENGTH`` deep and
   whose occurrences differ in the byte to their left is a maximal repeat; all its occurrences but the first are repeats.
3. An anchor with more than ``HOT`` different runs is too large for a block. Its runs are cut again by a second anchor, the
   short string with the least hash of another function, and so on up to ``LEVELS`` times: equal strings have all their
   anchors in common. Only what no anchor tells apart is dealt out by each string's own hash.
4. The repeats of a document are merged and cut out.

Hashes have 64 bits; step 1 joins on two independent ones. "First" is by id, then by position.

Defined edge cases: null and empty texts lose nothing; ids that are null, repeated or not whole numbers are replaced, for
the order, by numbers in the order of (id, text), so repeated rows count as copies, of which one is first; texts are worked
on in slices of at most ``SCAN_BYTES``, a longer one alone (about 100 bytes of memory for each of its bytes); an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions, slices, stored, table, texts_of

LENGTH = 100
GRAM = 32
HOT, LEVELS = 6000, 2
BLOCK_BYTES = 1 << 20
SCAN_BYTES = 1 << 20
_RANDOM = np.random.default_rng(20240607).integers(1 << 63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_INVERSE = tuple(np.uint64(pow(int(m), -1, 1 << 64)) for m in _MULTIPLY)


def _powers(m: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, m, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Rolling:
    """Hashes of substrings of ``data``: h(l, r) is the sum of random numbers of the bytes times powers."""

    def __init__(self, data: np.ndarray, which: int):
        n = len(data)
        self.power = _powers(_MULTIPLY[which], n + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_RANDOM[which][data] * _powers(_INVERSE[which], n + 1)[:n], dtype=np.uint64)))

    def of(self, left, right) -> np.ndarray:
        h = (self.sums[right] - self.sums[left]) * self.power[left]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` successive values (van Herk): blocks' running minima from both ends."""
    n = len(v)
    pad = -n % width
    full = np.concatenate((v, np.full(pad, np.iinfo(v.dtype).max, v.dtype))).reshape(-1, width)
    ahead = np.minimum.accumulate(full, 1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, level: int = 0) -> tuple[np.ndarray, ...]:
    """(text, first string, last string, anchor's place, anchor's hash, hash of the bytes) of each run.

    Each ``level`` has its own order of the short strings, and so other anchors.
    """
    empty = tuple(np.zeros(0, np.int64) for _ in range(6))
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return empty
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    rolling = Rolling(data, 0)
    places = np.arange(len(data) - gram + 1)
    h = rolling.of(places, places + gram)
    if level:
        h = (h ^ (h >> np.uint64(31 + level))) * np.uint64(0x9E3779B97F4A7C15 + 2 * level)
        h ^= h >> np.uint64(32)
    mixed = (h & np.uint64(0xFFFFFFFF00000000)) | places.astype(np.uint64)
    anchor = (sliding_min(mixed, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of each string's start
    room = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(texts)), room)
    if not len(owner):
        return empty
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(room)[:-1])), room) + np.arange(len(owner))
    a = anchor[at]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (owner[1:] != owner[:-1])))
    head = np.flatnonzero(new)
    tail = np.concatenate((head[1:], [len(owner)])) - 1
    first, last, own, a = at[head], at[tail], owner[head], a[head]
    content = Rolling(data, 1).of(first, last + length)
    content = content ^ ((a - first).astype(np.uint64) << np.uint64(48)) ^ (last - first).astype(np.uint64)
    base = starts[own]
    return own, first - base, last - base, a - base, h[a].view(np.int64), content.view(np.int64)


def slice_repeats(ids: np.ndarray, first: np.ndarray, last: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """(id, first, last, hash, bytes' hash, sure) of a slice's runs, where all but the first of equal ones are ``sure`` repeats.

    Adjoining sure runs become one, and get a hash of their place, so that neither a text of one phrase over and over nor a
    phrase of very many texts piles up at the phrase.
    """
    order = np.lexsort((first, ids, c, h))
    again = (h[order][1:] == h[order][:-1]) & (c[order][1:] == c[order][:-1])
    sure = np.zeros(len(ids), bool)
    sure[order[1:][again]] = True
    follows = np.concatenate(([False], sure[1:] & sure[:-1] & (ids[1:] == ids[:-1]) & (first[1:] == last[:-1] + 1)))
    head = np.flatnonzero(~follows)
    tail = np.concatenate((head[1:], [len(ids)])) - 1
    spread = ((ids[head] * 1_000_003 + first[head]).astype(np.uint64) * _MULTIPLY[0]).view(np.int64) ^ h[head]
    return ids[head], first[head], last[tail], np.where(sure[head], spread, h[head]), c[head], sure[head].astype(np.int64)


def first_and_repeats(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Of runs sorted by anchor, bytes, id and place: repeats (kind 0), and first runs of each bytes (kind 1).

    A first run is given out only if its anchor has other bytes, too: the last one is held back until that is known.
    """
    held = None  # (row, its anchor has other bytes)
    for b in batches:
        if "sure" in b.schema.names:
            sure = b.column("sure").to_numpy() > 0
            if sure.any():
                yield _found(np.zeros(int(sure.sum()), np.int64), *(b.column(k).to_numpy()[sure] for k in ("h", "id", "first", "last")))
                b = b.filter(pa.array(~sure))
        n = b.num_rows
        if not n:
            continue
        h, c, i, first, last = (b.column(k).to_numpy() for k in ("h", "c", "id", "first", "last"))
        old = held[0] if held else None
        same_h = np.concatenate(([old is not None and old[0] == h[0]], h[1:] == h[:-1]))
        same = same_h & np.concatenate(([old is not None and old[1] == c[0]], c[1:] == c[:-1]))
        repeat = np.flatnonzero(same)
        head = np.flatnonzero(~same)
        hh, hc, hi, hf, hl = (x[head] for x in (h, c, i, first, last))
        joined = same_h[head]  # same anchor as the row before, other bytes
        if held:
            hh, hc, hi, hf, hl = (np.concatenate(([x], y)) for x, y in zip(old, (hh, hc, hi, hf, hl)))
            joined = np.concatenate(([held[1]], joined))
        many = joined.copy()
        many[:-1] |= joined[1:]
        if len(hh):
            held = ((hh[-1], hc[-1], hi[-1], hf[-1], hl[-1]), bool(many[-1]))
        edge = np.flatnonzero(many[:-1])
        yield _found(np.zeros(len(repeat), np.int64), h[repeat], i[repeat], first[repeat], last[repeat])
        yield _found(np.ones(len(edge), np.int64), hh[edge], hi[edge], hf[edge], hl[edge])
    if held and held[1]:
        h, _, i, first, last = held[0]
        yield _found(*(np.array([x], np.int64) for x in (1, h, i, first, last)))


def _found(*cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["kind", "h", "id", "first", "last"])


class EnhancedSuffixArray:
    """Suffixes of numbers (0: a separator) in the order of their first ``depth``, with common prefixes of neighbours."""

    def __init__(self, s: np.ndarray, depth: int = 2 * LENGTH):
        n = len(s)
        rank = s.astype(np.int64)
        self.ranks = {1: rank}
        k = 1
        while k < depth:
            second = np.zeros(n, np.int64)
            if k < n:
                second[: n - k] = rank[k:] + 1
            key = rank * (n + 258) + second
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
            k *= 2
            self.ranks[k] = rank
        self.order = order
        a, b = order[:-1], order[1:]
        common = np.zeros(n - 1, np.int64)
        for k in sorted(self.ranks, reverse=True):
            r = self.ranks[k]
            i, j = a + common, b + common
            ok = (i < n) & (j < n)
            common[ok] += k * (r[i[ok]] == r[j[ok]])
        self.common = common  # of each suffix and the next


def maximal_repeats(sa: EnhancedSuffixArray, left: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, occurrences) of each maximal repeat of at least ``least``: intervals of the common-prefix tree.

    ``left``: what stands before each position; numbers above 255 differ from everything. The stack holds, for each open
    interval, its depth, its first row and whether its occurrences have different left sides.
    """
    rows = np.flatnonzero(sa.common >= least)
    if not len(rows):
        return
    cuts = np.flatnonzero(rows[1:] != rows[:-1] + 1) + 1
    for part in np.split(rows, cuts):
        lo = int(part[0])
        depth = [*sa.common[lo : int(part[-1]) + 1].tolist(), 0]
        sides = left[sa.order[lo : int(part[-1]) + 2]].tolist()
        stack: list[list] = []  # depth, first row, left side (-1: different ones)
        for row, d in enumerate(depth):
            side, first = sides[row], row
            while stack and stack[-1][0] > d:
                deep, first, own = stack.pop()
                side = own if own == side and side < 256 else -1
                if side == -1:
                    yield deep, sa.order[lo + first : lo + row + 1]
            if d >= least:
                if stack and stack[-1][0] == d:
                    stack[-1][2] = stack[-1][2] if stack[-1][2] == side and side < 256 else -1
                else:
                    stack.append([d, first, side])


def block_repeats(ids: np.ndarray, firsts: np.ndarray, parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, start, end) of all but the first occurrence of each maximal repeat among ``parts``."""
    sizes = np.array([len(p) + 1 for p in parts])
    data = np.zeros(int(sizes.sum()), np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    body = np.ones(len(data), bool)
    body[starts + sizes - 1] = False
    data[body] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64) + 1
    left = np.concatenate(([0], data[:-1])) - 1
    left[starts] = 1000  # nothing is known there, so it counts as different
    left[~body] = 1000
    sa = EnhancedSuffixArray(data, max(map(len, parts), default=1))
    # a common prefix can't reach over a separator
    ends = np.repeat(starts + sizes - 1, sizes)
    sa.common = np.minimum(sa.common, (ends - np.arange(len(data)))[sa.order[:-1]])
    sa.common = np.minimum(sa.common, (ends - np.arange(len(data)))[sa.order[1:]])
    out: list[list[np.ndarray]] = [[], [], []]
    for depth, at in maximal_repeats(sa, left, length):
        part = np.searchsorted(starts, at, "right") - 1
        i, s = ids[part], firsts[part] + at - starts[part]
        rest = np.lexsort((s, i))[1:]
        out[0].append(i[rest])
        out[1].append(s[rest])
        out[2].append(s[rest] + depth)
    if not out[0]:
        return tuple(np.zeros(0, np.int64) for _ in out)  # type: ignore[return-value]
    i, s, e = (np.concatenate(x) for x in out)
    order = np.lexsort((s, i))
    i, s, e = i[order], s[order], e[order]
    # nested repeats and neighbouring edges overlap: one span for each stretch of a document
    turn = np.cumsum(np.concatenate(([True], i[1:] != i[:-1])))
    reach = np.maximum.accumulate(e + turn * (1 << 40)) - turn * (1 << 40)
    new = np.concatenate(([True], (i[1:] != i[:-1]) | (s[1:] > reach[:-1])))
    head = np.flatnonzero(new)
    return i[head], s[head], reach[np.concatenate((head[1:], [len(i)])) - 1]


def _spans(i, s, e) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (i, s, e)], names=["id", "start", "end"])


def search_blocks(batches: Iterable[pa.RecordBatch], length: int, block_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Edges sorted by anchor, in blocks of whole anchors."""
    ids: list[int] = []
    firsts: list[int] = []
    parts: list[bytes] = []
    size, last = 0, None
    for b in batches:
        for h, i, f, p in zip(*(b.column(k).to_pylist() for k in ("h", "id", "first", "bytes"))):
            if h != last and size >= block_bytes:
                yield _spans(*block_repeats(np.array(ids), np.array(firsts), parts, length))
                ids, firsts, parts, size = [], [], [], 0
            last = h
            ids.append(i)
            firsts.append(f)
            parts.append(p)
            size += len(p)
    if parts:
        yield _spans(*block_repeats(np.array(ids), np.array(firsts), parts, length))


def ordered_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, id, text``, where ``id`` is a whole number for each row in the order of the ids."""
    rows = texts_of(docs, id_col, text_col)
    if rows.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        ids = rows.select("doc_id")
        odd = ids.where("doc_id is null").isEmpty() and ids.groupBy("doc_id").count().where("count > 1").isEmpty()
        if odd:
            return rows.select("doc_id", F.col("doc_id").cast("long").alias("id"), "text")
    parts = shuffle_partitions(docs.sparkSession)
    ranged = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return stored(ranged.select("doc_id", F.monotonically_increasing_id().alias("id"), "text"), "ordered")


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, level: int = 0) -> DataFrame:
    """``id, start, end`` of bytes of ``rows (id long, text)`` that are repeats; spans may overlap.

    At a ``level`` above 0, rows also have a number ``g``; only the strings of rows with the same one are compared.
    """
    scratch = Scratch(rows.sparkSession)

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, limit=SCAN_BYTES):
                ids = b.column("id").to_numpy()
                own, first, last, _, h, c = runs(b.column("text").cast(pa.binary()).to_pylist(), length, gram, level)
                if not len(own):
                    continue
                if level:
                    h = h ^ (b.column("g").to_numpy()[own] * np.int64(0x1E3779B97F4A7C15))
                i, first, last, h, c, sure = slice_repeats(ids[own], first, last, h, c)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, c, i, first, last, sure)], names=["h", "c", "id", "first", "last", "sure"])

    all_runs = rows.mapInArrow(emit, "h long, c long, id long, first long, last long, sure long")
    sorted_runs = all_runs.repartition("h").sortWithinPartitions("h", "c", "id", "first")
    found = scratch.store(sorted_runs.mapInArrow(lambda b: first_and_repeats(b, length), "kind long, h long, id long, first long, last long"), "runs")
    whole = found.where("kind = 0").select("id", F.col("first").alias("start"), (F.col("last") + length).alias("end"))

    edges = found.where("kind = 1").select("h", "id", "first", "last")
    wanted = edges.groupBy("id").agg(F.collect_list(F.struct("h", "first", "last")).alias("edges"))  # at most a text's length

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                out: list[list] = [[], [], [], []]
                for i, t, own in zip(b.column("id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("edges").to_pylist()):
                    for edge in own:
                        for col, v in zip(out, (edge["h"], i, edge["first"], t[edge["first"] : edge["last"] + length])):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], names=["h", "id", "first", "bytes"])

    contexts = scratch.store(rows.select("id", "text").join(wanted, "id").mapInArrow(fetch, "h long, id long, first long, bytes binary"), "edges")
    hot_anchors = scratch.store(contexts.groupBy("h").count().where(F.col("count") > hot).select("h"), "hot")
    usual = contexts.join(hot_anchors, "h", "left_anti")
    in_blocks = usual.repartition("h").sortWithinPartitions("h", "id").mapInArrow(lambda b: search_blocks(b, length), "id long, start long, end long")
    out = whole.unionByName(in_blocks)
    if not hot_anchors.isEmpty():
        out = out.unionByName(_hot_repeats(contexts.join(hot_anchors, "h", "left_semi"), length, gram, hot, level + 1))
    return out


def _hot_repeats(contexts: DataFrame, length: int, gram: int, hot: int, level: int) -> DataFrame:
    """The repeats of anchors with very many different runs: these are cut again by other anchors, at last string by string."""
    if level > LEVELS:
        return _equal_strings(contexts, length)
    parts = shuffle_partitions(contexts.sparkSession)
    ordered = contexts.repartitionByRange(parts, "id", "first").sortWithinPartitions("id", "first")
    numbered = stored(ordered.select("id", "first", "h", "bytes", F.monotonically_increasing_id().alias("number")), "hot")
    inner = repeated_spans(numbered.select(F.col("number").alias("id"), F.col("bytes").alias("text"), F.col("h").alias("g")), length, gram, hot, level)
    back = inner.withColumnRenamed("id", "number").join(numbered.select("number", "id", "first"), "number")
    return back.select("id", (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("end")).alias("end"))


def _equal_strings(contexts: DataFrame, length: int) -> DataFrame:
    """Each string of the contexts dealt out by its own 128-bit hash: all places but the first."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, f, p in zip(*(b.column(k).to_pylist() for k in ("id", "first", "bytes"))):
                h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(p[k : k + length]) for k in range(len(p) - length + 1)), np.int64).reshape(-1, 2)
                at = np.arange(f, f + len(h))
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(np.full(len(h), i)), pa.array(at), pa.array(at)], names=["h", "c", "id", "first", "last"])

    strings = contexts.mapInArrow(emit, "h long, c long, id long, first long, last long")
    found = strings.repartition("h", "c").sortWithinPartitions("h", "c", "id", "first").mapInArrow(lambda b: first_and_repeats(b, length), "kind long, h long, id long, first long, last long")
    return found.where("kind = 0").select("id", F.col("first").alias("start"), (F.col("last") + length).alias("end"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, spans, kept``.

    ``spans`` has start and end of each removed run of bytes, alternating; ``kept`` is the remaining bytes.
    """
    rows = ordered_ids(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    lists = repeated_spans(rows.select("id", "text"), length, gram).groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("repeats"))
    joined = rows.join(lists, "id", "left").select("doc_id", "text", "repeats")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                out: list[list] = [[], [], [], [], []]
                repeats = b.column("repeats")
                for k, t in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                    spans: list[int] = []
                    if repeats[k].is_valid:
                        own = repeats[k].values
                        for s, e in sorted(zip(own.field("start").to_pylist(), own.field("end").to_pylist())):
                            if spans and s <= spans[-1]:
                                spans[-1] = max(spans[-1], e)
                            else:
                                spans += [s, e]
                    kept = b"".join(t[a:z] for a, z in zip([0, *spans[1::2]], [*spans[::2], len(t)]))
                    for col, v in zip(out, (len(t), len(t) - len(kept), len(spans) // 2, spans, kept)):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return joined.mapInArrow(cut, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary")


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the bytes that repeats remove from it."""
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
