"""Self-join of documents on the Jaccard similarity of their word shingles, by T-occurrence search (DivideSkip).

1. Each text becomes the set of its distinct five-word shingles (64-bit hashes). Equal sets, by a 128-bit hash, are one
   *node*.
2. Prefix filter: two sets of similarity s share 1 + e of their first n - ceil(s n) + 1 + e shingles in any fixed order. The
   order puts shingles last that are frequent in a bounded sample of documents: this decides the cost only, not the
   result. The prefix shingles are dealt to tasks by ranges of (shingle, size, set) and sorted; those whose list has another
   set of a fitting size are *live*. Sets with fewer than 1 + e live ones are linked with nothing and drop out; the others
   may each leave out the e / 2 of them whose lists are longest. Of the lists that are left, neighbours whose sizes fit are
   chained, and the chains' connected components are the *groups*: no link crosses two groups. Ranges cut a list that a third of all sets share into many tasks; the chain over a cut is closed afterwards
   from the ranges' first and last rows.
3. A group is searched in blocks of at most about ``BLOCK_SHINGLES`` shingles. A larger group is dealt to blocks by size, so
   that only blocks meet whose sizes fit. A unit of work is one block, or two: an inverted index over one block is asked for
   the sets of the other. Of a query's lists, the short ones are merged by a heap, the long ones are probed by binary search
   for the candidates that can still reach the overlap T. Shingles with equal lists count as one list with a weight, and a
   list is kept in words of 64 neighbouring sets, so the heap merges a word at a time and passes over words whose lists
   don't weigh enough together.
4. Links become components; copies share their node's component.

Every link is found, and counted once: there is no cap on lists, candidates or groups. A list or group of any size is
streamed or cut into blocks, so no task holds more than two blocks of sets.

Defined edge cases: fewer words than a shingle has: the whole sequence is the one shingle; no words or a null text: an
empty set, linked with nothing; rows that repeat an id are documents each, and with an equal set they share a component;
null ids are grouped like any id but never represent others; a text of any length is one set (about 40 bytes of memory a
word while it is made); an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, giving_back, shuffle_partitions, slices, table, text_bytes, texts_of
from .components import connected_components

SHINGLE = 5
PERCENT = 75
#: A unit of work holds two blocks of so many shingles, or single larger sets.
BLOCK_SHINGLES = 1 << 19
#: Shingles beyond the shortest prefix (e above), in per cent of the set.
EXTRA = 12
SAMPLE_DOCS = 8000
#: Frequent: in so many of the sample's sets. At most ``FREQUENT`` of them, the commonest, are used.
SAMPLE_LEAST, FREQUENT = 4, 1 << 20
#: Weight of binary probes against merging, for the number of long lists.
MU = 0.03
#: Size classes by which a large group is dealt to blocks, for a factor of two.
CLASSES = 8
#: Sets whose copies a task recognises, so that it gives their prefixes out once. Beyond it they are given out again.
KNOWN_SETS = 1 << 16
SCAN_BYTES = 1 << 20
#: So many ids are broadcast (about 100 MB); beyond it the texts are shuffled to them.
BROADCAST_IDS = 1 << 22

_BYTE = np.random.default_rng(20250611).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_hashes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, where it begins); words don't reach over ``starts``, where texts begin.

    A word's hash is the sum of random numbers of its bytes times powers of a constant, mixed: differences of running sums.
    """
    word = ~_BLANK[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[starts] = True
    opens = word & edge[:-1]
    opens[1:] |= word[1:] & ~word[:-1]
    closes = word & edge[1:]
    closes[:-1] |= word[:-1] & ~word[1:]
    closes[-1:] |= word[-1:]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    out = np.zeros(len(first), np.uint64)
    at = 0
    while at < len(first):  # at most about SCAN_BYTES at once, so that long texts need no more memory
        end = max(at + 1, int(np.searchsorted(last, first[at] + SCAN_BYTES, "right")))
        base, stop = first[at], last[end - 1]
        n = int(stop - base)
        back = np.full(n, _BACK, np.uint64)
        back[:1] = 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw[base:stop]] * np.cumprod(back, dtype=np.uint64), dtype=np.uint64, out=sums[1:])
        ahead = np.full(n, _STEP, np.uint64)
        ahead[:1] = 1
        ahead = np.cumprod(ahead, dtype=np.uint64)
        a, z = first[at:end] - base, last[at:end] - base
        out[at:end] = _mixed((sums[z] - sums[a]) * ahead[a])
        at = end
    return out, first


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text."""
    raw, edges = text_bytes(texts)
    if not len(raw):
        return [np.zeros(0, np.int64) for _ in range(len(texts))]
    h, first = word_hashes(raw, edges[:-1][edges[:-1] < len(raw)])
    begin = np.searchsorted(first, edges).tolist()
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for i in range(size):
        out = _mixed(out * _STEP + h[i : len(h) - size + 1 + i])
    sets = []
    for a, z in zip(begin[:-1], begin[1:]):
        if z - a >= size:
            sets.append(np.unique(out[a : z - size + 1].view(np.int64)))
        elif z > a:  # the whole sequence
            sets.append(np.array([xxhash.xxh3_64_intdigest(h[a:z].tobytes(), z - a)], np.uint64).view(np.int64))
        else:
            sets.append(np.zeros(0, np.int64))
    return sets


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two whole numbers."""
    low, high = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist()
    return low, high


def prefix(s: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The shingles that a set of that similarity can't all lack, seldom ones first."""
    n = len(s)
    keep = n + (-percent * n // 100) + 1 + EXTRA * n // 100
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        known = frequent[at] == s
        s = np.concatenate((s[~known], s[known]))
    return s[:keep]


def frequent_shingles(docs: DataFrame, sample_docs: int, least: int, size: int) -> np.ndarray:
    """Shingles of at least ``least`` different sets among ``sample_docs`` documents (those of the smallest id hash).

    Ids are picked before texts are read. At most ``FREQUENT`` shingles come to the driver.
    """
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).distinct()
    sample = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("text")  # at most sample_docs numbers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                for s in shingle_sets(b.column("text"), size):
                    yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.full(len(s), set_key(s)[0]))], names=["t", "k"])

    found = sample.mapInArrow(run, "t long, k long").distinct().groupBy("t").count().where(F.col("count") >= least)
    return np.sort(np.array([r["t"] for r in found.orderBy(F.desc("count"), "t").limit(FREQUENT).collect()], np.int64))


class Forest:
    """Union-find that keeps only the edges that join something."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        parent, root = self.parent, x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    def join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.edges.append((a, b))


def _edges_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])


def distinct_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(t, n, k) of postings sorted by them, equal ones once; each piece begins with the row before it, if there is one."""
    last = None
    for b in batches:
        t, n, k = (b.column(c).to_numpy() for c in ("t", "n", "k"))
        if not len(t):
            continue
        new = np.concatenate(([last is None or (t[0], n[0], k[0]) != last], (t[1:] != t[:-1]) | (n[1:] != n[:-1]) | (k[1:] != k[:-1])))
        t, n, k = t[new], n[new], k[new]
        if not len(t):
            continue
        if last is not None:
            t, n, k = (np.concatenate(([x], y)) for x, y in zip(last, (t, n, k)))
        last = (t[-1], n[-1], k[-1])
        yield t, n, k


def live_postings(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of a range of postings sorted by shingle, size and node: those with a neighbour of a fitting size.

    The first and the last row count as live, too: their neighbours may lie in other ranges.
    """
    start, before = True, False  # whether the last row has been given out already
    held = None
    for t, n, k in distinct_rows(batches):
        fits = (t[1:] == t[:-1]) & (n[:-1] * 100 >= n[1:] * percent)
        live = np.concatenate(([False], fits)) | np.concatenate((fits, [False]))
        out = live.copy()
        out[0] |= start
        if not start:
            out[0] &= not before
        before = bool(live[-1]) or bool(out[-1])
        start, held = False, (t[-1:], n[-1:], k[-1:])
        yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (t, n, k)], names=["t", "n", "k"])
    if held and not before:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["t", "n", "k"])


def chain_lists(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of a range of postings sorted by shingle, size and node: rows (a, b, t, n) of two kinds.

    Edges (a, b) of a spanning forest of the neighbours whose sizes fit, with null t; and the range's first and last
    posting as (k, k, t, n).
    """

    def shown(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        e = _edges_batch(edges)
        return pa.RecordBatch.from_arrays([*e.columns, pa.nulls(e.num_rows, pa.int64()), pa.nulls(e.num_rows, pa.int64())], names=["a", "b", "t", "n"])

    forest, first, last = Forest(), None, None
    for t, n, k in distinct_rows(batches):
        first = first or (int(k[0]), int(t[0]), int(n[0]))
        last = (int(k[-1]), int(t[-1]), int(n[-1]))
        ok = np.flatnonzero((t[1:] == t[:-1]) & (n[:-1] * 100 >= n[1:] * percent))
        pairs = np.unique(np.stack((k[ok], k[ok + 1]), 1), axis=0)
        for a, c in pairs.tolist():
            forest.join(a, c)
        if len(forest.edges) >= 50_000:
            yield shown(forest.edges)
            forest.edges = []
            if len(forest.parent) > 1_000_000:  # edges may come again, but memory is bounded
                forest = Forest()
    if forest.edges:
        yield shown(forest.edges)
    if first:
        k, t, n = (np.array(x, np.int64) for x in zip(first, last))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k, k, t, n)], names=["a", "b", "t", "n"])


def distinctive(live: DataFrame, percent: int) -> DataFrame:
    """Live postings without those of sets that have too few, and without the e / 2 longest lists of each other set.

    Linked sets share 1 + e live shingles, e by the larger of the two, so they still share one after each has given up half.
    """
    spare = F.floor(EXTRA * F.floor(percent * F.col("n") / 100) / 100)  # e
    lengths = live.groupBy("t").agg(F.count("*").alias("length"))
    own = Window.partitionBy("k", "n")
    ranked = live.join(lengths, "t").withColumns({"all": F.count("*").over(own), "place": F.row_number().over(own.orderBy(F.desc("length"), "t"))})
    return ranked.where((F.col("all") > spare) & (F.col("place") > F.floor(spare / 2))).select("t", "n", "k")


def chained(live: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Edges ``(a, b)`` that connect, list by list, the neighbours whose sizes fit."""
    n = shuffle_partitions(live.sparkSession)
    rows = live.repartitionByRange(n, "t", "n", "k").sortWithinPartitions("t", "n", "k").mapInArrow(giving_back(lambda b: chain_lists(b, percent)), "a long, b long, t long, n long")
    found = scratch.store(rows, "chains")
    ends = found.where("t is not null").select("t", "n", F.col("a").alias("k"))  # two rows for each range
    over = ends.repartition(1).sortWithinPartitions("t", "n", "k").mapInArrow(giving_back(lambda b: chain_lists(b, percent)), "a long, b long, t long, n long")
    return found.unionByName(over).where("t is null").select("a", "b")


class InvertedLists:
    """Lists of the sets that have a shingle, sorted. Shingles whose lists are equal share one list.

    The shingles of a passage that some texts have in common have equal lists, so a query meets few lists, each with a weight:
    how many of its shingles the list stands for.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        owner = owner[order]
        self.tokens, first, length = np.unique(tokens[order], return_index=True, return_counts=True)
        # lists with equal sums of their sets' random numbers (128 bits) are equal
        one, two = (np.add.reduceat(r[owner], first) for r in np.random.default_rng(7).integers(1 << 63, size=(2, len(sets)), dtype=np.uint64))
        order = np.argsort(one, kind="stable")
        new = np.concatenate(([True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])))
        self.list_of_token = np.empty(len(first), np.int64)
        self.list_of_token[order] = np.cumsum(new) - 1
        keep = order[new]
        self.length = length[keep]
        self.first = np.cumsum(self.length) - self.length
        self.owner = owner[np.repeat(first[keep] - self.first, self.length) + np.arange(self.length.sum())]
        # each list as words of 64 neighbouring sets: the word's number and which of its sets are in the list
        word = (self.owner >> 6) + np.repeat(np.arange(len(self.length)), self.length) * (len(sets) // 64 + 1)
        new = np.concatenate(([True], word[1:] != word[:-1]))
        at = np.flatnonzero(new)
        self.words = self.owner[at] >> 6
        self.masks = np.bitwise_or.reduceat(np.uint64(1) << (self.owner & 63).astype(np.uint64), at)
        self.first_word = np.searchsorted(at, np.append(self.first, len(self.owner)))
        self.streams: dict[int, list[tuple[int, int, int]]] = {}

    def list_at(self, i: int) -> np.ndarray:
        return self.owner[self.first[i] : self.first[i] + self.length[i]]

    def stream(self, i: int) -> list[tuple[int, int, int]]:
        """The list's (word, list, place of the mask), in order."""
        own = self.streams.get(i)
        if own is None:
            a, z = int(self.first_word[i]), int(self.first_word[i + 1])
            own = self.streams[i] = list(zip(self.words[a:z].tolist(), repeat(i), range(a, z)))
        return own

    def merged(self, lists: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(sets in lists that weigh at least ``least`` together, how much they weigh).

        A heap merges the lists word by word; the sets of a word are told apart only if its lists weigh enough together.
        """
        single = self.length[lists] == 1
        streams = [self.stream(i) for i in lists[~single].tolist()]
        if single.any():  # lists of one set each: one sorted stream
            own = lists[single]
            at = self.first_word[own]
            order = np.argsort(self.words[at], kind="stable")
            streams.append(list(zip(self.words[at][order].tolist(), own[order].tolist(), at[order].tolist())))
        weight = dict(zip(lists.tolist(), weights.tolist()))
        found, counts = [], []

        def close(word: int, total: int, places: list[int], own: list[int]) -> None:
            if total < least:
                return
            bits = np.unpackbits(self.masks[places].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            count = np.array(own) @ bits
            hit = np.flatnonzero(count >= least)
            found.append(word * 64 + hit)
            counts.append(count[hit])

        now, total, places, own = -1, 0, [], []
        for word, i, place in heapq.merge(*streams):
            if word != now:
                close(now, total, places, own)
                now, total, places, own = word, 0, [], []
            w = weight[i]
            total += w
            places.append(place)
            own.append(w)
        close(now, total, places, own)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found), np.concatenate(counts)

    def overlaps(self, query: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(sets similar to the query, their overlap with it), by DivideSkip."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = len(query)
        fits = (self.sizes * 100 >= n * percent) & (n * 100 >= self.sizes * percent)
        if not fits.any():
            return none
        smallest = int(self.sizes[fits].min())
        least = -(-percent * (n + smallest) // (100 + percent))  # overlap T that the smallest partner needs
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        if len(at) < least:
            return none
        lists, weights = np.unique(self.list_of_token[at], return_counts=True)
        length = self.length[lists]
        most = min(least - 1, int(least / (MU * np.log2(max(2, length.max())) + 1)))
        order = np.argsort(-length, kind="stable")
        lists, weights = lists[order], weights[order]
        long = int(np.searchsorted(np.cumsum(weights), most, "right"))  # the longest lists, with a weight of ``most``
        left = int(weights[:long].sum())
        found, count = self.merged(lists[long:], weights[long:], least - left)
        keep = fits[found]
        found, count = found[keep], count[keep]
        need = -(-percent * (n + self.sizes[found]) // (100 + percent))
        for i, w in zip(lists[:long].tolist(), weights[:long].tolist()):
            keep = count + left >= need
            if not keep.all():
                found, count, need = found[keep], count[keep], need[keep]
            if not len(found):
                return none
            own = self.list_at(i)
            spot = np.minimum(np.searchsorted(own, found), len(own) - 1)
            count = count + w * (own[spot] == found)
            left -= w
        keep = count * 100 >= percent * (n + self.sizes[found] - count)
        return found[keep], count[keep]


def search_units(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit (of one block, or of two) become rows (a, b, links): forest edges, and each node's links."""

    def work(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        own = {(r[1], r[2]): r for r in rows}  # a node may come once for each of equal rows
        sides = [sorted((r for r in own.values() if r[1] == side), key=lambda r: r[2]) for side in (0, 1, 2)]
        if sides[2]:  # one block
            sides = [sides[2], []]
        elif not sides[0] or not sides[1]:
            return
        both = [*sides[0], *sides[1]]
        node, copies = (np.array([r[k] for r in both], np.int64) for k in (2, 3))
        lists = InvertedLists([r[4] for r in sides[0]])
        group, links, edges = np.arange(len(both)), np.zeros(len(both), np.int64), []
        for q in range(len(sides[0]) if sides[1] else 0, len(both)):
            found, _ = lists.overlaps(both[q][4], percent)
            found = found if sides[1] else found[found < q]  # each pair of one block once
            if not len(found):
                continue
            links[q] += copies[found].sum()
            links[found] += copies[q]
            met = np.unique(np.append(group[found], group[q]))
            if len(met) > 1:
                edges += [(node[met[0]], node[g], 0) for g in met[1:]]
                group[np.isin(group, met[1:])] = met[0]
        edges += [(node[i], node[i], links[i]) for i in np.flatnonzero(links)]
        if edges:
            cols = np.array(edges, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cols[:, i]) for i in range(3)], names=["a", "b", "links"])

    unit, rows = None, []
    for b in batches:
        sets = b.column("shingles")
        for i, (u, side, k, copies) in enumerate(zip(*(b.column(c).to_pylist() for c in ("unit", "side", "node", "copies")))):
            if u != unit:
                yield from work(rows)
                unit, rows = u, []
            rows.append((u, side, k, copies, sets[i].values.to_numpy().copy()))
    yield from work(rows)


def placed_units(wanted: DataFrame, percent: int, block_shingles: int) -> DataFrame:
    """``node, unit, side`` of each unit in which a node takes part (side 2: alone with its own block).

    A group of at most ``block_shingles`` is one block. The sets of a larger one get a class by size, each class is dealt by
    hash to blocks, and two blocks meet where sizes of their classes can lie within ``percent``.
    """
    whole = wanted.groupBy("component").agg(F.sum("n").alias("total"))
    sized = wanted.select("node", "component", "n").join(whole, "component")
    sized = sized.withColumn("class", F.when(F.col("total") > block_shingles, F.floor(F.log2("n") * CLASSES)).otherwise(0).cast("int"))
    blocks = sized.groupBy("component", "class").agg(F.ceil(F.sum("n") / block_shingles).alias("blocks"), F.min("n").alias("low"), F.max("n").alias("high"))
    own = sized.join(blocks, ["component", "class"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    fits = blocks.select("component", F.col("class").alias("other_class"), F.col("blocks").alias("others"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
    met = own.join(fits, "component").where((F.col("high") * 100 >= F.col("other_low") * percent) & (F.col("other_high") * 100 >= F.col("low") * percent))
    met = met.select("node", "component", "class", "own", "other_class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)).alias("other"))
    here, there = F.struct("class", "own"), F.struct(F.col("other_class").alias("class"), F.col("other").alias("own"))
    side = F.when(here == there, 2).otherwise((here > there).cast("int"))
    low, high = F.least(here, there), F.greatest(here, there)
    return met.select("node", F.concat_ws(":", "component", low["class"], low["own"], high["class"], high["own"]).alias("unit"), side.alias("side"))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, n_links``.

    ``component_id`` is the smallest id that links reach, ``n_links`` how many other documents are linked directly.
    """
    spark = docs.sparkSession
    scratch, parts = Scratch(spark), shuffle_partitions(spark)
    rows = texts_of(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    frequent = frequent_shingles(rows, SAMPLE_DOCS, SAMPLE_LEAST, size)

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[tuple[int, int]] = set()
        for batch in batches:
            for b in slices(batch):
                sets = shingle_sets(b.column("text"), size)
                own = [set_key(s) for s in sets]
                first = []
                for s, k in zip(sets, own):
                    first.append(None if k in known else prefix(s, frequent, percent))
                    if len(known) < KNOWN_SETS:
                        known.add(k)
                k1, k2 = np.array(own, np.int64).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1), pa.array(k2), pa.array(first, pa.list_(pa.int64()))], names=["doc_id", "n", "k1", "k2", "first"])

    scanned = scratch.store(rows.mapInArrow(giving_back(keys), f"doc_id {id_type}, n long, k1 long, k2 long, first array<long>"), "sets")
    members = scratch.store(scanned.select("doc_id", "n", "k1", "k2"), "members")
    nodes = scratch.store(members.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "nodes")

    # Groups may join too much: here a set is known by half of its key.
    postings = scanned.where("n > 0").select(F.explode("first").alias("t"), "n", F.col("k1").alias("k"))
    ranged = postings.repartitionByRange(parts, "t", "n", "k").sortWithinPartitions("t", "n", "k")
    live = scratch.store(ranged.mapInArrow(giving_back(lambda b: live_postings(b, percent)), "t long, n long, k long"), "live")
    scratch.drop(scanned)
    edges = scratch.store(chained(distinctive(live, percent), percent, scratch), "edges")
    scratch.drop(live)
    groups = scratch.store(connected_components(edges), "groups")  # node, component
    scratch.drop(edges)

    # From here on a node is a number of its own.
    wanted = nodes.join(groups, nodes["k1"] == groups["node"]).select("k1", "k2", "n", "least", "copies", "component", F.monotonically_increasing_id().alias("node"))
    wanted = scratch.store(wanted, "wanted")
    units = placed_units(wanted, percent, block_shingles)

    @giving_back
    def full(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                sets = shingle_sets(b.column("text"), size)
                k1, k2 = np.array([set_key(s) for s in sets], np.int64).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(sets, pa.list_(pa.int64()))], names=["k1", "k2", "shingles"])

    def sets_of(some: DataFrame, of: DataFrame) -> DataFrame:
        return some.mapInArrow(full, "k1 long, k2 long, shingles array<long>").join(of.select("k1", "k2", "node", "copies"), ["k1", "k2"]).drop("k1", "k2")

    ids = wanted.select(F.col("least").alias("doc_id")).distinct()
    texts = rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")  # beyond it, texts are shuffled
    nameless = rows.where("doc_id is null").dropDuplicates(["text"])  # for nodes that no id leads to
    sets = sets_of(texts, wanted).unionByName(sets_of(nameless, wanted.where("least is null")))
    work = sets.join(units, "node").select("unit", "side", "node", "copies", "shingles")
    found = work.repartition(parts, "unit").sortWithinPartitions("unit", "side", "node").mapInArrow(giving_back(lambda b: search_units(b, percent)), "a long, b long, links long")
    found = scratch.store(found, "found")

    linked = connected_components(found.where("a <> b").select("a", "b"))
    heads = linked.join(wanted.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("head"))
    heads = linked.join(heads, "component").select("node", "head")
    counts = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    reached = wanted.select("k1", "k2", "node").join(heads, "node").join(counts, "node").select("k1", "k2", "head", "links")
    of_node = nodes.join(reached, ["k1", "k2"], "left").select("k1", "k2", F.coalesce("head", "least").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = members.where("n > 0").join(of_node, ["k1", "k2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    empty = members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return known.unionByName(empty)


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its component of near duplicates."""
    return jaccard_classes(table(spark, sf_dir, "documents"))


OP2_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
o AS (SELECT a.r AS r1, b.r AS r2, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
l AS (SELECT r1, r2 FROM o JOIN n n1 ON n1.r = r1 JOIN n n2 ON n2.r = r2 WHERE 100 * c >= {PERCENT} * (n1.n + n2.n - c)),
p AS (SELECT r AS r1, r AS r2 FROM d UNION SELECT p.r1, l.r2 FROM p JOIN l ON p.r2 = l.r1)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(e.doc_id) AS component_id, (SELECT count(*) FROM l WHERE l.r1 = d.r) AS n_links
FROM d JOIN p ON p.r1 = d.r JOIN d e ON e.r = p.r2 LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id
"""
