"""Shortest-pack-first packing of tokenised documents, planned on the histogram of lengths.

1. Each document becomes its token ids and one end id. Full sequences are cut off its front; the remainder is an item.
2. Shortest-pack-first runs over the *counts* of the items' lengths, longest first: equal packs are one pattern with a count, an
   item goes to the pattern with most room, and as many packs of it as there are items move to the pattern that is longer by the
   item. Where nothing fits, as few new packs are opened as can hold all items of the length.
3. Cutting is free, so the emptiest packs are given up, as many as hold what the others lack, and their items, laid end to end, fill
   the others' room, widest first, so that few documents are cut, and few of these often. What remains after the last full sequence is
   cut into sequences whose lengths are powers of two, which need no padding.
4. Each item gets its rank within its length and takes the place planned for it. Ranks are counted in chunks of about ``CHUNK_ROWS``
   rows (more where a length would have over ``MOST_CHUNKS`` of them), so a length that most items share is no single task.
5. Places go back to their documents, whose ids are cut there.

The plan has some thousands of runs at most, whatever the size of the table: it depends on the lengths that occur, and travels with
the tasks. A run says "ranks from a on of length L go to sequences from s on, one each, at offset o", or "... lie end to end in the
stream from p on"; a run of gaps says "the stream from p on fills gaps of r tokens in sequences from s on". Ids are stored once, by 2
bytes where the vocabulary allows, and shuffled once.

Defined edge cases: a null or empty text is the end id alone; a null id stays null; repeated rows are packed each; texts are encoded in
runs of at most ``SLICE_BYTES``, a longer one alone; an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import giving_back, slices, stored, table
from .packing import CHUNK_ROWS, END_ID, MOST_CHUNKS, RANKS, TOKENIZER, ByteEncoder, vocabulary

CAPACITY = 1024
#: Room of fewer tokens is padded instead of filled by a cut; 1 fills everything.
LEAST_FILL = 1
#: Bits for a rank in a number that holds length and rank.
SHIFT = 48


@dataclass
class Pattern:
    """``n`` packs alike: pack i is sequence ``first + i`` and holds rank ``rank + i`` of each ``(length, rank, offset)`` of ``items``."""

    room: int
    first: int
    n: int
    items: list[tuple[int, int, int]]

    def take(self, k: int) -> tuple[Pattern, Pattern]:
        """The first ``k`` packs and the others."""
        rest = [(length, rank + k, offset) for length, rank, offset in self.items]
        return Pattern(self.room, self.first, k, self.items), Pattern(self.room, self.first + k, self.n - k, rest)


@dataclass
class Plan:
    #: ``(length, first rank, first sequence, offset)``
    placed: list[tuple[int, int, int, int]] = field(default_factory=list)
    #: ``(length, first rank, place in the stream)``
    laid: list[tuple[int, int, int]] = field(default_factory=list)
    #: ``(place in the stream, tokens, first sequence, offset)``, in the stream's order
    gaps: list[tuple[int, int, int, int]] = field(default_factory=list)


def shortest_pack_first(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns of packs that hold ``counts[length]`` items of each length."""
    by_room: dict[int, list[Pattern]] = {}
    rooms: list[int] = []  # sorted

    def put(p: Pattern) -> None:
        if p.n:
            if p.room not in by_room:
                by_room[p.room] = []
                insort(rooms, p.room)
            by_room[p.room].append(p)

    sequences = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            if not rooms or rooms[-1] < length:
                n = -(-left // (capacity // length))
                put(Pattern(capacity, sequences, n, []))
                sequences += n
            room = rooms[-1]
            widest = by_room[room].pop()
            own, rest = widest.take(min(left, widest.n))
            if not by_room[room]:
                del by_room[room], rooms[-1]
            put(rest)
            put(Pattern(room - length, own.first, own.n, [*own.items, (length, rank, capacity - room)]))
            left -= own.n
            rank += own.n
    return [p for room in rooms for p in by_room[room]]


def plan_packs(counts: dict[int, int], capacity: int = CAPACITY, least_fill: int = LEAST_FILL) -> Plan:
    """Places for ``counts[length]`` items of each length, with padding only where room is less than ``least_fill``."""
    patterns = sorted(shortest_pack_first(counts, capacity), key=lambda p: (p.room, p.first))
    sequences = sum(p.n for p in patterns)
    spare = sum(p.n * (capacity - p.room) for p in patterns)  # tokens of packs that are not kept, less the kept ones' room to fill
    kept: list[Pattern] = []
    given_up: list[Pattern] = []
    for p in patterns:  # fullest first
        costs = capacity if p.room >= least_fill else capacity - p.room
        own, rest = p.take(min(p.n, spare // costs) if not given_up else 0)
        spare -= own.n * costs
        kept += [own] * (own.n > 0)
        given_up += [rest] * (rest.n > 0)
    plan = Plan([(length, rank, p.first, offset) for p in kept for length, rank, offset in p.items])
    at = 0
    for p in reversed(given_up):
        for length, rank, _ in p.items:
            plan.laid.append((length, rank, at))
            at += p.n * length
    end, at = at, 0
    for p in reversed(kept):
        if p.room >= max(1, least_fill):
            plan.gaps.append((at, p.room, p.first, capacity - p.room))
            at += p.n * p.room
    if (end - at) // capacity:
        plan.gaps.append((at, capacity, sequences, 0))
        sequences += (end - at) // capacity
        at += (end - at) // capacity * capacity
    while at < end:
        size = 1 << (end - at).bit_length() - 1
        plan.gaps.append((at, size, sequences, 0))
        sequences += 1
        at += size
    return plan


class Places:
    """The plan as arrays: where an item of some length and rank goes."""

    def __init__(self, plan: Plan):
        runs = sorted([(length, rank, sequence, offset) for length, rank, sequence, offset in plan.placed] + [(length, rank, -1, at) for length, rank, at in plan.laid])
        self.first = np.array([(length << SHIFT) + rank for length, rank, _, _ in runs], np.int64)
        self.sequence = np.array([r[2] for r in runs], np.int64)
        self.at = np.array([r[3] for r in runs], np.int64)
        self.gap_at, self.gap_size, self.gap_sequence, self.gap_offset = np.array(plan.gaps, np.int64).reshape(-1, 4).T.copy()

    def pieces(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """``(item, place in the item, length, sequence, offset)`` of each piece of the items."""
        key = (length << SHIFT) + rank
        run = np.searchsorted(self.first, key, "right") - 1
        sequence, at, i = self.sequence[run], self.at[run], key - self.first[run]
        whole = np.flatnonzero(sequence >= 0)
        out = [(whole, np.zeros(len(whole), np.int64), length[whole], sequence[whole] + i[whole], at[whole])]
        cut = np.flatnonzero(sequence < 0)
        begin = at[cut] + i[cut] * length[cut]
        place = begin.copy()
        while len(cut):  # one gap further for all cut items at once
            gap = np.searchsorted(self.gap_at, place, "right") - 1
            nth, within = np.divmod(place - self.gap_at[gap], self.gap_size[gap])
            size = np.minimum(self.gap_size[gap] - within, begin + length[cut] - place)
            out.append((cut, place - begin, size, self.gap_sequence[gap] + nth, self.gap_offset[gap] + within))
            place = place + size
            more = place < begin + length[cut]
            cut, begin, place = cut[more], begin[more], place[more]
        return tuple(np.concatenate(c) for c in zip(*out))


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, tokenizer: str = TOKENIZER, ranks: str | None = RANKS) -> DataFrame:
    """``row_id, doc_id, doc_tokens, ids``: ids with the end id, as unsigned integers of 2 or 4 bytes, little end first."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    known = vocabulary(tokenizer)

    @giving_back
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder(tokenizer, ranks, known)
        end = np.array([end_id], "<u4").tobytes()
        short = max(known.size, end_id + 1) <= 1 << 16
        for batch in batches:
            for b in slices(batch):
                ids = [encoder.encode(t) + end for t in b.column("text").to_pylist()]
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                if short:
                    ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, pa.array(ids, pa.binary())], names=["row_id", "doc_id", "doc_tokens", "ids"])

    return rows.mapInArrow(encode, f"row_id long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, doc_tokens long, ids binary")


def ranked(items: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``items`` (``row_id, start, length``) with ``rank``, from 0 within each length, in any order."""
    spark = items.sparkSession
    chunks = spark.createDataFrame([(k, min(MOST_CHUNKS, max(1, v // CHUNK_ROWS))) for k, v in counts.items()], "length long, chunks long")
    items = items.join(F.broadcast(chunks), "length").withColumn("chunk", F.pmod(F.xxhash64("row_id", "start"), F.col("chunks"))).drop("chunks")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    bases = items.groupBy("length", "chunk").agg(F.count("*").alias("n")).select("length", "chunk", F.coalesce(before, F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("row_id", "start"))
    return items.withColumn("within", within - 1).join(bases, ["length", "chunk"]).select("row_id", "start", "length", (F.col("base") + F.col("within")).alias("rank"))


def pack_shortest_first(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, least_fill: int = LEAST_FILL, end_id: int = END_ID, tokenizer: str = TOKENIZER, ranks: str | None = RANKS, with_ids: bool = False
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``)."""
    tokens = stored(encoded(docs, id_col, text_col, end_id, tokenizer, ranks), "tokens")
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_tokens") - 1, F.lit(capacity).cast("long")))
    items = tokens.select("row_id", "doc_tokens", start.alias("start"))
    items = items.select("row_id", "start", F.least(F.lit(capacity).cast("long"), F.col("doc_tokens") - F.col("start")).alias("length"))
    counts = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}  # at most `capacity` rows
    places = Places(plan_packs(counts, capacity, least_fill))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, begin, length, rank = (c.to_numpy() for c in batch.columns)
            item, within, size, sequence, offset = places.pieces(length, rank)
            cols = [row[item], begin[item] + within, size, sequence, offset]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["row_id", "start", "length", "sequence_id", "offset"])

    pieces = ranked(items, counts).mapInArrow(place, "row_id long, start long, length long, sequence_id long, offset long")
    lists = pieces.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))  # of one document
    joined = tokens.join(lists, "row_id").select("doc_id", "doc_tokens", "ids", "pieces")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "ids"):
                lists = b.column("pieces")
                flat = lists.flatten()
                of = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                begin, length = flat.field("start").to_numpy(), flat.field("length").to_numpy()
                own, doc = [], -1
                for i, x, n in zip(of.tolist(), begin.tolist(), length.tolist()):
                    if i != doc:
                        doc, raw = i, b.column("ids")[i].as_buffer()
                        wide = memoryview(raw if len(raw) == 4 * b.column("doc_tokens")[i].as_py() else np.frombuffer(raw, "<u2").astype("<u4").tobytes())
                    own.append(wide[4 * x : 4 * (x + n)])
                at = pa.array(of)
                crc = pa.array([zlib.crc32(x) for x in own], pa.int64())
                cols = [b.column(0).take(at), flat.field("start"), flat.field("length"), crc, b.column(1).take(at), flat.field("sequence_id"), flat.field("offset")]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    cols, names = [*cols, pa.array([bytes(x) for x in own], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    id_type = tokens.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)


def op12_shortest_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of ``documents`` with its place in a sequence."""
    return pack_shortest_first(table(spark, sf_dir, "documents"))
