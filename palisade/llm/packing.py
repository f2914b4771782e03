"""Best-fit packing of tokenised documents into sequences, planned on the histogram of lengths.

1. Each document becomes its token ids and one end id; a document longer than a sequence is cut into full pieces,
   where the first piece takes the remainder and so may be shorter.
2. Best-fit decreasing runs over the *counts* of the lengths (at most ``capacity`` of them, whatever the size of the
   table) and yields runs of slots: "ranks a..b of length L go to sequences s.., k in each, at offset o".
3. Each piece gets its rank within its length and takes the slot planned for it. Ranks are counted in chunks of about
   ``CHUNK_ROWS`` rows (more where a length would have over ``MOST_CHUNKS`` of them), so a length that most pieces share is
   no single task, and neither is the sum over its chunks.

The plan depends on the lengths that occur, not on the number of documents, so it travels with the tasks.

Tokens are those of the tokenizers library. Blank-separated pieces of a text are encoded on their own and remembered,
which is exact for byte-level BPE whose pre-tokenizer starts a new word at a blank; texts where that doesn't hold
(neighbouring white space, special tokens) are encoded whole.

Defined edge cases: a null or empty text is one piece of the end id alone; repeated rows are packed each; texts are
encoded in runs of at most ``SLICE_BYTES``, a longer one alone; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, giving_back, slices, stored, table

CAPACITY = 2048
END_ID = 0
CHUNK_ROWS, MOST_CHUNKS = 1000, 1 << 18
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: Bytes of remembered pieces of text in a task, about; beyond it the memory starts anew.
REMEMBERED = 16 << 20


def _place(name: str) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


def _tokenizer(name: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(_place(name))


class Vocabulary(NamedTuple):
    """What tasks must know of a tokenizer; the driver reads it once, so that they needn't load the tokenizer itself."""

    special: tuple[str, ...]
    size: int


def vocabulary(tokenizer: str = TOKENIZER) -> Vocabulary:
    whole = _tokenizer(tokenizer)
    found = Vocabulary(tuple(t.content for t in whole.get_added_tokens_decoder().values()), whole.get_vocab_size())
    del whole
    give_back()
    return found


class ByteEncoder:
    """Token ids of a text as little-endian unsigned 32-bit bytes.

    With ``ranks`` the tokenizers library's own tokenizer, some 25 MB a task, is loaded for the first text that needs it only.
    """

    def __init__(self, tokenizer: str = TOKENIZER, ranks: str | None = RANKS, known: Vocabulary | None = None):
        self.tokenizer = tokenizer
        self.special = (known or vocabulary(tokenizer)).special
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.quick = None
        if ranks:  # the same vocabulary, several times faster
            import base64

            import public_tokenizers
            import tiktoken

            with open(_place(ranks), "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    @cached_property
    def whole(self):
        return _tokenizer(self.tokenizer)

    def _slow(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, text: str) -> bytes:
        ids = self.quick.encode_ordinary(text) if self.quick else self.whole.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self._slow(text)
        known = self.known
        if self.held > REMEMBERED:
            known.clear()
            self.held = 0
        out = []
        for part in (text if text[0] == " " else " " + text).split(" ")[1:]:
            got = known.get(part)
            if got is None:
                if not part or part[0].isspace() or part[-1].isspace():
                    return self._part(text)
                got = known[part] = self._part(" " + part)
                self.held += 160 + 2 * len(part) + len(got)
            out.append(got)
        if text[0] != " ":  # the first word has no blank before it
            out[0] = self._part(text.split(" ", 1)[0])
        return b"".join(out)


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: full ones, the remainder first."""
    at = n % capacity or min(n, capacity)
    if n:
        yield 0, at
    for start in range(at, n, capacity):
        yield start, capacity


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths: runs ``(length, first rank, items a sequence, first sequence, offset)``.

    Rank ``first + i`` of the length goes to sequence ``first sequence + i // items``, at ``offset + i % items * length``.
    A run ends where the length's next one begins.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    open_by_room: dict[int, list[tuple[int, int]]] = {}  # room left: (first sequence, how many)
    rooms: list[int] = []  # sorted
    sequences = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_by_room:
                open_by_room[room] = []
                insort(rooms, room)
            open_by_room[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room], rooms[at]
            else:
                room, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            each = room // length
            full = min(n, left // each)
            rest = min(left - full * each, each - 1) if full < n else 0
            if full:
                runs.append((length, rank, each, first, capacity - room))
                put(room - each * length, first, full)
                rank += full * each
                left -= full * each
            if rest:
                runs.append((length, rank, each, first + full, capacity - room))
                put(room - rest * length, first + full, 1)
                rank += rest
                left -= rest
            used = full + (rest > 0)
            put(room, first + used, n - used)
    return runs


def tokenized_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = TOKENIZER, ranks: str | None = RANKS, with_ids: bool = False) -> DataFrame:
    """Pieces ``(row_id, doc_id, piece, start, length, ids_crc32[, ids])`` of at most ``capacity`` tokens."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    end = np.array([end_id], "<u4").tobytes()
    known = vocabulary(tokenizer)

    @giving_back
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder(tokenizer, ranks, known)
        for batch in batches:
            for b in slices(batch):
                out: list[list] = [[], [], [], [], [], []]
                texts = b.column("text")
                for i in range(b.num_rows):
                    ids = encoder.encode(texts[i].as_py()) + end
                    for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + length)]
                        for col, v in zip(out, (i, piece, start, length, zlib.crc32(own), own if with_ids else None)):
                            col.append(v)
                at = pa.array(out[0], pa.int64())
                cols = [b.column(0).take(at), b.column(1).take(at), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64())]
                names = ["row_id", "doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array(out[5], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"row_id long, doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = TOKENIZER, ranks: str | None = RANKS, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``)."""
    spark = docs.sparkSession
    pieces = stored(tokenized_pieces(docs, id_col, text_col, capacity, end_id, tokenizer, ranks, with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = sorted(plan_best_fit(counts, capacity))
    shift = 48  # length and rank in one number
    first = np.array([(length << shift) + rank for length, rank, *_ in runs], np.int64)
    each, sequence, offset = (np.array([r[k] for r in runs], np.int64) for k in (2, 3, 4))

    chunks = spark.createDataFrame([(k, min(MOST_CHUNKS, max(1, v // CHUNK_ROWS))) for k, v in counts.items()], "length long, chunks long")
    light = pieces.select("row_id", "piece", "length").join(F.broadcast(chunks), "length")  # at most `capacity` rows
    light = light.withColumn("chunk", F.pmod(F.xxhash64("row_id", "piece"), F.col("chunks"))).drop("chunks")
    sizes = light.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("length", "chunk", F.coalesce(before, F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("row_id", "piece"))
    chunked = pieces.join(F.broadcast(chunks), "length").withColumn("chunk", F.pmod(F.xxhash64("row_id", "piece"), F.col("chunks"))).drop("chunks")
    ranked = chunked.withColumn("rank", within - 1).join(bases, ["length", "chunk"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("rank")).drop("base", "chunk", "row_id")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] * with_ids), "rank")

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            run = np.searchsorted(first, (length << shift) + rank, "right") - 1
            i = rank - (first[run] & ((1 << shift) - 1))
            cols = [c for c, n in zip(batch.columns, batch.schema.names) if n != "rank"]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence[run] + i // each[run]), pa.array(offset[run] + i % each[run] * length)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of ``documents`` with its place in a sequence."""
    return pack(table(spark, sf_dir, "documents"))
