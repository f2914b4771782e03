"""Shortest-pack-first packing: plans on counts against lists of packs, and the query's rows against the library's own tokens."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palisade.llm import shortest_packing as sp

from .test_operators import corpus, frame

COUNTS = st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30)


def expand(plan, counts):
    """``{(length, rank): pieces}`` through the arrays that tasks use."""
    places = sp.Places(plan)
    length = np.array([k for k, n in counts.items() for _ in range(n)], np.int64)
    rank = np.array([i for n in counts.values() for i in range(n)], np.int64)
    out = defaultdict(list)
    for item, within, size, sequence, offset in zip(*(c.tolist() for c in places.pieces(length, rank))):
        out[int(length[item]), int(rank[item])].append((within, size, sequence, offset))
    return out


def check_sequences(pieces, capacity):
    """Sequences hold no gap, no overlap, nothing beyond their end; returns tokens of padding."""
    of = defaultdict(list)
    for own in pieces:
        for _, size, sequence, offset in own:
            of[sequence].append((offset, size))
    padding = 0
    for parts in of.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at and size > 0
            at += size
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


@settings(max_examples=150, deadline=None)
@given(COUNTS, st.sampled_from([1, 2, 5, 65]))
def test_plans(counts, least):
    got = expand(sp.plan_packs(counts, 64, least), counts)
    assert set(got) == {(k, i) for k, n in counts.items() for i in range(n)}
    for (length, _), own in got.items():
        at = 0
        for within, size, _, _ in sorted(own):
            assert within == at
            at += size
        assert at == length
    padding = check_sequences(got.values(), 64)
    packs = len({p[2] for own in got.values() for p in own})
    if least == 1:
        assert padding == 0 and packs <= sum(k * n for k, n in counts.items()) // 64 + 6
    else:
        assert padding <= packs * max(0, least - 1) + (0 if least < 65 else 64 * packs)


@settings(max_examples=100, deadline=None)
@given(COUNTS)
def test_shortest_pack_first_is_that_of_single_packs(counts):
    """Each item in turn, longest first, to the emptiest pack with enough room, or to new packs as many as the length needs."""
    packs, left = [], Counter(counts)
    for length in sorted(counts, reverse=True):
        for i in range(counts[length]):
            room = max(packs, default=0)
            if room < length:
                packs += [64] * -(-(counts[length] - i) // (64 // length))
                room = 64
            packs[packs.index(room)] -= length
            left[length] -= 1
    got = Counter()
    for p in sp.shortest_pack_first(counts, 64):
        got[p.room] += p.n
        assert 64 - p.room == sum(length for length, _, _ in p.items)
    assert got == Counter(packs) and not +left


@pytest.fixture(scope="module")
def texts():
    rows, _ = corpus(n=60)
    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "beta,", "Gamma", "42", "é"]) for _ in range(4000))
    return [*rows, (200, long), (201, long), (201, long), (None, "no id"), (None, None), (202, "  two  blanks <|endoftext|>\n\n x")]


@pytest.mark.parametrize(("capacity", "least"), [(1024, 1), (64, 1), (64, 9)])
def test_round_trip(spark, texts, capacity, least, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(sp, "CHUNK_ROWS", 7)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in texts)
    rows = sp.pack_shortest_first(frame(spark, texts).repartition(3), capacity=capacity, least_fill=least, with_ids=True).collect()
    own = defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        own[r.doc_id, r.doc_tokens].append((r.start, r.length, r.sequence_id, r.offset, tuple(np.frombuffer(r.ids, "<u4").tolist())))
    assert sum(r.length for r in rows) == sum(len(ids) * n for (_, ids), n in want.items())
    for (i, ids), n in want.items():
        have = Counter(t for p in own[i, len(ids)] for t in p[4])  # copies of a row may be told apart by nothing
        total = Counter()
        for (j, other), m in want.items():
            if j == i and len(other) == len(ids):
                for t in other:
                    total[t] += m
        assert have == total
        if n == 1 and sum(j == i and len(other) == len(ids) for j, other in want) == 1:
            parts = sorted(own[i, len(ids)])
            assert [p[0] for p in parts] == [sum(q[1] for q in parts[:k]) for k in range(len(parts))]
            assert tuple(t for p in parts for t in p[4]) == ids
    padding = check_sequences([[(p[0], p[1], p[2], p[3])] for parts in own.values() for p in parts], capacity)
    assert padding == 0 if least == 1 else padding <= len({r.sequence_id for r in rows}) * (least - 1)


def test_no_rows_and_only_nulls(spark):
    assert sp.pack_shortest_first(frame(spark, [])).count() == 0
    (row,) = sp.pack_shortest_first(frame(spark, [(None, None)])).collect()
    assert (row.doc_id, row.start, row.length, row.doc_tokens, row.offset, row.ids_crc32) == (None, 0, 1, 1, 0, zlib.crc32(bytes(4)))
