"""Mixing and packing: totals, schedules and round trips."""

import collections
import math
import random
import re
import zlib

import cases
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenlog.llm import mixing, packing

ROWS = cases.documents()


def test_targets_share_all():
    got = mixing.targets([10, 100, 1000], [1, 2, 3])
    assert got[0] == 30 and got[1] == 300 and sum(got) == 1110
    assert mixing.targets([0, 5], [1, 1]) == [0, 5]
    assert mixing.targets([], []) == []


@given(st.lists(st.integers(0, 500), min_size=1, max_size=9))
@settings(max_examples=60, deadline=None)
def test_targets_hold_the_limit(sizes):
    got = mixing.targets(sizes, [i % 3 + 1 for i in range(len(sizes))])
    assert sum(got) == sum(sizes) and all(0 <= t <= 3 * s for t, s in zip(got, sizes))


def test_mix(spark):
    docs = cases.table(spark, ROWS)
    got = mixing.mixed_sizes(docs).collect()
    assert collections.Counter((r.doc_id, r.size) for r in got) == collections.Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", x or ""))) for i, x, _, _ in ROWS)
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for rows in by.values():
        assert sum(r.taken for r in rows) == math.floor(rows[0].target + 0.5)
        assert sum(r["size"] for r in rows) == rows[0].source_size
    assert all(r.taken <= 3 * r["size"] for r in got)
    again = mixing.mixed_sizes(docs.repartition(7)).collect()
    unique = [i for i, n in collections.Counter(r.doc_id for r in got).items() if n == 1 and i is not None]
    first, second = ({r.doc_id: r.taken for r in x} for x in (got, again))
    assert all(first[i] == second[i] for i in unique)


def test_mix_pieces_cover_blocks(spark):
    """Every slot holds one stretch of a source's stream; slots of a source are spread evenly."""
    rng = random.Random(2)
    rows = [(i, cases.sentence(rng, rng.randint(0, 60)), None, "ab"[i % 3 == 0]) for i in range(300)]
    mix = mixing.Mix(cases.table(spark, rows), block_words=64)
    pieces = mix.pieces.collect()
    sizes = collections.Counter()
    for p in pieces:
        sizes[p.slot] += p.length
    assert max(sizes.values()) == 64
    total = sum(sizes.values())
    slots = sorted((p.slot, p.sid) for p in {(p.slot, p.sid): p for p in pieces}.values())
    share = sum(1 for _, s in slots if s == 0) / len(slots)
    for cut in range(20, len(slots), 20):
        assert abs(sum(1 for _, s in slots[:cut] if s == 0) - share * cut) < 4
    assert abs(total - sum(len(x.split()) for _, x, _, _ in rows)) <= 1


def test_schedule_is_the_golden_sequence(spark):
    need = [5, 11, 0, 30]
    got = sorted((r.slot, r.sid, r["rank"]) for r in mixing._schedule(spark, need).collect())
    edges = np.cumsum(need) / sum(need)
    seen = collections.Counter()
    want = []
    for j in range(sum(need)):
        point = (((j + 1) * 11400714819323198485 % 2**64) >> 11) / 2**53
        s = int(np.searchsorted(edges, point, "right"))
        if seen[s] < need[s]:
            want.append((j, s, seen[s]))
        seen[s] += 1
    assert [g for g in got if g[0] < sum(need)] == want
    assert collections.Counter(g[1] for g in got) == {0: 5, 1: 11, 3: 30}


def test_mixed_documents(spark):
    rows = list({r[0]: r for r in ROWS if r[0] is not None}.values())
    docs = cases.table(spark, rows)
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    times = collections.Counter(r.doc_id for r in got.select("doc_id").collect())
    assert times and max(times.values()) <= 3
    assert mixing.mixed_sizes(docs.limit(0)).collect() == [] and mixing.mixed_documents(docs.limit(0)).collect() == []


def test_packing_round_trip(spark):
    rows = ROWS + [(700, "see <|endoftext|> there", None, None)]
    got = packing.pack(cases.table(spark, rows)).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, x, _, _ in rows:
        ids = np.asarray(plain.encode(x or "", add_special_tokens=False).ids + [2], "<u4")
        head = len(ids) % 1024
        starts = ([0] if head else []) + list(range(head, len(ids), 1024))
        for k, (a, b) in enumerate(zip(starts, starts[1:] + [len(ids)])):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= math.ceil(sum(r.length for r in got) / 1024) + 1
    assert packing.pack(cases.table(spark, rows).limit(0)).collect() == []


@given(st.lists(st.integers(1, 50), max_size=60))
@settings(max_examples=80, deadline=None)
def test_search_keeps_items_and_room(sizes):
    bins = packing.best_fit(sizes, 50)
    better = packing.improve(sizes, bins, 50)
    assert sorted(i for b in better for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 50 for b in better) and len(better) <= len(bins)


def test_search_empties_a_bin():
    """Best fit leaves three sequences where two are enough; exchanges find them."""
    sizes = [6, 5, 5, 4]
    bins = [[0], [1, 3], [2]]
    assert len(packing.improve(sizes, bins, 10)) == 2


@pytest.mark.parametrize("n", [1, 1023, 1024, 1025, 5000])
def test_cuts(n):
    parts = packing.cuts(n, 1024)
    assert sum(length for _, length in parts) == n and all(length == 1024 for _, length in parts[1:])


def test_mixed_rows_that_repeat_an_id(spark):
    """A row's times are its own: no row is taken more than three times, also where ids repeat or are null."""
    rows = [(1, f"one {'a ' * 40}", None, "rare"), (1, f"two {'b ' * 40}", None, "rare"), (None, f"three {'c ' * 40}", None, "rare"), (None, f"four {'d ' * 40}", None, "rare")]
    rows += [(10 + i, f"{i} {'e ' * 40}", None, "z") for i in range(40)]
    docs = cases.table(spark, rows)
    got = collections.Counter(r.text for r in mixing.mixed_documents(docs, source_col="source").collect())
    assert max(got.values()) <= 3 and {x for _, x, _, s in rows if s == "rare"} <= set(got)
