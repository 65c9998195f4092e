"""Exact copies, similar texts and shards against plain Python."""

import collections
import hashlib
import random
import re
import zlib

import cases
import pytest

from lumenlog.llm import exact_dedup, ngram_join, sharding
from lumenlog.llm.graph import components

ROWS = cases.documents()


def test_exact_groups(spark):
    got = exact_dedup.exact_groups(cases.table(spark, ROWS)).collect()
    groups = collections.defaultdict(list)
    for i, x, _, _ in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", x or "")].append(i)
    want = collections.Counter()
    for x, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), hashlib.sha256(x.encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_levels(spark):
    """Texts that differ late, beyond several levels, and one that is another's beginning."""
    stem = "s" * 20_000
    rows = [(1, stem + "a", None, None), (2, stem + "b", None, None), (3, stem, None, None), (4, stem + "a", None, None), (5, stem[:64], None, None), (6, stem[:64], None, None)]
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(cases.table(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 1, 5: 5, 6: 5}


def test_exact_hot_group_and_empty_table(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}", None, None) for i in range(3000)]
    got = exact_dedup.exact_groups(cases.table(spark, rows)).filter("group_size = 2000").collect()
    assert len(got) == 2000 and {r.keep_id for r in got} == {1} and [r.doc_id for r in got if r.kept] == [1]
    assert exact_dedup.exact_groups(cases.table(spark, rows).limit(0)).collect() == []


def _grams(x, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    return frozenset(zip(*[w[k:] for k in range(n)])) if len(w) >= n else frozenset([tuple(w)] if w else [])


def _components(rows, n, percent):
    sets = [_grams(x, n) for _, x, _, _ in rows]
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    low = collections.defaultdict(list)
    for a, row in enumerate(rows):
        low[root(a)].append(row[0])
    return collections.Counter((r[0], len(sets[a]), min((i for i in low[root(a)] if i is not None), default=None)) for a, r in enumerate(rows))


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 50), (3, 100)])
def test_jaccard_components(spark, n, percent):
    got = ngram_join.jaccard_components(cases.table(spark, ROWS), n=n, percent=percent).collect()
    want = _components(ROWS, n, percent)
    # A text without words is alone whatever its id.
    assert collections.Counter(tuple(r) for r in got) == want


def test_jaccard_large_cluster_in_blocks(spark, monkeypatch):
    """A cluster that needs several blocks; links across blocks must not be lost."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)
    rng = random.Random(3)
    base = cases.sentence(rng, 200).split()
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(200)] = f"w{rng.randrange(40)}"
        rows.append((i, " ".join(words), None, None))
    got = ngram_join.jaccard_components(cases.table(spark, rows)).collect()
    assert collections.Counter(tuple(r) for r in got) == _components(rows, 3, 90)
    assert ngram_join.jaccard_components(cases.table(spark, rows).limit(0)).collect() == []


def test_fragments_never_miss():
    """Similar sets share a signature, also where many fragments are empty."""
    import numpy as np

    rng = np.random.default_rng(5)
    cut = ngram_join.Fragments(90)
    for n in [*range(1, 60), 200, 777, 3000]:
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        for _ in range(4):
            gone = rng.integers(0, len(a) // 10 + 1)
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 63, len(a) // 10 - gone if gone < len(a) // 10 else 0, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 90 * (len(a) + len(b) - both):
                assert np.intersect1d(cut.signatures(a), cut.signatures(b)).size


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def _jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards(spark):
    got = sharding.place_in_shards(cases.table(spark, ROWS), 5).collect()
    text = collections.Counter((i, x or "") for i, x, _, _ in ROWS)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter(
        {(i, len(x.encode()) + 1, zlib.crc32(x.encode())): n for (i, x), n in text.items()}
    )
    for r in got:
        assert r.shard == _jump(r.doc_id or 0, 5) and r.grown_shard == _jump(r.doc_id or 0, 6) and r.grown_shard in (r.shard, 5)
    for s in range(5):
        mine = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        ids = [-1 if r.doc_id is None else r.doc_id for r in mine]
        assert ids == sorted(ids)
    assert sharding.place_in_shards(cases.table(spark, ROWS).limit(0), 5).collect() == []


def test_rows_that_stay_keep_their_columns(spark):
    rows = [r for r in ROWS if r[0] is not None and r[0] < 600 and r[0] % 10 < 5][:30]
    rows = list({r[0]: r for r in rows}.values())
    docs = cases.table(spark, rows)
    for kept in (exact_dedup.drop_exact_copies(docs), ngram_join.drop_similar(docs)):
        assert kept.columns == docs.columns and 0 < kept.count() < len(rows)


def test_rows_whose_ids_repeat_or_are_null(spark):
    """A row that goes takes no other row of its id along, and of rows that say the same one stays."""
    rng = random.Random(4)
    clean = [cases.sentence(rng, 60) for _ in range(4)]
    near = clean[0].rsplit(" ", 1)[0]
    rows = [(1, clean[0]), (1, clean[0]), (2, clean[1]), (2, clean[0]), (None, clean[1]), (None, clean[2]), (None, clean[3]), (None, clean[3]), (3, near), (None, near)]
    docs = cases.table(spark, [(i, x, None, None) for i, x in rows])
    exact = sorted(((r.doc_id or 0, r.text) for r in exact_dedup.drop_exact_copies(docs).collect()))
    assert exact == sorted([(1, clean[0]), (2, clean[1]), (0, clean[2]), (0, clean[3]), (3, near)])
    similar = ngram_join.drop_similar(docs)
    assert similar.columns == docs.columns
    assert sorted(((r.doc_id or 0, r.text) for r in similar.collect())) == sorted([(1, clean[0]), (2, clean[1]), (0, clean[2]), (0, clean[3])])


def test_stages_keep_every_text(spark):
    """On rows with repeated and null ids, each normalised text stays once."""
    docs = cases.table(spark, ROWS)
    plain = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x or "")
    got = exact_dedup.drop_exact_copies(docs).collect()
    assert sorted(plain(r.text) for r in got) == sorted({plain(x) for _, x, _, _ in ROWS})


def test_one_row_stays_of_rows_without_an_id(spark):
    rows = [(None, "same", None, None)] * 500 + [(None, "other words", None, None), (7, "twice", None, None), (7, "twice", None, None)]
    got = exact_dedup.exact_groups(cases.table(spark, rows)).collect()
    kept = [r for r in got if r.kept]
    assert len(got) == 503 and sorted((r.doc_id or 0, r.group_size) for r in kept) == [(0, 1), (0, 500), (7, 2)]
