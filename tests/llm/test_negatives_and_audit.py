"""Hard negatives and the audit of filters against plain Python."""

import collections
import itertools
import math
import random
import re

import cases
import pytest

from lumenlog.llm import filter_audit, hard_negatives

VECTORS = "vec_id bigint, embedding array<float>, label int, row bigint, id string, score double, slot int, anchor boolean"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, x, 1, "i", 0.5, 2, True) for i, v, x in rows], VECTORS)


def plain_negatives(rows, is_anchor, k=5, n=3, lower=50, upper=95):
    usable = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = collections.Counter()
    for a, (anchor, av, al) in enumerate(usable):
        if not is_anchor(anchor):
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, v)), i, label) for b, (i, v, label) in enumerate(usable) if b != a)
        for down, positive, _ in [s for s in scored if s[2] == al][:k]:
            p = -down
            fits = [(i, -d) for d, i, label in scored if label != al and lower * p <= -100 * d <= upper * p][:n]
            for rank, (i, score) in enumerate(fits, 1):
                out[anchor, positive, rank, i, p, score] += 1
    return out


def mined(df, **more):
    return collections.Counter(tuple(r) for r in hard_negatives.mine(df, df.vec_id % 5 == 0, **more).collect())


def random_vectors(seed, n, dims=4, coarse=False):
    rng = random.Random(seed)
    # Quarters are exact in floating point and give many equal scores.
    return [(i, [rng.randint(-3, 4) / 4 if coarse else float(f"{rng.uniform(-0.5, 0.7):.3f}") for _ in range(dims)], rng.randrange(4)) for i in range(n)]


def as_floats(rows):
    import numpy as np

    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


@pytest.mark.parametrize("coarse", [False, True])
def test_negatives_against_all_pairs(spark, coarse):
    rows = as_floats(random_vectors(3, 150, coarse=coarse))
    want = plain_negatives(rows, lambda i: i % 5 == 0)
    assert want and mined(vectors(spark, rows)) == want


def test_negatives_in_many_shards_blocks_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 7)
    monkeypatch.setattr(hard_negatives, "TILE_SCORES", 20)
    rows = as_floats(random_vectors(4, 120, coarse=True))
    assert mined(vectors(spark, rows)) == plain_negatives(rows, lambda i: i % 5 == 0)
    assert mined(vectors(spark, rows), positives=2, negatives=1, lower=10, upper=99) == plain_negatives(rows, lambda i: i % 5 == 0, 2, 1, 10, 99)


def test_negatives_odd_rows(spark):
    rows = as_floats(random_vectors(5, 60, coarse=True))
    rows += [(0, rows[0][1], rows[0][2]), (0, rows[3][1], 1), (70, rows[5][1], rows[5][2]), (70, rows[5][1], rows[5][2])]
    rows += [(80, None, 1), (85, [0.5, None, 0.5, 0.5], 1), (90, [float("nan")] * 4, 1), (95, [float("inf"), 0.0, 0.0, 0.0], 2), (100, rows[0][1], None), (None, rows[0][1], 1)]
    assert mined(vectors(spark, rows)) == plain_negatives(rows, lambda i: i % 5 == 0)
    short = as_floats([(0, [0.5, 0.5], 1), (1, [0.5], 1), (2, [0.25, 0.25, 0.25], 2), (3, [], 2)])
    assert mined(vectors(spark, short)) == {(0, 1, 1, 2, 16384, 16384): 0} or sum(mined(vectors(spark, short)).values()) == 0
    assert mined(vectors(spark, rows).limit(0)) == {}
    assert mined(vectors(spark, [(0, [0.5], 1)])) == {}


def test_negatives_with_large_components(spark):
    """Scores beyond 2^24 and 2^53 stay exact."""
    rng = random.Random(7)
    for size in (3_000.0, 300_000.0):
        rows = as_floats([(i, [rng.uniform(-0.3, 1) * size for _ in range(3)], rng.randrange(3)) for i in range(60)])
        want = plain_negatives(rows, lambda i: i % 5 == 0)
        assert want and mined(vectors(spark, rows)) == want


def test_negatives_one_vector_everywhere(spark):
    rows = [(i, [0.5, 0.5], 1 if i < 1500 else 2) for i in range(1500)] + [(5000 + i, [0.25, 0.5], 2) for i in range(500)]
    got = mined(vectors(spark, rows))
    assert len(got) == 300 * 15
    assert {(k[3], k[2]) for k in got} == {(5000, 1), (5001, 2), (5002, 3)}


LABELS = "doc_id bigint, quality int, toxic int, part string, id bigint"


def plain_audit(rows, labels):
    def split(x):
        return re.findall(r"[^\x20\x09-\x0D]+", x)

    first = {}
    for i, x, _, _ in rows:
        if i is not None:
            first[x or ""] = min(first.get(x or "", i), i)
    docs = []
    for i, x, lang, _ in rows:
        t = x or ""
        w = split(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        mine = [x for x in labels if x[0] is not None and x[0] == i]
        docs.append((lang or "", {f for f, bad in fails.items() if bad}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part in {d[0] for d in docs}:
        here = [d[1:] for d in docs if d[0] == part]
        total = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            alive = list(here)
            for step, f in enumerate(order, 1):
                gone = [d for d in alive if f in d[0]]
                alive = [d for d in alive if f not in d[0]]
                total[f] += len(gone)
                failing = [d for d in here if f in d[0]]
                out[part, "".join(order), step] = [len(alive), len(gone), len(failing) - len(gone), sum(d[0] == {f} for d in here), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def audited(spark, rows, labels):
    frame = spark.createDataFrame([(*x, "p", 1) for x in labels], LABELS)
    got = filter_audit.audit(cases.table(spark, rows), frame).collect()
    out = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got}
    assert len(out) == len(got)
    return out


def test_audit_against_plain_version(spark):
    rng = random.Random(2)
    rows = cases.documents() + [(2000 + i, " ".join(rng.choice(["Aa", "b#", "c", "dd", "e e", "F"]) for _ in range(rng.choice([20, 250]))), rng.choice(["en", None, "", "de"]), "s") for i in range(60)]
    rows += [(3000, rows[-1][1], "xx", None), (3000, rows[-1][1], "xx", None), (3001, None, None, None)]
    ids = [r[0] for r in rows]
    labels = [(rng.choice(ids), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(80)] + [(None, 1, 1), (99_999, 1, 1), (3000, 1, 1), (3000, 1, 0)]
    assert audited(spark, rows, labels) == plain_audit(rows, labels)


def test_audit_of_nothing_and_of_own_filters(spark):
    rows = [(1, "good", "en", None), (2, "bad", "en", None), (3, "bad", "en", None)]
    assert audited(spark, rows[:0] or [(1, "x", "en", None)], [])["en", "ABCDE", 1][:2] == [0, 1]
    frame, labels = cases.table(spark, rows), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(frame.limit(0), labels).collect() == []
    from pyspark.sql import functions as F

    got = filter_audit.audit(frame, labels, {"bad": F.col("t") == "bad", "short": F.length("t") < 4}, copies=None).collect()
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in got} == {
        ("badshort", 1): (1, 2, 0, 0, 2), ("badshort", 2): (1, 0, 2, 0, 2), ("shortbad", 1): (1, 2, 0, 0, 2), ("shortbad", 2): (1, 0, 2, 0, 2),
    }
    with pytest.raises(ValueError):
        filter_audit.audit(frame, labels, {str(i): F.lit(True) for i in range(9)})


def test_audit_sends_no_lattice_through_the_driver(spark):
    """However small the stored tables look, rows with their sets, failing rows and labels meet by merging."""
    rows = [(i, f"text {i}", "en", None) for i in range(20)]
    got = filter_audit.audit(cases.table(spark, rows), spark.createDataFrame([(1, 1, 0, "p", 1)], LABELS))
    assert len(got.collect()) == 600
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
