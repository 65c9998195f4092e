"""Small tables with everything that operators must stand: nulls, empty and very long texts, ties, repeated rows, odd columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, t string, name string, n bigint, size string, node bigint, _copy int, _kept_id bigint, block bigint"


def table(spark, rows):
    """Documents from (doc_id, text, lang, source), with columns whose names the operators use inside."""
    full = [(i, x, lang, source, None if x is None else len(x), 7, "t", "name", -1, "s", 3, 4, i, 9) for i, x, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA)


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(n))


def documents(seed: int = 1):
    """About 70 rows: copies, near copies, white space variants, a long text, nulls in every column."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(12, 120)) for _ in range(12)]
    rows = []
    for k, b in enumerate(base):
        words = b.split()
        rows.append((k * 10, b, "en", "src%d" % (k % 4)))
        rows.append((k * 10 + 1, b.upper() if k % 2 else b, "en", "src0"))
        rows.append((k * 10 + 2, "  ".join(words) + "\n", None, "src0"))
        changed = list(words)
        changed[rng.randrange(len(words))] = "changed"
        rows.append((k * 10 + 3, " ".join(changed), "de", None))
        rows.append((k * 10 + 4, " ".join(words[:-1]), "de", "src9"))
    long = sentence(rng, 30_000)
    rows += [(500, long, "en", "src1"), (501, long + " end", "en", "src1"), (502, "x" * 70_000, "en", "src2")]
    rows += [(600, None, None, None), (601, "", "en", "src1"), (602, " \t\n", "en", "src1"), (603, "Éa 1", "fr", "src1"), (604, "a b", "fr", "src1"), (605, "A\x0bB", "fr", "src1")]
    rows += [(0, base[0], "en", "src0"), (None, base[1], "en", "src1"), (None, "only here and there again", None, None)]
    rng.shuffle(rows)
    return rows
