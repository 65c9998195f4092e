"""The licence scan against a plain version, and what it must find or leave alone."""

import math
import random
import re

import cases
import pytest

from lumenlog.llm import licenses as L


def words(x):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), x or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(texts, notices=L.NOTICES, phrases=L.PHRASES):
    """(words, names, labels, score) of every text, by dictionaries and loops."""
    split = [words(x) for x in texts]
    vocabulary = {w for _, t, keys in notices for w in " ".join([t, *keys]).split()} | set(" ".join(phrases).split())
    frequency = {w: sum(w in set(s) for s in split) for w in vocabulary}
    idf = {w: math.log((len(split) + 1) / (n + 1)) + 1e-6 for w, n in frequency.items()}
    longest = max(len(t.split()) for _, t, _ in notices)
    out = []
    for s in split:
        names = [(k, label) for p, label in phrases.items() for k in range(len(s)) if s[k : k + len(p.split())] == p.split()]
        labels, score = {label for _, label in names}, L.NAME_SCORE if names else 0.0
        for label, text, keys in notices:
            spelled = text.split()
            rare = sorted(dict.fromkeys(spelled), key=lambda w: -idf[w])[: L.RARE_WORDS]
            held = [(q, w) for q, w in enumerate(spelled) if w in rare]
            groups = {}
            for k, w in enumerate(s):
                for q, other in held:
                    if w == other:
                        o = k - q + longest
                        for g in (2 * (o // (2 * L.DRIFT)), 2 * ((o + L.DRIFT) // (2 * L.DRIFT)) + 1):
                            groups.setdefault(g, {}).setdefault(q, []).append(k - q)
            for places in groups.values():
                share = sum(idf[spelled[q]] for q in places) / sum(idf[w] for _, w in held)
                first = min(x for v in places.values() for x in v)
                lo, hi = max(0, first - L.DRIFT), min(len(s), first + len(spelled) + 2 * L.DRIFT)
                verified = all(any(s[k : k + len(p.split())] == p.split() for k in range(lo, hi - len(p.split()) + 1)) for p in keys)
                if share >= L.LEAST_SHARE - 1e-12 and verified:
                    labels.add(label)
                    score = max(score, min(1.0, share))
        out.append((len(s), sorted(k for k, _ in names), ",".join(sorted(labels)), score))
    return out


def digest(spark, rows):
    found = L.scan(cases.table(spark, rows))
    return found.select("doc_id", "n_words", *L.labelled(found)).collect()


def texts():
    rng = random.Random(5)
    vocabulary = sorted({w for _, t, _ in L.NOTICES for w in t.split()})
    out = []
    for label, notice, _ in L.NOTICES:
        spelled = notice.split()
        around = [cases.sentence(rng, rng.randint(0, 40)) for _ in range(2)]
        out.append(f"{around[0]} {notice} {around[1]}")
        out.append(f"{around[0]}\n{notice.upper()}.\n{around[1]}")
        out.append(" ".join(spelled[: len(spelled) // 2]))
        put = list(spelled)
        put.insert(len(put) // 2, "inserted")
        out.append(" ".join(put))
        shuffled = list(spelled)
        rng.shuffle(shuffled)
        out.append(" ".join(shuffled))
    out += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    out += ["license " * 500, "mit license " * 300, "MIT-License; Apache/License!", "the mité license", "mit license" + "x" * 50_000, "", None, " \n", "mit", "license"]
    out += [cases.sentence(rng, 3000) + " general public license"]
    return out


def test_scan_against_plain_version(spark):
    rows = [(i, x, "en", "s") for i, x in enumerate(texts())]
    want = plain([x for _, x, _, _ in rows])
    got = {r.doc_id: r for r in digest(spark, rows)}
    assert len(got) == len(rows)
    for (i, x, _, _), (n, names, labels, score) in zip(rows, want):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(names), names[0] if names else None, names[-1] if names else None), x
        assert r.labels == labels and r.score == pytest.approx(score), x
    assert any(r.labels and not r.base_labels for r in got.values())


def test_every_notice_is_found_and_prose_is_not(spark):
    rng = random.Random(6)
    rows = [(i, f"{cases.sentence(rng, 300)}. {notice.capitalize()}. {cases.sentence(rng, 300)}", "en", "s") for i, (_, notice, _) in enumerate(L.NOTICES)]
    rows += [(1000 + i, cases.sentence(rng, 400), "en", "s") for i in range(40)]
    got = {r.doc_id: r for r in digest(spark, rows)}
    assert all(label in got[i].labels.split(",") and got[i].score > 0.99 for i, (label, _, _) in enumerate(L.NOTICES))
    assert all(got[i].labels == "" and got[i].score == 0 for i in got if i >= 1000)


def test_spans_point_at_the_words(spark):
    text = "one two three released under the MIT license four"
    spans = L.scan(cases.table(spark, [(1, text, None, None)])).first().spans
    name = [s for s in spans if s.kind == "name"]
    assert [(s.label, s.start, s.words) for s in name] == [("mit", 6, 2)]
    assert all(s.start <= 6 and s.start + s.words >= 8 for s in spans if s.label == "mit")


def test_repeats_nulls_long_texts_and_empty_table(spark):
    long = "word " * 400_000 + "mit license " + "z" * 3_000_000
    rows = [(1, "mit license", None, None), (1, "mit license", "en", None), (None, None, None, None), (None, "apache license", None, None), (2, long, None, None)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_base, r.first_word or 0, r.base_labels) for r in digest(spark, rows))
    assert got == [(0, 0, 0, 0, ""), (0, 2, 1, 0, "apache"), (1, 2, 1, 0, "mit"), (1, 2, 1, 0, "mit"), (2, 400_003, 1, 400_000, "mit")]
    empty = L.scan(cases.table(spark, rows).limit(0))
    assert empty.select("doc_id", *L.labelled(empty)).collect() == []
    assert all(r.labels == "" for r in L.scan(cases.table(spark, rows), [], {"no such name": "x"}).transform(lambda d: d.select(*L.labelled(d))).collect())
