"""Main text of pages, and pseudonyms."""

import hashlib
import re

import cases
import pytest
from pyspark.sql import functions as F

from lumenlog.llm import html_extract, pii

PARAGRAPH = "A paragraph of some length, with a comma, that belongs to the article itself."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("plain words", "plain words"),
        (f"<p>{PARAGRAPH}</p>", PARAGRAPH),
        (f"<nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>{PARAGRAPH}<p>short</article><footer>(c)</footer>", f"T & U\n{PARAGRAPH}\nshort"),
        (f"<div class=ad>Buy, buy, buy, buy, buy this</div><div id=content><p>{PARAGRAPH}</p><p>x</p></div>", f"{PARAGRAPH}\nx"),
        (f"<article><p>one<br>two &nbsp; three</p><script>var t='</p>';</script><p>{PARAGRAPH}</p></article>", f"one two three\n{PARAGRAPH}"),
        (f"<article><p>{PARAGRAPH}</p><section class='comments'><p>{PARAGRAPH} {PARAGRAPH}</p></section></article>", PARAGRAPH),
        (f"<div><div class='sidebar widget'><p>{PARAGRAPH}</p></div><div><p>{PARAGRAPH}</p><form><p>Your mail</p></form></div></div>", PARAGRAPH),
        (f"<body class='has sidebar'><main><p>{PARAGRAPH}</p></main></body>", PARAGRAPH),
        (f"<article><p>{PARAGRAPH}</p><ul><li><a href=1>Other story</a><li><a href=2>More</a></ul><ul><li>point<li>next</ul></article>", f"{PARAGRAPH}\npoint\nnext"),
        (f"<div role=dialog><p>Cookies, cookies, cookies</p></div><div><p>{PARAGRAPH}</p></div>", PARAGRAPH),
        (f"<article><header><h1>Title</h1><p>by me</p></header><p>{PARAGRAPH}</p><aside><p>{PARAGRAPH}</p></aside>", f"Title\n{PARAGRAPH}"),
        (f"<!-- <p>no</p> --><article><p>{PARAGRAPH} 1 < 2 & so</p><table><tr><td>a<td>b</table>", f"{PARAGRAPH} 1 < 2 & so\na\nb"),
        (f"<article><p style='display:none'>hidden</p><p>{PARAGRAPH}", PARAGRAPH),
    ],
)
def test_extract(page, want):
    assert html_extract.extract(page) == want


def test_main_text(spark):
    long = "<article>" + "".join(f"<p>{PARAGRAPH} {i}</p>" for i in range(5000)) + "</article>"
    rows = [(1, "u", f"<p>{PARAGRAPH}</p>", 0, "x"), (2, None, None, 0, "x"), (None, "v", "", 0, "x"), (1, "u", f"<p>{PARAGRAPH}</p>", 0, "x"), (3, "w", long, 0, "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, id int, text string")
    got = sorted(html_extract.main_text(pages).collect(), key=lambda r: (r.page_id is None, r.page_id))
    assert [r.page_id for r in got] == [1, 1, 2, 3, None] and [r.n_chars for r in got[:3]] == [len(PARAGRAPH)] * 2 + [0]
    assert got[3].text.count("\n") == 4999 and got[4].text == ""
    assert html_extract.main_text(pages.limit(0)).collect() == []


KEY = "k"


def _feistel(left, right, a, b, tweak, undo=False):
    draw = lambda i, x: int(hashlib.sha256(f"{KEY}|{tweak}|{i}|{x}".encode()).hexdigest()[:15], 16)
    for i in range(pii.ROUNDS)[:: -1 if undo else 1]:
        radix = a if i % 2 == 0 else b
        if undo:
            left, right = (right - draw(i, left)) % radix, left
        else:
            left, right = right, (left + draw(i, right)) % radix
    return left, right


def test_network_is_a_permutation(spark):
    df = spark.range(17 * 29).select(F.floor(F.col("id") / 29).alias("l"), (F.col("id") % 29).alias("r"))
    got = [(r.l, r.r, *r.p) for r in df.withColumn("p", pii.feistel(F.col("l"), F.col("r"), 17, 29, F.lit("t"), KEY)).collect()]
    assert len({g[2:] for g in got}) == 17 * 29
    for left, right, x, y in got:
        assert (x, y) == _feistel(left, right, 17, 29, "t") and (left, right) == _feistel(x, y, 17, 29, "t", undo=True)


def _luhn(s):
    digits = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else 2 * d - 9 if d > 4 else 2 * d for i, d in enumerate(digits)) % 10 == 0


def test_pseudonyms(spark):
    rows = [
        (1, "mail hein.19@mail5.example.com, card 4041 8949 7460 8795 and 4041894974608795; ip 152.143.123.131### tel +1 (988) 555-2485 x"),
        (2, "again hein.19@mail5.example.com\n4041-8949-7460-8795 +1 (988) 555-2485"),
        (3, "IBAN DE89 3704 0044 0532 0130 00, 078-05-1120, 2024-02-29 29.02.2024 02/29/2024 2024/02/29"),
        (4, "no card 4041894974608796, no date 2023-02-29 or 31/12, no ip 300.1.1.1 or 1.2.3, no number 000-12-3456, v 2.0, a4041894974608795"),
        (5, None),
        (6, ""),
        (None, "4041894974608795"),
        (1, "4041894974608795"),
        (7, "z" * 100_000 + " 10.0.0.1 " + "9" * 5000),
    ]
    docs = cases.table(spark, [(i, x, None, None) for i, x in rows])
    got = pii.pseudonymise(docs, KEY).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_found): r for r in got}
    one, two, three = by[1, 5], by[2, 3], by[3, 6]
    cards = [re.sub(r"\D", "", f.value) for r in got for f in r.found if f.kind == "card"]
    assert len(cards) == 5 and len(set(cards)) == 1 and _luhn(cards[0]) and cards[0] != "4041894974608795"
    for kind in ("email", "phone"):
        assert len({f.value for r in (one, two) for f in r.found if f.kind == kind}) == 1
    masked = lambda x: re.sub(r"[a-z]", "a", re.sub(r"\d", "9", x))
    assert masked(two.text) == masked(rows[1][1]) and "hein.19" not in one.text and "@mail5.example.com" in one.text
    assert [f.kind for f in three.found] == ["iban", "ssn", "date", "date", "date", "date"]
    dates = [f.value for f in three.found[2:]]
    y, m, d = dates[0].split("-")
    assert dates[1:] == [f"{d}.{m}.{y}", f"{m}/{d}/{y}", f"{y}/{m}/{d}"]
    iban = three.found[0].value.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert by[4, 0].text == rows[3][1] and by[5, 0].text is None and by[6, 0].text == ""
    ip = by[7, 1].found[0].value
    assert by[7, 1].text == "z" * 100_000 + f" {ip} " + "9" * 5000
    left, right = _feistel(10 * 256, 1, 65536, 65536, "ip")
    assert ip == f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    assert pii.pseudonymise(docs, "other key").filter("doc_id = 6").first().text == "" and pii.pseudonymise(docs.limit(0), KEY).collect() == []
    assert pii.pseudonymise(docs.filter("doc_id = 2"), "other key").first().text != two.text


def test_no_python_in_the_plan(spark):
    docs = cases.table(spark, [(1, "x", None, None)])
    plan = pii.pseudonymise(docs, KEY)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_values_followed_by_digits_or_words(spark):
    rows = [
        (1, "card 4111 1111 1111 1111 12/25 and 4111-1111-1111-1111 123."),
        (2, "call +1 415 555 2671 2024-01-05 or +1 415 555 2671 20 times"),
        (3, "pay DE89 3704 0044 0532 0130 00 or BE68 5390 0754 7034 CODE now"),
        (4, "4111 1111 1111 1111"),
        (5, "+1 415 555 2671"),
        (6, "BE68 5390 0754 7034"),
    ]
    got = {r.doc_id: r for r in pii.pseudonymise(cases.table(spark, [(i, x, None, None) for i, x in rows]), KEY).collect()}
    card, phone, iban = (got[i].found[0].value for i in (4, 5, 6))
    assert got[1].text == f"card {card} 12/25 and {card.replace(' ', '-')} 123."
    date = got[2].found[1].value
    assert [f.kind for f in got[2].found] == ["phone", "date", "phone"] and date != "2024-01-05"
    assert got[2].text == f"call {phone} {date} or {phone} 20 times"
    assert [f.kind for f in got[3].found] == ["iban", "iban"] and got[3].text.endswith(f" or {iban} CODE now")
