"""Pages in forms, broken markup of a megabyte, and points against a plain scorer."""

import random
import time

import pytest

from lumenlog.llm import html_extract as H

PROSE = "Some words, and more of them, stand here for a paragraph. " * 6
BODY = f"<p>{PROSE}</p><p>{PROSE}</p>"
TEXT = "\n".join([PROSE.strip()] * 2)


@pytest.mark.parametrize(
    "page",
    [
        f"<form method=post><input type=hidden name=state><div><article>{BODY}</article></div><input type=submit></form>",
        f"<form><input type=hidden name=state><div>{BODY}</div><input name=q><button>Find</button></form><div>Foot</div>",
        f"<form><main>{BODY}</main><select><option>1</select></form>",
        f"<div>{BODY}</div><form>Your name <input name=a> Your mail <input name=b><textarea></textarea><button>Send</button></form>",
        f"<form role=search>Look for <input name=q></form><div>{BODY}</div>",
    ],
)
def test_forms(page):
    assert H.extract(f"<html><body>{page}</body></html>") == TEXT


MEGABYTE = {
    "name": "<" + "a" * 1_000_000,
    "names": "<a " * 330_000,
    "open": "<div>" * 200_000,
    "open with text": "<div>word, " * 90_000,
    "ends": "<div>" * 90_000 + "</span2>" * 90_000,
    "quotes": "<a ' >" * 160_000,
    "odd quotes": "<a \" '>" * 160_000,
    "script": "<script></script" * 60_000,
    "comments": "<!--" * 250_000,
    "articles": "<article>" * 50_000 + "<header>" * 50_000,
    "forms": "<form>" * 150_000,
    "brackets": "<" * 1_000_000,
    "one open quote": '<a href="x>' + "<p>word</p>" * 90_000,
    "items": "<li>x" * 180_000,
}


@pytest.mark.parametrize("name", MEGABYTE)
def test_a_megabyte_of_broken_markup(name):
    started = time.time()
    H.extract(MEGABYTE[name])
    assert time.time() - started < 15  # a few seconds; quadratic work would take hours


def test_no_text_is_lost_to_an_open_tag():
    assert H.extract("<p>one</p><b two three") == "one\n<b two three"
    assert H.extract("a < b and c > d") == "a < b and c > d"
    assert H.extract('<a href="x>y</a><p>word</p>').endswith("word")


def plain_points(root):
    """Every paragraph walks up to all its ancestors."""
    nodes = list(H._walk(root))
    points = {n: 0.0 for n in nodes}
    for n in nodes:
        own = [p for p in n.parts if isinstance(p, tuple)]
        text = " ".join("".join(t for t, _ in own).split())
        if not text:
            continue
        free = max(0, len(text) - sum(len(" ".join(t.split())) for t, link in own if link))
        gained = (free >= H.LEAST_LENGTH) + min(free / 100, 3.0) + text.count(",") * (free / len(text))
        up = n.parent if n.tag in ("p", "h1", "h2", "li", "td", "pre") else n
        level = 0
        while up is not None:
            points[up] += gained * (1, 0.5)[level] if level < 2 else gained / 6 / 2 ** (level - 2)
            up, level = up.parent, level + 1
    return points


def test_points_against_a_plain_scorer():
    rng = random.Random(4)
    for _ in range(40):
        page, open_ = [], []
        for _ in range(rng.randrange(5, 60)):
            if open_ and rng.random() < 0.4:
                page.append(f"</{open_.pop()}>")
            elif rng.random() < 0.5:
                open_.append(rng.choice(["div", "section", "p", "ul", "li", "h2", "table", "tr", "td", "pre"]))
                page.append(f"<{open_[-1]}>")
            else:
                page.append(rng.choice(["a, b, c ", "word " * rng.randrange(30), "<a href=x>link, text</a> ", "<b>bold,</b>"]))
        root = H.parse("".join(page))
        H._spare_wrappers(root)
        want = plain_points(root)
        H._score(root)
        assert all(n.points == pytest.approx(p) for n, p in want.items())
