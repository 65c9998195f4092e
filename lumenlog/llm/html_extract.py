"""Main text of web pages by tree scoring.

Paragraphs earn points for length and commas and pass them on: all to the element around them, half to the next, less to those
further out. An element's points are discounted by the share of its text that is links. The best element is kept with those of
its siblings that score well too; menus, adverts, forms and the like are taken out at any depth.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
# Up to the end of a tag: past quoted values if all are closed, or simply to the next bracket.
QUOTED = re.compile(r"(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>")
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Elements by their role in HTML.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split()
)
REMOVED = frozenset("aside audio button canvas datalist dialog embed footer head iframe label menu nav object select svg template video math".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6".split())
# What an element that starts closes, up to the nearest of the second group.
CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
CLOSES = {k: (frozenset(a.split()), b) for k, (a, b) in CLOSES.items()}
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# Words in a class or id that name what is not the article, and words that overrule them.
SIDE = frozenset(
    "ad ads advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices outbrain overlay pager paginate pagination popup promo "
    "promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola teaser "
    "toast toolbar trending widget widgets".split()
)
MAIN = frozenset("article body content entry main page post story text".split())
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())

CONTROLS = frozenset("button input select textarea".split())
#: Characters for each control, and one time more, from which a form is rather prose with some controls.
CONTROL_CHARS = 200

LEAST_LENGTH = 25
SIBLING_SHARE = 0.2
LINKED = 0.5


class Node:
    """An element that is not inline; ``parts`` holds texts and elements in order."""

    __slots__ = ("tag", "parent", "parts", "points", "side", "chars", "linked", "controls", "inside", "near", "far")

    def __init__(self, tag: str, parent: Node | None, side: bool = False):
        self.tag, self.parent, self.side = tag, parent, side
        self.parts: list = []
        self.points, self.chars, self.linked, self.controls, self.inside = 0.0, 0, 0, 0, False
        self.near, self.far = 0.0, 0.0


def _is_side(tag: str, attributes: str) -> bool:
    """Whether an element by its name and attributes is not part of an article."""
    if tag in REMOVED:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return True
    names = {w.lower() for w in PART.findall(found.get("class", "") + " " + found.get("id", ""))}
    return bool(names & SIDE) and (not names & MAIN or bool(names & COMMENTS))


def _tokens(page: str) -> Iterator[tuple[str, bool, str, str, int]]:
    """(text before, whether it ends an element, name, attributes, where the tag ends), the name empty at the end of the page and for
    comments and the like; send a position to go on from there.

    Each character is looked at a bounded number of times, however broken the markup: what comes after the last bracket is text, and
    once a quote was found open to the end of the page, quotes in tags are no more than characters.
    """
    at = begin = 0
    last, quotes = page.rfind(">"), True
    while True:
        at = page.find("<", at)
        if at < 0:
            yield page[begin:], False, "", "", len(page)
            return
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            end, name, attributes, ends = (stop + 3 if stop >= 0 else len(page)), "", "", False
        elif at > last:
            at += 1
            continue
        elif page.startswith(("<!", "<?"), at):
            end, name, attributes, ends = page.index(">", at) + 1, "", "", False
        else:
            ends = page.startswith("/", at + 1)
            m = NAME.match(page, at + 1 + ends)
            if not m:
                at += 1
                continue
            name, tail = m[0], QUOTED.match(page, m.end()) if quotes else None
            quotes = quotes and tail is not None
            end = tail.end() if tail else page.index(">", m.end()) + 1
            attributes = page[m.end() : end - 1]
        moved = yield page[begin:at], ends, name.lower(), attributes, end
        at = begin = end if moved is None else moved


def parse(page: str) -> Node:
    """The tree of a page. End tags without a start are passed over; what is left open ends with the element around it."""
    root = node = Node("#root", None)
    links = 0
    opened: dict[str, int] = {}
    last = page.rfind(">") + 1
    tokens = _tokens(page)
    token = next(tokens, None)

    def close(up: Node) -> Node:
        """End all elements from the open one up to ``up``; the one around it is open then."""
        n = node
        while True:
            opened[n.tag] -= 1
            if n is up:
                return n.parent
            n = n.parent

    while token is not None:
        text, end, tag, attributes, at = token
        moved = None
        if text:
            node.parts.append((html.unescape(text), links > 0))
        if not tag:
            pass
        elif end:
            if tag == "a":
                links = max(0, links - 1)
            elif (tag == "p" or tag not in INLINE) and opened.get(tag):
                up = node
                while up.tag != tag:
                    up = up.parent
                node, links = close(up), 0
        elif tag in RAW:
            node.controls += tag in CONTROLS
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at, max(at, last))
            moved = stop.end() if stop else len(page)
        elif tag in VOID:
            node.controls += tag in CONTROLS and not re.search(r"type\s*=\s*[\"']?hidden", attributes, re.I)
            if tag in ("br", "hr"):
                node.parts.append((" ", False))
        elif tag == "a":
            links += not attributes.rstrip().endswith("/")
        elif tag not in INLINE or attributes and _is_side(tag, attributes):
            tag = "#inline" if tag in INLINE else tag
            links = 0
            if tag in CLOSES and any(opened.get(c) for c in CLOSES[tag][0]):
                closed, until = CLOSES[tag]
                up = node
                while up.tag not in closed and up.tag not in until:
                    up = up.parent
                if up.tag in closed:
                    node = close(up)
            if node.tag in ENDS_PARAGRAPH and tag != "#inline":
                node = close(node)
            child = Node(tag, node, _is_side(tag, attributes))
            node.parts.append(child)
            child.controls = int(tag in CONTROLS)
            if not attributes.rstrip().endswith("/"):
                node = child
                opened[tag] = opened.get(tag, 0) + 1
        token = tokens.send(moved) if at < len(page) or moved is not None else next(tokens, None)
    return root


def _walk(node: Node) -> Iterator[Node]:
    """All elements below in page order; those that are not part of an article are left out."""
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(p for p in reversed(n.parts) if isinstance(p, Node) and not p.side)


def _blocks(node: Node) -> Iterator[str]:
    """Texts of the blocks below, in page order, white space made plain."""
    pending: list[str] = []
    stack: list = [iter(node.parts)]
    while stack:
        part = next(stack[-1], None)
        if isinstance(part, tuple):
            pending.append(part[0])
            continue
        if part is not None and part.side:
            pending.append(" ")
            continue
        text = " ".join("".join(pending).split())
        pending.clear()
        if text:
            yield text
        if part is None:
            stack.pop()
        else:
            stack.append(iter(part.parts))


def _score(root: Node) -> None:
    """Set text and link lengths of every element, and the points its paragraphs pass to it."""
    order = list(_walk(root))
    for n in order:
        text = " ".join("".join(t for t, _ in (p for p in n.parts if isinstance(p, tuple))).split())
        n.chars = len(text)
        n.linked = sum(len(" ".join(t.split())) for t, link in (p for p in n.parts if isinstance(p, tuple)) if link)
        if not text:
            continue
        free = max(0, n.chars - n.linked)
        points = (free >= LEAST_LENGTH) + min(free / 100, 3.0) + text.count(",") * (free / n.chars)
        up = n.parent if n.tag in ENDS_PARAGRAPH or n.tag in ("li", "td", "th", "dd", "dt", "pre", "blockquote") else n
        if up is not None:
            up.points += points
    # All points go to the element around a paragraph, half to the next, a sixth to the third, then half each time: from the leaves
    # up, an element needs to know its own, its children's (near) and what comes from below them (far).
    for n in reversed(order):
        up = n.parent
        if up is not None:
            up.chars += n.chars
            up.linked += n.linked
            up.near += n.points
            up.far += n.near / 6 + n.far / 2
        n.points += n.near / 2 + n.far


def _density(n: Node) -> float:
    return min(1.0, n.linked / n.chars) if n.chars else 0.0


def _spare_wrappers(root: Node) -> None:
    """An element around the page's article is not taken out for its name, nor is the head of an article for its headings.

    A form goes as one unless it holds the article, or most of the page's text, or much text for its controls.
    """
    order = list(_every(root))
    for n in order[1:]:
        n.inside = n.parent.inside or n.parent.tag in ("article", "main")
        if n.tag in ("article", "main") and not n.side:
            up = n.parent
            # What is around an article that was met before is spared already.
            while up is not None and up.tag not in ("article", "main"):
                if up.tag not in REMOVED:
                    up.side = False
                up = up.parent
        if n.tag == "header":
            n.side = not n.inside
            if n.inside:
                n.parts = [p for p in n.parts if isinstance(p, Node) and p.tag in HEADINGS | {"div", "hgroup"}]
    if not any(n.tag == "form" for n in order):
        return
    chars, controls, mains = {}, {}, {}
    for n in reversed(order):
        below = [p for p in n.parts if isinstance(p, Node)]
        own = len(" ".join("".join(p[0] for p in n.parts if isinstance(p, tuple)).split()))
        chars[n] = own + sum(chars[p] for p in below if not p.side)
        controls[n] = n.controls + sum(controls[p] for p in below)
        mains[n] = n.tag in ("article", "main") or any(mains[p] for p in below)
        if n.tag == "form" and not mains[n] and chars[n] < CONTROL_CHARS * (controls[n] + 1):
            n.side = True
    forms = [n for n in order if n.tag == "form" and n.side]
    everything = chars[root] + sum(chars[n] for n in forms)
    for n in forms:
        if 2 * chars[n] > everything:
            n.side = False


def _every(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(p for p in reversed(n.parts) if isinstance(p, Node))


def extract(page: str | None) -> str:
    """The article's blocks joined by line feeds; empty for a null or empty page and for one without text."""
    if not page:
        return ""
    root = parse(page)
    _spare_wrappers(root)
    _score(root)
    # Lists of links, inside an article too, are menus.
    for n in list(_walk(root)):
        if n.tag in ("ul", "ol", "dl", "table") and _density(n) > LINKED:
            n.side = True
    candidates = [n for n in _walk(root) if n.points > 0 and n.tag not in HEADINGS]
    if not candidates:
        return "\n".join(_blocks(root))
    best = max(candidates, key=lambda n: n.points * (1 - _density(n)))
    top = best.points * (1 - _density(best))
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    best = up or best
    out: list[str] = []
    seen = False
    for part in best.parent.parts if best.parent else [best]:
        if part is best:
            seen = True
            out.extend(_blocks(best))
        elif isinstance(part, Node) and not part.side:
            score = part.points * (1 - _density(part))
            alone = part.tag == "p" and _density(part) < 0.25 and part.chars > 80
            title = part.tag in ("h1", "h2") and not seen
            if score >= SIBLING_SHARE * top or alone or title:
                out.extend(_blocks(part))
    return "\n".join(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"]
        )


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, ``text`` and its length in code points ``n_chars``.

    Whole pages are read. A null or empty page, or one that is all menus, gives an empty text; broken markup is read as far as it
    goes. Repeated rows are each extracted. Only the three named columns are read; an empty table gives an empty result.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    out = rows.mapInArrow(_extract, "id bigint, url string, text string, n_chars bigint")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
