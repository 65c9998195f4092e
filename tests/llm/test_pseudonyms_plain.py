"""Pseudonyms against a plain version that reads a text from left to right, and their cost in long texts."""

import datetime
import hashlib
import random
import time

import cases
import regex

from lumenlog.llm import pii

KEY = "k"
LETTERS = (pii.DIGITS, pii.LOWER, pii.UPPER)


def sha(*parts):
    return hashlib.sha256("|".join(str(p) for p in parts).encode()).hexdigest()


def numbers_network(left, right, a, b, tweak):
    for i in range(pii.ROUNDS):
        left, right = right, (left + int(sha(KEY, tweak, i, right)[:15], 16)) % (a if i % 2 == 0 else b)
    return left, right


def network(digits, radices, kind, undo=False):
    """Digits permuted by a network over two halves, or put back."""
    low = len(digits) // 2
    tweak = f"{kind}|{len(digits)}"

    def draw(i, other, count):
        seed = sha(KEY, tweak, i, ".".join(map(str, other)))
        blocks = [seed] + [sha(seed, b) for b in range(1, count // 8 + 1)]
        return [int(blocks[j // 8][j % 8 * 8 : j % 8 * 8 + 8], 16) for j in range(count)]

    x, y = list(digits[:low]), list(digits[low:])
    for i in range(pii.ROUNDS)[:: -1 if undo else 1]:
        radix = radices[:low] if i % 2 == 0 else radices[low:]
        if undo:
            x, y = [(d - n) % r for d, n, r in zip(y, draw(i, x, len(y)), radix)], x
        else:
            x, y = y, [(d + n) % r for d, n, r in zip(x, draw(i, y, len(x)), radix)]
    return x + y


def rewritten(text, kind, alphabets):
    places = [(i, next(a for a in alphabets if c in a)) for i, c in enumerate(text) if any(c in a for a in alphabets)]
    new = network([a.index(text[i]) for i, a in places], [len(a) for _, a in places], kind)
    out = list(text)
    for (i, a), d in zip(places, new):
        out[i] = a[d]
    return "".join(out)


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 if d > 4 else 2 * d for i, d in enumerate(digits[::-1]))


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def value(kind, m):
    """The pseudonym of a match of a kind, None if it does not validate."""
    digits = [int(c) for c in m if c in pii.DIGITS]
    if kind == "email":
        local, _, domain = m.partition("@")
        return rewritten(local, kind, LETTERS) + "@" + domain
    if kind == "iban":
        plain = m.replace(" ", "")
        if not 15 <= len(plain) <= 34 or mod97(plain[4:] + plain[:4]) != 1:
            return None
        account = rewritten(m[4:], kind, LETTERS[:1])
        return f"{m[:2]}{98 - mod97(account.replace(' ', '') + m[:2] + '00'):02d}{account}"
    if kind == "phone":
        code = regex.match(pii.COUNTRY, m).group()
        return code + rewritten(m[len(code) :], kind, LETTERS[:1]) if 8 <= len(digits) <= 15 else None
    if kind == "card":
        if luhn(digits) % 10:
            return None
        at = max(i for i, c in enumerate(m) if c in pii.DIGITS)
        body = rewritten(m[:at], kind, LETTERS[:1])
        return body + str(-luhn([int(c) for c in body if c in pii.DIGITS] + [0]) % 10) + m[at + 1 :]
    if kind == "ip":
        parts = m.split(".")
        if any(int(p) > 255 or str(int(p)) != p for p in parts):
            return None
        a, b, c, d = map(int, parts)
        left, right = numbers_network(a * 256 + b, c * 256 + d, 65536, 65536, "ip")
        return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    if kind == "date":
        form = "%Y-%m-%d" if regex.match(r"\d{4}-", m) else "%Y/%m/%d" if regex.match(r"\d{4}/", m) else "%d.%m.%Y" if "." in m else "%m/%d/%Y"
        first = datetime.date(1900, 1, 1)
        try:
            day = (datetime.datetime.strptime(m, form).date() - first).days
        except ValueError:
            return None
        if not 0 <= day < 17 * 4297:
            return None
        left, right = numbers_network(day // 4297, day % 4297, 17, 4297, "date")
        return (first + datetime.timedelta(left * 4297 + right)).strftime(form)
    a, b, c = map(int, m.split("-"))
    if not 1 <= a <= 899 or a == 666 or not b or not c:
        return None
    left, right = numbers_network((a - 1 - (a > 666)) * 99 + b - 1, c - 1, 898 * 99, 9999, "ssn")
    area = left // 99
    return f"{area + 2 if area >= 665 else area + 1:03d}-{left % 99 + 1:02d}-{right + 1:04d}"


def accepted(m):
    """The beginning of a match that is looked at: of a usual length and valid, or the longest valid one, or the whole."""
    numeric = ("iban", "phone", "card")
    kind_of = lambda x: next((k for k in numeric if regex.fullmatch(pii.KINDS[k], x)), None)
    if kind_of(m) is None:
        return m
    ends = [i for i in range(1, len(m)) if m[i] in " .()-" and m[i - 1] in pii.DIGITS + pii.UPPER] + [len(m)]
    beginnings = [m[:e] for e in reversed(ends)]
    valid = []
    for x in beginnings:
        fits = [k for k in numeric if regex.fullmatch(pii.KINDS[k], x)]
        plain = regex.sub("[^0-9A-Z+]", "", x)
        usual = [k for k in fits if regex.search(pii.USUAL[k], plain)]
        good = lambda k: value(k, x) is not None
        valid.append((bool(usual) and good(usual[-1]), bool(fits) and good(fits[-1])))
    for which in (0, 1):
        for x, v in zip(beginnings, valid):
            if v[which]:
                return x
    return m


def plain(text):
    """(text, found) as the operator should give them."""
    out, found, at, search = [], [], 0, regex.compile(pii.ANY)
    place = 0
    while (m := search.search(text, place)) is not None:
        x = accepted(m.group())
        new = next(((k, v) for k in pii.KINDS if regex.fullmatch(pii.KINDS[k], x) and (v := value(k, x)) is not None), None)
        if new is None:
            place = m.start() + 1
            continue
        out += [text[at : m.start()], new[1]]
        found.append(new)
        at = place = m.start() + len(x)
    return "".join(out) + text[at:], found


def test_network_can_be_undone():
    rng = random.Random(3)
    for size in (1, 2, 3, 15, 16, 17, 40, 90):
        radices = [rng.choice((10, 26)) for _ in range(size)]
        digits = [rng.randrange(r) for r in radices]
        assert network(network(digits, radices, "t"), radices, "t", undo=True) == digits


VALUES = [
    "hein.19@mail5.example.com", "a_b+" + "longLocal9" * 8 + "@x.org", "DE89 3704 0044 0532 0130 00", "BE68539007547034", "GB82 WEST 1234 5698 7654 32",
    "+1 (988) 555-2485", "(988) 555-2485", "988-555-2485", "+49 (0)151 23456789", "+4915123456789", "+352 621 123 456", "+7 912 345-67-89",
    "4111 1111 1111 1111", "4111-1111-1111-1111", "378282246310005", "5555555555554444", "6304 0000 0000 0000 000", "4111 1111 1111 1112",
    "10.0.0.1", "255.255.255.256", "2024-02-29", "2023-02-29", "29.02.2024", "02/29/2024", "2024/02/29", "1899-12-31", "078-05-1120", "666-05-1120", "899-99-9999",
    "12", "7", "2024", "word", "CODE", "x1", "É", "(", ")", "3.14", "99-1", "+", "@", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1 2 3",
]


def test_against_plain_reading(spark):
    rng = random.Random(5)
    texts = [x for x in VALUES] + ["".join(rng.choice(VALUES) + rng.choice((" ", " ", ", ", "\n", "-", ".", "")) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    got = {r.doc_id: r for r in pii.pseudonymise(cases.table(spark, [(i, x, None, None) for i, x in enumerate(texts)]), KEY).collect()}
    for i, x in enumerate(texts):
        text, found = plain(x)
        assert (got[i].text, [tuple(f) for f in got[i].found]) == (text, found), x


def test_spellings_of_a_phone_number_stay_linked(spark):
    groups = [
        ["+49 151 23456789", "+4915123456789", "+49 (0)151 23456789", "+49-151-23456789"],
        ["+1 415 555 2671", "+14155552671", "(415) 555-2671", "415-555-2671", "+1 (415) 555-2671"],
        ["+352 621 123 456", "+352621123456"],
    ]
    rows = [(g, x) for g, spellings in enumerate(groups) for x in spellings]
    got = {r.doc_id: r for r in pii.pseudonymise(cases.table(spark, [(i, f"call {x}, please", None, None) for i, (_, x) in enumerate(rows)]), KEY).collect()}
    national = {}
    for i, (g, x) in enumerate(rows):
        new = got[i].found[0].value
        code = regex.match(pii.COUNTRY, x).group()
        assert got[i].n_found == 1 and new.startswith(code) and regex.sub(r"\d", "9", new) == regex.sub(r"\d", "9", x)
        national.setdefault(g, set()).add(regex.sub(r"\D", "", new[len(code) :]))
    assert [len(s) for s in national.values()] == [1, 1, 1]


def test_cards_with_equal_beginnings_share_nothing(spark):
    cards = ["4111111111111111", "4111111111111129", "4111111111111137"]
    got = pii.pseudonymise(cases.table(spark, [(i, x, None, None) for i, x in enumerate(cards)]), KEY).collect()
    assert len({r.text[:6] for r in got}) == 3


def test_long_texts(spark):
    texts = ["1 " * 5_000, "10.0.0.1 " * 20_000, "a" * 400_000 + "@b.org", "12-3 " * 2_000]
    started = time.time()
    got = {r.doc_id: r for r in pii.pseudonymise(cases.table(spark, [(i, x, None, None) for i, x in enumerate(texts)]), KEY).collect()}
    assert time.time() - started < 120  # seconds; quadratic work would take hours for the address
    assert [got[i].n_found for i in (1, 2)] == [20_000, 1] and all(len(got[i].text) > 0.8 * len(x) for i, x in enumerate(texts))
    assert len(set(got[1].text.split())) == 1 and len(got[2].text) == len(texts[2])
