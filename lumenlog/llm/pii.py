"""Format-preserving pseudonyms for personal data, as Column expressions only.

E-mail addresses, phone, card, social security and bank account numbers, IP addresses and dates are found by one pattern, validated,
and replaced by a value of the same format. A match may be followed by digits or words that are not its own: of its beginnings up to
a separator, one of the usual length of its kind that validates is taken, or else the longest that validates, and the search goes
on behind it. A keyed Feistel network permutes all values of the format, so equal values stay equal in
all documents, different ones stay different, and a validated number stays valid. What does not validate is left as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Steps of a text that are gathered before they are put away.
STEPS = 64
#: Numbers that one hash gives to a round.
DRAWS = 8

EMAIL = r"(?<![\p{L}\p{N}._+-])[\p{L}\p{N}._+-]++@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
PHONE = r"(?<![\p{L}\p{N}+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\)|[ .-]?\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\p{L}\p{N}])"
IP = r"(?<![\p{L}\p{N}.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?[\p{L}\p{N}])"
DATE = r"(?<![\p{L}\p{N}./-])(?:\d{4}([-/])\d{2}\1\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\p{L}\p{N}]|[./-]\d)"
SSN = r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)"
CARD = r"(?<![\p{L}\p{N}])\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}])"
#: Kinds in order of precedence where matches begin at the same place.
KINDS = {"email": EMAIL, "iban": IBAN, "phone": PHONE, "ip": IP, "date": DATE, "ssn": SSN, "card": CARD}
#: Country codes of one and two digits; all others have three.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3})(?:[ .-]?\(0\))?|^"
#: Usual lengths, without separators: phone numbers by country code, cards by issuer, bank accounts by country.
USUAL = {
    "phone": r"^(?:\+(?:[17]\d{10}|(?:27|31|33|34|41|48|61)\d{9}|(?:30|44|52|90|91)\d{10}|4[57]\d{8})|\d{10})$",
    "card": r"^(?:4\d{15}|3[47]\d{13}|(?:5[1-5]|2[2-7]|35|6\d)\d{14}|3[068]\d{12})$",
    "iban": r"^(?:NO.{13}|BE.{14}|(?:DK|FI|NL).{16}|(?:AT|LU).{18}|CH.{19}|(?:DE|GB|IE).{20}|(?:ES|SE|CZ).{22}|PT.{23}|(?:FR|IT|GR).{25}|(?:PL|HU).{26})$",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values()).replace(r"([-/])\d{2}\1\d{2}", r"(?:-\d{2}-|/\d{2}/)\d{2}")

# Days from 1900-01-01 to 2099-12-31 are 17 * 4297; social security numbers are (898 areas * 99 groups) * 9999 serials.
FIRST_DAY, DAY_RADIX = "1900-01-01", (17, 4297)
AREAS, GROUPS, SERIALS = 898, 99, 9999


def _long(x) -> Column:
    return F.lit(x).cast("bigint") if isinstance(x, int) else x.cast("bigint")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def feistel(left: Column, right: Column, left_radix, right_radix, tweak: Column, key: str) -> Column:
    """array(left, right) permuted within the two radices by a network whose rounds are keyed hashes."""

    def run(v: Column) -> Column:
        def turn(s: Column, i: Column) -> Column:
            digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), s[1].cast("string")), 256)
            drawn = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
            return F.array(s[1], F.pmod(s[0] + drawn, F.when(i % 2 == 0, v[2]).otherwise(v[3])))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.slice(v, 1, 2), turn)

    return let(F.array(_long(left), _long(right), _long(left_radix), _long(right_radix)), run)


def _permuted(symbols: Column, kind: str, key: str) -> Column:
    """New digits of all symbols, as array<bigint>: a network over two halves of the whole value, however long it is.

    A round adds to each digit of one half, within its radix, a number drawn from a keyed hash of the other half.
    """

    def whole(symbols: Column) -> Column:
        low = F.floor(F.size(symbols) / 2).cast("int")
        tweak = F.concat_ws("|", F.lit(kind), F.size(symbols).cast("string"))
        plain = F.transform(symbols, lambda s: s["digit"])
        start = F.struct(F.slice(plain, 1, low).alias("x"), F.slice(plain, low + 1, F.size(plain) - low).alias("y"))
        # The radices of the half that a round changes, and those of the other one.
        radix = F.transform(symbols, lambda s: s["radix"])
        first, second = F.slice(radix, 1, low), F.slice(radix, low + 1, F.size(radix) - low)

        def run(v: Column) -> Column:
            def turn(state: Column, i: Column) -> Column:
                seed = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), F.array_join(state["y"].cast("array<string>"), ".")), 256)

                def changed(blocks: Column) -> Column:
                    drawn = lambda d, j: d + F.conv(F.substring(F.get(blocks, F.floor(j / DRAWS).cast("int")), j % DRAWS * 8 + 1, 8), 16, 10).cast("bigint")
                    return F.zip_with(F.transform(state["x"], drawn), F.when(i % 2 == 0, v["first"]).otherwise(v["second"]), F.pmod)

                last = F.floor(F.size(state["x"]) / DRAWS).cast("int")
                blocks = lambda seed: F.transform(F.sequence(F.lit(0), last), lambda b: F.when(b == 0, seed).otherwise(F.sha2(F.concat_ws("|", seed, b.cast("string")), 256)))
                return F.struct(state["y"].alias("x"), let(let(seed, blocks), changed).alias("y"))

            return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), v["start"], turn, lambda s: F.concat(s["x"], s["y"]))

        return let(F.struct(start.alias("start"), first.alias("first"), second.alias("second")), run)

    return let(symbols, whole)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _symbols(chars: Column, alphabets: tuple[str, ...]) -> Column:
    """struct(radix, digit) of the characters that are in one of the alphabets."""

    def place(c: Column) -> Column:
        found = F.lit(None).cast("struct<radix:bigint,digit:bigint>")
        for a in alphabets:
            found = F.when(F.instr(F.lit(a), c) > 0, F.struct(_long(len(a)).alias("radix"), (F.instr(F.lit(a), c) - 1).cast("bigint").alias("digit"))).otherwise(found)
        return found

    return F.filter(F.transform(chars, place), lambda s: s.isNotNull())


def _written(text: Column, digits: Column, alphabets: tuple[str, ...]) -> Column:
    """The text with new digits in the places of the old ones; places beyond the last digit keep their character."""
    one = "[" + "".join(alphabets) + "]"

    def write(v: Column) -> Column:
        def put(c: Column, i: Column) -> Column:
            def symbol(digit: Column) -> Column:
                out = c
                for a in alphabets:
                    out = F.when(F.instr(F.lit(a), c) > 0, F.substring(F.lit(a), (digit + 1).cast("int"), 1)).otherwise(out)
                return F.coalesce(out, c)

            return let(F.get(v["digits"], i), symbol)

        between = F.split(v["text"], one, -1)
        return F.array_join(F.zip_with(between, F.transform(F.regexp_extract_all(v["text"], F.lit(f"({one})"), F.lit(1)), put), lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")

    return let(F.struct(text.alias("text"), digits.alias("digits")), write)


def _numbers(text: Column) -> Column:
    """Decimal digits of a text as numbers."""
    return F.transform(_chars(F.regexp_replace(text, r"[^0-9]", "")), lambda c: c.cast("int"))


def _luhn(digits: Column, skip: int) -> Column:
    """Luhn sum of digits; ``skip`` is 0 if the last is the check digit and 1 if that is still to come."""
    weighted = F.transform(F.reverse(digits), lambda d, i: F.when((i + skip) % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(weighted, F.lit(0), lambda a, b: a + b)


def _mod97(text: Column) -> Column:
    """The remainder that an account number's letters and digits leave, letters counting from 10."""
    return F.aggregate(
        _chars(text),
        F.lit(0),
        lambda n, c: F.when(F.instr(F.lit(DIGITS), c) > 0, (n * 10 + F.instr(F.lit(DIGITS), c) - 1) % 97).otherwise((n * 100 + F.instr(F.lit(UPPER), c) + 9) % 97).cast("int"),
    )


def _email(m: Column, key: str) -> Column:
    alphabets = (DIGITS, LOWER, UPPER)
    local = let(F.substring_index(m, "@", 1), lambda x: _written(x, _permuted(_symbols(_chars(x), alphabets), "email", key), alphabets))
    return F.concat(local, F.lit("@"), F.substring_index(m, "@", -1))


def _phone(m: Column, key: str) -> Column:
    """The country code and a bracketed trunk zero stay; numbers have 8 to 15 digits with the code, or 10 without.

    What is permuted is the national number alone, so all spellings of a number stay linked, with or without its country code.
    """
    code = F.regexp_extract(m, COUNTRY, 0)

    def new(code: Column) -> Column:
        rest = m.substr(F.length(code) + 1, F.length(m))
        return F.concat(code, let(rest, lambda x: _written(x, _permuted(_symbols(_chars(x), (DIGITS,)), "phone", key), (DIGITS,))))

    return F.when(F.size(_numbers(m)).between(8, 15), let(code, new))


def _card(m: Column, key: str) -> Column:
    """The check digit follows from the others."""

    def new(text: Column) -> Column:
        symbols = _symbols(_chars(text), (DIGITS,))
        body = let(symbols, lambda s: F.slice(s, 1, F.size(s) - 1))

        def checked(digits: Column) -> Column:
            check = F.pmod(10 - _luhn(F.transform(digits, lambda d: d.cast("int")), 1) % 10, F.lit(10)).cast("bigint")
            return _written(text, F.concat(digits, F.array(check)), (DIGITS,))

        return let(_permuted(body, "card", key), checked)

    return F.when(_luhn(_numbers(m), 0) % 10 == 0, let(m, new))


def _iban(m: Column, key: str) -> Column:
    """Country and letters stay; the check digits follow from the rest."""

    def new(account: Column) -> Column:
        check = 98 - _mod97(F.concat(F.regexp_replace(account, " ", ""), F.substring(m, 1, 2), F.lit("00")))
        return F.concat(F.substring(m, 1, 2), F.lpad(check.cast("string"), 2, "0"), account)

    plain = F.regexp_replace(m, " ", "")
    ok = (_mod97(F.concat(plain.substr(F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1) & F.length(plain).between(15, 34)
    account = let(m.substr(F.lit(5), F.length(m)), lambda x: _written(x, _permuted(_symbols(_chars(x), (DIGITS,)), "iban", key), (DIGITS,)))
    return F.when(ok, let(account, new))


def _ip(m: Column, key: str) -> Column:
    parts = F.split(m, r"\.")
    ok = F.forall(parts, lambda x: (x.cast("int") < 256) & (x.cast("int").cast("string") == x))

    def new(p: Column) -> Column:
        net = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, F.lit("ip"), key)
        return F.array_join(F.transform(net, lambda n: F.concat_ws(".", F.floor(n / 256).cast("string"), (n % 256).cast("string"))), ".")

    return F.when(ok, let(F.transform(parts, lambda x: x.cast("bigint")), new))


def _date(m: Column, key: str) -> Column:
    """Days from 1900 to 2099, written year first, or day first with dots, or month first with slashes."""
    iso = F.when(m.rlike(r"^\d{4}"), F.regexp_replace(m, "/", "-")).otherwise(
        F.when(m.contains("."), F.regexp_replace(m, r"(\d+)\.(\d+)\.(\d+)", "$3-$2-$1")).otherwise(F.regexp_replace(m, r"(\d+)/(\d+)/(\d+)", "$3-$1-$2"))
    )
    form = F.when(m.rlike(r"^\d{4}-"), "yyyy-MM-dd").when(m.rlike(r"^\d{4}/"), "yyyy/MM/dd").when(m.contains("."), "dd.MM.yyyy").otherwise("MM/dd/yyyy")
    size, fine = DAY_RADIX[0] * DAY_RADIX[1], DAY_RADIX[1]

    def new(day: Column) -> Column:
        net = feistel(F.floor(day / fine), F.pmod(day, F.lit(fine)), *DAY_RADIX, F.lit("date"), key)
        moved = let(net, lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), (n[0] * fine + n[1]).cast("int")))
        return F.when((day >= 0) & (day < size), F.call_function("date_format", moved, form))

    return let(F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date")), new)


def _ssn(m: Column, key: str) -> Column:
    """Area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999."""

    def new(part: Column) -> Column:
        ok = part[0].between(1, 899) & (part[0] != 666) & (part[1] > 0) & (part[2] > 0)
        area = F.when(part[0] > 666, part[0] - 2).otherwise(part[0] - 1)
        net = feistel(area * GROUPS + part[1] - 1, part[2] - 1, AREAS * GROUPS, SERIALS, F.lit("ssn"), key)
        return F.when(ok, let(net, written))

    def written(net: Column) -> Column:
        area = F.floor(net[0] / GROUPS)
        pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
        return F.concat_ws("-", pad(F.when(area >= 665, area + 2).otherwise(area + 1), 3), pad(net[0] % GROUPS + 1, 2), pad(net[1] + 1, 4))

    return let(F.transform(F.split(m, "-"), lambda x: x.cast("bigint")), new)


REPLACERS = {"email": _email, "iban": _iban, "phone": _phone, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card}


def _named(kind: str):
    return lambda v: F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def pseudonym(match: Column, key: str) -> Column:
    """Struct of the kind and the pseudonym of one match; both null if it does not validate as any kind."""
    out = F.lit(None).cast("struct<kind:string,value:string>")
    for kind in reversed(list(KINDS)):
        value = F.when(match.rlike("^(?:" + KINDS[kind] + ")$"), REPLACERS[kind](match, key))
        out = F.coalesce(let(value, _named(kind)), out)
    return out


def _valid(part: Column, usual: bool) -> Column:
    """Whether a beginning of a match validates as a phone, card or account number, of a usual length if that is asked."""
    plain = F.regexp_replace(part, "[^0-9A-Z+]", "")
    account = _mod97(F.concat(plain.substr(F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1
    checks = {"iban": account & F.length(plain).between(15, 34), "phone": F.size(_numbers(part)).between(8, 15), "card": _luhn(_numbers(part), 0) % 10 == 0}
    out = F.lit(False)
    for kind, check in checks.items():
        fits = part.rlike("^(?:" + KINDS[kind] + ")$")
        out = F.when(fits & plain.rlike(USUAL[kind]) if usual else fits, check).otherwise(out)
    return out


def _accepted(match: Column) -> Column:
    """The part of a match from its beginning on that is looked at as a value; the whole match if no part is better."""

    def pick(parts: Column) -> Column:
        starts = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), ""))

        def best(s: Column) -> Column:
            usual, valid = F.get(F.filter(s, lambda x: _valid(x, True)), F.lit(0)), F.get(F.filter(s, lambda x: _valid(x, False)), F.lit(0))
            return F.coalesce(usual, valid, s[0])

        return let(starts, best)

    numeric = "^(?:" + "|".join(f"(?:{KINDS[k]})" for k in ("iban", "phone", "card")) + ")$"
    return F.when(match.rlike(numeric), let(F.split(match, r"(?<=[0-9A-Z])(?=[ .()-])"), pick)).otherwise(match)


def _taken(looked: Column) -> Column:
    """For each piece of the text what of it stays (from ``cut`` on) and whether its value is replaced.

    A piece begins where a match may begin and ends before the next such place; a value may reach over several pieces, and those
    places are then passed over.
    """
    steps = F.array().cast("array<struct<cut:int,taken:boolean>>")
    start = F.struct(F.lit(0).alias("over"), F.array().cast("array<array<struct<cut:int,taken:boolean>>>").alias("done"), steps.alias("open"))

    # Steps are gathered in short arrays, as an array is copied whenever a step is added.
    def turn(state: Column, x: Column) -> Column:
        taken = (state["over"] == 0) & (x["reach"] > 0)
        reach = F.when(taken, x["reach"]).otherwise(state["over"])
        step = F.array(F.struct(F.least(reach, x["size"]).alias("cut"), taken.alias("taken")))
        full = F.size(state["open"]) == STEPS
        done = F.when(full, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])
        return F.struct(F.greatest(reach - x["size"], F.lit(0)).alias("over"), done.alias("done"), F.when(full, step).otherwise(F.concat(state["open"], step)).alias("open"))

    return F.aggregate(looked, start, turn, lambda state: F.concat(F.flatten(state["done"]), state["open"]))


def pseudonymise(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, the text with pseudonyms, ``n_found``, and ``found``: kind and pseudonym of each, in order.

    A null text stays null and an empty one empty, with nothing found. The same key gives the same pseudonyms in every run and
    document; without the key they cannot be undone. A null id stays null, and repeated rows are each rewritten. Only the two
    named columns are read; an empty table gives an empty result. Rows are rewritten where they lie, nothing is shuffled.
    """
    text = F.col(text_col)
    ahead = f"(?=({ANY}))"
    looked = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ahead), F.lit(1)))
    some = F.size("m") > 0
    rows = df.select(F.col(id_col).alias("id"), text.alias("t"), looked.alias("m"))
    # A line break in front, so that the first piece is never one that begins with a match.
    pieces = F.when(some, F.split(F.concat(F.lit("\n"), "t"), f"(?={ANY})", -1))
    rows = rows.select("id", "t", "m", pieces.alias("s"), F.when(some, F.transform("m", _accepted)).alias("a"))
    named = F.transform("a", lambda x: let(pseudonym(x, key), lambda p: F.struct(p.alias("p"), F.when(p["value"].isNull(), 0).otherwise(F.length(x)).alias("reach"))))
    rows = rows.select("id", "t", "s", F.when(some, named).alias("p"))
    sized = F.zip_with(F.slice("s", 2, F.size("s")), "p", lambda x, p: F.struct(p["reach"].alias("reach"), F.length(x).alias("size")))
    rows = rows.select("id", "t", "s", "p", F.when(F.col("p").isNotNull(), _taken(sized)).alias("k"))
    each = F.arrays_zip(F.slice("s", 2, F.size("s")).alias("s"), F.col("p.p").alias("p"), F.col("k").alias("k"))
    rows = rows.select("id", "t", "s", each.alias("e"))
    write = lambda e: F.concat(F.when(e["k"]["taken"], e["p"]["value"]).otherwise(F.lit("")), e["s"].substr(e["k"]["cut"] + 1, F.length(e["s"])))
    joined = F.concat(F.expr("substring(s[0], 2)"), F.array_join(F.transform("e", write), ""))
    found = F.transform(F.filter("e", lambda e: e["k"]["taken"]), lambda e: e["p"])
    found = F.coalesce(found, F.array().cast("array<struct<kind:string,value:string>>"))
    out = rows.select("id", F.when(F.col("e").isNotNull(), joined).otherwise(F.col("t")).alias("text"), found.alias("found"))
    return out.select(F.col("id").alias(id_col), "text", F.size("found").cast("bigint").alias("n_found"), "found")
