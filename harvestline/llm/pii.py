"""Format-preserving pseudonyms of personal data by a keyed Feistel network, in DataFrame functions only.

A value is validated (check digits, calendar, ranges), split into places of known sizes and permuted among all values of its
format: equal values have equal pseudonyms in all documents, different ones have different pseudonyms, and the result is
valid again. Values that fail validation are left as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Letters of names beyond a-z that keep their class: the Latin-1 block's small letters.
_LATIN_SMALL = (0xDF, 0xFF)

_NOT_IN = r"(?<![A-Za-z0-9])"
_END = r"(?![A-Za-z0-9])"
#: Countries by the length of their IBANs; other countries' lengths are open.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG YE", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """The country's own length first, so that a word or number after it is not taken for a part of it."""
    known = (rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items())
    return rf"{_NOT_IN}(?:(?:{'|'.join(known)}){_END}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_END})"


#: kind and pattern, tried in this order at each place of the text.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": _iban_pattern(),
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9A-Za-z])",
    "date": _NOT_IN + r"(?:(?:19|20)[0-9]{2}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2(?:19|20)[0-9]{2})" + _END,
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "phone": r"(?<![A-Za-z0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![A-Za-z0-9])|(?<![A-Za-z0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![A-Za-z0-9])|(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![A-Za-z0-9-])",
    "card": _NOT_IN + r"(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\3[0-9]{4}\3[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\4[0-9]{5})" + _END,
}
ANY = "|".join(PATTERNS.values())
#: Years of the dates that are permuted.
YEARS = (1900, 2099)


def _last_day(month: int) -> int:
    return 28 if month == 2 else 30 if month in (4, 6, 9, 11) else 31


#: Days of the year but 29 February, as MM-dd, by the order and widths of day and month. Of day-first dates (dmy) those that could be
#: month-first as well (any) are a layout of their own, so a pseudonym is read as its value was.
LAYOUTS = {
    f"{order}{wd}{wm}": [f"{m:02}-{d:02}" for m in range(1, 13 if wm == 2 else 10) for d in range(first, min(last, _last_day(m), 31 if wd == 2 else 9) + 1)]
    for order, first, last, widths in (("ymd", 1, 31, (1, 2)), ("any", 1, 12, (1, 2)), ("dmy", 13, 31, (2,)), ("mdy", 13, 31, (2,)))
    for wd in widths for wm in (1, 2)
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def feistel(values: Column, sizes: Column, key: str) -> Column:
    """A keyed permutation of arrays of int: the value at each place stays below the size of that place.

    The halves take turns; each round adds to one half, place by place, a keyed hash of the other one.
    """
    n, half = F.size(values), F.floor(F.size(values) / 2).cast("int")
    start = F.struct(
        F.slice(values, 1, half).alias("a"), F.slice(values, half + 1, n).alias("b"),
        F.slice(sizes, 1, half).alias("size_a"), F.slice(sizes, half + 1, n).alias("size_b"),
    )

    def step(s: Column, r: Column) -> Column:
        text = F.concat_ws("|", F.lit(key), r.cast("string"), F.array_join(s["size_a"].cast("array<string>"), ","), F.array_join(s["b"].cast("array<string>"), ","))
        added = _let(F.sha2(text, 256), lambda h: F.transform(F.arrays_zip(s["a"].alias("v"), s["size_a"].alias("m")), lambda x, i: F.pmod(x["v"] + F.pmod(F.xxhash64(h, i), x["m"]), x["m"]).cast("int")))
        return F.struct(s["b"].alias("a"), added.alias("b"), s["size_b"].alias("size_a"), s["size_a"].alias("size_b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.flatten(F.array(s["a"], s["b"])))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _digits(text: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(text, "[^0-9]", "")), lambda c: c.cast("int"))


def _refill(text: Column, place: str, new: Column) -> Column:
    """The text with its characters of the class, in order, replaced by the strings of new."""
    step = lambda s, c: F.when(
        c.rlike(place), F.struct((s["i"] + 1).alias("i"), F.concat_ws("", s["out"], F.get(new, s["i"])).alias("out"))
    ).otherwise(F.struct(s["i"].alias("i"), F.concat_ws("", s["out"], c).alias("out")))
    return F.aggregate(_chars(text), F.struct(F.lit(0).alias("i"), F.lit("").alias("out")), step, lambda s: s["out"])


def _same(values: Column, size: int) -> Column:
    return F.transform(values, lambda _: F.lit(size))


def luhn_sum(digits: Column) -> Column:
    n = F.size(digits)
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.transform(digits, lambda d, i: F.when(F.pmod(n - i, F.lit(2)) == 0, doubled(d)).otherwise(d)), F.lit(0), lambda a, x: a + x)


def _card(text: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        body = F.slice(d, 1, F.size(d) - 1)
        return _let(feistel(body, _same(body, 10), f"{key}|card"), lambda p: F.flatten(F.array(p, F.array(F.pmod(10 - F.pmod(luhn_sum(F.flatten(F.array(p, F.array(F.lit(0))))), F.lit(10)), F.lit(10))))))

    fill = lambda d: F.when(F.pmod(luhn_sum(d), F.lit(10)) == 0, _let(new(d).cast("array<string>"), lambda n: _refill(text, "[0-9]", n)))
    return _let(_digits(text), fill)


def _phone(text: Column, key: str) -> Column:
    code = F.regexp_extract(text, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substring(text, F.length(code) + 1, F.length(text))
    fill = lambda d: F.when(F.size(d).between(6, 15), F.concat(code, _let(feistel(d, _same(d, 10), f"{key}|phone").cast("array<string>"), lambda n: _refill(rest, "[0-9]", n))))
    return _let(_digits(rest), fill)


def _ip(text: Column, key: str) -> Column:
    octets = F.transform(F.split(text, r"\."), lambda x: x.cast("int"))
    return _let(octets, lambda o: F.when(F.array_max(o) < 256, F.array_join(feistel(o, _same(o, 256), f"{key}|ip").cast("array<string>"), ".")))


def _ssn(text: Column, key: str) -> Column:
    parts = F.transform(F.split(text, "-"), lambda x: x.cast("int"))
    valid = lambda p: (F.get(p, F.lit(0)).between(1, 899)) & (F.get(p, F.lit(0)) != 666) & (F.get(p, F.lit(1)) > 0) & (F.get(p, F.lit(2)) > 0)
    area = lambda p: F.get(p, F.lit(0))
    places = lambda p: F.array(area(p) - F.when(area(p) > 666, 2).otherwise(1), F.get(p, F.lit(1)) - 1, F.get(p, F.lit(2)) - 1)
    sizes = F.array(F.lit(898), F.lit(99), F.lit(9999))
    back = lambda q: F.concat_ws("-", F.lpad((area(q) + F.when(area(q) > 664, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((F.get(q, F.lit(1)) + 1).cast("string"), 2, "0"), F.lpad((F.get(q, F.lit(2)) + 1).cast("string"), 4, "0"))
    return _let(parts, lambda p: F.when(valid(p), _let(feistel(places(p), sizes, f"{key}|ssn"), back)))


def _date(text: Column, key: str) -> Column:
    """Another date of the same order, marks and widths of the fields."""
    mark = F.substring(F.regexp_replace(text, "[0-9]", ""), F.lit(1), F.lit(1))
    part = lambda p, i: F.get(p, F.lit(i))
    day = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    iso = lambda p: F.length(part(p, 0)) == 4
    day_first = lambda p: day(part(p, 2), part(p, 1), part(p, 0))
    value = lambda p: F.when(iso(p), day(part(p, 0), part(p, 1), part(p, 2))).otherwise(F.coalesce(day_first(p), day(part(p, 2), part(p, 0), part(p, 1))))
    order = lambda p: F.when(iso(p), F.lit("ymd")).when(day_first(p).isNull(), F.lit("mdy")).when(F.dayofmonth(day_first(p)) > 12, F.lit("dmy")).otherwise(F.lit("any"))
    new = lambda p: _let(F.struct(value(p).alias("day"), order(p).alias("order")), lambda v: F.when(F.year(v["day"]).between(*YEARS), _other_date(p, v["day"], v["order"], key)))
    return _let(F.split(text, "[-/.]"), lambda p: F.replace(new(p), F.lit("-"), mark))


def _other_date(p: Column, day: Column, order: Column, key: str) -> Column:
    """Year and day of the year are permuted among those of the layout, 29 February among the leap years."""
    at = lambda ymd, mdy, dmy: F.length(F.when(order == "ymd", F.get(p, F.lit(ymd))).when(order == "mdy", F.get(p, F.lit(mdy))).otherwise(F.get(p, F.lit(dmy))))
    wide_day, wide_month = at(2, 1, 0), at(1, 0, 1)
    layout = F.concat(order, wide_day.cast("string"), wide_month.cast("string"))
    days = F.lit(None).cast("array<string>")
    for name, values in LAYOUTS.items():
        days = F.when(layout == name, F.array(*map(F.lit, values))).otherwise(days)
    year, leap = F.year(day) - YEARS[0], F.date_format(day, "MM-dd") == "02-29"
    n = F.floor((year - 4) / 4).cast("int")
    leap_day = lambda q: F.concat((1904 + 4 * (7 * F.get(q, F.lit(0)) + F.get(q, F.lit(1)))).cast("string"), F.lit("-02-29"))
    other = lambda d: _let(feistel(F.array(year, F.array_position(d, F.date_format(day, "MM-dd")).cast("int") - 1), F.array(F.lit(200), F.size(d)), f"{key}|date"), lambda q: F.concat_ws("-", (1900 + F.get(q, F.lit(0))).cast("string"), F.get(d, F.get(q, F.lit(1)))))
    new = F.when(leap, _let(feistel(F.array(F.floor(n / 7).cast("int"), F.pmod(n, F.lit(7))), F.array(F.lit(7), F.lit(7)), f"{key}|date"), leap_day)).otherwise(_let(days, other))

    def written(d: Column) -> Column:
        field = lambda i, width: F.when(width == 1, F.substring(d, i + 1, 1)).otherwise(F.substring(d, i, 2))
        y, m, dd = F.substring(d, 1, 4), field(6, wide_month), field(9, wide_day)
        return F.when(order == "ymd", F.concat_ws("-", y, m, dd)).when(order == "mdy", F.concat_ws("-", m, dd, y)).otherwise(F.concat_ws("-", dd, m, y))

    return _let(new, written)


def _mod97(text: Column) -> Column:
    """Of a text of digits and capitals, which count from 10."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), F.pmod(a * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97)))
    return F.aggregate(_chars(text), F.lit(0), step)


def _classed(chars: Column) -> tuple[Column, Column, Callable[[Column], Column]]:
    """Values and sizes of characters by class (digits, small and capital letters, Latin small letters; others have size 1), and the way back."""
    low, high = _LATIN_SMALL
    code = lambda c: F.ascii(c)
    base = lambda c: F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).when(c.rlike("[A-Z]"), 65).when(code(c).between(low, high), low).otherwise(code(c))
    size = lambda c: F.when(c.rlike("[0-9]"), 10).when(c.rlike("[A-Za-z]"), 26).when(code(c).between(low, high), high - low + 1).otherwise(1)
    back = lambda new: F.transform(F.arrays_zip(chars.alias("c"), new.alias("n")), lambda x: F.when(size(x["c"]) == 1, x["c"]).otherwise(F.char(base(x["c"]) + x["n"])))
    return F.transform(chars, lambda c: code(c) - base(c)), F.transform(chars, size), back


def _iban(text: Column, key: str) -> Column:
    plain = F.replace(text, F.lit(" "), F.lit(""))
    body = F.substring(plain, F.lit(5), F.length(plain))
    values, sizes, back = _classed(_chars(body))
    new_body = F.array_join(back(feistel(values, sizes, f"{key}|iban")), "")
    check = lambda b: F.lpad((98 - _mod97(F.concat(b, F.substring(plain, F.lit(1), F.lit(2)), F.lit("00")))).cast("string"), 2, "0")
    whole = lambda b: F.concat(F.substring(plain, F.lit(1), F.lit(2)), check(b), b)
    return F.when(_mod97(F.concat(body, F.substring(plain, F.lit(1), F.lit(4)))) == 1, _let(new_body, lambda b: _let(_chars(whole(b)), lambda n: _refill(text, "[A-Z0-9]", n))))


def _email(text: Column, key: str) -> Column:
    local = F.substring_index(text, "@", 1)
    values, sizes, back = _classed(_chars(local))
    return F.concat(F.array_join(back(feistel(values, sizes, f"{key}|email")), ""), F.substring(text, F.length(local) + 1, F.length(text)))


_MAKERS = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _whole(kind: str) -> str:
    """The kind's pattern for a match on its own, whose back references count from its own groups."""
    pattern = PATTERNS[kind].replace(r"\3", r"\1").replace(r"\4", r"\2")
    return f"^(?:{pattern})$"


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text, found (kind, value, pseudonym) for each row of docs, by a secret key.

    The whole text is read; values are found from the left without overlap and only valid ones are replaced. A null text
    stays null, a text without values stays as it is, texts of any length are read to the end, repeated rows change alike, an empty table
    gives no rows, and columns other than doc_id and text are not read. Found values are for tests and audits: drop them before the texts are passed on.
    """
    text = F.col("text")

    def mapped(m: Column) -> Column:
        cases = [F.when(m.rlike(_whole(kind)), F.struct(F.lit(kind).alias("kind"), m.alias("value"), make(m, key).alias("pseudonym"))) for kind, make in _MAKERS.items()]
        return F.coalesce(*cases, F.struct(F.lit("").alias("kind"), m.alias("value"), F.lit(None).cast("string").alias("pseudonym")))

    found = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), mapped)
    none = F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")
    rows = docs.select("doc_id", "text", F.when(text.rlike(ANY), found).otherwise(none).alias("all"))
    gaps = F.split(text, ANY, -1)
    pieces = F.transform(F.arrays_zip(gaps.alias("gap"), F.col("all").alias("all")), lambda x: F.concat_ws("", x["gap"], F.coalesce(x["all"]["pseudonym"], x["all"]["value"])))
    return rows.select(
        "doc_id", F.when(F.size("all") > 0, F.array_join(pieces, "")).otherwise(text).alias("text"),
        F.filter("all", lambda x: x["pseudonym"].isNotNull()).alias("found"),
    )


def pii_digests(rows: DataFrame) -> DataFrame:
    """doc_id, n_found, the count of each kind, and the pseudonymised text."""
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", F.size("found").cast("long").alias("n_found"), *map(count, PATTERNS), "text")
