"""Format-preserving pseudonyms for personal data (operator 10). DataFrame operations only.

Values are found by pattern, validated (Luhn for cards, modulus 97 for IBANs, ranges for addresses, social security numbers and dates) and permuted by a
keyed Feistel network within their format. Cards, IBANs and phone numbers run through it as bare digits and capitals: a round adds a keyed hash of one
half to the characters of the other, each in its own radix, and separators are put back after it, so one number gets one pseudonym however it is
written. Social security numbers, addresses and dates are pairs of numbers, each side of which is moved by a keyed hash of the other within its own
range, so results are valid; day and month forms that could be read as one another keep apart by walking the cycle until the form fits. Check digits
are made anew. The permutation depends on the key and kind alone, so equal values stay linked across documents and different values stay apart; as in any
permutation a value may be its own image. A date's form is part of its value: the same day in two forms gets two pseudonyms.

Cards and IBANs are looked for from each group of a run of digits (capitals) that single spaces or hyphens (spaces) hold together, longest first, so
numbers beside a value don't hide it. One run of groups in ten has a valid Luhn sum by chance, so long rows of numbers lose some of them to pseudonyms,
and of overlapping valid runs that no issuer uses the leftmost is taken, which can be the wrong one. Not looked for: IPv6 addresses, mail addresses with
letters beyond ASCII, dates before 1900 or from August 2099.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.column import Column

from .common import free_name

ROUNDS, WALKS = 8, 24
DAY_SIDE, FIRST_DAY, FIRST_YEAR, YEARS = 270, "1900-01-01", 1900, 200
#: International country codes, none of which begins another; those not listed have three digits.
COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_DIGIT = r"[ .()-]{0,2}\d"
#: The longest of 8 to 15 digits (spelt out, as Java doesn't bound the length of a repeated group in a look-behind); what follows may be another number.
_PLUS = r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)(?<=\+" + _DIGIT * 8 + f"(?:{_DIGIT})?" * 7 + ")"
#: Candidates of each kind in the order in which they are tried; a part of a text belongs to the first kind that finds a valid value there. Those of
#: iban and card are runs of groups, which `_in_run` searches. An international number that ends its run of digits goes before cards, others after.
PATTERNS = {
    "email": r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?=(?: ?[A-Z0-9]){11})[A-Z0-9]*+(?![a-z])(?: [A-Z0-9]++(?![a-z]))*+",
    "ip": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\d|\.\d)",
    "date": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": _PLUS + r"(?![ .-]?\d)|(?<![\w(])\(\d{3}\) ?\d{3}[.-]\d{4}(?!\d)|(?<![\w-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "card": r"(?<![A-Za-z0-9_.-])(?=\d(?:[ -]?\d){12})\d++(?![A-Za-z_]|-(?!\d))(?:[ -]\d++(?![A-Za-z_]|-(?!\d)))*+",
}
PASSES = (*PATTERNS.items(), ("phone", _PLUS))
ANY = "|".join(f"(?:{p})" for _, p in PASSES)
#: First digits and lengths that card issuers use; of several valid cards in one run of digits these are taken first.
ISSUED = r"^(?:4(?:\d{12}|\d{15}|\d{18})|5[1-5]\d{14}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}|3[47]\d{13}|3(?:0[0-5]|[689]\d)\d{11}|6\d{15,18}|35\d{14,17})$"
PIECES = "array<struct<v:string,k:string>>"

def _hash(key: str, kind: str, step: Column, half: Column) -> Column:
    """64 hexadecimal digits."""
    return F.sha2(F.concat(F.lit(f"{key}|{kind}|"), step.cast("string"), F.lit("|"), half).cast("binary"), 256)


def _number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def feistel(value: Column, key: str, kind: str) -> Column:
    """Keyed permutation of the strings of one format; letters and digits move, all else stays. A single one moves by a fixed step that isn't 0."""

    def turned(c: Column, number: Column, least: int = 0) -> Column:
        turn = lambda low, radix: F.char(low + F.pmod(F.ascii(c) - low + (number % (radix - least)) + least, F.lit(radix)))
        return F.when(c.rlike("^[0-9]$"), turn(48, 10)).when(c.rlike("^[a-z]$"), turn(97, 26)).when(c.rlike("^[A-Z]$"), turn(65, 26)).otherwise(c)

    def added(mine: Column, other: Column, step: Column) -> Column:
        moved = lambda h: F.array_join(F.transform(F.split(mine, ""), lambda c, i: turned(c, _number(F.substring(h, 4 * (i % 16) + 1, F.lit(4))))), "")
        return _bound(_hash(key, kind, step, other), moved)

    half = F.ceil(F.length(value) / 2).cast("int")
    begin = F.struct(F.substring(value, F.lit(1), half).alias("a"), F.substring(value, half + 1, F.length(value)).alias("b"))
    step = lambda acc, r: F.struct(acc.b.alias("a"), added(acc.a, acc.b, r).alias("b"))
    whole = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, step, lambda acc: F.concat(acc.a, acc.b))
    return F.when(F.length(value) > 1, whole).otherwise(turned(value, _number(F.substring(_hash(key, kind, F.lit(0), F.lit("")), 1, 8)), 1))


def _bare(v: Column) -> Column:
    return F.regexp_replace(v, "[^A-Za-z0-9]", "")


def _put_back(v: Column, bare: Column) -> Column:
    """v with its letters and digits replaced by those of bare in turn."""
    begin = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    put = lambda b: F.aggregate(
        F.split(v, ""),
        begin,
        lambda a, c: F.when(c.rlike("^[A-Za-z0-9]$"), F.struct(F.concat(a.s, F.substring(b, a.i, F.lit(1))).alias("s"), (a.i + 1).alias("i"))).otherwise(
            F.struct(F.concat(a.s, c).alias("s"), a.i.alias("i"))
        ),
        lambda a: a.s,
    )
    return _bound(bare, put)


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits whose last one is the check digit."""
    twice = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    step = lambda a, c: F.struct((a.s + F.when(a.i % 2 == 0, c.cast("int")).otherwise(twice(c.cast("int")))).alias("s"), (a.i + 1).alias("i"))
    return F.aggregate(F.reverse(F.split(digits, "")), F.struct(F.lit(0).alias("s"), F.lit(0).alias("i")), step, lambda a: a.s)


def _mod97(value: Column) -> Column:
    return F.aggregate(F.split(value, ""), F.lit(0), lambda m, c: F.when(c.rlike("^[0-9]$"), (m * 10 + F.ascii(c) - 48) % 97).otherwise((m * 100 + F.ascii(c) - 55) % 97))


def _card(v: Column, key: str) -> Column:
    """The digits before the last are permuted, the last makes the sum a multiple of ten."""
    head = feistel(F.substring(_bare(v), F.lit(1), F.length(_bare(v)) - 1), key, "card")
    check = lambda h: F.concat(h, ((10 - _luhn(F.concat(h, F.lit("0"))) % 10) % 10).cast("string"))
    return _put_back(v, _bound(head, check))


def _iban(v: Column, key: str) -> Column:
    country = F.substring(v, 1, 2)
    made = lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b)
    return _put_back(v, _bound(feistel(F.substring(_bare(v), F.lit(5), F.length(v)), key, "iban"), made))


def _pair(a: Column, b: Column) -> Column:
    return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))


def _pair_network(pair: Column, sides: tuple[int, int], key: str, kind: str) -> Column:
    """Keyed permutation of the pairs with 0 <= a < sides[0] and 0 <= b < sides[1]: by turns each is moved by a hash of the other."""
    shift = lambda r, half: _number(F.substring(_hash(key, kind, r, half.cast("string")), 1, 12))
    step = lambda acc, r: F.when(r % 2 == 1, _pair(F.pmod(acc.a + shift(r, acc.b), F.lit(sides[0])), acc.b)).otherwise(
        _pair(acc.a, F.pmod(acc.b + shift(r, acc.a), F.lit(sides[1])))
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), pair, step)


def _walked(pair: Column, sides: tuple[int, int], key: str, kind: str, fits) -> Column:
    """The first pair that fits on the way of a pair that fits through the network's cycle; WALKS steps leave none unfinished in practice."""
    state = lambda p, done: F.struct(p.a.alias("a"), p.b.alias("b"), done.alias("done"))
    step = lambda acc, _: F.when(acc.done, acc).otherwise(_bound(_pair_network(_pair(acc.a, acc.b), sides, key, kind), lambda p: state(p, fits(p))))
    begin = _bound(pair, lambda p: state(p, F.lit(False)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), begin, step)


def _padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("long").cast("string"), width, "0")


def _ssn(v: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999: (area and group, serial) is a pair."""
    part = lambda at, n: F.substring(v, at, n).cast("int")
    area = part(1, 3) - 1 - F.when(part(1, 3) > 666, 1).otherwise(0)
    said = lambda p: F.concat_ws("-", _padded(F.floor(p.a / 99) + F.when(F.floor(p.a / 99) >= 665, 2).otherwise(1), 3), _padded(p.a % 99 + 1, 2), _padded(p.b + 1, 4))
    return _bound(_pair_network(_pair(area * 99 + part(5, 2) - 1, part(8, 4) - 1), (898 * 99, 9999), key, "ssn"), said)


def _ip(v: Column, key: str) -> Column:
    octet = lambda i: F.get(F.split(v, r"\."), F.lit(i)).cast("int")
    parts = lambda p: F.concat_ws(".", *(x.cast("long").cast("string") for x in (F.floor(p.a / 256), p.a % 256, F.floor(p.b / 256), p.b % 256)))
    return _bound(_pair_network(_pair(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3)), (65536, 65536), key, "ip"), parts)


def _day(v: Column) -> Column:
    """Days since FIRST_DAY of a date with hyphens; null where there is no such day."""
    return F.datediff(F.try_to_timestamp(v, F.lit("yyyy-MM-dd")).cast("date"), F.lit(FIRST_DAY).cast("date"))


def _slashed(v: Column) -> tuple[Column, Column, Column]:
    return F.substring(v, 1, 2).cast("int"), F.substring(v, 4, 2).cast("int"), F.substring(v, 7, 4).cast("int")


def _real_date(v: Column) -> Column:
    """Whether v is a day in range; of two numbers before the year the second is the day if it is over 12, else the first."""
    one, two, year = _slashed(v)
    form = F.when(two > 12, F.lit("MM/dd/yyyy")).otherwise(F.lit("dd/MM/yyyy"))
    slashed = F.try_to_timestamp(v, form).isNotNull() & year.between(FIRST_YEAR, FIRST_YEAR + YEARS - 1)
    return F.coalesce(F.when(v.contains("-"), _day(v).between(0, DAY_SIDE * DAY_SIDE - 1)).otherwise(slashed), F.lit(False))


def _date(v: Column, key: str) -> Column:
    """Days with hyphens are numbers of a day. With slashes there are three forms that stay apart: both numbers up to 12, day first, month first."""
    moved = lambda p: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (p.a * DAY_SIDE + p.b).cast("int")), "yyyy-MM-dd")
    hyphens = _bound(_pair_network(_pair(F.floor(_day(v) / DAY_SIDE), _day(v) % DAY_SIDE), (DAY_SIDE, DAY_SIDE), key, "date"), moved)
    one, two, year = _slashed(v)
    slashed = lambda x, y, b: F.concat_ws("/", _padded(x, 2), _padded(y, 2), _padded(b + FIRST_YEAR, 4))
    either = _bound(_pair_network(_pair((one - 1) * 12 + two - 1, year - FIRST_YEAR), (144, YEARS), key, "date/"), lambda p: slashed(F.floor(p.a / 12) + 1, p.a % 12 + 1, p.b))
    # a month and a day from 13 to 31 make one side; the network may give a day that its month doesn't have, so the cycle is walked on
    month, day = lambda p: F.floor(p.a / 19).cast("int") + 1, lambda p: (p.a % 19 + 13).cast("int")
    exists = lambda p: day(p) <= F.dayofmonth(F.last_day(F.make_date((p.b + FIRST_YEAR).cast("int"), month(p), F.lit(1))))
    by_day = lambda m, d, kind, said: _bound(_walked(_pair((m - 1) * 19 + d - 13, year - FIRST_YEAR), (228, YEARS), key, kind, exists), said)
    day_first = by_day(two, one, "date/d", lambda p: slashed(day(p), month(p), p.b))
    month_first = by_day(one, two, "date/m", lambda p: slashed(month(p), day(p), p.b))
    return F.when(v.contains("-"), hyphens).when(one > 12, day_first).when(two > 12, month_first).otherwise(either)


def _phone(v: Column, key: str) -> Column:
    """The country code behind a plus stays; what follows is permuted as numbers without one are."""
    code = F.when(v.startswith("+"), F.regexp_extract(_bare(v), f"^(?:{COUNTRY})", 0)).otherwise(F.lit(""))
    return _put_back(v, F.concat(code, feistel(F.substring(_bare(v), F.length(code) + 1, F.length(v)), key, "phone")))


def _email(v: Column, key: str) -> Column:
    return F.concat(feistel(F.substring_index(v, "@", 1), key, "email"), F.lit("@"), F.substring_index(v, "@", -1))


def _piece(v: Column, k: str = "") -> Column:
    return F.struct(v.alias("v"), F.lit(k).alias("k"))


def _merged(pieces: Column) -> Column:
    """Neighbouring pieces without a kind made one."""
    begin = F.struct(F.array().cast(PIECES).alias("done"), F.lit("").alias("open"))
    both = lambda acc: F.concat(acc.done, F.when(acc.open == "", F.array().cast(PIECES)).otherwise(F.array(_piece(acc.open))))
    longer = lambda acc, p: F.struct(acc.done.alias("done"), F.concat(acc.open, p.v).alias("open"))
    closed = lambda acc, p: F.struct(F.concat(both(acc), F.array(p)).alias("done"), F.lit("").alias("open"))
    step = lambda acc, p: F.when(p.k == "", longer(acc, p)).otherwise(closed(acc, p))
    return F.aggregate(pieces, begin, step, both)


def _in_run(run: Column, kind: str, group: str, most: int, valid) -> Column:
    """Pieces of a run of groups: from each group on, the longest valid value of up to `most` groups; else the next group is tried."""
    own = lambda groups, i, n: F.regexp_replace(F.array_join(F.slice(groups, i + 1, n), ""), "^[ -]", "")
    counts = lambda groups, i: F.reverse(F.sequence(F.lit(1), F.least(F.lit(most), F.size(groups) - i)))
    tried = lambda groups, i: F.transform(counts(groups, i), lambda n: F.struct(own(groups, i, n).alias("v"), n.alias("n")))
    longest = lambda groups, i: F.get(F.filter(tried(groups, i), lambda c: valid(c.v, run)), F.lit(0))
    lead = lambda g: F.regexp_extract(g, "^[ -]?", 0)
    begin = F.struct(F.array().cast(PIECES).alias("done"), F.lit(0).alias("skip"))

    def step(acc: Column, c: Column) -> Column:
        hit = F.struct(F.concat(acc.done, F.array(_piece(lead(c.g)), _piece(c.best.v, kind))).alias("done"), (c.best.n - 1).alias("skip"))
        passed = F.struct(acc.done.alias("done"), (acc.skip - 1).alias("skip"))
        plain = F.struct(F.concat(acc.done, F.array(_piece(c.g))).alias("done"), F.lit(0).alias("skip"))
        return F.when(acc.skip > 0, passed).when(c.best.isNotNull(), hit).otherwise(plain)

    found = _bound(F.regexp_extract_all(run, F.lit(group), F.lit(0)), lambda groups: F.transform(groups, lambda g, i: F.struct(g.alias("g"), longest(groups, i).alias("best"))))
    return F.aggregate(found, begin, step, lambda acc: acc.done)


def _cards(run: Column) -> Column:
    """A run that is a card as a whole; else cards of a known issuer at an end of the run, then within it, then any others in what is left."""
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    card = lambda v: v.rlike("[0-9]$") & F.length(digits(v)).between(13, 19) & (_luhn(digits(v)) % 10 == 0)
    issued = lambda v: digits(v).rlike(ISSUED)
    out = F.array(_piece(run))
    for wanted in (lambda v, run: (v == run) | (issued(v) & (run.startswith(v) | run.endswith(v))), lambda v, run: issued(v), lambda v, run: F.lit(True)):
        out = _merged(F.flatten(F.transform(out, _searcher(lambda v, run, wanted=wanted: wanted(v, run) & card(v)))))
    return out


def _searcher(valid):
    return lambda p: F.when(p.k == "", _in_run(p.v, "card", r"[ -]?\d+|[ -]", 19, valid)).otherwise(F.array(p))


def _ibans(run: Column) -> Column:
    plain = lambda v: F.replace(v, F.lit(" "))
    valid = lambda v, run: v.rlike("^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}$") & (_mod97(F.concat(F.substring(plain(v), F.lit(5), F.length(v)), F.substring(v, 1, 4))) == 1)
    return _in_run(run, "iban", " ?[A-Z0-9]+", 34, valid)


def _found(hit: Column, kind: str) -> Column:
    """Pieces of a candidate; those that aren't valid have no kind."""
    if kind == "card":
        return _cards(hit)
    if kind == "iban":
        return _ibans(hit)
    valid = {
        "date": _real_date(hit),
        "ssn": ~hit.rlike("^(000|666|9)|-00-|-0000$"),
    }.get(kind, F.lit(True))
    return F.array(F.struct(hit.alias("v"), F.when(valid, F.lit(kind)).otherwise(F.lit("")).alias("k")))


def _cutter(kind: str, pattern: str):
    def cut(p: Column) -> Column:
        found = lambda g, h: F.concat(F.array(_piece(g)), F.when(h.isNull(), F.array().cast(PIECES)).otherwise(_found(h, kind)))
        parts = F.zip_with(F.split(p.v, pattern, -1), F.regexp_extract_all(p.v, F.lit(pattern), F.lit(0)), found)
        return F.when((p.k == "") & p.v.rlike(pattern), _merged(F.flatten(parts))).otherwise(F.array(p))

    return cut


def pieces_of(text: Column) -> Column:
    """The text cut into pieces of a kind and the pieces between (kind ''). Each kind searches what the kinds before it have left whole, so that a
    candidate that turns out invalid hides no value of another kind; the pieces joined give the text."""
    out = F.array(_piece(text)).cast(PIECES)
    for kind, pattern in PASSES:
        out = F.flatten(F.transform(out, _cutter(kind, pattern)))
    return out


def pseudonym(v: Column, kind: Column, key: str) -> Column:
    made = {"email": _email(v, key), "iban": _iban(v, key), "ip": _ip(v, key), "date": _date(v, key), "ssn": _ssn(v, key), "phone": _phone(v, key), "card": _card(v, key)}
    out = F.when(kind == "", v)
    for name, value in made.items():
        out = out.when(kind == name, value)
    return out.otherwise(v)


COUNTED = tuple(PATTERNS)


def pseudonymize(documents: DataFrame, key: str, text: str = "text", counts: bool = True) -> DataFrame:
    """All columns of documents with the text column rewritten; with counts, also n_<kind> for each kind and n_pii (long).

    Whoever has the key can undo the pseudonyms, so it is the caller's secret. Null texts stay null with counts 0; empty texts and texts without
    personal data stay as they are. Equal values get equal pseudonyms in every row, so repeated rows stay equal. An empty table gives an empty
    result. Columns of the input that are named as a count are replaced; all others stay, whatever their names.
    """
    t, some, pieces = F.col(text), free_name("_any", documents), free_name("_pieces", documents)
    cut = documents.withColumn(some, t.rlike(ANY))
    # one-element explodes keep arrays from being computed once per use
    named = cut.withColumn(pieces, F.explode(F.array(F.when(F.col(some), pieces_of(t)))))
    out = named.withColumn(text, F.when(F.col(pieces).isNull(), t).otherwise(F.array_join(F.transform(pieces, lambda p: pseudonym(p.v, p.k, key)), "")))
    if counts:
        of_kind = lambda name: lambda p: p.k == name
        n = {f"n_{name}": F.when(F.col(pieces).isNull(), F.lit(0)).otherwise(F.size(F.filter(pieces, of_kind(name)))).cast("long") for name in COUNTED}
        out = out.withColumns(n).withColumn("n_pii", sum((F.col(k) for k in list(n)[1:]), F.col(next(iter(n)))))
    return out.drop(some, pieces)
