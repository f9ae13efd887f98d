"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Candidates are found by one pattern, validated (Luhn for cards, mod 97 for IBANs, the calendar for dates, octets for
IPv4, issued ranges for social security numbers, length and grouping for phones) and replaced by a keyed permutation of
their own domain, so a value has one pseudonym in all documents and two values never share one:

* cards: the digits before the check digit are permuted, the check digit is made anew; grouping stays;
* phones: the ten national digits, or those after the country code of an international form; the rest and grouping stay;
* IBANs: the digits after the check digits (letters stay), check digits made anew;
* dates of 1700-01-01 to 2099-12-31: the day number among 146,097 days; layout stays. Two digits, two digits, year is read
  day first if that is a date, else month first; month-first dates (days above 12) are permuted among themselves;
* IPv4 addresses: the 32 bits; social security numbers: the issued numbers;
* e-mail addresses: no fixed format to keep, so a keyed digest names the mailbox, under a reserved domain.

The permutation is an alternating Feistel network on pairs (x mod a, y mod b) with SHA-256 as round function; both moduli
may be any number, so no cycle walking is needed. Of a candidate that fails, the longest valid part is taken
(cards between separators, IBANs from their start). What has none stays as it is. Documents are not shuffled.

A null text stays null with n_found 0; empty texts stay empty. An empty table gives no rows. Repeated rows and equal values give equal results. Input
columns of any name stay in ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

ROUNDS = 8
DAYS = 146_097
EPOCH = "1700-01-01"

# Candidate patterns, first match wins.
_START, _STOP = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
_GROUPED = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
_INTERNATIONAL = r"\+[1-9][0-9]{0,14}+(?:[ .-]?\([0-9]{1,12}+\)[ .-]?[0-9]{1,12}+|[ .-][0-9]{1,12}+){0,6}"
_BARE = r"(?!37|96|[2-9](?:9|11))[2-9][0-9]{9}"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "iban": _START + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _STOP,
    "date": _START + r"(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})" + _STOP,
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "ssn": _START + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _STOP,
    "phone": r"(?<![0-9A-Za-z+])(?:" + _GROUPED + "|" + _INTERNATIONAL + "|" + _BARE + ")" + _STOP,
    "card": _START + r"[0-9](?:[ -]?[0-9]){12,18}" + _STOP,
}
ANY = "|".join(PATTERNS.values()).replace(r"\2", r"\2")
SHAPES = {
    "email": "@", "iban": "^[A-Z]{2}", "date": r"^(?:[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}|[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4})$",
    "ip": r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$", "ssn": "^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "phone": "^" + _GROUPED + r"$|^\+|^" + _BARE + "$", "card": "",
}


def _big(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("bigint")


def feistel(x: Column, y: Column, a, b, key: str, tag) -> Column:
    """Permute (x, y) of Z_a x Z_b; struct of ``x`` and ``y``."""
    a, b = _big(a), _big(b)
    tag = tag if isinstance(tag, Column) else F.lit(tag)

    def mix(number: Column, half: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tag, number.cast("string"), half.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")

    def turn(state: Column, number: Column) -> Column:
        even = F.struct(F.pmod(state.x + mix(number, state.y), a).alias("x"), state.y.alias("y"))
        odd = F.struct(state.x.alias("x"), F.pmod(state.y + mix(number, state.x), b).alias("y"))
        return F.when(number % 2 == 0, even).otherwise(odd)

    start = F.struct(_big(x).alias("x"), _big(y).alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _padded(number: Column, size: Column) -> Column:
    return F.lpad(number.cast("string"), size, "0")


def permute_digits(digits: Column, key: str, tag: str) -> Column:
    """Keyed permutation of the digit strings of one length (2 to 36 digits)."""
    size = F.length(digits)
    left = (size / 2).cast("int")
    right = size - left
    power = lambda n: F.pow(F.lit(10.0), n).cast("bigint")
    mixed = feistel(F.substring(digits, F.lit(1), left), F.substring(digits, left + 1, right), power(left), power(right), key,
                    F.concat(F.lit(tag), size.cast("string")))
    return F.aggregate(F.array(mixed), F.lit(""), lambda s, m: F.concat(s, _padded(m.x, left), _padded(m.y, right)))


def refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced one by one."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def put(state, char):
        return F.when(char.rlike("^[0-9]$"), F.struct((state.at + 1).alias("at"), F.concat(
            state.out, F.substring(digits, state.at, F.lit(1))).alias("out"))).otherwise(
            F.struct(state.at.alias("at"), F.concat(state.out, char).alias("out")))

    return F.aggregate(F.split(shape, ""), start, put).out


def luhn_sum(digits: Column, double_last: bool) -> Column:
    """Luhn sum; ``double_last`` if a check digit is still to follow."""
    size = F.length(digits)

    def add(total, k):
        digit = F.substring(digits, k, F.lit(1)).cast("int")
        twice = (size - k) % 2 == (0 if double_last else 1)
        return total + F.when(twice, digit * 2 - F.when(digit > 4, 9).otherwise(0)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add)


def _longest(m: Column, starts: Column, good, make, least: int, separators: str = " -") -> Column:
    """``m`` with its longest part that ``good`` accepts (a number, 0 for no; larger ones first) replaced by ``make``; null
    without one. Parts start at one of ``starts``, end before a separator or at the end and have ``least`` characters."""
    size = F.length(m)
    ends = F.filter(F.sequence(F.lit(1), size), lambda k: (k == size) | F.substring(m, k + 1, F.lit(1)).isin(*separators))
    spans = F.transform(F.array(ends), lambda known: F.flatten(F.transform(starts, lambda a: F.transform(
        F.filter(known, lambda b: b - a >= least - 1), lambda b: F.struct(a.alias("a"), F.substring(m, a, b - a + 1).alias("part"))))))
    parts = F.transform(spans[0], lambda x: F.struct(
        good(x.part).alias("rank"), F.length(x.part).alias("size"), (-x.a).alias("back"), x.part.alias("part")))
    best = F.array(F.array_max(F.filter(parts, lambda x: x.rank > 0)))
    return F.aggregate(best, F.lit(None).cast("string"), lambda _, x: F.concat(
        F.substring(m, F.lit(1), -x.back - 1), make(x.part), F.substring(m, x.size - x.back, size)))


def _card(m: Column, key: str) -> Column:
    def good(part):
        digits = F.regexp_replace(part, "[^0-9]", "")
        return F.when(part.rlike("^[0-9](?:[ -]?[0-9]){12,18}$"), (luhn_sum(digits, False) % 10 == 0).cast("int")).otherwise(0)

    def make(part):
        digits = F.regexp_replace(part, "[^0-9]", "")
        body = F.substring(digits, F.lit(1), F.length(digits) - 1)
        fresh = F.aggregate(F.array(permute_digits(body, key, "card")), F.lit(""), lambda _, d: F.concat(
            d, F.pmod(F.lit(10) - luhn_sum(d, True) % 10, F.lit(10)).cast("string")))
        return refill(part, fresh)

    starts = F.filter(F.sequence(F.lit(1), F.length(m)), lambda k: (k == 1) | F.substring(m, k - 1, F.lit(1)).isin(" ", "-"))
    return _longest(m, starts, good, make, 13)


TWO_DIGIT_LANDS = "^(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
"""Country codes of two digits; 1 and 7 have one, the others three."""


def _phone(m: Column, key: str) -> Column:
    def good(part):
        return F.length(F.regexp_replace(part, "[^0-9]", "")).between(8, 15).cast("int")

    return _longest(m, F.array(F.lit(1)), good, lambda part: _whole_phone(part, key), 8, " .-")


def _whole_phone(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    land = F.when(digits.rlike("^[17]"), 1).when(digits.rlike(TWO_DIGIT_LANDS), 2).otherwise(3)
    national = F.when(m.rlike("^" + _GROUPED + "$") | ~m.startswith("+"), 10).otherwise(F.length(digits) - land)
    body = F.right(digits, national)
    head = F.substring(digits, F.lit(1), F.length(digits) - national)
    return refill(m, F.concat(head, permute_digits(body, key, "phone")))


def _mod97(text: Column) -> Column:
    """Remainder of an IBAN's moved form, letters as 10 to 35."""
    def add(total, char):
        code = F.ascii(char)
        digit = code <= 57
        value = F.when(digit, code - 48).otherwise(code - 55)
        return (total * F.when(digit, 10).otherwise(100) + value) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), add)


IBAN_SIZES = {15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
              22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT",
              26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT"}


def _whole_iban(m: Column, key: str) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    land, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain) - 4)
    digits = F.regexp_replace(body, "[^0-9]", "")
    mixed = refill(body, F.when(F.length(digits) > 1, permute_digits(digits, key, "iban")).otherwise(digits))

    def named(_, fresh):
        check = F.lpad((F.lit(98) - _mod97(F.concat(fresh, land, F.lit("00")))).cast("string"), 2, "0")
        return F.concat(check, F.regexp_replace(fresh, "[^0-9]", ""))

    fresh = F.aggregate(F.array(mixed), F.lit(""), named)
    return refill(m, fresh)


def _iban(m: Column, key: str) -> Column:
    def good(part):  # the length of the country first
        plain = F.replace(part, F.lit(" "), F.lit(""))
        valid = _mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1
        usual = F.lit(False)
        for size, lands in IBAN_SIZES.items():
            usual = usual | ((F.length(plain) == size) & F.substring(plain, 1, 2).isin(*lands.split()))
        return F.when((F.length(plain) >= 12) & valid, F.when(usual, 2).otherwise(1)).otherwise(0)

    return _longest(m, F.array(F.lit(1)), good, lambda part: _whole_iban(part, key), 12)


LATE_DAYS = (9, 9833)
"""The 88,497 days after the 12th of a month in 400 years, as a product."""


def _late_day(day: Column, number: Column, key: str) -> Column:
    """A date after the 12th, permuted among all such dates: they are numbered by leaving out 12 days a month."""
    months = 12 * (F.year(day) - int(EPOCH[:4])) + F.month(day)
    rank = number - 12 * months
    a, b = LATE_DAYS
    mixed = feistel(F.floor(rank / b), rank % b, a, b, key, "date-mdy")

    def dated(_, p):
        place = p.x * b + p.y
        near = F.floor(place * 4800 / (a * b)).cast("int")  # the month, give or take a few

        def found(month):
            first = F.make_date(F.lit(int(EPOCH[:4])) + F.floor(month / 12).cast("int"), (month % 12 + 1).cast("int"), F.lit(1))
            return F.date_add(first, (place - F.date_diff(first, F.lit(EPOCH).cast("date")) + 12 * month + 12).cast("int"))

        months = F.sequence(F.greatest(F.lit(0), near - 3), F.least(F.lit(4799), near + 3))
        return F.element_at(F.filter(F.transform(months, lambda k: F.struct(k.alias("k"), found(k).alias("d"))), lambda x: (
            F.year(x.d) * 12 + F.month(x.d) - 1 == int(EPOCH[:4]) * 12 + x.k) & (F.dayofmonth(x.d) > 12)), 1).d

    return F.aggregate(F.array(mixed), F.lit(None).cast("date"), dated)


def _date(m: Column, key: str) -> Column:
    first = m.rlike("^[0-9]{4}")
    digits = F.regexp_replace(m, "[^0-9]", "")
    year = F.when(first, F.substring(digits, 1, 4)).otherwise(F.substring(digits, 5, 4))
    one = F.when(first, F.substring(digits, 5, 2)).otherwise(F.substring(digits, 3, 2))
    two = F.when(first, F.substring(digits, 7, 2)).otherwise(F.substring(digits, 1, 2))
    usual = F.to_date(F.try_to_timestamp(F.concat_ws("-", year, one, two), F.lit("yyyy-MM-dd")))
    other = F.when(~first, F.to_date(F.try_to_timestamp(F.concat_ws("-", year, two, one), F.lit("yyyy-MM-dd"))))
    found = F.array(F.struct(F.coalesce(usual, other).alias("d"), usual.isNull().alias("swapped")))

    def shift(_, f):
        number = F.date_diff(f.d, F.lit(EPOCH).cast("date"))
        mixed = feistel(F.floor(number / 773), number % 773, 189, 773, key, "date")
        fresh = F.aggregate(F.array(mixed), F.lit(None).cast("date"),
                            lambda _, p: F.date_add(F.lit(EPOCH).cast("date"), (p.x * 773 + p.y).cast("int")))
        layout = F.when(first, F.date_format(fresh, "yyyyMMdd")).when(f.swapped, F.date_format(_late_day(f.d, number, key), "MMddyyyy")) \
            .otherwise(F.date_format(fresh, "ddMMyyyy"))
        return F.when((number >= 0) & (number < DAYS), refill(m, layout))

    return F.aggregate(found, F.lit(None).cast("string"), shift)


def _ip(m: Column, key: str) -> Column:
    part = lambda k: F.split_part(m, F.lit("."), F.lit(k)).cast("int")
    octets = [part(k) for k in (1, 2, 3, 4)]
    mixed = feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], 65536, 65536, key, "ip")
    fresh = F.aggregate(F.array(mixed), F.lit(""), lambda _, p: F.concat_ws(
        ".", *[(F.floor(v / 256) if high else v % 256).cast("string") for v in (p.x, p.y) for high in (True, False)]))
    valid = octets[0] <= 255
    for octet in octets[1:]:
        valid = valid & (octet <= 255)
    return F.when(valid, fresh)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, at, n).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    number = area - 1 - F.when(area > 666, 1).otherwise(0)  # 898 areas: 001 to 899 without 666
    mixed = feistel(number * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")

    def spell(_, p):
        fresh = F.floor(p.x / 99) + 1
        return F.concat_ws("-", F.lpad((fresh + F.when(fresh >= 666, 1).otherwise(0)).cast("string"), 3, "0"),
                           F.lpad((p.x % 99 + 1).cast("string"), 2, "0"), F.lpad((p.y + 1).cast("string"), 4, "0"))

    valid = (area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1)
    return F.when(valid, F.aggregate(F.array(mixed), F.lit(""), spell))


def _email(m: Column, key: str) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256)
    return F.concat(F.lit("u"), F.substring(digest, 1, 20), F.lit("@example.invalid"))


MAKERS = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonymize(docs: DataFrame, key: str, keep: list[str] | None = None) -> DataFrame:
    """Columns ``row`` (input columns, or ``keep``), ``text``, ``n_found`` and ``kinds`` (sorted, comma-joined)."""
    text = F.col("text").cast("string")
    kept = F.struct(*[F.col(quoted(c)) for c in (docs.columns if keep is None else keep)]).alias("row")
    some = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    rows = docs.select(kept, text.alias("text"), some.alias("hits"))

    def replaced(m: Column) -> Column:
        kind = F.lit(None).cast("string")
        value = F.lit(None).cast("string")
        for name in reversed(SHAPES):
            shaped = m.rlike(SHAPES[name]) if SHAPES[name] else F.lit(True)
            kind = F.when(shaped, F.lit(name)).otherwise(kind)
            value = F.when(shaped, MAKERS[name](m, key)).otherwise(value)
        return F.struct(m.alias("old"), value.alias("new"), kind.alias("kind"))

    rows = rows.withColumn("found", F.when(F.size("hits") > 0, F.transform("hits", replaced)))
    gaps = F.split("text", ANY, -1)
    mended = F.concat(F.array_join(F.zip_with(
        F.slice(gaps, F.lit(1), F.size("found")), F.col("found"),
        lambda gap, f: F.concat(gap, F.coalesce(f.new, f.old))), ""), F.element_at(gaps, -1))
    good = F.filter("found", lambda f: f.new.isNotNull())
    return rows.select(
        "row", F.when(F.size("found") > 0, mended).otherwise(F.col("text")).alias("text"),
        F.coalesce(F.when(F.size("found") > 0, F.size(good)), F.lit(0)).cast("bigint").alias("n_found"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(good, lambda f: f.kind))), ","), F.lit("")).alias("kinds"))
