"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Candidates are found by one pattern and validated by kind. A valid value is permuted within its format: every
digit stays a digit and every letter a letter of its case, check digits are made anew, addresses and dates stay
valid ones. The permutation depends on the key and the kind alone, so equal values have equal pseudonyms in
all documents, and different values of one layout different ones. A text is split at its candidates and put together again,
row by row: no shuffle, and no code outside DataFrame expressions.

Kinds: e-mail addresses (the part before the at sign), IPv4 addresses, dates from 1800 to 2199 (three layouts,
day before month where both are possible; days and months with or without a leading zero are layouts of their own), IPv6 addresses of eight groups, payment card numbers (13 to 19 digits with a right check digit),
bank account numbers (IBAN with right check digits), social security numbers, telephone numbers with an area
code or, in groups of any size, behind a country code (which stays), and credentials: access key ids, 32 to 64 hexadecimal digits in either case, and what
follows ``password=``.

Defined cases: a null text stays null with no pseudonyms; an empty text stays; repeated rows get equal results,
and there are no ties, as candidates don't overlap (the first from the left stands); an empty table gives no
rows; all columns of the input stay, whatever their names; a long text is read whole, in one row's expression.
"""

from __future__ import annotations

import calendar
import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import free_name

ROUNDS = 8
# One alternative for each kind; inner groups but the separator's capture nothing.
_BEFORE, _AFTER = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
#: Symbols of an IBAN by country (IBAN registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(f"(?:{names.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + f" ?[A-Z0-9]{{{n % 4}}}" * (n % 4 > 0) for n, names in IBAN_LENGTHS.items())
# other codes and lengths: as far as it can reach, but not into an IBAN of the registry
_LONGEST = rf"[A-Z]{{2}}[0-9]{{2}}(?:(?! (?:{_IBAN}){_AFTER}) ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?"
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "password": r"(?<=password[=:])[A-Za-z0-9]{6,128}+",
    "access_key": _BEFORE + r"AKIA[A-Z0-9]{16}" + _AFTER,
    "hex": _BEFORE + r"[0-9A-Fa-f]{32,64}+" + _AFTER,
    "iban": _BEFORE + f"(?:(?:{_IBAN}){_AFTER}|{_LONGEST})" + _AFTER,
    "ip": r"(?<![A-Za-z0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9]|\.[0-9])",
    "ip6": r"(?<![A-Za-z0-9:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![A-Za-z0-9:])",
    "date": r"(?<![A-Za-z0-9./\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![A-Za-z0-9]|[./\-][0-9])",
    "ssn": _BEFORE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9]|-[0-9])",
    "phone": r"(?<![A-Za-z0-9+])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}" + _AFTER,
    "abroad": r"(?<![A-Za-z0-9+])\+[1-9][0-9]{0,2}(?:[ .\-]?\([0-9]{1,4}\)|[ .\-][0-9]{1,5})(?:[ .\-][0-9]{2,8}){1,4}" + _AFTER,
    "card": _BEFORE + r"(?:[0-9]{13,19}+|[0-9]{4}([ \-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})" + _AFTER,
}
PATTERN = "|".join(KINDS.values())
#: No kind does without one of these characters, but access keys and passwords.
MAY_HOLD = r"[0-9@]|AKIA|password[=:]"
# Dates are those of 400 years, 97 of them leap years.
_FIRST_YEAR, _LEAPS = 1800, 97


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _each(n: Column, make) -> Column:
    """The joined results of ``make`` for 1 to n."""
    return F.when(n < 1, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), make), ""))


def _digest(key: str, kind: str, turn: Column, rest: Column) -> Column:
    """A keyed digest: SHA-512 of the key and the SHA-512 of the key and the message."""
    message = F.concat(F.lit(f"{key}|{kind}|"), turn.cast("string"), F.lit("|"), rest)
    return F.sha2(F.concat(F.lit(f"{key}|"), F.sha2(message, 512)), 512)


def _moved(char: Column, by: Column, letters: int) -> Column:
    ring = lambda first, size: F.char(F.lit(ord(first)) + (F.ascii(char) - ord(first) + by) % size)
    return F.when(char.between("0", "9"), ring("0", 10)).when(char.between("a", "z"), ring("a", letters)).otherwise(ring("A", letters))


def _permuted(symbols: Column, kind: str, key: str, letters: int = 26) -> Column:
    """A permutation of the strings with the same classes of letters and digits."""

    def added(half: Column, other: Column, turn: Column) -> Column:
        byte = lambda d, i: F.conv(F.substring(d, (2 * F.pmod(i - 1, F.lit(64)) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
        return _let(_digest(key, kind, turn, other), lambda d: _each(F.length(half), lambda i: _moved(F.substring(half, i, F.lit(1)), byte(d, i), letters)))

    def step(acc: Column, turn: Column) -> Column:
        even = turn % 2 == 0
        return F.struct(F.when(even, added(acc["a"], acc["b"], turn)).otherwise(acc["a"]).alias("a"), F.when(even, acc["b"]).otherwise(added(acc["b"], acc["a"], turn)).alias("b"))

    def run(x: Column) -> Column:
        half = (F.length(x) / 2).cast("int")
        start = F.struct(F.substring(x, F.lit(1), half).alias("a"), F.substring(x, half + 1, F.length(x)).alias("b"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.concat(acc["a"], acc["b"]))

    return _let(symbols, run)


def _permuted_pair(high: Column, low: Column, sizes: tuple[int, int], kind: str, key: str) -> Column:
    """The same for a pair of numbers below two sizes."""
    number = lambda turn, other: F.conv(F.substring(_digest(key, kind, turn, other.cast("string")), 1, 12), 16, 10).cast("long")

    def step(acc: Column, turn: Column) -> Column:
        even = turn % 2 == 0
        a = F.when(even, (acc["a"] + number(turn, acc["b"])) % sizes[0]).otherwise(acc["a"])
        b = F.when(even, acc["b"]).otherwise((acc["b"] + number(turn, acc["a"])) % sizes[1])
        return F.struct(a.alias("a"), b.alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(high.cast("long").alias("a"), low.cast("long").alias("b")), step)


def _symbols(value: Column) -> Column:
    return F.regexp_replace(value, "[^A-Za-z0-9]", "")


def _laid_out(value: Column, symbols: Column) -> Column:
    """The symbols at the places of the letters and digits of a value."""

    def at(i: Column) -> Column:
        char = F.substring(value, i, F.lit(1))
        return F.when(char.rlike("[A-Za-z0-9]"), F.substring(symbols, F.length(_symbols(F.substring(value, F.lit(1), i))), F.lit(1))).otherwise(char)

    return _each(F.length(value), at)


def _luhn_digit(payload: Column) -> Column:
    """The check digit that follows the payload."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(payload, (F.length(payload) - i + 1).cast("int"), F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, 2 * digit - F.when(digit > 4, 9).otherwise(0)).otherwise(digit)

    return ((10 - F.aggregate(F.sequence(F.lit(1), F.length(payload)), F.lit(0), add) % 10) % 10).cast("string")


def _mod97(symbols: Column) -> Column:
    def add(rest: Column, i: Column) -> Column:
        char = F.substring(symbols, i, F.lit(1))
        return F.when(char.between("0", "9"), (rest * 10 + F.ascii(char) - 48) % 97).otherwise((rest * 100 + F.ascii(char) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(symbols)), F.lit(0), add)


def _email(v: Column, key: str) -> Column:
    local = F.substring_index(v, "@", 1)
    return F.concat(_laid_out(local, _permuted(_symbols(local), "email", key)), F.lit("@"), F.substring_index(v, "@", -1))


def _ip(v: Column, key: str) -> Column:
    def made(parts: Column) -> Column:
        pair = _permuted_pair(parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], (65536, 65536), "ip", key)
        put = lambda p: F.concat_ws(".", *[x.cast("int").cast("string") for h in (p["a"], p["b"]) for x in ((h - h % 256) / 256, h % 256)])
        return F.when(~F.exists(parts, lambda x: x > 255), _let(pair, put)).otherwise(v)

    return _let(F.transform(F.split(v, r"\."), lambda x: x.cast("int")), made)


@dataclass(frozen=True)
class _Dates:
    """The dates of 400 years with a day from ``low`` to ``high`` in the first ``months`` months, in order, as one range of ranks."""

    kind: str
    months: int
    low: int
    high: int

    def before(self, leap: bool) -> list[int]:
        """How many dates of a year stand before each month, and how many there are."""
        days = [calendar.monthrange(2000 if leap else 2001, m)[1] for m in range(1, self.months + 1)]
        return list(itertools.accumulate((min(self.high, d) - self.low + 1 for d in days), initial=0))

    @property
    def size(self) -> int:
        return 400 * self.before(False)[-1] + _LEAPS * (self.before(True)[-1] - self.before(False)[-1])

    @property
    def sides(self) -> tuple[int, int]:
        """Two sizes of about the same order whose product exceeds ``size`` by as little as can be."""
        root = math.isqrt(self.size)
        return min(((h, -(-self.size // h)) for h in range(root, root // 4, -1)), key=lambda s: (s[0] * s[1] - self.size, -s[0]))

    def first(self, year: Column) -> Column:
        """The rank of a year's first date."""
        leaps = lambda y: F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400)
        common, more = self.before(False)[-1], self.before(True)[-1] - self.before(False)[-1]
        return (year - _FIRST_YEAR) * common + more * (leaps(year - 1) - leaps(F.lit(_FIRST_YEAR - 1)))

    def _table(self, year: Column) -> Column:
        leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
        return F.when(leap, F.array(*map(F.lit, self.before(True)))).otherwise(F.array(*map(F.lit, self.before(False))))

    def rank(self, year: Column, month: Column, day: Column) -> Column:
        return self.first(year) + F.get(self._table(year), month - 1) + day - self.low

    def date(self, rank: Column) -> Column:
        """year, month, day of a rank."""

        def within(year: Column) -> Column:
            left = rank - self.first(year)
            month = F.size(F.filter(F.slice(self._table(year), 1, self.months), lambda n: n <= left))
            return F.struct(year.alias("year"), month.alias("month"), (left - F.get(self._table(year), month - 1) + self.low).alias("day"))

        about = _FIRST_YEAR + F.floor(rank * 400 / self.size).cast("long")
        return _let(_let(about, lambda y: y - F.when(self.first(y) > rank, 1).otherwise(0) + F.when(self.first(y + 1) <= rank, 1).otherwise(0)), within)

    def permuted(self, rank: Column, key: str) -> Column:
        """A Feistel network over the sides, taken again while it leaves the range: its cycles come back to it."""
        high, low = self.sides
        once = lambda n: _let(_permuted_pair((n - n % low) / low, n % low, (high, low), self.kind, key), lambda q: q["a"] * low + q["b"])
        most = high * low - self.size
        return once(rank) if not most else F.aggregate(F.sequence(F.lit(1), F.lit(most)), once(rank), lambda n, _: F.when(n < self.size, n).otherwise(once(n)))


_ALL_DAYS = _Dates("date", 12, 1, 31)


def _date(v: Column, key: str) -> Column:
    """Each layout is permuted by itself: the digits of day and month, and dates that only a month-first reading makes valid."""

    def made(p: Column) -> Column:
        text = lambda y, m, d: F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")
        sep = F.when(F.contains(v, F.lit("/")), "/").otherwise(".")
        year, a, b = (F.when(F.length(p[0]) == 4, p[i]).otherwise(p[j]).cast("long") for i, j in ((0, 2), (1, 0), (2, 1)))
        short = (F.length(p[0]) == 1, F.length(p[1]) == 1)

        def shown(dates: _Dates, month_first: bool, put) -> Column:
            month, day = (a, b) if month_first else (b, a)
            return _let(dates.permuted(dates.rank(year, month, day), key), lambda n: _let(dates.date(n), put))

        two = lambda x: F.lpad(x.cast("string"), 2, "0")
        four = lambda x: F.lpad(x.cast("string"), 4, "0")

        def layout(first: str, second: str, one: bool, other: bool):
            put = lambda q, name, narrow: q[name].cast("string") if narrow else two(q[name])
            return lambda q: F.concat(put(q, first, one), sep, put(q, second, other), sep, four(q["year"]))

        iso = F.length(p[0]) == 4
        known = F.when(iso, text(p[0], p[1], p[2]).isNotNull()).otherwise(text(p[2], p[1], p[0]).isNotNull() | text(p[2], p[0], p[1]).isNotNull())
        out = F.when(~known | ~year.between(_FIRST_YEAR, _FIRST_YEAR + 399), v).when(iso, shown(_ALL_DAYS, True, lambda q: F.concat_ws("-", four(q["year"]), two(q["month"]), two(q["day"]))))
        day_first = text(p[2], p[1], p[0]).isNotNull()
        for one, other, dates in ((False, False, _ALL_DAYS), (True, False, _Dates("date12", 12, 1, 9)), (False, True, _Dates("date21", 9, 1, 31)), (True, True, _Dates("date11", 9, 1, 9))):
            out = out.when(day_first & (short[0] == one) & (short[1] == other), shown(dates, False, layout("day", "month", one, other)))
        late = _Dates("late22", 12, 13, 31), _Dates("late12", 9, 13, 31)
        return out.when(short[0], shown(late[1], True, layout("month", "day", True, False))).otherwise(shown(late[0], True, layout("month", "day", False, False)))

    return _let(F.split(v, r"[./\-]"), made)


def _card(v: Column, key: str) -> Column:
    def made(s: Column) -> Column:
        payload = F.substring(s, F.lit(1), F.length(s) - 1)
        right = _luhn_digit(payload) == F.substring(s, F.length(s), F.lit(1))
        new = _let(_permuted(payload, "card", key), lambda p: F.concat(p, _luhn_digit(p)))
        return F.when(right & F.length(s).between(13, 19), _laid_out(v, new)).otherwise(v)

    return _let(_symbols(v), made)


def _iban(v: Column, key: str) -> Column:
    """The longest valid beginning that ends at a space is the number; words behind it stay."""
    body = lambda s: F.substring(s, F.lit(5), F.length(s))
    head = lambda i: F.substring(v, F.lit(1), i)
    right = lambda s: F.length(s).between(15, 34) & (_mod97(F.concat(body(s), F.substring(s, 1, 4))) == 1)

    def made(s: Column) -> Column:
        country = F.substring(s, 1, 2)
        check = lambda b: F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
        return _let(_permuted(body(s), "iban", key), lambda b: F.concat(country, check(b), b))

    def put(end: Column) -> Column:
        new = _let(head(end), lambda h: _laid_out(h, made(_symbols(h))))
        return F.when(end.isNotNull(), F.concat(new, F.substring(v, end + 1, F.length(v)))).otherwise(v)

    ends = F.sequence(F.greatest(F.length(v), F.lit(15)), F.lit(15), F.lit(-1))
    valid = lambda i: F.substring(v, i + 1, F.lit(1)).isin("", " ") & _let(_symbols(head(i)), right)
    return _let(F.get(F.filter(ends, valid), F.lit(0)), put)


def _ssn(v: Column, key: str) -> Column:
    right = ~v.rlike("^(000|666|9)") & ~F.substring(v, 5, 2).isin("00") & ~F.substring(v, 8, 4).isin("0000")
    return F.when(right, _laid_out(v, _permuted(_symbols(v), "ssn", key))).otherwise(v)


def _phone(v: Column, key: str) -> Column:
    country = F.regexp_extract(v, r"^\+[0-9]{1,3}[ .\-]?(?=[(0-9])", 0)
    rest = F.substring(v, F.length(country) + 1, F.length(v))
    return F.concat(country, _let(rest, lambda r: _laid_out(r, _permuted(_symbols(r), "phone", key))))


def _abroad(v: Column, key: str) -> Column:
    """The country code stays; numbers of less than 7 or more than 14 digits behind it are none."""
    country = F.regexp_extract(v, r"^\+[0-9]{1,3}", 0)
    rest = F.substring(v, F.length(country) + 1, F.length(v))
    return F.when(F.length(_symbols(rest)).between(7, 14), F.concat(country, _let(rest, lambda r: _laid_out(r, _permuted(_symbols(r), "abroad", key))))).otherwise(v)


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of a candidate; a candidate that is not valid stays as it is."""
    whole = lambda kind: value.rlike("^(?:" + KINDS[kind].replace("(?<=password[=:])", "") + ")$")
    out = F.when(F.contains(value, F.lit("@")), _email(value, key))
    out = out.when(whole("ip"), _ip(value, key)).when(whole("date"), _date(value, key)).when(whole("ssn"), _ssn(value, key)).when(whole("phone"), _phone(value, key))
    out = out.when(whole("ip6"), _laid_out(value, _permuted(_symbols(value), "ip6", key, 6))).when(whole("abroad"), _abroad(value, key))
    out = out.when(whole("card"), _card(value, key)).when(whole("access_key"), F.concat(F.lit("AKIA"), _permuted(F.substring(value, F.lit(5), F.lit(16)), "access_key", key)))
    # without the letters above f, hexadecimal digits stay such
    out = out.when(whole("hex"), _permuted(value, "hex", key, 6)).when(whole("iban"), _iban(value, key))
    return out.otherwise(_permuted(value, "password", key))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """docs with pseudonyms in a text column; ``count`` names a further column with how many were put in.

    A column of that name stays, and the count's gets underscores until its name is free.
    """
    found, new = free_name(docs, "_found"), free_name(docs, "_new")
    have = docs.select("*", F.when(F.col(text).rlike(MAY_HOLD), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).alias(found))
    have = have.withColumn(new, F.when(F.size(found) > 0, F.transform(found, lambda v: pseudonym(v, key))))
    joined = F.array_join(F.zip_with(F.split(text, PATTERN, -1), new, lambda part, put: F.concat(part, F.coalesce(put, F.lit("")))), "")
    out = have.withColumn(text, F.when(F.col(new).isNotNull(), joined).otherwise(F.col(text)))
    if count:
        changed = F.aggregate(F.zip_with(found, new, lambda a, b: (a != b).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
        out = out.withColumn(free_name(docs, count), F.coalesce(changed, F.lit(0).cast("long")))
    return out.drop(found, new)
