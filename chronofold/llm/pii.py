"""Format-preserving pseudonyms for personal data, by a keyed Feistel network in SQL functions.

Found are e-mail addresses, IPv4 addresses, telephone numbers, social security numbers, dates,
IBANs in capitals, account and card numbers of 13 to 19 digits, secrets of 32 to 64 hexadecimal digits
and keys with a vendor's prefix. A value that does not validate (octets over 255, no such day, no such
area number, an IBAN with wrong check digits) stays as it is; digits after a wrong IBAN's first four
characters are still read as groups, as below.

Digit groups joined by single blanks or hyphens are read from the left. A group of 13 to 19 digits
is a number by itself. Several groups are one only if their check digit is valid (Luhn): 4-4-4-4 and
4-6-5 digits anywhere among the groups, groups of other lengths from the first one on, as few of
them as validate. So a card keeps its pseudonym whatever digits stand next to it, and lists of years
and rows of a table stay as they are, but for the one in ten that validates by chance.

A value is read as a pair (a, b) of numbers below (p, q) and runs through ROUNDS rounds that add
a keyed hash of one half to the other half, modulo p or q in turn. That is a permutation of all p * q
values, so different values stay different, equal ones get the same pseudonym in every text, and
``restore`` with the same key is its inverse:

* telephone and account numbers: the halves of their digits; a telephone number keeps its country
  code, separators stay where they were, and a number with a valid check digit (Luhn) gets one;
* IPv4: the two upper and the two lower octets;
* social security numbers: (area, group and serial) over the valid ones;
* IBANs: the halves of the digits behind the check digits; country and letters stay, the check digits
  are valid again;
* dates: days of the 400 years from 1800 on, 146097 = 189 * 773, in the form they had. With slashes the
  month is first where that is a day; ``restore`` finds the day where its pseudonym reads alike, with
  or without the zeros in front.

A trunk zero in brackets, ``(0)``, or before a slash is no part of a telephone number and stays.

E-mail addresses, secrets and keys have no number to permute; they become keyed hashes of the same
kind, keys keep their prefix and length.

Null text stays null and has no finds. Text without finds comes back unchanged. Every row is treated
by itself, so repeated rows and other columns pass through. An input column of the name ``n_pii`` is
replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_EMAIL = r"[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){1,8}"
_IP = rf"(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d)"
_PHONE = (
    r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ ./-]?\d{2,4}){1,4}(?!\d)"
    r"|0\d{2,4}/\d{4,8}(?![\d/])"
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)"
)
_SSN = r"\d{3}-\d{2}-\d{4}(?![\d-])"
_DATE = (
    r"\d{4}-\d{2}-\d{2}(?![\d-])|\d{2}\.\d{2}\.\d{4}(?![\d])"
    r"|\d{4}/\d{2}/\d{2}(?![\d/])|\d{1,2}/\d{1,2}/\d{4}(?![\d/])"
)
_SECRET = r"(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![\p{L}\p{N}])"
#: Prefixes of vendors' keys and what follows them.
_VENDOR_KEYS = (
    ("AKIA", "[0-9A-Z]{16}"), ("ASIA", "[0-9A-Z]{16}"), ("AIza", "[0-9A-Za-z_-]{35}"),
    ("github_pat_", "[0-9A-Za-z_]{82}"), ("gh[oprsu]_", "[0-9A-Za-z]{36}"), ("glpat-", "[0-9A-Za-z_-]{20}"),
    ("sk-", "[0-9A-Za-z_-]{20,200}"), ("xox[abprs]-", "[0-9A-Za-z-]{10,200}"),
)
_KEY_PREFIX = "(?:" + "|".join(prefix for prefix, _ in _VENDOR_KEYS) + ")"
_KEY = "(?:" + "|".join(prefix + rest for prefix, rest in _VENDOR_KEYS) + r")(?![\p{L}\p{N}_-])"
#: Length of an IBAN by country.
_IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18,
    "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24,
    "XK": 20,
}


def _iban_pattern() -> str:
    """Country and check digits, then groups of four, blanks between them or not."""
    forms = []
    for n in sorted(set(_IBAN_LENGTHS.values())):
        countries = "|".join(c for c, length in _IBAN_LENGTHS.items() if length == n)
        whole, rest = divmod(n - 4, 4)
        last = rf" ?[0-9A-Z]{{{rest}}}" if rest else ""
        forms.append(rf"(?:{countries})\d\d(?: ?[0-9A-Z]{{4}}){{{whole}}}{last}")
    return "(?:" + "|".join(forms) + r")(?![\p{L}\p{N}])"


_IBAN = _iban_pattern()

#: A value begins where no letter, digit or joining sign stands before it.
_NAMED = (
    r"(?<![\p{L}\p{N}._%+@-])(?:" + "|".join((_EMAIL, _KEY, _IBAN, _SECRET, _IP, _DATE, _SSN)) + ")"
    rf"|(?<![\p{{L}}\p{{N}}+])(?:{_PHONE})"
)
#: Digit groups of 13 digits or more up to where another value begins, taken apart by ``_cards``.
_GROUPS = rf"(?=\d(?:[ -]?\d){{12}})\d++(?:[ -](?!{_NAMED})\d++)*+"
_FIND = rf"{_NAMED}|(?<![\p{{L}}\p{{N}}+])(?:{_GROUPS})"
#: Lengths of the groups of a card, and the digits of an account number.
_SHAPES, _SHORTEST, _LONGEST = ((4, 4, 4, 4), (4, 6, 5)), 13, 19
_DAYS_P, _DAYS_Q = 189, 773
_AREAS, _REST = 898, 99 * 9999


def _number(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("0")).cast("long")


def _power(n: Column) -> Column:
    """10^n as a whole number, for n from 0 to 15."""
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def _hash(key: str, kind: str, round_: Column, half: Column) -> Column:
    """48 bits of a keyed hash."""
    said = F.concat_ws("|", F.lit(key), F.lit(kind), round_.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(said, 256), 1, 12), 16, 10).cast("long")


def permuted(
    a: Column, b: Column, p: Column, q: Column, key: str, kind: str, restore: bool = False
) -> Column:
    """struct(a, b): the pair (a, b) of Z_p x Z_q after all rounds, or before them."""

    def turn(pair: Column, i: Column) -> Column:
        modulus = F.when(i % 2 == 0, p).otherwise(q)
        if restore:
            other = F.pmod(pair["b"] - _hash(key, kind, i, pair["a"]), modulus)
            return F.struct(other.alias("a"), pair["a"].alias("b"))
        new = F.pmod(pair["a"] + _hash(key, kind, i, pair["b"]), modulus)
        return F.struct(pair["b"].alias("a"), new.alias("b"))

    order = range(ROUNDS - 1, -1, -1) if restore else range(ROUNDS)
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.array(*[F.lit(i) for i in order]), start, turn)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _put_digits(form: Column, digits: Column) -> Column:
    """The form with its digits replaced by these, in order."""
    chars = F.transform(
        F.sequence(F.lit(1), F.length(form)),
        lambda i: F.when(
            form.substr(i, F.lit(1)).rlike("[0-9]"),
            digits.substr(F.length(_digits(form.substr(F.lit(1), i))), F.lit(1)),
        ).otherwise(form.substr(i, F.lit(1))),
    )
    return F.array_join(chars, "")


def _permuted_digits(digits: Column, key: str, kind: str, restore: bool) -> Column:
    """Digits of any length from 2 to 30, leading zeros kept; the length is part of the key."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    v = n - u
    out = permuted(
        _number(digits.substr(F.lit(1), u)),
        _number(digits.substr(u + 1, v)),
        _power(u),
        _power(v),
        key,
        kind,
        restore,
    )
    joined = F.transform(
        F.array(out),
        lambda pair: F.concat(
            F.lpad(pair["a"].cast("string"), u, F.lit("0")),
            F.lpad(pair["b"].cast("string"), v, F.lit("0")),
        ),
    )
    return joined[0]


def _luhn(digits: Column) -> Column:
    """Sum of digits, every second one from the right (the last is the first) doubled."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = digits.substr(n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, d).otherwise(twice)

    places = F.sequence(F.lit(0), n - 1)
    return F.aggregate(F.transform(places, value), F.lit(0), lambda x, y: x + y)


def _account(value: Column, key: str, restore: bool) -> Column:
    digits = _digits(value)
    body = digits.substr(F.lit(1), F.length(digits) - 1)

    def checked(new: Column) -> Column:
        check = F.pmod(-_luhn(F.concat(new, F.lit("0"))), F.lit(10))
        return F.concat(new, check.cast("string"))

    valid = F.transform(F.array(_permuted_digits(body, key, "luhn", restore)), checked)[0]
    return F.when(F.pmod(_luhn(digits), F.lit(10)) == 0, _put_digits(value, valid)).otherwise(
        _put_digits(value, _unchecked(digits, key, restore))
    )


def _unchecked(digits: Column, key: str, restore: bool) -> Column:
    """Numbers without a valid check digit stay without: the distance of the last digit from the
    valid one is kept, from 1 to 9, and the others are permuted."""
    n = F.length(digits)
    body = digits.substr(F.lit(1), n - 1)
    away = F.pmod(_luhn(digits), F.lit(10))

    def closed(new: Column) -> Column:
        last = F.pmod(away - _luhn(F.concat(new, F.lit("0"))), F.lit(10))
        return F.concat(new, last.cast("string"))

    return F.transform(F.array(_permuted_digits(body, key, "number", restore)), closed)[0]


def _phone(value: Column, key: str, restore: bool) -> Column:
    """The country code stays: what stands between + and the first sign, or else all but the last ten
    digits, one at least. So does a trunk zero: ``(0)``, or the first digit of a number with a slash
    and no country code."""
    bare = F.regexp_replace(value, r"\(0\)", "(o)")
    digits = _digits(bare)
    n = F.length(digits)
    trunk = F.when(value.contains("/"), F.lit(1)).otherwise(F.lit(0))
    apart = F.length(F.regexp_extract(value, r"^\+(\d{1,3})[ .(-]", 1))
    plus = F.when(apart > 0, apart).otherwise(F.greatest(n - 10, F.lit(1)))
    code = F.when(value.startswith("+"), plus).otherwise(trunk)
    body = digits.substr(code + 1, n - code)
    new = F.concat(digits.substr(F.lit(1), code), _permuted_digits(body, key, "phone", restore))
    return F.regexp_replace(_put_digits(bare, new), "o", "0")


def _mod_97(text: Column) -> Column:
    """Of the number that digits, and letters as 10 to 35, make one after another."""

    def add(total: Column, char: Column) -> Column:
        n = F.conv(char, 36, 10).cast("int")
        return F.pmod(total * F.when(n < 10, 10).otherwise(100) + n, F.lit(97))

    return F.aggregate(F.split(text, "(?!^)(?!$)"), F.lit(0), add)


def _iban_valid(value: Column) -> Column:
    bare = F.regexp_replace(value, " ", "")
    moved = F.concat(bare.substr(F.lit(5), F.length(bare)), bare.substr(1, 4))
    # 00, 01 and 99 are never given out, though they may fit
    return bare.substr(3, 2).cast("int").between(2, 98) & (_mod_97(moved) == 1)


def _iban(value: Column, key: str, restore: bool) -> Column:
    bare = F.regexp_replace(value, " ", "")
    body = bare.substr(F.lit(5), F.length(bare))
    digits = _digits(body)

    def checked(new: Column) -> Column:
        left = _mod_97(F.concat(_put_digits(body, new), bare.substr(1, 2), F.lit("00")))
        check = F.lpad((98 - left).cast("string"), 2, "0")
        return _put_digits(value, F.concat(check, new))

    some = F.length(digits) >= 2
    new = F.transform(F.array(_permuted_digits(digits, key, "iban", restore)), checked)[0]
    return F.when(some & _iban_valid(value), new).otherwise(value)


def _ip(value: Column, key: str, restore: bool) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("int"))
    side = F.lit(65536)
    pair = permuted(
        octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], side, side, key, "ip", restore
    )
    return F.transform(
        F.array(pair),
        lambda x: F.concat_ws(
            ".",
            *[
                c.cast("string")
                for half in (x["a"], x["b"])
                for c in (F.floor(half / 256), F.pmod(half, F.lit(256)))
            ],
        ),
    )[0]


def _ssn(value: Column, key: str, restore: bool) -> Column:
    area = value.substr(1, 3).cast("int")
    group, serial = value.substr(5, 2).cast("int"), value.substr(8, 4).cast("int")
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    rest = (group - 1) * 9999 + serial - 1
    pair = permuted(place, rest, F.lit(_AREAS), F.lit(_REST), key, "ssn", restore)

    def shown(x: Column) -> Column:
        new = x["a"] + 1 + F.when(x["a"] >= 665, 1).otherwise(0)
        return F.concat_ws(
            "-",
            F.lpad(new.cast("string"), 3, "0"),
            F.lpad((F.floor(x["b"] / 9999) + 1).cast("string"), 2, "0"),
            F.lpad((F.pmod(x["b"], F.lit(9999)) + 1).cast("string"), 4, "0"),
        )

    return F.when(valid, F.transform(F.array(pair), shown)[0]).otherwise(value)


def _date(value: Column, key: str, restore: bool) -> Column:
    """The value where it is no day of one of the forms."""

    def day(form: str) -> Column:
        return F.try_to_timestamp(value, F.lit(form)).cast("date")

    padded = value.rlike(r"^\d{2}/\d{2}/")
    forms = [
        (value.contains("-"), "yyyy-MM-dd", "yyyy-MM-dd"),
        (value.contains("."), "dd.MM.yyyy", "dd.MM.yyyy"),
        (value.rlike(r"^\d{4}/"), "yyyy/MM/dd", "yyyy/MM/dd"),
        (padded, "M/d/yyyy", "MM/dd/yyyy"),
        (~padded, "M/d/yyyy", "M/d/yyyy"),
        (padded, "d/M/yyyy", "dd/MM/yyyy"),
        (~padded, "d/M/yyyy", "d/M/yyyy"),
    ]
    first = F.lit("1800-01-01").cast("date")
    numbers = F.array(
        *[F.when(fits, F.date_diff(day(read), first)) for fits, read, _ in forms]
    )

    def written(number: Column) -> Column:
        """``number`` has the day and the place of its form."""
        pair = permuted(
            F.floor(number["n"] / _DAYS_Q),
            F.pmod(number["n"], F.lit(_DAYS_Q)),
            F.lit(_DAYS_P),
            F.lit(_DAYS_Q),
            key,
            "date",
            restore,
        )

        def text(x: Column) -> Column:
            new = F.date_add(first, (x["a"] * _DAYS_Q + x["b"]).cast("int"))
            shown = F.when(F.lit(False), value)
            for place, (_, _, form) in enumerate(forms):
                shown = shown.when(number["form"] == place, F.date_format(new, form))
            return shown

        return F.transform(F.array(pair), text)[0]

    placed = F.transform(numbers, lambda n, i: F.struct(n.alias("n"), i.alias("form")))
    found = F.filter(placed, lambda x: x["n"].between(0, _DAYS_P * _DAYS_Q - 1))
    return F.when(F.size(found) > 0, _let(F.get(found, F.lit(0)), written)).otherwise(value)


def _named(value: Column, key: str, kind: str, length: int) -> Column:
    said = F.concat_ws("|", F.lit(key), F.lit(kind), F.lower(value))
    return F.substring(F.sha2(said, 256), 1, length)


def _email(value: Column, key: str) -> Column:
    domain = F.substring_index(value, "@", -1)
    return F.concat(
        F.lit("u"), _named(value, key, "email", 12), F.lit("@d"), _named(domain, key, "domain", 8),
        F.lit(".example"),
    )


def _secret(value: Column, key: str) -> Column:
    new = F.substring(
        F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), value), 256), 1, 64
    ).substr(F.lit(1), F.length(value))
    return F.when(value.rlike("[A-F]"), F.upper(new)).otherwise(new)


def _vendor_key(value: Column, key: str) -> Column:
    """The prefix and hexadecimal digits of keyed hashes, as many as characters followed it."""
    prefix = F.regexp_extract(value, f"^{_KEY_PREFIX}", 0)
    blocks = F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        lambda i: F.sha2(F.concat_ws("|", F.lit(key), F.lit("key"), i.cast("string"), value), 256),
    )
    rest = F.array_join(blocks, "").substr(F.lit(1), F.length(value) - F.length(prefix))
    return F.concat(prefix, F.when(prefix.rlike("^A[KS]IA$"), F.upper(rest)).otherwise(rest))


def pseudonym(value: Column, key: str, restore: bool = False) -> Column:
    """The pseudonym of one found value; ``restore`` undoes it but for e-mails, secrets and keys."""

    def whole(pattern: str) -> Column:
        return value.rlike(rf"^(?:{pattern})$")

    return (
        F.when(value.contains("@"), value if restore else _email(value, key))
        .when(whole(_KEY), value if restore else _vendor_key(value, key))
        .when(whole(_IBAN), _iban(value, key, restore))
        .when(whole(_SECRET) & value.rlike("[A-Fa-f]"), value if restore else _secret(value, key))
        .when(whole(_IP), _ip(value, key, restore))
        .when(whole(_DATE), _date(value, key, restore))
        .when(whole(_SSN), _ssn(value, key, restore))
        .when(whole(_PHONE) & (F.length(_digits(value)).between(7, 15)), _phone(value, key, restore))
        .when(F.length(_digits(value)).between(13, 19), _account(value, key, restore))
        .otherwise(value)
    )


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), use)[0]


def _segment(text: Column, found: bool) -> Column:
    return F.struct(text.alias("s"), F.lit(found).alias("found"))


def _taken(groups: Column, i: Column) -> Column:
    """How many groups, from the i-th on, are an account or card number; 0 if none."""
    long = F.length(_digits(groups[i - 1])).between(_SHORTEST, _LONGEST)
    near = F.transform(F.slice(groups, i, F.lit(_LONGEST)), _digits)

    def valid(window: Column, k: Column) -> Column:
        digits = F.array_join(F.slice(window, F.lit(1), k), "")
        fits = F.length(digits).between(_SHORTEST, _LONGEST)
        # shorter or longer digits are not summed
        sums = _let(F.when(fits, digits), lambda d: F.pmod(_luhn(d), F.lit(10)) == 0)
        return (k <= F.size(window)) & fits & sums

    def several(window: Column) -> Column:
        lengths = F.transform(window, lambda g: F.length(g))
        taken = F.when(F.lit(False), F.lit(0))
        for shape in _SHAPES:
            k = F.lit(len(shape))
            same = F.slice(lengths, F.lit(1), k) == F.array(*[F.lit(n) for n in shape])
            taken = taken.when(same & valid(window, k), k)
        free = F.filter(F.sequence(F.lit(2), F.lit(_LONGEST)), lambda k: valid(window, k))
        free = F.when(F.size(free) > 0, free[0])
        return taken.when(i == 1, F.coalesce(free, F.lit(0))).otherwise(F.lit(0))

    return F.when(long, F.lit(1)).when(i < F.size(groups), _let(near, several)).otherwise(0)


def _cards(value: Column) -> Column:
    """Segments of a value of ``_GROUPS``: the numbers among its groups, and what is left."""

    def cut(groups: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(groups))
        taken = F.transform(places, lambda i: F.struct(i.alias("i"), _taken(groups, i).alias("k")))
        none = F.lit([]).cast("array<struct<i:int,k:int,after:int>>")
        start = F.struct(F.lit(1).alias("next"), none.alias("chosen"))

        def choose(state: Column, at: Column) -> Column:
            one = F.struct(at["i"].alias("i"), at["k"].alias("k"), state["next"].alias("after"))
            more = F.struct(
                (at["i"] + at["k"]).alias("next"),
                F.concat(state["chosen"], F.array(one)).alias("chosen"),
            )
            return F.when((at["k"] > 0) & (at["i"] >= state["next"]), more).otherwise(state)

        def part(first: Column, n: Column) -> Column:
            return F.array_join(F.slice(groups, first, n), "")

        def segments(state: Column) -> Column:
            def pair(x: Column) -> Column:
                own = part(x["i"], x["k"])
                sign = F.regexp_extract(own, "^[ -]?", 0)
                before = F.concat(part(x["after"], x["i"] - x["after"]), sign)
                return F.array(
                    _segment(before, False), _segment(F.regexp_replace(own, "^[ -]", ""), True)
                )

            pairs = F.flatten(F.transform(state["chosen"], pair))
            rest = part(state["next"], F.size(groups) + 1 - state["next"])
            return F.concat(pairs, F.array(_segment(rest, False)))

        return _let(F.aggregate(taken, start, choose), segments)

    return _let(F.regexp_extract_all(value, F.lit(r"[ -]?\d+"), 0), cut)


def _free(frame: DataFrame, name: str) -> str:
    while name in frame.columns:
        name += "_"
    return name


def _segments(found: Column, parts: Column) -> Column:
    """All segments of a text whose finds are ``found`` and what stands round them ``parts``."""

    def split(value: Column) -> Column:
        one = value.rlike(r"[^0-9 -]")
        for pattern in (_DATE, _SSN, _PHONE):
            one = one | value.rlike(rf"^(?:{pattern})$")
        wrong = value.rlike(r"^[A-Z]{2}\d\d [0-9 ]+$") & value.rlike(f"^{_IBAN}$") & ~_iban_valid(value)
        groups = F.when(wrong, value.substr(F.lit(5), F.length(value)))
        cut = F.concat(F.array(_segment(value.substr(1, 4), False)), _cards(groups))
        return (
            F.when(wrong, cut).when(one, F.array(_segment(value, True))).otherwise(_cards(value))
        )

    rest = F.slice(parts, F.lit(2), F.size(found))
    after = F.zip_with(
        found, rest, lambda value, text: F.concat(split(value), F.array(_segment(text, False)))
    )
    return F.concat(F.array(_segment(parts[0], False)), F.flatten(after))


def _rewritten(docs: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    parts, finds = _free(docs, "_parts"), _free(docs, "_finds")
    found = F.when(F.col("text").rlike(f"[0-9@]|{_KEY_PREFIX}"), F.regexp_extract_all("text", F.lit(_FIND), 0))
    split = docs.withColumn(finds, found)
    some = F.coalesce(F.size(F.col(finds)), F.lit(0)) > 0
    split = split.withColumn(parts, F.when(some, F.split("text", _FIND, -1)))
    split = split.withColumn(parts, F.when(some, _segments(F.col(finds), F.col(parts))))
    number = F.size(F.filter(F.col(parts), lambda x: x["found"]))
    number = F.when(some, number).otherwise(0)
    new = F.transform(
        F.col(parts), lambda x: F.when(x["found"], change(x["s"])).otherwise(x["s"])
    )
    text = F.array_join(new, "")
    return split.withColumns(
        {"text": F.when(number > 0, text).otherwise(F.col("text")), "n_pii": number.cast("long")}
    ).drop(parts, finds)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and ``n_pii``, the number of finds."""
    return _rewritten(docs, lambda value: pseudonym(value, key))
