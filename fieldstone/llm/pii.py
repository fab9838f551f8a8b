"""Personal data: format-preserving pseudonyms by a keyed Feistel permutation.

Numbers, addresses and dates are found by pattern and validated (check digits, ranges, the calendar).
Each is read as an integer below the size of its format's domain, permuted there by a balanced
Feistel network with a keyed hash as round function (walking the cycle until the result is valid in
the format again), and written back in the same layout, with new check digits.  It is a permutation:
equal values stay equal across all documents, different values stay different, and no table of
seen values is kept or shuffled.  The work is per row; no row meets another.

Formats:

* e-mail addresses: top-level domain kept, each letter or digit within its class;
* payment cards of 13 to 19 digits (Luhn), in one or in groups of three or more but for the last: length and first digit kept, linked
  across groupings;
* IBAN (mod 97): country kept; US social security numbers; IPv4 addresses;
* phone numbers: country code, leading zeros and punctuation kept, linked across punctuation.  Numbers of the North
  American plan have ten digits, and area and exchange codes from 2 on; those that haven't such codes are permuted
  among themselves, if a country code or a bracket says that they are meant as phone numbers; others have 6 to 14
  digits after the country code;
* dates from 1900 to 2099: ISO, day.month.year, day/month/year, and month/day/year where the first can't be
  a month's day; the number of digits of day and month is kept.  Dates with two digits each are linked across all
  layouts but the last, whose pseudonyms again can't be read otherwise; those with single digits are linked
  among themselves;
* access keys (``AKIA...``) and assigned secrets (``password=...``, ``"api_key": "..."``), each character within its class.

Values that fail validation are left alone.

Defined results: a null text stays null, an empty one empty; text without a valid value is
unchanged; very long texts are treated whole; repeated rows get equal results; where two formats could start
at one place the first of ``FORMATS`` that is valid there is taken; other columns, whatever their names, are kept.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, in_slices

ROUNDS = 8
DEFAULT_KEY = b"fieldstone demonstration key"


def feistel(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of the integers below ``size``."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            data = tweak + bytes((r,)) + right.to_bytes(width, "big")
            if width <= 64:
                f = hashlib.blake2b(data, key=key[:64], digest_size=width).digest()
            else:
                f = hashlib.shake_256(key + data).digest(width)
            left, right = right, left ^ (int.from_bytes(f, "big") & mask)
        value = (left << half) | right
        if value < size:
            return value


def walk(value: int, size: int, key: bytes, tweak: bytes, valid) -> int:
    """The permutation restricted to the valid values: walks the cycle to the next one."""
    while True:
        value = feistel(value, size, key, tweak)
        if valid(value):
            return value


CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
CLASS_OF = {c: s for s in CLASSES for c in s}


def same_classes(text: str, key: bytes, tweak: bytes) -> str:
    """Each ASCII letter or digit becomes one of its class; all other characters stay."""
    value, size = 0, 1
    for c in text:
        if c in CLASS_OF:
            s = CLASS_OF[c]
            value, size = value * len(s) + s.index(c), size * len(s)
    value = feistel(value, size, key, tweak + size.to_bytes((size.bit_length() + 7) // 8, "big")[:16])
    out = []
    for c in reversed(text):
        if c in CLASS_OF:
            s = CLASS_OF[c]
            value, i = divmod(value, len(s))
            c = s[i]
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def refill(layout: str, digits: str) -> str:
    """``layout`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in layout)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def card(text: str, key: bytes) -> str | None:
    d = _digits(text)
    if not 13 <= len(d) <= 19 or not luhn(d) or len(set(d)) == 1 or d[0] == "0":
        return None
    if any(len(g) < 3 for g in re.split("[ -]", text)[:-1]):
        return None
    n = len(d) - 2
    inner = str(feistel(int(d[1:-1]), 10**n, key, b"card%d" % n)).zfill(n)
    return refill(text, next(x for x in (d[0] + inner + c for c in "0123456789") if luhn(x)))


def iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


def iban(text: str, key: bytes) -> str | None:
    s = text.replace(" ", "")
    if not 15 <= len(s) <= 34 or iban_number(s[4:] + s[:4]) % 97 != 1:
        return None
    inner = same_classes(s[4:], key, b"iban" + s[:2].encode())
    done = s[:2] + f"{98 - iban_number(inner + s[:2] + '00') % 97:02d}" + inner
    it = iter(done)
    return "".join(c if c == " " else next(it) for c in text)


def ssn(text: str, key: bytes) -> str | None:
    def valid(v: int) -> bool:
        return 0 < v // 10**6 < 900 and v // 10**6 != 666 and v // 10**4 % 100 > 0 and v % 10**4 > 0

    v = int(_digits(text))
    return refill(text, str(walk(v, 10**9, key, b"ssn", valid)).zfill(9)) if valid(v) else None


# The international country codes of one and two digits; all others have three.
COUNTRY_CODES = {"1", "7"} | set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def phone(text: str, key: bytes) -> str | None:
    d = _digits(text)
    code = next((d[:n] for n in (1, 2) if d[:n] in COUNTRY_CODES), d[:3]) if text[0] == "+" else "1"
    kept = code if text[0] == "+" else ""
    rest = d[len(kept) :]
    plan = code == "1"  # area and exchange codes start with 2 to 9
    if not plan:
        zeros = len(rest) - len(rest.lstrip("0"))
        kept, rest = kept + rest[:zeros], rest[zeros:]
    n = len(rest)
    if (n != 10) if plan else not (6 <= n <= 14 and len(d) <= 15 and d[0] != "0"):
        return None

    def assigned(v: int) -> bool:
        return v // 10**9 > 1 and v // 10**6 % 10 > 1 if plan else v >= 10 ** (n - 1)

    kind = assigned(int(rest))
    if not kind and text[0] not in "+(":
        return None
    new = walk(int(rest), 10**n, key, b"phone" + code.encode() + b"-%d%d" % (n, kind), lambda v: assigned(v) == kind)
    return refill(text, kept + str(new).zfill(n))


def ipv4(text: str, key: bytes) -> str | None:
    part = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in part) or part[0] == "0":
        return None
    v = int.from_bytes(bytes(map(int, part)), "big")
    return ".".join(map(str, walk(v, 1 << 32, key, b"ipv4", lambda x: x >> 24 > 0).to_bytes(4, "big")))


FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def date(text: str, key: bytes) -> str | None:
    p = re.split(r"[-./]", text)
    year_first, sep = len(p[0]) == 4, text[len(p[0])]
    for order in ((0, 1, 2),) if year_first else ((2, 1, 0), (2, 0, 1)) if sep == "/" else ((2, 1, 0),):
        try:
            day = datetime.date(*(int(p[i]) for i in order)).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        month_first = order == (2, 0, 1)
        plain = {i: len(p[i]) == 1 or p[i][0] != "0" for i in order[1:]}
        single = any(len(p[i]) == 1 for i in order[1:])

        def written(on: datetime.date) -> list[str] | None:
            """The parts of a date in this layout; None if it doesn't fit."""
            out = ["", "", ""]
            for i, v in zip(order, (on.year, on.month, on.day)):
                out[i] = str(v).zfill(len(p[i]))
                if len(out[i]) != len(p[i]) or (single and i in plain and len(p[i]) == 2 and plain[i] != (v > 9)):
                    return None
            return out if not month_first or on.day > 12 else None

        tweak = b"date" + b"".join(b"%d%d" % (len(p[i]), plain[i]) for i in order[1:]) * single + b"m" * month_first
        size = LAST_DAY - FIRST_DAY + 1
        new = walk(day - FIRST_DAY, size, key, tweak, lambda v: written(datetime.date.fromordinal(FIRST_DAY + v)) is not None)
        return sep.join(written(datetime.date.fromordinal(FIRST_DAY + new)))
    return None


def email(text: str, key: bytes) -> str | None:
    head, _, top = text.rpartition(".")
    return same_classes(head, key, b"email") + "." + top


def access_key(text: str, key: bytes) -> str | None:
    return text[:4] + same_classes(text[4:], key, b"access")


def secret(text: str, key: bytes) -> str | None:
    at = ASSIGNED.match(text).end()
    return text[:at] + same_classes(text[at:], key, b"secret")


SECRET_WORDS = "password passwd pwd secret api_key apikey token".split()
NAMED = f"(?i:(?:{'|'.join(SECRET_WORDS)}))"
# A name that ends or goes on with one of these words, with or without quotes, up to the value.
ASSIGN = rf"(?:[A-Za-z0-9]+[_.-])*{NAMED}(?:[_-][A-Za-z0-9]+)*[\"']?\s*[=:]\s*[\"']?"
ASSIGNED = re.compile(ASSIGN)

# In this order where two could start at one place.
FORMATS = {
    "email": (email, r"(?<![\w.+%-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![\w-])"),
    "secret": (secret, rf"(?<![\w.-]){ASSIGN}[A-Za-z0-9_/+.-]*[A-Za-z0-9_/+-]"),
    "access_key": (access_key, r"\bAKIA[A-Z0-9]{16}\b"),
    "iban": (iban, r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "date": (date, r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\w/-]|\.\d)"),
    "ipv4": (ipv4, r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"),
    "ssn": (ssn, r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "card": (card, r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    "phone": (phone, r"(?<!\w)\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\w)|(?<!\w)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"),
}
ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, (_, p) in FORMATS.items()))
# The same at a place that is known to follow a separator.
LATER = re.compile(re.sub(r"\(\?<!(?:\\w|\[[^\]]*\])\)", "", ANY.pattern))
# What every format needs: a digit, an @, or one of the words of the secrets.
MAY_HOLD = re.compile("[0-9@]|" + NAMED)


def replaced(kind: str, text: str, key: bytes) -> tuple[str, str, int] | None:
    """(kind, pseudonym, length) of a valid value that the match starts with.  Where the pattern took in
    following groups that don't belong to the value, it is the longest valid head."""
    new = FORMATS[kind][0](text, key)
    if new is not None:
        return kind, new, len(text)
    for cut in (i for i in range(len(text) - 1, 0, -1) if text[i] in " -"):
        head = ANY.fullmatch(text, 0, cut)
        if head and (new := FORMATS[head.lastgroup][0](text[:cut], key)) is not None:
            return head.lastgroup, new, cut
    return None


def pseudonymise(text: str | None, key: bytes, seen: dict) -> tuple[str | None, list[str]]:
    """The text with every valid value replaced, and the kinds of those values in order.  Where a match
    has no valid head, a value may start after any of its separators."""
    if not text or not MAY_HOLD.search(text):
        return text, []
    kinds: list[str] = []
    out: list[str] = []
    done = at = 0

    def value(m: re.Match) -> tuple[str, str, int] | None:
        found = (m.lastgroup, m[0])
        if found not in seen:
            if len(seen) > 100_000:
                seen.clear()
            seen[found] = replaced(m.lastgroup, m[0], key)
        return seen[found]

    while m := ANY.search(text, at):
        start, at, hit = m.start(), m.end(), value(m)
        if hit is None:
            for i in range(start + 1, at - 1):
                if text[i] in " -" and (later := LATER.match(text, i + 1)) and (hit := value(later)) is not None:
                    start = i + 1
                    break
        if hit is not None:
            kind, new, length = hit
            kinds.append(kind)
            out += text[done:start], new
            done = at = start + length
    return "".join(out) + text[done:], kinds


def masked(text: Column, key: bytes = DEFAULT_KEY) -> Column:
    """struct(text, kinds): the pseudonymised text and the kinds of the values found, in order.
    A real key must come from the caller; the default only makes runs repeatable."""

    @F.arrow_udf("text string, kinds array<string>")
    def mask(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen: dict = {}
        for texts in in_slices(batches):
            done = [pseudonymise(t, key, seen) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([t for t, _ in done], pa.string()), pa.array([k for _, k in done], pa.list_(pa.string()))], ["text", "kinds"])

    return mask(text)


def mask_documents(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", key: bytes = DEFAULT_KEY) -> DataFrame:
    """``docs`` with the text pseudonymised and its length, if such a column is there, renewed."""
    name = fresh(docs, "masked")
    out = docs.withColumn(name, masked(F.col(text), key)).withColumn(text, F.col(name)["text"])
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    return out.drop(name)
