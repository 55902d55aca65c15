"""Format-preserving pseudonyms for personal data.

A found value is checked (calendar, check digit, number plan), its free digits are read
as one number, and a keyed Feistel network permutes that number within the set of valid
ones.  The result is written back in the format found.  A permutation is one-to-one, so
equal values stay equal across documents and different ones stay different, without any
table of replacements.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable
from math import isqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harbinger.llm.common import small_batches, with_fields


class Feistel:
    """Keyed permutation of ``0 .. size-1``: alternating rounds on two halves of a near-square
    product, walked along its cycle while outside."""

    def __init__(self, key: bytes, rounds: int = 8):
        self.key, self.rounds = hashlib.blake2b(key, digest_size=32).digest(), rounds

    def _round(self, tweak: bytes, i: int, half: int, bits: int) -> int:
        """A number of at least 128 bits more than the half of ``bits`` that it is added to."""
        if bits <= 128:
            data = b"%d|%d|%s" % (i, half, tweak)
            return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big")
        data = b"%d|%x|%s" % (i, half, tweak)  # decimal digits of so wide a half would be slow, and limited
        seed = hashlib.blake2b(data, key=self.key, digest_size=64).digest()
        blocks = [hashlib.blake2b(b"%d" % n, key=seed, digest_size=64).digest() for n in range((bits + 128) // 512 + 1)]
        return int.from_bytes(b"".join(blocks), "big")

    def permute(self, value: int, size: int, tweak: bytes) -> int:
        if not 0 <= value < size:
            raise ValueError(f"{value} is not in 0..{size - 1}")
        if size < 2:
            return value
        a = isqrt(size - 1) + 1
        b = -(-size // a)
        bits = a.bit_length()
        x = value
        while True:
            left, right = divmod(x, b)
            for i in range(0, self.rounds, 2):
                left = (left + self._round(tweak, i, right, bits)) % a
                right = (right + self._round(tweak, i + 1, left, bits)) % b
            x = left * b + right
            if x < size:
                return x


def refill(shape: str, digits: str) -> str:
    """``shape`` with its decimal digits replaced one by one."""
    new = iter(digits)
    return "".join(next(new) if c in DIGITS else c for c in shape)


DIGITS = "0123456789"


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        n = int(c) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


def card(text: str, f: Feistel) -> str | None:
    """13 to 19 digits with a right check digit; the first digit (network) stays."""
    d = digits_of(text)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1]:
        return None
    n = len(d) - 2
    body = d[0] + f"{f.permute(int(d[1:-1]), 10**n, b'card%d' % n):0{n}d}"
    return refill(text, body + luhn_digit(body))


def phone(text: str, f: Feistel) -> str | None:
    """Ten national digits, area and exchange from 200 on, permuted under their country code; or
    a number of 8 to 15 digits with + of another plan, of which all but the first three after the
    head are permuted.  No country but 1 and 7 has a code of one digit."""
    d = digits_of(text)
    head, body = d[:-10], d[-10:]
    national = len(d) >= 10 and body[0] not in "01" and body[3] not in "01" and (len(head) != 1 or head in "17")
    if not 8 <= len(d) <= 15 or text[0] != "+" and (not national or head not in ("", "1")):
        return None
    if not national:
        keep = len(head) + 3
        n = len(d) - keep
        return refill(text, d[:keep] + f"{f.permute(int(d[keep:]), 10**n, b'tail%d' % n):0{n}d}")
    value = ((int(body[:3]) - 200) * 800 + int(body[3:6]) - 200) * 10000 + int(body[6:])
    value, line = divmod(f.permute(value, 800 * 800 * 10000, b"phone"), 10000)
    area, exchange = divmod(value, 800)
    return refill(text, f"{head}{area + 200}{exchange + 200}{line:04d}")


def social(text: str, f: Feistel) -> str | None:
    """Social security numbers: area 001-899 without 666, group and serial not zero."""
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    value, serial = divmod(f.permute(value, 898 * 99 * 9999, b"social"), 9999)
    area, group = divmod(value, 99)
    area += 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def address(text: str, f: Feistel) -> str | None:
    """IPv4 addresses, as 32-bit numbers."""
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255:
        return None
    value = f.permute(int.from_bytes(bytes(parts), "big"), 2**32, b"address")
    return ".".join(map(str, value.to_bytes(4, "big")))


def letters(text: str, f: Feistel, tweak: bytes) -> str:
    """Lower-case letters, upper-case letters and digits each stay in their class; the rest stays."""
    value, size, kinds = 0, 1, []
    for c in text:
        first, count = ("a", 26) if "a" <= c <= "z" else ("A", 26) if "A" <= c <= "Z" else ("0", 10) if c in DIGITS else (c, 1)
        kinds.append((first, count))
        value, size = value * count + ord(c) - ord(first), size * count
    shape = "".join(k for k, _ in kinds).encode("utf-8", "surrogatepass")
    value = f.permute(value, size, tweak + hashlib.blake2b(shape, digest_size=16).digest())
    out = []
    for first, count in reversed(kinds):
        value, x = divmod(value, count)
        out.append(chr(ord(first) + x))
    return "".join(reversed(out))


def email(text: str, f: Feistel) -> str | None:
    """The local part; the domain, which names a provider, stays."""
    local, domain = text.rsplit("@", 1)
    return letters(local, f, b"email") + "@" + domain


def iban(text: str, f: Feistel) -> str | None:
    """Account numbers with right check digits (modulo 97), which are then set anew."""
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = letters(plain[4:], f, b"iban")
    new = iter(plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02d}" + body)
    return "".join(c if c == " " else next(new) for c in text)


def secret(text: str, f: Feistel) -> str | None:
    """Values assigned to a name that says token, secret, key or password."""
    shape = re.fullmatch(r"(.*[\"'=:\s])([A-Za-z0-9_+/.-]{16,})([\"']?)", text, re.S)
    if shape is None:
        return None
    value = shape[2]
    if max(map(len, value.split("."))) < 16 and not any(c in DIGITS for c in value):
        return None  # a dotted name, as in code
    if re.fullmatch(r"[0-9a-f]+", value):
        new = f"{f.permute(int(value, 16), 16 ** len(value), b'hex%d' % len(value)):0{len(value)}x}"
    else:
        new = letters(value, f, b"secret")
    return shape[1] + new + shape[3]


FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


def as_date(year: int, month: int, day: int) -> dt.date | None:
    """A calendar day from 1900 to 2099."""
    try:
        day_of = dt.date(year, month, day)
    except ValueError:
        return None
    return day_of if FIRST_DAY <= day_of.toordinal() <= LAST_DAY else None


def other_day(day: dt.date, f: Feistel, late: bool = False) -> dt.date:
    """The permuted day, whatever the spelling; ``late`` walks on to a day of month over 12."""
    while True:
        n = f.permute(day.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, b"day")
        day = dt.date.fromordinal(FIRST_DAY + n)
        if not late or day.day > 12:
            return day


def iso_date(text: str, f: Feistel) -> str | None:
    day = as_date(int(text[:4]), int(text[5:7]), int(text[8:10]))
    if day is None:
        return None
    day = other_day(day, f)
    return f"{day.year}{text[4]}{day.month:02d}{text[7]}{day.day:02d}"


def short_date(text: str, f: Feistel) -> str | None:
    """Month first with slashes, day first with dots and hyphens, unless only the other order is a
    date.  Such a date moves among its like, days after the 12th, so that no two dates meet."""
    first, second, year = (int(x) for x in re.split(r"[/.-]", text))
    sep = text[-5]
    month_first, late = sep == "/", False
    day = as_date(year, *((first, second) if month_first else (second, first)))
    if day is None:
        month_first, late = not month_first, True
        day = as_date(year, *((first, second) if month_first else (second, first)))
    if day is None:
        return None
    day = other_day(day, f, late)
    parts = (day.month, day.day) if month_first else (day.day, day.month)
    return f"{parts[0]:02d}{sep}{parts[1]:02d}{sep}{day.year}"


# Month names.
MONTHS = "January February March April May June July August September October November December".split()


def named_date(text: str, f: Feistel) -> str | None:
    name = re.search(r"[A-Za-z]+", text)[0]
    numbers = [int(x) for x in re.findall(r"\d+", text)]
    month = next(i for i, m in enumerate(MONTHS, 1) if m[:3].lower() == name[:3].lower())
    day = as_date(numbers[1], month, numbers[0])
    if day is None:
        return None
    day = other_day(day, f)
    new = MONTHS[day.month - 1]
    new = new if len(name) > 3 or name.lower() == "may" else new[:3]
    spans = re.sub(r"[A-Za-z]+", new, text, count=1)
    found = iter((str(day.day), str(day.year)))
    return re.sub(r"\d+", lambda _: next(found), spans)


NAMES = "|".join(m if len(m) < 4 else f"{m[:3]}(?:{m[3:]})?" for m in MONTHS)
KINDS: list[tuple[str, str, Callable[[str, Feistel], str | None]]] = [
    ("email", r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", email),
    ("secret", r"(?i:\b(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)\b[\"']?\s*[=:]\s*[\"']?)[A-Za-z0-9_+/-][A-Za-z0-9_+/.-]{14,}[A-Za-z0-9_+/-][\"']?", secret),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", iban),
    ("address", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)", address),
    ("date", r"(?<!\d)\d{4}[-/.](?:0[1-9]|1[0-2])[-/.](?:0[1-9]|[12]\d|3[01])(?!\d)", iso_date),
    ("date", r"(?<![\d/.-])\d{1,2}([/.-])\d{1,2}\1\d{4}(?!\d)", short_date),
    ("date", rf"\b(?:\d{{1,2}} (?:{NAMES})|(?:{NAMES}) \d{{1,2}}),? \d{{4}}\b", named_date),
    ("social", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", social),
    ("card", r"(?<!\d)\d(?:[ -]?\d){12,18}", card),
    ("phone", r"(?<![\w+])\+\d(?:(?:[ ./-]|[ .-]?\(|\)[ .-]?)?\d){7,14}(?!\d)", phone),
    ("phone", r"(?<![\w+])(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w-])", phone),
]
NEEDED = re.compile(r"[0-9@]|(?i:token|secret|passw|key)")


def compiled() -> re.Pattern[str]:
    parts = []
    for i, (_, pattern, _) in enumerate(KINDS):
        parts.append(f"(?P<k{i}>{pattern.replace(chr(92) + '1', f'(?P=s{i})').replace('([/.-])', f'(?P<s{i}>[/.-])')})")
    return re.compile("|".join(parts))


# Length of an account number by country.
IBAN_LENGTHS = {c: n for n, codes in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in codes.split()}
USUAL_CARD = re.compile(r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{4,5}")


SOME_DIGIT = frozenset(DIGITS)


def card_ends(text: str, start: int, end: int) -> list[int]:
    """Ends of digit runs at which 13 to 19 digits are read: usual groupings first, then the longest."""
    ends = [i for i in range(end, start, -1) if text[i - 1] in DIGITS and text[i : i + 1] not in SOME_DIGIT
            and len(digits_of(text[start:i])) >= 13]
    return sorted(ends, key=lambda i: USUAL_CARD.fullmatch(text, start, i) is None)


def readings(name: str, text: str, m: re.Match[str]) -> list[int]:
    """Where the candidate may end, the likeliest first."""
    start, end = m.span()
    if name == "card":
        return card_ends(text, start, end)
    if name == "iban":
        held = [i for i in range(end, start, -1) if text[i - 1] != " " and not text[i : i + 1].isalnum()]
        own = IBAN_LENGTHS.get(text[start : start + 2])
        return sorted(held, key=lambda i: len(text[start:i].replace(" ", "")) != own)
    if name == "phone" and text[start : start + 2] == "+1":
        held = [i for i in range(end, start, -1) if text[i - 1] in DIGITS and text[i : i + 1] not in SOME_DIGIT]
        return sorted({end, *(i for i in held if len(digits_of(text[start:i])) == 11)})
    return [end]


def card_inside(text: str, start: int, end: int, f: Feistel) -> bool:
    """Whether a card in a usual grouping starts at a later digit run of the candidate."""
    for i in range(start + 1, end):
        if text[i] in SOME_DIGIT and text[i - 1] not in SOME_DIGIT:
            later = CARD.match(text, i)
            if later and any(USUAL_CARD.fullmatch(text, i, e) and card(text[i:e], f) for e in card_ends(text, i, later.end())):
                return True
    return False


CARD = re.compile(next(p for n, p, _ in KINDS if n == "card"))


def rewrite(text: str, pattern: re.Pattern[str], kinds: list[re.Pattern[str]], f: Feistel) -> tuple[str, list[str]]:
    """``text`` with pseudonyms, and the kinds of what was replaced.  Where a candidate fails its check, its
    shorter readings are tried, then the other kinds that start there, then what starts later."""
    out, found, done, at = [], [], 0, 0
    while (m := pattern.search(text, at)) is not None:
        start, at = m.start(), m.start() + 1
        new = None
        for i in range(int(m.lastgroup[1:]), len(KINDS)):
            name, _, rule = KINDS[i]
            if (own := kinds[i].match(text, start)) is None:
                continue
            for end in readings(name, text, own):
                new = rule(text[start:end], f)
                if new is not None and name == "card" and not USUAL_CARD.fullmatch(text, start, end) and card_inside(text, start, end, f):
                    new = None
                if new is not None:
                    break
            if new is not None:
                out += [text[done:start], new]
                found.append(name)
                done = at = end
                break
    return "".join([*out, text[done:]]), found


def pseudonymise(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Input columns with ``text`` rewritten, and ``n_replaced long, kinds array<string>``.

    ``kinds`` names the kind of each replaced value in text order.  A value that fails
    its check (calendar, check digit, number plan) in every reading is left alone.  The same key gives the
    same pseudonyms in every run and document.  Null text stays null with no replacement;
    empty text stays empty; repeated rows come out alike; an input column named as an
    output gives way.  No shuffle; a text without digit, ``@`` or secret's name is passed
    through.
    """
    small_batches(texts.sparkSession)
    secret_key = key.encode()

    @F.pandas_udf(f"`{text}` string, n_replaced long, kinds array<string>")
    def rewritten(column: pd.Series) -> pd.DataFrame:
        pattern, feistel = compiled(), Feistel(secret_key)
        single = [re.compile(p) for _, p, _ in KINDS]
        texts, numbers, kinds = [], [], []
        for value in column:
            found: list[str] = []
            if value is not None and NEEDED.search(value):
                value, found = rewrite(value, pattern, single, feistel)
            texts.append(value)
            numbers.append(len(found))
            kinds.append(found)
        return pd.DataFrame({text: texts, "n_replaced": numbers, "kinds": kinds})

    order = texts.columns
    out = with_fields(texts, rewritten(F.col(text)), [text, "n_replaced", "kinds"])
    return out.select(*[f"`{c}`" for c in order if c in out.columns and c not in ("n_replaced", "kinds")], "n_replaced", "kinds")
