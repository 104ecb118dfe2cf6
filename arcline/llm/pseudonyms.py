"""Personal numbers, dates and addresses replaced by pseudonyms of the same format, by a keyed Feistel permutation.

A value is validated first (check digits, ranges, calendar), mapped to a whole number below the number of values of its format, permuted
there, and written in the separators and letter cases in which it stood.  The same value gets the same pseudonym in every
document, different values different ones, and check digits hold again.  Who has the key can go back (``reveal``).
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import math
import re
import struct as pack
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcline.llm.common import read

ROUNDS = 10
KINDS = ("email", "secret", "iban", "card", "phone", "ip", "national_id", "date")
#: Stands in for a key in tests and in the registered query; callers pass their own.
EXAMPLE_KEY = b"example key, not for use"

#: How the kinds are written.  No part of a pattern can be tried again from within a run of the same characters, so texts cost in proportion.
_PATTERN = re.compile(
    r"(?P<email>(?<![\w.%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)"
    r"|(?P<secret>\bAKIA[0-9A-Z]{16}\b|(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b\s*[=:]\s*[\"']?)[A-Za-z0-9_+/-]{8,})"
    r"|(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<phone>(?<![0-9])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![\w(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![\w.+-])[2-9][0-9]{2}(?P<gap>[.-])[2-9][0-9]{2}(?P=gap)[0-9]{4}(?![\w-]|\.[0-9]))"
    r"|(?P<date>(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9/-]|\.[0-9]))"
    r"|(?P<national_id>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
    r"|(?P<card>(?<![0-9.,-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9-]))"
    r"|(?P<ip>(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9]))"
)
#: Country calling codes of one and of two digits; all others have three.
_ONE_DIGIT = ("1", "7")
_TWO_DIGITS = ("20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
#: A long secret is permuted in parts of so many characters, each keyed by what stands before it.
PART = 64


def _round(key: bytes, tweak: bytes, i: int, x: int) -> int:
    data = pack.pack("<BI", i, len(tweak)) + tweak + x.to_bytes((x.bit_length() + 7) // 8 or 1, "little")
    return int.from_bytes(hashlib.blake2b(data, key=key[:64], digest_size=64).digest(), "little")


def permute(x: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1: a Feistel network over a * b >= size, walked until it is below ``size``."""
    if size < 2:
        return x
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(x, b)
        for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * _round(key, tweak, i, left)) % b
            else:
                left = (left + sign * _round(key, tweak, i, right)) % a
        x = left * b + right
        if x < size:
            return x


def _mixed(parts: list[int], sizes: list[int]) -> tuple[int, int]:
    x, size = 0, 1
    for p, s in zip(parts, sizes, strict=True):
        x, size = x * s + p, size * s
    return x, size


def _split(x: int, sizes: list[int]) -> list[int]:
    out = []
    for s in reversed(sizes):
        x, p = divmod(x, s)
        out.append(p)
    return out[::-1]


def _refill(text: str, digits: str) -> str:
    """``text`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in text)


def _characters(text: str, key: bytes, tweak: bytes, back: bool) -> str:
    """Digits permuted among digits and letters among letters, cases and signs staying; hex text is permuted as such.

    Text is permuted in parts of ``PART`` characters, each with a hash of the plain text before it as a tweak.
    """
    out, plain = "", ""
    for i in range(0, len(text), PART):
        part = text[i : i + PART]
        new = _part(part, key, tweak + (hashlib.blake2b(plain.encode(), digest_size=16).digest() if plain else b""), back)
        plain, out = hashlib.blake2b((plain + (new if back else part)).encode(), digest_size=16).hexdigest(), out + new
    return out


def _part(text: str, key: bytes, tweak: bytes, back: bool) -> str:
    if re.fullmatch(r"(?=.*[0-9])(?:(?=.*[a-f])[0-9a-f]{8,}|(?=.*[A-F])[0-9A-F]{8,})", text):
        n, new = int(text, 16), ""
        while not (re.search(r"[0-9]", new) and re.search(r"[A-Fa-f]", new)):  # walks on to hex text that shows as such
            n = permute(n, 16 ** len(text), key, tweak + b"hex", back)
            new = f"{n:0{len(text)}{'X' if text.upper() == text else 'x'}}"
        return new
    out = list(text)
    digits = [i for i, c in enumerate(text) if "0" <= c <= "9"]
    letters = [i for i, c in enumerate(text) if "a" <= c.lower() <= "z"]
    for where, zero, radix, name in ((digits, ord("0"), 10, b"digits"), (letters, ord("a"), 26, b"letters")):
        if where:
            sizes = [radix] * len(where)
            x, size = _mixed([ord(text[i].lower()) - zero for i in where], sizes)
            other = text if name == b"letters" else ""
            for i, p in zip(where, _split(permute(x, size, key, tweak + name, back), sizes), strict=True):
                c = chr(zero + p)
                out[i] = c.upper() if other and text[i].isupper() else c
    return "".join(out)


def luhn(digits: str) -> int:
    """The check digit that makes ``digits`` plus it valid."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def _iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4]))


def _email(text: str, key: bytes, back: bool) -> str | None:
    local, _, domain = text.rpartition("@")
    return f"{_characters(local, key, b'email', back)}@{domain}"


def _secret(text: str, key: bytes, back: bool) -> str | None:
    head = "AKIA" if text.startswith("AKIA") else re.match(r"(?i).*?[=:]\s*[\"']?", text)[0]
    return head + _characters(text[len(head) :], key, b"secret", back)


def _iban(text: str, key: bytes, back: bool) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_number(plain) % 97 != 1:
        return None
    body = _characters(plain[4:], key, b"iban" + plain[:2].encode(), back)
    new = plain[:2] + f"{98 - _iban_number(plain[:2] + '00' + body) % 97:02d}" + body
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in text)


def _card(text: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"[^0-9]", "", text)
    if digits[0] == "0" or luhn(digits[:-1]) != int(digits[-1]):
        return None
    body = digits[1:-1]
    x = permute(int(body), 10 ** len(body), key, b"card" + digits[:1].encode() + bytes([len(digits)]), back)
    new = digits[0] + f"{x:0{len(body)}d}"
    return _refill(text, new + str(luhn(new)))


def _phone(text: str, key: bytes, back: bool) -> str | None:
    """A number is its country code and the digits after it, however they are set apart; without a code it is one of the North American plan."""
    digits = re.sub(r"[^0-9]", "", text)
    country = "1"
    if text[0] == "+":
        country = next(digits[:n] for n in (1, 2, 3) if n == 3 or digits[:n] in (_ONE_DIGIT, _TWO_DIGITS)[n - 1])
        digits = digits[len(country) :]
    if country == "1":
        if len(digits) != 10 or digits[0] < "2" or digits[3] < "2":  # area and exchange begin with 2 to 9
            return None
        sizes = [8, 100, 8, 100, 10_000]
        x, size = _mixed([int(digits[0]) - 2, int(digits[1:3]), int(digits[3]) - 2, int(digits[4:6]), int(digits[6:])], sizes)
        p = _split(permute(x, size, key, b"phone-1", back), sizes)
        new = f"{p[0] + 2}{p[1]:02d}{p[2] + 2}{p[3]:02d}{p[4]:04d}"
    elif 6 <= len(digits) <= 14:
        new = f"{permute(int(digits), 10 ** len(digits), key, b'phone' + country.encode() + bytes([len(digits)]), back):0{len(digits)}d}"
    else:
        return None
    return _refill(text, (country if text[0] == "+" else "") + new)


def _ip(text: str, key: bytes, back: bool) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255 or not 1 <= parts[0] <= 223 or parts[0] == 127:  # not a host's own
        return None
    sizes = [222, 256, 256, 256]
    first = parts[0] - 1 - (parts[0] > 127)
    x, size = _mixed([first, *parts[1:]], sizes)
    p = _split(permute(x, size, key, b"ip", back), sizes)
    return ".".join(map(str, [p[0] + 1 + (p[0] >= 126), *p[1:]]))


def _national_id(text: str, key: bytes, back: bool) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    sizes = [898, 99, 9999]
    x, size = _mixed([area - 1 - (area > 666), group - 1, serial - 1], sizes)
    p = _split(permute(x, size, key, b"national", back), sizes)
    return f"{p[0] + 1 + (p[0] >= 665):03d}-{p[1] + 1:02d}-{p[2] + 1:04d}"


@functools.lru_cache(maxsize=1)
def _late_days() -> list[int]:
    """The days after the 12th of their month, which are told from months in any order."""
    return [n for n in range(_FIRST_DAY, _LAST_DAY + 1) if datetime.date.fromordinal(n).day > 12]


def _date(text: str, key: bytes, back: bool) -> str | None:
    """A date is its day, however it is written: year first, day first, or month first with slashes and a day after the 12th.

    Days to the 12th and later ones are permuted apart, so what could be read as month first still can be.
    """
    a, b, c = (int(p) for p in re.split(r"[^0-9]", text))
    year_first = "0" <= text[2] <= "9"
    month_first = not year_first and text[2] == "/" and a <= 12 < b
    if not year_first and text[2] != text[5]:
        return None
    try:
        day = datetime.date(a, b, c) if year_first else datetime.date(c, a, b) if month_first else datetime.date(c, b, a)
    except ValueError:
        return None
    if not _FIRST_DAY <= day.toordinal() <= _LAST_DAY:
        return None
    if day.day > 12:
        late = _late_days()
        new = datetime.date.fromordinal(late[permute(bisect.bisect_left(late, day.toordinal()), len(late), key, b"late date", back)])
    else:
        x, size = _mixed([day.year - 1900, day.month - 1, day.day - 1], [200, 12, 12])
        y, m, d = _split(permute(x, size, key, b"date", back), [200, 12, 12])
        new = datetime.date(1900 + y, m + 1, d + 1)
    parts = (f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}")
    order = parts if year_first else (parts[1], parts[2], parts[0]) if month_first else parts[::-1]
    return _refill(text, "".join(order))


_BY_KIND: dict[str, Callable[[str, bytes, bool], str | None]] = {"email": _email, "secret": _secret, "iban": _iban, "card": _card, "phone": _phone, "ip": _ip, "national_id": _national_id, "date": _date}


def replace(text: str, key: bytes, back: bool = False) -> tuple[str, list[int]]:
    """``text`` with its values replaced, and how many of each of ``KINDS`` there were."""
    counts = [0] * len(KINDS)

    def one(m: re.Match) -> str:
        new = _BY_KIND[m.lastgroup](m[0], key, back)
        if new is None:
            return m[0]
        counts[KINDS.index(m.lastgroup)] += 1
        return new

    return _PATTERN.sub(one, text), counts


def pseudonymise(docs: DataFrame, key: bytes, *, text: str = "text", back: bool = False) -> DataFrame:
    """``docs`` with the values in ``text`` replaced, n_pii (their number) and n_<kind> for each kind; a row each, in place.

    Only texts with a digit, an @ or the name of a secret go to Python.  Null texts stay null and empty ones empty, with counts 0; repeated rows get equal
    texts; very long texts are taken whole, in time in proportion.  Input columns named like the new ones give way.  An empty table gives no rows.  ``back`` undoes it.
    """
    made = ["n_pii", *(f"n_{k}" for k in KINDS)]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in made])

    @F.pandas_udf("text string, counts array<int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = [(None, None) if t is None else replace(t, key, back) for t in texts]
        return pd.DataFrame(out, columns=["text", "counts"])

    may = F.col(text).rlike(r"[0-9@]|(?i:passw|pwd|secret|token|api.?key)")
    found = docs.withColumn("_found", run(F.when(may, F.col(text))))
    count = lambda i: F.coalesce(F.get("_found.counts", F.lit(i)), F.lit(0)).cast("long")
    out = found.withColumn(text, F.coalesce("_found.text", F.col(text)))
    out = out.withColumn("n_pii", F.aggregate(F.coalesce("_found.counts", F.array().cast("array<int>")), F.lit(0).cast("long"), lambda t, x: t + x))
    return out.withColumns({f"n_{k}": count(i) for i, k in enumerate(KINDS)}).drop("_found")


def reveal(docs: DataFrame, key: bytes, *, text: str = "text") -> DataFrame:
    """The original texts of what ``pseudonymise`` made with the same key."""
    return pseudonymise(docs, key, text=text, back=True)


def op2(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), EXAMPLE_KEY)
