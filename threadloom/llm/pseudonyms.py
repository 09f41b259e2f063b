"""Format-preserving pseudonyms for personal data.

What a text holds of validated numbers (payment cards by check digit, bank accounts by remainder, social security
numbers, phone numbers, IPv4 addresses), calendar dates, mail addresses and quoted secrets is replaced by
another value of the same format: same length, separators, letter case and validity (numbers in IPv4 addresses may
have another count of digits). The replacement is
a keyed Feistel permutation of the value's own domain, so equal values stay equal in all documents, in whatever
separators they are written, different ones stay different, and who holds the key can turn it back.

Values that don't validate are left alone, as are all other characters. Nulls, empties and repeats: a
null text stays null and an empty one empty, with nothing found; repeated rows are all treated; an empty
table gives an empty one. Columns of the table named n_found or found_kinds give way.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
from collections import Counter
from datetime import date, timedelta

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import column, fields, fresh, mapped, table

ROUNDS = 10
#: Dates are permuted among the days of these years.
FIRST_DAY, LAST_YEAR = date(1900, 1, 1), 2100
MONTHS = (LAST_YEAR - FIRST_DAY.year) * 12
#: The days after the 12th of a month.
_LATE = [d for k in range((date(LAST_YEAR, 1, 1) - FIRST_DAY).days) if (d := FIRST_DAY + timedelta(days=k)).day > 12]
_LATE_AT = {d: k for k, d in enumerate(_LATE)}
_DIGITS = "0123456789"
_LOWER, _UPPER, _HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
_TO_LOWER = str.maketrans(_UPPER, _LOWER)

_FIND = regex.compile(
    r"""
      (?P<email>(?<![\w.%+@-])[\w%+-]+(?:\.[\w%+-]+)*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b)
    | (?P<secret>(?<=\b(?i:token|secret|password|passwd|api_?key|key)\s{0,3}[=:]\s{0,3}["'])[0-9A-Za-z+/_-]{16,}(?=["']))
    | (?P<iban>(?<![\w])[A-Za-z]{2}[0-9]{2}(?:\ ?[A-Za-z0-9]{4}){2,7}(?:\ ?[A-Za-z0-9]{1,4})?(?![\w]))
    | (?P<phone>(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![\w]))
    | (?P<ip>(?<![\w.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\.?\w))
    | (?P<day>(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![\w/-]|\.\w))
    | (?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
    | (?P<card>(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]))
    """,
    regex.X,  # values are of ASCII letters only: without case, K and S would stand for U+212A and U+017F too
)
#: What every value has: a digit, an at sign, or the quote in front of a secret.
_MAYBE = regex.compile(r"""[0-9@]|[=:]\s{0,3}["']""")
#: Country codes of one and two digits; all others have three.
_COUNTRIES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}


class Pseudonyms:
    def __init__(self, key: bytes):
        self.key = key
        self.permuted = functools.lru_cache(1 << 16)(self._permuted)

    def _round(self, label: str, k: int, value: int, size: int) -> int:
        mac = hmac.digest(self.key, f"{label}|{k}|{value}".encode(), hashlib.sha256)
        return int.from_bytes(mac + hmac.digest(self.key, mac, hashlib.sha256), "big") % size

    def _permuted(self, label: str, value: int, size: int, back: bool = False) -> int:
        """A keyed permutation of 0 .. size - 1: a Feistel network on a x b >= size, walked until it lands inside."""
        a = 1
        while a * a < size:
            a *= 2
        b = -(-size // a)
        while True:
            # halves of sizes a and b change place each round; with an even number of rounds they end as they began
            left, right = value // b, value % b
            sizes = (a, b)
            for k in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
                if back:
                    left, right = right, left
                    sizes = sizes[::-1]
                    left = (left - self._round(label, k, right, sizes[0])) % sizes[0]
                else:
                    left = (left + self._round(label, k, right, sizes[0])) % sizes[0]
                    left, right = right, left
                    sizes = sizes[::-1]
            value = left * b + right
            if value < size:
                return value

    def letters(self, label: str, text: str, back: bool = False) -> str:
        """Digits, lower and upper letters permuted each among its own kind, all at once; other characters stay."""
        kinds = [next((x for x in (_DIGITS, _LOWER, _UPPER) if c in x), None) for c in text]
        value, size = 0, 1
        for c, kind in zip(text, kinds, strict=True):
            if kind:
                value, size = value * len(kind) + kind.index(c), size * len(kind)
        shape = "".join(kind[0] if kind else c for c, kind in zip(text, kinds, strict=True))
        value = self.permuted(f"{label}|{shape}", value, size, back) if size > 1 else 0
        out = []
        for c, kind in zip(reversed(text), reversed(kinds), strict=True):
            if kind:
                value, k = divmod(value, len(kind))
                c = kind[k]
            out.append(c)
        return "".join(reversed(out))

    def digits(self, label: str, digits: str, back: bool = False) -> str:
        n = len(digits)
        return str(self.permuted(f"{label}|{n}", int(digits), 10**n, back)).zfill(n)

    # a function for each kind: the value's replacement, or None where it doesn't validate

    def card(self, text: str, back: bool) -> str | None:
        digits = _only_digits(text)
        if luhn(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        body = self.digits("card", digits[:-1], back)
        return _filled(text, body + luhn(body))

    def iban(self, text: str, back: bool) -> str | None:
        plain = text.replace(" ", "").upper()
        # check digits 00, 01 and 99 leave the remainder of 97, 98 and 02, which are those that are given out
        if not 15 <= len(plain) <= 34 or _remainder(plain) != 1 or not 2 <= int(plain[2:4]) <= 98:
            return None
        body = self.letters(f"iban|{plain[:2]}", plain[4:], back)
        check = 98 - _remainder(plain[:2] + "00" + body)
        out = iter(plain[:2] + f"{check:02d}" + body)
        return _cased(text, "".join(c if c == " " else next(out) for c in text))

    def ssn(self, text: str, back: bool) -> str | None:
        digits = _only_digits(text)
        valid = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        if not valid(digits):
            return None
        digits = self.digits("ssn", digits, back)
        while not valid(digits):
            digits = self.digits("ssn", digits, back)
        return _filled(text, digits)

    def phone(self, text: str, back: bool) -> str | None:
        digits = _only_digits(text)
        if not 8 <= len(digits) <= 17:
            return None
        country = next((digits[:k] for k in (1, 2) if digits[:k] in _COUNTRIES), digits[:3])
        return _filled(text, country + self.digits(f"phone|+{country}", digits[len(country) :], back))

    def ip(self, text: str, back: bool) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        value = self.permuted("ip", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, back)
        return ".".join(map(str, value.to_bytes(4, "big")))

    def day(self, text: str, back: bool) -> str | None:
        """With slashes the month comes first, unless only the other order is a date.

        Days up to the 12th and later ones are permuted among themselves, so that a date still reads in that order.
        """
        a, b, c = (int(x) for x in regex.split(r"[-./]", text))
        for y, m, d, form in ((a, b, c, "%Y-%m-%d"),) if "-" in text else ((c, b, a, "%d.%m.%Y"),) if "." in text else ((c, a, b, "%m/%d/%Y"), (c, b, a, "%d/%m/%Y")):
            try:
                when = date(y, m, d)
            except ValueError:
                continue
            if not FIRST_DAY.year <= y < LAST_YEAR:
                return None
            months = (y - FIRST_DAY.year) * 12 + m - 1
            if d <= 12:
                months, d = divmod(self.permuted("day|12", months * 12 + d - 1, MONTHS * 12, back), 12)
                new = date(FIRST_DAY.year + months // 12, months % 12 + 1, d + 1)
            else:
                new = _LATE[self.permuted("day|31", _LATE_AT[when], len(_LATE), back)]
            return new.strftime(form)
        return None

    def email(self, text: str, back: bool) -> str | None:
        local, _, domain = text.rpartition("@")
        return f"{_cased(local, self.letters('email|' + domain.lower(), local.translate(_TO_LOWER), back))}@{domain}"

    def secret(self, text: str, back: bool) -> str | None:
        if set(text) <= set(_HEX):
            n = len(text)
            return f"{self.permuted(f'hex|{n}', int(text, 16), 16**n, back):0{n}x}"
        text = self.letters("secret", text, back)
        while set(text) <= set(_HEX):  # those have their own permutation
            text = self.letters("secret", text, back)
        return text

    def replace(self, text: str, back: bool = False) -> tuple[str, Counter]:
        """The text with its pseudonyms (or, with back, its values again), and how many of each kind."""
        found: Counter = Counter()
        if not _MAYBE.search(text):
            return text, found

        def one(m) -> str:
            kind = m.lastgroup
            new = getattr(self, kind)(m[0], back)
            if new is None:
                return m[0]
            found[kind] += 1
            return new

        return _FIND.sub(one, text), found


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def _cased(text: str, new: str) -> str:
    """new, of the same length, in upper and lower case where text is."""
    return "".join(n.upper() if c in _UPPER else n.lower() if c in _LOWER else n for c, n in zip(text, new, strict=True))


def _filled(text: str, digits: str) -> str:
    """The text with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c in _DIGITS else c for c in text)


def luhn(body: str) -> str:
    """The check digit of a number without it."""
    total = sum(d if k % 2 else (2 * d if d < 5 else 2 * d - 9) for k, d in enumerate(map(int, reversed(body))))
    return str(-total % 10)


def _remainder(iban: str) -> int:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97


_kept: dict[bytes, Pseudonyms] = {}


def _replace_rows(key: bytes, back: bool, names: list[str], batches):
    """The kept columns and the new ones; the text comes last."""
    p = _kept.setdefault(key, Pseudonyms(key))
    for batch in batches:
        texts, counts, kinds = [], [], []
        for x in batch.columns[-1]:
            text, found = (None, Counter()) if (t := x.as_py()) is None else p.replace(t, back)
            texts.append(text)
            counts.append(sum(found.values()))
            kinds.append(",".join(f"{k}:{n}" for k, n in sorted(found.items())))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(kinds, pa.string())], names=names)


def pseudonymize(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """docs with text replaced, and n_found and found_kinds ('card:1,email:2') added. A narrow job: no row moves."""
    kept = [c for c in docs.columns if c not in ("text", "n_found", "found_kinds")]
    rows = docs.select(*map(column, kept), F.col("text").alias(fresh(docs, "text")[0]))
    schema = fields(docs, kept, text="string", n_found="long", found_kinds="string")
    return mapped(rows, schema, _replace_rows, key, back)


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents under a key for tests; production passes its own."""
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), b"a key for tests only")
