"""Personal data: format-preserving pseudonyms from a keyed Feistel permutation.

Every kind has a validator, so an order number that only looks like a card stays.
What is validated is permuted inside its own format: digits become digits of the same
count and grouping, check digits are made valid again, a date stays a date, an address
part stays in range, letters and digits of a mail name keep their kinds.  The
permutation depends on key, kind and length only, so equal values get equal
pseudonyms in every document and can be undone with the key.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .columns import with_text

ROUNDS = 8
_DAY0, _DAYS = datetime.date(1900, 1, 1).toordinal(), 73_049  # 1900-01-01 to 2099-12-31
_MAIL = "abcdefghijklmnopqrstuvwxyz"


class Feistel:
    """A keyed permutation of 0 .. size - 1: a balanced network over the next even number of bits, walked until it is inside."""

    def __init__(self, key: bytes, tweak: str, size: int):
        if size < 1:
            raise ValueError("empty domain")
        self.size = size
        self.half = max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.keys = [hashlib.blake2b(f"{tweak}:{size}:{r}".encode(), key=key, digest_size=16).digest() for r in range(ROUNDS)]

    def _round(self, r: int, x: int) -> int:
        n = (self.half + 7) // 8
        return int.from_bytes(hashlib.blake2b(x.to_bytes(n, "big"), key=self.keys[r], digest_size=max(n, 8)).digest(), "big") & self.mask

    def apply(self, x: int) -> int:
        while True:
            left, right = x >> self.half, x & self.mask
            for r in range(ROUNDS):
                left, right = right, left ^ self._round(r, right)
            x = left << self.half | right
            if x < self.size:
                return x

    def undo(self, x: int) -> int:
        while True:
            left, right = x >> self.half, x & self.mask
            for r in reversed(range(ROUNDS)):
                left, right = right ^ self._round(r, left), left
            x = left << self.half | right
            if x < self.size:
                return x


def luhn_digit(body: str) -> int:
    """The check digit that makes ``body`` + digit valid."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_check(country: str, body: str) -> str:
    """The two check digits of an account number by country."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


class Pseudonyms:
    """Finds and replaces; one per worker and key, pseudonyms are remembered up to a bound."""

    KINDS = ("mail", "iban", "card", "ssn", "phone", "ip", "date")
    PATTERN = re.compile(
        r"(?P<mail>(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]*[A-Za-z0-9]@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}(?![A-Za-z0-9]))"
        r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
        r"|(?P<phone>(?<![\w+])\+1[ .\-]?(?:\(\d{3}\)|\d{3})[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)|(?<![\w+])\+(?!1[ .\-(])\d{1,3}[ .\-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .\-]?\d{2,4}){2,3}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\w.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-]))"
        r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"
        r"|(?P<ssn>(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-]))"
        r"|(?P<date>(?<![\w\-/.])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w\-/]|\.\d))"
        r"|(?P<card>(?<![\w\-.])\d(?:[ \-]?\d){12,18}(?![\w\-]|\.\d))",
        re.ASCII,
    )
    TRACE = re.compile("[0-9@]")
    REMEMBER = 100_000

    def __init__(self, key: bytes):
        self.key = key
        self._known: dict[tuple[str, str], str | None] = {}

    @lru_cache(maxsize=512)  # noqa: B019  one object per worker
    def _perm(self, tweak: str, size: int) -> Feistel:
        return Feistel(self.key, tweak, size)

    def _digits(self, kind: str, digits: str) -> str:
        return f"{self._perm(kind, 10 ** len(digits)).apply(int(digits)):0{len(digits)}d}" if digits else ""

    @staticmethod
    def _refill(shape: str, chars: str) -> str:
        it = iter(chars)
        return "".join(next(it) if c.isalnum() else c for c in shape)

    def _mail(self, v: str) -> str | None:
        name, _, host = v.rpartition("@")
        if len(name) > 64:
            return None
        letters = [c for c in name if c.isalpha()]
        digits = [c for c in name if c.isdigit()]
        number = 0
        for c in letters:
            number = number * 26 + _MAIL.index(c.lower())
        # letters and digits together are one number in a mixed radix
        size = 26 ** len(letters) * 10 ** len(digits)
        x = self._perm(f"mail{len(letters)}.{len(digits)}@{host.lower()}", size).apply(number * 10 ** len(digits) + int("".join(digits) or "0"))
        number, tail = divmod(x, 10 ** len(digits))
        out_digits = iter(f"{tail:0{len(digits)}d}" if digits else "")
        out_letters = []
        for c in reversed(letters):
            number, k = divmod(number, 26)
            out_letters.append(_MAIL[k].upper() if c.isupper() else _MAIL[k])
        it = iter(reversed(out_letters))
        return "".join(next(it) if c.isalpha() else next(out_digits) if c.isdigit() else c for c in name) + "@" + host

    def _iban(self, v: str) -> str | None:
        flat = v.replace(" ", "")
        if not 15 <= len(flat) <= 34 or iban_check(flat[:2], flat[4:]) != flat[2:4]:
            return None
        body = flat[4:]
        digits = "".join(c for c in body if c.isdigit())
        it = iter(self._digits("iban" + flat[:2], digits))
        body = "".join(next(it) if c.isdigit() else c for c in body)
        return self._refill(v, flat[:2] + iban_check(flat[:2], body) + body)

    def _card(self, v: str) -> str | None:
        flat = re.sub("[^0-9]", "", v)
        if not 13 <= len(flat) <= 19 or luhn_digit(flat[:-1]) != int(flat[-1]) or not flat.strip("0"):
            return None
        body = flat[0] + self._digits("card" + flat[0], flat[1:-1])
        return self._refill(v, body + str(luhn_digit(body)))

    def _ssn(self, v: str) -> str | None:
        area, group, serial = map(int, v.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        n = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        n, serial = divmod(self._perm("ssn", 898 * 99 * 9999).apply(n), 9999)
        area, group = divmod(n, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def _phone(self, v: str) -> str | None:
        flat = re.sub("[^0-9]", "", v)
        lead = len(re.match(r"\+(\d{1,3})(?=[ .\-(])", v)[1]) if re.match(r"\+\d{1,3}[ .\-(]", v) else int(v[0] == "+")
        if not 8 <= len(flat) <= 15:
            return None
        return self._refill(v, flat[:lead] + self._digits("phone" + flat[:lead], flat[lead:]))

    def _ip(self, v: str) -> str | None:
        parts = v.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        n = int.from_bytes(bytes(map(int, parts)), "big")
        return ".".join(map(str, self._perm("ip", 1 << 32).apply(n).to_bytes(4, "big")))

    def _date(self, v: str) -> str | None:
        sep = next(c for c in v if not c.isdigit())
        a, b, c = map(int, v.split(sep))
        try:
            if sep == "-":
                day, order = datetime.date(a, b, c), "ymd"
            elif sep == ".":
                day, order = datetime.date(c, b, a), "dmy"
            else:
                day, order = (datetime.date(c, a, b), "mdy") if a <= 12 else (datetime.date(c, b, a), "dmy")
        except ValueError:
            return None
        if not 0 <= day.toordinal() - _DAY0 < _DAYS:
            return None
        # m/d is kept apart from d/m by the day: what could be read either way stays so
        perm = self._perm("date", _DAYS)
        n = day.toordinal() - _DAY0
        while True:
            n = perm.apply(n)
            new = datetime.date.fromordinal(n + _DAY0)
            if sep != "/" or (new.day <= 12 if order == "mdy" and b <= 12 else new.day > 12):
                break
        wide = len(v) == 10
        put = {"y": f"{new.year:04d}", "m": f"{new.month:02d}" if wide else str(new.month), "d": f"{new.day:02d}" if wide else str(new.day)}
        return sep.join(put[x] for x in order)

    def pseudonym(self, kind: str, value: str) -> str | None:
        """The pseudonym of a value, None where it is not valid."""
        k = (kind, value)
        if k not in self._known:
            if len(self._known) >= self.REMEMBER:
                self._known.clear()
            self._known[k] = getattr(self, f"_{kind}")(value)
        return self._known[k]

    def _shorter(self, m: re.Match) -> str | None:
        """The longest valid card number that ends at a separator inside an invalid match."""
        for i in range(len(m[0]) - 1, 12, -1):
            if m[0][i] in " -" and self.pseudonym("card", m[0][:i]) is not None:
                return m[0][:i]
        return None

    def _line(self, line: str, size: int, found: list[dict]) -> str:
        out, at, pos = [], 0, 0
        while (m := self.PATTERN.search(line, pos)) is not None:
            kind, value = m.lastgroup, m[0]
            new = self.pseudonym(kind, value)
            if new is None and kind == "card" and (value := self._shorter(m)) is not None:
                new = self.pseudonym(kind, value)
            if new is None:  # an invalid candidate may hide a valid one that begins inside it
                pos = m.start() + 1
                continue
            out.append(line[at : m.start()])
            size += m.start() - at
            found.append({"kind": kind, "first": size, "last": size + len(new)})
            out.append(new)
            size += len(new)
            at = pos = m.start() + len(value)
        return "".join(out) + line[at:] if out else line

    def replace(self, text: str | None) -> tuple[str | None, list[dict]]:
        """The text with pseudonyms, and what was replaced: kind and place in the new text.

        No kind spans lines, and a line without a digit or an at sign holds none.
        """
        found: list[dict] = []
        if not text or not self.TRACE.search(text):
            return text, found
        lines, size = text.split("\n"), 0
        for i, line in enumerate(lines):
            if self.TRACE.search(line):
                lines[i] = self._line(line, size, found)
            size += len(lines[i]) + 1
        return "\n".join(lines), found


@lru_cache(maxsize=4)
def pseudonyms(key: bytes) -> Pseudonyms:
    return Pseudonyms(key)


def pseudonymize(docs: DataFrame, key: bytes, text_col: str = "text", out_col: str = "clean_text") -> DataFrame:
    """``docs`` with ``out_col`` and ``pii``: what was replaced (kind, first and last place in the new text).

    One pass over the rows, no shuffle.  A null text stays null and an empty one
    empty, with an empty list; repeated rows come back as often as they came; other
    columns pass through, but columns of these two names are replaced (``out_col`` may
    name the text itself).  An empty table gives an empty one.
    """
    spans = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
    rows, fields, place = with_text(docs, text_col, [out_col, "pii"])
    schema = T.StructType([*fields, T.StructField(out_col, T.StringType()), T.StructField("pii", spans)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))

    def run(batches):
        own = pseudonyms(key)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                done = [own.replace(t) for t in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(fields)], pa.array([t for t, _ in done], pa.string()), pa.array([f for _, f in done], kind)], names=schema.names)

    return rows.mapInArrow(run, schema)
