"""Format-preserving pseudonyms for personal numbers and dates by keyed Feistel permutations.

A value that is valid for its kind (Luhn digit, octets, IBAN check, calendar) is mapped to another
valid value of the same kind and layout. The map is a keyed bijection of the kind's values, so equal
values stay equal over all documents and whoever has the key can take the map back.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.llm.common import map_arrow

ROUNDS = 10
#: Days that a date may become, from FIRST_DAY on: 1900-01-01 to 2099-12-31.
FIRST_DAY, DAYS = dt.date(1900, 1, 1).toordinal(), 73_049

NUMBERS = re.compile(
    r"(?<![\w.+-])(?:"
    r"(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
    r"|(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?![\w]|\.\d)"
    r"|(?P<phone>(?:\+1[ .-]?)?\(\d{3}\) ?\d{3}-\d{4}|(?:\+1[ .-])?\d{3}[.-]\d{3}[.-]\d{4}|\+[1-9]\d{0,2}(?:[ .-]?\d{2,4}){3,5})(?![\w-])"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?P<iso>\d{4}-\d{2}-\d{2})(?![\d-])"
    r"|(?P<day>\d{2}(?P<s>[/.])\d{2}(?P=s)\d{4})(?!\w)"
    r"|(?P<card>\d{13,19}|\d{4}([ -])\d{4}\9\d{4}\9\d{1,7}|\d{4}([ -])\d{6}\10\d{5})(?!\w)"
    r")"
)
EMAIL = re.compile(r"(?<![\w.+-])(?P<local>[A-Za-z0-9][A-Za-z0-9._+-]*)(?P<at>@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})(?!\w)")


class Feistel:
    """A keyed permutation of range(a * b): alternating rounds add a keyed hash of one part to the other."""

    def __init__(self, key: bytes, tweak: str) -> None:
        self.key, self.tweak = hashlib.blake2b(key, digest_size=32).digest(), tweak.encode()

    def _round(self, i: int, value: int) -> int:
        return int.from_bytes(hashlib.blake2b(self.tweak + b"/%d/%d" % (i, value), key=self.key, digest_size=32).digest(), "big")

    def permute(self, value: int, a: int, b: int, back: bool = False) -> int:
        x, y = divmod(value, b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if i % 2:
                y = (y + (-1 if back else 1) * self._round(i, x)) % b
            else:
                x = (x + (-1 if back else 1) * self._round(i, y)) % a
        return x * b + y

    def digits(self, text: str, back: bool = False) -> str:
        """A permutation of the digit strings of one length."""
        half = 10 ** (len(text) // 2)
        return str(self.permute(int(text), 10 ** (len(text) - len(text) // 2), half, back)).zfill(len(text)) if text else text

    def below(self, value: int, n: int, back: bool, ok: Callable[[int], bool] = lambda _: True) -> int:
        """A permutation of the values in range(n) that are ok, walking cycles of a larger range."""
        side = int(n**0.5) + 1
        while True:
            value = self.permute(value, side, side, back)
            if value < n and ok(value):
                return value


#: The country calling codes of one and two digits; all others have three.
SHORT_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def calling_code(digits: str) -> str | None:
    """The country calling code that an international number begins with; None if no zone is behind it."""
    if digits[:1] in ("", "0"):
        return None
    return next((digits[:n] for n in (1, 2) if digits[:n] in SHORT_CODES), digits[:3])


def luhn_digit(body: str) -> str:
    """The check digit that makes a number valid."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c)
        total += d if i % 2 else (2 * d - 9 if d > 4 else 2 * d)
    return str(-total % 10)


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in f'{rest}{country}00')) % 97:02d}"


def _laid_out(layout: str, digits: str) -> str:
    """Digits put in the places of a layout's digits."""
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in layout)


def _date(text: str, pattern: str) -> dt.date | None:
    try:
        d = dt.datetime.strptime(text, pattern).date()
    except ValueError:
        return None
    return d if 0 <= d.toordinal() - FIRST_DAY < DAYS else None


class Pseudonyms:
    """Maps the values found in a text; ``back`` takes the map back."""

    def __init__(self, key: bytes, back: bool = False) -> None:
        self.key, self.back = key, back
        self.cache: dict[tuple[str, str], str | None] = {}

    def value(self, kind: str, text: str) -> str | None:
        """The pseudonym of a value, or None if it isn't valid for its kind."""
        if (kind, text) not in self.cache:
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[kind, text] = self._value(kind, text)
        return self.cache[kind, text]

    def _value(self, kind: str, text: str) -> str | None:
        digits = re.sub(r"\D", "", text) if kind != "iban" else ""
        f = Feistel(self.key, kind if kind == "ip" else f"{kind}/{len(digits)}")
        if kind == "card":
            if luhn_digit(digits[:-1]) != digits[-1] or not int(digits):
                return None
            body = f.digits(digits[:-1], self.back)
            return _laid_out(text, body + luhn_digit(body))
        if kind == "ip":
            parts = [int(x) for x in text.split(".")]
            if max(parts) > 255 or any(str(p) != x for p, x in zip(parts, text.split("."), strict=True)):
                return None
            out = f.permute(int.from_bytes(bytes(parts), "big"), 1 << 16, 1 << 16, self.back)
            return ".".join(map(str, out.to_bytes(4, "big")))
        if kind == "phone":
            country = calling_code(digits) if text.startswith("+") else ""
            if country is None or not 7 <= len(digits) - len(country) or len(digits) > 15:
                return None
            f = Feistel(self.key, f"phone/{country}/{len(digits)}")
            return _laid_out(text, country + f.digits(digits[len(country) :], self.back))
        if kind == "ssn":
            ok = lambda n: (s := f"{n:09d}")[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
            return _laid_out(text, f"{f.below(int(digits), 10**9, self.back, ok):09d}") if ok(int(digits)) else None
        if kind == "iban":
            plain = text.replace(" ", "")
            country, check, rest = plain[:2], plain[2:4], plain[4:]
            if not 15 <= len(plain) <= 34 or iban_check(country, rest) != check:
                return None
            f = Feistel(self.key, f"iban/{country}/{re.sub('[0-9]', '0', rest)}")
            rest = _laid_out(rest, f.digits(re.sub(r"\D", "", rest), self.back))
            left = iter(country + iban_check(country, rest) + rest)
            return "".join(c if c == " " else next(left) for c in text)
        if kind == "email":
            f = Feistel(self.key, "email/" + re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", text))))
            sizes = [26 if c.isalpha() else 10 if c.isdigit() else 1 for c in text]
            firsts = [ord("a" if c.islower() else "A" if c.isalpha() else "0" if c.isdigit() else c) for c in text]
            number, low, high, half = 0, 1, 1, sum(s > 1 for s in sizes) // 2
            seen = 0
            for c, s, first in zip(text, sizes, firsts, strict=True):
                number = number * s + ord(c) - first
                seen += s > 1
                low, high = (low * s, high) if seen > half else (low, high * s)
            number = f.permute(number, high, low, self.back)
            out = []
            for s, first in zip(reversed(sizes), reversed(firsts), strict=True):
                number, d = divmod(number, s)
                out.append(chr(first + d))
            return "".join(reversed(out))
        if kind == "iso":
            forms = ["%Y-%m-%d"]
        else:
            forms = [f"%d{text[2]}%m{text[2]}%Y", f"%m{text[2]}%d{text[2]}%Y"]
        for i, form in enumerate(forms):
            if (d := _date(text, form)) is not None:
                as_text = lambda n, form=form: dt.date.fromordinal(FIRST_DAY + n).strftime(form)
                ok = (lambda n: _date(as_text(n), forms[0]) is None) if i else (lambda n: True)
                return as_text(f.below(d.toordinal() - FIRST_DAY, DAYS, self.back, ok))
        return None

    def text(self, text: str) -> tuple[str, Counter]:
        """The text with each valid value replaced, and how many of each kind."""
        found: Counter = Counter()

        def number(m: re.Match) -> str:
            kind = "date" if m.lastgroup in ("iso", "day", "s") else next(k for k in ("iban", "ip", "phone", "ssn", "card") if m[k])
            got = self.value("iso" if m["iso"] else "day" if m["day"] else kind, m[0])
            if got is None:
                return m[0]
            found[kind] += 1
            return got

        def email(m: re.Match) -> str:
            got = self.value("email", m["local"])
            found["email"] += 1
            return got + m["at"]

        if "@" in text:
            text = EMAIL.sub(email, text)
        return NUMBERS.sub(number, text), found


def pseudonymise(docs: DataFrame, key: str = "a key that production takes from its key store", back: bool = False, counts: str = "pii") -> DataFrame:
    """Replace text, and add pii (how many of each kind, as map<string,int>), under this or a given name.

    All columns stay, whatever their names (an existing one of that name is replaced). Kinds: card (Luhn), ip,
    phone, ssn, iban, date (dd before mm where both are possible) and email (the part before the @;
    letters stay letters, digits digits). Numbers that aren't valid for a kind stay. Null texts stay
    null and have no pii; empty texts stay empty. Repeated rows get equal results; an empty table
    gives an empty one. Texts are scanned whole, however long.
    """
    kept = [c for c in docs.columns if c != counts]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + f", `{counts}` map<string,int>"
    at, secret = kept.index("text"), key.encode()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = _held.setdefault((secret, back), Pseudonyms(secret, back))
        got = [(None, Counter()) if x is None else p.text(x) for x in batch.column(at).to_pylist()]
        columns = list(batch.columns)
        columns[at] = pa.array([t for t, _ in got], batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays([*columns, pa.array([list(n.items()) for _, n in got], pa.map_(pa.string(), pa.int32()))], [*kept, counts])

    return map_arrow(docs.select(*[F.col(f"`{c}`") for c in kept]), run, schema)


_held: dict[tuple[bytes, bool], Pseudonyms] = {}


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_found, the kinds with their counts, the text and its SHA-256, for each document.

    A null text counts as empty; repeated rows come out as often as they went in; other columns are not read.
    """
    out = pseudonymise(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    entries = F.array_sort(F.map_entries("pii"))
    return out.select(
        "doc_id",
        F.aggregate(entries, F.lit(0), lambda n, e: n + e["value"]).cast("bigint").alias("n_found"),
        F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias("kinds"),
        F.sha2("text", 256).alias("text_sha256"),
        "text",
    )
