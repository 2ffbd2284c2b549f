"""PII: format-preserving pseudonyms by a keyed Feistel permutation.

A found value is validated (check digits, ranges, calendar), turned into a number of the values its
format allows, permuted there by a keyed Feistel network and written back in the same format: a card number
becomes another card number with a right check digit and the same separators, a date another date.  The
permutation depends on the key and the kind only, so equal values stay equal across documents, and
different values stay different.  A number that fails its validation is not personal data and stays.

Beside other numbers or upper-case words a card or IBAN can be read in several ways.  Whole groups of digits (or
words) are tried, likely shapes first (for cards one token or the usual grouping, for IBANs the length of the country),
then the longest; the first valid ones that do not overlap count.  Where another reading was refused and the first
pseudonym would make it valid, the permutation is walked on, so the inverse stays exact; only there a value gets
another pseudonym than elsewhere.

Kinds: card (13 to 19 digits, Luhn), iban (mod 97), ssn, phone (international or bracketed area code), ip (IPv4),
date (calendar, 1900 to 2099; it keeps whether month and day are below 10 and the day above 12, so all writings of a day
have one pseudonym; 05/06/2020 is read month first), email (the part before the registered domain), secret (keys and quoted
tokens; each character within its class).  A narrow pass over the documents, nothing is shuffled.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

DEMO_KEY = b"wholesail demonstration key: pass your own"
ROUNDS = 10


class Permutation:
    """Keyed permutation of ``0 .. size - 1`` by a Feistel network with cycle walking."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        self.half = math.isqrt(size - 1) + 1
        self.key = hashlib.blake2b(tweak.encode(), key=hashlib.sha256(key).digest(), digest_size=32).digest()
        self.bytes = (self.half.bit_length() + 7) // 8 + 1
        self.drawn = max(24, self.bytes + 8)  # at least 64 bits more than half has, so that all its digits change alike

    def _round(self, r: int, x: int) -> int:
        given = bytes([r]) + x.to_bytes(self.bytes, "big")
        if self.drawn <= 24:
            h = hashlib.blake2b(given, key=self.key, digest_size=24).digest()
        else:
            h = hashlib.shake_256(self.key + given).digest(self.drawn)
        return int.from_bytes(h, "big") % self.half

    def _forward(self, x: int) -> int:
        a, b = divmod(x, self.half)
        for r in range(ROUNDS):
            a, b = b, (a + self._round(r, b)) % self.half
        return a * self.half + b

    def _backward(self, x: int) -> int:
        a, b = divmod(x, self.half)
        for r in reversed(range(ROUNDS)):
            a, b = (b - self._round(r, a)) % self.half, a
        return a * self.half + b

    def __call__(self, x: int, valid: Callable[[int], bool] | None = None) -> int:
        y = self._forward(x)
        while y >= self.size or (valid is not None and not valid(y)):
            y = self._forward(y)
        return y

    def inverse(self, x: int, valid: Callable[[int], bool] | None = None) -> int:
        y = self._backward(x)
        while y >= self.size or (valid is not None and not valid(y)):
            y = self._backward(y)
        return y


# -- formats -----------------------------------------------------------------------------------
def luhn(digits: str) -> int:
    """Check digit for the digits before it."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_check(country: str, account: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CLASS_OF = {c: k for k in _CLASSES for c in k}


class Pseudonyms:
    def __init__(self, key: bytes = DEMO_KEY, reverse: bool = False):
        self.key, self.reverse = key, reverse
        self.known: dict[tuple[str, int], Permutation] = {}

    def permute(self, tweak: str, x: int, size: int, valid: Callable[[int], bool] | None = None) -> int:
        p = self.known.get((tweak, size))
        if p is None:
            p = self.known[(tweak, size)] = Permutation(self.key, tweak, size)
        return p.inverse(x, valid) if self.reverse else p(x, valid)

    def digits(self, tweak: str, digits: str, valid: Callable[[str], bool] | None = None) -> str:
        n = len(digits)
        ok = None if valid is None else lambda x: valid(str(x).zfill(n))
        return str(self.permute(f"{tweak}/{n}", int(digits), 10**n, ok)).zfill(n)

    def characters(self, tweak: str, text: str, valid: Callable[[str], bool] | None = None) -> str:
        """Each letter and digit within its class, all as one mixed-radix number; other characters stay."""
        shape, x, size = [], 0, 1
        for c in text:
            k = _CLASS_OF.get(c)
            shape.append(k)
            if k:
                x = x * len(k) + k.index(c)
                size *= len(k)
        if size == 1:
            return text
        name = "".join(str(len(k)) + k[0] if k else c for k, c in zip(shape, text, strict=True))

        def written(y: int) -> str:
            out = []
            for k, c in zip(reversed(shape), reversed(text), strict=True):
                if k:
                    y, d = divmod(y, len(k))
                    c = k[d]
                out.append(c)
            return "".join(reversed(out))

        return written(self.permute(f"{tweak}/{name}", x, size, None if valid is None else lambda y: valid(written(y))))

    # each takes a valid card or IBAN and gives the pseudonym that ``stays`` accepts
    def card(self, s: str, stays: Callable[[str], bool]) -> str:
        def written(body: str) -> str:
            return _refill(s, body + str(luhn(body)))

        digits = re.sub(r"\D", "", s)
        return written(self.digits("card", digits[:-1], lambda b: len(set(b + str(luhn(b)))) > 1 and stays(written(b))))

    def iban(self, s: str, stays: Callable[[str], bool]) -> str:
        def written(account: str) -> str:
            it = iter(f"{country}{iban_check(country, account):02d}{account}")
            return "".join(c if c == " " else next(it) for c in s)

        flat = s.replace(" ", "")
        country = flat[:2]
        return written(self.characters(f"iban/{country}", flat[4:], lambda a: stays(written(a))))

    def among_readings(self, kind: str, text: str, found: list[tuple[int, int, str, str]]) -> Iterator[tuple[int, int, str, str]]:
        """The cards or IBANs of ``text`` that do not overlap ``found``."""
        readings, valid, write = (_card_readings, _card, self.card) if kind == "card" else (_iban_readings, _iban, self.iban)
        for lo, hi, ordered in readings(text):
            now, covered = text[lo:hi], bytearray(hi - lo)
            for b, e, _, _ in found:
                if b < hi and lo < e:
                    covered[max(b, lo) - lo : min(e, hi) - lo] = b"\1" * (min(e, hi) - max(b, lo))
            taken: list[tuple[int, int, list[tuple[int, int]]]] = []
            refused: dict[int, list[int]] = {}  # ends by start
            for b, e in ordered:
                if 1 in covered[b:e]:
                    continue
                if valid(now[b:e]):
                    covered[b:e] = b"\1" * (e - b)
                    taken.append((b, e, [(x, y) for x in range(max(0, b - WIDEST), e) for y in refused.get(x, ()) if b < y]))
                else:
                    refused.setdefault(b, []).append(e)
            # one after the other: a pseudonym must leave the refused readings that it touches refused, and the
            # inverse meets the same neighbours on its way back
            for b, e, rivals in reversed(taken) if self.reverse else taken:
                def stays(new: str, b: int = b, e: int = e, rivals: list[tuple[int, int]] = rivals, now: str = now) -> bool:
                    return not rivals or not any(valid((now[:b] + new + now[e:])[x:y]) for x, y in rivals)

                now = now[:b] + write(now[b:e], stays) + now[e:]
            for b, e, _ in taken:
                yield lo + b, lo + e, kind, now[b:e]

    # each takes the matched text and gives its pseudonym, or None if it is not valid
    def ssn(self, m: re.Match) -> str | None:
        digits = m[0].replace("-", "")
        return _refill(m[0], self.digits("ssn", digits, _ssn)) if _ssn(digits) else None

    def phone(self, m: re.Match) -> str | None:
        s = m[0]
        digits = re.sub(r"\D", "", s)
        head = len(m["country"] or "")
        if not 9 <= len(digits) <= 15 or len(digits) - head < 7:
            return None
        return _refill(s, digits[:head] + self.digits(f"phone/{digits[:head]}", digits[head:]))

    def ip(self, m: re.Match) -> str | None:
        parts = [int(x) for x in m[0].split(".")]
        if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in m[0].split(".")):
            return None
        y = self.permute("ip", int.from_bytes(bytes(parts), "big"), 2**32)
        return ".".join(str(b) for b in y.to_bytes(4, "big"))

    def date(self, m: re.Match) -> str | None:
        s = m[0]
        sep = re.search(r"\D", s)[0]
        a, b, c = s.split(sep)
        form = "ymd" if len(a) == 4 else "mdy" if sep == "/" and int(a) <= 12 else "dmy"
        y, mo, d = (a, b, c) if form == "ymd" else (c, a, b) if form == "mdy" else (c, b, a)
        try:
            day = dt.date(int(y), int(mo), int(d))
        except ValueError:
            return None
        if not FIRST <= day <= LAST:
            return None
        x = self.permute("date/any", (day - FIRST).days, (LAST - FIRST).days + 1, lambda x: _date_class(FIRST + dt.timedelta(x)) == _date_class(day))
        new = FIRST + dt.timedelta(x)
        y, mo, d = f"{new.year:04d}", f"{new.month:0{len(mo)}d}", f"{new.day:0{len(d)}d}"
        return sep.join((y, mo, d) if form == "ymd" else (mo, d, y) if form == "mdy" else (d, mo, y))

    def email(self, m: re.Match) -> str | None:
        local, host = m[0].split("@")
        labels = host.split(".")
        head = labels[:-2]
        new = self.characters("email", ".".join(["@".join([local, *head[:1]]), *head[1:]]) if head else local + "@")
        local_new, _, head_new = new.partition("@")
        return local_new + "@" + ".".join([*([head_new] if head_new else []), *labels[-2:]])

    def secret(self, m: re.Match) -> str | None:
        s, at = m["value"], m.start("value") - m.start()
        return m[0][:at] + self.characters("secret", s) + m[0][at + len(s) :]

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """``start, end, kind, pseudonym`` of what is found, in text order, not overlapping; a kind named earlier in
        ``KINDS`` wins."""
        found: list[tuple[int, int, str, str]] = []
        if not _ANY.search(text):
            return found
        for kind, pattern in KINDS:
            if kind in ("card", "iban"):
                found += list(self.among_readings(kind, text, found))
                continue
            for m in pattern.finditer(text):
                if any(m.start() < e and b < m.end() for b, e, _, _ in found):
                    continue
                new = getattr(self, kind)(m)
                if new is not None:
                    found.append((m.start(), m.end(), kind, new))
        return sorted(found)

    def apply(self, text: str | None) -> tuple[str | None, list[tuple[int, int, str, str]]]:
        found = self.spans(text) if text else []
        if not found:
            return text, found
        out, at = [], 0
        for b, e, _, new in found:
            out += [text[at:b], new]
            at = e
        return "".join([*out, text[at:]]), found


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _card(s: str) -> bool:
    digits = re.sub(r"\D", "", s)
    return 13 <= len(digits) <= 19 and luhn(digits[:-1]) == int(digits[-1]) and len(set(digits)) > 1


def _iban(s: str) -> bool:
    flat = s.replace(" ", "")
    return 15 <= len(flat) <= 34 and int(flat[2:4]) == iban_check(flat[:2], flat[4:])


# Both give ``start, end`` of each run and the readings in it (places in the run), the likeliest first.  They look at
# the shape only (and an IBAN's country), which pseudonyms keep.
def _card_readings(text: str) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    for run in _CARD_RUN.finditer(text):
        s = run[0]
        groups = [(g.start(), g.end()) for g in re.finditer(r"[0-9]+", s)]
        ordered = []
        for i, (b, _) in enumerate(groups):
            n, sizes = 0, []
            for j in range(i, len(groups)):
                e = groups[j][1]
                sizes.append(e - groups[j][0])
                n += sizes[-1]
                if n > 19:
                    break
                if n < 13:
                    continue
                alike = len({s[groups[k][1]] for k in range(i, j)}) < 2
                # blanks and hyphens in one number: only between blanks, as two phone numbers or dates in a row are
                if alike or (s[b - 1 : b] != "-" and s[e : e + 1] != "-"):
                    usual = alike and tuple(sizes) in _USUAL or len(sizes) == 1
                    ordered.append((not usual, -n, b, e))
        yield run.start(), run.end(), [(b, e) for _, _, b, e in sorted(ordered)]


def _iban_readings(text: str) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    runs: list[tuple[int, int, list[tuple[bool, int, int, int]]]] = []
    m = _IBAN_RUN.search(text)
    while m:
        s, b = m[0], m.start()
        fixed = IBAN_LENGTHS.get(s[:2])
        ordered, n = [], 0
        for k, c in enumerate(s):
            n += c != " "
            end = k + 1 == len(s) or s[k + 1] == " "
            # a known country's other lengths are no IBANs, but for the whole match
            if c != " " and end and n >= 15 and (fixed is None or n == fixed or k + 1 == len(s)):
                ordered.append((n != fixed, b, -n, b + k + 1))
        if runs and b < runs[-1][1]:
            lo, hi, before = runs[-1]
            before += ordered
            runs[-1] = (lo, max(hi, m.end()), before)
        else:
            runs.append((b, m.end(), ordered))
        m = _IBAN_RUN.search(text, b + 1)
    for lo, hi, ordered in runs:
        yield lo, hi, [(b - lo, e - lo) for _, b, _, e in sorted(ordered)]


def _date_class(day: dt.date) -> tuple[bool, bool, bool]:
    """What a date keeps: a month and a day of one digit can be written so again, and 13/02/2020 can only be read day first."""
    return day.month < 10, day.day < 10, day.day > 12


def _ssn(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


FIRST, LAST = dt.date(1900, 1, 1), dt.date(2099, 12, 31)
# what every pattern below needs: a digit, @, the = or : of a secret, AKIA or ASIA; one class at the front is searched fast
_ANY = re.compile(r"[0-9@=:A](?:(?<!A)|[KS]IA)")
_IBAN_RUN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_CARD_RUN = re.compile(r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,}(?![0-9A-Za-z]|[.-][0-9])")
WIDEST = 64  # characters of the widest reading: 34 of an IBAN, each after a blank
_USUAL = {(4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4), (4, 4, 4, 1), (4, 4, 5), (4, 5, 6)}
#: Characters of a country's IBANs; other countries are taken at any length.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23,
    "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28,
    "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
KINDS = [
    ("email", re.compile(r"(?<![\w.%+-])[\w%+-]+(?:\.[\w%+-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])")),
    ("secret", re.compile(r"\b(?:AKIA|ASIA)(?P<value>[0-9A-Z]{16})\b")),
    ("secret", re.compile(r"(?i:\b(?:password|passwd|pwd|secret|api[_-]?key|token)\b)\s*[=:]\s*[\"']?(?P<value>[A-Za-z0-9_/+-]{8,})")),
    ("iban", _IBAN_RUN),
    ("card", _CARD_RUN),
    ("date", re.compile(r"(?<![0-9./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([/.-])[0-9]{1,2}\2[0-9]{4})(?![0-9]|[./-][0-9])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z+])(?:\+(?P<country>1|7|[2-9][0-9]{1,2})[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?)[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z+])\+(?P<country>1|7|[2-9][0-9])[ .-]?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z+.-])(?P<country>)[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9]|[.-][0-9])")),
]
RESULT = "doc_id long, text string, n_found int, kinds array<string>, starts array<int>, ends array<int>"


def pseudonymise(docs: DataFrame, key: bytes = DEMO_KEY, reverse: bool = False) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ..)``: ``doc_id, text`` with pseudonyms, ``n_found``, and by find in
    text order ``kinds, starts, ends`` (places in the given text).  ``reverse`` with the same key undoes it.

    Null texts stay null, empty ones empty; repeated rows and null ids stay; other columns are ignored; an
    empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, reverse)
        for part in slices(batches):
            made = [names.apply(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array([t for t, _ in made], pa.string()), pa.array([len(f) for _, f in made], pa.int32()),
                    pa.array([[x[2] for x in f] for _, f in made], pa.list_(pa.string())),
                    pa.array([[x[0] for x in f] for _, f in made], pa.list_(pa.int32())),
                    pa.array([[x[1] for x in f] for _, f in made], pa.list_(pa.int32())),
                ],
                ["doc_id", "text", "n_found", "kinds", "starts", "ends"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, RESULT)


def pseudonymise_column(docs: DataFrame, column: str = "text", key: bytes = DEMO_KEY) -> DataFrame:
    """``docs`` with ``column`` pseudonymised, ``n_chars`` following it where it is there; other columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for part in slices(batches, column):
            at = part.schema.get_field_index(column)
            new = pa.array([names.apply(t)[0] for t in part.column(at).to_pylist()], part.schema.field(at).type)
            yield part.set_column(at, part.schema.field(at), new)

    out = docs.mapInArrow(run, docs.schema)
    if column == "text" and "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length(column).cast(docs.schema["n_chars"].dataType)))
    return out
