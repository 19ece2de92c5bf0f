"""PII replaced by format-preserving Feistel pseudonyms.

E-mail addresses, IPv4 addresses, payment card numbers (Luhn), IBANs
(mod 97), social security numbers, phone numbers, dates and credentials are found and validated. Each is permuted, under a key,
within the set of values of its own format: a card number stays a valid card
number, a date a date, an address keeps its length, letters and digits. The
permutation depends only on the key and the value, so equal values get equal
pseudonyms in every document, with no table to share and no exchange. A date
gets one pseudonym however it is spelt: days up to the 12th are permuted among
themselves and so are the others, so that a date that reads day first or
month first reads so again and no two dates of a spelling become one.

The permutation is a ten-round Feistel network over the next even number of
bits, walked until it falls into the set again, so it is one-to-one. (A value
is its own pseudonym with a chance of one in the size of its set.)

Defined results: null stays null, empty stays empty; a value that fails
validation (a wrong check digit, a date of a 13th month, an octet over 255)
is no PII and stays; digits are ASCII ones; secrets may be of any length; a date may have its month's
English name; an IBAN ends where it is valid, whatever follows; of overlapping finds the earlier, then the longer counts.
Repeated rows change alike. All columns stay; only the text changes.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import secrets
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quern.llm.common import map_arrow, narrow

ROUNDS = 10


_OWN_KEYS: dict[str, bytes] = {}


def as_key(secret: bytes) -> bytes:
    """A key of any length as one the hash takes whole; none is empty."""
    if not secret:
        raise ValueError("the key of the pseudonyms is empty")
    return secret if len(secret) <= 64 else hashlib.blake2b(secret).digest()


def session_key(spark: SparkSession) -> bytes:
    """The session's `quern.pii.key`; without one, a random key that lasts as long as the application.

    Pseudonyms of different applications link only under a key that is set.
    """
    given = spark.conf.get("quern.pii.key", None)
    if given is not None:
        return as_key(given.encode())
    return _OWN_KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def permute(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed one-to-one map of range(size)."""
    if size <= 1:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8

    def once(x: int) -> int:
        a, b = x >> half, x & mask
        for r in range(ROUNDS):
            f = hashlib.blake2b(bytes([r]) + tweak + b.to_bytes(width, "big"), key=key, digest_size=max(8, width)).digest()
            a, b = b, a ^ (int.from_bytes(f, "big") & mask)
        return a << half | b

    x = once(value)
    while x >= size:
        x = once(x)
    return x


_DIGITS = frozenset("0123456789")


def digits_of(s: str) -> str:
    return "".join(c for c in s if c in _DIGITS)


def _with_digits(s: str, digits: str) -> str:
    """`s` with other digits; what stands between them stays."""
    new = iter(digits)
    return "".join(next(new) if c in _DIGITS else c for c in s)


def _digits(s: str, key: bytes, tweak: bytes) -> str:
    """Digits permuted among all strings of as many digits."""
    ds = digits_of(s)
    return _with_digits(s, str(permute(int(ds), 10 ** len(ds), key, tweak + bytes([len(ds)]))).zfill(len(ds)))


#: Social security numbers: areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999.
_AREAS, _GROUPS, _SERIALS = 898, 99, 9999


def _ssn(s: str, key: bytes) -> str:
    """A valid number becomes a valid number."""
    area, group, serial = int(s[:3]), int(s[4:6]), int(s[7:])
    value = ((area - 1 - (area > 666)) * _GROUPS + group - 1) * _SERIALS + serial - 1
    rest, serial = divmod(permute(value, _AREAS * _GROUPS * _SERIALS, key, b"ssn"), _SERIALS)
    area, group = divmod(rest, _GROUPS)
    area += 1 + (area >= 665)
    return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _card(s: str, key: bytes) -> str | None:
    """A valid number keeps its first digit, its length and its validity; any other is no card number."""
    ds = digits_of(s)
    if luhn_digit(ds[:-1]) != ds[-1]:
        return None
    body = ds[0] + _digits(ds[1:-1], key, b"card" + ds[0].encode())
    return _with_digits(s, body + luhn_digit(body))


#: The octets of one, two and three digits.
_OCTETS = ((0, 10), (10, 90), (100, 156))


def _ip(s: str, key: bytes) -> str | None:
    """Each octet stays within those of as many digits; None if one is over 255 or has a leading zero."""
    parts = s.split(".")
    value, size = 0, 1
    for p in parts:
        low, n = _OCTETS[len(p) - 1]
        if not low <= int(p) < low + n:
            return None
        value, size = value * n + int(p) - low, size * n
    new = permute(value, size, key, b"ip" + bytes(map(len, parts)))
    out = []
    for p in reversed(parts):
        low, n = _OCTETS[len(p) - 1]
        new, i = divmod(new, n)
        out.append(str(low + i))
    return ".".join(reversed(out))


#: The alphabets within which the characters of an address or a credential are permuted.
_ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
_PLACE = {c: (a, i) for a in _ALPHABETS for i, c in enumerate(a)}
_HEX = "0123456789abcdef"


#: Characters that are permuted as one number; a half of it fits a digest.
_PIECE = 200


def _template(s: str, key: bytes, tweak: bytes, place: dict[str, tuple[str, int]] = _PLACE) -> str:
    """Each character stays in its alphabet; others stay.

    A long value goes piece by piece, forth and back, under a digest of the
    pieces before: one-to-one, in linear time, and each piece depends on all.
    """
    if len(s) <= _PIECE:
        return _template_piece(s, key, tweak, place)
    pieces = [s[i : i + _PIECE] for i in range(0, len(s), _PIECE)]
    for way in (b"forth", b"back"):
        before = hashlib.blake2b(way + tweak + str(len(s)).encode())
        for i, piece in enumerate(pieces):
            pieces[i] = _template_piece(piece, key, tweak + before.copy().digest(), place)
            before.update(piece.encode())
        pieces.reverse()
    return "".join(pieces)


def _template_piece(s: str, key: bytes, tweak: bytes, place: dict[str, tuple[str, int]]) -> str:
    value, size, shape = 0, 1, []
    for c in s:
        if c in place:
            a, i = place[c]
            value, size = value * len(a) + i, size * len(a)
            shape.append(a)
    shown = "".join(place[c][0][0] if c in place else c for c in s)
    new = permute(value, size, key, tweak + shown.encode())
    out = []
    for a in reversed(shape):
        new, i = divmod(new, len(a))
        out.append(a[i])
    it = iter(reversed(out))
    return "".join(next(it) if c in place else c for c in s)


def _email(s: str, key: bytes) -> str:
    local, _, domain = s.rpartition("@")
    host, _, top = domain.rpartition(".")
    return f"{_template(local, key, b'local')}@{_template(host, key, b'host')}.{top}"


def _credential(s: str, key: bytes) -> str:
    """One of hexadecimal digits alone stays such, and no other becomes one; a known beginning stays."""
    if known := _KNOWN.match(s):
        return known[0] + _template(s[known.end() :], key, known[0].encode())
    if _is_hex(s):
        return _template(s, key, b"hex", {c: (_HEX, i) for i, c in enumerate(_HEX)})
    s = _template(s, key, b"credential")
    while _is_hex(s) or _KNOWN.match(s):
        s = _template(s, key, b"credential")
    return s


_KNOWN = re.compile("AKIA|gh[pousr]_|sk-")


def _is_hex(s: str) -> bool:
    return all(c in _HEX for c in s)


_MONTHS = "january february march april may june july august september october november december".split()


@lru_cache(maxsize=1)
def _calendar() -> tuple[list[datetime.date], dict[datetime.date, int], int]:
    """The dates of 1900 to 2099, days up to the 12th first; each date's place; and how many go first."""
    first = datetime.date(1900, 1, 1)
    dates = [first + datetime.timedelta(i) for i in range((datetime.date(2100, 1, 1) - first).days)]
    dates.sort(key=lambda d: d.day > 12)
    return dates, {d: i for i, d in enumerate(dates)}, sum(d.day <= 12 for d in dates)


def _moved(d: datetime.date, key: bytes) -> datetime.date | None:
    """The pseudonym of a date of the years 1900 to 2099; a day up to the 12th stays one."""
    dates, place, low = _calendar()
    at = place.get(d)
    if at is None:
        return None
    return dates[permute(at, low, key, b"date") if at < low else low + permute(at - low, len(dates) - low, key, b"late date")]


def _date(s: str, key: bytes) -> str | None:
    """A date of the years 1900 to 2099 becomes another, written alike; None if there is no such date."""
    a, b, c = (int(x) for x in re.findall(r"[0-9]+", s))
    seps = re.findall(r"[^0-9]", s)
    year_first = s.index(seps[0]) == 4
    y, m, d = (a, b, c) if year_first else (c, b, a)
    swapped = not year_first and m > 12 >= d  # month first
    if swapped:
        m, d = d, m
    try:
        new = _moved(datetime.date(y, m, d), key)
    except ValueError:
        return None
    if new is None:
        return None
    parts = [f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"] if year_first else [f"{new.month:02d}", f"{new.day:02d}", f"{new.year:04d}"] if swapped else [f"{new.day:02d}", f"{new.month:02d}", f"{new.year:04d}"]
    return parts[0] + seps[0] + parts[1] + seps[1] + parts[2]


_NAMES = {name: (i + 1, short) for i, m in enumerate(_MONTHS) for name, short in ((m, False), (m[:3], m != "may"), *((("sept", True),) if m == "september" else ()))}
_NAME = "|".join(sorted(_NAMES, key=len, reverse=True))
_NAMED = rf"""(?<![\w./-])(?:(?P<d>[0-9]{{1,2}})(?P<o>st|nd|rd|th)?(?:\.?\s+(?:of\s+)?|-)(?P<m>{_NAME})\b(?:\.?,?\s+|-)|(?P<m2>{_NAME})\b\.?\s+(?P<d2>[0-9]{{1,2}})(?P<o2>st|nd|rd|th)?(?:\s*,\s*|\s+))(?P<y>[0-9]{{4}})(?![\w]|[./-][0-9])"""
_NAMED_DATE = re.compile(_NAMED, re.I | re.A)


def _named_date(s: str, key: bytes) -> str | None:
    """A date with its month's English name, in full or cut to three letters, written alike; the same date as in digits gets the same pseudonym."""
    x = _NAMED_DATE.fullmatch(s)
    day, ordinal, month = ("d", "o", "m") if x["d"] else ("d2", "o2", "m2")
    number, short = _NAMES[x[month].lower()]
    try:
        old = datetime.date(int(x["y"]), number, int(x[day]))
    except ValueError:
        return None
    new = _moved(old, key)
    if new is None:
        return None
    name = _MONTHS[new.month - 1]
    name = name[:3] if short else name
    name = name.upper() if x[month].isupper() else name.capitalize() if x[month][0].isupper() else name
    parts = {day: f"{new.day:02d}" if x[day][0] == "0" else str(new.day), month: name, "y": f"{new.year:04d}"}
    if x[ordinal]:
        end = "th" if 10 < new.day < 14 else {1: "st", 2: "nd", 3: "rd"}.get(new.day % 10, "th")
        parts[ordinal] = end.upper() if x[ordinal].isupper() else end
    out, at = [], 0
    for group in sorted(parts, key=x.start):
        out += s[at : x.start(group)], parts[group]
        at = x.end(group)
    return "".join(out)


#: The length of an IBAN in each country that has one.
_IBAN_LENGTH = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 "
    "HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 "
    "QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()}


def _ibans(text: str, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    """The places of valid IBANs; what follows one, in capitals or digits, may look like more of it.

    Of the ends between words the one of the country's length goes first,
    then the longest.
    """
    m = pattern.search(text)
    while m:
        s, start = m[0], m.start()
        ends = [i for i in range(len(s), 0, -1) if i == len(s) or s[i] == " "]
        ends.sort(key=lambda i: len(s[:i].replace(" ", "")) != _IBAN_LENGTH.get(s[:2]))
        end = next((i for i in ends if _iban_ok(s[:i].replace(" ", ""))), 0)
        if end:
            yield start, start + end
        m = pattern.search(text, start + (end or 1))


def _iban_mod(flat: str) -> int:
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97


def _iban_ok(flat: str) -> bool:
    return 15 <= len(flat) <= 34 and "02" <= flat[2:4] <= "98" and _iban_mod(flat) == 1


def _iban(s: str, key: bytes) -> str | None:
    """The account part is permuted and the check digits are made anew; None if they are wrong."""
    flat = s.replace(" ", "")
    if not _iban_ok(flat):
        return None
    body = _template(flat[4:], key, b"iban" + flat[:2].encode())
    new = iter(flat[:2] + f"{98 - _iban_mod(flat[:2] + '00' + body):02d}" + body)
    return "".join(c if c == " " else next(new) for c in s)


#: Kind, pattern, and what gives the pseudonym (None: no PII after all). Earlier kinds go first at the same place.
KINDS: tuple[tuple[str, re.Pattern, Callable[[str, bytes], str | None]], ...] = (
    ("email", re.compile(r"(?<![\w.+%-])[_.+%-]*(?P<v>[^\W_][\w.+%-]*)@[A-Za-z0-9](?:[A-Za-z0-9-]*\.)+[A-Za-z]{2,}"), _email),
    ("credential", re.compile(r"(?P<known>(?<![0-9A-Za-z])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,})(?![0-9A-Za-z]))|(?<=[\"'])[^\s\"']{8,}(?=[\"'])(?<!\s)"), _credential),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"), _iban),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"), _ip),
    ("date", re.compile(r"(?<![0-9./-])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?![0-9]|[./-][0-9])"), _date),
    ("date", _NAMED_DATE, _named_date),
    ("ssn", re.compile(r"(?<![0-9-])(?!000|666|9[0-9][0-9])[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"), _ssn),
    ("card", re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])"), _card),
    ("phone", re.compile(r"(?<![\w.])(?:\+[0-9]{1,3}[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]{2,4}[ .-][0-9]{3,4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([.-])[0-9]{3}\1[0-9]{4})(?![0-9]|\.[0-9])"), lambda s, key: _digits(s, key, b"phone")),
)
_ASSIGN = re.compile(r"(?i)(?:key|token|secret|password|passwd|pwd|bearer|auth)\w*\s*[:=]?\s*$")
_GATE = re.compile(r"[0-9@]|[\"']")


def _find(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of what is replaced, in order, without overlaps."""
    got = []
    has_at, has_digit = "@" in text, re.search("[0-9]", text) is not None
    for order, (kind, pattern, fn) in enumerate(KINDS):
        if kind == "email" and not has_at or kind not in ("email", "credential") and not has_digit:
            continue
        if kind == "iban":
            got.extend((a, -b, order, b, kind, text[a:b], fn) for a, b in _ibans(text, pattern))
            continue
        for m in pattern.finditer(text):
            start = m.start("v") if kind == "email" else m.start()  # a run of such characters is read once, from its beginning
            s = text[start : m.end()]
            if kind == "credential" and m["known"] is None and not _ASSIGN.search(text, max(0, m.start() - 60), m.start() - 1):
                continue
            got.append((start, -m.end(), order, m.end(), kind, s, fn))
    got.sort(key=lambda x: x[:3])
    out, last = [], 0
    for start, _, _, end, kind, s, fn in got:
        if start >= last and (new := fn(s, key)) is not None:
            out.append((start, end, kind, new))
            last = end
    return out


def pseudonymise(text: str | None, key: bytes) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and (start, end, kind) of each find in the original."""
    if not text or not _GATE.search(text):
        return text, []
    found = _find(text, key)
    if not found:
        return text, []
    out, at = [], 0
    for start, end, _, new in found:
        out.append(text[at:start])
        out.append(new)
        at = end
    out.append(text[at:])
    return "".join(out), [(a, b, k) for a, b, k, _ in found]


def findings(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, text (with pseudonyms), n_pii, kinds (of each find, in order), spans in the original."""
    d, key = narrow(docs, id_col, text_col), as_key(key)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [pseudonymise(t.as_py(), key) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t for t, _ in got], pa.string()), pa.array([len(f) for _, f in got], pa.int64()), pa.array([[k for _, _, k in f] for _, f in got], pa.list_(pa.string())), pa.array([[{"start": a, "end": b} for a, b, _ in f] for _, f in got], span)],
                ["doc_id", "text", "n_pii", "kinds", "spans"],
            )

    return map_arrow(d, run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, text string, n_pii long, kinds array<string>, spans array<struct<start:long,end:long>>")


def replace(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """`docs`, all rows and columns, with pseudonyms in the text."""
    at, key = docs.columns.index(text_col), as_key(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([pseudonymise(t.as_py(), key)[0] for t in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    schema = T.StructType([T.StructField(text_col, T.StringType()) if i == at else f for i, f in enumerate(docs.schema.fields)])
    return map_arrow(docs, run, schema)
