"""Operator 8: personal data to format-preserving pseudonyms by a keyed Feistel permutation.

Texts are searched for e-mail addresses, telephone numbers, payment cards (Luhn), account numbers
(IBAN, mod 97), US social security numbers, IPv4 addresses, dates of the calendar and access
secrets. A value is validated, written as a number of its format's domain, permuted there by a
Feistel network (rounds keyed by BLAKE2b; values that leave the domain walk on along their cycle)
and written back in the same format: separators stay, check digits are made anew, letters stay
letters and digits digits. The permutation depends on key, kind and domain only, so equal values
get equal pseudonyms in all documents, and ``reveal`` takes them back with the key.

What is not valid (a 16-digit number without the check digit, 31 February) is left alone. Where a
pattern takes in too much, shorter readings are tried: an account number ends where its country's
length says, a telephone number at a separator. The search goes on behind the first character of
what is not valid. A number right behind groups that look like its own may then, with its pseudonym,
be read in another place by ``reveal``, which then does not take it back.

What stays in clear: an e-mail address's host, the country and first two digits of a telephone number
beyond +1, a card's first digit, an account number's country, an access key's first four letters and
the separators. A date is the same pseudonym day in the orders year-month-day and day-month-year; in
month/day/year, where only days past the twelfth tell the order, the walk goes on to such a day, so
that ``reveal`` reads it alike. Any four numbers up to 255 with dots between are an address, as
nothing in the format tells one from a version.

Defined results: null stays null; empty texts and texts without such values are unchanged; where
candidates overlap, the one that begins first wins, ties by the order of kinds; repeated rows are
rewritten alike. Whole texts are searched.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices

ROUNDS = 10
MEMO = 100_000
FIRST, LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """A keyed permutation of 0 .. n-1, its inverse with ``back``."""

    def __init__(self, key: bytes, kind: str, n: int):
        self.n, self.a = n, max(1, math.isqrt(n - 1) + 1 if n > 1 else 1)
        self.b = max(1, -(-n // self.a))
        self.tag = f"{kind}:{n}:".encode()
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _f(self, i: int, x: int, m: int) -> int:
        size = x.bit_length() // 8 + 1
        h = hashlib.blake2b(self.tag + bytes([i]) + x.to_bytes(size, "big"), key=self.key, digest_size=min(64, max(16, m.bit_length() // 8 + 9)))
        return int.from_bytes(h.digest(), "big") % m

    def _once(self, x: int, back: bool) -> int:
        left, right = divmod(x, self.b)
        for i in range(ROUNDS)[:: -1 if back else 1]:
            s = -1 if back else 1
            if i % 2:
                right = (right + s * self._f(i, left, self.b)) % self.b
            else:
                left = (left + s * self._f(i, right, self.a)) % self.a
        return left * self.b + right

    def __call__(self, x: int, back: bool = False) -> int:
        if self.n < 2:
            return x
        x = self._once(x, back)
        while x >= self.n:
            x = self._once(x, back)
        return x


Walk = Callable[[str, int, int], int]  # (kind, number, size of the domain) -> number


def mixed(digits: list[tuple[int, int]], kind: str, walk: Walk) -> list[int]:
    """Permutes a number of mixed radix, given as (digit, radix)."""
    x, n = 0, 1
    for d, r in digits:
        x, n = x * r + d, n * r
    x = walk(kind, x, n)
    out = []
    for _, r in reversed(digits):
        x, d = divmod(x, r)
        out.append(d)
    return out[::-1]


def luhn(digits: str) -> int:
    """The sum that a valid number has at 0 mod 10."""
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, digits[::-1]))) % 10


def refill(text: str, digits: str) -> str:
    """``digits`` in the places of the text's digits."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def card(text: str, walk: Walk) -> str | None:
    d = "".join(c for c in text if c.isdigit())
    if not 13 <= len(d) <= 19 or luhn(d) or len(set(d)) == 1:
        return None
    body = d[0] + "".join(map(str, mixed([(int(c), 10) for c in d[1:-1]], "card", walk)))
    return refill(text, body + str((10 - luhn(body + "0")) % 10))


def phone(text: str, walk: Walk) -> str | None:
    d = "".join(c for c in text if c.isdigit())
    us = d[1:] if len(d) == 11 and d[0] == "1" else d if len(d) == 10 and not text.startswith("+") else ""
    if us:
        if us[0] in "01" or us[3] in "01":
            return None
        own = mixed([(int(c) - 2 * (i in (0, 3)), 8 if i in (0, 3) else 10) for i, c in enumerate(us)], "phone", walk)
        return refill(text, d[: len(d) - 10] + "".join(str(x + 2 * (i in (0, 3))) for i, x in enumerate(own)))
    if not text.startswith("+") or not 8 <= len(d) <= 15 or d[0] == "0":
        return None
    return refill(text, d[:2] + "".join(map(str, mixed([(int(c), 10) for c in d[2:]], "phone", walk))))


def ssn(text: str, walk: Walk) -> str | None:
    a, g, s = int(text[:3]), int(text[4:6]), int(text[7:])
    if a in (0, 666) or a >= 900 or not g or not s:
        return None
    a, g, s = mixed([(a - 1 - (a > 666), 898), (g - 1, 99), (s - 1, 9999)], "ssn", walk)
    return f"{a + 1 + (a >= 665):03d}{text[3]}{g + 1:02d}{text[6]}{s + 1:04d}"


def address(text: str, walk: Walk) -> str | None:
    p = text.split(".")
    if any(int(x) > 255 or str(int(x)) != x for x in p):
        return None
    return ".".join(map(str, mixed([(int(x), 256) for x in p], "ipv4", walk)))


#: Characters of an account number by country (ISO 13616).
_LENGTHS = """15 NO 16 BE 18 DK FI FK FO GL NL SD 19 MK SI 20 AT BA EE KZ LT LU MN XK 21 CH HR LI LV 22 BG BH CR DE GB GE IE ME RS VA
23 AE GI IL IQ OM SO TL 24 AD CZ ES MD PK RO SA SE SK TN VG 25 LY PT ST 26 IS TR 27 BI DJ FR GR IT MC MR SM 28 AL AZ BY CY DO GT HN HU LB NI PL SV
29 BR EG PS QA UA 30 JO KW MU YE 31 MT SC 32 LC 33 RU"""
LENGTH: dict[str, int] = {}
for _x in _LENGTHS.split():
    if _x.isdigit():
        _size = int(_x)
    else:
        LENGTH[_x] = _size


def _number(s: str) -> int:
    return int("".join(str(int(x, 36)) for x in s))


def _is_iban(text: str) -> bool:
    c = text.replace(" ", "")
    return 15 <= len(c) <= 34 and _number(c[4:] + c[:4]) % 97 == 1


def iban_ends(text: str) -> list[int]:
    """Where the account number may end: at its country's length, else at the end of all."""
    cuts = [i for i, x in enumerate(text) if x == " " and len(text[:i].replace(" ", "")) == LENGTH.get(text[:2])]
    return [*cuts[:1], len(text)]


def phone_ends(text: str) -> list[int]:
    return [len(text), *(i for i in range(len(text) - 1, 0, -1) if text[i] in " .-" and text[i - 1].isdigit())]


def iban(text: str, walk: Walk) -> str | None:
    """Walks on while the result would be read as a shorter number, so that it is taken back."""
    if not _is_iban(text):
        return None
    text = _iban_once(text, walk)
    while any(_is_iban(text[:i]) for i in iban_ends(text)[:-1]):
        text = _iban_once(text, walk)
    return text


def _iban_once(text: str, walk: Walk) -> str:
    c = text.replace(" ", "")
    own = mixed([(int(x, 36) - (0 if x.isdigit() else 10), 10 if x.isdigit() else 26) for x in c[4:]], "iban:" + c[:2], walk)
    body = "".join(str(d) if x.isdigit() else chr(65 + d) for d, x in zip(own, c[4:]))
    it = iter(c[:2] + f"{98 - _number(body + c[:2] + '00') % 97:02d}" + body)
    return "".join(next(it) if x != " " else x for x in text)


def _day(order: str, parts: list[str]) -> int | None:
    named = dict(zip(order, map(int, parts)))
    try:
        day = datetime.date(named["y"], named["m"], named["d"]).toordinal()
    except ValueError:
        return None
    return day if FIRST <= day <= LAST else None


def _date(order: str, but: str = "") -> Callable[[str, Walk], str | None]:
    """but: an order that is tried before. What can be read in that order is not of this one, so the
    walk goes on while the pseudonym can."""

    def run(text: str, walk: Walk) -> str | None:
        parts = re.split(r"(\D)", text)
        day = _day(order, parts[::2])
        if day is None or but and _day(but, parts[::2]) is not None:
            return None
        while True:
            day = FIRST + walk("date", day - FIRST, LAST - FIRST + 1)
            t = datetime.date.fromordinal(day)
            own = [{"y": f"{t.year:04d}", "m": f"{t.month:02d}", "d": f"{t.day:02d}"}[k] for k in order]
            if not but or _day(but, own) is None:
                return parts[1].join(own)

    return run


def _classes(kind: str, keep: Callable[[str], int]) -> Callable[[str, Walk], str | None]:
    """Letters to letters of their case, digits to digits, after the first ``keep`` characters."""

    def run(text: str, walk: Walk) -> str | None:
        k = keep(text)
        base = lambda c: ("0", 10) if c.isdigit() else ("a", 26) if c.islower() else ("A", 26)
        own = [c for c in text[k:] if c.isascii() and c.isalnum()]
        it = iter(mixed([(ord(c) - ord(base(c)[0]), base(c)[1]) for c in own], kind + str(len(own)), walk))
        return text[:k] + "".join(chr(ord(base(c)[0]) + next(it)) if c.isascii() and c.isalnum() else c for c in text[k:])

    return run


def email(text: str, walk: Walk) -> str | None:
    name, _, host = text.rpartition("@")
    return f"{_classes('email', lambda _: 0)(name, walk)}@{host}"


def hexadecimal(text: str, walk: Walk) -> str | None:
    k = re.search(r"[0-9a-fA-F]+\"?$", text).start()
    body = text[k:].rstrip('"')
    return text[:k] + "".join("0123456789abcdef"[x] for x in mixed([(int(c, 16), 16) for c in body], "hex", walk)) + text[k + len(body) :]


#: Kind, pattern, format. In the order in which they are tried at one place.
KINDS: list[tuple[str, str, Callable[[str, Walk], str | None]]] = [
    ("email", r"(?<![\w.+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])", email),
    ("secret", r"\b(?:password|passwd|pwd|secret|token|api_key|apikey)\s{0,3}[=:]\s{0,3}\"?[0-9a-f]{12,128}(?![0-9A-Za-z])\"?", hexadecimal),
    ("access_key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", _classes("access_key", lambda _: 4)),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", iban),
    ("date", r"(?<![\d.-])\d{4}-\d{2}-\d{2}(?![\d-])", _date("ymd")),
    ("date", r"(?<![\d./])\d{2}([./])\d{2}\1\d{4}(?![\d/])", _date("dmy")),
    ("date", r"(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])", _date("mdy", "dmy")),
    ("ipv4", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", address),
    ("ssn", r"(?<![\d-])\d{3}[- ]\d{2}[- ]\d{4}(?![\d-])", ssn),
    ("card", r"(?<!\d)(?<!\d\.)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?!\d)", card),
    ("phone", r"(?<![\d+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)", phone),
    ("phone", r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)", phone),
    ("phone", r"(?<![\d-])(?:1[ .-])?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?![\d-])", phone),
]
_COMPILED = [(k, re.compile(p), f) for k, p, f in KINDS]
#: Kinds whose first match may take in too much: where its readings may end, in the order of trial.
_ENDS = {"iban": iban_ends, "phone": phone_ends}
#: What each kind has at least: a digit, an address's @, a secret's = or :, an access key's beginning.
_HINT = re.compile(r"[0-9@=:]|A[KS]IA")


class Vault:
    """The permutations of one key; a bounded memory of values."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back, self.nets, self.known = key, back, {}, {}

    def walk(self, kind: str, x: int, n: int) -> int:
        net = self.nets.get((kind, n)) or self.nets.setdefault((kind, n), Feistel(self.key, kind, n))
        return net(x, self.back)

    def value(self, i: int, text: str) -> str | None:
        if (i, text) not in self.known:
            if len(self.known) >= MEMO:
                self.known.clear()
            self.known[i, text] = _COMPILED[i][2](text, self.walk)
        return self.known[i, text]

    def rewrite(self, text: str) -> tuple[str, list[dict]]:
        """The text with its values exchanged, and each as (kind, start, end in the original)."""
        if not _HINT.search(text):
            return text, []
        found = []
        for i, (kind, pattern, _) in enumerate(_COMPILED):
            if kind == "email" and "@" not in text:
                continue
            at = 0
            while m := pattern.search(text, at):
                start, at = m.start(), m.start() + 1
                for size in _ENDS[kind](m[0]) if kind in _ENDS else (len(m[0]),):
                    end = start + size
                    if pattern.fullmatch(text, start, end) and (new := self.value(i, text[start:end])) is not None:
                        found.append((start, i, end, new))
                        at = end
                        break
        out, at, entities = [], 0, []
        for start, i, end, new in sorted(found):
            if start >= at:
                out += [text[at:start], new]
                at = end
                entities.append({"kind": _COMPILED[i][0], "start": start, "end": end})
        return "".join([*out, text[at:]]), entities


_ENTITIES = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """(doc_id, text, entities: array of kind, start, end), a row for each row of ``docs``."""

    def run(batches):
        vault = Vault(key, back)
        for b in slices(batches):
            both = [vault.rewrite(t) if t else (t, []) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in both], pa.string()), pa.array([e for _, e in both], _ENTITIES)], names=["doc_id", "text", "entities"])

    ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, text string, entities array<struct<kind:string,start:int,end:int>>")


def reveal(docs: DataFrame, key: bytes) -> DataFrame:
    """The inverse of ``pseudonymise`` under the same key."""
    return pseudonymise(docs, key, back=True)


def rewrite_column(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with all its columns, texts pseudonymised and n_chars, if there, counted anew."""

    def run(batches):
        vault = Vault(key)
        for b in slices(batches):
            text = pa.array([vault.rewrite(t)[0] if t else t for t in b.column("text").to_pylist()], pa.string())
            yield b.set_column(b.schema.get_field_index("text"), "text", text)

    ship(docs.sparkSession)
    out = docs.withColumn("text", F.col("text").cast("string"))
    out = out.mapInArrow(run, out.schema)
    kind = dict(docs.dtypes).get("n_chars")
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars"))) if kind else out
