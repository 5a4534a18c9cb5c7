"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Every kind has proposals (regular expressions), a check, a score to begin
with and words that raise or lower it when they stand within ``NEAR``
characters of the span.

* Base kinds, leftmost and not overlapping within a kind; a match that fails
  its check is dropped and not tried again: email; ip (four decimal parts of
  at most 255); card (12 to 19 digits, single spaces or hyphens between them,
  Luhn); phone (a plus sign, 9 to 15 digits). They stay whatever their score.
* Further kinds, kept from a score of ``ACCEPTED`` on where they overlap no
  base span and no better one: card numbers among other groups of digits
  (Luhn, an issuer's first digit, and a usual grouping or a word nearby);
  iban (length by country, mod 97); ipv6; and, only with a word that tells
  them, ssn, phone without a plus sign, and secret (long keys and tokens).

Every pattern is read once from left to right (possessive repeats, a
lookbehind, or a walk back from the at sign), so the time of a text grows with
its length. One pass over the documents, nothing is shuffled.

Defined results: a null or empty text has no spans; null ids stay; repeated
rows are documents of their own; extra columns are carried if asked for, but
for those named like a result, which the result replaces; an empty table gives
no rows. Places are code points, ends exclusive.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkdraft.llm.words import string_buffers

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "ipv6", "ssn", "secret"]
ACCEPTED, NEARBY = 0.5, 0.35
#: Characters on each side in which words count as nearby.
NEAR = 60

# Length of an account number by country.
IBAN_LENGTHS = """
AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 ES24 FI18 FO18 FR27 GB22
GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IS26 IT27 JO30 KW30 KZ20 LB28 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19
MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SE24 SI19 SK24 SM27 TN24 TR26 UA29 VG24
"""


@dataclass(frozen=True)
class Kind:
    """Score of a kind's spans, and the words nearby that raise or lower it."""

    score: float
    likely: frozenset
    unlikely: frozenset = frozenset()


def _words(text: str) -> frozenset:
    return frozenset(text.split())


SCORES = {
    "email": Kind(0.9, _words("email mail contact write address correo courriel")),
    "ip": Kind(0.6, _words("ip address host server client login network"), _words("version release section chapter v")),
    "card": Kind(0.4, _words("card credit debit visa mastercard amex payment pay tarjeta carte karte kreditkarte")),
    "phone": Kind(0.4, _words("phone call tel telephone mobile cell fax whatsapp contact telefon handy teléfono téléphone")),
    "iban": Kind(0.9, _words("iban account bank transfer konto compte cuenta")),
    "ipv6": Kind(0.6, _words("ip ipv6 address host server")),
    "ssn": Kind(0.3, _words("ssn social security taxpayer")),
    "secret": Kind(0.3, _words("token key apikey secret password passwd bearer credential credentials")),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)++|[0-9]++")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}+(?![0-9A-Za-z:.])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_NATIONAL = re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_KEY = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+")
_LETTERS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others (every second one doubled, from the right)."""
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number without spaces leaves 1 modulo 97, its head put last and letters read as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        domain, start = _DOMAIN.match(text, at + 1), at
        if domain:
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                last = domain.end()
                found.append((start, last))
        at = text.find("@", max(at + 1, last))
    return found


def ips(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            end = at + sum(map(len, parts[i : i + 4])) + 3
            # Four digits beyond the leading zeros are too much; long parts are never read as numbers.
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                found.append((at, end))
            at = end + 1
    return found


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def cards(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Card numbers, and the other stretches of digits."""
    found, rest = [], []
    for m in _DIGITS.finditer(text):
        digits = _digits(m.group()) if m.end() - m.start() >= 12 else ""
        (found if 12 <= len(digits) <= 19 and luhn(digits) else rest).append(m.span())
    return found, rest


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]


def _inner_cards(text: str, stretch: tuple[int, int]) -> Iterator[tuple[int, int, float]]:
    """Card numbers of whole groups of a longer stretch of digits, with what their
    grouping adds to the score: from the left, usually grouped ones first, then longer ones."""
    groups = [(m.start() + stretch[0], m.end() + stretch[0]) for m in re.finditer("[0-9]+", text[stretch[0] : stretch[1]])]
    i = 0
    while i < len(groups):
        best, size = None, 0
        for j in range(i, len(groups)):
            size += groups[j][1] - groups[j][0]
            if size > 19:
                break
            if size >= 13 and j + 1 - i < len(groups) and text[groups[i][0]] in "3456" and luhn(_digits(text[groups[i][0] : groups[j][1]])):
                shape = [b - a for a, b in groups[i : j + 1]]
                best = max(best or (0.0, j), (0.2 if shape in ([4, 4, 4, 4], [4, 6, 5]) else 0.0, j))
        if best is None:
            i += 1
            continue
        yield groups[i][0], groups[best[1]][1], best[0]
        i = best[1] + 1


@cache
def _account_body(country: str) -> re.Pattern | None:
    lengths = {x[:2]: int(x[2:]) for x in IBAN_LENGTHS.split()}
    return re.compile(rf"(?:\x20?[A-Z0-9]){{{lengths[country] - 4}}}(?![A-Za-z0-9])") if country in lengths else None


def _accounts(text: str) -> Iterator[tuple[int, int, float]]:
    for m in _IBAN.finditer(text):
        body = _account_body(m.group()[:2])
        end = body.match(text, m.end()) if body else None
        if end and mod97(text[m.start() : end.end()].replace(" ", "")):
            yield m.start(), end.end(), 0.0


def _long_addresses(text: str) -> Iterator[tuple[int, int, float]]:
    for m in _IPV6.finditer(text):
        try:
            ipaddress.IPv6Address(m.group())
        except ValueError:
            continue
        if m.end() - m.start() >= 6:
            yield *m.span(), 0.0


def _keys(text: str) -> Iterator[tuple[int, int, float]]:
    for m in _KEY.finditer(text):
        letters = set(m.group())
        if len(letters) >= 8 and any(c.isdigit() for c in letters) and any(c.isalpha() for c in letters):
            yield *m.span(), 0.0


def _score(text: str, kind: str, start: int, end: int, bonus: float) -> float:
    near = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    words = {w.lower() for part in near for w in _LETTERS.findall(part)}
    about = SCORES[kind]
    score = about.score + bonus + NEARBY * (not words.isdisjoint(about.likely)) - NEARBY * (not words.isdisjoint(about.unlikely))
    return round(min(1.0, max(0.0, score)), 6)


def personal_spans(text: str) -> list[tuple[int, int, str, float, bool]]:
    """(start, end, kind, score, whether of the base) of one text, by start, then kind as listed."""
    whole, stretches = cards(text)
    base = {"email": emails(text), "ip": ips(text), "card": whole, "phone": phones(text)}
    # A checksum that holds, or a plus sign, confirms the base spans.
    confirmed = {"card": 0.4, "phone": 0.3}
    found = [(a, b, k, _score(text, k, a, b, confirmed.get(k, 0.0)), True) for k, spans in base.items() for a, b in spans]
    more = [("card", c) for s in stretches if s[1] - s[0] >= 14 for c in _inner_cards(text, s)]
    more += [("phone", (*m.span(), 0.0)) for m in _NATIONAL.finditer(text)]
    more += [("ssn", (*m.span(), 0.0)) for m in _SSN.finditer(text)]
    more += [(k, c) for k, spans in (("iban", _accounts), ("ipv6", _long_addresses), ("secret", _keys)) for c in spans(text)]
    rated = [(a, b, k, _score(text, k, a, b, bonus), False) for k, (a, b, bonus) in more]
    rated = sorted((r for r in rated if r[3] >= ACCEPTED), key=lambda r: (-r[3], r[0], KINDS.index(r[2])))
    if rated:
        taken = _Taken([(a, b) for a, b, *_ in found])
        found += [r for r in rated if taken.add(r[0], r[1])]
    return sorted(found, key=lambda r: (r[0], KINDS.index(r[2])))


class _Taken:
    """Stretches of a text in use, in cells of 64 characters so that a look-up costs the same in any text."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.cells: dict[int, list[tuple[int, int]]] = {}
        for a, b in spans:
            self._put(a, b)

    def _put(self, a: int, b: int) -> None:
        for cell in range(a >> 6, (b - 1 >> 6) + 1):
            self.cells.setdefault(cell, []).append((a, b))

    def add(self, a: int, b: int) -> bool:
        """Take [a, b) if no stretch in use overlaps it."""
        if any(x < b and a < y for cell in range(a >> 6, (b - 1 >> 6) + 1) for x, y in self.cells.get(cell, ())):
            return False
        self._put(a, b)
        return True


def redacted(text: str, spans: list[tuple[int, int, str, float, bool]]) -> str:
    """The text with its spans, joined where they overlap, replaced by the kind of the first, in angle brackets."""
    out, at = [], 0
    for a, b, kind, _, _ in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns with found, an array of (kind, start, end, score,
    base), and redacted, the text with all spans replaced."""
    keep = [c for c in keep if c not in ("found", "redacted")]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text.alias("text"))
    results = T.StructType.fromDDL("found array<struct<kind: string, start: bigint, end: bigint, score: double, base: boolean>>, redacted string")
    span_type = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        telling = np.zeros(256, dtype=bool)
        telling[[0x40, *range(0x30, 0x3A)]] = True
        for batch in batches:
            data, offsets = string_buffers(batch.column(1))
            # All patterns hold an at sign or a digit.
            at = np.flatnonzero(telling[data])
            some = np.searchsorted(at, offsets[1:]) > np.searchsorted(at, offsets[:-1])
            found, clean = [], []
            for t, has in enumerate(some):
                text = batch.column(1)[t].as_py()
                spans = personal_spans(text) if has else []
                found.append([dict(kind=k, start=a, end=b, score=s, base=base) for a, b, k, s, base in spans])
                clean.append(redacted(text, spans) if spans else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span_type)), pa.array(clean, pa.string())], names=["row", "found", "redacted"])

    got = packed.mapInArrow(run, T.StructType([packed.schema["row"], *results]))
    return got.select(*[F.col("row").getField(c).alias(c) for c in keep], "found", "redacted")


def span_digests(found: DataFrame) -> DataFrame:
    """doc_id, the number of base spans by kind, their digest, and all spans as kind:start:end."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind: str) -> Column:
        return F.filter("found", lambda s: s["base"] & (s["kind"] == kind))

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("found", lambda s: s["base"])
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
