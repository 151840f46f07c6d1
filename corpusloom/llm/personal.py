"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their scores.

Each kind has a pattern, a test of what the pattern found, and words that make it likelier where they stand within
``BEFORE`` code points before or ``AFTER`` behind it. A span's score, in hundredths, is the kind's own, that of a passed test and
that of such a word. Base kinds (email, ip, card, phone) are kept whenever their test passes, whatever their score; added kinds
(iban by mod-97 and its country's length, ssn by its number ranges, routing by its 3-7-1 checksum, shortcard of 13 to 15
digits by Luhn and issuer) need ``THRESHOLD``, and give way to a base span that they overlap unless they hold it whole.
Matches are leftmost and do not overlap within a kind; a match whose test fails is dropped, and the search goes on behind it.

Every pattern is read in one pass: an address is found by its @, the run before it ends at the @ before, and possessive runs
are never read twice, so a text of one long run takes no longer than any other. A map over the partitions: no shuffle.

Defined cases: null and empty texts hold nothing, and still return a row; a null doc_id stays null; rows that repeat are read
each; other columns are ignored; an empty table has no rows; offsets count code points and ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import load, slices

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "routing", "shortcard")
#: Hundredths that an added span needs; code points in which words nearby count.
THRESHOLD, BEFORE, AFTER = 50, 48, 24
#: Hundredths of a kind's pattern, of its passed test, of a word nearby.
SCORES = {"email": (70, 10, 20), "ip": (40, 20, 30), "card": (30, 45, 25), "phone": (40, 15, 35), "iban": (15, 65, 20), "ssn": (15, 20, 45), "routing": (5, 20, 45), "shortcard": (5, 30, 40)}
#: Words by which texts announce a kind, in four languages (fixed values).
NEARBY = {
    "email": "e-?mail|mail|mailto|address|courriel|correo|adresse|contact|kontakt|contacto",
    "ip": "ip|ipv4|host|server|serveur|servidor|login|address|adresse",
    "card": "card|credit|debit|visa|mastercard|amex|karte|kreditkarte|carte|tarjeta",
    "phone": "phone|tel|telephone|mobile|cell|call|fax|telefon|handy|téléphone|teléfono|móvil",
    "iban": "iban|account|bank|konto|kontonummer|compte|banque|cuenta|banco",
    "ssn": "ssn|social security|social-security|taxpayer",
    "routing": "routing|aba|rtn",
}
NEARBY["shortcard"] = NEARBY["card"]
WORDS = {k: re.compile(rf"(?<!\w)(?:{v})(?!\w)", re.I) for k, v in NEARBY.items()}
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
OUTSIDE = re.compile(r"[^A-Za-z0-9._%+-]")
PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])"),
    "ssn": re.compile(r"(?<![\w+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "routing": re.compile(r"(?<![\w.-])[0-9]{9}(?![\w-])"),
}
DIGIT = re.compile(r"[0-9]")
#: Lengths of account numbers by country (fixed values).
LENGTHS = {"AT": 20, "BE": 16, "BG": 22, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IT": 27, "LT": 20, "LU": 20, "LV": 21, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26, "UA": 29}

Span = tuple[str, int, int, int]


def digits_of(found: str) -> str:
    return "".join(c for c in found if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """From the right, every second digit doubled, less 9 where that is above 9: the sum ends in 0."""
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod_97(account: str) -> bool:
    """Country and check digits behind the rest, letters as 10 to 35: the number leaves 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def routing(digits: str) -> bool:
    d = [int(c) for c in digits]
    return any(d) and sum(w * x for w, x in zip((3, 7, 1) * 3, d, strict=True)) % 10 == 0


def issued(digits: str) -> bool:
    """American Express and Diners Club: the issuers whose numbers are that short."""
    return len(digits) == 15 and digits[:2] in ("34", "37") or len(digits) == 14 and (digits[:2] in ("36", "38") or "300" <= digits[:3] <= "305")


def passes(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(x := part.lstrip("0")) < 3 or len(x) == 3 and x <= "255" for part in found.split("."))
    if kind == "iban":
        account = found.replace(" ", "")
        return LENGTHS.get(account[:2]) == len(account) and mod_97(account)
    digits = digits_of(found)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "ssn":
        return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
    return routing(digits) if kind == "routing" else issued(digits) and luhn(digits)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Starts and ends of addresses: the run before an @, behind the last address, and at least two labels after it."""
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and not OUTSIDE.match(text, start - 1):
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            after = domain.end()
            yield start, after
        else:
            after = at + 1
        at = text.find("@", after)


def proposed(kind: str, text: str) -> Iterator[tuple[int, int]]:
    return emails(text) if kind == "email" else (m.span() for m in PATTERNS["card" if kind == "shortcard" else kind].finditer(text))


def spans(text: str | None) -> list[Span]:
    """kind, start, end, score: base kinds as they are listed, then added ones, each by start."""
    text = text or ""
    base, added = [], []
    digits = DIGIT.search(text) is not None
    for kind in BASE + ADDED:
        if kind != "email" and not digits:
            continue
        own, tested, near = SCORES[kind]
        for start, end in proposed(kind, text):
            if not passes(kind, text[start:end]):
                continue
            score = own + tested + near * bool(WORDS[kind].search(text[max(0, start - BEFORE) : start]) or WORDS[kind].search(text[end : end + AFTER]))
            if kind in BASE:
                base.append((kind, start, end, score))
            elif score >= THRESHOLD:
                added.append((kind, start, end, score))
    if added and base:
        added = [a for a in added if all(b[2] <= a[1] or a[2] <= b[1] or a[1] <= b[1] and b[2] <= a[2] for b in base)]
    return base + added


def joined(found: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end, _ in found)


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, spans: array of (kind, start, end, score in hundredths)."""

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.int32())]))
        for batch in slices(batches):
            found = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: bigint, end: bigint, score: int>>")


def masked(text: str | None) -> str | None:
    """The text with each span's text replaced by its kind in brackets; of overlapping spans the earlier, longer one counts."""
    out, at = [], 0
    for kind, start, end, _ in sorted(spans(text), key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = end
    return text if not out else "".join(out) + text[at:]


def digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores (hundredths, in the order of spans)."""
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "scores"]

    def run(batches):
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                found = spans(text)
                base = [s for s in found if s[0] in BASE]
                rows.append([*(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(found), ",".join(str(s[3]) for s in found)])
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string")


def query(spark, sf_dir: str) -> DataFrame:
    return digest(load(spark, sf_dir, "documents"))
