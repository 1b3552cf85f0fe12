"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Base kinds are taken as they are proposed, leftmost and not overlapping within a kind, and dropped if their check
fails: email, ip (parts at most 255), card (13 to 19 digits, Luhn) and phone (9 to 15 digits). Two kinds are
added: iban (mod-97 and length) and ``local_phone``, a number without a country code, which counts only when a
context word stands near it. A span's score starts at its kind's value, gains for a confirmed checksum and for a
context word in the 40 characters before it, and added spans below 0.5 are dropped; base spans stay whatever
their score. Offsets are code points, ends exclusive.

Every expression is scanned in time linear in the text: an e-mail's name is found from its ``@``, an address only starts where a run of
digits starts. Work is per row in Arrow batches, with no shuffle.

Cases: null and empty texts have no spans. Each row is treated by itself, so repeated ids and rows just repeat. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import narrow

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "local_phone")
NEAR = 40
LEAST = 0.5
# What a kind is worth before and after its checksum, and the words that make it likelier.
START = {"email": 0.8, "ip": 0.5, "card": 0.4, "phone": 0.6, "iban": 0.4, "local_phone": 0.3}
CHECKED = {"card": 0.4, "iban": 0.4}
CONTEXT = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "address", "host", "server"), "card": ("card", "visa", "credit", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "fax"), "iban": ("iban", "account", "bank", "konto"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "teléfono", "téléphone"),
}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LOCAL = re.compile(r"(?<![0-9+A-Za-z])(?:\([0-9]{2,5}\)\x20?)?[0-9]{2,5}(?:[\x20./-][0-9]{2,5}){1,4}(?![0-9A-Za-z])")
_WORDS = {kind: re.compile(r"(?<!\w)(?:" + "|".join(words) + r")\w*", re.IGNORECASE) for kind, words in CONTEXT.items()}

Span = tuple[str, int, int, float]


def digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _NAME:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
            at = text.find("@", free)
        else:
            # the name can't reach over this @
            free = at + 1
            at = text.find("@", free)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    for start, end in emails(text):
        yield "email", start, end
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(map(_small, m.group().split("."))):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        number = digits(m.group())
        if 13 <= len(number) <= 19 and luhn(number):
            yield "card", m.start(), m.end()
    for m in _PHONE.finditer(text):
        if 9 <= len(digits(m.group())) <= 15:
            yield "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        plain = m.group().replace(" ", "")
        if 15 <= len(plain) <= 34 and mod97(plain):
            yield "iban", m.start(), m.end()
    for m in _LOCAL.finditer(text):
        if 7 <= len(digits(m.group())) <= 12:
            yield "local_phone", m.start(), m.end()


_DIGIT = re.compile(r"[0-9]")


def spans(text: str | None) -> list[Span]:
    """(kind, start, end, score) by kind as listed in BASE and ADDED, then by start."""
    out: list[Span] = []
    taken: list[tuple[int, int]] = []
    for kind, start, end in _proposed(text or ""):
        near = _WORDS[kind].search(text[max(0, start - NEAR) : start]) is not None
        score = round(min(1.0, START[kind] + CHECKED.get(kind, 0.0) + (0.2 if near else 0.0)), 2)
        if kind in ADDED and (score < LEAST or any(start < e and s < end for s, e in taken)):
            continue
        taken.append((start, end))
        out.append((kind, start, end, score))
    return out


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("text", pa.string())]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[{"kind": k, "start": s, "end": e, "score": p, "text": t[s:e]} for k, s, e, p in spans(t)]
                 for t in (x.as_py() for x in batch.column("text"))]
        yield pa.record_batch([batch.column("doc_id"), pa.array(found, _FOUND)], names=["doc_id", "spans"])


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: kind, start, end, score and text of each finding, one row for each row of ``docs``."""
    return narrow(docs, id_col, text_col).mapInArrow(
        _find, "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double, text: string>>")


def listed(found: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in found)


def base_digest(found: list[Span]) -> str:
    return hashlib.sha256(listed([x for x in found if x[0] in BASE]).encode()).hexdigest()
