"""Personal data: patterns propose spans, validators confirm them, nearby words adjust the score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Order of the kinds in results; the first four make up the base.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "tel")

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
DIGIT = re.compile(r"[0-9]")
#: Matches of IP lie inside such runs; finding the runs first is quicker.
DOTTED = re.compile(r"[0-9][0-9.]*")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
TEL = re.compile(r"(?<![0-9+().-])(?<!\+[0-9] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")

#: Words near a span that speak for its kind, score of a bare match, score that a span needs.
CONTEXT = {
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "taxpayer"),
    "tel": ("call", "phone", "tel", "mobile", "telefon", "téléphone", "teléfono"),
}
#: Words near a span that speak against a kind.
AGAINST = {"iban": (), "ssn": ("order", "invoice", "isbn", "serial", "ticket"), "tel": ("order", "invoice", "isbn", "serial", "ticket")}
SCORE = {"iban": 0.4, "ssn": 0.3, "tel": 0.3}
VALID_BONUS, CONTEXT_BONUS, AGAINST_LOSS, NEEDED, NEAR = 0.4, 0.4, 0.2, 0.7, 48
WORD = re.compile(r"\w+")
DIGITS = str.maketrans("", "", " ().-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their @ so that long runs without one cost nothing."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(last, at + 1))


def ip_matches(text: str, at: int, end: int) -> Iterator[re.Match]:
    """The pattern's matches in a run of digits and dots. A start inside a run of digits is never tried, as a
    match from there would be part of one from the run's start."""
    while at < end:
        if found := IP.match(text, at, end):
            yield found
            at = found.end()
        else:
            while at < end and text[at] != ".":
                at += 1
        while at < end and text[at] == ".":
            at += 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return spans
    for run in DOTTED.finditer(text):
        if run[0].count(".") >= 3:
            spans += [("ip", *m.span()) for m in ip_matches(text, *run.span()) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].translate(DIGITS)) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return spans


def nearby(text: str, start: int, end: int) -> str:
    """The whole words that begin and end within NEAR characters of a span, in lower case, with a space around each."""
    low, high = max(0, start - NEAR), min(len(text), end + NEAR)
    while low and low < start and WORD.match(text[low - 1 : low]):
        low += 1
    while high < len(text) and high > end and WORD.match(text[high : high + 1]):
        high -= 1
    return f" {' '.join(WORD.findall(text[low:start].lower()))} | {' '.join(WORD.findall(text[end:high].lower()))} "


def added_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int, float]]:
    """Further spans whose score, from validator and nearby words, is high enough."""
    spans = []
    if not DIGIT.search(text):
        return spans
    for kind, pattern in (("iban", IBAN), ("ssn", SSN), ("tel", TEL)):
        for m in pattern.finditer(text):
            if any(a < m.end() and m.start() < b for _, a, b in taken):
                continue
            valid = False
            if kind == "iban":
                valid = 15 <= len(plain := m[0].replace(" ", "")) <= 34 and mod97(plain)
                if not valid:
                    continue
            elif kind == "ssn":
                valid = m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000"
                if not valid:
                    continue
            near = nearby(text, *m.span())
            speaks = lambda words: any(f" {w} " in near for w in words)
            score = SCORE[kind] + VALID_BONUS * (kind == "iban") + CONTEXT_BONUS * speaks(CONTEXT[kind]) - AGAINST_LOSS * speaks(AGAINST[kind])
            if score >= NEEDED:
                spans.append((kind, *m.span(), score))
    return spans


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, list] = {k: [] for k in BASE}
        shas, spans, scores = [], [], []
        for text in batch.column(1):
            text = text.as_py() or ""
            base = base_spans(text)
            more = added_spans(text, base)
            for k in BASE:
                counts[k].append(sum(x[0] == k for x in base))
            shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(base + [x[:3] for x in more]))
            scores.append([1.0] * len(base) + [x[3] for x in more])
        yield pa.record_batch({"doc_id": batch.column(0), **{f"n_{k}": pa.array(v, pa.int64()) for k, v in counts.items()}, "base_sha256": pa.array(shas, pa.string()), "spans": pa.array(spans, pa.string()), "scores": pa.array(scores, pa.list_(pa.float64()))})


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of personal data in each whole text, one row per row of ``docs``.

    Columns: doc_id, n_email, n_ip, n_card, n_phone (of the base), base_sha256, spans and scores. Spans count code
    points, end exclusive. A null or empty text has no spans, repeated rows give repeated rows, and an empty table
    gives none. Added kinds are iban (mod-97 must hold), ssn and tel (a context word must be near); they never
    overlap a base span. Other columns of ``docs`` are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>")


def redact(text: str, spans: str) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans merge into the first."""
    parts, last = [], 0
    for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)), key=lambda s: (s[1], -s[2])):
        if b > last:
            if a >= last:
                parts += [text[last:a], f"<{kind}>"]
            last = b
    return "".join([*parts, text[last:]])
