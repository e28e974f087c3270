"""Personal data: patterns propose spans, checksums confirm, context words adjust the score.

Kinds in listed order: email, ip, card, phone, iban, secret, ssn, local_phone.
The first four keep every span that their pattern proposes and their check
confirms. The others need a score of ``MIN_SCORE`` as well: a kind has a first
score, words of it nearby raise it by ``CONTEXT_GAIN``, and words that speak
for something else (a checksum, an order number) lower it by as much. An IBAN
of its country's length passes by mod 97 alone, one of another length needs a
bank nearby; so do a random-looking string, a social security number and a
phone number without country code with words of theirs. Each kind is matched
leftmost without overlaps, on whole texts, in time linear in the text; spans
of the last four that touch one listed before them are dropped.

Defined results: a null text counts as empty and has no spans. Repeated rows
are each searched. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from cityfeed.llm.common import map_arrow, slices

KINDS = ("email", "ip", "card", "phone", "iban", "secret", "ssn", "local_phone")
BASE_KINDS = 4
MIN_SCORE = 0.5
CONTEXT_CHARS = 60

#: First score, gain or loss by a context word nearby, and the words.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.3, "secret": 0.3, "ssn": 0.3, "local_phone": 0.3}
KNOWN_FORM = 0.4
CONTEXT_GAIN = 0.3
CONTEXT_WORDS = {
    "email": ("mail", "contact", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"),
    "secret": ("token", "secret", "password", "passwd", "api", "apikey", "key", "bearer", "credential", "passwort", "clave"),
    "ssn": ("ssn", "social security", "tax id", "taxpayer"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon"),
}
AGAINST = {
    "email": (),
    "ip": ("version", "release"),
    "card": ("order", "invoice", "isbn"),
    "phone": (),
    "iban": ("order", "invoice"),
    "secret": ("sha", "sha1", "sha256", "md5", "commit", "checksum", "digest", "hash", "etag", "uuid"),
    "ssn": ("order", "invoice", "part", "isbn"),
    "local_phone": ("order", "invoice", "isbn", "article"),
}
#: Characters of an IBAN by country.
IBAN_LENGTH = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21,
    "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24,
    "SI": 19, "SK": 24, "TR": 26,
}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DIGIT = re.compile(r"[0-9]")
# a run of digits is tried from its first digit only: if that fails, so does every later start
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{20,200}+={0,2}+(?![A-Za-z0-9_+/=-])")
#: How keys of well-known services start.
SECRET_FORMS = re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-|sk_live_")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+(])(?:\([0-9]{2,5}\)|[0-9]{3,5})[\x20./-][0-9]{3,8}(?:[\x20-][0-9]{2,5})?(?![0-9])")


def _words(words: tuple[str, ...]):
    return re.compile(r"\b(?:" + "|".join(words) + r")", re.IGNORECASE) if words else None


FOR = {k: _words(words) for k, words in CONTEXT_WORDS.items()}
CONTRARY = {k: re.compile(r"\b(?:" + "|".join(words) + r")\b", re.IGNORECASE) if words else None for k, words in AGAINST.items()}


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: int
    score: float

    def __str__(self) -> str:
        return f"{KINDS[self.kind]}:{self.start}:{self.end}"


def luhn(digits: str) -> bool:
    """Whether a digit string passes the Luhn check."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without blanks passes mod 97."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str):
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            free = m.end()
            yield start, free
        at = text.find("@", max(free, at + 1))


def _ips(text: str):
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            yield m.span()


def _cards(text: str):
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield m.span()


def _ibans(text: str):
    for m in IBAN.finditer(text):
        # a blank may lead on into the next word, so the longest stretch that passes counts
        end = m.end()
        while end > m.start():
            code = text[m.start() : end].replace(" ", "")
            if len(code) >= 15 and mod97(code):
                yield m.start(), end
                break
            end = text.rfind(" ", m.start(), end)


def _secrets(text: str):
    """Strings in which letters and digits are mixed and no character is frequent."""
    for m in SECRET.finditer(text):
        x = m.group()
        count = Counter(x)
        if sum(c.isdigit() for c in x) >= 3 and sum(c.isalpha() for c in x) >= 3 and len(count) >= 10 and 3 * max(count.values()) <= len(x):
            yield m.span()


def _ssns(text: str):
    for m in SSN.finditer(text):
        yield m.span()


def _local_phones(text: str):
    for m in LOCAL_PHONE.finditer(text):
        if 7 <= sum(c.isdigit() for c in m.group()) <= 12:
            yield m.span()


FINDERS = (_emails, _ips, _cards, _phones, _ibans, _secrets, _ssns, _local_phones)


def _has_known_form(name: str, span: str) -> bool:
    if name == "iban":
        return IBAN_LENGTH.get(span[:2]) == len(span.replace(" ", ""))
    return name == "secret" and SECRET_FORMS.match(span) is not None


def _near(words, text: str, start: int, end: int) -> bool:
    if words is None:
        return False
    return bool(words.search(text, max(0, start - CONTEXT_CHARS), start) or words.search(text, end, end + CONTEXT_CHARS))


def score_of(name: str, text: str, start: int, end: int) -> float:
    """Score of a confirmed span by its form and by the words around it, from 0 to 1."""
    score = BASE_SCORE[name] + KNOWN_FORM * _has_known_form(name, text[start:end])
    score += CONTEXT_GAIN * (_near(FOR[name], text, start, end) - _near(CONTRARY[name], text, start, end))
    return min(max(score, 0.0), 1.0)


def find_spans(text: str | None) -> list[Span]:
    """All confirmed spans of a text, by start and then kind as listed."""
    if not text:
        return []
    digits = DIGIT.search(text) is not None
    out: list[Span] = []
    for kind, (name, find) in enumerate(zip(KINDS, FINDERS, strict=True)):
        if kind and not digits or name == "phone" and "+" not in text:
            continue
        found = list(find(text))
        if kind >= BASE_KINDS and found:
            found = _apart(found, out)
        for start, end in found:
            score = score_of(name, text, start, end)
            if kind < BASE_KINDS or score >= MIN_SCORE:
                out.append(Span(start, end, kind, score))
    return sorted(out, key=lambda s: (s.start, s.kind))


def _apart(found: list[tuple[int, int]], taken: list[Span]) -> list[tuple[int, int]]:
    """The ranges, in order, that touch none of ``taken``."""
    starts = sorted((s.start, s.end) for s in taken)
    reach = list(accumulate((e for _, e in starts), max, initial=0))  # furthest end of the first k
    return [(a, b) for a, b in found if reach[bisect_left(starts, (b, 0))] <= a]


OUT = pa.schema(
    [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("n_personal", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("scores", pa.string())]
)
OUT_DDL = "doc_id long, " + "".join(f"n_{k} long, " for k in KINDS) + "n_personal long, base_sha256 string, spans string, scores string"


def _batches(batches):
    for batch in slices(batches, 1):
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            spans = find_spans(text)
            counts = [sum(s.kind == k for s in spans) for k in range(len(KINDS))]
            base = ",".join(str(s) for s in spans if s.kind < BASE_KINDS)
            rows.append((doc_id, *counts, len(spans), hashlib.sha256(base.encode()).hexdigest(), ",".join(map(str, spans)), ",".join(f"{s.score:.1f}" for s in spans)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), OUT, strict=True)] if rows else [pa.array([], f.type) for f in OUT], schema=OUT)


def scan(docs: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, all spans and their scores, one row per row of ``doc_id, text``."""
    return map_arrow(docs.select("doc_id", "text"), _batches, OUT_DDL)
