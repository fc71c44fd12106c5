"""Personal data and secrets: patterns propose spans, check sums or entropy confirm them, words nearby raise or lower the score."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from stratalens.llm.text import only

#: The base kinds in their order, then those the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")
#: Characters looked at on either side of a span for context words.
NEAR = 60

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DIGIT = re.compile(r"[0-9]")
# Digits are taken greedily and never given back: no other split of the same run could match.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")

# A value after the name of a secret, and keys that are known by their form alone. Runs are taken greedily and never given back.
_NAMED_SECRET = re.compile(
    r"(?<![A-Za-z])(?:api[_-]?key|(?:secret|access|private)[_-]?key|client[_-]?secret|(?:auth|access|bearer)[_-]?token|token|secret|passw(?:or)?d|pwd)"
    r"[\"']?\x20{0,3}[:=]\x20{0,3}[\"']?([A-Za-z0-9_+/=.~-]{16,}+)",
    re.I,
)
_KEY = re.compile(
    r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}(?![0-9A-Z])|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9_-]{20,}+"
    r"|eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)"
)
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z]{2,9} )?PRIVATE KEY-----")
#: Least bits a character of a secret: words have fewer, random letters and digits more.
ENTROPY = 3.0

#: kind -> score of a confirmed span without context, words that raise it, words that lower it.
PRIORS = {
    "email": (0.9, r"mail|contact|write|schreib|correo|courriel", r"example|noreply"),
    "ip": (0.6, r"\bip\b|address|host|server|adresse|direcci", r"version|release|build|chapter|section"),
    "card": (0.8, r"card|visa|credit|debit|payment|karte|tarjeta|carte", r"order|isbn|serial|tracking|invoice"),
    "phone": (0.8, r"phone|call|tel|mobile|fax|anruf|llam|appel", r"isbn|version|score"),
    "iban": (0.9, r"iban|account|bank|konto|cuenta|compte", r"serial|model"),
    "ssn": (0.3, r"\bssn\b|social security|tax id", r"part|serial|order"),
    "secret": (0.7, r"api|auth|credential|login|secret|key", r"example|placeholder|dummy|sample"),
}
_CONTEXT = {k: (base, re.compile(up, re.I), re.compile(down, re.I)) for k, (base, up, down) in PRIORS.items()}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def random_looking(value: str) -> bool:
    """Letters and digits mixed, with the entropy of a drawn text."""
    n = len(value)
    bits = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    return bits >= ENTROPY and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    """Values of named secrets and keys of known form, each place once."""
    done = -1
    found = [m.span(1) for m in _NAMED_SECRET.finditer(text)] + [m.span() for m in _KEY.finditer(text)]
    for start, end in sorted(found, key=lambda s: (s[0], -s[1])):
        if start >= done and random_looking(text[start:end]):
            yield start, end
            done = end


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The longest run of name characters before each sign, and the domain after it."""
    done, sign = 0, text.find("@")
    while sign >= 0:
        start = sign
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, sign + 1) if start < sign else None
        done = domain.end() if domain else sign + 1
        if domain:
            yield start, done
        sign = text.find("@", done)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans whose pattern and check sum hold. Every pattern takes time in proportion to the text."""
    if "@" in text:
        for start, end in _emails(text):
            yield "email", start, end
    if "PRIVATE KEY" in text:
        for m in _PRIVATE.finditer(text):
            yield "secret", *m.span()
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(map(_small, m.group().split("."))):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _digits(m.group())) <= 19 and luhn(digits):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                yield "phone", *m.span()
    for m in _IBAN.finditer(text):
        account = m.group().replace(" ", "")
        if 15 <= len(account) <= 34 and mod97(account):
            yield "iban", *m.span()
    for m in _SSN.finditer(text):
        yield "ssn", *m.span()
    for start, end in _secrets(text):
        yield "secret", start, end


def find_spans(text: str | None, min_score: float = 0.5) -> list[Span]:
    """Spans by start, then kind in the order of ``KINDS``. Base kinds stay whatever their score."""
    text = text or ""
    found = []
    for kind, start, end in proposed(text):
        base, up, down = _CONTEXT[kind]
        near = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
        score = min(1.0, max(0.0, base + 0.3 * bool(up.search(near)) - 0.3 * bool(down.search(near))))
        if kind in BASE_KINDS or score >= min_score:
            found.append(Span(kind, start, end, round(score, 2)))
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with every span replaced by its kind; of overlapping spans, the first counts."""
    parts, at = [], 0
    for span in spans:
        if span.start >= at:
            parts += [text[at : span.start], f"<{span.kind}>"]
            at = span.end
    return "".join([*parts, text[at:]])


def find_pii(docs: DataFrame, min_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans, masked_text`` for every row of ``docs``.

    ``spans`` are structs of kind, start, end (characters, end exclusive) and score. Rows are read
    where they lie; nothing is shuffled.

    Edge cases: null and empty texts have no spans and an empty masked text; every row is judged by its own text,
    repeated ones too; an empty table gives an empty result; other columns are ignored.
    """
    base = only(docs, doc_id=id_col, text=text_col)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, texts = [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                found = find_spans(text, min_score)
                spans.append([s._asdict() for s in found])
                texts.append(masked(text, found) if found else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(spans, pa.list_(span)), pa.array(texts, pa.string())],
                ["doc_id", "spans", "masked_text"],
            )

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(
        scan,
        f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint, score: double>>, masked_text string",
    )
