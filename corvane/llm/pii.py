"""Personal data with offsets in the source text, also where it is disguised.

Base detectors find e-mail addresses, IPv4 addresses, card numbers and phone numbers in the text as it is. Then transducers rewrite the
disguises of a text: look-alike letters and full-width characters to ASCII, digit words in a row to digits, "at" and "dot" in brackets or
between the parts of an address to @ and full stops. Each keeps for every character it puts out the source characters it came from. The
detectors run again on the rewritten text; what they find there is mapped back and added unless a base span of its kind overlaps it.

Spans are in code points, the end exclusive. Every search is linear in the text: a number or a local part is tried once at its run, not at each of
its characters. Edge cases: a null or empty text has no spans; rows with one doc_id each give a row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.common import keyed_text

KINDS = ("email", "ip", "card", "phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
Span = tuple[int, int]


def _emails(text: str) -> list[Span]:
    """Each @ is tried once, with the longest local part before it."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and _LOCAL.match(text, begin - 1):
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((begin, end))
        else:
            end = max(end, at)
        at = text.find("@", max(at + 1, end))
    return out


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def find(text: str) -> dict[str, list[Span]]:
    """Base spans by kind."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if not _ANY_DIGIT.search(text):
        return out
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_byte, m.groups()))]
    for m in _CARD.finditer(text):
        d = m[0] if m[0].isdigit() else _digits(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


_ANY_DIGIT = re.compile("[0-9]")

# Letters and marks that look like ASCII ones, and digit words.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹫": "@", "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "", " ": " ", " ": " ", " ": " ",
}
LOOKALIKES |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
LOOKALIKES |= {chr(base + d): str(d) for base in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_LOOKALIKE = re.compile("[" + "".join(map(re.escape, LOOKALIKES)) + "]+")
_WORD = "|".join(DIGIT_WORDS)
_SPELLED = re.compile(rf"(?i)(?<![a-z])(?:plus[\x20-]+)?(?:{_WORD})(?:[\x20,-]{{1,2}}(?:{_WORD}|[0-9])(?![a-z])){{6,}}")
_SPELLED_PART = re.compile(rf"(?i){_WORD}|plus|[0-9]")
_OCTETS = re.compile(rf"(?i)(?<![a-z])((?:(?:{_WORD})[\x20-]?){{1,3}})[\x20]?(?:dot|point)[\x20]?((?:(?:{_WORD})[\x20-]?){{1,3}})[\x20]?(?:dot|point)[\x20]?((?:(?:{_WORD})[\x20-]?){{1,3}})[\x20]?(?:dot|point)[\x20]?((?:(?:{_WORD})[\x20-]?){{1,3}})(?![a-z])")
_BRACKET = re.compile(r"(?i)[\x20]{0,2}[\[({<][\x20]{0,2}(at|dot|punkt|punto|point|arroba|@|\.)[\x20]{0,2}[\])}>][\x20]{0,2}")
_SPACED = re.compile(r"(?i)(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]++)[\x20]{1,2}(at|@)[\x20]{1,2}([A-Za-z0-9-]++(?:[\x20]{1,2}(?:dot|\.)[\x20]{1,2}[A-Za-z0-9-]++)++)")
_DOT_DIGITS = re.compile(r"(?i)(?<![0-9])([0-9]{1,3})[\x20]{1,2}(?:dot|point)[\x20]{1,2}([0-9]{1,3})[\x20]{1,2}(?:dot|point)[\x20]{1,2}([0-9]{1,3})[\x20]{1,2}(?:dot|point)[\x20]{1,2}([0-9]{1,3})(?![0-9])")
_HINT = re.compile(r"(?i)[\x20\])}>](?:at|dot|@|point|punkt|punto|arroba)[\x20\])}>]|[\[({<][\x20]{0,2}(?:at|dot|@|\.|punkt|punto|point|arroba)[\x20]{0,2}[\])}>]|(?<![a-z])(?:" + _WORD + r")[\x20,-]")


@dataclass
class Tape:
    """A text, and for each of its characters where its source begins and ends."""

    text: str
    begin: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, text: str) -> Tape:
        at = np.arange(len(text))
        return cls(text, at, at + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """With text[a:b] replaced by each edit's string; all its characters come from all of text[a:b]."""
        texts, begins, ends, at = [], [], [], 0
        for a, b, new in edits:
            texts += [self.text[at:a], new]
            begins += [self.begin[at:a], np.full(len(new), self.begin[a])]
            ends += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            at = b
        return Tape("".join([*texts, self.text[at:]]), np.concatenate([*begins, self.begin[at:]]), np.concatenate([*ends, self.end[at:]]))

    def source(self, span: Span) -> Span:
        return int(self.begin[span[0]]), int(self.end[span[1] - 1])


def _lookalikes(text: str) -> list[tuple[int, int, str]]:
    return [(i, i + 1, LOOKALIKES[text[i]]) for m in _LOOKALIKE.finditer(text) for i in range(*m.span())]


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Rows of at least seven digit words; a digit for each word, from that word."""
    out = []
    for m in _SPELLED.finditer(text):
        at = m.start()
        for w in _SPELLED_PART.finditer(text, *m.span()):
            if w.start() > at:
                out.append((at, w.start(), ""))
            word = w[0].lower()
            out.append((w.start(), w.end(), "+" if word == "plus" else DIGIT_WORDS.get(word, word)))
            at = w.end()
    return out


def _addresses(text: str) -> list[tuple[int, int, str]]:
    out = [(*m.span(), "@" if m[1].lower() in ("at", "@", "arroba") else ".") for m in _BRACKET.finditer(text)]
    for m in _SPACED.finditer(text):
        if m[2] == "@" or re.search(r"(?i)\bdot\b|\.", m[3]):
            out.append((m.end(1), m.start(3), "@"))
            out += [(m.start(3) + d.start(), m.start(3) + d.end(), ".") for d in re.finditer(r"(?i)[\x20]{1,2}(?:dot|\.)[\x20]{1,2}", m[3])]
    for m in _DOT_DIGITS.finditer(text):
        out += [(m.end(k), m.start(k + 1), ".") for k in (1, 2, 3)]
    for m in _OCTETS.finditer(text):
        at = m.start()
        for k in (1, 2, 3, 4):
            for w in re.finditer(rf"(?i){_WORD}", m[k]):
                out.append((at, m.start(k) + w.end(), DIGIT_WORDS[w[0].lower()]) if w.start() == 0 and k == 1 else (m.start(k) + w.start(), m.start(k) + w.end(), DIGIT_WORDS[w[0].lower()]))
                at = m.start(k) + w.end()
            if k < 4:
                out.append((at, m.start(k + 1), "."))
    out.sort()
    apart, end = [], 0
    for a, b, new in out:
        if a >= end and b > a:
            apart.append((a, b, new))
            end = b
    return apart


def disguised(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that only the rewritten text shows."""
    odd = not text.isascii() and _LOOKALIKE.search(text) is not None
    if not odd and not _HINT.search(text):
        return {}
    tape, changed = Tape.of(text), False
    for step in (_lookalikes, _addresses, _spelled):
        if edits := step(tape.text):
            tape, changed = tape.rewrite(edits), True
    if not changed or not tape.text:
        return {}
    out: dict[str, list[Span]] = {}
    for kind, spans in find(tape.text).items():
        taken = sorted(base[kind])
        starts = [a for a, _ in taken]
        for span in spans:
            a, b = tape.source(span)
            k = np.searchsorted(starts, b, "left") - 1 if starts else -1
            if k < 0 or taken[k][1] <= a:
                out.setdefault(kind, []).append((a, b))
    return out


def _joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans.get(k, ())))


def detect(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans, and all spans."""
    base = find(text or "")
    more = disguised(text or "", base)
    return base, {k: base[k] + more.get(k, []) for k in KINDS}


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and all spans of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [detect(t.as_py()) for t in batch.column("text")]
            counts = [pa.array([len(base[k]) for base, _ in found], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], pa.string()), pa.array([_joined(every) for _, every in found], pa.string())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    return keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
