"""Personal data, disguised or plain: email, ip, card and phone spans in source code points.

Base spans are found in the text as it is. Then rewriting transducers normalise the text: look-alike
characters, invisible characters, spelled digits, and disguises of "at" and "dot". Each rewrite keeps, for
every normalised character, the source range it came from, so identifiers found in the normalised text map back
to source characters. A mapped span is added if a rewrite took place inside it and it overlaps no base span of its kind, or
holds more than each of those it overlaps; base spans stay.

Defined results: null text counts as empty (no spans, digest of the empty string); repeated rows are scanned
each; all work is linear in the text, so very long texts and runs are safe; further columns are not read.
"""
from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import map_rows
from patronage.llm.spans import Span, digest, in_order, joined

KINDS = ("email", "ip", "card", "phone")

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a run of digits that fails as a whole fails from inside as well, so only its start is tried
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping matches: each @ takes the longest run before it that no earlier match holds."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and _LOCAL_END.match(text, start - 1):
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield "email", start, match.end()
            free = match.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def found(text: str) -> list[Span]:
    """Spans of all kinds in the text as it is."""
    out: list[Span] = list(emails(text)) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 14:
            digits = re.sub(r"[^0-9]", "", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
                out.append(("phone", *m.span()))
    return in_order(out, KINDS)


# Characters that look like another one, and invisible ones.
LOOK_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "τ": "t", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɑ": "a", "ɡ": "g",
    "﹫": "@", "․": ".", "。": ".", "｡": ".", "﹒": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ", " ": " ",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}
# full-width forms and digits of other scripts follow a rule
LOOK_ALIKE |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
LOOK_ALIKE |= {chr(zero + i): str(i) for zero in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for i in range(10)}
LOOK_ALIKE |= {chr(0x2080 + i): str(i) for i in range(10)} | {chr(0x2460 + i): str(i + 1) for i in range(9)} | {"⓪": "0", "⁰": "0", "¹": "1", "²": "2", "³": "3"}
LOOK_ALIKE |= {chr(0x2074 + i): str(i + 4) for i in range(6)}

# Digits spelled in English, German, French and Spanish.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_AT = "at|arroba|arobase|klammeraffe"
_DOT = "dot|punkt|punto|point|period"
_PLUS = "plus"

_ODD = re.compile("[" + "".join(map(re.escape, LOOK_ALIKE)) + "]")
_WORD = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
_ITEM = rf"(?:{_WORD}|{_PLUS}|{_DOT}|[0-9]+)"
_BETWEEN = r"(?:[ ]?[,.\-/][ ]?|[ ]|(?<=[0-9])|(?=[0-9]))"
_CHAIN = re.compile(rf"(?<!\w)(?:\+[ ]?)?{_ITEM}(?:{_BETWEEN}{_ITEM})+(?!\w)", re.IGNORECASE)
_IN_CHAIN = re.compile(rf"\+|{_WORD}|{_PLUS}|{_DOT}|[0-9]+", re.IGNORECASE)
_BRACKET_AT = rf"[ ]?[(\[{{<][ ]?(?:{_AT}|@)[ ]?[)\]}}>][ ]?"
_BRACKET_DOT = rf"[ ]?[(\[{{<][ ]?(?:{_DOT}|\.)[ ]?[)\]}}>][ ]?"
_ANY_AT = rf"(?:{_BRACKET_AT}|[ ](?:{_AT})[ ]|[_-](?:{_AT})[_-]|[ ]?&(?:\#64|\#x40|commat);[ ]?|[ ]@[ ]|%40|@)"
_ANY_DOT = rf"(?:{_BRACKET_DOT}|[ ](?:{_DOT})[ ]|[_-](?:{_DOT})[_-]|&(?:\#46|\#x2e|period);|[ ]\.[ ]|\.)"
_LOCAL_DOT = rf"(?:{_BRACKET_DOT}|[ ](?:{_DOT})[ ]|&(?:\#46|\#x2e|period);|[ ]\.[ ])(?=[A-Za-z0-9])"
_AT_SIGN = re.compile(_ANY_AT, re.IGNORECASE)
# runs of local characters and disguised dots; each character belongs to one run, and each run is read once
_LOCAL_RUN = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9%+._-]++|{_LOCAL_DOT})*+", re.IGNORECASE)
_HIDDEN_DOT_NEXT = rf"(?![_-](?:{_DOT})[_-])"
_LABEL = rf"[A-Za-z0-9](?:{_HIDDEN_DOT_NEXT}[A-Za-z0-9-])*+"
_HIDDEN_DOMAIN = re.compile(rf"{_LABEL}(?:{_ANY_DOT}{_LABEL})++", re.IGNORECASE)
_INSIDE_RUN = re.compile(rf"[_-](?:{_AT})[_-]|%40", re.IGNORECASE)
_DOT_IN = re.compile(_ANY_DOT, re.IGNORECASE)
_DOTS_IP = re.compile(rf"(?<![0-9.])[0-9]++(?:{_ANY_DOT}[0-9]++){{3}}", re.IGNORECASE)
#: Disguises of at and dot, from the pieces of the patterns above: an edit of an address or of dots needs one of them. " at " alone is none.
_SIGN = re.compile(rf"[(\[{{<][ ]?(?:{_AT}|@|{_DOT}|\.)[ ]?[)\]}}>]|[ ](?:{_DOT}|@|\.)[ ]|[_-](?:{_AT}|{_DOT})[_-]|&(?:\#64|\#x40|commat|\#46|\#x2e|period);|%40", re.IGNORECASE)


class Mapped:
    """A rewritten text as pieces; each piece knows its source range and whether it was rewritten."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None, changed: list[bool] | None = None) -> None:
        self.text = text
        self.starts = list(range(len(text))) if starts is None else starts
        self.ends = list(range(1, len(text) + 1)) if ends is None else ends
        self.changed = [False] * len(text) if changed is None else changed

    def rewritten(self, edits: list[tuple[int, int, str]]) -> "Mapped":
        """Ranges of the normalised text replaced; a replacement comes from the whole source range it replaces."""
        if not edits:
            return self
        text, starts, ends, changed, upto = [], [], [], [], 0
        for a, b, new in edits:
            text += [self.text[upto:a], new]
            starts += self.starts[upto:a] + [self.starts[a]] * len(new)
            ends += self.ends[upto:a] + [self.ends[b - 1]] * len(new)
            changed += self.changed[upto:a] + [True] * len(new)
            upto = b
        return Mapped("".join(text) + self.text[upto:], starts + self.starts[upto:], ends + self.ends[upto:], changed + self.changed[upto:])

    def source(self, span: Span) -> Span:
        return span[0], self.starts[span[1]], self.ends[span[2] - 1]


def _look_alikes(m: Mapped) -> list[tuple[int, int, str]]:
    return [(x.start(), x.end(), LOOK_ALIKE[x.group()]) for x in _ODD.finditer(m.text)]


def _spelled_digits(m: Mapped) -> list[tuple[int, int, str]]:
    """Chains of spelled digits, digits, dots and a plus become one number; needs four digits and a spelled one."""
    edits = []
    for chain in _CHAIN.finditer(m.text):
        out, words = [], 0
        for item in _IN_CHAIN.finditer(m.text, *chain.span()):
            word = item.group().lower()
            new = SPELLED.get(word) or ("+" if word in (_PLUS, "+") else word if word.isdigit() else ".")
            words += word in SPELLED
            out.append((item.start(), item.end(), new))
        if not words or sum(len(x[2]) for x in out if x[2].isdigit()) < 4:
            continue
        for i, (a, b, new) in enumerate(out):
            edits.append((a, out[i + 1][0] if i + 1 < len(out) else b, new))
    return edits


def _at_and_dot(m: Mapped) -> list[tuple[int, int, str]]:
    edits = []
    for local, at, domain in disguised(m.text):
        inner = [(d.start(), d.end(), ".") for d in _DOT_IN.finditer(m.text, *domain) if d.group() != "."]
        plain = re.fullmatch(rf"[ ](?:{_AT})[ ]", m.text[at[0]:at[1]], re.IGNORECASE)
        if plain and not inner:  # "stay at example.com" is a sentence
            continue
        dots = [(d.start(), d.end(), ".") for d in _DOT_IN.finditer(m.text, *local) if d.group() != "."]
        edits += dots + ([(at[0], at[1], "@")] if m.text[at[0]:at[1]] != "@" else []) + inner
    return edits


def disguised(text: str) -> Iterator[tuple[tuple[int, int], tuple[int, int], tuple[int, int]]]:
    """(local part, at, domain) of each address, leftmost first, plain or disguised, of any length.

    A run of local characters ends before an at-sign that is none of them, or holds signs such as ``_at_``: of these the
    first one with a domain after it counts.
    """
    free = 0
    for run in _LOCAL_RUN.finditer(text):
        start, end = max(run.start(), free), run.end()
        if end <= start:
            continue
        after = _AT_SIGN.match(text, end)
        for at in [*_INSIDE_RUN.finditer(text, start, end), *([after] if after else [])]:
            domain = _HIDDEN_DOMAIN.match(text, at.end()) if at.start() > start else None
            if domain:
                yield (start, at.start()), at.span(), domain.span()
                free = domain.end()
                break


def _dots_between_digits(m: Mapped) -> list[tuple[int, int, str]]:
    return [(d.start(), d.end(), ".") for x in _DOTS_IP.finditer(m.text) for d in _DOT_IN.finditer(m.text, *x.span()) if d.group() != "."]


def steps_for(text: str) -> list[Callable[[Mapped], list[tuple[int, int, str]]]]:
    """The rewrites a text needs, by signs without which they change nothing."""
    steps: list[Callable] = []
    if not text.isascii() and _ODD.search(text):
        steps.append(_look_alikes)
        text = _ODD.sub(lambda x: LOOK_ALIKE[x.group()], text)
    if _WORD_FIRST.search(text) or _WORD_NEXT.search(text):
        steps.append(_spelled_digits)
    if _SIGN.search(text):
        steps += [_at_and_dot, _dots_between_digits]
    return steps


# in a chain that counts, a spelled digit has a neighbour after it or before it
_WORD_FIRST = re.compile(rf"(?<![^\W0-9]){_WORD}{_BETWEEN}{_ITEM}", re.IGNORECASE)
_WORD_NEXT = re.compile(rf"(?:[0-9]|{_PLUS}|{_DOT}){_BETWEEN}{_WORD}", re.IGNORECASE)


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans)."""
    base = found(text)
    steps = steps_for(text)
    if not steps:
        return base, base
    m = Mapped(text)
    for step in steps:
        m = m.rewritten(step(m))
    if m.text == text:
        return base, base
    changes = [i for i, c in enumerate(m.changed) if c]
    extra = []
    for s in found(m.text):
        at = bisect.bisect_left(changes, s[1])
        touched = at < len(changes) and changes[at] < s[2] or m.ends[s[2] - 1] - m.starts[s[1]] != s[2] - s[1]
        mapped = m.source(s)
        if touched and all(mapped[1] <= a and b <= mapped[2] and (a, b) != mapped[1:] for k, a, b in base if k == mapped[0] and a < mapped[2] and mapped[1] < b):
            extra.append(mapped)
    return base, in_order(base + extra, KINDS)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (all), n_added — one row per document."""
    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": batch["doc_id"], **{f"n_{k}": [] for k in KINDS}, "base_sha256": [], "spans": [], "n_added": []}
            for text in batch["text"]:
                base, all_spans = scan(text or "")
                for kind in KINDS:
                    out[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
                out["base_sha256"].append(digest(joined(base)))
                out["spans"].append(joined(all_spans))
                out["n_added"].append(len(all_spans) - len(base))
            yield out

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(rows, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long", work)
