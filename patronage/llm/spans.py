"""Spans (kind, start, end) in code points, as the personal-data and secret scans return them."""
from __future__ import annotations

import hashlib

Span = tuple[str, int, int]


def in_order(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
