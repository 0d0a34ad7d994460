"""Byte spans in texts as code point spans, and their text form kind:start:end."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from itertools import accumulate

from lexquarry.llm.textbytes import code_points

Span = tuple[str, int, int]


def apart(found: list[Span], base: list[Span]) -> list[Span]:
    """Those of found that overlap no span of base."""
    taken = sorted((s, e) for _, s, e in base)
    starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    out = []
    for kind, s, e in found:
        before = bisect_left(starts, e)  # those that start before the end; one of them reaches the start or none does
        if not before or reach[before - 1] <= s:
            out.append((kind, s, e))
    return out


def in_code_points(text: bytes, found: list[Span]) -> list[Span]:
    before = code_points(text) if found else None
    return found if before is None else [(k, int(before[s]), int(before[e])) for k, s, e in found]


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def digest(found: list[Span]) -> str:
    return hashlib.sha256(joined(found).encode()).hexdigest()
