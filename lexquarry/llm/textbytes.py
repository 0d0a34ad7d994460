"""Vectorised access to the UTF-8 bytes of a string column inside Arrow batches.

Every operator that works on bytes or words in Python goes through here: rows are taken in slices of bounded
size, each slice is one byte array, and words, lines and hashes are found for all its rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
PIECE = 1 << 15
EIGHT = 8
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


@dataclass
class Slice:
    """Some rows of a batch. data holds a newline before, between and after the texts; starts and ends are theirs."""

    rows: pa.RecordBatch
    data: np.ndarray
    raw: bytes
    starts: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def text(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.ends[i]]

    def per_row(self, marks: np.ndarray) -> np.ndarray:
        """The sum of marks (one for each byte) for each row."""
        total = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(marks, out=total[1:])
        return total[self.ends] - total[self.starts]

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Slices of about `most` bytes of text; a longer text is alone in its slice. Null counts as empty."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(column))
        if not pa.types.is_large_string(text.type):
            text = text.cast(pa.large_string())
        text = text.fill_null("")
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        body = memoryview(text.buffers()[2]) if text.buffers()[2] is not None else memoryview(b"")
        first = 0
        while first < len(text):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
            last = min(last, len(text))
            raw = b"\n" + b"\n".join([body[offsets[i] : offsets[i + 1]] for i in range(first, last)]) + b"\n"
            sizes = np.diff(offsets[first : last + 1])
            starts = 1 + np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) if last > first else np.zeros(0, np.int64)
            yield Slice(batch.slice(first, last - first), np.frombuffer(raw, np.uint8), raw, starts, starts + sizes)
            first = last


def table(members: bytes, inverse: bool = False) -> np.ndarray:
    """A lookup of 256 booleans."""
    out = np.zeros(256, bool)
    out[list(members)] = True
    return ~out if inverse else out


#: `[^\x20\x09-\x0D]+` and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after lowering A-Z), as bytes: all of UTF-8's other bytes are in words.
SPACED_WORD = table(b" \t\n\v\f\r", inverse=True)
PLAIN_WORD = table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def lowered(raw: bytes) -> bytes:
    return raw.translate(LOWER)


def runs(data: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of members. The data begin and end with a newline, which is never a member."""
    edges = np.flatnonzero(np.diff(members[data].view(np.int8)))
    return edges[0::2] + 1, edges[1::2] + 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """64-bit hashes of spans of bytes, from prefix sums of a polynomial, whatever the spans' lengths.

    The terms are mixed runs of EIGHT bytes: a polynomial modulo 2**64 over single bytes gives the two Thue-Morse strings
    over any two letters one hash, whatever its base. Shorter spans, which that can't happen to, are hashed byte by byte.
    """

    def __init__(self, data: np.ndarray) -> None:
        self.data, self._totals = data, {}
        n = len(data)
        if len(_powers.get("up", ())) <= n:
            size = 1 << int(n + 1).bit_length()
            for name, base in (("up", _B), ("down", _B_INV)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                _powers[name] = np.multiply.accumulate(p)

    def _total(self, long: bool) -> np.ndarray:
        if long not in self._totals:
            x = mix(_runs_of_eight(self.data)) if long else _BYTE[self.data]
            x *= _powers["up"][: len(x)]
            total = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(x, out=total[1:])
            self._totals[long] = total
        return self._totals[long]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        long = size >= EIGHT
        if long.all():
            h = self._sums(True, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        else:
            h = np.zeros(len(starts), np.uint64)
            for kind, these in ((False, ~long), (True, long)):
                if these.any():
                    h[these] = self._sums(kind, starts[these], ends[these])
        return mix(h ^ size.astype(np.uint64))

    def _sums(self, long: bool, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total = self._total(long)
        return (total[ends - (EIGHT - 1 if long else 0)] - total[starts]) * _powers["down"][starts]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Spans.hashes of one set of spans."""
    return Spans(data).hashes(starts, ends)


def all_grams(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes (a multiple of EIGHT) from each place on, in pieces that stay in a core's cache."""
    many = len(data) - size + 1
    out = np.zeros(max(many, 0), np.uint64)
    for a in range(0, many, PIECE):
        b = min(a + PIECE, many)
        x = mix(_runs_of_eight(data[a : b + size - 1]))
        h = out[a:b]
        for j in range(0, size, EIGHT):
            h *= _B
            h += x[j : j + b - a]
        h[:] = mix(h)
    return out


def _runs_of_eight(data: np.ndarray) -> np.ndarray:
    """At each byte the number that it and the next ones make."""
    return np.ndarray(len(data) - EIGHT + 1, np.dtype("<u8"), np.ascontiguousarray(data), 0, (1,)).copy()


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive word hashes; one for each start, also across rows (callers drop those)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h *= _B
        h += words[j : j + n]
    return mix(h)


def code_points(text: bytes) -> np.ndarray | None:
    """For each byte offset the number of code points before it; None if offsets are code points."""
    if text.isascii():
        return None
    lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    return np.concatenate(([0], np.cumsum(lead)))
