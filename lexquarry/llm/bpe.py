"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The symbols of all new words of a slice lie in one flat array. In each round the keys of all neighbouring pairs are
looked up by binary search in the vocabulary's sorted pair keys, the lowest rank in each word is merged wherever it
stands in that word, and words without a known pair leave the array. Words of over LONG bytes are merged by a heap of
their pairs instead. Words seen before come from a bounded cache of the worker.

The vocabulary is a file in the format of the tokenizers library (byte-level, no normaliser, no added prefix space),
named by `path`; it is read where the work runs. Strings of its special tokens in a text become those tokens.

Cases: null counts as empty, and an empty text has no tokens. Ids that the vocabulary lacks decode to nothing; bytes
that aren't UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lexquarry.llm import textbytes as tb

#: Fixed value: the pattern by which byte-level vocabularies split texts into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_WORDS, CACHED_IDS = 250_000, 4_000_000
#: Words of more bytes are merged one by one: rounds over a whole long word would be as many as its different merges.
LONG = 1_000
_NONE = np.int32(2**31 - 1)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class _Known(dict):
    """Codes of words; a new word gets the next code and waits to be encoded."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        self.new.append(word)
        return code


class Vocabulary:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        ids = file["model"]["vocab"]
        letters = byte_letters()
        self.first = np.array([ids[c] for c in letters], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int32)
        self.special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        byte = {c: b for b, c in enumerate(letters)}
        tokens: dict[int, bytes] = {i: bytes(byte[c] for c in t) for t, i in ids.items()}
        tokens |= {i: t.encode() for t, i in self.special.items()}
        table = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.token_bytes = np.frombuffer(b"".join(table), np.uint8)
        self.token_size = np.array([len(t) for t in table], np.int64)
        self.token_start = np.concatenate(([0], np.cumsum(self.token_size)[:-1]))
        self.decimal = [str(i) for i in range(len(table))]
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._forget()

    def _forget(self) -> None:
        self.known = _Known()
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for t, i in self.special.items():
            self.known[t] = len(self.known)
            self._add(np.array([i], np.int32), np.array([1]))

    def _add(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.flat = np.concatenate((self.flat, flat))

    def merge_long(self, word: bytes) -> list[int]:
        """The ids of one word: pairs wait in a heap by rank and place, and a merge puts at most two new ones there."""
        symbol = self.first[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        known = self.pairs
        heap = [(*r, i) for i, p in enumerate(zip(symbol, symbol[1:], strict=False)) if (r := known.get(p))]
        heapq.heapify(heap)
        end = len(word)
        while heap:
            rank, merged, i = heapq.heappop(heap)
            j = after[i]
            # one of the two may have been merged away or changed meanwhile
            if symbol[i] < 0 or j >= end or known.get((symbol[i], symbol[j])) != (rank, merged):
                continue
            symbol[i], symbol[j], after[i] = merged, -1, after[j]
            if after[j] < end:
                before[after[j]] = i
                if r := known.get((merged, symbol[after[j]])):
                    heapq.heappush(heap, (*r, i))
            if before[i] >= 0 and (r := known.get((symbol[before[i]], merged))):
                heapq.heappush(heap, (*r, before[i]))
        return [s for s in symbol if s >= 0]

    @cached_property
    def pairs(self) -> dict[tuple[int, int], tuple[int, int]]:
        """The rank and the new symbol of each known pair, for long words only."""
        return {(int(k >> 32), int(k & 0xFFFFFFFF)): (int(r), int(self.merged[r])) for k, r in zip(self.keys, self.ranks, strict=True)}

    def merged_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """merge_rounds() of short words and merge_long() of long ones, in their order."""
        long = {k: np.array(self.merge_long(w), np.int32) for k, w in enumerate(words) if len(w) > LONG}
        if not long:
            return self.merge_rounds(words)
        flat, size = self.merge_rounds([b"" if k in long else w for k, w in enumerate(words)])
        ends, parts, at = np.cumsum(size), [], 0
        for k, ids in long.items():
            parts += [flat[at : ends[k]], ids]
            at = ends[k]
            size[k] = len(ids)
        return np.concatenate([*parts, flat[at:]]), size

    def merge_rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each has."""
        size = np.array([len(w) for w in words], np.int64)
        symbol = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            key = symbol[:-1].astype(np.int64) << 32 | symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(symbol), _NONE)
            rank[:-1] = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], _NONE)
            begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.repeat(np.minimum.reduceat(rank, begin), np.diff(np.append(begin, len(word))))
            over = least == _NONE
            if over.any():
                done.append((word[over], symbol[over]))
            chosen = np.flatnonzero((rank == least) & ~over)
            # of overlapping places (the same symbol three times) every other one counts, from the left
            head = np.concatenate(([True], np.diff(chosen) != 1)) if len(chosen) else np.zeros(0, bool)
            run = chosen[np.maximum.accumulate(np.where(head, np.arange(len(chosen)), 0))] if len(chosen) else chosen
            chosen = chosen[(chosen - run) % 2 == 0]
            symbol[chosen] = self.merged[rank[chosen]]
            stay = ~over
            stay[chosen + 1] = False
            symbol, word = symbol[stay], word[stay]
        if not done:
            return np.zeros(0, np.int32), size * 0
        word, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbol[order], np.bincount(word, minlength=len(words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and offsets of the texts in them."""
        if len(self.known) > CACHED_WORDS or len(self.flat) > CACHED_IDS:
            self._forget()
        codes, many = [], []
        code = self.known.__getitem__
        for t in texts:
            before = len(codes)
            for i, piece in enumerate(self.cut.split(t)) if self.cut else ((0, t),):
                if i % 2:
                    codes.append(code(piece))
                else:
                    codes.extend(map(code, self.words.findall(piece)))
            many.append(len(codes) - before)
        if self.known.new:
            self._add(*self.merged_words([w.encode() for w in self.known.new]))
            self.known.new = []
        c = np.array(codes, np.int64)
        size = self.size[c]
        upto = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.repeat(self.start[c] - upto[:-1], size) + np.arange(upto[-1])]
        return ids, upto[np.concatenate(([0], np.cumsum(many)))]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        ids = np.where((ids >= 0) & (ids < len(self.token_size)), ids, 0)
        size = np.where((ids >= 0) & (ids < len(self.token_size)), self.token_size[ids], 0)
        upto = np.concatenate(([0], np.cumsum(size)))
        flat = self.token_bytes[np.repeat(self.token_start[ids] - upto[:-1], size) + np.arange(upto[-1])].tobytes()
        at = upto[offsets]
        return [flat[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


def _texts(part: tb.Slice) -> list[str]:
    return [part.text(i).decode() for i in range(len(part))]


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of docs(text, ...) and `ids` array<int>; a column of that name is replaced."""
    path = path or default_path()
    docs = docs.drop("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches, "text"):
            ids, offsets = load(path).encode(_texts(part))
            yield pa.RecordBatch.from_arrays([*part.rows.columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))], [*part.rows.schema.names, "ids"])

    old = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{old}, ids array<int>")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of rows(ids, ...) and `decoded` string; null ids decode to an empty string."""
    path = path or default_path()
    rows = rows.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            offsets = np.concatenate(([0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            text = load(path).decode(ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False), offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, "decoded"])

    old = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{old}, decoded string")


def round_trips(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of docs, `ids`, and `decoded`, in one pass: one worker a task instead of two."""
    path = path or default_path()
    docs = docs.drop("ids", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches, "text"):
            v = load(path)
            ids, offsets = v.encode(_texts(part))
            yield pa.RecordBatch.from_arrays([*part.rows.columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)), pa.array(v.decode(ids, offsets), pa.string())], [*part.rows.schema.names, "ids", "decoded"])

    old = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{old}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding in one pass, so no ids leave the workers."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for part in tb.slices(batches, "text"):
            v = load(path)
            ids, offsets = v.encode(_texts(part))
            text = list(map(v.decimal.__getitem__, ids.tolist()))
            one = [sha(",".join(text[a:b])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            two = [sha(t) for t in v.decode(ids, offsets)]
            yield pa.RecordBatch.from_arrays([part.rows.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
