"""Secret scans: fixed patterns, and random-looking tokens told from ordinary identifiers by character Markov models.

Two first-order Markov models over classes of characters, one of random strings and one of ordinary identifiers and
words, are trained from labelled samples; a token is reported as kind `random` if the log-likelihood ratio per
transition and in total exceed fixed thresholds. Candidates are all runs of 16 or more of `[A-Za-z0-9+/_=-]` that hold
a digit or a capital after a small letter.

The labelled samples are made here: random strings over the usual alphabets from a seeded generator, and identifiers
joined from syllables in the usual styles; `train` takes any others.

Cases: null counts as empty. Texts without findings have zero counts and empty strings. Spans that the models find
and that overlap a base span are left out, so base spans stay as they are.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexquarry.llm import spans
from lexquarry.llm import textbytes as tb

KINDS = ("assign", "access", "hex")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = tb.table(b"0123456789abcdef")
TOKEN = tb.table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_TOKEN = 6, 20, 24, 16
PER_STEP, IN_ALL = 0.35, 14.0


@dataclass
class Markov:
    """ratio[a, b]: log probability of b after a in random strings, less that in ordinary ones. Bytes are the states."""

    ratio: np.ndarray

    def scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        steps = self.ratio[data[:-1], data[1:]]
        total = np.concatenate(([0.0], np.cumsum(steps, dtype=np.float64)))
        return total[ends - 1] - total[starts]


def _transitions(strings: list[bytes], smoothing: float) -> np.ndarray:
    many = np.zeros((256, 256))
    used = TOKEN.nonzero()[0]
    many[np.ix_(used, used)] = smoothing
    for s in strings:
        a = np.frombuffer(s, np.uint8)
        np.add.at(many, (a[:-1], a[1:]), 1)
    total = many.sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, np.log(np.maximum(many, 1e-300) / total), 0.0)


def train(strings: list[bytes], is_random: list[bool], smoothing: float = 0.5) -> Markov:
    """From labelled samples. Case is kept: the change of case inside a token is part of what tells them apart."""
    one = _transitions([s for s, r in zip(strings, is_random, strict=True) if r], smoothing)
    two = _transitions([s for s, r in zip(strings, is_random, strict=True) if not r], smoothing)
    used = np.outer(TOKEN, TOKEN)
    return Markov(np.where(used, one - two, 0.0).astype(np.float32))


def samples(n: int = 4000, seed: int = 7) -> tuple[list[bytes], list[bool]]:
    """Labelled samples, half random: (strings, is_random)."""
    r = random.Random(seed)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    alphabets = [b64, b64 + "+/", b64 + "-_", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]
    onset, vowel, coda = "b c d f g h j k l m n p r s t v w st tr ch th sh pr qu".split(), "a e i o u ea ou ie".split(), ["", "", "n", "r", "s", "t", "l", "nt", "ng", "nd", "x"]
    out, label = [], []
    for i in range(n):
        if i % 2:
            out.append("".join(r.choice(alphabets[i // 2 % len(alphabets)]) for _ in range(r.randint(16, 64))))
        else:
            words = ["".join(r.choice(onset) + r.choice(vowel) + r.choice(coda) for _ in range(r.randint(1, 4))) for _ in range(r.randint(2, 7))]
            style = r.randrange(6)
            text = ("_".join(words), "-".join(words), "".join(w.title() for w in words), "/".join(words), "".join(words), "_".join(words).upper())[style]
            if r.random() < 0.4:
                text += r.choice(["", "_", "-", "="]) + str(r.randrange(10 ** r.randint(1, 8)))
            if r.random() < 0.15:
                text = f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}-" + text
            out.append(text)
        label.append(bool(i % 2))
    return [x.encode() for x in out], label


def base_spans(text: bytes, low: bytes) -> list[spans.Span]:
    """Spans of the fixed patterns but hex, in bytes. low: the text with A-Z lowered."""
    out = []
    at = sorted(m for k in KEYWORDS for m in _places(low, k))
    done = 0
    for a in at:
        # every match starts with a keyword, so trying those places in order is the leftmost search
        if a >= done and (m := ASSIGN.match(text, a)):
            done = m.end()
            if len(m[2]) >= MIN_ASSIGN:
                out.append(("assign", m.start(), m.end()))
    for m in ACCESS.finditer(text):
        if len(m[0]) >= MIN_ACCESS:
            out.append(("access", m.start(), m.end()))
    return out


def _places(text: bytes, word: bytes) -> Iterator[int]:
    at = text.find(word)
    while at >= 0:
        yield at
        at = text.find(word, at + 1)


def _flagged(part: tb.Slice, low: bytes) -> set[int]:
    """Rows with a keyword or an access key's beginning."""
    out: set[int] = set()
    for raw, words in ((low, KEYWORDS), (part.raw, (b"AKIA",))):
        for w in words:
            at = np.fromiter(_places(raw, w), np.int64)
            out.update(part.row_of(at).tolist())
    return out


def findings(part: tb.Slice, model: Markov) -> Iterator[tuple[int, list[spans.Span], list[spans.Span]]]:
    """(row, base spans, the model's spans) of the rows that have any, in code points."""
    data, low = part.data, tb.lowered(part.raw)
    starts, ends = tb.runs(data, HEX)
    long = ends - starts >= MIN_HEX
    hexes: dict[int, list[spans.Span]] = {}
    for s, e in zip(starts[long], ends[long], strict=True):
        r = int(part.row_of(s))
        hexes.setdefault(r, []).append(("hex", int(s - part.starts[r]), int(e - part.starts[r])))
    starts, ends = tb.runs(data, TOKEN)
    long = ends - starts >= MIN_TOKEN
    starts, ends = starts[long], ends[long]
    score = model.scores(data, starts, ends)
    odd = (score > IN_ALL) & (score > PER_STEP * (ends - starts - 1))
    by_row: dict[int, list[spans.Span]] = {}
    for s, e in zip(starts[odd], ends[odd], strict=True):
        if re.search(rb"[0-9]|[a-z][A-Z]", part.raw[s:e]):
            r = int(part.row_of(s))
            by_row.setdefault(r, []).append(("random", int(s - part.starts[r]), int(e - part.starts[r])))
    for r in sorted(_flagged(part, low) | hexes.keys() | by_row.keys()):
        text = part.text(r)
        base = base_spans(text, low[part.starts[r] : part.ends[r]]) + hexes.get(r, [])
        base.sort(key=lambda x: (x[1], KINDS.index(x[0])))
        more = spans.apart(by_row.get(r, []), base)
        yield r, spans.in_code_points(text, base), spans.in_code_points(text, more)


def scanned(docs: DataFrame, model: Markov | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) for each row of docs(doc_id, text)."""
    model = model or train(*samples())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches, "text"):
            n = len(part)
            many = {k: np.zeros(n, np.int64) for k in (*KINDS, "random")}
            sha, text = [spans.digest([])] * n, [""] * n
            for r, base, more in findings(part, model):
                for k, _, _ in base + more:
                    many[k][r] += 1
                sha[r] = spans.digest(base)
                text[r] = spans.joined(sorted(base + more, key=lambda x: (x[1], (*KINDS, "random").index(x[0]))))
            yield pa.RecordBatch.from_arrays([part.rows.column(0), *(pa.array(many[k]) for k in KINDS), pa.array(sha, pa.string()), pa.array(text, pa.string()), pa.array(many["random"])], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_random"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")
