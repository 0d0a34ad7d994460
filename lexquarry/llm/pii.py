"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

The field scores whole candidate segments (shape, digits, check sums, separators, the words before) together with the
labels' transitions, and chooses boundaries and types jointly by dynamic programming over segments of at most
MAX_TOKENS tokens. Only segments that can be personal data at all are candidates (`possible`), so stretches without
digits or at signs are outside for certain, and the program runs on the regions around them (REACH bytes either side).

The weights maximise the conditional likelihood of labelled sentences; `sentences` makes such sentences from seeded
templates, and `train` takes any others.

Cases: null counts as empty; texts without findings have zero counts and empty strings. Segments that overlap a base
span are left out, so base spans stay as they are.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexquarry.llm import spans
from lexquarry.llm import textbytes as tb

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, REACH = 24, 64
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: The look-behinds only spare starts inside a run of digits, where no match can begin that doesn't begin at the run.
_IP = re.compile(rb"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(rb"[A-Za-z]+|[0-9]+|[\x80-\xff]+|[\x00-\x7f]")
_HOT = tb.table(b"0123456789@")


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = (c - 48) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: bytes) -> bytes:
    return bytes(c for c in text if 48 <= c <= 57)


def base_spans(text: bytes) -> list[spans.Span]:
    """By kind as listed, then start; in bytes."""
    out, done, at = [], 0, text.find(b"@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find(b"@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(x := p.lstrip(b"0")) <= 3 and int(x or b"0") <= 255 for p in m.groups()):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


@dataclass
class Field:
    """Weights of features (kind, feature) and of transitions (kind, kind); "" is outside."""

    weights: dict[tuple[str, str], float]


def tokens(text: bytes) -> list[tuple[int, int, bytes]]:
    return [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]


def possible(text: bytes) -> list[str]:
    """The kinds that a segment can be at all."""
    n = sum(48 <= c <= 57 for c in text)
    if b"@" in text:
        return ["email"] if text.count(b"@") == 1 and b"." in text and text.count(b" ") <= 2 else []
    if text[0] not in b"+(0123456789" or n < 4 or re.search(rb"[A-Za-z\x80-\xff\n]", text):
        return []
    return [k for k, ok in (("ip", text.count(b".") >= 3 and n <= 12), ("card", 13 <= n <= 19), ("phone", 7 <= n <= 15)) if ok]


def features(toks: list[tuple[int, int, bytes]], i: int, j: int, text: bytes) -> list[str]:
    """Of the segment toks[i:j] as a whole."""
    part = [t for _, _, t in toks[i:j]]
    shape = "".join("d%d" % min(len(t), 5) if t.isdigit() else "a" if t[:1].isalpha() else "u" if t[0] > 127 else t.decode() for t in part)
    d = _digits(text)
    kind = lambda k: "edge" if not 0 <= k < len(toks) else "d" if toks[k][2].isdigit() else "a" if toks[k][2][:1].isalpha() else toks[k][2].decode("latin-1")[:1]
    out = [f"shape {shape if len(shape) <= 24 else shape[:8] + '..' + shape[-8:]}", f"digits {min(len(d), 20)}", f"left {kind(i - 1)}", f"right {kind(j)}", "seps " + "".join(sorted({t.decode("latin-1") for t in part if not t.isalnum()})), f"parts {min(len(part), 12)}"]
    if text[:1] == b"+":
        out.append("plus")
    if 13 <= len(d) <= 19:
        out.append(f"luhn {luhn(d)}")
    numbers = text.split(b".")
    if len(numbers) == 4 and all(x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in numbers):
        out.append("octets")
    if kind(j) in ".-" and j + 1 < len(toks) and toks[j + 1][2].isdigit() or kind(i - 1) in ".-+" and i > 1 and toks[i - 2][2].isdigit():
        out.append("cut short")
    seen = 0
    for _, _, t in reversed(toks[max(0, i - 8) : i]):
        if t.isalpha() and seen < 3:
            out.append(f"cue {t.decode().lower()}")
            seen += 1
    return out


Candidate = tuple[int, int, str, list[str]]


def candidates(toks: list[tuple[int, int, bytes]], text: bytes) -> list[list[Candidate]]:
    """For each end (in tokens) the segments that end there."""
    out: list[list[Candidate]] = [[] for _ in range(len(toks) + 1)]
    hot = np.concatenate(([0], np.cumsum([t.isdigit() or t == b"@" for _, _, t in toks])))
    for i, (s, _, t) in enumerate(toks):
        if not (t.isalnum() or t in (b"+", b"(")):
            continue
        for j in range(i + 1, min(len(toks), i + MAX_TOKENS) + 1):
            last = toks[j - 1][2]
            if last == b"\n" or toks[j - 1][1] - s > REACH:
                break
            if hot[j] == hot[i] or not last.isalnum():
                continue
            segment = text[s : toks[j - 1][1]]
            if kinds := possible(segment):
                f = features(toks, i, j, segment)
                out[j] += [(i, j, k, f) for k in kinds]
    return out


LABELS = ("", *KINDS)


def _scored(cands: list[list[Candidate]], w: dict) -> list[list[tuple[int, str, float]]]:
    """For each end the segments as (start, label, score); a token outside scores 0."""
    get = w.get
    return [([(j - 1, "", 0.0)] if j else []) + [(i, k, sum(get((k, f), 0.0) for f in fs)) for i, _, k, fs in c] for j, c in enumerate(cands)]


def decode(cands: list[list[Candidate]], w: dict) -> list[tuple[int, int, str]]:
    """The best segmentation's entities (Viterbi over segments)."""
    best: list[dict[str, tuple[float, int, str]]] = [{"": (0.0, -1, "")}]
    for j, segments in enumerate(_scored(cands, w)[1:], 1):
        here: dict[str, tuple[float, int, str]] = {}
        for i, k, score in segments:
            for before, (total, _, _) in best[i].items():
                x = total + score + w.get((before, k, "step"), 0.0)
                if k not in here or x > here[k][0]:
                    here[k] = (x, i, before)
        best.append(here)
    out, j = [], len(cands) - 1
    k = max(best[j], key=lambda k: best[j][k][0]) if best[j] else ""
    while j > 0:
        _, i, before = best[j][k]
        if k:
            out.append((i, j, k))
        j, k = i, before
    return out[::-1]


def _add(totals: list[float]) -> float:
    top = max(totals, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum(math.exp(x - top) for x in totals))


def gradient(cands: list[list[Candidate]], truth: set[tuple[int, int, str]], w: dict) -> dict:
    """Of the log-likelihood: counts in the true segmentation less those expected (forward and backward sums)."""
    n, scored = len(cands) - 1, _scored(cands, w)
    ahead: list[dict[str, float]] = [{"": 0.0}] + [{} for _ in range(n)]
    for j in range(1, n + 1):
        sums = defaultdict(list)
        for i, k, s in scored[j]:
            sums[k] += [a + s + w.get((b, k, "step"), 0.0) for b, a in ahead[i].items()]
        ahead[j] = {k: _add(v) for k, v in sums.items()}
    behind: list[dict[str, list[float]]] = [defaultdict(list) for _ in range(n + 1)]
    after: list[dict[str, float]] = [{} for _ in range(n + 1)]
    after[n] = dict.fromkeys(LABELS, 0.0)
    for j in range(n, 0, -1):
        if j < n:
            after[j] = {k: _add(v) for k, v in behind[j].items()}
        for i, k, s in scored[j]:
            if k in after[j]:
                for b in ahead[i]:
                    behind[i][b].append(s + w.get((b, k, "step"), 0.0) + after[j][k])
    z = _add([a + after[n][k] for k, a in ahead[n].items()])
    out: dict = defaultdict(float)
    by = {(i, j, k): f for c in cands for i, j, k, f in c}
    for j in range(1, n + 1):
        for i, k, s in scored[j]:
            for b, a in ahead[i].items():
                if k not in after[j]:
                    continue
                p = math.exp(a + s + w.get((b, k, "step"), 0.0) + after[j][k] - z)
                if p > 1e-6:
                    out[(b, k, "step")] -= p
                    for f in by.get((i, j, k), ()):
                        out[(k, f)] -= p
    before, j = "", 0
    at = {i: (j, k) for i, j, k in truth}
    while j < n:
        end, k = at.get(j, (j + 1, ""))
        out[(before, k, "step")] += 1
        for f in by.get((j, end, k), ()):
            out[(k, f)] += 1
        before, j = k, end
    return out


def train(labelled: list[tuple[bytes, list[spans.Span]]], rounds: int = 6, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """From sentences with their spans in bytes, by stochastic Adagrad."""
    ready = []
    for text, true in labelled:
        toks = tokens(text)
        start, end = {s: i for i, (s, _, _) in enumerate(toks)}, {e: i + 1 for i, (_, e, _) in enumerate(toks)}
        cands = candidates(toks, text)
        have = {(i, j, k) for c in cands for i, j, k, _ in c}
        ready.append((cands, {x for k, s, e in true if s in start and e in end and (x := (start[s], end[e], k)) in have}))
    w: dict = defaultdict(float)
    seen: dict = defaultdict(lambda: 1e-6)
    for _ in range(rounds):
        for cands, truth in ready:
            for k, g in gradient(cands, truth, w).items():
                g -= decay * w[k]
                seen[k] += g * g
                w[k] += rate * g / math.sqrt(seen[k])
    return Field({k: v for k, v in w.items() if abs(v) > 1e-4})


def sentences(n: int = 400, seed: int = 11) -> list[tuple[bytes, list[spans.Span]]]:
    """Labelled sentences: personal data in many forms, and numbers that are none."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("aeioulnrstdmpg") for _ in range(r.randint(2, 9)))

    def card() -> str:
        x = r.choice("3456") + d(14)
        x += next(c for c in "0123456789" if luhn((x + c).encode()))
        s = r.choice(["", " ", "-", ".", "/"])
        return s.join(x[i : i + 4] for i in range(0, 16, 4))

    def octet() -> str:
        return str(r.randint(0, 255))

    def no_card() -> str:
        x = card()
        return x if not luhn(_digits(x.encode())) else x[:-1] + str((int(x[-1]) + r.randint(1, 9)) % 10)

    make = {
        "email": lambda: f"{word()}{r.choice(['.', '_', ''])}{word()}{r.choice(['@', '@', ' @ '])}{word()}.{r.choice(['com', 'org', 'example.com'])}",
        "ip": lambda: ".".join(octet() for _ in range(4)),
        "card": card,
        "phone": lambda: r.choice(["+1 ({0}) {1}-{2}", "({0}) {1}-{2}", "{0}-{1}-{2}", "+{0} {1} {2}", "{0} {1} {2}", "({0}) {1} {2}", "0{0}/{1}{2}"]).format(d(3), d(3), d(4)),
    }
    cues = {"email": ["mail", "write to", "email"], "ip": ["host", "address", "server"], "card": ["card", "visa", "pay with"], "phone": ["phone", "call", "tel", "mobile"]}
    other = [
        lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{r.randint(10, 23)}:{d(2)}:{d(2)}", lambda: f"version {r.randint(0, 9)}.{r.randint(0, 9)}.{r.randint(0, 30)}", lambda: f"section {r.randint(1, 9)}.{r.randint(1, 9)}.{r.randint(1, 9)}.{r.randint(256, 999)}",
        lambda: f"no {d(8)}", no_card, no_card, no_card, lambda: f"order {d(14)}", lambda: f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: f"{d(2)}.{d(3)}.{d(3)}", lambda: f"{d(9)}", lambda: f"page {d(3)}", lambda: f"{d(3)} {d(3)} {d(3)} euro", lambda: f"@{word()}", lambda: f"{d(4)} {d(4)} items",
    ]
    out = []
    for _ in range(n):
        text, true = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(word() for _ in range(r.randint(1, 4))) + " "
            if r.random() < 0.55:
                k = r.choice(KINDS)
                if r.random() < 0.6 or k == "phone":
                    text += r.choice(cues[k]) + r.choice([" ", ": "])
                s = make[k]()
                true.append((k, len(text), len(text) + len(s)))
                text += s + r.choice([" ", ". ", ", "])
            else:
                text += r.choice(other)() + r.choice([" ", ". ", ", "])
        out.append((text.encode(), true))
    return out


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(sentences())


def _regions(text: bytes) -> Iterator[tuple[int, int]]:
    at = np.flatnonzero(_HOT[np.frombuffer(text, np.uint8)])
    if not len(at):
        return
    gaps = np.flatnonzero(np.diff(at) > 2 * REACH)
    for a, b in zip(np.append(at[0], at[gaps + 1]), np.append(at[gaps], at[-1]), strict=True):
        middle = text[a : b + 1]
        n = sum(48 <= c <= 57 for c in middle)
        if b"@" in middle or n >= 7 or n >= 4 and middle.count(b".") >= 3:
            yield max(0, int(a) - REACH), min(len(text), int(b) + 1 + REACH)


def field_spans(text: bytes, field: Field) -> list[spans.Span]:
    out = []
    for a, b in _regions(text):
        part = text[a:b]
        toks = tokens(part)
        out += [(k, a + toks[i][0], a + toks[j - 1][1]) for i, j, k in decode(candidates(toks, part), field.weights)]
    return out


def scanned(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_field) for each row of docs(doc_id, text)."""
    field = field or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches, "text"):
            n = len(part)
            many = {k: np.zeros(n, np.int64) for k in (*KINDS, "field")}
            sha, text = [spans.digest([])] * n, [""] * n
            for r in np.flatnonzero(part.per_row(_HOT[part.data])):
                t = part.text(r)
                base = base_spans(t)
                more = spans.apart(field_spans(t, field), base)
                base, more = spans.in_code_points(t, base), spans.in_code_points(t, more)
                for k, _, _ in base:
                    many[k][r] += 1
                many["field"][r] = len(more)
                sha[r] = spans.digest(base)
                text[r] = spans.joined(sorted(base + more, key=lambda x: (KINDS.index(x[0]), x[1])))
            yield pa.RecordBatch.from_arrays([part.rows.column(0), *(pa.array(many[k]) for k in KINDS), pa.array(sha, pa.string()), pa.array(text, pa.string()), pa.array(many["field"])], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_field"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_field long")
