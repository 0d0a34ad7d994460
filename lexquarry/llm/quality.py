"""Quality rules: counts over whole texts, and a calibrated classifier on hashed word and character n-grams.

The classifier is a logistic regression on three families of hashed features (byte trigrams, words, word bigrams),
each scaled by its number of occurrences in the text. It is fitted on a bounded sample of labelled rows
(`sample_rows`, those with the smallest hashes of their ids), calibrated by Platt's method on a quarter of them that
the weights have not seen, and scored in Arrow batches.

Cases: a null or empty text has zero counts and fails the base rule. Several labels of one id count as one, the
largest, and of several texts of one id the smallest is learnt from. Without labels of both kinds there is no model and the score is null; the base rule alone decides.
Rows with the same id are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm import textbytes as tb

BITS = 18
SAMPLE_ROWS = 2000
THRESHOLD = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
_SYMBOL = tb.table(b"#*$%&|<>")
_SCALE = 20.0
_SHIFT = np.uint64(64 - BITS)


@dataclass
class Model:
    """weights: (3, 2**BITS) float32. The probability of quality 1 is the logistic of slope * margin + shift."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (margin + self.bias) + self.shift, -50, 50)))


def counts(part: tb.Slice) -> dict[str, np.ndarray]:
    """The base rule's counts, by row."""
    data, n = part.data, len(part)
    starts, ends = tb.runs(data, tb.SPACED_WORD)
    words = tb.span_hashes(data, starts, ends)
    row = part.row_of(starts)
    first = np.searchsorted(starts, part.starts)
    n_words = np.searchsorted(starts, part.ends) - first

    breaks = np.flatnonzero(data == 10)
    line_from, line_to = breaks[:-1] + 1, breaks[1:]
    has_word = np.searchsorted(starts, line_to) > np.searchsorted(starts, line_from)
    line_from, line_to = line_from[has_word], line_to[has_word]
    line_row = part.row_of(line_from)
    salted = tb.mix(tb.span_hashes(data, line_from, line_to) + line_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, once = np.unique(salted, return_index=True)
    n_dup = np.bincount(line_row, minlength=n) - np.bincount(line_row[once], minlength=n)

    repeated = np.zeros(len(words) + 1, np.int32)
    grams = tb.gram_hashes(words, WINDOW)
    whole = np.flatnonzero(row[: len(grams)] == row[WINDOW - 1 :][: len(grams)]) if len(grams) else np.zeros(0, np.int64)
    if len(whole):
        salted = tb.mix(grams[whole] + row[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(salted)
        same = salted[order][1:] == salted[order][:-1]
        twice = np.zeros(len(whole), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = whole[twice]
        np.add.at(repeated, at, 1)
        np.subtract.at(repeated, at + WINDOW, 1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(repeated[:-1]) > 0)))
    return {
        "n_words": n_words,
        "word_chars": part.per_row(tb.SPACED_WORD[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": part.per_row(_SYMBOL[data]),
        "n_dup_lines": n_dup,
        "n_repeat_words": covered[first + n_words] - covered[first],
        "_words": (words, first, n_words, row),
    }


def hashed(part: tb.Slice, words: tuple) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each family: the hashed feature of each occurrence, and where each row's occurrences start and end."""
    data = part.data.astype(np.uint32)
    three = ((data[:-2] | data[1:-1] << 8 | data[2:] << 16) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    w, first, n, row = words
    two = (tb.gram_hashes(w, 2) >> _SHIFT).astype(np.int64)
    last = first + n
    return [
        (three, part.starts, np.maximum(part.ends - 2, part.starts)),
        ((w >> _SHIFT).astype(np.int64), first, last),
        (two, first, np.maximum(last - 1, first)),
    ]


def margins(part: tb.Slice, words: tuple, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(len(part))
    for table, (feature, start, end) in zip(weights, hashed(part, words), strict=True):
        total = np.concatenate(([0.0], np.cumsum(table[feature], dtype=np.float64)))
        out += (total[end] - total[start]) / np.maximum(end - start, 1)
    return out * _SCALE


def _logistic_fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, with Platt's smoothed targets."""
    n1 = y.sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        g = np.array([((p - goal) * x).sum(), (p - goal).sum()])
        s = p * (1 - p)
        h = np.array([[(s * x * x).sum() + 1e-3, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def train(texts: list[str], quality: np.ndarray, rounds: int = 80, rate: float = 0.5, decay: float = 1e-4) -> Model | None:
    """Full-batch Adagrad on three quarters of the rows, calibration on the rest."""
    y = np.asarray(quality, np.float64)
    if len(y) < 8 or y.min() == y.max():
        return None
    row, feature, value, base = [], [], [], 0
    for part in tb.slices([pa.record_batch({"text": pa.array(texts, pa.large_string())})], "text"):
        for family, (f, start, end) in enumerate(hashed(part, counts(part)["_words"])):
            n = end - start
            at = np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            key, many = np.unique(np.repeat(np.arange(len(n)), n) << np.int64(BITS) | f[at].astype(np.int64), return_counts=True)
            r = key >> BITS
            row.append(base + r)
            feature.append((key & ((1 << BITS) - 1)) + (family << BITS))
            value.append(_SCALE * many / n[r])
        base += len(part)
    row, feature, value = map(np.concatenate, (row, feature, value))
    held = np.arange(len(y)) % 4 == 3
    if y[~held].min() == y[~held].max() or y[held].min() == y[held].max():
        held[:] = False
    used = ~held[row]
    r, f, v = row[used], feature[used], value[used]
    weights, bias = np.zeros(3 << BITS), 0.0
    seen, seen_bias = np.full(3 << BITS, 1e-8), 1e-8
    # both kinds of rows weigh the same in total; the calibration puts the true share back
    share = np.where(y == 1, 0.5 / y[~held].sum(), 0.5 / (~held).sum() / max(1e-9, 1 - y[~held].mean())) * ~held
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, v * weights[f], len(y)) + bias, -50, 50)))
        err = (p - y) * share
        grad, grad_bias = np.bincount(f, v * err[r], 3 << BITS) + decay * weights, err.sum()
        seen += grad * grad
        seen_bias += grad_bias**2
        weights -= rate * grad / np.sqrt(seen)
        bias -= rate * grad_bias / np.sqrt(seen_bias)
    fit = held if held.any() else ~held
    a, b = _logistic_fit((np.bincount(row, value * weights[feature], len(y)) + bias)[fit], y[fit])
    return Model(weights.reshape(3, -1).astype(np.float32), bias, a, b)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from the `sample_rows` labelled rows of docs(doc_id, text) with the smallest hashes of their ids."""
    label = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # the sample is bounded by sample_rows, so it may be broadcast
    sample = label.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id")
    # one text an id, so sample_rows at most; in an order of their own, which deals them for the calibration
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality")).select("text", "quality", F.xxhash64("doc_id").alias("place"))
    rows = rows.toArrow().sort_by([("place", "ascending"), ("text", "ascending")])
    return train(rows["text"].to_pylist(), rows["quality"].to_numpy())


def judged(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    Columns of docs by those names are replaced.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    docs = docs.drop(*added, "base_failed", "score", "kept")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in tb.slices(batches, "text"):
            c = counts(part)
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
            score = None if m is None else m.probability(margins(part, c["_words"], m.weights))
            kept = ~failed if score is None else ~failed & (score >= threshold)
            yield pa.RecordBatch.from_arrays(
                [*part.rows.columns, *(pa.array(c[k].astype(np.int64)) for k in added), pa.array(failed), pa.nulls(len(part), pa.float64()) if score is None else pa.array(score), pa.array(kept)],
                [*part.rows.schema.names, *added, "base_failed", "score", "kept"],
            )

    old = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, old + "".join(f", {k} long" for k in added) + ", base_failed boolean, score double, kept boolean")
