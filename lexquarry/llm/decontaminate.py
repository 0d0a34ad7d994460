"""Benchmark decontamination by winnowing.

A window is SPAN consecutive words of an item; an item of fewer words, but not none, is one window. From every run of
WINDOW consecutive word K-grams the smallest hash is kept (the rightmost of equal ones), so two texts that share K +
WINDOW - 1 = SPAN words share a kept K-gram inside them. Kept K-grams of documents and items are joined by hash, their
words are compared, and each hit is extended to both sides word by word; it counts if SPAN words agree. Items shorter
than SPAN can't be winnowed with that guarantee: all document grams of just those lengths are looked up instead.

A Bloom filter of the items' fingerprints, of FILTER_BITS whatever the number of items, is all that is sent to the
executors; it only spares rows from the join.

Cases: null or wordless texts have no words, no hits and `items` empty; null or wordless items match nothing; items of
the same id count once; documents with the same id get a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm import shared
from lexquarry.llm import textbytes as tb
from lexquarry.llm.bloom import Bloom

K, WINDOW = 5, 6
SPAN = K + WINDOW - 1
FILTER_BITS = 1 << 24
_PRINT = "hash long, size int, pos long, `left` string, gram string, `right` string"


def _words(part: tb.Slice) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = tb.lowered(part.raw)
    data = np.frombuffer(raw, np.uint8)
    starts, ends = tb.runs(data, tb.PLAIN_WORD)
    return raw, starts, ends, tb.span_hashes(data, starts, ends), part.row_of(starts)


def winnowed(words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the K-grams that are the smallest in some run of WINDOW of them within a row."""
    grams = tb.gram_hashes(words, K)
    n = len(grams) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, at = grams[:n].copy(), np.arange(n)
    for j in range(1, WINDOW):
        lower = grams[j : j + n] <= least
        least = np.where(lower, grams[j : j + n], least)
        at[lower] = np.flatnonzero(lower) + j
    at = np.unique(at[row[:n] == row[SPAN - 1 : SPAN - 1 + n]])
    return at, grams[at]


def _short_hash(words: np.ndarray, size: int) -> np.ndarray:
    return tb.mix(tb.gram_hashes(words, size) ^ np.uint64(size))


def _context(raw: bytes, starts: np.ndarray, ends: np.ndarray, a: int, b: int) -> str:
    return b" ".join([raw[starts[i] : ends[i]] for i in range(a, b)]).decode()


def _prints(raw, starts, ends, first: int, last: int, at: int, size: int, h: int) -> dict:
    """A fingerprint of the words at..at+size of a row whose words are first..last, with the words on both sides."""
    reach = SPAN - K if size == K else 0
    return {
        "hash": int(np.uint64(h).view(np.int64)), "size": 0 if reach else size, "pos": int(at - first),
        "left": _context(raw, starts, ends, max(first, at - reach), at), "gram": _context(raw, starts, ends, at, at + size),
        "right": _context(raw, starts, ends, at + size, min(last, at + size + reach)),
    }


def item_prints(items: DataFrame) -> DataFrame:
    """(item_id, hash, size, left, gram, right): size 0 for winnowed K-grams, else the length of a short item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches, "text"):
            raw, starts, ends, words, row = _words(part)
            first, last = np.searchsorted(row, np.arange(len(part))), np.searchsorted(row, np.arange(len(part)), "right")
            out = []
            at, h = winnowed(words, row)
            for a, x in zip(at, h, strict=True):
                r = row[a]
                out.append(_prints(raw, starts, ends, first[r], last[r], a, K, x) | {"row": r})
            for r in np.flatnonzero((last > first) & (last - first < SPAN)):
                n = int(last[r] - first[r])
                p = _prints(raw, starts, ends, first[r], last[r], first[r], n, _short_hash(words[first[r] : last[r]], n)[0])
                # the only short length that is also K must not be taken for a winnowed K-gram
                out.append(p | {"row": r, "size": n, "left": "", "right": ""})
            ids = part.rows.column(0).take(pa.array([int(x["row"]) for x in out], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([x[k] for x in out], t) for k, t in (("hash", pa.int64()), ("size", pa.int32()), ("pos", pa.int64()), ("left", pa.string()), ("gram", pa.string()), ("right", pa.string())))], ["item_id", "hash", "size", "pos", "left", "gram", "right"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, {_PRINT}").drop("pos").distinct()


def document_prints(docs: DataFrame, bloom: Bloom, sizes: list[int], carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried columns, n_words, prints): the fingerprints that may be in the filter, for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches, "text"):
            raw, starts, ends, words, row = _words(part)
            first, last = np.searchsorted(row, np.arange(len(part))), np.searchsorted(row, np.arange(len(part)), "right")
            found: list[list[dict]] = [[] for _ in range(len(part))]
            at, h = winnowed(words, row)
            looked = [(at, h, K, True)]
            for size in sizes:
                h = _short_hash(words, size)
                whole = np.flatnonzero(row[: len(h)] == row[size - 1 : size - 1 + len(h)])
                looked.append((whole, h[whole], size, False))
            for at, h, size, winnow in looked:
                ok = sent.value.has(h)
                for a, x in zip(at[ok], h[ok], strict=True):
                    r = row[a]
                    p = _prints(raw, starts, ends, first[r], last[r], a, size, x)
                    found[r].append(p if winnow else p | {"size": size, "left": "", "right": ""})
            kind = pa.struct([("hash", pa.int64()), ("size", pa.int32()), ("pos", pa.int64()), ("left", pa.string()), ("gram", pa.string()), ("right", pa.string())])
            kept = [part.rows.column(part.rows.schema.get_field_index(c)) for c in ("doc_id", *carried)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(last - first, pa.int64()), pa.array(found, pa.list_(kind))], ["doc_id", *carried, "n_words", "prints"])

    kind = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *carried))
    struct = _PRINT.replace(" long", ": long").replace(" int", ": int").replace(" string", ": string")
    return docs.select(*dict.fromkeys(("doc_id", "text", *carried))).mapInArrow(run, f"{kind}, n_words long, prints array<struct<{struct}>>")


def _extended(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words that agree around each joined fingerprint, if they make a window."""
    for f in frames:
        out = []
        for row, item, size, pos, gram, a, b, c, d in zip(f["row"], f["item_id"], f["size"], f["pos"], f["gram"], f["left"], f["item_left"], f["right"], f["item_right"], strict=True):
            if size:
                out.append((row, item, pos, pos + size))
                continue
            # by the blank that joined them alone: words may hold or be other white space, such as U+00A0
            a, b, c, d = (x.split(" ") if x else [] for x in (a, b, c, d))
            left = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), min(len(a), len(b)))
            right = next((i for i, (x, y) in enumerate(zip(c, d, strict=False)) if x != y), min(len(c), len(d)))
            if left + K + right >= SPAN:
                out.append((row, item, pos - left, pos + K + right))
        yield pd.DataFrame(out, columns=["row", "item_id", "start", "end"])


def hits(docs: DataFrame, items: DataFrame, carried: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Documents as (row, doc_id, carried columns, n_words, likely), and spans as (row, item_id, start, end) in words.
    Rows that aren't likely have none."""
    prints = shared.checkpointed(item_prints(items))
    sizes = sorted(r[0] for r in prints.where("size > 0").select("size").distinct().collect())
    found = shared.cut(document_prints(docs, Bloom(prints, "hash", FILTER_BITS), sizes, carried).withColumn("row", F.monotonically_increasing_id()))
    sides = found.where("size(prints) > 0").select("row", F.explode("prints").alias("p")).select("row", "p.*")
    # the order of spark's choice: only rows that passed the filter are shuffled here, and a hash that many documents
    # hold is split by the adaptive skew join
    theirs = prints.select("item_id", "hash", "size", "gram", F.col("left").alias("item_left"), F.col("right").alias("item_right"))
    spans = sides.join(theirs, ["hash", "size", "gram"]).select("row", "item_id", "size", "pos", "gram", "left", "item_left", "right", "item_right")
    return found.select("row", "doc_id", *carried, "n_words", (F.size("prints") > 0).alias("likely")), spans.mapInPandas(_extended, f"row long, item_id {items.schema['item_id'].dataType.simpleString()}, start long, end long")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated) for every row of docs; items sorted as strings."""
    rows, spans = hits(docs, items)
    covered = F.expr("""aggregate(array_sort(spans), struct(0L as n, 0L as upto),
        (a, s) -> struct(a.n + greatest(0L, s.end - greatest(s.start, a.upto)) as n, greatest(a.upto, s.end) as upto), a -> a.n)""")
    by_row = spans.distinct().groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
    by_row = by_row.select("row", covered.alias("n_hit"), F.array_sort("items").alias("items"))
    out = rows.join(by_row, "row", "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no window of any item, all their columns. Only the texts with fingerprints that may be
    an item's are shuffled."""
    # the caller's columns travel in a struct, so that no name of theirs can clash
    packed = docs.select(F.lit(0).alias("doc_id"), "text", F.struct(*(c for c in docs.columns if c != "text")).alias("rest"))
    rows, spans = hits(packed, items, ("text", "rest"))
    kept = rows.where("not likely").union(rows.where("likely").join(spans.select("row").distinct(), "row", "left_anti"))
    return kept.select(*("text" if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns))
