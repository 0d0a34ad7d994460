"""Importance resampling of documents towards a target's distribution of hashed word n-grams.

A document's weight is the mean log ratio of its features' smoothed frequencies in the target and in the corpus, in
thousandths, floored; a Gumbel draw made from its id is added, and the highest scores are drawn, which is sampling
without replacement in proportion to the weights. Counts cover every text of both tables.

Scores are ranked by parallel sorting by regular sampling: every partition is a locally sorted run, every step-th row
of each run is a sample, every so many samples in order is a splitter, the rows between two splitters are exchanged to
one task and merged there, and prefix counts of the segments make the places within them ranks. The splitters come
from all runs at equal steps, so a segment holds at most about two segments' even share, whatever the scores are.

Cases: a null text has no words; a document without features has weight 0; a null id counts as the empty string in its
draw and comes before others among ties; rows of one id and one score are ranked in any order; without a target the
gains are those of an empty one; a table without rows gives none.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm import shared
from lexquarry.llm import textbytes as tb

BUCKETS, WORDS, SEED, MIN_WORDS, PERCENT = 10_000, 1, 2024, 20, 10
#: Rows a segment, and the most segments; the driver takes about the square of their number of samples.
SEGMENT_ROWS, MAX_SEGMENTS = 100_000, 1_000
PIECE = 1 << 20
_IN_PARTITION = (1 << 33) - 1
_SPACED = bytes(c if tb.PLAIN_WORD[c] else 32 for c in tb.LOWER)


def features(text: bytes, words: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(new words, the buckets of their runs of 1 to `words` words) of the pieces of a text, which is cut between words."""
    plain, at, held = text.translate(_SPACED), 0, []
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        found = plain[at:end].split()
        both, at = held + found, end
        hashes: list[int] = []
        for k in range(1, words + 1):
            new = both[max(0, len(held) - k + 1) :]  # runs that end in this piece
            hashes.extend(map(crc32, new if k == 1 else map(b" ".join, zip(*(new[j:] for j in range(k)), strict=False))))
        yield len(found), np.array(hashes, np.int64) % buckets
        held = both[max(0, len(both) - words + 1) :] if words > 1 else []


def counts(rows: DataFrame, words: int = WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in rows(text): added up in the tasks, then by bucket; `buckets` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in tb.slices(batches, "text"):
            for i in range(len(part)):
                for _, found in features(part.text(i), words, buckets):
                    np.add.at(total, found, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "many"])

    got = rows.select("text").mapInArrow(run, "bucket int, many long").groupBy("bucket").agg(F.sum("many").alias("many")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got["bucket"].to_numpy()] = got["many"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The floored log ratio of each bucket, in thousandths."""
    s_all, t_all, many = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(((t + 1) * (s_all + many)) / ((s + 1) * (t_all + many)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, words: int = WORDS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches, "text"):
            out = []
            for i in range(len(part)):
                n_words = n = total = 0
                for new, found in features(part.text(i), words, len(gain)):
                    n_words, n, total = n_words + new, n + len(found), total + int(gain[found].sum())
                out.append((n_words, n, total // n if n else 0))
            columns = [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ((), (), ()))]
            yield pa.RecordBatch.from_arrays([part.rows.column(0), *columns], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def scored(weights: DataFrame, seed: int = SEED) -> DataFrame:
    """weights(doc_id, weight, ...) with `score`, the weight and a Gumbel draw made from seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return weights.withColumn("score", (F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))).cast("long"))


def _key(score: int, doc_id: object) -> tuple:
    return -score, doc_id is not None, doc_id


def splitters(runs: DataFrame, segments: int, rows: int) -> list[tuple]:
    """At most segments - 1 keys that cut runs(doc_id, score, place) into about equal segments: from every sorted run
    each step-th row, so that a sample stands for as many rows whatever the run's size."""
    step = max(1, rows // segments**2)
    got = runs.where(F.col("place") % step == 0).select("score", "doc_id").toArrow()
    keys = sorted(map(_key, got["score"].to_pylist(), got["doc_id"].to_pylist()))
    return [keys[k * len(keys) // segments] for k in range(1, segments)] if keys else []


def ranked(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """rows(doc_id, score, ...) with `rank`: 1, 2, ... by score from the highest on, ties to the smaller id."""
    order = [F.desc("score"), F.asc("doc_id")]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION))
    runs = shared.cut(rows.sortWithinPartitions(*order).withColumn("place", place))
    many = runs.count()
    segments = min(MAX_SEGMENTS, max(1, -(-many // segment_rows)))
    cuts = splitters(runs, segments, many)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = map(_key, batch["score"].to_pylist(), batch["doc_id"].to_pylist())
            yield batch.append_column("segment", pa.array([bisect_right(cuts, k) for k in keys], pa.int32()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.drop("place").schema.fields)
    found = runs.drop("place").mapInArrow(dealt, f"{schema}, segment int")
    sizes = dict(found.groupBy("segment").count().collect())  # a row a segment
    before = [0, *accumulate(sizes.get(k, 0) for k in range(segments))][:segments]
    merged = found.repartitionById(segments, "segment").sortWithinPartitions(*order)
    return merged.withColumn("rank", F.element_at(F.lit(before).cast("array<long>"), F.col("segment") + 1) + place + 1).drop("segment")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, words: int = WORDS, buckets: int = BUCKETS, seed: int = SEED, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs(doc_id, text); rank is null for those that
    are not drawn: the drawn ones are `percent` percent of the documents with at least min_words words."""
    gain = gains(counts(docs, words, buckets), counts(target, words, buckets))
    rows = shared.cut(scored(weighed(docs, gain, words), seed))
    enough = F.col("n_words") >= min_words
    draws = percent * rows.where(enough).count() // 100
    chosen = ranked(rows.where(enough), segment_rows).withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")))
    return chosen.unionByName(rows.where(~enough).withColumn("rank", F.lit(None).cast("long")))


def drawn(docs: DataFrame, target: DataFrame, **how: int) -> DataFrame:
    """The rows of docs whose id is drawn; all rows of an id that is drawn with one of them."""
    ids = resampled(docs, target, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias("drawn_id")).distinct()
    return docs.join(ids, F.expr("doc_id <=> drawn_id"), "left_semi")
