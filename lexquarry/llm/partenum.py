"""N-gram Jaccard join by PartEnum signatures.

A document's set holds the hashes of its distinct word shingles (64 bits each; equality of whole sets is decided by 128
bits). Sets of Jaccard similarity g or more in a band of sizes up to u differ in at most k = floor(2 u (1 - g) / (1 + g))
elements. The domain of elements is split into parts and each part into smaller ones; a signature is the hash of the
elements in a chosen subset of the smaller parts, and `layout` deals them so that two sets that differ in k elements at
most share a signature:

* small k: floor(k / (tolerated + 1)) + 1 parts of `sub` smaller ones; some part holds `tolerated` differences at most,
  so one choice of sub - tolerated of its smaller parts holds none;
* larger k: k + 1 + spare parts, each a signature by itself. At least spare + 1 of them hold no difference.

Spare signatures are given up where that saves most. Parts with the fewest elements are the least telling, so of
`extra` parts more only the fullest are signed; and of the signatures that more than HOT sets share, each set gives up
the `spare` most common ones. Both orders depend on nothing but the signature, so what two similar sets share last is
given up by neither. Bands grow by BAND; a set whose partners may lie in a next band signs there as well.

Documents of equal sets are one node. Of the nodes of a signature the one with the most shared signatures is its pivot,
and each node is first compared with the pivot that it shares most signatures with: copies edited from one text meet
that text. Only for signatures whose nodes are then still in several components are further pairs looked at: each node
outside the signature's largest component with the nodes of other components there, for ROUNDS rounds only the nearest of each component
by a parity sketch of 1,024 bits, which bounds the number of differing elements from below, then all that are left.
Pairs are never made within a component, so large groups of near copies stay linear.

Sketches and filters only spare work; the similarity of each pair that they leave is counted on the sets themselves.

Cases: a null or wordless text has an empty set and is linked with nothing; fewer words than `n` make one shingle;
equal ids are separate rows; a component's id is the smallest doc_id in it (null ids count as none).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm import shared
from lexquarry.llm import textbytes as tb
from lexquarry.llm.bloom import Bloom
from lexquarry.llm.components import components

SHINGLE, PERCENT = 3, 90
BAND = 1.25
#: Up to FEW differences subsets are enumerated, with MOST signatures at most; beyond, the shares of k + 1 by which
#: parts are added that aren't signed (EXTRA) and signatures that may be given up (SPARE).
FEW, MOST = 24, 64
EXTRA, SPARE = 0.25, 0.15
HOT = 8
ROUNDS = 1
FILTER_BITS = 1 << 26
_PARITY = tuple(f"p{i}" for i in range(16))
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def bands(upto: int = 1 << 40, growth: float = BAND) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest size of each band."""
    low, high = [1], [1]
    while high[-1] < upto:
        low.append(high[-1] + 1)
        high.append(max(low[-1], int(low[-1] * growth)))
    return np.array(low), np.array(high)


_LOW, _HIGH = bands()


@lru_cache(maxsize=None)
def layout(k: int) -> tuple[int, int, int, int, int]:
    """(parts, sub, tolerated, extra, spare) for k differences: of all choices the one with the largest subsets."""
    if k > FEW:
        extra, spare = ceil(EXTRA * (k + 1)), ceil(SPARE * (k + 1))
        return k + 1 + extra + spare, 1, 0, extra, spare
    best = (0.0, 0, 0, 0)
    for tolerated in range(k + 1):
        parts = k // (tolerated + 1) + 1
        for sub in range(tolerated + 1, tolerated + 9):
            if parts * comb(sub, tolerated) <= MOST:
                best = max(best, ((sub - tolerated) / (sub * parts), -parts, -sub, tolerated))
    return -best[1], -best[2], best[3], 0, 0


def shingles(part: tb.Slice, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """All rows' distinct shingle hashes, sorted within each row, and offsets of the rows in them."""
    data = np.frombuffer(tb.lowered(part.raw), np.uint8)
    starts, ends = tb.runs(data, tb.SPACED_WORD)
    words = tb.span_hashes(data, starts, ends)
    first, last = np.searchsorted(starts, part.starts), np.searchsorted(starts, part.ends)
    grams = tb.gram_hashes(words, n)
    sets = []
    for a, b in zip(first, last, strict=True):
        if b - a >= n:
            h = np.sort(grams[a : b - n + 1])
            sets.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
        else:  # the whole sequence as one; its length keeps it apart from others
            sets.append(tb.mix(tb.gram_hashes(words[a:b], int(b - a)) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64))
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For consecutive groups of these sizes: each member's group, and its place in the group."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def signatures(elements: np.ndarray, offsets: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All rows' signatures, the number of those of the same band that the row may give up plus 2**24 for each band
    after its own, and offsets of the rows in both."""
    size = np.diff(offsets)
    own = np.searchsorted(_HIGH, size)
    # a row's elements are sorted hashes, so those of a part of the domain are neighbours and their sum is a difference
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tb.mix(elements + _GOLD), dtype=np.uint64)))
    high = elements >> np.uint64(32)
    out, tags, of, step = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
    while True:
        # a next band only if a partner can be there: 100 * size >= percent * partner
        reached = np.flatnonzero((size > 0) & ((100 * size >= percent * _LOW[own + step]) if step else True))
        if not len(reached):
            break
        for b in np.unique(own[reached]):
            rows = reached[own[reached] == b]
            parts, sub, tolerated, extra, spare = layout(int(2 * _HIGH[b + step] * (100 - percent) // (100 + percent)))
            cells = parts * sub
            r, at = _spread(size[rows])
            cell = r * cells + ((high[offsets[rows][r] + at] * np.uint64(cells)) >> np.uint64(32)).astype(np.int64)
            many = np.bincount(cell, minlength=len(rows) * cells).reshape(len(rows), cells)
            end = offsets[rows][:, None] + np.cumsum(many, axis=1)
            place = np.arange(cells, dtype=np.uint64) + np.uint64(int(b + step) << 40)
            sums = tb.mix((total[end] - total[end - many]) ^ tb.mix(place)).reshape(len(rows), parts, sub)
            if sub > 1:  # a signature for each choice of smaller parts: the sum of what they hold
                chosen = np.array([[j in c for c in combinations(range(sub), sub - tolerated)] for j in range(sub)], np.uint64)
                sums = tb.mix(np.matmul(sums, chosen))
            h = sums.reshape(len(rows), -1)
            if extra:  # the fullest parts, equal ones by hash
                order = (np.minimum(many, 255).astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
                h = np.take_along_axis(h, np.argpartition(order, extra, axis=1)[:, extra:], axis=1)
            out.append(h.ravel())
            of.append(np.repeat(rows, h.shape[1]))
            tags.append(np.full(h.size, spare + (step << 24), np.int32))
        step += 1
    out, tags, of = np.concatenate(out), np.concatenate(tags), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return out[order], tags[order], np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(size)))))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _keys(elements: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for a row's set."""
    return _sums(tb.mix(elements + np.uint64(3)), offsets), _sums(tb.mix(elements ^ np.uint64(0xABCDEF)), offsets)


def _parity(elements: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Bits, each the parity of the number of elements that fall on it, as numbers of 64 bits."""
    n, bits = len(offsets) - 1, 64 * len(_PARITY)
    row = np.repeat(np.arange(n), np.diff(offsets))
    many = np.bincount(row * bits + (tb.mix(elements ^ np.uint64(77)) & np.uint64(bits - 1)).astype(np.int64), minlength=n * bits)
    packed = np.packbits((many & 1).astype(np.uint8).reshape(n, bits), axis=1, bitorder="little")
    return list(np.ascontiguousarray(packed).view(np.int64).reshape(n, -1).T)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _list(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _common(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(s): the signatures that occur in more than one row. Nothing but the signature is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([_long(signatures(*shingles(part, n), percent)[0])], ["s"])

    return docs.select("text").mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("many")).where("many > 1").select("s")


def _marked(docs: DataFrame, common: Bloom, n: int, percent: int) -> tuple[DataFrame, object]:
    """(doc_id, n_shingles, k0, k1, p0..p15, signatures, tags) for each row, with the signatures that may be in the
    filter; no sketch where there are none. And the broadcast, to be destroyed once the rows are written."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches, "text"):
            e, offsets = shingles(part, n)
            s, tags, at = signatures(e, offsets, percent)
            keep = sent.value.has(s)
            kept = np.concatenate(([0], np.cumsum(keep)))[at]
            none = np.diff(kept) == 0
            parity = [pa.array(p, mask=none) for p in _parity(e, offsets)]
            yield pa.RecordBatch.from_arrays([part.rows.column(0), pa.array(np.diff(offsets)), *map(_long, _keys(e, offsets)), *parity, _list(_long(s[keep]), kept), _list(pa.array(tags[keep]), kept)], ["doc_id", "n_shingles", "k0", "k1", *_PARITY, "signatures", "tags"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, k0 long, k1 long, " + "".join(f"{p} long, " for p in _PARITY) + "signatures array<long>, tags array<int>"), sent


def _near(heads: DataFrame) -> DataFrame:
    """(s, node, pivot) of the signatures that several nodes have, less those that are given up."""
    rows = heads.select("node", F.explode(F.arrays_zip("signatures", "tags")).alias("x")).select("node", F.col("x.signatures").alias("s"), F.col("x.tags").alias("tag"))
    many = rows.groupBy("s").agg(F.count("*").alias("many")).where("many > 1")
    # lists of one node's signatures: bounded by its text
    listed = rows.join(many, "s").groupBy("node", "tag").agg(F.sum("many").alias("weight"), F.collect_list(F.struct("many", "s")).alias("l"))
    hot = f"slice(sort_array(filter(l, x -> x.many > {HOT}), false), (tag & 16777215) + 1, greatest(size(l), 1))"
    kept = listed.select("node", "weight", F.explode(F.expr(f"concat(filter(l, x -> x.many <= {HOT}), {hot})")).alias("x")).select("node", "weight", F.col("x.s").alias("s"))
    kept = shared.cut(kept)
    pivots = kept.groupBy("s").agg(F.count("*").alias("many"), F.max_by("node", F.struct("weight", "node")).alias("pivot")).where("many > 1").select("s", "pivot")
    out = shared.cut(kept.join(pivots, "s").select("s", "node", "pivot"))
    shared.drop(kept)
    return out


def _texts(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, text): a text of each of the given nodes(node, k0, k1). All texts are read again; a filter of fixed size
    keeps those of other nodes from being sent."""
    sent = docs.sparkSession.sparkContext.broadcast(Bloom(nodes, "k0", FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches, "text"):
            k0, k1 = _keys(*shingles(part, n))
            _, once = np.unique(k0, return_index=True)  # copies of a set in one slice go once
            once = np.sort(once)[sent.value.has(k0[np.sort(once)])]
            yield pa.RecordBatch.from_arrays([_long(k0[once]), _long(k1[once]), pa.array([part.text(i) for i in once], pa.binary()).cast(pa.string())], ["k0", "k1", "text"])

    found = docs.select("text").mapInArrow(run, "k0 long, k1 long, text string").groupBy("k0", "k1").agg(F.first("text").alias("text"))
    out = shared.cut(nodes.join(found, ["k0", "k1"]).select("node", "text"))
    sent.destroy()
    return out


def _differ(x: str, y: str) -> str:
    """SQL: in how many bits the sketches of x and y differ; their sets differ in as many elements at least."""
    return "(" + " + ".join(f"bit_count({x}.{p} ^ {y}.{p})" for p in _PARITY) + ")"


def _may(x: str, y: str, percent: int) -> str:
    """SQL: by sizes and parity sketches, x and y may be similar enough."""
    return f"100L * least({x}.n_shingles, {y}.n_shingles) >= {percent}L * greatest({x}.n_shingles, {y}.n_shingles) and {100 + percent}L * {_differ(x, y)} <= {100 - percent}L * ({x}.n_shingles + {y}.n_shingles)"


def _sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    for part in tb.slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text"):
        e, offsets = shingles(part, n)
        yield from np.split(e, offsets[1:-1])


def _linked(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of pairs(a, b) of the similarity asked for, counted on the sets of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):  # so many sets in memory at once
                part = b.slice(i, 256)
                second = part.column(3).dictionary_encode()
                theirs = list(_sets(second.dictionary, n))
                keep = []
                for x, j in zip(_sets(part.column(2), n), second.indices.to_pylist(), strict=True):
                    y = theirs[j]
                    same = int(np.isin(x, y, assume_unique=True).sum()) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                    keep.append(100 * same >= percent * (len(x) + len(y) - same))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return shared.cut(both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"))


def _across(near: DataFrame, brief: DataFrame, part: DataFrame, percent: int) -> DataFrame:
    """(a, b, x, component, d): the pairs of nodes that share a signature, lie in different components and may be
    similar enough; x is one of a and b, and component that of the other. d: the difference of their sketches."""
    at = near.select("s", "node").join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = at.groupBy("s", "component").agg(F.count("*").alias("many"))
    mixed = parts.groupBy("s").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("many", "component")).alias("main")).where("parts > 1").select("s", "main")
    at = at.join(mixed, "s").join(brief, "node")
    few = at.where("component <> main")
    pairs = few.alias("x").join(at.alias("y"), F.expr(f"x.s = y.s and x.component <> y.component and {_may('x', 'y', percent)}"))
    return pairs.selectExpr("greatest(x.node, y.node) as a", "least(x.node, y.node) as b", "x.node as x", "y.component as component", f"{_differ('x', 'y')} as d")


def joined(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs(doc_id, text)."""
    common = shared.cut(_common(docs, n, percent))
    marked, sent = _marked(docs, Bloom(common, "s", FILTER_BITS), n, percent)
    marked = shared.cut(marked.withColumn("row", F.monotonically_increasing_id()))
    sent.destroy()
    shared.drop(common)
    shared.sweep(docs.sparkSession)
    heads = marked.where("size(signatures) > 0").groupBy("k0", "k1").agg(*(F.first(c).alias(c) for c in ("n_shingles", *_PARITY, "signatures", "tags")))
    heads = shared.cut(heads.withColumn("node", F.monotonically_increasing_id()))
    near = _near(heads)
    brief = heads.select("node", "n_shingles", *_PARITY)
    texts = _texts(docs, near.select("node").distinct().join(heads.select("node", "k0", "k1"), "node"), n)

    votes = near.where("node <> pivot").groupBy("node", "pivot").agg(F.count("*").alias("many"))
    votes = votes.alias("v").join(brief.alias("x"), F.expr("v.node = x.node")).join(brief.alias("y"), F.expr("v.pivot = y.node")).where(_may("x", "y", percent)).select("v.*")
    first = votes.groupBy("node").agg(F.max_by("pivot", F.struct("many", "pivot")).alias("b")).select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()
    tried = shared.cut(first)
    edges = _linked(tried, texts, n, percent)
    shared.sweep(docs.sparkSession)
    part = shared.cut(components(edges))
    # the nearest of each other component first, as one link is mostly enough; then all that are still apart
    for k in range(ROUNDS + 1):
        pairs = _across(near, brief, part, percent).join(tried, ["a", "b"], "left_anti")
        if k < ROUNDS:  # aggregated before any pair is written
            pairs = pairs.groupBy("x", "component").agg(F.min_by(F.struct("a", "b"), F.struct("d", "a", "b")).alias("p")).select("p.*")
        pairs = shared.cut(pairs.select("a", "b").distinct())
        shared.sweep(docs.sparkSession)
        if pairs.isEmpty():
            break
        found, tried = _linked(pairs, texts, n, percent), tried.union(pairs)
        if not found.isEmpty():
            edges = edges.union(found)
            part = shared.cut(components(edges))

    member = marked.select("row", "doc_id", "k0", "k1").join(heads.select("k0", "k1", "node"), ["k0", "k1"]).join(part, "node", "left").select("row", "doc_id", F.coalesce("component", "node").alias("component"))
    ids = member.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    groups = shared.cut(member.join(ids, "component").select("row", "component_id"))
    shared.drop(near, texts, heads)
    return marked.select("row", "doc_id", "n_shingles").join(groups, "row", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
