"""Suffix-array dedup: every byte covered by a SPAN-byte string that also starts earlier is removed.

Sorting all suffixes of a corpus moves each byte many times over, so the steps below work on what can
repeat at all, which is found exactly:

1. Each window of SPAN bytes has an anchor, the GRAM-byte string in it with the smallest hash (the rightmost of equal
   ones). Equal windows have equal anchors at equal offsets. Anchors that occur once in the corpus are left out.
2. A run is a maximal series of windows with one anchor. Of runs of equal bytes (128 bits of hashes) the first is
   kept; all windows of the others start earlier somewhere, so they are done.
3. First runs that share an anchor but differ may still share some windows. They are cut into blocks of BLOCK, then
   FEW windows, on a grid that is fixed by the anchor; of equal blocks again only the first is kept. The bytes that
   all windows of a block have in common, its core, get a name, and blocks of a core that occurs once are left out. A
   block is then a short string of symbols: the bytes to the left, the core's name, the bytes to the right; its
   windows are prefixes of that string's suffixes.
4. Triples of symbols at places sampled by a difference cover ({1, 2} modulo 3) are named; as a window has FEW
   symbols, one more than a triple, a name and a symbol tell windows apart. Windows equal in both form a group whose
   first place stays. Grouping by equality replaces the method's merge of suffixes and comparison of neighbours, as only
   equality is asked: the names' order isn't used, and there is no recursion.

The texts are read once for each of anchors, runs, blocks and the result. Filters of fixed size keep what can't repeat
from being sent; a false positive only adds rows to steps that compare exactly. Aggregations are partial before their
shuffles, and no group is gathered, so a string that a third of all documents hold is no harder than others.

Cases: null counts as empty; texts shorter than SPAN lose nothing; strings may overlap themselves and others in one
text. Rows of one doc_id and one text count as one document: a place is an id and a start, and what is removed at a place
goes from all of them. Rows of one doc_id with other texts are documents of their own, in the order of their texts'
SHA-256. A null id comes before all others. Ids may be of any type that can be sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm import shared
from lexquarry.llm import textbytes as tb
from lexquarry.llm.bloom import Bloom

SPAN, GRAM = 100, 32
REACH = SPAN - GRAM + 1
BLOCK, FEW = 16, 4
FILTER_BITS = 1 << 26
#: Bits of the anchors' hashes that are counted: an accidental agreement only lets a run through to the exact steps.
ANCHOR_BITS = 44
_NO_ID = -(1 << 63)


class Runs:
    """The runs of a slice: row, anchor's place and hash, first and last window."""

    def __init__(self, part: tb.Slice) -> None:
        data, n = part.data, len(part.data)
        self.row = self.at = self.lo = self.hi = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.uint64)
        if n < SPAN:
            return
        grams = tb.all_grams(data, GRAM)
        least = _least(grams)
        step = np.zeros(len(least) + 1, np.int8)
        full = part.ends - part.starts >= SPAN
        step[part.starts[full]] = 1
        step[part.ends[full] - SPAN + 1] = -1
        inside = np.cumsum(step[:-1], dtype=np.int8).view(bool)
        # a run ends where the anchor changes or the windows of a text do; those of two texts never touch
        change = np.concatenate(([True], least[1:] != least[:-1], [True]))
        change[1:-1] |= inside[1:] != inside[:-1]
        self.lo, self.hi = np.flatnonzero(change[:-1] & inside), np.flatnonzero(change[1:] & inside)
        self.at = (_LOW - (least[self.lo] & _LOW)).astype(np.int64)
        self.anchor, self.row = grams[self.at], part.row_of(self.lo)

    def only(self, keep: np.ndarray) -> Runs:
        self.row, self.at, self.lo, self.hi, self.anchor = (x[keep] for x in (self.row, self.at, self.lo, self.hi, self.anchor))
        return self


_LOW = np.uint64(0xFFFFFFFF)


def _least(grams: np.ndarray) -> np.ndarray:
    """The smallest of REACH neighbours, found by doubling in pieces that stay in a core's cache: the hash's high half above
    the place's complement, which makes the rightmost of equal ones win."""
    many = len(grams) - REACH + 1
    out = np.zeros(many, np.uint64)
    for a in range(0, many, tb.PIECE):
        b = min(a + tb.PIECE, many)
        x, size = (grams[a : b + REACH - 1] & ~_LOW) | (_LOW - np.arange(a, b + REACH - 1, dtype=np.uint64)), 1
        while 2 * size <= REACH:
            x = np.minimum(x[:-size], x[size:])
            size *= 2
        out[a:b] = np.minimum(x[: b - a], x[REACH - size : REACH - size + b - a])
    return out


def _cut(anchor: np.ndarray) -> np.ndarray:
    return anchor >> np.uint64(64 - ANCHOR_BITS)


def _ids(part: tb.Slice) -> np.ndarray:
    return part.rows.column(0).cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _place(ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    return tb.mix(tb.mix(ids.astype(np.int64).view(np.uint64)) + start.astype(np.uint64))


def anchors(docs: DataFrame) -> DataFrame:
    """(anchor, many): how often each anchor occurs in a slice, 2 for more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches, "text"):
            u, many = np.unique(_cut(Runs(part).anchor), return_counts=True)
            yield pa.RecordBatch.from_arrays([_long(u), pa.array(np.minimum(many, 2), pa.int32())], ["anchor", "many"])

    return docs.select("text").mapInArrow(run, "anchor long, many int")


def runs(docs: DataFrame, repeated: Bloom) -> DataFrame:
    """(h0, h1, anchor, doc_id, code) of the runs whose anchor may repeat. code: 128 * start + windows - 1."""
    sent = docs.sparkSession.sparkContext.broadcast(repeated)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches, "text"):
            r = Runs(part)
            r.only(sent.value.has(tb.mix(_cut(r.anchor))))
            h = tb.span_hashes(part.data, r.lo, r.hi + SPAN)
            two = tb.span_hashes(_OTHER[part.data], r.lo, r.hi + SPAN)
            code = _codes(part, r)
            yield pa.RecordBatch.from_arrays([_long(h), _long(two), _long(r.anchor), pa.array(_ids(part)[r.row]), pa.array(code)], ["h0", "h1", "anchor", "doc_id", "code"])

    return docs.select("doc_id", "text").mapInArrow(run, "h0 long, h1 long, anchor long, doc_id long, code long")


#: Another order of the byte values, for second hashes.
_OTHER = np.random.default_rng(5).permutation(256).astype(np.uint8)


def _block_table(part: tb.Slice, r: Runs) -> dict[str, np.ndarray]:
    """The blocks of runs: k (its run), c (where its core starts), zero (where its window 0 would start), t0 and t1."""
    grid0, grid1 = (r.at - r.hi) // BLOCK, (r.at - r.lo) // BLOCK
    many = grid1 - grid0 + 1
    k = np.repeat(np.arange(len(many)), many)
    grid = grid0[k] + np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many)
    c = r.at[k] - grid * BLOCK
    zero = c - (BLOCK - 1)
    return {"k": k, "grid": grid, "c": c, "zero": zero, "t0": np.maximum(r.lo[k] - zero, 0), "t1": np.minimum(r.hi[k] - zero, BLOCK - 1)}


def _open_runs(part: tb.Slice, r: Runs, differing: Bloom, first: Bloom) -> Runs:
    """First runs that share an anchor with others."""
    ids, code = _ids(part), _codes(part, r)
    return r.only(differing.has(r.anchor) & first.has(_place(ids[r.row], code)))


def _codes(part: tb.Slice, r: Runs) -> np.ndarray:
    return (r.lo - part.starts[r.row]) * 128 + r.hi - r.lo


def _block_codes(part: tb.Slice, r: Runs, t: dict[str, np.ndarray]) -> np.ndarray:
    return (t["zero"] + t["t0"] - part.starts[r.row[t["k"]]]) * 128 + t["t1"] - t["t0"]


def blocks(docs: DataFrame, differing: Bloom, first: Bloom) -> DataFrame:
    """(f0, f1, doc_id, code, grid, c0, c1, left, right, at, t0, t1): the blocks of first runs that share an anchor.

    f0, f1: hashes of all bytes of the block's windows; c0, c1: of its core. code: as for runs. at is where the block's
    window 0 would start; windows t0 to t1 belong to the run.
    """
    sent = docs.sparkSession.sparkContext.broadcast((differing, first))
    core = SPAN - BLOCK + 1
    binary = pa.binary(BLOCK - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches, "text"):
            r = _open_runs(part, Runs(part), *sent.value)
            t = _block_table(part, r)
            k, c, zero = t["k"], t["c"], t["zero"]
            padded = np.concatenate((np.zeros(SPAN, np.uint8), part.data, np.zeros(SPAN, np.uint8)))
            side = np.arange(BLOCK - 1)
            left, right = padded[SPAN + zero[:, None] + side], padded[SPAN + c[:, None] + core + side]
            row, one, two = r.row[k], tb.Spans(part.data), tb.Spans(_OTHER[part.data])
            a, b = zero + t["t0"], zero + t["t1"] + SPAN
            yield pa.RecordBatch.from_arrays(
                [_long(one.hashes(a, b)), _long(two.hashes(a, b)), pa.array(_ids(part)[row]), pa.array(_block_codes(part, r, t)), pa.array(t["grid"], pa.int32()),
                 _long(one.hashes(c, c + core)), _long(two.hashes(c, c + core)),
                 *(pa.FixedSizeBinaryArray.from_buffers(binary, len(k), [None, pa.py_buffer(np.ascontiguousarray(s).tobytes())]).cast(pa.binary()) for s in (left, right)),
                 pa.array(zero - part.starts[row]), pa.array(t["t0"], pa.int32()), pa.array(t["t1"], pa.int32())],
                ["f0", "f1", "doc_id", "code", "grid", "c0", "c1", "left", "right", "at", "t0", "t1"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "f0 long, f1 long, doc_id long, code long, grid int, c0 long, c1 long, `left` binary, `right` binary, at long, t0 int, t1 int")


def first_blocks(found: DataFrame) -> DataFrame:
    """Of equal blocks the first: (doc_id, code, grid, c0, c1, left, right, at, t0, t1)."""
    row = F.struct("doc_id", "code", "grid", "c0", "c1", "left", "right", "at", "t0", "t1")
    return found.groupBy("f0", "f1").agg(F.min(row).alias("b")).select("b.*")


def small_blocks(first: DataFrame) -> DataFrame:
    """(k0, k1, l, r, w0, w1, doc_id, at): blocks of FEW windows, for blocks whose core others have too.

    k0, k1: hashes of the small block's own core; l, r: its bytes to the left and right as one number each, those that
    belong to none of its windows w0 to w1 as zero.
    """
    often = first.groupBy("grid", "c0", "c1").agg(F.count("*").alias("many")).where("many > 1")
    # a false positive adds small blocks whose cores are counted exactly later
    sent = first.sparkSession.sparkContext.broadcast(Bloom(often, "c0", FILTER_BITS // 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(sent.value.has(b.column(b.schema.get_field_index("c0")).to_numpy().view(np.uint64))))

    small = first.drop("code").mapInArrow(run, first.drop("code").schema).withColumn("u", F.explode(F.expr(f"sequence(0, {BLOCK // FEW - 1})"))).where(f"t0 < {FEW} * (u + 1) and t1 >= {FEW} * u")
    small = small.selectExpr("*", f"greatest(t0 - {FEW} * u, 0) as w0", f"least(t1 - {FEW} * u, {FEW - 1}) as w1", f"substring(`left`, {FEW} * u + {FEW}, {BLOCK - FEW} - {FEW} * u) as a", f"substring(`right`, 1, {FEW} * u) as b")
    byte = lambda side, i: f"cast(conv(hex(substring(`{side}`, {FEW} * u + {i + 1}, 1)), 16, 10) as bigint)"
    l = " + ".join(f"if(w0 <= {i}, {256 ** (2 - i)} * {byte('left', i)}, 0)" for i in range(FEW - 1))  # noqa: E741
    r = " + ".join(f"if(w1 > {i}, {256 ** (2 - i)} * {byte('right', i)}, 0)" for i in range(FEW - 1))
    core = "grid, c0, c1, u, a, b"
    return small.selectExpr(f"xxhash64({core}) as k0", f"xxhash64(1, {core}) as k1", f"{l} as l", f"{r} as r", "w0", "w1", "doc_id", f"at + {FEW} * u as at")


_SMALL = ["k0", "k1", "l", "r", "w0", "w1"]


def first_small(small: DataFrame) -> DataFrame:
    """Of equal small blocks the first, and how many there are."""
    return small.groupBy(*_SMALL).agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("many"))


def later_small(small: DataFrame, once: DataFrame) -> DataFrame:
    """(doc_id, code): the small blocks that aren't the first of their kind."""
    later = small.join(once.where("many > 1").select(*_SMALL, "first"), _SMALL).where(F.struct("doc_id", "at") != F.col("first"))
    return later.selectExpr("doc_id", "(at + w0) * 128 + w1 - w0 as code")


def strings(once: DataFrame) -> DataFrame:
    """(core, symbols, doc_id, at, w0, w1): small blocks as strings of symbols, if their core repeats."""
    named = once.groupBy("k0", "k1").agg(F.count("*").alias("many")).where("many > 1").select("k0", "k1")
    # names above the bytes' values; checkpointed, as the numbers must not change when a task is run again
    named = shared.checkpointed(named.withColumn("core", F.monotonically_increasing_id() + 256))
    byte = lambda c, i: f"shiftright({c}, {16 - 8 * i}) & 255"
    symbols = "array(" + ", ".join([byte("l", i) for i in range(3)] + ["core"] + [byte("r", i) for i in range(3)]) + ")"
    return once.join(named, ["k0", "k1"]).selectExpr("core", f"{symbols} as symbols", "first.doc_id", "first.at", "w0", "w1")


def triple_names(triples: DataFrame) -> DataFrame:
    """(x, y, z, name): the distinct triples, sorted, with names that grow in their order."""
    order = triples.distinct().repartitionByRange("x", "y", "z").sortWithinPartitions("x", "y", "z")
    return shared.checkpointed(order.withColumn("name", F.monotonically_increasing_id()))


def window_rows(found: DataFrame) -> DataFrame:
    """(x, y, z, w, other, doc_id, start): each window of strings(...) as a sampled triple and one symbol more.

    Of places 0 to 6 of a string, 1, 2, 4 and 5 are sampled. The windows at 1 and 2 are a sampled triple and the symbol
    after it; those at 0 and 3, which aren't sampled, are a symbol and the sampled triple after it.
    """
    w = "struct({}l as w, symbols[{}] as x, symbols[{}] as y, symbols[{}] as z, symbols[{}] as other)"
    rows = found.select("doc_id", "at", "w0", "w1", F.explode(F.expr("array(" + ", ".join((w.format(0, 1, 2, 3, 0), w.format(1, 1, 2, 3, 4), w.format(2, 2, 3, 4, 5), w.format(3, 4, 5, 6, 3))) + ")")).alias("s"))
    return rows.where("s.w between w0 and w1").selectExpr("s.x", "s.y", "s.z", "s.w", "s.other", "doc_id", "at + s.w as start")


def named_rows(rows: DataFrame) -> DataFrame:
    """(w, name, other, place): the triples replaced by their names in sorted order."""
    return rows.join(triple_names(rows.select("x", "y", "z")), ["x", "y", "z"]).select("w", "name", "other", F.struct("doc_id", "start").alias("place"))


def repeated_windows(ranked: DataFrame) -> DataFrame:
    """(doc_id, start) of windows that also start earlier: merged suffixes that agree on the whole window."""
    first = ranked.groupBy("w", "name", "other").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last").drop("last")
    return ranked.join(first, ["w", "name", "other"]).where("place <> first").select("place.doc_id", "place.start")


def repeated_places(first: DataFrame) -> DataFrame:
    """(doc_id, code) of the repeated windows in first_blocks(...)."""
    small = shared.cut(small_blocks(first))
    once = shared.cut(first_small(small))
    rows = shared.cut(window_rows(strings(once)))
    ranked = shared.cut(named_rows(rows))
    out = shared.cut(later_small(small, once).union(repeated_windows(ranked).selectExpr("doc_id", "start * 128 as code")))
    shared.drop(small, once, rows, ranked)
    return out


def places(docs: DataFrame) -> tuple[tuple[Bloom, Bloom, Bloom], DataFrame, DataFrame]:
    """Filters of the anchors that repeat, of those of differing runs, and of first runs; the first runs and blocks
    (doc_id, code), which stay unless other windows of theirs are repeated; and the repeated windows (doc_id, code)."""
    often = anchors(docs).groupBy("anchor").agg(F.sum("many").alias("many")).where("many > 1")
    often = shared.cut(often.select("anchor"))
    repeated = Bloom(_mixed(often), "hash", FILTER_BITS)
    first = runs(docs, repeated).groupBy("h0", "h1").agg(F.min(F.struct("doc_id", "code")).alias("place"), F.first("anchor").alias("anchor"))
    first = shared.cut(first.select("anchor", "place.doc_id", "place.code"))
    differing = Bloom(first.groupBy("anchor").agg(F.count("*").alias("many")).where("many > 1"), "anchor", FILTER_BITS // 2)
    variants = Bloom(_placed(first), "hash", FILTER_BITS)
    cut = shared.cut(first_blocks(blocks(docs, differing, variants)))
    windows = repeated_places(cut)
    shared.drop(often)
    return (repeated, differing, variants), first.select("doc_id", "code").union(cut.select("doc_id", -1 - F.col("code"))), windows


def _mixed(anchor: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([_long(tb.mix(b.column(0).to_numpy().view(np.uint64)))], ["hash"])

    return anchor.mapInArrow(run, "hash long")


def _placed(first: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([_long(_place(b.column(0).to_numpy(), b.column(1).to_numpy()))], ["hash"])

    return first.select("doc_id", "code").mapInArrow(run, "hash long")


def kept_spans(size: int, starts: np.ndarray, ends: np.ndarray) -> tuple[list[tuple[int, int]], int]:
    """What is left of 0..size without the union of starts..ends, and the number of maximal removed runs."""
    step = np.zeros(size + 1, np.int64)
    ok = ends <= size
    np.add.at(step, starts[ok], 1)
    np.subtract.at(step, ends[ok], 1)
    gone = np.concatenate(([0], (np.cumsum(step[:-1]) > 0).astype(np.int8), [0]))
    edge = np.flatnonzero(np.diff(gone))
    a, b = edge[0::2], edge[1::2]
    keep = list(zip(np.append(0, b).tolist(), np.append(a, size).tolist(), strict=True))
    return [(s, e) for s, e in keep if s < e], len(a)


def _needs_numbers(docs: DataFrame) -> bool:
    """Whether ids can't serve as places: not integers, or several rows have one. Only ids are read."""
    if docs.schema["doc_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        return True
    return not docs.groupBy("doc_id").agg(F.count("*").alias("many")).where(f"many > 1 or doc_id = {_NO_ID}").isEmpty()


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with numbers as ids that grow with (doc_id, hash of the text), and (number, id) for each of them."""
    d = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("th"))
    order = d.select("doc_id", "th").distinct().repartitionByRange(F.asc_nulls_first("doc_id"), "th").sortWithinPartitions(F.asc_nulls_first("doc_id"), "th")
    # checkpointed, as the numbers must not change when a task is run again
    names = shared.checkpointed(order.select(F.col("doc_id").alias("id"), F.col("th").alias("h"), F.monotonically_increasing_id().alias("number")))
    rows = d.join(names, F.expr("doc_id <=> id and th = h")).select(F.col("number").alias("doc_id"), "text")
    return shared.cut(rows), names.select("number", "id")


def deduped(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row; kept: the rest as bytes, null if all is kept."""
    docs = docs.select("doc_id", "text")
    if not _needs_numbers(docs):
        return _deduped(docs)
    rows, names = numbered(docs)
    return _deduped(rows).join(names, F.col("doc_id") == F.col("number")).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def _deduped(docs: DataFrame) -> DataFrame:
    """deduped() where rows of one integer id have one text."""
    filters, first, windows = places(docs)
    sent = docs.sparkSession.sparkContext.broadcast(filters)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, differing, variants = sent.value
        for part in tb.slices(batches, "text"):
            r = Runs(part)
            r.only(repeated.has(tb.mix(_cut(r.anchor))))
            row, code = r.row, _codes(part, r)
            r = _open_runs(part, r, differing, variants)
            t = _block_table(part, r)
            # runs as they are, blocks as negative numbers
            row, code = np.concatenate((row, r.row[t["k"]])), np.concatenate((code, -1 - _block_codes(part, r, t)))
            order = np.argsort(row, kind="stable")
            bounds = np.searchsorted(row[order], np.arange(len(part) + 1))
            texts = [part.text(i) for i in range(len(part))]
            yield pa.RecordBatch.from_arrays(
                [part.rows.column(0), pa.array(_ids(part)), pa.array(part.ends - part.starts), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                 pa.array([t if b > a else None for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True)], pa.binary()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(code[order]))],
                ["doc_id", "id", "n_bytes", "kept_sha256", "body", "codes"],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                yield _without(b.slice(i, 64))

    rows = docs.mapInArrow(read, f"doc_id {kind}, id long, n_bytes long, kept_sha256 string, body binary, codes array<long>")
    # lists of one document's places: bounded by its length
    firsts = first.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("code").alias("first"))
    later = windows.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("code").alias("windows"))
    empty = F.array().cast("array<long>")
    rows = rows.join(firsts, "id", "left").join(later, "id", "left")
    rows = rows.select("doc_id", "n_bytes", "kept_sha256", "body", F.array_except("codes", F.coalesce("first", empty)).alias("codes"), F.coalesce("windows", empty).alias("windows"))
    return rows.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _without(b: pa.RecordBatch) -> pa.RecordBatch:
    removed, spans, sha, kept = [], [], [], []
    for size, old, body, codes, windows in zip(*(b.column(i) for i in range(1, 6)), strict=True):
        codes, windows = np.array(codes.values, np.int64), np.array(windows.values, np.int64)
        if body.as_py() is None or not len(codes) + len(windows):
            removed.append(0), spans.append(0), sha.append(old.as_py()), kept.append(None)
            continue
        text = body.as_py()
        codes = np.concatenate((np.where(codes < 0, -1 - codes, codes), windows))
        keep, n = kept_spans(len(text), codes // 128, codes // 128 + codes % 128 + SPAN)
        rest = b"".join([text[s:e] for s, e in keep])
        removed.append(len(text) - len(rest)), spans.append(n), sha.append(hashlib.sha256(rest).hexdigest()), kept.append(rest)
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
