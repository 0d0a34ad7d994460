"""Token ids in ORC files: written in the order of document ids, read back by stripes or by id.

A folder holds `tokens`, ORC files of (doc_id, part, at, n_tokens, ids), and `parts`, one row for each part with the
number of ids before it. Documents are dealt to parts by ranges of their id and sorted there; `at` counts the ids of
a part before a document, so a document's place among all ids is its part's plus `at` and no row has to be read for it
twice. ORC stores the ids by integer run lengths, with an index for every STRIDE rows and Bloom filters on the ids:
stripes are read by tasks of their own, and a search for ids leaves out row groups that can't hold them.

The tokenizer is a file of the tokenizers library. For a byte-level vocabulary texts are split into words first and the
library's model encodes each word once for each worker, which gives the same ids; with any other file it encodes whole
texts.
Strings of special tokens in a text become those tokens; no special tokens are added, and nothing is cut off or padded.

Cases: null counts as empty and has the end id alone; a null id comes first; rows of one id come in the order of their
texts' hashes; a table without rows gives a folder without ids.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.llm import bpe, shared
from lexquarry.llm import textbytes as tb

END = 2
STRIDE, STRIPE_BYTES, BLOOM_FPP = 1_000, 16 << 20, 0.01
PIECE = 1 << 20
#: A worker keeps the ids of words of up to LONG characters, until they come to CACHED_CHARS.
LONG, CACHED_CHARS = 200, 6 << 20
_BETWEEN_WORDS = re.compile(r"(?<=[0-9A-Za-z])(?= [0-9A-Za-z])")
# letters, numbers and white space up to U+024F; what other characters are differs between versions of Unicode, so the
# library itself splits what holds them
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile("[^\x00-\u024f]")
_LETTERS = dict(enumerate(bpe.byte_letters()))


class Words(dict):
    """The ids of words as little-endian numbers of four bytes, encoded by the library's model when first met."""

    def __init__(self, tokenizer: object) -> None:
        self.model, self.chars = tokenizer.model, 0

    def __missing__(self, word: str) -> bytes:
        found = self.model.tokenize(word.encode().decode("latin-1").translate(_LETTERS))
        ids = np.array([t.id for t in found], "<i4").tobytes()
        if len(word) <= LONG:
            if self.chars > CACHED_CHARS:
                self.clear()
                self.chars = 0
            self[word], self.chars = ids, self.chars + len(word)
        return ids


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        file = json.loads(self.tokenizer.to_str())
        split, added = file.get("pre_tokenizer") or {}, file.get("added_tokens") or []
        plain = not any(t[k] for t in added for k in ("lstrip", "rstrip", "single_word"))
        self.by_words = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not file.get("normalizer") and plain
        self.known = Words(self.tokenizer)
        special = "|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))
        self.special = re.compile(f"({special})") if special else None

    def encode(self, text: str) -> bytes:
        """The ids of a text as in Words."""
        if not self.by_words:
            return self._whole(text)
        parts = self.special.split(text) if self.special else [text]
        return self._plain(text) if len(parts) == 1 else b"".join(self._whole(p) if k % 2 else self._plain(p) for k, p in enumerate(parts))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<i4").tobytes()

    def _plain(self, text: str) -> bytes:
        if _BEYOND.search(text):
            # cut where every version sees two words, and joined again to the longest parts with and without them
            kinds = groupby(_BETWEEN_WORDS.split(text), lambda p: bool(_BEYOND.search(p)))
            return b"".join(self._whole("".join(p)) if beyond else self._latin("".join(p)) for beyond, p in kinds)
        return self._latin(text)

    def _latin(self, text: str) -> bytes:
        words, ids = _LATIN.findall, self.known.__getitem__
        if len(text) <= 2 * PIECE:
            return b"".join(map(ids, words(text)))
        out, at = [], 0
        while at < len(text):
            cut = _BETWEEN_WORDS.search(text, at + PIECE)
            end = cut.start() if cut else len(text)
            out.append(b"".join(map(ids, words(text, at, end))))
            at = end
        return b"".join(out)


@lru_cache(maxsize=2)
def load(path: str) -> Encoder:
    return Encoder(path)


def encoded(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """(doc_id, part, at, n_tokens, ids) of docs(doc_id, text), in the order of the rows of each partition."""
    path = path or bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, last = TaskContext.get().partitionId(), 0, np.array([end], "<i4").tobytes()
        for rows in tb.slices(batches, "text"):
            ids = [load(path).encode(rows.text(i).decode()) + last for i in range(len(rows))]
            upto = np.cumsum([0, *map(len, ids)]) // 4
            columns = [rows.rows.column(0), pa.array(np.full(len(rows), part, np.int32)), pa.array(at + upto[:-1]), pa.array(np.diff(upto)), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "at", "n_tokens", "ids"])
            at += int(upto[-1])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part int, at long, n_tokens long, ids array<int>")


def written(docs: DataFrame, folder: str | None = None, path: str | None = None, end: int = END) -> str:
    """Writes the ids of docs(doc_id, text), each text's with `end` after them, and returns the folder."""
    folder = folder or f"{shared.folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    by = ["doc_id", "tie"]
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange(*by).sortWithinPartitions(*by)
    out = encoded(dealt, path, end).write.option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", STRIDE)
    out.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", BLOOM_FPP).option("orc.compress", "ZSTD").orc(f"{folder}/tokens")
    spark = docs.sparkSession
    found = spark.read.orc(f"{folder}/tokens").groupBy("part").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    rows = sorted(map(tuple, found.collect()), key=lambda x: x[0])  # one for each part
    before = accumulate((x[2] for x in rows), initial=0)
    table = spark.createDataFrame([(*x, b) for x, b in zip(rows, before, strict=False)], f"part int, documents long, tokens long, first_id {docs.schema['doc_id'].dataType.simpleString()}, last_id {docs.schema['doc_id'].dataType.simpleString()}, start long")
    table.coalesce(1).write.orc(f"{folder}/parts")
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts the ids of all documents before."""
    parts = spark.read.orc(f"{folder}/parts").select("part", "start")
    return spark.read.orc(f"{folder}/tokens").join(parts, "part").select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, folder: str, doc_ids: list) -> DataFrame:
    """read() of some documents; the files' statistics and Bloom filters leave out what can't hold them."""
    return read(spark, folder).where(F.col("doc_id").isin(doc_ids))


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of read()'s rows, from the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["ids"]
            size = ids.value_lengths().to_numpy(zero_copy_only=False)
            raw = memoryview(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            upto = np.concatenate(([0], np.cumsum(size) * 4)).tolist()
            crc = [crc32(raw[a:b]) for a, b in zip(upto[:-1], upto[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["start"], pa.array(size, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "ids").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long")
