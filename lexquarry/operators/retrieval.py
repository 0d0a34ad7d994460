"""Ranked retrieval over chunks(kb, chunk_id, path, collection, heading, content): BM25, nearest vectors, and their fusion.

`bm25` counts its words in one pass over the texts, and only counts are shuffled. For many queries over one corpus, write
`index(chunks)` once as a table and ask it with `bm25_from`, which reads the lists of terms and no text, or
`write_postings` and ask `bm25_stored`, which reads the rows of the query's terms and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexquarry.functions import text as t
from lexquarry.functions import vectors as v

K1, B = 1.2, 0.75
RRF = 60
STRONG, RELATED = 0.70, 0.88
#: Words whose places are listed at once.
WORDS = 1_000_000


def postings(chunks: DataFrame) -> DataFrame:
    """(kb, chunk_id, term, tf, dl): one row for each chunk and distinct term."""
    d = chunks.select("kb", "chunk_id", t.terms("content").alias("w"))
    d = d.select("kb", "chunk_id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    return d.groupBy("kb", "chunk_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def filtered(chunks: DataFrame, collection: str | None = None, glob: str | None = None) -> DataFrame:
    if collection is not None:
        chunks = chunks.where(F.col("collection") == collection)
    return chunks if glob is None else chunks.where(F.col("path").rlike(t.glob_pattern(glob)))


def index(chunks: DataFrame) -> DataFrame:
    """(kb, chunk_id, path, collection, w): each chunk's terms in their order, to be written once and asked with bm25_from."""
    return chunks.select("kb", "chunk_id", "path", "collection", t.terms("content").alias("w"))


def bm25(chunks: DataFrame, query: str, collection: str | None = None, glob: str | None = None) -> DataFrame:
    """(kb, chunk_id, score): smaller is better, any of the query's words suffices.

    Frequencies and lengths are those of the whole kb; filters only choose what is returned. A word in half the chunks
    or more gets the weight 1e-6. A query word of several terms must stand as a phrase.
    """
    held = [c for c, needed in (("collection", collection is not None), ("path", glob is not None)) if needed]
    return bm25_from(chunks.select("kb", "chunk_id", *held, t.terms("content").alias("w")), query, collection, glob)


def bm25_from(terms: DataFrame, query: str, collection: str | None = None, glob: str | None = None) -> DataFrame:
    """bm25 over index(...)."""
    words = list(dict.fromkeys(w for w in (x.replace('"', "").lower() for x in query.split()) if w))
    if not words:
        return terms.select("kb", "chunk_id", F.lit(0.0).alias("score")).where("false")
    tf = F.array(*(_count(F.col("x"), t.terms(F.lit(w))) for w in words))
    keep = [c for c in terms.columns if c in ("collection", "path")]
    # a generator, so that neither the split nor the counts are computed again for each place that uses them
    d = terms.select("kb", "chunk_id", *keep, F.inline(F.array(F.struct(F.size("w").alias("dl"), F.array_join("w", "  ").alias("x")))))
    d = d.select("kb", "chunk_id", *keep, "dl", F.explode(F.array(tf)).alias("tf"))
    n, many = len(words), F.col("n")
    stats = d.groupBy("kb").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(n)))
    weights = [F.log((many - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) for i in range(n)]
    stats = stats.select("kb", "avgdl", F.array(*(F.when(x > 0, x).otherwise(1e-6) for x in weights)).alias("idf"))
    hits = filtered(d.where(F.exists("tf", lambda x: x > 0)), collection, glob)
    # a row for each kb; whether it is small enough to broadcast is left to the measured size
    return _scores(hits.join(stats, "kb"))


def _scores(hits: DataFrame) -> DataFrame:
    """(kb, chunk_id, score) of hits(tf, idf, dl, avgdl, ...)."""
    one = F.zip_with("tf", "idf", lambda f, w: w * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))))
    return hits.select("kb", "chunk_id", (-F.aggregate(one, F.lit(0.0), lambda a, x: a + x)).alias("score"))


def write_postings(chunks: DataFrame, folder: str, buckets: int = 64) -> None:
    """The corpus by term, to be searched with bm25_stored: `terms`, a row for each chunk and distinct term with its places,
    in files by a bucket of the term and sorted by it, `chunks` with their paths and collections, and `kbs`, the number and
    mean length of each kb's chunks. No bucket is gathered in one task: its rows are dealt out by chunk too.

    A chunk's places are listed where it is read, so that a term's row is shuffled once, and no single word is.
    """
    d = index(chunks).withColumn("dl", F.size("w")).withColumn("where", F.xxhash64("path", "collection"))
    d.select("kb", "chunk_id", "where", "path", "collection").write.mode("overwrite").parquet(f"{folder}/chunks")
    kind = lambda c: d.schema[c].dataType.simpleString()
    rows = d.select("kb", "chunk_id", "where", "dl", "w").mapInArrow(_listed, f"kb {kind('kb')}, chunk_id {kind('chunk_id')}, where long, dl int, term string, places array<int>")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).sortWithinPartitions("bucket", "term")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/terms")
    d.groupBy("kb").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{folder}/kbs")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk and distinct term of rows(kb, chunk_id, where, dl, w), with the term's places in w; some chunks at once."""
    for batch in batches:
        start = 0
        ends = np.cumsum(pc.fill_null(batch["dl"], 0).to_numpy(zero_copy_only=False).clip(0))
        while start < batch.num_rows:
            # about WORDS words, or one chunk
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + WORDS, "right")))
            some, start = batch.slice(start, stop - start), stop
            w = some["w"]
            row = pc.list_parent_indices(w).to_numpy()
            if len(row):
                new = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                at = np.arange(len(row)) - np.repeat(new, np.diff(np.append(new, len(row))))
                t_ = pa.table({"row": pa.array(row), "term": pc.list_flatten(w), "at": pa.array(at, pa.int32())}).group_by(["row", "term"], use_threads=False).aggregate([("at", "list")]).combine_chunks()
                of = some.select(["kb", "chunk_id", "where", "dl"]).take(t_["row"].combine_chunks() if isinstance(t_["row"], pa.ChunkedArray) else t_["row"])
                term, places = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (t_["term"], t_["at_list"]))
                yield pa.RecordBatch.from_arrays([*of.columns, term, places], names=["kb", "chunk_id", "where", "dl", "term", "places"])


def bm25_stored(spark: SparkSession, folder: str, query: str, collection: str | None = None, glob: str | None = None) -> DataFrame:
    """bm25 over write_postings(...): only the files of the query's terms are opened, and in them only their row groups read."""
    words = list(dict.fromkeys(w for w in (x.replace('"', "").lower() for x in query.split()) if w))
    kbs = spark.read.parquet(f"{folder}/kbs")
    first = kbs.select("buckets").first()
    # the query's own terms, by the expression that made the stored ones
    split = spark.range(1).select(*(t.terms(F.lit(w)).alias(f"w{i}") for i, w in enumerate(words))).first() if words else ()
    phrases = [list(p) for p in split]
    asked = sorted({x for p in phrases for x in p})
    stored = spark.read.parquet(f"{folder}/terms")
    if not asked or first is None:
        return stored.select("kb", "chunk_id", F.lit(0.0).alias("score")).where("false")
    bucket = [b for (b,) in spark.createDataFrame([(x,) for x in asked], "term string").select(F.pmod(F.xxhash64("term"), F.lit(first["buckets"])).cast("int")).distinct().collect()]
    d = stored.where(F.col("bucket").isin(bucket) & F.col("term").isin(asked))
    # a chunk's places of each asked term: as many as the query has terms, in one row
    d = d.groupBy("kb", "chunk_id", "where", "dl", "term").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
    d = d.groupBy("kb", "chunk_id", "where", "dl").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at"))
    tf = F.array(*(_stands([F.coalesce(F.try_element_at("at", F.lit(x)), F.array().cast("array<int>")) for x in p]) for p in phrases))
    d = d.select("kb", "chunk_id", "where", "dl", F.explode(F.array(tf)).alias("tf")).where(F.exists("tf", lambda x: x > 0))
    n, many = len(phrases), F.col("n")
    df = d.groupBy("kb").agg(*(F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(n)))
    weights = [F.log((many - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) for i in range(n)]
    stats = df.join(kbs, "kb").select("kb", "avgdl", F.array(*(F.when(x > 0, x).otherwise(1e-6) for x in weights)).alias("idf"))
    if collection is not None or glob is not None:
        d = d.join(filtered(spark.read.parquet(f"{folder}/chunks"), collection, glob), ["kb", "chunk_id", "where"], "left_semi")
    return _scores(d.join(stats, "kb"))


def _stands(places: list[Column]) -> Column:
    """How often terms stand one after another, given the places of each; of overlapping places the first counts."""
    if not places:
        return F.lit(0)
    together = places[0]
    back = lambda p, k: F.transform(p, lambda x: x - k)
    for k, p in enumerate(places[1:], 1):
        together = F.array_intersect(together, back(p, k))
    if len(places) == 1:
        return F.size(together)
    state = lambda n, end: F.struct(n.alias("n"), end.alias("end"))
    step = lambda a, x: F.when(x >= a["end"], state(a["n"] + 1, x + len(places))).otherwise(a)
    return F.aggregate(F.array_sort(together), state(F.lit(0), F.lit(0)), step, lambda a: a["n"])


def _count(joined: Column, phrase: Column) -> Column:
    """How often a phrase stands in terms joined by two blanks: with one blank at each end no two places share one."""
    p = F.concat(F.lit(" "), F.array_join(phrase, "  "), F.lit(" "))
    x = F.concat(F.lit(" "), joined, F.lit(" "))
    return F.when(F.size(phrase) > 0, (F.length(x) - F.length(F.replace(x, p, F.lit("")))) / F.length(p)).otherwise(0).cast("int")


def nearest(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(kb, chunk_id, distance): the k nearest of each kb by Euclidean distance, ties by id.

    Each task keeps the k best of what it has read (`grouped limit`), so k rows a kb and task are shuffled.
    """
    q = F.array(*(F.lit(float(x)) for x in query))
    d = vectors.select("kb", "chunk_id", v.l2(F.col("embedding"), q).alias("distance"))
    w = Window.partitionBy("kb").orderBy("distance", "chunk_id")
    return d.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def ranked(hits: DataFrame, by: str, n: int) -> DataFrame:
    """With `rank` 1..n within each kb."""
    w = Window.partitionBy("kb").orderBy(by, "chunk_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def closeness(distance: Column) -> Column:
    """strong, related, weak; null without a distance. A label, never a filter."""
    return F.when(distance <= STRONG, "strong").when(distance <= RELATED, "related").when(distance.isNotNull(), "weak")


def fused(lexical: DataFrame, semantic: DataFrame, k: int, kb_order: dict[str, int] | None = None) -> DataFrame:
    """(kb, chunk_id, score, bm25_rank, vector_rank, distance): reciprocal ranks summed over both legs.

    Ties: the order of kbs, then the lexical rank, then the vector rank.
    """
    a = lexical.select("kb", "chunk_id", F.col("rank").alias("bm25_rank"))
    b = semantic.select("kb", "chunk_id", F.col("rank").alias("vector_rank"), "distance")
    d = a.join(b, ["kb", "chunk_id"], "full")
    part = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    d = d.withColumn("score", F.round(part("bm25_rank") + part("vector_rank"), 5))
    order = F.coalesce(*(F.when(F.col("kb") == name, i) for name, i in (kb_order or {}).items()), F.lit(1 << 20))
    return d.orderBy(F.desc("score"), order, "kb", F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("vector_rank"), "chunk_id").limit(k)


def search(chunks: DataFrame, query: str, vectors: DataFrame | None = None, query_vector: list[float] | None = None, k: int = 10, collection: str | None = None, glob: str | None = None, kbs: list[str] | None = None) -> DataFrame:
    """The best k chunks over all kbs with path, heading, snippet, score, ranks, distance and closeness.

    Filters apply before the lexical leg's cut, and after the vector leg's, which may then have fewer rows.
    """
    if kbs is not None:
        chunks = chunks.where(F.col("kb").isin(kbs))
    n = max(3 * k, 20)
    lexical = ranked(bm25(chunks, query, collection, glob), "score", n)
    if vectors is not None and query_vector is not None:
        near = nearest(vectors if kbs is None else vectors.where(F.col("kb").isin(kbs)), query_vector, n)
        keep = filtered(chunks, collection, glob).select("kb", "chunk_id")
        semantic = ranked(near.join(keep, ["kb", "chunk_id"], "left_semi"), "distance", n)
    else:
        semantic = lexical.select("kb", "chunk_id", F.lit(None).cast("int").alias("rank"), F.lit(None).cast("double").alias("distance")).where("false")
    best = fused(lexical, semantic, k, {name: i for i, name in enumerate(kbs or [])})
    # at most k rows
    out = chunks.join(F.broadcast(best), ["kb", "chunk_id"])
    return out.select("kb", "chunk_id", "path", "collection", "heading", t.snippet("content").alias("snippet"), "score", "bm25_rank", "vector_rank", "distance", closeness(F.col("distance")).alias("closeness")).orderBy(F.desc("score"), "kb", "chunk_id")


def search_summary(hits: DataFrame) -> DataFrame:
    """One row: hits of each leg, the best distance, and whether the semantic side is weak throughout."""
    return hits.agg(F.count("*").alias("results"), F.count("bm25_rank").alias("bm25_hits"), F.count("vector_rank").alias("vector_hits"), F.min("distance").alias("best_distance"), F.coalesce(F.min("distance") > RELATED, F.lit(False)).alias("weak_semantic_match"))


def grep(docs: DataFrame, pattern: str, limit: int = 200) -> DataFrame:
    """(path, line, text): matching lines in the order of paths, at most `limit` in all."""
    d = docs.select("path", F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    return d.where(F.col("text").rlike(pattern)).select("path", (F.col("i") + 1).alias("line"), "text").orderBy("path", "line").limit(limit)


def index_changes(files: DataFrame, corpus: DataFrame) -> DataFrame:
    """(path, change): added, changed or deleted, for files(path, hash) of the last run and the present corpus(path, text)."""
    now = corpus.select("path", F.sha1("text").alias("new"))
    d = files.select("path", F.col("hash").alias("old")).join(now, "path", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed")
    return d.select("path", change.alias("change"), F.col("new").alias("hash")).where("change is not null")


def upserted(index: DataFrame, fresh: DataFrame, changes: DataFrame) -> DataFrame:
    """The chunk index with chunks of changed and deleted files replaced by fresh ones."""
    return index.join(changes.select("path"), "path", "left_anti").unionByName(fresh.join(changes.where("change <> 'deleted'").select("path"), "path", "left_semi"))


def backlog(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks without a vector."""
    return chunks.join(vectors.select("kb", "chunk_id"), ["kb", "chunk_id"], "left_anti")
