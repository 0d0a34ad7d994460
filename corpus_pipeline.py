"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.llm import bpe, decontaminate, linededup, partenum, quality, shared

#: Near copies share 80 percent of their shingles of five words; op9's own 3 and 90 hold for that query alone.
SHINGLE, PERCENT = 5, 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rest): the other columns in a struct, so that none of theirs is taken for a stage's own."""
    return docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c != "text")).alias("rest"))


def _unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs, from packed rows."""
    return rows.select(*(changed.get(c, F.col("text") if c == "text" else F.col("rest")[c]).alias(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or the classifier go; the classifier is fitted on labelled rows of docs."""
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return _unpacked(quality.judged(_packed(docs), model).where("kept"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines are cut from the texts; documents of which nothing is left go."""
    out = linededup.deduped(_packed(docs)).where("length(text) > 0")
    new = {"n_chars": F.when(F.col("n_removed_lines") > 0, F.char_length("text")).otherwise(F.col("rest")["n_chars"]).cast("long")} if "n_chars" in docs.columns else {}
    return _unpacked(out, docs, **new)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest doc_id (rows that share an id stay or go together)."""
    kept = partenum.joined(docs, n=SHINGLE, percent=PERCENT).where("doc_id <=> component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    return _unpacked(_packed(docs).join(kept, F.expr("doc_id <=> kept_id"), "left_semi"), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, round_trip): the tokens, and whether decoding them gives the text."""
    out = bpe.round_trips(docs)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", bpe_encoding),
]

#: The classifier and the tokenizer have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.cut(docs)
    return docs
