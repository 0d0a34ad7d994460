"""Health and statistics of a workspace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.functions import text as t


def core_health(freshness: Column, backlog: Column, claims: Column) -> Column:
    return F.round(0.55 * freshness + 0.25 * backlog + 0.20 * claims, 3)


def retrieval_health(freshness: Column, coverage: Column) -> Column:
    return F.round(0.7 * freshness + 0.3 * coverage, 3)


def freshness(artifact: Column, newest_source: Column) -> Column:
    """1 if the artifact is as new as its sources, else 0.3; 0 without an artifact."""
    return F.when(artifact.isNull(), 0.0).when(newest_source.isNull() | (artifact >= newest_source), 1.0).otherwise(0.3)


def sync_ratio(scores: DataFrame) -> DataFrame:
    """The mean of scores(weight, score) weighted over those that have a score; null if none has."""
    ok = F.col("score").isNotNull()
    return scores.agg(F.round(F.sum(F.when(ok, F.col("weight") * F.col("score"))) / F.sum(F.when(ok, F.col("weight"))), 3).alias("sync_ratio"))


def overdue(age_days: Column, window_days: Column) -> Column:
    return age_days > 2 * F.greatest(window_days, F.lit(1))


def tree(files: DataFrame) -> DataFrame:
    """(directory, files, newest): files(path, mtime) by the first directory."""
    return files.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("directory")).agg(F.count("*").alias("files"), F.max("mtime").alias("newest"))


def vector_coverage(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    v = vectors.select("kb", "chunk_id", F.lit(1).alias("has"))
    return chunks.join(v, ["kb", "chunk_id"], "left").groupBy("kb").agg(F.count("*").alias("chunks"), F.count("has").alias("vectors"), F.round(F.count("has") / F.count("*"), 4).alias("coverage"))


def summary(docs: DataFrame) -> DataFrame:
    """(directory, files, without_sources, links_per_file): docs(path, text, sources)."""
    d = docs.select(F.split_part("path", F.lit("/"), F.lit(2)).alias("directory"), F.size(t.wikilinks("text")).alias("n"), (F.coalesce(F.size("sources"), F.lit(0)) <= 0).alias("bare"))
    return d.groupBy("directory").agg(F.count("*").alias("files"), F.sum(F.col("bare").cast("int")).alias("without_sources"), F.round(F.avg("n"), 2).alias("links_per_file"))


def concept_density(docs: DataFrame) -> DataFrame:
    """(path, words, links, per_1000): wikilinks for 1,000 words outside of math and environments."""
    plain = F.regexp_replace(t.prose("text"), r"(?s)\\begin\{(\w+\*?)\}.*?\\end\{\1\}", " ")
    d = docs.select("path", t.word_count(plain).alias("words"), F.size(t.wikilinks(plain)).alias("links"))
    return d.withColumn("per_1000", F.when(F.col("words") > 0, F.round(1000 * F.col("links") / F.col("words"), 2)))


def inverted(items: DataFrame, key: str, member: str) -> DataFrame:
    """(key, count, members): most frequent first, ties by key; members sorted."""
    d = items.select(F.col(key).alias("key"), F.col(member).alias("m")).distinct().groupBy("key")
    return d.agg(F.count("*").alias("count"), F.array_sort(F.collect_list("m")).alias("members")).orderBy(F.desc("count"), "key")


def document_map(docs: DataFrame) -> DataFrame:
    """(path, lines, sections, display_math, inline_math)."""
    body = F.regexp_replace("text", r"(?ms)^```.*?^```", "")
    rest = F.regexp_replace(body, r"(?s)\$\$.*?\$\$", "")
    return docs.select("path", F.size(F.split("text", "\n", -1)).alias("lines"), F.regexp_count(body, F.lit(r"(?m)^#{1,6} ")).alias("sections"), F.regexp_count(body, F.lit(r"(?s)\$\$.*?\$\$")).alias("display_math"), F.regexp_count(rest, F.lit(r"\$[^$\n]+\$")).alias("inline_math"))


def task_counts(tasks: DataFrame) -> DataFrame:
    """One row: ready, in_progress, blocked and open tasks; a task may count in several. tasks(status, blocked_by)."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    blocked, open_ = F.coalesce(F.col("blocked_by"), F.lit(0)) > 0, F.col("status") != "closed"
    return tasks.agg(one((F.col("status") == "open") & ~blocked).alias("ready"), one(F.col("status") == "in_progress").alias("in_progress"), one(blocked & open_).alias("blocked"), one(open_).alias("open"))


def hints(state: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(code, text) of the rules (code, SQL condition, SQL text) that hold for a one-row state, in their order."""
    checks = F.array(*(F.when(F.expr(cond), F.struct(F.lit(code).alias("code"), F.expr(text).cast("string").alias("text"))) for code, cond, text in rules))
    return state.select(F.posexplode(F.filter(checks, lambda x: x.isNotNull())).alias("ord", "h")).select("ord", "h.code", "h.text")


def uncompiled(sources: DataFrame, references: DataFrame) -> DataFrame:
    """Raw sources without a reference card: by the card's source path, else by the slug of either file's stem."""
    stem = lambda c: t.slug(F.regexp_extract(c, r"([^/]*?)(?:\.[^.]*)?$", 1), None)
    d = sources.join(references.select(F.col("source").alias("path")).where("path is not null").distinct(), "path", "left_anti")
    names = references.select(F.explode(F.array(stem("source"), stem("path"))).alias("slug")).where("slug is not null").distinct()
    return d.withColumn("slug", stem("path")).join(names, "slug", "left_anti").drop("slug")
