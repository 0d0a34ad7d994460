"""Corpora of Markdown files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.functions import text as t
from lexquarry.operators.graph import directory_type, node_type


def markdown(spark: SparkSession, root: str, folders: tuple[str, ...] = ("wiki", "raw", "drafts"), kb: str = "") -> DataFrame:
    """(kb, path, text, mtime, size) of the `*.md` files below root's folders; index files, backups and hidden folders
    are left out. Files are read whole by the executors."""
    d = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    d = d.select(F.lit(kb).alias("kb"), F.regexp_replace(F.col("_metadata.file_path"), "^.*?" + _quoted(root) + "/?", "").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("size"))
    return d.where(indexed("path") & F.split_part("path", F.lit("/"), F.lit(1)).isin(*folders))


def _quoted(path: str) -> str:
    plain = path.split("://", 1)[-1].rstrip("/")
    return "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in plain)


def indexed(path: str) -> Column:
    """Not an index file, a backup or in a hidden folder."""
    p = F.col(path)
    return ~p.rlike(r"(^|/)_index\.md$") & ~p.rlike(r"(^|/)[^/]*\.backup[^/]*(/|$)") & ~p.rlike(r"(^|/)\.")


def cards(docs: DataFrame) -> DataFrame:
    """docs(path, text) as cards for graph.build: frontmatter fields, and the wikilinks of the body."""
    d = docs.withColumn("block", t.frontmatter("text"))
    field = lambda n: F.coalesce(t.scalar_field(F.col("block"), n), F.lit(""))
    listed = lambda n: F.coalesce(t.list_field(F.col("block"), n), F.array().cast("array<string>"))
    kind = node_type(F.col("path"), t.scalar_field(F.col("block"), "type"))
    category = F.coalesce(t.scalar_field(F.col("block"), "category"), directory_type(F.col("path")), F.lit(""))
    return d.select("path", field("title").alias("title"), kind.alias("type"), category.alias("category"), field("summary").alias("summary"), field("created").alias("created"), field("updated").alias("updated"), listed("tags").alias("tags"), listed("aliases").alias("aliases"), t.wikilinks(t.body("text")).alias("links"))


def claims(docs: DataFrame) -> DataFrame:
    """(id, doc_id, text, status, source_type, source, quote) from the claims comments of docs(path, text)."""
    from lexquarry.operators.claims import parsed

    inside = docs.select("path", F.array_join(F.regexp_extract_all("text", F.lit(r"(?s)<!--\s*\w*:?claims\s*(.*?)-->"), 1), "\n").alias("text")).where("text <> ''")
    node = F.regexp_replace("path", r"\.md$", "")
    return parsed(inside).where("claim is not null").select(t.claim_id(node, "claim").alias("id"), node.alias("doc_id"), F.col("claim").alias("text"), "status", "source_type", "source", F.col("evidence").alias("quote"))


def registry(kbs: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Knowledge bases that are searched together: enabled, not excluded, with an index. kbs(name, path, enabled, has_index)."""
    return kbs.where(F.col("enabled") & F.col("has_index") & ~F.col("name").isin(*exclude))


def topics(registered: DataFrame, on_disk: DataFrame, archived: bool = False) -> DataFrame:
    """(slug, path, status): registered topics and those that are only on disk."""
    extra = on_disk.join(registered.select("slug"), "slug", "left_anti").select("slug", "path", F.lit("unregistered").alias("status"))
    d = registered.select("slug", "path", "status").unionByName(extra)
    return d if archived else d.where(~((F.col("status") == "archived") | F.col("path").like("%topics/.archive/%")))


def archive(topics_: DataFrame, slug: str, reason: str, day: str) -> DataFrame:
    """The registry with one topic archived."""
    on = F.col("slug") == slug
    put = lambda c, v: F.when(on, v).otherwise(F.col(c)).alias(c)
    return topics_.select("slug", put("path", F.concat(F.lit("topics/.archive/"), "slug")), put("status", F.lit("archived")), put("archived", F.lit(day)), put("archive_reason", F.lit(reason)))


def unique_names(wanted: DataFrame) -> DataFrame:
    """(ord, name, given): names as registered; the second of a name gets -2, and so on. wanted(ord, name)."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("name").orderBy("ord"))
    return wanted.select("ord", "name", F.when(n == 1, F.col("name")).otherwise(F.concat_ws("-", "name", n.cast("string"))).alias("given"))
