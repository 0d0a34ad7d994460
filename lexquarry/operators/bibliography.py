"""Bibliographic libraries stored as entity, attribute and value, and citation export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions import text as t

FIELDS = ("title", "DOI", "url", "extra", "archiveID", "date")
HIDDEN = ("attachment", "note", "annotation")


def items(item: DataFrame, types: DataFrame, data: DataFrame, fields: DataFrame, values: DataFrame) -> DataFrame:
    """One wide row an item, sorted by title: the last value of a field wins; attachments and notes are left out."""
    kinds = item.join(F.broadcast(types), "itemTypeID").where(~F.col("typeName").isin(*HIDDEN)).select(F.col("itemID").alias("item_id"), "key", F.col("typeName").alias("item_type"), "dateAdded")
    f = data.join(F.broadcast(fields.where(F.col("fieldName").isin(*FIELDS))), "fieldID").join(values, "valueID")
    wide = f.groupBy(F.col("itemID").alias("item_id")).pivot("fieldName", list(FIELDS)).agg(F.max_by("value", "valueID"))
    d = kinds.join(wide, "item_id", "left")
    return d.select("item_id", "key", "item_type", "title", F.col("DOI").alias("doi"), "url", "extra", F.col("archiveID").alias("archive_id"), "date", "dateAdded").orderBy(F.lower("title"), "item_id")


def in_collection(found: DataFrame, members: DataFrame, collections: DataFrame, name: str) -> DataFrame:
    ids = members.join(collections.where(F.col("collectionName") == name), "collectionID").select(F.col("itemID").alias("item_id"))
    return found.join(ids, "item_id", "left_semi")


def collection_sizes(collections: DataFrame, members: DataFrame) -> DataFrame:
    n = members.groupBy("collectionID").agg(F.count("*").alias("items"))
    return collections.join(n, "collectionID", "left").select("collectionID", "collectionName", "parentCollectionID", F.coalesce("items", F.lit(0)).alias("items")).orderBy("collectionName", "collectionID")


def attachments(rows: DataFrame) -> DataFrame:
    """(item_id, pdf_path): the first stored PDF of each parent."""
    name = F.regexp_replace("path", "^storage:", "")
    d = rows.where("path like 'storage:%' and (contentType is null or contentType in ('', 'application/pdf'))").withColumn("name", name).where("name not in ('', 'undefined')")
    w = Window.partitionBy("parentItemID").orderBy("itemID")
    return d.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("parentItemID").alias("item_id"), F.col("name").alias("pdf_path"))


def identified(found: DataFrame) -> DataFrame:
    """With arxiv_id (from the archive's id, extra, url, DOI in that order) and the normalised DOI."""
    a = F.coalesce(t.arxiv_id("archive_id"), t.arxiv_id("extra"), F.when(F.col("url").contains("arxiv"), t.arxiv_id("url")), t.arxiv_in_doi("doi"))
    return found.withColumn("arxiv_id", a).withColumn("doi", t.doi("doi"))


def coverage(found: DataFrame) -> DataFrame:
    """One row of conditional counts in a single pass."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    a, d = F.col("arxiv_id").isNotNull(), F.col("doi").isNotNull()
    return found.agg(F.count("*").alias("total"), one(a).alias("arxiv"), one(d).alias("doi"), one(~a & d).alias("doi_only"), one(~a & ~d).alias("neither"), one(F.col("pdf_path").isNotNull()).alias("pdf"), one(~a & ~d & F.col("pdf_path").isNotNull()).alias("pdf_only"))


def describe(item: DataFrame, collections: DataFrame) -> DataFrame:
    return item.agg(F.count("*").alias("items"), F.max("dateAdded").alias("last_added")).crossJoin(collections.agg(F.count("*").alias("collections")))


def bibtex(found: DataFrame) -> DataFrame:
    """(item_id, entry): articles if there is a venue, else misc; the key is the first author's last name and the year."""
    who = t.authors("authors")
    last = F.regexp_extract(F.coalesce(F.get(who, F.lit(0)), F.lit("anon")), r"(\S+)$", 1)
    year = F.coalesce(t.found("date", r"\b((?:19|20)[0-9]{2})\b"), F.lit(""))
    safe = lambda c: F.regexp_replace(c, r"([{}])", r"\\$1")
    kind = F.when(F.coalesce("venue", F.lit("")) != "", "article").otherwise("misc")
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"  {name} = {{"), safe(c), F.lit("}")))
    fields = F.concat_ws(",\n", line("title", F.col("title")), line("author", F.array_join(who, " and ")), line("year", year), line("journal", F.col("venue")), line("doi", F.col("doi")), line("eprint", F.col("arxiv_id")))
    return found.select("item_id", F.concat(F.lit("@"), kind, F.lit("{"), F.lower(F.regexp_replace(last, r"[^\p{L}\p{N}]", "")), year, F.lit(",\n"), fields, F.lit("\n}")).alias("entry"))
