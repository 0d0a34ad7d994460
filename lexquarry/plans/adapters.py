"""The test tables as inputs of the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.functions import text as t
from lexquarry.operators import graph
from lexquarry.sources import tables


#: Tables whose texts are work for many tasks however few bytes they have.
TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, name)
    return tables.spread(rows) if name in TEXTS else rows


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: a language is a kb, a source a collection."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("lang").alias("kb"), F.col("doc_id").alias("chunk_id"), F.concat(F.lit("raw/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("source").alias("collection"), F.lit("").alias("heading"), F.coalesce("text", F.lit("")).alias("content"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as the vectors of the chunks with the same number, in three kbs by label."""
    d = table(spark, sf_dir, "embeddings")
    return d.select(F.concat(F.lit("kb"), F.pmod("label", F.lit(3)).cast("string")).alias("kb"), F.col("vec_id").alias("chunk_id"), "embedding", "label")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as cards: links are the texts of local anchors, tags the language and the quarter of the page's number."""
    p = table(spark, sf_dir, "pages").where("html is not null")
    folder = F.element_at(F.array(*map(F.lit, ("concepts", "references", "topics"))), (F.pmod("page_id", F.lit(3)) + 1).cast("int"))
    path = F.concat(F.lit("wiki/"), folder, F.lit("/p"), F.col("page_id").cast("string"), F.lit(".md"))
    lang = F.regexp_extract("html", r'lang="([a-z]+)"', 1)
    alias = F.regexp_extract("url", r"//([a-z]+)", 1)
    none = F.lit("")
    return p.select(path.alias("path"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), graph.node_type(path, F.lit(None).cast("string")).alias("type"), lang.alias("category"), none.alias("summary"), none.alias("created"), none.alias("updated"), F.array(lang, F.concat(F.lit("q"), F.pmod("page_id", F.lit(4)).cast("string"))).alias("tags"), F.array(alias).alias("aliases"), F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), 1).alias("links"))


def web_graph(spark: SparkSession, sf_dir: str) -> graph.Graph:
    return graph.build(cards(spark, sf_dir))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items as claims of pages; every third is verified."""
    b = table(spark, sf_dir, "benchmark")
    node = F.concat(F.lit("wiki/concepts/p"), (F.col("item_id") * 3).cast("string"))
    return b.select(t.claim_id(node, "text").alias("id"), node.alias("doc_id"), "text", F.when(F.col("item_id") % 3 == 0, "verified").otherwise("unverified").alias("status"), F.when(F.col("item_id") % 2 == 0, "local_wiki").otherwise("web").alias("source_type"), F.concat(F.lit("wiki/topics/p"), F.col("item_id").cast("string"), F.lit(".md")).alias("source"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an ingest log of one batch a user: signups enqueue, views create items, purchases approve, clicks reject,
    errors take back."""
    e = table(spark, sf_dir, "events")
    is_ = lambda *k: F.col("event_type").isin(*k)
    slot = (F.col("event_id") % 20).cast("string")
    kind = F.when(is_("signup"), "enqueue").when(is_("view"), "item").when(is_("purchase", "error"), "decision").otherwise("commit")
    user = F.col("user_id").cast("string")
    text = lambda c: F.when(c, slot)
    return e.select(F.col("event_id").alias("offset"), kind.alias("kind"), F.col("ts").alias("at"), F.concat_ws("-", user, slot).alias("req_id"), F.concat(F.lit("b"), user).alias("batch_id"), F.concat(F.lit("i"), slot).alias("item_id"), F.lit("url").alias("source_type"), F.col("props").alias("source_value"), F.element_at(F.array(*map(F.lit, ("arxiv-html", "tex", "textlayer", "mineru", "ocr"))), (F.col("event_id") % 5 + 1).cast("int")).alias("route"), F.lit(None).cast("string").alias("retry_of"), text(is_("view")).alias("title"), F.lit("staged").alias("status"), F.when(F.col("value") > 90, "late").alias("error"), F.when(is_("purchase"), F.when(F.col("event_id") % 2 == 0, "approve").otherwise("reject")).when(is_("error"), "reset").alias("decision"), F.when(kind == "commit", F.concat(F.lit("wiki/"), slot)).alias("committed_path"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as literature candidates: customers are papers, priorities are sources."""
    o = table(spark, sf_dir, "orders")
    source = F.when(F.col("o_orderpriority").startswith("1"), "arxiv-new:cs").when(F.col("o_orderpriority").startswith("2"), "arxiv-new:math").otherwise("s2-recommendation")
    return o.select(F.concat(F.lit("c"), (F.col("o_orderkey") % 5000).cast("string")).alias("id"), F.concat(F.lit("x"), F.col("o_custkey").cast("string")).alias("arxiv_id"), F.lit(None).cast("string").alias("doi"), F.col("o_orderstatus").alias("title"), F.year("o_orderdate").alias("year"), F.lit("").alias("abstract"), F.lit("").alias("url"), source.alias("source"), F.when(F.col("o_orderkey") % 7 != 0, F.round(F.col("o_totalprice") / 1000000, 4)).alias("score"), F.when(source == "s2-recommendation", 0).otherwise(1).alias("source_ord"), F.col("o_orderkey").alias("ord"))


def folder(spark: SparkSession) -> str:
    """A new folder where executors share one; in local mode without one, a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared or tempfile.mkdtemp()}/store-{uuid.uuid4().hex}"
