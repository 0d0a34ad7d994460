"""Staged records of logs and services as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.functions import text as t

EVENTS = "kind string, at timestamp, req_id string, batch_id string, item_id string, source_type string, source_value string, route string, retry_of string, title string, status string, error string, decision string, committed_path string"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank lines and lines that aren't whole objects are left out."""
    return parsed_lines(spark.read.text(path), schema)


def parsed_lines(lines: DataFrame, schema: str) -> DataFrame:
    d = lines.select(F.trim("value").alias("value")).where("value <> ''")
    bad = F.from_json("value", schema + ", __bad string", {"columnNameOfCorruptRecord": "__bad"})
    return d.select(bad.alias("r")).where("r is not null and r.__bad is null").select("r.*").drop("__bad")


def seen_ids(ledger: DataFrame) -> DataFrame:
    return ledger.where("id is not null and id <> ''").select("id").distinct()


def recommendations(raw: DataFrame, source_ord: int = 0) -> DataFrame:
    """Candidates from recommended papers raw(ord, paper struct<paperId, title, year, abstract, url, externalIds struct
    <ArXiv, DOI>, authors array<struct<name>>>): no title, or nothing to know them by, and they go."""
    p = raw.select("ord", "paper.*")
    d = p.where("trim(coalesce(title, '')) <> ''").where("not (year is null and abstract is null and externalIds.ArXiv is null and externalIds.DOI is null)")
    return d.select(F.coalesce("externalIds.ArXiv", "externalIds.DOI", "paperId").alias("id"), F.col("externalIds.ArXiv").alias("arxiv_id"), F.col("externalIds.DOI").alias("doi"), t.squeezed("title").alias("title"), "year", F.substring(t.squeezed(F.coalesce("abstract", F.lit(""))), 1, 1500).alias("abstract"), "url", F.lit("s2-recommendation").alias("source"), F.transform("authors", lambda a: a["name"]).alias("authors"), F.lit(None).cast("date").alias("published"), F.lit(source_ord).alias("source_ord"), "ord")


def feed_entries(feeds: DataFrame, since: str, category: str, source_ord: int = 1) -> DataFrame:
    """Candidates from Atom feeds(ord, xml): entries with id, title and date, not older than `since`."""
    d = feeds.select(F.col("ord").alias("feed"), F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<entry>(.*?)</entry>"), 1)).alias("n", "e"))
    tag = lambda n: t.squeezed(t.found("e", rf"(?s)<{n}[^>]*>(.*?)</{n}>"))
    d = d.select("feed", "n", t.arxiv_id(tag("id")).alias("arxiv_id"), tag("title").alias("title"), tag("summary").alias("abstract"), F.try_to_timestamp(tag("published")).alias("at"), F.transform(F.regexp_extract_all("e", F.lit(r"(?s)<author>.*?<name>(.*?)</name>"), 1), t.squeezed).alias("authors"))
    d = d.where("arxiv_id is not null and title is not null and at is not null").where(F.col("at") >= F.lit(since).cast("timestamp"))
    return d.select(F.col("arxiv_id").alias("id"), "arxiv_id", F.lit(None).cast("string").alias("doi"), "title", F.year("at").alias("year"), F.substring("abstract", 1, 1500).alias("abstract"), t.abs_url("arxiv_id").alias("url"), F.lit(f"arxiv-new:{category}").alias("source"), "authors", F.to_date("at").alias("published"), F.lit(source_ord).alias("source_ord"), F.struct("feed", "n").cast("string").alias("ord"))


def batch_lookup(requests: DataFrame) -> DataFrame:
    """(doi, paper): requests and their answers matched by position, null answers dropped. requests(dois, papers)."""
    return requests.select(F.explode(F.arrays_zip("dois", "papers")).alias("z")).select(F.col("z.dois").alias("doi"), F.col("z.papers").alias("paper")).where("paper is not null")


def accepted_page(pages: DataFrame, least: int = 20_000) -> DataFrame:
    """(url, ok, reason): is the served HTML a paper? pages(url, final_url, html); no HTML is too short."""
    reason = F.when(F.col("final_url").contains("/abs/"), "redirected to the abstract").when(F.coalesce(F.octet_length("html"), F.lit(0)) < least, "too short").when(~F.col("html").contains("alttext"), "no formulas")
    return pages.select("url", reason.isNull().alias("ok"), reason.alias("reason"))


def main_tex(files: DataFrame) -> DataFrame:
    """(bundle, path): the main file of each LaTeX bundle by an additive score. files(bundle, slug, path, text)."""
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.tex)?$", 1)
    used = files.select("bundle", F.explode(F.regexp_extract_all("text", F.lit(r"\\(?:input|include|subfile)\s*\{([^}]+)\}"), 1)).alias("i"))
    used = used.select("bundle", F.regexp_extract("i", r"([^/]*?)(?:\.tex)?$", 1).alias("stem")).distinct().withColumn("included", F.lit(True))
    d = files.withColumn("stem", stem).join(used, ["bundle", "stem"], "left")
    depth = F.size(F.split("path", "/")) - 1
    low = F.lower("stem")
    score = (
        F.when(F.col("included"), -100).otherwise(0) + F.when(F.col("text").contains("\\begin{document}"), 50).otherwise(0) + F.when(F.col("stem") == F.col("slug"), 30).otherwise(0)
        + F.when(low.rlike("^(main|paper|ms|article|manuscript)"), 20).otherwise(0) - F.when(low.rlike("supp|appendix|response|cover"), 40).otherwise(0) - F.when(F.col("text").contains("{standalone}"), 60).otherwise(0) - 5 * depth
    )
    best = d.groupBy("bundle").agg(F.min_by("path", F.struct((-score).alias("s"), depth.alias("d"), F.length("path").alias("l"), "path")).alias("path"))
    return best


def text_layer(pages: DataFrame) -> DataFrame:
    """(pdf, usable, reason): pages(pdf, chars, image_share, text); thresholds on the sampled pages' means."""
    cid = (F.length("text") - F.length(F.regexp_replace("text", r"\(cid:[0-9]+\)", ""))) / F.greatest(F.length("text"), F.lit(1))
    odd = F.length(F.regexp_replace("text", r"[\p{Print}\p{L}\s]", "")) / F.greatest(F.length("text"), F.lit(1))
    d = pages.groupBy("pdf").agg(F.avg("chars").alias("chars"), F.avg((F.col("image_share") >= 0.95).cast("int")).alias("scanned"), F.avg(cid).alias("cid"), F.avg(1 - odd).alias("printable"))
    reason = F.when(F.col("chars") < 200, "too little text").when(F.col("scanned") > 0.5, "scanned pages").when(F.col("cid") > 0.5, "unmapped glyphs").when(F.col("printable") < 0.7, "unprintable text")
    return d.select("pdf", reason.isNull().alias("usable"), reason.alias("reason"))


def assembled(pages: DataFrame) -> DataFrame:
    """(doc, text): pages(doc, name, text) in the order of their numbers, unnumbered last, then by name."""
    d = pages.select("doc", F.struct(t.page_number("name").alias("n"), F.lower("name").alias("k"), "text").alias("p"))
    return d.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]), "\n\n").alias("text"))
