"""Checks of written articles before they are filed: findings(path, code, severity, detail), one code a rule.

documents(path, raw_text) without frontmatter have that one finding. What exists is files(path): the files of the
library; a folder exists if a file lies below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.functions import text as t
from lexquarry.operators import quality, rewriting, structure

# Fields that articles must have, marks and first words of paragraphs that derive instead of claiming, the
# length from which a paragraph must cite, and the areas in which a source named by an absolute path is looked for.
FIELDS = ("title", "created")
MATH_MARKS = ("$$", "\\begin{", "\\int", "\\sum")
DERIVATIONS = ("proof", "substituting", "let", "integrating", "differentiating", "where", "hence", "therefore", "using")
LEAST_CLAIM = 50
AREAS = ("wiki", "raw", "inventory", "datasets")


def _finding(d: DataFrame, code: str, detail: Column) -> DataFrame:
    return quality.findings(d, code, "critical", detail)


def _parsed(docs: DataFrame) -> DataFrame:
    return docs.select("path", t.frontmatter("raw_text").alias("block"), t.body("raw_text").alias("body"))


def _without_frontmatter(d: DataFrame) -> DataFrame:
    return _finding(d.where("block IS NULL"), "no-frontmatter", F.lit(""))


def _missing_fields(d: DataFrame) -> DataFrame:
    lost = F.array_compact(F.array(*(F.when(~F.col("block").rlike(f"(?m)^{f}:"), f) for f in FIELDS)))
    return _finding(d.select("path", F.explode(lost).alias("field")), "missing-field", F.col("field"))


def listed_sources(block: Column) -> Column:
    """The items of the block list `sources`; an inline list has none here."""
    below = t.found(block, r"(?m)^sources:.*((?:\n .*)*)")
    return F.transform(F.regexp_extract_all(below, F.lit("(?m)^  - (.*)$"), 1), lambda x: F.btrim(F.trim(x), F.lit("\"'")))


def _dead_links(d: DataFrame, files: DataFrame, folders: tuple[str, ...]) -> DataFrame:
    """(path, link): wikilinks that no file in folders has the name of, as it stands or with underscores for blanks."""
    links = d.select("path", F.explode(F.array_distinct(t.wikilinks("body"))).alias("link"))
    names = F.array_distinct(F.array("link", F.replace("link", F.lit(" "), F.lit("_"))))
    tried = links.withColumn("name", F.explode(names)).select("path", "link", F.explode(F.array(*(F.concat(F.lit(f + "/"), "name", F.lit(".md")) for f in folders))).alias("file"))
    alive = tried.join(files.select(F.col("path").alias("file")), "file", "left_semi").select("path", "link").distinct()
    return links.join(alive, ["path", "link"], "left_anti")


def thesis(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Theses: fields, the right type, a list of sources, a top-level heading, wikilinks, and a file for each of them."""
    d = _parsed(docs)
    own = d.where("block IS NOT NULL")
    kind = F.btrim(t.scalar_field("block", "type"), F.lit("\"'"))
    out = [
        _without_frontmatter(d), _missing_fields(own), _finding(own.withColumn("kind", kind).where("kind <> 'thesis'"), "wrong-type", F.col("kind")),
        _finding(own.where(F.coalesce(F.size(listed_sources(F.col("block"))), F.lit(0)) == 0), "no-sources", F.lit("")),
        _finding(own.where(~F.col("body").rlike("(?m)^# ")), "no-heading", F.lit("")),
        _finding(own.where(F.size(t.wikilinks("body")) == 0), "no-wikilinks", F.lit("")),
        _finding(_dead_links(own, files, ("wiki/concepts", "wiki/references")), "dangling-wikilink", F.col("link")),
    ]
    return _union(out)


def lost_sources(d: DataFrame, files: DataFrame) -> DataFrame:
    """(path, source): listed sources that aren't addresses and lead to nothing: relative to the library, or, if absolute,
    from one of the AREAS in them on."""
    refs = d.select("path", F.explode(F.array_distinct(listed_sources(F.col("block")))).alias("source")).where("NOT source RLIKE '^https?://'")
    parts = F.split("source", "/")
    tails = F.transform(F.filter(F.transform(parts, lambda x, i: F.when(x.isin(*AREAS), i)), lambda i: i.isNotNull()), lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "/"))
    tried = refs.withColumn("entry", F.explode(F.when(F.startswith("source", F.lit("/")), tails).otherwise(F.array("source")))).withColumn("entry", rewriting.normal_path(F.col("entry")))
    there = structure.entries(files.select(F.lit("").alias("root"), "path")).select(F.col("path").alias("entry"))
    alive = tried.join(there, "entry", "left_semi").select("path", "source").distinct()
    return refs.join(alive, ["path", "source"], "left_anti")


def uncited(body: Column) -> Column:
    """How many paragraphs claim something without a link: comments, headings, tables, quotations, lists, short ones and
    derivations aside."""
    paragraphs = F.transform(F.split(F.regexp_replace(body, r"(?s)<!--.*?-->", ""), r"\n\n+"), lambda p: F.regexp_replace(p, r"(?U)\A\s+|\s+\z", ""))

    def claims(p: Column) -> Column:
        word = F.btrim(F.lower(F.regexp_extract(p, r"(?U)^(\S+)", 1)), F.lit(".,:;()"))
        derives = word.isin(*DERIVATIONS)
        for mark in MATH_MARKS:
            derives |= p.contains(mark)
        return (F.length(p) >= LEAST_CLAIM) & ~p.rlike(r"^[#|>]|^[-*] ") & ~derives & ~p.contains("[[") & ~p.contains("](")

    return F.size(F.filter(paragraphs, claims))


def research(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Research reports: fields, sources that exist, and how many paragraphs cite nothing."""
    d = _parsed(docs)
    own = d.where("block IS NOT NULL")
    claims = own.withColumn("n", uncited(F.col("body"))).where("n > 0")
    return _union([_without_frontmatter(d), _missing_fields(own), _finding(lost_sources(own, files), "lost-source", F.col("source")), _finding(claims, "uncited-paragraphs", F.col("n").cast("string"))])


def enrichment(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Enrichment logs: linked concepts without a file, all in one finding."""
    d = _parsed(docs)
    dead = _dead_links(d.where("block IS NOT NULL"), files, ("wiki/concepts",)).groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("link")), ", ").alias("links"))
    return _union([_without_frontmatter(d), _finding(dead, "orphan-concepts", F.col("links"))])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
