"""Repairs of articles' frontmatter. A repair gives new versions of the documents that change and leaves the old ones as they
are; run over its own result it changes nothing.

documents(path, raw_text). Empty fields count as missing. Documents without frontmatter, or outside of wiki's folders,
aren't repaired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.functions import text as t
from lexquarry.operators import library, upkeep

# The folders whose name says their articles' category, and the volatility of an article that has none.
CATEGORIES = {"concepts": "concept", "topics": "topic", "references": "reference"}
VOLATILITY = "warm"
_DOCUMENT = r"(?s)\A---\n(.*?)\n---(.*)\z"


def _parted(docs: DataFrame) -> DataFrame:
    """docs of wiki's folders with `block` and `rest`, their frontmatter and what follows it."""
    text = F.regexp_replace("raw_text", r"\r\n?", "\n")
    d = docs.where(F.col("path").rlike("^wiki/[^/]+/.")).select("path", F.explode(F.array(text)).alias("x")).where(F.col("x").rlike(_DOCUMENT))
    return d.select("path", F.regexp_extract("x", _DOCUMENT, 1).alias("block"), F.regexp_extract("x", _DOCUMENT, 2).alias("rest"))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(t.squeezed(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def completed(docs: DataFrame, today: str) -> DataFrame:
    """(path, raw_text, added): articles that lack a category, summary, tags, dates or volatility, with them: category by
    folder, summary from the body, tags by folder, dates from each other, from `verified` or today's. The first two stand
    below the title, the others at the end."""
    d, block = _parted(docs), F.col("block")
    one = lambda name: F.nullif(t.scalar_field(block, name), F.lit("[]"))
    folder = F.split_part("path", F.lit("/"), F.lit(2))
    singular = F.when(F.endswith(folder, F.lit("s")), F.expr("left(split_part(path, '/', 2), length(split_part(path, '/', 2)) - 1)"))
    thesis = F.coalesce(one("type") == "thesis", F.lit(False)) | (folder == "theses")
    has = lambda name: one(name).isNotNull() | (F.coalesce(F.size(t.list_field(block, name)), F.lit(0)) > 0)
    fields = F.struct(
        thesis.alias("thesis"), folder.alias("folder"), F.coalesce(singular, F.lit("wiki")).alias("kind"), *(has(n).alias(f"has_{n}") for n in ("category", "summary", "tags", "created", "updated", "volatility")),
        *(one(n).alias(n) for n in ("created", "updated", "verified")),
    )
    # a generator, so that every field is read once
    d = d.select("path", "block", "rest", F.inline(F.array(fields)))
    created = F.when(~F.col("has_created"), F.coalesce("updated", "verified", F.lit(today)))
    updated = F.when(~F.col("has_updated"), F.coalesce("created", created, "verified", F.lit(today)))
    known = F.coalesce(*(F.when(F.col("folder") == k, v) for k, v in CATEGORIES.items()))
    category = F.when(~F.col("thesis") & ~F.col("has_category"), known)
    summary = F.when(~F.col("has_summary"), _quoted(t.summary("rest")))
    tags = F.when(~F.col("has_tags"), F.concat(F.lit("["), F.when(F.col("thesis"), "thesis").otherwise(F.col("kind")), F.lit("]")))
    line = lambda name, value: F.when(value.isNotNull(), F.struct(F.lit(name).alias("name"), F.concat(F.lit(f"\n{name}: "), value).alias("line")))
    top = F.array_compact(F.array(line("summary", summary), line("category", category)))
    end = F.array_compact(F.array(line("tags", tags), line("created", created), line("updated", updated), line("volatility", F.when(~F.col("has_volatility"), F.lit(VOLATILITY)))))
    d = d.select("path", "block", "rest", top.alias("top"), end.alias("end")).where("size(top) + size(end) > 0")
    # lines of fields that are there but empty give way
    names = F.transform(F.concat("top", "end"), lambda x: x["name"])
    kept = F.filter(F.split("block", "\n", -1), lambda x: ~(x.rlike(r"^\w+:[ \t]*(\[\])?[ \t]*$") & F.array_contains(names, F.substring_index(x, ":", 1))))
    d = d.withColumn("kept", kept)
    after = F.coalesce(F.nullif(F.array_position(F.transform("kept", lambda x: F.startswith(x, F.lit("title:"))), F.lit(True)), F.lit(0)), F.lit(1)).cast("int")
    joined = lambda lines: F.array_join(F.transform(lines, lambda x: x["line"]), "")
    head, tail = F.array_join(F.slice("kept", 1, after), "\n"), F.slice("kept", after + 1, F.size("kept"))
    new = F.concat(head, joined("top"), F.rtrim(F.array_join(F.transform(tail, lambda x: F.concat(F.lit("\n"), x)), ""), F.lit(" \n")), joined("end"))
    return d.select("path", F.concat(F.lit("---\n"), new, F.lit("\n---"), "rest").alias("raw_text"), names.alias("added"))


def with_whole_sources(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(path, raw_text): articles whose list of sources names raw files by less than their path, with the paths.
    files(path, title, aliases) are what references may mean, as in library.resolved_sources."""
    d = _parted(docs).withColumn("sources", t.list_field("block", "sources")).where("size(sources) > 0")
    refs = d.select("path", F.posexplode("sources").alias("i", "ref"))
    found = library.resolved_sources(refs.select("ref"), files).select("ref", F.when(F.startswith("path", F.lit("raw/")), F.col("path")).alias("whole"))
    new = refs.join(found, "ref", "left").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("i", "ref", F.coalesce("whole", "ref").alias("new")))).alias("x"))
    new = new.where("exists(x, y -> y.ref <> y.new)").select("path", F.transform("x", lambda y: y["new"]).alias("new"))
    d = d.join(new, "path")
    return d.select("path", F.concat(F.lit("---\n"), upkeep.replaced_list(F.col("block"), "sources", F.col("new"), plain=True), F.lit("\n---"), "rest").alias("raw_text"))


def next_versions(versions: DataFrame, changed: DataFrame) -> DataFrame:
    """versions(path, version, raw_text) and the next version of each of changed(path, raw_text) whose text is another."""
    latest = versions.groupBy("path").agg(F.max_by(F.struct("version", "raw_text"), "version").alias("l"))
    new = changed.select("path", "raw_text").join(latest, "path", "left").where(~F.col("raw_text").eqNullSafe(F.col("l.raw_text")))
    return versions.select("path", "version", "raw_text").unionByName(new.select("path", (F.coalesce("l.version", F.lit(0)) + 1).cast(versions.schema["version"].dataType).alias("version"), "raw_text"))


def latest_versions(versions: DataFrame) -> DataFrame:
    """(path, raw_text) of each document's highest version."""
    return versions.groupBy("path").agg(F.max_by("raw_text", "version").alias("raw_text"))
