"""Concepts that grow by additions: each addition goes to the concept that its name means, or founds one.

additions(name, source, content, at) are merged into a store of one row a concept. `at` orders them. Names of one batch
that are alike, but neither the same slug nor alike to a concept that is already there, found concepts of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.functions import text as t
from lexquarry.operators import library
from lexquarry.sources import store

PERSPECTIVES = "array<struct<source:string,content:string>>"
SCHEMA = f"slug string, title string, aliases array<string>, sources array<string>, created string, updated string, perspectives {PERSPECTIVES}, at long"
RULES = {"title": store.first, "aliases": store.united, "sources": store.first, "created": store.smallest, "updated": store.largest, "perspectives": store.united, "at": store.largest}


def concept_store(folder: str, buckets: int = 64) -> store.Store:
    return store.Store(folder, SCHEMA, ("slug",), "at", buckets, RULES)


def changes(additions: DataFrame, known: DataFrame, files: DataFrame, today: str) -> DataFrame:
    """Rows of SCHEMA for additions: known is the store's table, files(path) are what sources may mean. A name goes to the
    first concept by slug with an alike slug, title or alias, and becomes its alias if its slug isn't that of the title;
    additions without a usable name, or from a source that leaves the library, are left out."""
    a = additions.withColumn("own", t.slug("name")).where("own <> ''")
    names = known.select("slug", "title", F.explode(F.array_distinct(F.concat(F.array("slug", "title"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("name"))
    alike = library.similar_names(a.select("name").distinct(), names.select("name").where("name IS NOT NULL").distinct(), every=True)
    meant = alike.join(names, F.col("match") == names["name"]).groupBy(alike["name"]).agg(F.min(F.struct("slug", "title")).alias("to"))
    a = a.join(meant, "name", "left").join(library.concept_sources(a.select(F.col("source").alias("ref")), files).select(F.col("ref").alias("source"), "path"), "source").where("path IS NOT NULL")
    title = F.coalesce("to.title", "name")
    # the title of a concept that the same batch founds comes from its first addition, whose slug is that of all others
    alias = F.when(F.col("own") != t.slug(title), F.array("name")).otherwise(F.array().cast("array<string>"))
    return a.select(
        F.coalesce("to.slug", "own").alias("slug"), title.alias("title"), alias.alias("aliases"), F.array("path").alias("sources"), F.lit(today).alias("created"), F.lit(today).alias("updated"),
        F.array(F.struct("source", "content")).cast(PERSPECTIVES).alias("perspectives"), F.col("at").cast("long").alias("at"),
    )


def page() -> Column:
    """A concept's row as its Markdown page."""
    listed = lambda name: F.concat(F.lit(f"{name}:"), F.when(F.size(name) > 0, F.array_join(F.transform(name, lambda x: F.concat(F.lit("\n  - "), F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - 2))), "")).otherwise(" []"))
    parts = F.transform("perspectives", lambda p: F.concat(F.lit("\n### Perspective from "), p["source"], F.lit("\n"), p["content"], F.lit("\n")))
    head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("title: "), "title"), F.lit("category: concept\nstatus: stub"), F.concat(F.lit("created: "), "created"), F.concat(F.lit("updated: "), "updated"), listed("aliases"), listed("sources"), F.lit("---\n"))
    return F.concat(head, F.lit("\n# "), "title", F.lit("\n\n## 1. Core Definition\n\n## 2. Mathematical Formalism\n\n## 5. Perspectives from Literature\n"), F.array_join(parts, ""))


def to_embed(items: DataFrame, cache: DataFrame) -> DataFrame:
    """The rows of items(name, text) whose text isn't the one that cache(name, md5, ...) has a vector of, with `md5`: what a
    model has to embed before its answers are merged into the cache by name."""
    d = items.withColumn("md5", F.md5("text"))
    return d.join(cache.select("name", "md5").distinct(), ["name", "md5"], "left_anti")
