"""Rules on where files belong and what they must hold, routes of sources, and reports: findings as in operators.quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions import text as t
from lexquarry.operators import quality

# The areas that are checked, the folder that each kind of file belongs to, the headings that articles must
# have, suffixes and types that decide a source's route, and errors that only follow from an earlier one.
AREAS = ("raw", "wiki", "inventory", "datasets")
FOLDERS = {
    "raw": {"articles": "articles", "papers": "papers", "repos": "repos", "notes": "notes", "data": "data"},
    "wiki": {"concept": "concepts", "topic": "topics", "reference": "references"},
    "inventory": {
        "item": "items", "entity": "entities", "corpus": "corpora", "ingest-candidate": "candidates", "question": "candidates",
        "task": "candidates", "artifact": "candidates", "watch": "candidates",
    },
}
KIND_FIELD = {"raw": "type", "wiki": "category", "inventory": "kind"}
HEADINGS = {"references": ("Key Contributions", "Theoretical Framework"), "concepts": ("Core Definition", "Mathematical Formalism")}
IDENTITY_TYPES, TEXT_SUFFIXES, TEX_SUFFIXES = ("arxiv", "url", "doi"), (".md", ".markdown", ".txt"), (".tex", ".tar.gz", ".tgz")
CASCADES = (
    "missing $ inserted", "display math should end with $$", "bad math environment delimiter", "extra }, or forgotten $", "missing } inserted",
    "allowed only in math mode",
)
SAMPLE_PAGES = 6


def is_checked(path: Column) -> Column:
    """Whether a path is in one of the AREAS and in no folder whose name starts with a dot."""
    return quality.area(path).isin(*AREAS) & ~path.rlike(r"(^|/)\.[^/]*/")


def misplaced(docs: DataFrame) -> DataFrame:
    """Files that their kind puts into another folder (critical), and data sets whose folder isn't their id (warning).

    A file of an unknown kind, or without one, stays where it is, as do views of the inventory.
    """
    d = docs.select("path", F.explode(F.array(t.frontmatter("raw_text"))).alias("block"))
    parts, place, block = F.split("path", "/"), quality.area("path"), F.col("block")
    kind = F.coalesce(*(F.when(place == a, t.scalar_field(block, f)) for a, f in KIND_FIELD.items()))
    thesis = (place == "wiki") & (t.scalar_field(block, "type") == "thesis")
    # a generator, so that the fields are read once and not for each folder
    d = d.select("path", "block", F.inline(F.array(F.struct(F.when(thesis, "thesis").otherwise(kind).alias("kind")))))
    known = F.create_map(*(F.lit(x) for a, kinds in FOLDERS.items() for k, to in kinds.items() for x in (f"{a}/{k}", to)), F.lit("wiki/thesis"), F.lit("theses"))
    views = (place == "inventory") & (F.get(parts, F.lit(1)) == "views")
    folder = F.when(~views, F.try_element_at(known, F.concat(place, F.lit("/"), F.col("kind"))))
    d = d.select("path", "block", F.concat_ws("/", place, folder, F.element_at(parts, -1)).alias("expected"), folder.isNotNull().alias("known"))
    wrong = quality.findings(d.where("known and expected <> path"), "misplaced", "critical", F.col("expected"))
    name = t.scalar_field(F.col("block"), "dataset_id")
    other = d.where(F.col("path").rlike("^datasets/[^/]+/MANIFEST\\.md$")).where(name != F.get(F.split("path", "/"), F.lit(1)))
    return wrong.unionByName(quality.findings(other, "dataset-folder", "warning", name))


def missing_headings(docs: DataFrame) -> DataFrame:
    """References and concepts without one of their second-level headings, whose number doesn't matter."""
    d = docs.select("path", "raw_text", F.regexp_extract("path", "^wiki/([^/]+)/", 1).alias("kind")).where(F.col("kind").isin(*HEADINGS))
    d = d.where(~F.lower(F.coalesce(t.scalar_field(t.frontmatter("raw_text"), "exclude_structure_check"), F.lit(""))).eqNullSafe("true"))
    body = t.body(F.coalesce("raw_text", F.lit("")))
    has = lambda h: body.rlike(r"(?mi)^##\s+[0-9]*\.?\s*" + h.replace(" ", r"\s+"))
    lost = F.array_compact(F.array(*(F.when((F.col("kind") == k) & ~has(h), h) for k, hs in HEADINGS.items() for h in hs)))
    return quality.findings(d.select("path", F.explode(lost).alias("h")), "missing-heading", "critical", F.col("h"))


def provenance(docs: DataFrame, resolved: DataFrame) -> DataFrame:
    """Warnings: articles without sources that aren't compiled from a conversation, sources that aren't a list or lead to no
    file, and markers of retracted sources. resolved(ref, path) as from library.resolved_sources."""
    d = docs.select("path", t.body("raw_text").alias("body"), t.frontmatter("raw_text").alias("block"), quality.area("path").alias("area"))
    listed, single, origin = t.list_field("block", "sources"), t.scalar_field("block", "sources"), t.scalar_field("block", "compiled-from")
    d = d.select("path", "body", "area", listed.alias("refs"), single.alias("single"), F.coalesce(origin.isin("conversation", "mixed"), F.lit(False)).alias("exempt"))
    wiki, some = F.col("area") == "wiki", F.coalesce(F.size("refs"), F.lit(0)) > 0
    none = d.where(wiki & ~some & (F.col("single").isNull() | (F.col("single") == "[]")) & ~F.col("exempt"))
    plain = d.where(wiki & ~some & F.col("single").isNotNull() & (F.col("single") != "[]"))
    refs = d.where(F.col("area").isin("wiki", "inventory") & some).select("path", F.explode("refs").alias("ref")).where("not ref rlike '^https?://'")
    lost = refs.join(resolved.where("path is not null").select("ref"), "ref", "left_anti").distinct()
    out = quality.findings(none, "no-sources", "warning", F.lit("")).unionByName(quality.findings(plain, "sources-no-list", "warning", F.col("single")))
    out = out.unionByName(quality.findings(lost, "lost-source", "warning", F.col("ref")))
    return out.unionByName(quality.findings(d.where(F.contains("body", F.lit("RETRACTED-SOURCE"))), "retracted-source", "warning", F.lit("")))


def first_route(source_type: Column, value: Column, has_text_layer: Column) -> Column:
    """Where a source's conversion starts: arxiv-html, add, tex, textlayer or mineru."""
    ends = lambda suffixes: F.coalesce(F.lower(value).rlike("(?:" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"), F.lit(False))
    return F.when(source_type.isin(*IDENTITY_TYPES), "arxiv-html").when(ends(TEXT_SUFFIXES), "add").when(ends(TEX_SUFFIXES), "tex").when(ends((".pdf",)) & F.coalesce(has_text_layer, F.lit(False)), "textlayer").otherwise("mineru")


def sampled_pages(pages: Column, most: int = SAMPLE_PAGES) -> Column:
    """Page indices from the first to the last, evenly spaced and rounded half to even; all of them if there are few."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (pages - 1) / (most - 1)).cast("int"))
    return F.when(pages <= 0, F.array().cast("array<int>")).when(pages <= most, F.sequence(F.lit(0), F.greatest(pages, F.lit(1)).cast("int") - 1)).otherwise(F.array_distinct(spread))


def report_status(text: Column) -> Column:
    """pending-review if the frontmatter says so, else reviewed."""
    return F.when(F.contains(t.frontmatter(text), F.lit("status: pending-review")), "pending-review").otherwise("reviewed")


def compile_issues(errors: DataFrame, most: int = 15) -> DataFrame:
    """The first `most` of errors(path, ord, line, error, context) a document: no errors that only follow from others, and of
    equal ones the first."""
    own = ~F.lower("error").rlike("|".join(r"\Q" + c + r"\E" for c in CASCADES))
    first = errors.where(own).groupBy("path", "line", "error", "context").agg(F.min("ord").alias("ord"))
    rank = F.row_number().over(Window.partitionBy("path").orderBy("ord"))
    return first.withColumn("r", rank).where(F.col("r") <= most).drop("r")


def not_stubs(cards: DataFrame) -> DataFrame:
    """Cards with a status other than stub; a missing one counts as stub."""
    return cards.where(F.coalesce("status", F.lit("stub")) != "stub")


def split_tasks(tasks: DataFrame, here: str, prefix: str = "topic:") -> DataFrame:
    """tasks(id, title, labels) with `topic` from the first label of that prefix, which the title loses, and `is_here`."""
    topic = F.get(F.filter("labels", lambda x: F.startswith(x, F.lit(prefix))), F.lit(0))
    d = tasks.withColumn("topic", F.nullif(F.substr(topic, F.lit(len(prefix) + 1)), F.lit("")))
    mark = F.concat(F.lit("["), F.col("topic"), F.lit("]"))
    d = d.withColumn("title", F.when(F.startswith("title", mark), F.trim(F.substr("title", F.length(mark) + 1))).otherwise(F.col("title")))
    return d.withColumn("labels", F.filter("labels", lambda x: ~F.startswith(x, F.lit(prefix)))).withColumn("is_here", F.coalesce(F.col("topic") == here, F.lit(False)))


def tasks_here(split: DataFrame) -> DataFrame:
    return split.agg(F.count_if("is_here").alias("here"), F.count_if(~F.col("is_here")).alias("elsewhere"))


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    """How many rows each combination of keys has: imports by route, issues of formulas by file, detector and confidence."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))
