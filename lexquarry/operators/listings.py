"""Listings of a workspace's files and the pages made of them.

A page is rows of lines(page, place, line), in the order of place: however many entries a page has, no task holds it
whole, and it is written by a range partitioning on (page, place). Every page ends up the same on every run of one day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.functions import text as t
from lexquarry.operators import rewriting, rules

# Suffixes that archives lose as a whole, how captions are called, and where site-absolute addresses lead.
ARCHIVES = (".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tar.xz", ".txz", ".tar", ".tex")
CAPTIONS = ("FIGURE", "Figure", "FIG", "Fig", "TABLE", "Table", "SCHEME", "Scheme")
SITE = "https://arxiv.org"
DRAFT_HEAD = 2000
_PLACE = "struct<part:int,key:string>"


def _name(path: Column | str = "path") -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def reports(files: DataFrame) -> DataFrame:
    """(name, kind, status, path, mtime, size) of the radar reports among files(path, text, mtime, size): digests and citation
    gaps, to be shown by name from the last on; pending-review or reviewed by the frontmatter."""
    name = F.regexp_extract("path", "^inbox/radar/([^/]+)$", 1)
    kind = F.array_compact(F.array(F.when(name.rlike(r"-digest.*\.md$"), "digest"), F.when(name.rlike(r"-citation-gaps\.md$"), "citation-gap")))
    d = files.select(name.alias("name"), "path", "text", "mtime", "size", F.explode(kind).alias("kind"))
    return d.select("name", "kind", rules.report_status(F.coalesce("text", F.lit(""))).alias("status"), "path", "mtime", "size")


def drafts(files: DataFrame) -> DataFrame:
    """(name, path, title, mtime, size) of the Markdown files below drafts, the latest first. The title is that of the
    frontmatter, else the first heading, and stands in the first DRAFT_HEAD characters."""
    head = F.substring(F.coalesce("text", F.lit("")), 1, DRAFT_HEAD)
    titled = F.regexp_replace(F.trim(t.found(head, r"(?m)^title:[ \t]*(\S.*)$")), r"""^["'](?=.)|(?<=.)["']$""", "")
    title = F.coalesce(titled, F.trim(t.found(head, r"(?m)^#\s+(.+)$")))
    d = files.where(F.startswith("path", F.lit("drafts/")) & F.endswith("path", F.lit(".md")))
    return d.select(_name().alias("name"), "path", title.alias("title"), "mtime", "size").orderBy(F.desc("mtime"), "path")


def chosen_documents(entries: DataFrame) -> DataFrame:
    """(archive, name): which of entries(archive, ord, name, size) is an archive's document: full.md in any folder, else a
    name that ends so, else the largest Markdown file; the first of several. Archives without one are left out."""
    d = entries.where(F.endswith("name", F.lit(".md")))
    tier = F.when(_name("name") == "full.md", 1).when(F.endswith("name", F.lit("full.md")), 2).otherwise(3)
    rank = F.struct(tier.alias("tier"), F.when(tier == 3, -F.col("size")).otherwise(0).alias("less"), "ord")
    return d.groupBy("archive").agg(F.min_by("name", rank).alias("name"))


def archived(status: Column, path: Column) -> Column:
    return F.coalesce(status == "archived", F.lit(False)) | F.coalesce(F.startswith(path, F.lit("topics/.archive/")), F.lit(False))


def topic_paths(registry: DataFrame, hub: str, home: str = "~") -> DataFrame:
    """(slug, path): where each topic of registry(slug, path, status) lies: its own path, in which `<HUB>` and `HUB` stand for
    the hub and a leading tilde for home; without one its folder among the topics, or among the archived ones."""
    raw, under = F.col("path"), lambda x: F.concat(F.lit(hub.rstrip("/") + "/"), x)
    own = (
        F.when(raw.isin(".", "<HUB>", "HUB"), hub).when(F.startswith(raw, F.lit("<HUB>/")), under(F.substr(raw, F.lit(7)))).when(F.startswith(raw, F.lit("HUB/")), under(F.substr(raw, F.lit(5))))
        .when(raw == "~", home).when(F.startswith(raw, F.lit("~/")), F.concat(F.lit(home.rstrip("/") + "/"), F.substr(raw, F.lit(3)))).when(F.startswith(raw, F.lit("/")), raw).otherwise(under(raw))
    )
    usual = F.concat(F.when(F.col("status") == "archived", "topics/.archive/").otherwise("topics/"), "slug")
    return registry.select("slug", F.when(F.coalesce(raw, F.lit("")) != "", own).otherwise(under(usual)).alias("path"))


def free_names(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """(ord, path, given): paths as they can be written without overwriting: as wanted(ord, path) says if free, else the first
    free sibling `name-2`, `name-3` and so on; several that want one path get siblings in their order. existing(path)."""
    from pyspark.sql import Window

    extension = F.regexp_extract("path", r"[^/.][^/]*?(\.[^./]*)$", 1)
    parts = lambda d: d.withColumn("extension", extension).withColumn("stem", F.substr("path", F.lit(1), F.length("path") - F.length("extension")))
    w = parts(wanted).withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("ord")))
    e = parts(existing.select("path").distinct())
    # what a file takes of its own name, and of the name that it is a numbered sibling of
    numbered = e.where(F.col("stem").rlike(r"-([2-9]|[1-9][0-9]+)$")).select(F.regexp_replace("stem", "-[0-9]+$", "").alias("stem"), "extension", F.regexp_extract("stem", "([0-9]+)$", 1).cast("int").alias("number"))
    taken = e.select("stem", "extension", F.lit(1).alias("number")).unionByName(numbered).join(w.select("stem", "extension").distinct(), ["stem", "extension"], "left_semi")
    # sorted, the i-th taken number leaves number - i free ones below it
    taken = taken.groupBy("stem", "extension").agg(F.array_sort(F.collect_set("number")).alias("numbers"))
    below = F.coalesce(F.size(F.filter(F.transform("numbers", lambda x, i: x - 1 - i), lambda free: free < F.col("k"))), F.lit(0))
    d = w.join(taken, ["stem", "extension"], "left").withColumn("number", F.col("k") + below)
    return d.select("ord", "path", F.when(F.col("number") == 1, F.col("path")).otherwise(F.concat("stem", F.lit("-"), F.col("number").cast("string"), "extension")).alias("given"))


def cell(c: Column | str) -> Column:
    """A text as a table's cell."""
    return F.replace(t.squeezed(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("\\|"))


def _destination(c: Column) -> Column:
    return F.when(c.rlike(r"[\s)]"), F.concat(F.lit("<"), c, F.lit(">"))).otherwise(c)


def _fixed(page: DataFrame, lines: Sequence[str | Column], part: int) -> DataFrame:
    """The same lines on every page(page, ...), before or after its rows."""
    each = F.posexplode(F.array(*(F.lit(x) if isinstance(x, str) else x for x in lines))).alias("k", "line")
    return page.select("page", each).select("page", F.struct(F.lit(part).alias("part"), F.lpad(F.col("k").cast("string"), 4, "0").alias("key")).cast(_PLACE).alias("place"), "line")


def _row(d: DataFrame, key: str, line: Column) -> DataFrame:
    return d.select("page", F.struct(F.lit(1).alias("part"), F.col(key).alias("key")).cast(_PLACE).alias("place"), line.alias("line"))


def directory_pages(cards: DataFrame, today: str) -> DataFrame:
    """lines of the `_index.md` of every folder of cards(path, title, summary, tags, updated): a row for each file by name."""
    d = cards.where(_name() != "_index.md").select(F.concat(rewriting.folder_of(F.col("path")), F.lit("_index.md")).alias("page"), _name().alias("name"), "title", "summary", "tags", "updated")
    folder = F.regexp_extract("page", "([^/]*)/_index.md$", 1)
    title = F.when(folder.isin("wiki", "raw"), F.initcap(folder)).otherwise(F.initcap(F.translate(folder, "-_", "  ")))
    head = [F.concat(F.lit("# "), title, F.lit(" Index")), "", F.lit(f"Last updated: {today}"), "", "## Contents", "", "| File | Summary | Tags | Updated |", "|------|---------|------|---------|"]
    shown = F.coalesce(F.nullif(t.squeezed("title"), F.lit("")), F.regexp_replace("name", r"\.md$", ""))
    line = F.concat(F.lit("| ["), cell(shown), F.lit("]("), _destination(F.col("name")), F.lit(") | "), cell("summary"), F.lit(" | "), cell(F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ", ")), F.lit(" | "), cell("updated"), F.lit(" |"))
    return _fixed(d.select("page").distinct(), head, 0).unionByName(_row(d, "name", line))


def hub_page(registry: DataFrame, today: str) -> DataFrame:
    """lines of a hub's index of registry(slug, path, status, title, description): active topics by slug, archived ones
    counted. The topic called hub is the hub itself."""
    d = registry.where("slug <> 'hub'").withColumn("page", F.lit("_index.md")).withColumn("gone", archived(F.col("status"), F.col("path")))
    counts = d.agg(F.count_if(~F.col("gone")).cast("string").alias("active"), F.count_if(F.col("gone")).cast("string").alias("archived")).withColumn("page", F.lit("_index.md"))
    head = ["# Hub Index", "", F.lit(f"Last updated: {today}"), "", F.concat(F.lit("- Active topics: "), "active"), F.concat(F.lit("- Archived topics: "), "archived"), "", "| Topic | Title | Description |", "|------|-------|-------------|"]
    shown = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.initcap(F.replace("slug", F.lit("-"), F.lit(" "))))
    path = F.coalesce(F.nullif(F.col("path"), F.lit("")), F.concat(F.lit("topics/"), "slug"))
    line = F.concat(F.lit("| ["), cell("slug"), F.lit("]("), _destination(path), F.lit(") | "), cell(shown), F.lit(" | "), cell("description"), F.lit(" |"))
    return _fixed(counts, head, 0).unionByName(_row(d.where(~F.col("gone")), "slug", line))


def coverage_page(unreferenced: DataFrame, before: DataFrame, cards: DataFrame, today: str) -> DataFrame:
    """lines of the page that lists raw sources no article refers to: unreferenced(path), and those it listed before(path),
    with what cards(path, title, summary, tags) say of them; none without such sources."""
    page = "wiki/references/uncompiled-source-coverage.md"
    d = unreferenced.select("path").union(before.select("path")).where(F.startswith("path", F.lit("raw/"))).distinct().join(cards, "path", "left").withColumn("page", F.lit(page))
    head = ["---", 'title: "Uncompiled Source Coverage"', "category: reference", F.lit(f"created: {today}"), F.lit(f"updated: {today}"), "tags: [coverage, backlog]", "exclude_structure_check: true", "sources:"]
    middle = ["---", "", "# Uncompiled Source Coverage", "", "| Source | Path | Summary | Tags |", "|--------|------|-------------|------|"]
    pages = d.select("page").distinct()
    listed = _row(d, "path", F.concat(F.lit("  - "), "path"))
    stem = F.regexp_replace(_name(), r"\.md$", "")
    line = F.concat(F.lit("| ["), cell(F.coalesce(F.nullif(F.col("title"), F.lit("")), stem)), F.lit("]("), _destination(F.concat(F.lit("../../"), "path")), F.lit(") | `"), "path", F.lit("` | "), cell("summary"), F.lit(" | "), cell(F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ", ")), F.lit(" |"))
    rows = _row(d, "path", line).withColumn("place", F.col("place").withField("part", F.lit(3)))
    return _fixed(pages, head, 0).unionByName(listed).unionByName(_fixed(pages, middle, 2)).unionByName(rows)


def gap_page(found: DataFrame, today: str) -> DataFrame:
    """lines of a citation-gap report of found(id, title, year, own_paper, shared_refs, shared_titles, abstract), the most
    shared references first; none if nothing was found."""
    page = f"inbox/radar/{today}-citation-gaps.md"
    d = found.withColumn("page", F.lit(page))
    counts = d.groupBy("page").agg(F.count("*").cast("string").alias("many"))
    head = ["---", F.lit(f'title: "Citation gaps {today}"'), "type: citation-gap-report", "status: pending-review", F.concat(F.lit("candidates: "), "many"), "---", "", F.lit(f"# Citation gaps {today}"), ""]
    tick = F.replace(F.coalesce("id", F.lit("")), F.lit("`"), F.lit("'"))
    title = F.coalesce(F.nullif(t.squeezed(F.coalesce("title", F.lit(""))), F.lit("")), F.lit("(untitled)"))
    own = F.array_compact(F.array(
        F.concat(F.lit("## "), title), F.lit(""), F.concat(F.lit("- id: `"), tick, F.lit("` · "), F.coalesce(F.col("year").cast("string"), F.lit("?")), F.lit(" · source: citation-gap")),
        F.concat(F.lit("- should arguably cite: our arXiv:"), "own_paper"), F.concat(F.lit("- shared refs: "), F.col("shared_refs").cast("string")),
        F.when(F.size("shared_titles") > 0, F.concat(F.lit("- shared references include: "), F.array_join("shared_titles", "; "))), F.when(t.squeezed("abstract") != "", F.concat(F.lit("- abstract: "), t.ellipsized(t.squeezed("abstract"), 400))), F.lit(""),
    ))
    # by falling number of references, then id; the lines of one candidate in their order
    key = F.concat(F.lpad((F.lit(10**9) - F.col("shared_refs")).cast("string"), 10, "0"), F.lit(" "), tick, F.lit(" "), F.lpad(F.col("k").cast("string"), 2, "0"))
    rows = d.select("page", "id", "shared_refs", F.posexplode(own).alias("k", "line"))
    return _fixed(counts, head, 0).unionByName(rows.select("page", F.struct(F.lit(1).alias("part"), key.alias("key")).cast(_PLACE).alias("place"), "line"))


def write_pages(lines: DataFrame, folder: str) -> None:
    """Text files of the lines, each page's in their order: a page that many tasks write is many files, in order by name."""
    lines.repartitionByRange("page", "place").sortWithinPartitions("page", "place").select("page", "line").write.mode("overwrite").partitionBy("page").text(folder)


def harvest(fresh: DataFrame, folder: str, today: str) -> None:
    """Appends fresh(id, source, ...) to the ledger of seen ids, and only then to the log of candidates: if the second write
    fails, a candidate is lost to the log but never offered again. Both read one copy of fresh."""
    from lexquarry.operators.similarity import _kept

    rows = _kept(fresh)
    rows.select("id", F.lit(today).alias("first_seen"), "source").write.mode("append").json(f"{folder}/seen")
    rows.write.mode("append").json(f"{folder}/candidates")


def alias_pattern(aliases: Sequence[str]) -> str:
    """A pattern that finds any of some names, whatever the case: where a name begins or ends with an ASCII letter, digit or
    underscore, a word must begin or end there too; CJK names stand within runs of letters."""

    def one(name: str) -> str:
        edge = lambda c: r"\b" if c.isascii() and (c.isalnum() or c == "_") else ""
        return edge(name[0]) + "".join("\\" + c if c.isascii() and not c.isalnum() else c for c in name) + edge(name[-1])

    return "(?i)(?:" + "|".join(one(a) for a in aliases if a) + ")"


def caption_label(c: Column | str) -> Column:
    """`Figure 5` or `Table 2` for a text that is a caption, null for one that only refers to it: a label alone, in capitals,
    before one of `.:|`, or before a title with a capital."""
    x = F.col(c) if isinstance(c, str) else c
    whole = r"(?s)^\s*(" + "|".join(CAPTIONS) + r")\b\.?\s*([0-9]+)(?![0-9])\s*(.*)$"
    prefix, number, rest = (F.regexp_extract(x, whole, k) for k in (1, 2, 3))
    caption = (rest == "") | (prefix == F.upper(prefix)) | rest.rlike(r"^[.:|]") | rest.rlike(r"^\p{Lu}")
    return F.when(x.rlike(whole) & caption, F.concat(F.initcap(prefix), F.lit(" "), number))


def figure_slug(c: Column) -> Column:
    return F.replace(c, F.lit("/"), F.lit("-"))


def archive_slug(c: Column) -> Column:
    """A file name without the whole suffix of an archive, or without its extension."""
    suffix = F.coalesce(*(F.when(F.endswith(F.lower(c), F.lit(s)), F.lit(len(s))) for s in ARCHIVES), F.length(F.regexp_extract(c, r"[^.](\.[^.]*)$", 1)))
    return F.substr(c, F.lit(1), F.length(c) - suffix)


def with_site(docs: DataFrame, site: str = SITE) -> DataFrame:
    """docs(path, text) with images of site-absolute addresses pointing to the site; the documents that change."""
    d = rewriting.movable_images(docs).where(F.startswith("target", F.lit("/")))
    return rewriting.rewritten_images(docs, d.select("path", "target", F.concat(F.lit(site), "target").alias("name")), prefix="")


def pages_of(spark: SparkSession, folder: str) -> DataFrame:
    """(page, line) of pages written by write_pages."""
    return spark.read.text(folder).select(F.col("page"), F.col("value").alias("line"))

