"""Quality rules over documents. Each rule returns rows of findings(path, code, severity, detail).

documents(path, raw_text) are files; `today` is a parameter wherever age matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.functions import text as t

MIN_WORDS = 100
# Commands that are left over when TeX was not understood, the fields each area requires, and how long an
# article of each volatility stays fresh.
TEX_COMMANDS = (
    "begin", "end", "cite", "ref", "label", "newcommand", "renewcommand", "usepackage", "documentclass", "includegraphics",
    "bibliography", "footnote", "textbf", "textit",
)
REQUIRED = {
    "raw": ("title", "source", "type", "ingested"),
    "wiki": ("title", "category", "created", "updated", "tags", "summary"),
    "inventory": ("title", "kind", "status", "priority", "created", "updated", "tags", "summary"),
    "datasets": ("title", "dataset_id", "status", "storage", "locations", "formats", "schema_status", "created", "updated", "tags", "summary"),
}
VOLATILITY_DAYS = {"hot": 30, "warm": 180, "cold": 365}
# Texts of placeholders and their kinds.
PLACEHOLDERS = ((r"\[STUB: Awaiting synthesis\]", "stub_tag"), (r"No explicit.*", "no_explicit_text"), (r"^\s*\*\s+\*\*(.*?)\*\*\s*:\s*$", "empty_bullet"))
ALLOWED = {
    "raw": {"type": ("articles", "papers", "repos", "notes", "data")},
    "wiki": {"category": ("concept", "topic", "reference"), "confidence": ("high", "medium", "low"), "volatility": ("hot", "warm", "cold")},
    "inventory": {
        "kind": ("item", "ingest-candidate", "entity", "corpus", "question", "task", "artifact", "watch"),
        "status": ("proposed", "active", "blocked", "ingested", "superseded", "archived"), "priority": ("p0", "p1", "p2", "p3", "p4"),
    },
    "datasets": {
        "status": ("proposed", "active", "external", "archived", "unavailable"), "storage": ("local", "remote", "external", "hybrid"),
        "schema_status": ("unknown", "inferred", "declared", "validated"),
    },
}


def findings(df: DataFrame, code: str, severity: str, detail: Column) -> DataFrame:
    return df.select("path", F.lit(code).alias("code"), F.lit(severity).alias("severity"), detail.alias("detail"))


def area(path: Column | str = "path") -> Column:
    return F.split_part(F.col(path) if isinstance(path, str) else path, F.lit("/"), F.lit(1))


def missing_fields(docs: DataFrame) -> DataFrame:
    """A finding for each required field that is missing or empty; tags and summary of raw sources are only warnings."""
    d = docs.where(area().isin(*REQUIRED)).withColumn("block", t.frontmatter("raw_text")).withColumn("area", area())
    fields = F.coalesce(*(F.when(F.col("area") == a, F.array(*map(F.lit, f + (("tags", "summary") if a == "raw" else ())))) for a, f in REQUIRED.items()))
    d = d.select("path", "area", "block", F.explode(fields).alias("field"))
    names = sorted({f for fs in REQUIRED.values() for f in fs} | {"tags", "summary"})
    value = F.coalesce(*(F.when(F.col("field") == n, F.coalesce(t.scalar_field(F.col("block"), n), F.when(F.size(t.list_field(F.col("block"), n)) > 0, "list"))) for n in names))
    d = d.where(F.col("block").isNull() | value.isNull() | (value == "[]"))
    soft = (F.col("area") == "raw") & F.col("field").isin("tags", "summary")
    return d.select("path", F.lit("missing-field").alias("code"), F.when(soft, "warning").otherwise("critical").alias("severity"), F.col("field").alias("detail"))


def bad_enums(docs: DataFrame, allowed: dict[str, dict[str, tuple[str, ...]]] = ALLOWED) -> DataFrame:
    """Fields with a value that their area doesn't allow."""
    d = docs.withColumn("block", t.frontmatter("raw_text"))
    value = lambda n: t.scalar_field(F.col("block"), n)
    checks = [F.when((area() == a) & ~value(n).isin(*v), F.concat_ws("=", F.lit(n), value(n))) for a, fields in allowed.items() for n, v in fields.items()]
    found = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return findings(d.select("path", F.explode(found).alias("x")), "bad-value", "critical", F.col("x"))


def broken_wikilinks(docs: DataFrame) -> DataFrame:
    """Wikilinks to no file: by stem or path, with or without the extension, whatever the case."""
    names = docs.select(F.explode(F.array(F.regexp_extract("path", r"([^/]*?)(?:\.md)?$", 1), F.regexp_replace("path", r"\.md$", ""), "path")).alias("n")).select(t.link_key("n").alias("key")).distinct()
    d = docs.select("path", F.explode(t.wikilinks("raw_text")).alias("link")).withColumn("key", t.link_key("link"))
    return findings(d.join(names, "key", "left_anti").distinct(), "broken-link", "warning", F.col("link"))


def bad_wikilinks(docs: DataFrame) -> DataFrame:
    """Links of wiki documents with characters that file names can't have, or that look like TeX; the first rule counts."""
    d = docs.where(area() == "wiki").select("path", F.explode(t.wikilinks("raw_text")).alias("link"))
    why = F.when(F.col("link").rlike(r"""[\\/:*?"<>|]"""), "illegal character").when(F.col("link").rlike(r"^\$|\$$|[{}]"), "TeX")
    return findings(d.withColumn("why", why).where("why is not null").distinct(), "wikilink-format", "warning", F.concat_ws(": ", "why", "link"))


def dead_markdown_links(docs: DataFrame) -> DataFrame:
    """Local Markdown links to files that aren't there, relative to their document's folder."""
    d = docs.select("path", F.explode(t.markdown_links("raw_text")).alias("link")).where("link rlike '\\\\.md(#.*)?$' and not link rlike '^[a-z]+://'")
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    target = F.concat(folder, F.regexp_replace(F.regexp_replace("link", "#.*$", ""), "%20", " "))
    # a fold over the path's parts; what would lead above the top stays, and is no file's path
    parts = F.aggregate(F.split(target, "/"), F.array().cast("array<string>"), lambda done, x: F.when(x.isin("", "."), done)
        .when((x == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(x))))
    target = F.array_join(parts, "/")
    d = d.withColumn("target", target).join(docs.select(F.col("path").alias("target")), "target", "left_anti")
    return findings(d.distinct(), "dead-link", "critical", F.col("link"))


def index_gaps(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Files that no index lists, and index entries without a file: entries(folder, name), files(folder, name)."""
    path = F.concat_ws("/", "folder", "name").alias("path")
    lost = files.join(entries, ["folder", "name"], "left_anti").select(path)
    dead = entries.join(files, ["folder", "name"], "left_anti").select(path)
    return findings(lost, "stale-index", "warning", F.lit("not listed")).unionByName(findings(dead, "dead-index-entry", "critical", F.lit("no such file")))


def unreferenced(sources: DataFrame, references: DataFrame) -> DataFrame:
    """Raw sources that no article refers to; collection manifests are left out. sources(path, tags), references(source)."""
    d = sources.where(~F.coalesce(F.array_contains("tags", "collection-manifest"), F.lit(False)))
    return findings(d.join(references.select(F.col("source").alias("path")), "path", "left_anti"), "orphan-source", "warning", F.lit("not referenced"))


def stale(docs: DataFrame, today: str) -> DataFrame:
    """Wiki articles without a volatility (info), and those that were verified, else updated, longer ago than it allows.

    An unknown volatility, or no valid date, gives no finding here.
    """
    d = docs.where(area() == "wiki").withColumn("block", t.frontmatter("raw_text"))
    kind = t.scalar_field(F.col("block"), "volatility")
    limit = F.coalesce(*(F.when(kind == k, F.lit(n)) for k, n in VOLATILITY_DAYS.items()))
    day = F.try_to_date(F.substring(F.coalesce(t.scalar_field(F.col("block"), "verified"), t.scalar_field(F.col("block"), "updated")), 1, 10))
    d = d.withColumn("kind", kind).withColumn("limit", limit).withColumn("age", F.datediff(F.lit(today).cast("date"), day))
    none = findings(d.where("kind is null"), "missing-volatility", "info", F.lit("no volatility"))
    return none.unionByName(findings(d.where("age > limit"), "stale-article", "warning", F.col("age").cast("string")))


def similar_tags(tags: DataFrame, groups: list[list[str]]) -> DataFrame:
    """Groups of near-duplicate tags of which the corpus holds more than one: tags(tag)."""
    d = tags.select("tag").distinct().join(F.broadcast(tags.sparkSession.createDataFrame([(i, x) for i, g in enumerate(groups) for x in g], "g int, tag string")), "tag")
    d = d.groupBy("g").agg(F.array_sort(F.collect_set("tag")).alias("t")).where("size(t) > 1")
    return d.select(F.lit("").alias("path"), F.lit("duplicate-tags").alias("code"), F.lit("warning").alias("severity"), F.array_join("t", ", ").alias("detail"))


def leftover_commands(text: Column) -> Column:
    """How many commands with an argument are among TEX_COMMANDS, or of the cite family."""
    names = F.regexp_extract_all(text, F.lit(r"\\([a-zA-Z]+)\s*[\[{]"), 1)
    return F.size(F.filter(names, lambda n: n.isin(*TEX_COMMANDS) | n.rlike("^cite[a-z]*$")))


def conversion_gates(conversions: DataFrame) -> DataFrame:
    """Checks of converted papers in a fixed order: conversions(path, md, payload, tex_source, figures_referenced,
    figures_resolved, expected_arxiv_id)."""
    md, text = F.coalesce("md", F.lit("")), t.body(F.coalesce("md", F.lit("")))
    words = t.word_count(text)
    leftover = F.when(F.contains(text, F.lit("\\")), leftover_commands(t.prose(text))).otherwise(0)
    kinds = F.filter(F.transform(t.image_targets(md), lambda x: t.image_kind(x)), lambda k: ~k.isin("portable", "external"))
    # the paper's own field; what its text cites says nothing
    claimed = t.arxiv_id(t.scalar_field(t.frontmatter(md), "arxiv_id"))
    gate = lambda ok, code, severity, detail: F.when(ok, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail")))
    checks = F.array(
        gate(F.substring("payload", 1, 5) == F.lit(b"%PDF-"), "payload-is-pdf", "block", F.lit("the payload is a PDF")),
        gate(words < MIN_WORDS, "suspiciously-short", "flag", words),
        gate(leftover > 0, "leftover-tex", "flag", leftover),
        gate(F.col("figures_referenced") > F.col("figures_resolved"), "figure-count-mismatch", "flag", F.col("figures_referenced") - F.col("figures_resolved")),
        gate(F.size(kinds) > 0, "image-references", "block", F.array_join(F.slice(kinds, 1, 3), ", ")),
        gate(claimed != t.arxiv_id("expected_arxiv_id"), "wrong-paper", "block", claimed),
        gate(~F.startswith(md, F.lit("---\n")), "no-frontmatter", "flag", F.lit("no frontmatter")),
    )
    d = conversions.select("path", F.posexplode(F.filter(checks, lambda c: c.isNotNull())).alias("ord", "f"))
    return d.select("path", "f.code", "f.severity", "f.detail")


def placeholders(docs: DataFrame) -> DataFrame:
    """(path, line, kind, text): lines with placeholder text; the first pattern that fits counts."""
    d = docs.select("path", F.posexplode(F.split("raw_text", "\n", -1)).alias("i", "text"))
    kind = F.coalesce(*(F.when(F.col("text").rlike(p), k) for p, k in PLACEHOLDERS))
    return d.select("path", (F.col("i") + 1).alias("line"), kind.alias("kind"), "text").where("kind is not null")


def orphan_math(docs: DataFrame) -> DataFrame:
    """Documents with an odd number of lines that are only `$$`."""
    n = F.size(F.filter(F.split("raw_text", "\n", -1), lambda x: F.trim(x) == "$$"))
    return findings(docs.withColumn("n", n).where("n % 2 = 1"), "orphan-math", "warning", F.col("n").cast("string"))


def prose_in_math(docs: DataFrame, least: int = 6) -> DataFrame:
    """Display formulas with a run of `least` or more plain words."""
    d = docs.select("path", F.posexplode(F.regexp_extract_all("raw_text", F.lit(r"(?s)\$\$(.*?)\$\$"), 1)).alias("i", "f"))
    run = F.aggregate(F.filter(F.split("f", r"\s+"), lambda w: w != ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")), lambda a, w: F.struct(F.when(w.rlike("^[A-Za-z]{2,}[,.;]?$"), a["now"] + 1).otherwise(0).alias("now"), F.greatest(a["best"], F.when(w.rlike("^[A-Za-z]{2,}[,.;]?$"), a["now"] + 1).otherwise(0)).alias("best")), lambda a: a["best"])
    return findings(d.withColumn("run", run).where(F.col("run") >= least), "prose-in-math", "warning", F.concat_ws(":", F.col("i").cast("string"), F.col("run").cast("string")))


def formulas(docs: DataFrame) -> DataFrame:
    """(path, kind, line, formula): display and inline formulas outside of fenced code with the line they start in."""
    # fences keep their line ends, so lines still count right
    text = F.regexp_replace("raw_text", r"(?ms)^```.*?^```", "\n")
    blocks = docs.select("path", text.alias("x"))
    d = blocks.select("path", F.posexplode(F.split("x", r"\$\$", -1)).alias("i", "part"), F.split("x", r"\$\$", -1).alias("parts"))
    line = F.expr("1 + length(array_join(slice(parts, 1, i), '')) - length(replace(array_join(slice(parts, 1, i), ''), '\n', ''))")
    display = d.where("i % 2 = 1 and i < size(parts) - 1").select("path", F.lit("display").alias("kind"), line.alias("line"), F.regexp_replace("part", r"\A\s+|\s+\z", "").alias("formula"))
    plain = d.where("i % 2 = 0").select("path", line.alias("first"), F.posexplode(F.split("part", "\n", -1)).alias("j", "l"))
    inline = plain.select("path", F.lit("inline").alias("kind"), (F.col("first") + F.col("j")).alias("line"), F.explode(F.regexp_extract_all("l", F.lit(r"\$([^$\n]+)\$"), 1)).alias("formula"))
    return display.unionByName(inline)


def compile_errors(errors: DataFrame, formula_lines: DataFrame, reach: int = 9) -> DataFrame:
    """(path, line, error, source_line): each error's formula line is its own or the nearest earlier within `reach`.

    A backward as-of join with tolerance: lines are dealt into buckets of reach + 1, so an error meets only its own
    and the previous bucket.
    """
    size = reach + 1
    e = errors.select("path", "line", "error", F.explode(F.array(F.floor(F.col("line") / size), F.floor(F.col("line") / size) - 1)).alias("bucket"))
    f = formula_lines.select("path", F.col("line").alias("at"), "source_line", F.floor(F.col("line") / size).alias("bucket"))
    d = e.join(f, ["path", "bucket"], "left").withColumn("ok", F.col("at").between(F.col("line") - reach, F.col("line")))
    return d.groupBy("path", "line", "error").agg(F.max_by("source_line", F.when(F.col("ok"), F.col("at"))).alias("source_line"))


def summary(found: DataFrame) -> DataFrame:
    """One row: findings by severity, and whether none is critical or blocks."""
    one = lambda *s: F.coalesce(F.sum(F.when(F.col("severity").isin(*s), 1).otherwise(0)), F.lit(0))
    return found.agg(one("critical", "block").alias("critical"), one("warning", "flag").alias("warning"), F.count("*").alias("total"), (one("critical", "block") == 0).alias("passed"))


def in_report_order(found: DataFrame) -> DataFrame:
    rank = F.when(F.col("severity").isin("critical", "block"), 0).when(F.col("severity").isin("warning", "flag"), 1).otherwise(2)
    return found.orderBy(rank, "path", "code", "detail")
