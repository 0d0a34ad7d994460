"""Lookups, renames and derived pages of a library of cards."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.functions import text as t
from lexquarry.operators import radar, substrings
from lexquarry.operators.similarity import _kept

GRAM = 3


def _stem(c: Column | str) -> Column:
    return F.regexp_extract(c, r"([^/]*?)(?:\.[^./]*)?$", 1)


def resolved_sources(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(ref, path, tier) for refs(ref) and files(path, title, aliases): what a source reference means.

    Tiers in order: the exact path; a wiki card by the slug of stem, title or alias; a raw file by the slug of its
    stem, with or without a leading date; a raw file whose slug contains one of 8 characters or more. The first tier
    with exactly one file counts; several files in it leave the reference unresolved.
    """
    f = files.select("path", F.concat(F.array(_stem("path"), F.col("title")), F.coalesce("aliases", F.array().cast("array<string>"))).alias("names"))
    wiki = F.col("path").startswith("wiki/")
    dated = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}-"
    keys = F.array_distinct(F.when(wiki, F.transform("names", lambda n: t.slug(n, None))).otherwise(F.array(t.slug(_stem("path"), None), F.regexp_replace(t.slug(_stem("path"), None), dated, ""))))
    named = f.select("path", F.when(wiki, 2).otherwise(3).alias("tier"), F.explode(keys).alias("key")).where("key <> ''")
    r = refs.select("ref").where("ref is not null").distinct().withColumn("key", t.slug(_stem("ref"), None))
    exact = r.join(f.select("path"), F.col("ref") == F.col("path")).select("ref", "path", F.lit(1).alias("tier"))
    by_name = r.join(named, "key").select("ref", "path", "tier")
    # containment needs a comparison with every raw slug; its blocks are pairs of 8-grams, so only likely files meet
    grams = lambda d: d.select("*", F.explode(F.expr("transform(sequence(1, greatest(length(key) - 7, 1)), i -> substring(key, i, 8))")).alias("g"))
    a = grams(r.where("length(key) >= 8")).groupBy("ref", "key").agg(F.min("g").alias("g"))
    b = grams(named.where("tier = 3")).select(F.col("key").alias("raw_key"), "path", "g").distinct()
    inside = a.join(b, "g").where(F.col("raw_key").contains(F.col("key"))).select("ref", "path", F.lit(4).alias("tier")).distinct()
    found = exact.unionByName(by_name).unionByName(inside).distinct().groupBy("ref", "tier").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    best = found.groupBy("ref").agg(F.min_by(F.struct("n", "path", "tier"), "tier").alias("b"))
    return refs.select("ref").distinct().join(best, "ref", "left").select("ref", F.when(F.col("b.n") == 1, F.col("b.path")).alias("path"), F.when(F.col("b.n") == 1, F.col("b.tier")).alias("tier"))


def concept_sources(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(ref, path, name) for refs(ref): the file of files(path) that a concept's source means. Its slug and the file's
    contain one another; raw papers come before references, then the smaller name. A reference that no file fits stands
    for itself, one with `..` for nothing."""
    file = files.where(F.col("path").rlike(r"^(raw/papers|wiki/references)/[^/]+\.md$") & ~F.endswith("path", F.lit("/_index.md")))
    # both tables are kept: a filter on a slug would be moved to what the names are made of, whole texts perhaps, and take
    # them apart again for each time that the slug's expression holds the name
    name = _stem("path")
    file = _kept(file.select(t.slug(name).alias("w"), F.struct(F.when(F.startswith("path", F.lit("raw/")), 1).otherwise(2).alias("tier"), name.alias("name"), "path").alias("f")).groupBy("w").agg(F.min("f").alias("f")))
    r = _kept(refs.select("ref").distinct().select("ref", F.when(~F.contains("ref", F.lit("..")), t.slug("ref")).alias("text"))).where("ref IS NOT NULL")
    # an empty slug is contained in every other, and is no name
    asked = r.where("text <> ''").select("text").distinct()
    pairs = substrings.either_contains(asked.select(F.col("text").alias("id"), "text"), file.where("w <> ''").select("w"))
    # merge joins: how many rows a kept table, or what is found in it, has isn't known to the planner, which would broadcast them
    best = pairs.join(file.hint("merge"), "w").groupBy(F.col("id").alias("text")).agg(F.min("f").alias("f"))
    own = F.when(~F.contains("ref", F.lit("..")), F.col("ref"))
    return r.join(best.hint("merge"), "text", "left").select("ref", F.coalesce("f.path", own).alias("path"), F.coalesce("f.name", own).alias("name"))


def found_cards(targets: DataFrame, cards: DataFrame) -> DataFrame:
    """(target, path, matches): a card by path, path below the topic, exact stem, then a unique part of a stem.

    Every tier is a join on equal values; for the last, stems and targets meet by a piece of GRAM letters at most. An
    empty target matches nothing.
    """
    c = cards.select("path", _stem("path").alias("stem"))
    x = targets.select("target").distinct()
    below = F.expr("transform(sequence(1, size(split(path, '/')) - 1), i -> array_join(slice(split(path, '/'), i + 1, size(split(path, '/'))), '/'))")
    names = c.select("path", F.explode(F.concat(F.array(F.struct(F.lit(1).alias("tier"), F.col("path").alias("name")), F.struct(F.lit(3).alias("tier"), F.col("stem").alias("name"))),
        F.when(F.contains("path", F.lit("/")), F.transform(below, lambda n: F.struct(F.lit(2).alias("tier"), n.alias("name")))).otherwise(F.array().cast("array<struct<tier:int,name:string>>")))).alias("n")).select("path", "n.*")
    asked = x.where("target <> ''").select("target", F.explode(F.array(F.struct(F.lit(1).alias("tier"), F.col("target").alias("name")), F.struct(F.lit(2).alias("tier"), F.col("target").alias("name")),
        F.struct(F.lit(3).alias("tier"), F.regexp_replace("target", r"\.md$", "").alias("name")))).alias("n")).select("target", "n.*")
    exact = asked.join(names, ["tier", "name"]).select("target", "path", "tier")
    grams = F.expr(f"array_distinct(flatten(transform(sequence(1, {GRAM}), k -> filter(transform(sequence(1, greatest(length(stem), 1)), i -> substring(stem, i, k)), g -> length(g) = k))))")
    part = x.where("target <> ''").withColumn("gram", F.substring("target", 1, GRAM)).join(c.withColumn("gram", F.explode(grams)), "gram").where(F.col("stem").contains(F.col("target")))
    d = exact.union(part.select("target", "path", F.lit(4).alias("tier")))
    d = d.groupBy("target", "path").agg(F.min("tier").alias("tier"))
    best = d.groupBy("target", "tier").agg(F.count("*").alias("n"), F.min("path").alias("path")).groupBy("target").agg(F.min_by(F.struct("n", "path"), "tier").alias("b"))
    return x.join(best, "target", "left").select("target", F.when(F.col("b.n") == 1, F.col("b.path")).alias("path"), F.coalesce("b.n", F.lit(0)).alias("matches"))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching blocks' share of two strings; an edit distance is something else."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def similar_names(new: DataFrame, known: DataFrame, least: float = 0.82, contained: float = 0.65, every: bool = False) -> DataFrame:
    """(name, match): for new(name) the first known(name) that is alike, by the ratio or as a prefix or suffix, or every one.

    Candidates share a pair of neighbouring letters: names alike to that degree always do.
    """
    pairs_of = lambda c: F.array_distinct(F.expr(f"transform(sequence(1, greatest(length({c}) - 1, 1)), i -> substring({c}, i, 2))"))
    a = new.select(t.slug("name", None).alias("a"), "name").withColumn("g", F.explode(pairs_of("a")))
    b = known.select(t.slug("name", None).alias("b"), F.col("name").alias("match")).withColumn("g", F.explode(pairs_of("b")))
    d = a.join(b, "g").select("name", "a", "match", "b").distinct()
    # the ratio can't exceed twice the shorter length over the sum
    d = d.where(2 * F.least(F.length("a"), F.length("b")) >= least * (F.length("a") + F.length("b")) * contained)
    inside = (F.startswith("a", "b") | F.startswith("b", "a") | F.endswith("a", "b") | F.endswith("b", "a")) & (F.least(F.length("a"), F.length("b")) >= contained * F.greatest(F.length("a"), F.length("b")))
    alike = d.withColumn("ratio", sequence_ratio("a", "b")).where((F.col("ratio") >= least) | inside)
    return alike.select("name", "match").distinct() if every else alike.groupBy("name").agg(F.min("match").alias("match"))


def mapped_tags(cards: DataFrame, mapping: DataFrame) -> DataFrame:
    """cards(path, tags) with tags replaced by mapping(tag, canonical); an empty canonical drops the tag; order kept."""
    d = cards.select("path", F.posexplode_outer("tags").alias("i", "tag")).join(mapping, "tag", "left")
    new = F.coalesce("canonical", "tag")
    d = d.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("i", new.alias("t")))).alias("x"))
    return d.select("path", F.array_distinct(F.filter(F.transform("x", lambda s: s["t"]), lambda v: v.isNotNull() & (v != ""))).alias("tags"))


def renamed_links(docs: DataFrame, old: str, new: str) -> DataFrame:
    """docs(path, text) with wikilinks and Markdown links to `old` pointing to `new`, whatever the case."""
    q = "".join("\\" + c if not c.isalnum() else c for c in old).replace("\\-", "[-_ ]").replace("\\_", "[-_ ]").replace("\\ ", "[-_ ]")
    x = F.regexp_replace("text", rf"(?i)\[\[{q}(\|[^\]]*)?\]\]", f"[[{new}$1]]")
    x = F.regexp_replace(x, rf"(?i)(\]\((?:[^)\s]*/)?){q}(\.md\))", f"$1{new}$2")
    return docs.withColumn("text", x)


def merged_cards(cards: DataFrame, merges: DataFrame) -> DataFrame:
    """cards(path, tags, aliases, title, body) with merged(kept, merged) ones folded into the kept: lists in order of
    first sight, the merged title as an alias, bodies one after the other."""
    into = cards.join(merges.select(F.col("merged").alias("path"), "kept"), "path")
    none = F.array().cast("array<string>")
    extra = into.groupBy("kept").agg(F.array_sort(F.collect_list(F.struct("path", "title", F.coalesce("tags", none).alias("tags"), F.coalesce("aliases", none).alias("aliases"), "body"))).alias("x"))
    d = cards.join(merges.select(F.col("merged").alias("path")), "path", "left_anti").join(extra.withColumnRenamed("kept", "path"), "path", "left")
    listed = lambda k: F.coalesce(F.flatten(F.transform("x", lambda s: s[k])), none)
    tags = F.array_distinct(F.concat(F.coalesce("tags", none), listed("tags")))
    aliases = F.array_distinct(F.concat(F.coalesce("aliases", none), F.coalesce(F.transform("x", lambda s: s["title"]), none), listed("aliases")))
    body = F.concat_ws("\n\n", F.array("body"), F.transform("x", lambda s: s["body"]))
    return d.select("path", tags.alias("tags"), aliases.alias("aliases"), "title", body.alias("body"))


def index_pages(cards: DataFrame) -> DataFrame:
    """(category, files, page): for each category of cards(path, title, category, summary) its page, sorted by title."""
    row = F.struct(F.lower("title").alias("k"), "path", F.concat(F.lit("| [["), _stem("path"), F.lit("]] | "), F.replace(F.coalesce("summary", F.lit("")), F.lit("|"), F.lit("/")), F.lit(" |")).alias("line"))
    d = cards.groupBy("category").agg(F.count("*").alias("files"), F.array_sort(F.collect_list(row)).alias("rows"))
    head = F.concat(F.lit("# "), F.initcap("category"), F.lit("\n\n| Page | Summary |\n|---|---|\n"))
    return d.select("category", "files", F.concat(head, F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n")).alias("page"))


def inbox(files: DataFrame, today: str) -> DataFrame:
    """(path, title, day, target) of files(path, text): title from the frontmatter, the first heading or the name; day
    from the frontmatter, the name or today."""
    block = t.frontmatter("text")
    stem = _stem("path")
    plain = F.regexp_replace(stem, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[-_ ]?", "")
    title = F.coalesce(t.scalar_field(block, "title"), F.trim(t.found(t.body("text"), r"(?m)^# (.+)$")), F.initcap(F.regexp_replace(plain, "[-_]+", " ")))
    day = F.coalesce(F.try_to_date(F.substring(t.scalar_field(block, "date"), 1, 10)), F.try_to_date(t.found("path", r"([0-9]{4}-[0-9]{2}-[0-9]{2})")), F.lit(today).cast("date"))
    d = files.select("path", title.alias("title"), day.alias("day"))
    return d.withColumn("target", F.concat(F.lit("raw/"), F.col("day").cast("string"), F.lit("-"), t.slug("title"), F.lit(".md")))


def symptoms(docs: DataFrame) -> DataFrame:
    """(path, line, symptom, remedy): rows of two-column Markdown tables whose head names a symptom."""
    d = docs.select("path", F.posexplode(F.split("text", "\n", -1)).alias("i", "l"), F.split("text", "\n", -1).alias("all"))
    cells = lambda c: F.transform(F.split(F.regexp_replace(F.trim(c), r"^\||\|$", ""), r"(?<!\\)\|"), lambda x: F.trim(x))
    # the table's head is the row above the nearest rule line before this row, with only table rows between
    start = F.expr("i - size(filter(sequence(1, greatest(i, 1)), k -> k <= i and forall(slice(all, i - k + 1, k), x -> ltrim(x) like '|%')))")
    d = d.where("ltrim(l) like '|%'").withColumn("start", start).where("i >= start + 2")
    head = F.expr("lower(all[start])")
    return d.where(head.rlike("symptom|症状")).select("path", (F.col("i") + 1).alias("line"), cells("l")[0].alias("symptom"), cells("l")[1].alias("remedy")).where("symptom is not null and not symptom rlike '^:?-+:?$'")


def harvested(candidates: DataFrame, seen: DataFrame, library: DataFrame, embeddings: DataFrame, center: DataFrame, least: float, most: int) -> DataFrame:
    """A harvest: fresh candidates, scored against the library's centroid, cut to the relevant and to the budget."""
    from lexquarry.operators.similarity import relevance

    new = radar.fresh(candidates.drop("score"), seen, library)
    scored = relevance(new.join(embeddings.select("id", "embedding"), "id", "left"), center)
    return radar.by_score(radar.budgeted(radar.relevant(scored, least), most))


def clustered_boxes(boxes: DataFrame, gap: float) -> DataFrame:
    """(page, cluster, x0, y0, x1, y1): boxes of a page merged while their gap-expanded boxes meet.

    boxes(page, x0, y0, x1, y1). One fold per page over its own few boxes: each takes in every cluster that it meets.
    """
    meets = f"b.x0 - {gap} <= c.x1 and c.x0 <= b.x1 + {gap} and b.y0 - {gap} <= c.y1 and c.y0 <= b.y1 + {gap}"
    # after a box has joined clusters the result may meet others; the fold is repeated over its own result, as often as
    # there are boxes: a pass that changes anything leaves at least one cluster less
    once = f"""aggregate(a, slice(a, 1, 0), (cs, b) -> concat(filter(cs, c -> not ({meets})), array(named_struct(
        'x0', least(b.x0, coalesce(array_min(transform(filter(cs, c -> {meets}), c -> c.x0)), b.x0)), 'y0', least(b.y0, coalesce(array_min(transform(filter(cs, c -> {meets}), c -> c.y0)), b.y0)),
        'x1', greatest(b.x1, coalesce(array_max(transform(filter(cs, c -> {meets}), c -> c.x1)), b.x1)), 'y1', greatest(b.y1, coalesce(array_max(transform(filter(cs, c -> {meets}), c -> c.y1)), b.y1))))))"""
    d = boxes.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("x0", "y0", "x1", "y1"))).alias("m"))
    d = d.select("page", F.expr(f"aggregate(sequence(1, size(m)), m, (a, i) -> {once})").alias("m"))
    d = d.select("page", F.posexplode(F.array_sort("m")).alias("cluster", "b"))
    return d.select("page", "cluster", "b.*")
