"""Cutting documents into chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.functions import text as t

# Headings whose sections are not indexed outside of raw sources.
BOILERPLATE = (
    "see also", "sources", "references", "related", "further reading", "参考文献", "相关条目", "另见", "来源",
    "语义关联 (semantic links)", "语义关联", "semantic links",
)
SLICE_LINES = 250


def heading_chunks(docs: DataFrame, most: int = SLICE_LINES) -> DataFrame:
    """(path, heading, start_line, end_line, content) of docs(path, text).

    A section starts at every line but the first with one to three # and a blank, also inside code fences. Longer
    sections are cut every `most` lines and only the first part has the heading. Lines count from 1; content is
    stripped and empty chunks go. Boundaries are found in the document's own array of lines, so nothing is shuffled.
    """
    d = docs.select("path", F.split("text", "\n", -1).alias("l"))
    heads = "filter(sequence(1, size(l)), i -> i = 1 or l[i - 1] rlike '^#{1,3} ')"
    d = d.withColumn("heads", F.expr(heads))
    ends = "transform(heads, (s, k) -> named_struct('s', s, 'e', if(k = size(heads) - 1, size(l), heads[k + 1] - 1)))"
    d = d.withColumn("sections", F.expr(ends))
    parts = f"flatten(transform(sections, x -> transform(sequence(0, cast((x.e - x.s) div {most} as int)), j -> named_struct('s', x.s + j * {most}, 'e', least(x.e, x.s + j * {most} + {most - 1}), 'first', j = 0, 'head', l[x.s - 1]))))"
    d = d.select("path", "l", F.explode(F.expr(parts)).alias("p"))
    heading = F.expr("if(p.first and p.head rlike '^#{1,6} ', trim(regexp_replace(p.head, '^#+', '')), '')")
    content = F.expr(r"regexp_replace(array_join(slice(l, p.s, p.e - p.s + 1), '\n'), r'\A\s+|\s+\z', '')")
    return d.select("path", heading.alias("heading"), F.col("p.s").alias("start_line"), F.col("p.e").alias("end_line"), content.alias("content")).where("content <> ''")


def without_boilerplate(chunks: DataFrame) -> DataFrame:
    """Chunks but those outside raw under a boilerplate heading."""
    head = F.lower(F.rtrim(F.trim(F.rtrim(F.trim("heading"), F.lit(":")))))
    return chunks.where((t.collection_of("path") == "raw") | ~F.coalesce(head, F.lit("")).isin(*BOILERPLATE))


def numbered(chunks: DataFrame) -> DataFrame:
    """With `id`: a hash of path and first line, the same in every run."""
    return chunks.withColumn("id", F.xxhash64("path", "start_line"))


def window_chunks(docs: DataFrame, most: int = 500) -> DataFrame:
    """(path, chunk, start_line, end_line, content): broken at the first blank line outside fences once `most` lines are full.

    The greedy reset is a fold over a document's lines, so it stays inside one row.
    """
    d = docs.select("path", F.split("text", "\n", -1).alias("l"))
    fold = f"""aggregate(sequence(1, size(l)), named_struct('cuts', array(0), 'fence', false), (a, i) -> named_struct(
        'cuts', if(not (a.fence != (l[i - 1] rlike '^\\\\s*```')) and trim(l[i - 1]) = '' and i - element_at(a.cuts, -1) >= {most} and i < size(l), concat(a.cuts, array(i)), a.cuts),
        'fence', a.fence != (l[i - 1] rlike '^\\\\s*```')), a -> concat(a.cuts, array(size(l))))"""
    d = d.withColumn("cuts", F.expr(fold))
    d = d.select("path", "l", "cuts", F.explode(F.expr("sequence(1, size(cuts) - 1)")).alias("chunk"))
    return d.selectExpr("path", "chunk", "cuts[chunk - 1] + 1 as start_line", "cuts[chunk] as end_line", "array_join(slice(l, cuts[chunk - 1] + 1, cuts[chunk] - cuts[chunk - 1]), '\\n') as content")


def paragraph_context(docs: DataFrame, pattern: str) -> DataFrame:
    """(path, block): paragraphs that match, each with its neighbours; a block inside the one before it is left out."""
    d = docs.select("path", F.expr(r"filter(split(text, r'\n\s*\n'), p -> trim(p) <> '')").alias("p"))
    d = d.select("path", "p", F.posexplode("p").alias("i", "x")).where(F.col("x").rlike(pattern))
    d = d.select("path", "i", F.expr("array_join(slice(p, greatest(i, 1), if(i = 0, 2, 3)), '\\n\\n')").alias("block"))
    listed = d.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("i", "block"))).alias("b"))
    kept = F.expr("filter(b, (x, k) -> k = 0 or not contains(b[k - 1].block, x.block))")
    return listed.select("path", F.explode(kept).alias("x")).select("path", F.col("x.block").alias("block"))


def sections(docs: DataFrame) -> DataFrame:
    """(path, h2, h3, start_line, end_line, content): a manual's hierarchy, headings inside code fences don't count."""
    d = docs.select("path", F.split("text", "\n", -1).alias("l"))
    d = d.withColumn("fenced", F.expr("aggregate(l, named_struct('on', false, 'a', cast(array() as array<boolean>)), (s, x) -> named_struct('on', s.on != startswith(ltrim(x), '```'), 'a', array_append(s.a, s.on or startswith(ltrim(x), '```'))), s -> s.a)"))
    d = d.withColumn("heads", F.expr("filter(sequence(1, size(l)), i -> not fenced[i - 1] and l[i - 1] rlike '^##{1,2} ')"))
    d = d.select("path", "l", "heads", F.posexplode("heads").alias("k", "s"))
    d = d.withColumn("e", F.expr("if(k = size(heads) - 1, size(l), heads[k + 1] - 1)"))
    title = lambda i: f"trim(regexp_replace(l[{i} - 1], '^#+', ''))"
    above = "try_element_at(filter(heads, i -> i <= s and l[i - 1] rlike '^## '), -1)"
    return d.selectExpr("path", f"{title(above)} as h2", f"if(l[s - 1] rlike '^### ', {title('s')}, null) as h3", "s as start_line", "e as end_line", "array_join(slice(l, s + 1, e - s), '\\n') as content")


def search_sections(found: DataFrame, query: str, per_section: int = 3, limit: int = 8) -> DataFrame:
    """(h2, h3, matches, lines): sections by how many lines hold the query whatever the case, with their first lines."""
    hit = F.filter(F.split("content", "\n"), lambda x: F.lower(x).contains(query.lower()))
    d = found.withColumn("hits", hit).where("size(hits) > 0")
    return d.select("path", "h2", "h3", "start_line", F.size("hits").alias("matches"), F.slice("hits", 1, per_section).alias("lines")).orderBy(F.desc("matches"), "path", "start_line").limit(limit)
