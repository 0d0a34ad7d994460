"""Literature radar: candidates from several sources are deduplicated, scored, budgeted and triaged.

candidates(id, arxiv_id, doi, title, year, abstract, url, source, authors, published, source_ord, ord): source_ord and
ord give the order in which they were found, on which first-wins rules and ties depend.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions import text as t
from lexquarry.operators.graph import first_wins


def fresh(candidates: DataFrame, seen: DataFrame, library: DataFrame) -> DataFrame:
    """Candidates not seen before, not in the library, each id once (the first found)."""
    d = candidates.where("id is not null").join(seen.select("id"), "id", "left_anti")
    d = d.join(library.select("arxiv_id").where("arxiv_id is not null").distinct(), "arxiv_id", "left_anti")
    return first_wins(d, ["id"], ["source_ord", "ord"])


def relevant(candidates: DataFrame, least: float) -> DataFrame:
    """Those without a score stay."""
    return candidates.where(F.col("score").isNull() | (F.col("score") >= least))


def recent(papers: DataFrame, since_year: int) -> DataFrame:
    return papers.where(F.coalesce("year", F.lit(0)) >= since_year)


def budgeted(candidates: DataFrame, most: int, is_recent: Column | None = None) -> DataFrame:
    """At most `most` rows: half the places (or as many as there are) for the best recent listings, the rest by score.

    Recent listings are those whose source begins with `arxiv-new`. Two global ranks over what the harvest kept.
    """
    new = F.col("source").startswith("arxiv-new") if is_recent is None else is_recent
    order = [F.desc(F.coalesce("score", F.lit(-1.0))), "source_ord", "ord"]
    d = candidates.withColumn("__new", F.coalesce(new, F.lit(False)))
    top = lambda rows, n: rows.orderBy(*order).limit(n)
    reserved = top(d.where("__new"), most // 2).select("id")
    rest = d.join(reserved, "id", "left_anti")
    n = reserved.agg(F.count("*").alias("n"))
    filled = top(rest, most).withColumn("__r", F.row_number().over(Window.orderBy(*order))).crossJoin(F.broadcast(n)).where(f"__r <= {most} - n")
    kept = reserved.union(filled.select("id"))
    return d.join(F.broadcast(kept), "id", "left_semi").drop("__new")


def by_score(candidates: DataFrame) -> DataFrame:
    """Falling score, unscored as -1, ties as found."""
    return candidates.orderBy(F.desc(F.coalesce("score", F.lit(-1.0))), "source_ord", "ord")


def triage_state(log: DataFrame) -> DataFrame:
    """(report, id, decision): the last decision by place in the log; `reset` and null take it away."""
    last = log.where("id is not null").groupBy("report", "id").agg(F.max_by("decision", "offset").alias("decision"), F.max("offset").alias("offset"))
    return last.where("decision is not null and decision <> 'reset'").select("report", "id", "decision")


def untriaged(reports: DataFrame, state: DataFrame) -> DataFrame:
    """(report, candidates, untriaged) for reports(report, id)."""
    d = reports.join(state, ["report", "id"], "left")
    return d.groupBy("report").agg(F.count("*").alias("candidates"), F.sum(F.when(F.col("decision").isNull(), 1).otherwise(0)).alias("untriaged"))


def status(seen: DataFrame, pending: DataFrame) -> DataFrame:
    """One row: ids seen, candidates pending, day of the last harvest."""
    return seen.agg(F.countDistinct("id").alias("seen"), F.max("first_seen").alias("last_harvest")).crossJoin(pending.agg(F.count("*").alias("pending")))


def group_neighbours(anchors: DataFrame, papers: DataFrame, most: int = 20) -> DataFrame:
    """(anchor, paper_id, year, score): the `most` best papers near each anchor, ties by the smaller id, where those of its
    group are near it and itself isn't. anchors(anchor, group), papers(paper_id, group, year, score), a row each.

    A group's papers are ranked once for all of its anchors: those behind the first most + 1 are nobody's, as an anchor
    leaves out one of them at most.
    """
    best = papers.withColumn("r", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("score"), "paper_id"))).where(F.col("r") <= most + 1)
    own = best.select(F.col("paper_id").alias("anchor"), "group", F.col("r").alias("own"))
    d = anchors.join(own, ["anchor", "group"], "left").join(best, "group").where("anchor <> paper_id")
    return d.where(F.col("r") <= most + F.when(F.col("own").isNull(), 0).otherwise(1)).select("anchor", "paper_id", "year", "score")


def citation_gap(neighbours: DataFrame, refs: DataFrame, citations: DataFrame, since_year: int, least_shared: int = 3, per_anchor: int = 20, titles: int = 5) -> DataFrame:
    """(anchor, paper_id, shared, shared_titles): papers near an anchor that share references with it but don't cite it.

    neighbours(anchor, paper_id, year, score), refs(paper_id, ref_id, ref_title), citations(cited_id, citing_id). The
    best `per_anchor` neighbours of each anchor are looked at.
    """
    cites = citations.select(F.col("cited_id").alias("anchor"), F.col("citing_id").alias("paper_id"))
    d = recent(neighbours.join(cites, ["anchor", "paper_id"], "left_anti"), since_year)
    w = Window.partitionBy("anchor").orderBy(F.desc("score"), "paper_id")
    d = d.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_anchor)
    ours = refs.select(F.col("paper_id").alias("anchor"), "ref_id").distinct()
    theirs = refs.groupBy("paper_id", "ref_id").agg(F.min("ref_title").alias("ref_title"))
    common = d.select("anchor", "paper_id").join(theirs, "paper_id").join(ours, ["anchor", "ref_id"])
    out = common.groupBy("anchor", "paper_id").agg(F.count("*").alias("shared"), F.slice(F.array_sort(F.collect_set("ref_title")), 1, titles).alias("shared_titles"))
    return out.where(F.col("shared") >= least_shared)


def seeds(*sources: DataFrame, most: int = 50) -> DataFrame:
    """An ordered union of (id, ord), each id once at its first place."""
    d = sources[0].select(F.lit(0).alias("s"), "ord", "id")
    for i, x in enumerate(sources[1:], 1):
        d = d.union(x.select(F.lit(i), "ord", "id"))
    return d.groupBy("id").agg(F.min(F.struct("s", "ord")).alias("at")).orderBy("at", "id").limit(most).select("id")


def percent_tiers(scored: DataFrame) -> DataFrame:
    """(report, id, score, share, tier): the share of a report's scores strictly below; top from 0.75, mid from 0.40.

    Reports with fewer than 4 scores have no tiers.
    """
    d = scored.where("score is not null")
    w = Window.partitionBy("report")
    d = d.withColumn("n", F.count("*").over(w)).withColumn("share", (F.rank().over(w.orderBy("score")) - 1) / F.col("n"))
    return d.where("n >= 4").select("report", "id", "score", "share", F.when(F.col("share") >= 0.75, "top").when(F.col("share") >= 0.40, "mid").otherwise("low").alias("tier"))


def digest_lines(candidates: DataFrame) -> DataFrame:
    """(ord, line): a Markdown entry for each candidate, with what could break it made harmless."""
    safe = lambda c: F.replace(t.squeezed(c), F.lit("`"), F.lit("'"))
    names = F.transform(F.slice("authors", 1, 6), lambda a: F.replace(t.squeezed(a), F.lit(","), F.lit(" ")))
    who = F.concat(F.array_join(names, ", "), F.when(F.size("authors") > 6, " et al.").otherwise(""))
    line = F.concat(F.lit("### "), safe("title"), F.lit("\n- id: `"), safe("id"), F.lit("`\n- authors: "), who, F.lit("\n- year: "), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit("\n- source: "), safe("source"), F.coalesce(F.concat(F.lit("\n- score: "), F.col("score").cast("string")), F.lit("")), F.lit("\n\n"), t.ellipsized(t.squeezed(F.coalesce("abstract", F.lit("")))), F.lit("\n"))
    return candidates.select("ord", line.alias("line"))


def digest_entries(digests: DataFrame) -> DataFrame:
    """(report, id, title, year, source, score) of digests(report, text): what digest_lines wrote, read back."""
    d = digests.select("report", F.posexplode(F.split("text", r"(?m)^### ")).alias("ord", "entry")).where("ord > 0")
    field = lambda name: F.nullif(F.trim(t.found("entry", rf"(?m)^- {name}: `?([^`\n]*)`?$")), F.lit(""))
    out = d.select("report", "ord", field("id").alias("id"), F.trim(F.split_part("entry", F.lit("\n"), F.lit(1))).alias("title"), field("year").cast("int").alias("year"), field("source").alias("source"), field("score").cast("double").alias("score"))
    return out.where("id is not null")
