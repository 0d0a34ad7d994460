"""The knowledge graph: nodes, edges, tags and aliases from cards, and views on them.

cards(path, title, type, category, summary, created, updated, tags, aliases, links) are parsed documents; links holds
the texts of wikilinks. Edges are (source_id, target_id, type) with types wikilink, has_tag, has_claim, supported_by.
A link resolves to the first card in path order with that title, file stem or alias; what resolves to nothing keeps
its text and counts as broken. A self-loop counts once in `degrees` and twice in `graph_map`.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions import text as t

LINK_TYPES = ("wikilink", "has_claim", "supported_by")
BROKEN_TYPES = ("wikilink", "supported_by")
# The kinds of nodes, and the folders that decide them.
NODE_TYPES = ("concept", "reference", "topic", "thesis", "claim", "tag")
DIRECTORY_TYPES = {"concepts": "concept", "references": "reference", "theses": "thesis", "topics": "topic"}


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    tags: DataFrame
    aliases: DataFrame


def parent(path: Column) -> Column:
    """The name of a file's folder."""
    return F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)


def directory_type(path: Column) -> Column:
    return F.coalesce(*(F.when(parent(path) == d, v) for d, v in DIRECTORY_TYPES.items()))


def node_type(path: Column, declared: Column) -> Column:
    """The folder decides; a declared type wins only if it is a known one. In other folders it is the declared type,
    or the folder's name."""
    said, mapped = F.nullif(F.lower(F.trim(declared)), F.lit("")), directory_type(path)
    return F.when(mapped.isNotNull(), F.when(said.isin(*NODE_TYPES), said).otherwise(mapped)).otherwise(F.coalesce(said, parent(path)))


def link_table(cards: DataFrame) -> DataFrame:
    """(key, node_id): what link texts resolve to. The first card in path order wins; in it title, stem, aliases."""
    names = F.concat(F.array("title", "stem"), F.coalesce("aliases", F.array().cast("array<string>")))
    d = cards.select("path", "title", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.regexp_extract("path", r"([^/]*?)(?:\.md)?$", 1).alias("stem"), _id("path").alias("node_id"))
    d = d.select("path", "node_id", F.posexplode(names).alias("ord", "name")).where("name is not null and trim(name) <> ''").select(t.link_key("name").alias("key"), "node_id", "path", "ord")
    return d.groupBy("key").agg(F.min(F.struct("path", "ord", "node_id")).alias("first")).select("key", "first.node_id")


def _id(path: str) -> Column:
    return F.regexp_replace(path, r"\.md$", "")


def build(cards: DataFrame) -> Graph:
    """Nodes of cards and tags; wikilink and has_tag edges, each once."""
    c = cards.withColumn("id", _id("path"))
    blank = lambda x: F.coalesce(F.col(x), F.lit("")).alias(x)
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.md)?$", 1)
    nodes = c.select("id", "path", F.coalesce(F.nullif("title", F.lit("")), stem).alias("title"), "type", *(blank(x) for x in ("category", "summary", "created", "updated")))
    tags = c.select(F.col("id").alias("node_id"), F.explode("tags").alias("tag")).where("tag <> ''").distinct()
    aliases = c.select(F.col("id").alias("node_id"), F.explode("aliases").alias("alias")).where("alias <> ''").distinct()
    links = c.select(F.col("id").alias("source_id"), F.explode("links").alias("text")).withColumn("key", t.link_key("text"))
    wiki = links.join(link_table(cards), "key", "left").select("source_id", F.coalesce("node_id", F.trim("text")).alias("target_id"), F.lit("wikilink").alias("type"))
    name = F.concat(F.lit("tag:"), "tag")
    tag_nodes = tags.select(name.alias("id")).distinct().select("id", F.lit("").alias("path"), F.substring("id", 5, 1 << 20).alias("title"), F.lit("tag").alias("type"), *(F.lit("").alias(x) for x in ("category", "summary", "created", "updated")))
    tagged = tags.select(F.col("node_id").alias("source_id"), name.alias("target_id"), F.lit("has_tag").alias("type"))
    return Graph(nodes.unionByName(tag_nodes), wiki.unionByName(tagged).distinct(), tags, aliases)


def with_claims(graph: Graph, claims: DataFrame) -> Graph:
    """Adds claims(id, doc_id, text, status, source_type, source): claim nodes, has_claim edges, and supported_by edges
    to the card of a local source; a source without a card keeps its text."""
    nodes = claims.select("id", F.lit("").alias("path"), F.substring("text", 1, 80).alias("title"), F.lit("claim").alias("type"), *(F.lit("").alias(x) for x in ("category", "summary", "created", "updated"))).dropDuplicates(["id"])
    has = claims.select(F.col("doc_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("has_claim").alias("type"))
    by = claims.where("source_type = 'local_wiki' and source <> ''").select(F.col("id").alias("source_id"), _id("source").alias("target_id"), F.lit("supported_by").alias("type"))
    return graph._replace(nodes=graph.nodes.unionByName(nodes), edges=graph.edges.unionByName(has).unionByName(by).distinct())


def degrees(graph: Graph, types: tuple[str, ...] = ("wikilink",)) -> DataFrame:
    """(id, degree) for every node. Both ends are exploded, so the count is one aggregation and no join on `or`."""
    ends = graph.edges.where(F.col("type").isin(*types)).select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("id"))
    n = ends.groupBy("id").agg(F.count("*").alias("degree"))
    return graph.nodes.select("id").join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def overview(graph: Graph, claims: DataFrame | None = None) -> DataFrame:
    """(section, key, n): nodes and edges by type, claims by status, distinct tags, broken links."""
    count = lambda d, section, by: d.groupBy(F.col(by).alias("key")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "key", "n")
    out = count(graph.nodes, "nodes", "type").unionByName(count(graph.edges, "edges", "type"))
    if claims is not None:
        out = out.unionByName(count(claims, "claims", "status"))
    tags = graph.tags.agg(F.countDistinct("tag").alias("n")).select(F.lit("tags").alias("section"), F.lit("distinct").alias("key"), "n")
    missing = broken(graph).agg(F.count("*").alias("n")).select(F.lit("broken_links").alias("section"), F.lit("all").alias("key"), "n")
    return out.unionByName(tags).unionByName(missing)


def broken(graph: Graph) -> DataFrame:
    """(source_id, source_title, target_text, type): link edges whose target is no node."""
    e = graph.edges.where(F.col("type").isin(*BROKEN_TYPES)).join(graph.nodes.select(F.col("id").alias("target_id")), "target_id", "left_anti")
    titles = graph.nodes.select(F.col("id").alias("source_id"), F.col("title").alias("source_title"))
    return e.join(titles, "source_id", "left").select("source_id", "source_title", F.col("target_id").alias("target_text"), "type")


def browse_nodes(graph: Graph, node_type: str | None = None, q: str | None = None, limit: int = 50) -> DataFrame:
    """The nodes of most links, ties by id; q is looked for in title or id whatever the case (% and _ are wildcards)."""
    n = graph.nodes
    if node_type:
        n = n.where(F.col("type") == node_type)
    if q:
        n = n.where(F.lower("title").like(f"%{q.lower()}%") | F.lower("id").like(f"%{q.lower()}%"))
    n = n.join(degrees(graph), "id").select("id", "title", "type", "category", "updated", "degree")
    return n.orderBy(F.desc("degree"), "id").limit(limit)


def hubs(graph: Graph, limit: int = 20) -> DataFrame:
    return browse_nodes(graph, limit=limit).select("id", "title", "type", "degree")


def tag_counts(graph: Graph, q: str | None = None, limit: int = 100) -> DataFrame:
    d = graph.tags if not q else graph.tags.where(F.lower("tag").like(f"%{q.lower()}%"))
    return d.groupBy("tag").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "tag").limit(limit)


def browse_claims(claims: DataFrame, status: str | None = None, q: str | None = None, limit: int = 50) -> DataFrame:
    d = claims if status is None else claims.where(F.col("status") == status)
    d = d if not q else d.where(F.lower("text").like(f"%{q.lower()}%"))
    return d.select("id", "doc_id", "status", "text").orderBy("id").limit(limit)


def resolved(graph: Graph, names: DataFrame) -> DataFrame:
    """(text, node_id) for names(text): an id as it is, else titles and stems of all nodes by id, else aliases."""
    stem = F.regexp_replace(F.regexp_extract(F.coalesce(F.nullif("path", F.lit("")), "id"), r"([^/]*)$", 1), r"\.md$", "")
    n = graph.nodes.select("id", F.posexplode(F.array("title", stem)).alias("ord", "name")).select(F.lit(0).alias("tier"), "id", "ord", "name")
    a = graph.aliases.select(F.lit(1).alias("tier"), F.col("node_id").alias("id"), F.lit(0).alias("ord"), F.col("alias").alias("name"))
    table = n.unionByName(a).where("name <> ''").groupBy(t.link_key("name").alias("key")).agg(F.min(F.struct("tier", "id", "ord")).alias("first")).select("key", F.col("first.id").alias("by_name"))
    exact = graph.nodes.select(F.col("id").alias("text"), F.col("id").alias("by_id"))
    return names.select("text").join(exact, "text", "left").withColumn("key", t.link_key("text")).join(table, "key", "left").select("text", F.coalesce("by_id", "by_name").alias("node_id"))


def links(graph: Graph, node_ids: DataFrame) -> DataFrame:
    """(node_id, direction, other_id, other_title, type): what the given nodes(node_id) link to and what links to them."""
    e = graph.edges.where(F.col("type").isin(*LINK_TYPES))
    titles = graph.nodes.select(F.col("id").alias("other_id"), F.col("title").alias("other_title"))
    out = e.select(F.col("source_id").alias("node_id"), F.lit("outgoing").alias("direction"), F.col("target_id").alias("other_id"), "type")
    into = e.select(F.col("target_id").alias("node_id"), F.lit("incoming").alias("direction"), F.col("source_id").alias("other_id"), "type")
    return out.unionByName(into).join(node_ids.distinct(), "node_id", "left_semi").join(titles, "other_id", "left").select("node_id", "direction", "other_id", "other_title", "type")


def neighbours(graph: Graph) -> DataFrame:
    """(id, adjacent): each node's neighbours whatever the direction, sorted."""
    e = graph.edges.where(F.col("type").isin(*LINK_TYPES))
    both = e.select(F.col("source_id").alias("id"), F.col("target_id").alias("other")).union(e.select("target_id", "source_id")).distinct()
    return both.groupBy("id").agg(F.array_sort(F.collect_list("other")).alias("adjacent"))


def graph_map(graph: Graph, include_tags: bool = False, limit: int = 800) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, title, type, degree), edges(source, target, type)) of the whole graph as it is drawn.

    Unresolved targets become ghosts; edges to nodes that are left out go. Over `limit` nodes those of the smallest
    degree go, ghosts first among equals, and edges of dropped nodes with them.
    """
    all_ = graph.nodes.select("id", "title", "type")
    real = all_ if include_tags else all_.where("type <> 'tag'")
    e = graph.edges.where(F.col("type").isin(*LINK_TYPES)).join(real.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    known = e.join(real.select(F.col("id").alias("target_id")), "target_id", "left_semi").select("source_id", "target_id", "type")
    ghostly = e.where(F.col("type").isin(*BROKEN_TYPES)).join(all_.select(F.col("id").alias("target_id")), "target_id", "left_anti").select("source_id", "target_id", "type")
    kept = known.unionByName(ghostly)
    nodes = real.unionByName(ghostly.select(F.col("target_id").alias("id"), F.col("target_id").alias("title"), F.lit("ghost").alias("type")).distinct())
    ends = kept.select(F.explode(F.array("source_id", "target_id")).alias("id"), F.lit(False).alias("tagging"))
    if include_tags:
        tagged = graph.edges.where("type = 'has_tag'").join(real.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(real.select(F.col("id").alias("target_id")), "target_id", "left_semi").select("source_id", "target_id", "type")
        kept = kept.unionByName(tagged)
        ends = ends.union(tagged.select(F.explode(F.array("source_id", "target_id")), F.lit(True)))
    # a tag's degree counts has_tag edges only, any other node's all but those
    n = ends.groupBy("id", "tagging").agg(F.count("*").alias("degree"))
    nodes = nodes.withColumn("tagging", F.col("type") == "tag").join(n, ["id", "tagging"], "left").select("id", "title", "type", F.coalesce("degree", F.lit(0)).alias("degree"))
    nodes = nodes.orderBy(F.desc("degree"), F.col("type") == "ghost", "id").limit(limit)
    edges = kept.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "type")
    for end in ("source", "target"):
        edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return nodes, edges.select("source", "target", "type")


def paths(graph: Graph, start: str, goal: str, most: int = 3, limit: int = 5) -> DataFrame:
    """(path, hops): the shortest paths between two nodes over at most `most` links in either direction, no tags.

    One frontier join per hop (hops are few and fixed); a path never visits a node twice.
    """
    e = graph.edges.where(F.col("type").isin(*LINK_TYPES)).select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    both = e.union(e.select("b", "a")).distinct()
    at = graph.nodes.where(F.col("id") == start).select(F.col("id").alias("end"), F.array("id").alias("path"))
    found = None
    for hop in range(1, most + 1):
        at = at.join(both, F.col("end") == F.col("a")).where(~F.array_contains("path", F.col("b"))).select(F.col("b").alias("end"), F.array_append("path", F.col("b")).alias("path"))
        done = at.where(F.col("end") == goal).select(F.array_join("path", " > ").alias("path"), F.lit(hop).alias("hops"))
        found = done if found is None else found.unionByName(done)
        at = at.where(F.col("end") != goal)
    return found.orderBy("hops", "path").limit(limit)


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
