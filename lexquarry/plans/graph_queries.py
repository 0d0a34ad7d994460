"""Knowledge graph queries over the pages table, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexquarry.operators import claims as c
from lexquarry.operators import graph as g
from lexquarry.operators import stats
from lexquarry.plans.adapters import cards, claims, table, web_graph

_CTE = r"""
WITH RECURSIVE cards AS MATERIALIZED (SELECT page_id, 'wiki/' || CASE page_id % 3 WHEN 0 THEN 'concepts' WHEN 1 THEN 'references' ELSE 'topics' END || '/p' || page_id || '.md' AS path,
  CASE page_id % 3 WHEN 0 THEN 'concept' WHEN 1 THEN 'reference' ELSE 'topic' END AS type, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang,
  regexp_extract(url, '//([a-z]+)', 1) AS alias, regexp_extract_all(html, '<a href="/([^"]*)"', 1) AS links FROM pages WHERE html IS NOT NULL),
ids AS MATERIALIZED (SELECT *, replace(path, '.md', '') AS id, 'p' || page_id AS stem FROM cards),
names AS (SELECT path, id, 0 AS o, title AS n FROM ids UNION ALL SELECT path, id, 1, stem FROM ids UNION ALL SELECT path, id, 2, alias FROM ids),
keys AS MATERIALIZED (SELECT lower(replace(trim(n), '_', ' ')) AS k, arg_min(id, (path, o)) AS node FROM names WHERE trim(n) <> '' GROUP BY 1),
tags AS MATERIALIZED (SELECT DISTINCT id AS node_id, tag FROM (SELECT id, lang AS tag FROM ids UNION ALL SELECT id, 'q' || page_id % 4 FROM ids) WHERE tag <> ''),
nodes AS MATERIALIZED (SELECT id, path, CASE WHEN title = '' THEN stem ELSE title END AS title, type, lang AS category, '' AS updated FROM ids UNION ALL SELECT DISTINCT 'tag:' || tag, '', tag, 'tag', '', '' FROM tags),
edges AS MATERIALIZED (SELECT DISTINCT id AS source_id, coalesce(node, trim(t)) AS target_id, 'wikilink' AS type FROM (SELECT id, unnest(links) AS t FROM ids) LEFT JOIN keys ON k = lower(replace(trim(t), '_', ' ')) UNION ALL SELECT node_id, 'tag:' || tag, 'has_tag' FROM tags),
ends AS (SELECT source_id AS id FROM edges WHERE type = 'wikilink' UNION ALL SELECT target_id FROM edges WHERE type = 'wikilink' AND target_id <> source_id),
deg AS MATERIALIZED (SELECT nodes.id, count(ends.id) AS degree FROM nodes LEFT JOIN ends USING (id) GROUP BY 1),
claims AS MATERIALIZED (SELECT 'claim:' || substr(sha1('wiki/concepts/p' || item_id * 3 || '|' || text), 1, 12) AS id, 'wiki/concepts/p' || item_id * 3 AS doc_id, text, CASE WHEN item_id % 3 = 0 THEN 'verified' ELSE 'unverified' END AS status,
  CASE WHEN item_id % 2 = 0 THEN 'local_wiki' ELSE 'web' END AS source_type, 'wiki/topics/p' || item_id || '.md' AS source FROM benchmark)
"""
Q, SQL = {}, {}


def query(sql: str, cte: bool = True):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = (_CTE if cte else "") + sql
        return f

    return put


@query("SELECT id, path, title, type, category FROM nodes")
def c2_graph_nodes(spark, d):
    return web_graph(spark, d).nodes.select("id", "path", "title", "type", "category")


@query("SELECT * FROM edges")
def c2_graph_edges(spark, d):
    return web_graph(spark, d).edges


@query("SELECT id, CAST(degree AS BIGINT) AS degree FROM deg")
def c2_degrees(spark, d):
    return g.degrees(web_graph(spark, d)).select("id", F.col("degree").cast("long").alias("degree"))


@query("""SELECT 'nodes' AS section, type AS key, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edges', type, count(*) FROM edges GROUP BY 2 UNION ALL SELECT 'claims', status, count(*) FROM claims GROUP BY 2
UNION ALL SELECT 'tags', 'distinct', count(DISTINCT tag) FROM tags UNION ALL SELECT 'broken_links', 'all', count(*) FROM edges WHERE type IN ('wikilink', 'supported_by') AND target_id NOT IN (SELECT id FROM nodes)""")
def c2_overview(spark, d):
    return g.overview(web_graph(spark, d), claims(spark, d))


@query("SELECT id, title, type, category, updated, degree FROM nodes JOIN deg USING (id) WHERE type = 'concept' AND (lower(title) LIKE '%the%' OR lower(id) LIKE '%the%') ORDER BY degree DESC, id LIMIT 50")
def c2_browse_nodes(spark, d):
    return g.browse_nodes(web_graph(spark, d), "concept", "the")


@query("SELECT id, title, type, degree FROM nodes JOIN deg USING (id) ORDER BY degree DESC, id LIMIT 20")
def c2_hubs(spark, d):
    return g.hubs(web_graph(spark, d))


@query("SELECT tag, count(*) AS count FROM tags GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def c2_tags(spark, d):
    return g.tag_counts(web_graph(spark, d))


@query("SELECT e.source_id, s.title AS source_title, e.target_id AS target_text, e.type FROM edges e LEFT JOIN nodes s ON s.id = e.source_id WHERE e.type IN ('wikilink', 'supported_by') AND NOT EXISTS (SELECT 1 FROM nodes t WHERE t.id = e.target_id)")
def c2_broken_links(spark, d):
    return g.broken(web_graph(spark, d))


@query("SELECT id, doc_id, status, text FROM claims WHERE status = 'verified' AND lower(text) LIKE '%th%' ORDER BY id LIMIT 50")
def c2_browse_claims(spark, d):
    return g.browse_claims(claims(spark, d), "verified", "th")


_LINKS = """SELECT x.node_id, direction, other_id, n.title AS other_title, x.type FROM (SELECT source_id AS node_id, 'outgoing' AS direction, target_id AS other_id, type FROM edges WHERE type <> 'has_tag'
UNION ALL SELECT target_id, 'incoming', source_id, type FROM edges WHERE type <> 'has_tag') x LEFT JOIN nodes n ON n.id = other_id"""


@query(_LINKS + " WHERE x.node_id IN (SELECT id FROM nodes)")
def c2_links(spark, d):
    gr = web_graph(spark, d)
    return g.links(gr, gr.nodes.select(F.col("id").alias("node_id")))


@query("SELECT id, string_agg(o, ' ' ORDER BY o) AS adjacent FROM (SELECT source_id AS id, target_id AS o FROM edges WHERE type <> 'has_tag' UNION SELECT target_id, source_id FROM edges WHERE type <> 'has_tag') GROUP BY 1")
def c2_neighbours(spark, d):
    return g.neighbours(web_graph(spark, d)).select("id", F.array_join("adjacent", " ").alias("adjacent"))


_MAP = """, mn AS (SELECT id, title, type, coalesce(d, 0) AS degree FROM (SELECT id, title, type FROM nodes WHERE type <> 'tag' UNION ALL SELECT DISTINCT target_id, target_id, 'ghost' FROM edges WHERE type = 'wikilink' AND target_id NOT IN (SELECT id FROM nodes))
LEFT JOIN (SELECT id, count(*) AS d FROM (SELECT source_id AS id FROM edges WHERE type = 'wikilink' UNION ALL SELECT target_id FROM edges WHERE type = 'wikilink') GROUP BY 1) USING (id) ORDER BY degree DESC, type = 'ghost', id LIMIT 300)
"""


@query(_MAP + "SELECT * FROM mn")
def c2_map_nodes(spark, d):
    return g.graph_map(web_graph(spark, d), limit=300)[0]


@query(_MAP + "SELECT source_id AS source, target_id AS target, type FROM edges WHERE type = 'wikilink' AND source_id IN (SELECT id FROM mn) AND target_id IN (SELECT id FROM mn)")
def c2_map_edges(spark, d):
    return g.graph_map(web_graph(spark, d), limit=300)[1]


@query("""SELECT t AS text, coalesce((SELECT id FROM nodes WHERE id = t), k.id) AS node_id FROM (SELECT DISTINCT unnest(links) AS t FROM ids) LEFT JOIN
(SELECT k, arg_min(id, (tier, id, o)) AS id FROM (SELECT 0 AS tier, id, 0 AS o, lower(replace(trim(title), '_', ' ')) AS k FROM nodes UNION ALL SELECT 0, id, 1, lower(replace(trim(replace(regexp_extract(CASE WHEN path = '' THEN id ELSE path END, '([^/]*)$', 1), '.md', '')), '_', ' ')) FROM nodes
 UNION ALL SELECT 1, id, 0, lower(replace(trim(alias), '_', ' ')) FROM ids) GROUP BY 1) k ON k.k = lower(replace(trim(t), '_', ' '))""")
def c2_resolve(spark, d):
    return g.resolved(web_graph(spark, d), cards(spark, d).select(F.explode("links").alias("text")).distinct())


@query(""", bi AS (SELECT source_id AS a, target_id AS b FROM edges WHERE type <> 'has_tag' UNION SELECT target_id, source_id FROM edges WHERE type <> 'has_tag'),
w AS (SELECT a AS s, b AS e, [a, b] AS p, 1 AS h FROM bi WHERE a = 'wiki/concepts/p0' AND b <> a UNION ALL SELECT s, b, list_append(p, b), h + 1 FROM w JOIN bi ON a = e WHERE h < 3 AND NOT list_contains(p, b) AND e <> 'wiki/concepts/p120')
SELECT array_to_string(p, ' > ') AS path, h AS hops FROM w WHERE e = 'wiki/concepts/p120' ORDER BY hops, path LIMIT 5""")
def c2_paths(spark, d):
    return g.paths(web_graph(spark, d), "wiki/concepts/p0", "wiki/concepts/p120")


@query("""SELECT source_id, target_id, type FROM edges UNION SELECT doc_id, id, 'has_claim' FROM claims UNION SELECT id, replace(source, '.md', ''), 'supported_by' FROM claims WHERE source_type = 'local_wiki'""")
def c2_claim_edges(spark, d):
    return g.with_claims(web_graph(spark, d), claims(spark, d)).edges


@query("""SELECT id, text, status, string_agg(source, ' | ' ORDER BY source, quote) AS sources, string_agg(quote, ' | ' ORDER BY source, quote) AS quotes FROM claims JOIN
(SELECT id, source, substr(text, 1, 10) AS quote FROM claims UNION ALL SELECT id, doc_id, '' FROM claims) e USING (id) GROUP BY 1, 2, 3""".replace("SELECT id, text, status, string_agg(source", "SELECT id, text, status, string_agg(e.source").replace("ORDER BY source, quote)", "ORDER BY e.source, quote)"))
def c2_claims_with_evidence(spark, d):
    x = claims(spark, d)
    e = x.select(F.col("id").alias("claim_id"), "source", F.substring("text", 1, 10).alias("quote")).union(x.select("id", "doc_id", F.lit(None).cast("string")))
    return c.with_evidence(x, e)


@query("SELECT count(*) AS claims, sum((status = 'verified')::INT)::BIGINT AS verified, round(avg((status = 'verified')::INT), 4) AS ratio FROM claims")
def c7_claim_ratio(spark, d):
    return c.verification_ratio(claims(spark, d))


@query("SELECT key, count(*) AS count, string_agg(m, ' ' ORDER BY m) AS members FROM (SELECT DISTINCT tag AS key, node_id AS m FROM tags) GROUP BY 1")
def c7_tag_index(spark, d):
    return stats.inverted(web_graph(spark, d).tags, "tag", "node_id").select("key", "count", F.array_join("members", " ").alias("members"))


@query("""WITH q AS (SELECT item_id, text AS quote FROM benchmark), s AS (SELECT text FROM documents),
h AS (SELECT item_id, max(CASE WHEN contains(text, quote) THEN 2 WHEN contains(trim(regexp_replace(text, '\\s+', ' ', 'g')), trim(regexp_replace(quote, '\\s+', ' ', 'g'))) THEN 1 ELSE 0 END) AS t FROM q, s GROUP BY 1)
SELECT item_id, CASE t WHEN 2 THEN 'exact' WHEN 1 THEN 'whitespace' ELSE 'not-found' END AS result FROM h""".replace("\\\\", "\\"), cte=False)
def c6_verify_quotes(spark, d):
    """Every benchmark text as a quotation from any document."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("quote"))
    return c.found_anywhere(q, table(spark, d, "documents").select("doc_id", "text")).withColumnRenamed("id", "item_id")


@query("""WITH b AS (SELECT item_id, string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM benchmark),
q AS (SELECT 3 * item_id + k AS id, CASE k WHEN 0 THEN w[2] WHEN 1 THEN w[3][2:] || CASE WHEN item_id % 2 = 0 THEN ' ' ELSE '  ' END || w[4][1:2] ELSE w[5][2:4] || ' ' END AS quote FROM b, (VALUES (0), (1), (2)) v(k)),
s AS (SELECT text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS plain FROM documents),
h AS (SELECT id, max(CASE WHEN contains(text, quote) THEN 2 WHEN contains(plain, trim(regexp_replace(quote, '\\s+', ' ', 'g'))) THEN 1 ELSE 0 END) AS t FROM q, s WHERE quote <> '' GROUP BY 1)
SELECT q.id, CASE WHEN trim(quote) = '' OR quote IS NULL THEN 'malformed' WHEN t = 2 THEN 'exact' WHEN t = 1 THEN 'whitespace' ELSE 'not-found' END AS result FROM q LEFT JOIN h USING (id)""".replace("\\\\", "\\"), cte=False)
def c6_short_quotes(spark, d):
    """One word, two cut words and one cut word of every benchmark text as quotations from any document."""
    b = table(spark, d, "benchmark").select("item_id", F.expr(r"split(trim(regexp_replace(text, '\\s+', ' ')), ' ')").alias("w"))
    w = lambda k: F.get("w", F.lit(k))
    two = F.concat(F.substr(w(2), F.lit(2)), F.when(F.col("item_id") % 2 == 0, " ").otherwise("  "), F.substr(w(3), F.lit(1), F.lit(2)))
    q = b.select(F.posexplode(F.array(w(1), two, F.concat(F.substr(w(4), F.lit(2), F.lit(3)), F.lit(" ")))).alias("k", "quote"), "item_id")
    return c.found_anywhere(q.select((3 * F.col("item_id") + F.col("k")).alias("id"), "quote"), table(spark, d, "documents").select("doc_id", "text"))
