"""Smaller operators over columns of the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexquarry.operators import bibliography, claims, graph, quality, radar, rules, similarity, stats
from lexquarry.plans.adapters import table
from lexquarry.sources import corpus

Q, SQL = {}, {}


def query(sql: str):
    def put(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


@query("SELECT doc_id AS item_id, lang FROM documents WHERE doc_id IN (SELECT conv_id FROM conversations JOIN nation ON turn = n_nationkey WHERE n_name = 'NATION_3')")
def j_in_collection(spark, d):
    """Documents in the collection of conversations that go on for three turns."""
    members = table(spark, d, "conversations").select(F.col("turn").alias("collectionID"), F.col("conv_id").alias("itemID"))
    collections = table(spark, d, "nation").select(F.col("n_nationkey").alias("collectionID"), F.col("n_name").alias("collectionName"))
    return bibliography.in_collection(table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "lang"), members, collections, "NATION_3")


@query("SELECT (SELECT count(*) FROM orders) AS items, (SELECT max(o_orderdate) FROM orders) AS last_added, (SELECT count(*) FROM nation) AS collections")
def s_describe(spark, d):
    return bibliography.describe(table(spark, d, "orders").select(F.col("o_orderdate").alias("dateAdded")), table(spark, d, "nation"))


_WORDS = """w AS (SELECT DISTINCT regexp_extract(html, 'lang="([a-z]+)"', 1) || regexp_extract(url, 'example\\.([a-z]+)', 1) AS key, page_id % 2 AS half, unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) AS t FROM pages)"""


@query(f"""WITH {_WORDS}, k AS (SELECT DISTINCT key FROM w)
SELECT key, coalesce((SELECT string_agg(t, ' ' ORDER BY t) FROM w n WHERE n.key = k.key AND half = 1 AND t NOT IN (SELECT t FROM w o WHERE o.key = k.key AND half = 0)), '') AS added, coalesce((SELECT string_agg(t, ' ' ORDER BY t) FROM w o WHERE o.key = k.key AND half = 0 AND t NOT IN (SELECT t FROM w n WHERE n.key = k.key AND half = 1)), '') AS removed FROM k""")
def u_link_changes(spark, d):
    """The anchors of a language and site's pages of even numbers, and of odd ones."""
    key = F.concat(F.regexp_extract("html", 'lang="([a-z]+)"', 1), F.regexp_extract("url", r"example\.([a-z]+)", 1))
    w = table(spark, d, "pages").select(key.alias("key"), (F.col("page_id") % 2).alias("half"), F.explode(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), 1)).alias("t")).distinct()
    half = lambda n: w.where(F.col("half") == n).groupBy("key").agg(F.array_sort(F.collect_list("t")).alias("targets"))
    c = similarity.link_changes(half(0), half(1))
    return c.select("key", F.array_join("added", " ").alias("added"), F.array_join("removed", " ").alias("removed"))


TAG_GROUPS = [["the", "The"], ["and", "And", "AND"], ["inn", "in", "In"], ["nobody", "noone"], ["ofthe", "of"]]


@query("""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS tag FROM benchmark), g(g, tag) AS (VALUES """ + ", ".join(f"({i}, '{x}')" for i, xs in enumerate(TAG_GROUPS) for x in xs) + """)
SELECT '' AS path, 'duplicate-tags' AS code, 'warning' AS severity, string_agg(tag, ', ' ORDER BY tag) AS detail FROM g JOIN t USING (tag) GROUP BY g HAVING count(*) > 1""")
def q_similar_tags(spark, d):
    tags = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("tag"))
    return quality.similar_tags(tags, TAG_GROUPS)


@query("""WITH l AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS x FROM (SELECT doc_id, string_split(translate(text, '"', ' '), chr(10)) AS l FROM documents)),
b AS (SELECT doc_id, i // 4 AS ord, max(x) FILTER (WHERE i % 4 = 0) AS claim, max(x) FILTER (WHERE i % 4 = 1) AS evidence, max(x) FILTER (WHERE i % 4 = 2) AS source, max(x) FILTER (WHERE i % 4 = 3) AS status FROM l GROUP BY 1, 2)
SELECT 'd' || doc_id AS path, ord, trim(claim) AS claim, trim(evidence) AS evidence, trim(source) AS source, CASE WHEN trim(coalesce(status, '')) = '' THEN 'unverified' ELSE lower(trim(status)) END AS status FROM b""")
def f_claim_blocks(spark, d):
    """Every four lines of a document as a claim, its quoted evidence, its source and its status."""
    head = lambda x, i: F.concat(F.when(i % 4 == 0, "CLAIM: ").when(i % 4 == 1, 'EVIDENCE: "').when(i % 4 == 2, "SOURCE: ").otherwise("STATUS: "), x, F.when(i % 4 == 1, '"').otherwise(""))
    x = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.array_join(F.transform(F.split(F.translate("text", '"', " "), "\n", -1), head), "\n").alias("text"))
    return claims.parsed(x).select("path", "ord", "claim", "evidence", "source", "status")


_TYPES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in graph.DIRECTORY_TYPES.items())


@query(f"""WITH c AS (SELECT page_id, CASE regexp_extract(url, 'example\\.([a-z]+)', 1) WHEN 'com' THEN 'concepts' WHEN 'net' THEN 'references' ELSE regexp_extract(html, 'lang="([a-z]+)"', 1) END AS f, lower(trim(regexp_extract(html, '<a href="/([^"]*)"', 1))) AS said FROM pages)
SELECT page_id, CASE WHEN CASE f {_TYPES} END IS NOT NULL THEN CASE WHEN said IN ({", ".join(f"'{x}'" for x in graph.NODE_TYPES)}) THEN said ELSE CASE f {_TYPES} END END ELSE coalesce(nullif(said, ''), f) END AS type FROM c""")
def p_node_types(spark, d):
    """Pages in folders by their site or language, declared as what their first anchor says."""
    folder = F.when(F.col("url").rlike(r"example\.com"), "concepts").when(F.col("url").rlike(r"example\.net"), "references").otherwise(F.regexp_extract("html", 'lang="([a-z]+)"', 1))
    return table(spark, d, "pages").select("page_id", graph.node_type(F.concat(F.lit("wiki/"), folder, F.lit("/x.md")), F.regexp_extract("html", '<a href="/([^"]*)"', 1)).alias("type"))


@query("SELECT c_name AS name, c_mktsegment AS path FROM customer WHERE c_acctbal > 0 AND c_nationkey > 3 AND c_name NOT IN ('Customer#000000007', 'Customer#000000011')")
def s_registry(spark, d):
    """Customers with money as enabled knowledge bases, those of later nations as indexed."""
    kbs = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("path"), (F.col("c_acctbal") > 0).alias("enabled"), (F.col("c_nationkey") > 3).alias("has_index"))
    return corpus.registry(kbs, ("Customer#000000007", "Customer#000000011")).select("name", "path")


@query("""SELECT c_name AS slug, CASE WHEN c_name = 'Customer#000000005' THEN 'topics/.archive/' || c_name ELSE c_mktsegment END AS path, CASE WHEN c_name = 'Customer#000000005' THEN 'archived' ELSE 'active' END AS status, CASE WHEN c_name = 'Customer#000000005' THEN '2024-06-01' END AS archived, CASE WHEN c_name = 'Customer#000000005' THEN 'done' END AS archive_reason FROM customer""")
def k_archive(spark, d):
    none = F.lit(None).cast("string")
    t = table(spark, d, "customer").select(F.col("c_name").alias("slug"), F.col("c_mktsegment").alias("path"), F.lit("active").alias("status"), none.alias("archived"), none.alias("archive_reason"))
    return corpus.archive(t, "Customer#000000005", "done", "2024-06-01")


@query("SELECT lang AS collection, source AS detector, count(*) AS n FROM documents WHERE contains(text, '|') GROUP BY 1, 2")
def g_issue_counts(spark, d):
    """Documents with a bar as issues, by language and source."""
    return rules.counts_by(table(spark, d, "documents").where(F.contains("text", F.lit("|"))).select(F.col("lang").alias("collection"), F.col("source").alias("detector")), "collection", "detector")


@query("""WITH s AS (SELECT count(*) AS docs, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE contains(text, '|')) AS bars FROM documents)
SELECT 0 AS ord, 'many' AS code, docs || ' documents' AS text FROM s WHERE docs > 10 UNION ALL SELECT 1, 'bars', bars || ' of them with bars' FROM s WHERE bars > 0 AND bars < docs""")
def q_hints(spark, d):
    """Hints on a state that is counted over all documents; the rule in the middle doesn't hold."""
    state = table(spark, d, "documents").agg(F.count("*").alias("docs"), F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.contains("text", F.lit("|"))).alias("bars"))
    rules_ = [("many", "docs > 10", "concat(docs, ' documents')"), ("english", "en = docs", "'all English'"), ("bars", "bars > 0 and bars < docs", "concat(bars, ' of them with bars')")]
    return stats.hints(state, rules_).select("ord", "code", "text")


@query("""WITH r AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')[1:12]) AS ref FROM documents),
n AS (SELECT a.conv_id AS anchor, d.doc_id AS paper_id, d.n_chars AS score FROM conversations a JOIN documents d ON d.doc_id % 50 = a.conv_id % 50 AND d.doc_id <> a.conv_id WHERE a.turn = 0),
k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, paper_id) <= 20)
SELECT k.anchor, k.paper_id, count(*) AS shared FROM k JOIN r x ON x.doc_id = k.anchor JOIN r y ON y.doc_id = k.paper_id AND x.ref = y.ref GROUP BY 1, 2 HAVING count(*) >= 3""")
def r_shared_references(spark, d):
    """Documents as papers that refer to their first words, near the conversations of like numbers."""
    docs = table(spark, d, "documents")
    refs = docs.select(F.col("doc_id").alias("paper_id"), F.explode(F.slice(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1), 1, 12)).alias("ref_id")).withColumn("ref_title", F.col("ref_id"))
    a = table(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("anchor"), (F.col("conv_id") % 50).alias("group"))
    papers = docs.select(F.col("doc_id").alias("paper_id"), (F.col("doc_id") % 50).alias("group"), F.col("n_chars").alias("score"), F.lit(2024).alias("year"))
    # no citation and no year leaves any of them out below, so no more are needed
    near = radar.group_neighbours(a, papers, 20)
    none = spark.createDataFrame([], "cited_id long, citing_id long")
    return radar.citation_gap(near, refs, none, 2020).drop("shared_titles")
