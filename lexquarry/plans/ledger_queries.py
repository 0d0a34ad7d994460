"""Radar, ledger, bibliography, quality and statistics queries over the star tables and documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions import text as t
from lexquarry.operators import bibliography, ledger, quality, radar, stats
from lexquarry.operators.graph import first_wins
from lexquarry.plans.adapters import candidates, log, table
from lexquarry.sources import corpus, records

Q, SQL = {}, {}


def query(sql: str):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_CAND = """WITH cand AS MATERIALIZED (SELECT 'c' || o_orderkey % 5000 AS id, 'x' || o_custkey AS arxiv_id, year(o_orderdate) AS year, CASE WHEN o_orderpriority LIKE '1%' THEN 'arxiv-new:cs' WHEN o_orderpriority LIKE '2%' THEN 'arxiv-new:math' ELSE 's2-recommendation' END AS source,
  CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice / 1000000, 4) END AS score, o_orderkey AS ord FROM orders),
fresh AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN source = 's2-recommendation' THEN 0 ELSE 1 END, ord) AS r FROM cand
  WHERE id NOT IN (SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 3 = 0) AND arxiv_id NOT IN (SELECT 'x' || c_custkey FROM customer WHERE c_custkey % 5 = 0)) WHERE r = 1)
"""


def _fresh(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    seen = c.where("c_custkey % 3 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    library = c.where("c_custkey % 5 = 0").select(F.concat(F.lit("x"), F.col("c_custkey").cast("string")).alias("arxiv_id"))
    return radar.fresh(candidates(spark, d), seen, library)


@query(_CAND + "SELECT id, arxiv_id, year, source, score, ord FROM fresh")
def c4_fresh_candidates(spark, d):
    return _fresh(spark, d).select("id", "arxiv_id", F.col("year").cast("long").alias("year"), "source", "score", "ord")


@query(_CAND + "SELECT id, score FROM fresh WHERE (score IS NULL OR score >= 0.2) AND coalesce(year, 0) >= 1996")
def c4_relevant_recent(spark, d):
    return radar.recent(radar.relevant(_fresh(spark, d), 0.2), 1996).select("id", "score")


@query(_CAND + """, o AS (SELECT *, CASE WHEN source = 's2-recommendation' THEN 0 ELSE 1 END AS so FROM fresh),
res AS (SELECT id FROM o WHERE source LIKE 'arxiv-new%' ORDER BY coalesce(score, -1) DESC, so, ord LIMIT 20),
rest AS (SELECT id, row_number() OVER (ORDER BY coalesce(score, -1) DESC, so, ord) AS r FROM o WHERE id NOT IN (SELECT id FROM res))
SELECT id, source, score FROM fresh WHERE id IN (SELECT id FROM res UNION ALL SELECT id FROM rest WHERE r <= 40 - (SELECT count(*) FROM res))""")
def c4_budget(spark, d):
    return radar.budgeted(_fresh(spark, d), 40).select("id", "source", "score")


@query("""WITH s AS (SELECT o_orderpriority AS report, o_orderkey AS id, round(o_totalprice, 2) AS score FROM orders), x AS (SELECT *, count(*) OVER (PARTITION BY report) AS n, (rank() OVER (PARTITION BY report ORDER BY score) - 1)::DOUBLE AS b FROM s)
SELECT report, id, score, round(b / n, 6) AS share, CASE WHEN b / n >= 0.75 THEN 'top' WHEN b / n >= 0.4 THEN 'mid' ELSE 'low' END AS tier FROM x WHERE n >= 4""")
def c4_percent_tiers(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderpriority").alias("report"), F.col("o_orderkey").alias("id"), F.round("o_totalprice", 2).alias("score"))
    return radar.percent_tiers(s).withColumn("share", F.round("share", 6))


_TRIAGE = """WITH tl AS (SELECT 'r' || user_id % 20 AS report, 'p' || event_id % 97 AS id, CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'click' THEN 'dismiss' WHEN 'view' THEN 'task' WHEN 'error' THEN 'reset' END AS decision, event_id AS o FROM events),
st AS (SELECT report, id, decision FROM (SELECT *, row_number() OVER (PARTITION BY report, id ORDER BY o DESC) AS r FROM tl) WHERE r = 1 AND decision <> 'reset')
"""


def _triage(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "accept").when(F.col("event_type") == "click", "dismiss").when(F.col("event_type") == "view", "task").when(F.col("event_type") == "error", "reset")
    return e.select(F.concat(F.lit("r"), (F.col("user_id") % 20).cast("string")).alias("report"), F.concat(F.lit("p"), (F.col("event_id") % 97).cast("string")).alias("id"), kind.alias("decision"), F.col("event_id").alias("offset"))


@query(_TRIAGE + "SELECT * FROM st")
def c4_triage_state(spark, d):
    return radar.triage_state(_triage(spark, d))


@query(_TRIAGE + "SELECT report, count(*) AS candidates, sum((decision IS NULL)::INT)::BIGINT AS untriaged FROM (SELECT DISTINCT report, id FROM tl) LEFT JOIN st USING (report, id) GROUP BY 1")
def c4_untriaged(spark, d):
    x = _triage(spark, d)
    return radar.untriaged(x.select("report", "id").distinct(), radar.triage_state(x))


@query("""WITH refs AS (SELECT DISTINCT o_custkey AS p, l_partkey % 200 AS r FROM orders JOIN lineitem ON l_orderkey = o_orderkey), nb AS (SELECT DISTINCT o_custkey % 20 AS anchor, o_custkey AS p, max(year(o_orderdate)) OVER (PARTITION BY o_custkey) AS y, max(o_totalprice) OVER (PARTITION BY o_custkey) AS s FROM orders WHERE o_custkey >= 20),
c AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY s DESC, p) AS k FROM nb WHERE y >= 1996 AND NOT (p % 20 = anchor AND p % 3 = 0))
SELECT anchor, c.p AS paper_id, count(*) AS shared, array_to_string(list_slice(list(DISTINCT lpad(a.r::VARCHAR, 3, '0') ORDER BY lpad(a.r::VARCHAR, 3, '0')), 1, 5), ' ') AS shared_titles FROM c JOIN refs a ON a.p = c.p JOIN refs b ON b.p = c.anchor AND b.r = a.r WHERE k <= 20 GROUP BY 1, 2 HAVING count(*) >= 3""")
def c4_citation_gap(spark, d):
    """Customers as papers and parts as references: near an anchor, sharing parts with it, not citing it."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    r = F.col("l_partkey") % 200
    refs = o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("paper_id"), r.alias("ref_id"), F.lpad(r.cast("string"), 3, "0").alias("ref_title"))
    near = o.where("o_custkey >= 20").groupBy((F.col("o_custkey") % 20).alias("anchor"), F.col("o_custkey").alias("paper_id")).agg(F.max(F.year("o_orderdate")).alias("year"), F.max("o_totalprice").alias("score"))
    cites = near.where("paper_id % 3 = 0").select(F.col("anchor").alias("cited_id"), F.col("paper_id").alias("citing_id"))
    return radar.citation_gap(near, refs, cites, 1996).withColumn("shared_titles", F.array_join("shared_titles", " "))


@query("SELECT * FROM (SELECT o_custkey AS id, min(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END * 10000000 + o_orderkey) AS at FROM orders GROUP BY 1 ORDER BY 2 LIMIT 50)")
def c4_seeds(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ord"), "o_orderstatus")
    ids = radar.seeds(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"))
    at = o.groupBy("id").agg(F.min(F.when(F.col("o_orderstatus") == "F", 0).otherwise(1) * 10000000 + F.col("ord")).alias("at"))
    return at.join(ids, "id")


_LOG = """WITH lg AS MATERIALIZED (SELECT event_id AS o, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'item' WHEN 'purchase' THEN 'decision' WHEN 'error' THEN 'decision' ELSE 'commit' END AS kind, user_id || '-' || event_id % 20 AS req_id, 'b' || user_id AS batch_id, 'i' || event_id % 20 AS item_id, props,
  ['arxiv-html', 'tex', 'textlayer', 'mineru', 'ocr'][event_id % 5 + 1] AS route, CASE WHEN event_type = 'view' THEN (event_id % 20)::VARCHAR END AS title, CASE WHEN value > 90 THEN 'late' END AS error,
  CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'approve' ELSE 'reject' END WHEN event_type = 'error' THEN 'reset' END AS decision, CASE WHEN event_type = 'click' THEN 'wiki/' || event_id % 20 END AS path FROM events),
it AS MATERIALIZED (SELECT batch_id, item_id, min(o) AS o, arg_min(req_id, o) AS req_id, arg_min(route, o) AS route, arg_min(coalesce(error, ''), o) AS error FROM lg WHERE kind = 'item' GROUP BY 1, 2),
de AS (SELECT batch_id, item_id, arg_max(decision, o) AS decision, max(o) AS dat FROM lg WHERE kind = 'decision' GROUP BY 1, 2), co AS (SELECT batch_id, item_id, arg_max(path, o) AS path FROM lg WHERE kind = 'commit' GROUP BY 1, 2),
st AS MATERIALIZED (SELECT it.batch_id, it.item_id, req_id, route, nullif(error, '') AS error, CASE WHEN dat > it.o AND decision <> 'reset' THEN decision END AS decision, path AS committed_path, it.o AS "offset" FROM it LEFT JOIN de USING (batch_id, item_id) LEFT JOIN co USING (batch_id, item_id))
"""


def _items(spark, d) -> DataFrame:
    return ledger.batch_items(log(spark, d))


@query(_LOG + "SELECT req_id, o AS \"offset\", route FROM lg WHERE kind = 'enqueue' AND req_id NOT IN (SELECT req_id FROM lg WHERE kind = 'item')")
def c5_pending(spark, d):
    return ledger.pending(log(spark, d)).select("req_id", "offset", "route")


@query(_LOG + "SELECT * FROM st")
def c5_batch_items(spark, d):
    return _items(spark, d).select("batch_id", "item_id", "req_id", "route", "error", "decision", "committed_path", "offset")


@query(_LOG + "SELECT batch_id, count(*) AS items, sum((decision IS NULL AND committed_path IS NULL)::INT)::BIGINT AS undecided, count(committed_path) AS committed, count(error) AS failed FROM st GROUP BY 1")
def c5_batch_counts(spark, d):
    return ledger.batch_counts(_items(spark, d))


@query(_LOG + "SELECT batch_id, bool_and(decision IS NOT NULL OR committed_path IS NOT NULL) AS eligible FROM st GROUP BY 1")
def c5_settled(spark, d):
    return ledger.settled(_items(spark, d))


@query(_LOG + "SELECT 'enqueue' AS kind, batch_id || ':' || item_id || ':' || n AS req_id, n AS route, req_id AS retry_of FROM (SELECT *, CASE route WHEN 'arxiv-html' THEN 'tex' WHEN 'tex' THEN 'textlayer' WHEN 'textlayer' THEN 'mineru' WHEN 'mineru' THEN 'ocr' END AS n FROM st WHERE decision = 'reject') WHERE n IS NOT NULL")
def c5_retries(spark, d):
    return ledger.retries(_items(spark, d))


@query(_LOG + "SELECT batch_id, item_id FROM st WHERE decision = 'approve' AND committed_path IS NULL AND error IS NULL")
def c5_committable(spark, d):
    return ledger.committable(_items(spark, d)).select("batch_id", "item_id")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 40")
def c5_last_rows(spark, d):
    return ledger.last_rows(table(spark, d, "events").withColumn("offset", F.col("event_id")), "user_id").select("event_id", "user_id")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 10 <> 0")
def s_json_lines(spark, d):
    """Lines of JSON of which every tenth is cut off."""
    e = table(spark, d, "events")
    lines = e.select(F.when(F.col("event_id") % 10 == 0, F.expr("substring(concat('{\"event_id\": ', event_id, ', \"props\": ', props, '}'), 1, 15)")).otherwise(F.expr("concat('{\"event_id\": ', event_id, ', \"props\": ', props, '}')")).alias("value"))
    return records.parsed_lines(lines, "event_id long, props struct<k: long>").select("event_id", "props.k")


_EAV = """WITH f(fid, name) AS (VALUES (1, 'title'), (2, 'DOI'), (3, 'url'), (4, 'extra'), (5, 'archiveID'), (6, 'date')),
it AS (SELECT o_orderkey AS id, o_orderkey % 4 AS ty, o_orderdate AS added FROM orders)
"""


def _eav(spark, d):
    """orders as items and lineitems as attribute values."""
    o = table(spark, d, "orders")
    item = o.select(F.col("o_orderkey").alias("itemID"), (F.col("o_orderkey") % 4).cast("int").alias("itemTypeID"), F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderdate").cast("string").alias("dateAdded"))
    types = spark.createDataFrame([(0, "journalArticle"), (1, "book"), (2, "attachment"), (3, "preprint")], "itemTypeID int, typeName string")
    fields = spark.createDataFrame(list(enumerate(bibliography.FIELDS, 1)), "fieldID int, fieldName string")
    # orders repeat line numbers: a value's number also holds its row's place, of which the first one wins: files by name,
    # counted from the last one (a row for each file), then rows
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.col("_metadata.file_path").alias("file"), (-F.col("_metadata.row_index")).alias("row"))
    files = li.select("file").distinct().select("file", F.row_number().over(Window.orderBy(F.desc("file"))).alias("place"))
    li = li.join(F.broadcast(files), "file").withColumn("valueID", F.struct("l_orderkey", "l_linenumber", "place", "row"))
    data = li.select(F.col("l_orderkey").alias("itemID"), (F.col("l_linenumber") % 6 + 1).alias("fieldID"), "valueID")
    values = li.select("valueID", F.concat(F.lit("v"), F.col("l_partkey").cast("string")).alias("value"))
    return item, types, data, fields, values


@query(_EAV + """, v AS (SELECT l_orderkey AS id, l_linenumber % 6 + 1 AS fid, arg_max('v' || l_partkey, l_linenumber) AS v FROM lineitem GROUP BY 1, 2)
SELECT id AS item_id, CASE ty WHEN 0 THEN 'journalArticle' WHEN 1 THEN 'book' ELSE 'preprint' END AS item_type, max(v) FILTER (WHERE fid = 1) AS title, max(v) FILTER (WHERE fid = 2) AS doi, max(v) FILTER (WHERE fid = 5) AS archive_id FROM it LEFT JOIN v USING (id) WHERE ty <> 2 GROUP BY 1, 2""")
def s_library_items(spark, d):
    return bibliography.items(*_eav(spark, d)).select("item_id", "item_type", "title", "doi", "archive_id")


@query("SELECT n_nationkey AS \"collectionID\", n_name AS \"collectionName\", count(c_custkey) AS items FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_custkey % 2 = 0 GROUP BY 1, 2")
def s_collection_sizes(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("collectionID"), F.col("n_name").alias("collectionName"), F.col("n_regionkey").alias("parentCollectionID"))
    m = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_nationkey").alias("collectionID"), F.col("c_custkey").alias("itemID"))
    return bibliography.collection_sizes(n, m).select("collectionID", "collectionName", "items")


@query("SELECT o_orderkey AS item_id, min_path AS pdf_path FROM (SELECT o_custkey % 500 AS o_orderkey, arg_min('f' || o_orderkey || '.pdf', o_orderkey) AS min_path FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 GROUP BY 1)")
def s_attachments(spark, d):
    o = table(spark, d, "orders")
    path = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "linked:").otherwise("storage:"), F.lit("f"), F.col("o_orderkey").cast("string"), F.lit(".pdf"))
    rows = o.select(F.col("o_orderkey").alias("itemID"), (F.col("o_custkey") % 500).alias("parentItemID"), F.when(F.col("o_orderkey") % 5 == 0, "text/html").when(F.col("o_orderkey") % 2 == 0, "application/pdf").alias("contentType"), path.alias("path"))
    return bibliography.attachments(rows)


@query("SELECT count(*) AS total, sum((o_orderkey % 3 = 0)::INT)::BIGINT AS arxiv, sum((o_orderkey % 2 = 0)::INT)::BIGINT AS doi, sum((o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0)::INT)::BIGINT AS doi_only, sum((o_orderkey % 3 <> 0 AND o_orderkey % 2 <> 0)::INT)::BIGINT AS neither, sum((o_orderkey % 5 = 0)::INT)::BIGINT AS pdf, sum((o_orderkey % 3 <> 0 AND o_orderkey % 2 <> 0 AND o_orderkey % 5 = 0)::INT)::BIGINT AS pdf_only FROM orders")
def c7_library_coverage(spark, d):
    k = F.col("o_orderkey")
    x = table(spark, d, "orders").select(F.when(k % 3 == 0, F.concat(F.lit("arXiv:2401."), F.lpad((k % 100000).cast("string"), 5, "0"))).alias("archive_id"), F.lit(None).cast("string").alias("extra"), F.lit(None).cast("string").alias("url"), F.when(k % 2 == 0, F.concat(F.lit("10.1000/"), k.cast("string"))).alias("doi"), F.when(k % 5 == 0, "f.pdf").alias("pdf_path"))
    return bibliography.coverage(bibliography.identified(x))


_DOCS = """WITH md AS MATERIALIZED (SELECT doc_id, 'wiki/' || CASE WHEN doc_id % 2 = 0 THEN 'concepts' ELSE 'references' END || '/d' || doc_id || '.md' AS path, doc_id % 4 AS m, text FROM documents)
"""


def _markdown(spark, d) -> DataFrame:
    """documents as cards with frontmatter; some lack a field, some are old, all link to a document that may be missing."""
    x = table(spark, d, "documents")
    k = F.col("doc_id")
    path = F.concat(F.lit("wiki/"), F.when(k % 2 == 0, "concepts").otherwise("references"), F.lit("/d"), k.cast("string"), F.lit(".md"))
    head = F.concat(F.lit("---\ntitle: D"), k.cast("string"), F.lit("\ncategory: x\ncreated: 2024-01-01\nupdated: "), F.date_add(F.lit("2024-01-01").cast("date"), (k % 400).cast("int")).cast("string"), F.lit("\ntags: [a, \"b,c\"]\nvolatility: "), F.element_at(F.array(F.lit("hot"), F.lit("warm"), F.lit("cold")), (k % 3 + 1).cast("int")), F.when(k % 4 == 0, "").otherwise("\nsummary: s"), F.lit("\n---\n"))
    return x.select("doc_id", path.alias("path"), F.concat(head, F.lit("[[d"), (k * 2).cast("string"), F.lit("]] "), F.coalesce("text", F.lit("")), F.when(k % 10 == 0, "\n$$\n").otherwise("\n")).alias("raw_text"))


@query(_DOCS + "SELECT path, 'missing-field' AS code, 'critical' AS severity, 'summary' AS detail FROM md WHERE m = 0")
def c6_missing_fields(spark, d):
    return quality.missing_fields(_markdown(spark, d))


@query(_DOCS + "SELECT path, 'broken-link' AS code, 'warning' AS severity, 'd' || doc_id * 2 AS detail FROM md WHERE doc_id * 2 NOT IN (SELECT doc_id FROM md)")
def c6_broken_wikilinks(spark, d):
    return quality.broken_wikilinks(_markdown(spark, d))


@query(_DOCS + ", a AS (SELECT path, date_diff('day', DATE '2024-01-01' + (doc_id % 400)::INTEGER, DATE '2024-12-31') AS age, [30, 180, 365][doc_id % 3 + 1] AS lim FROM md) SELECT path, 'stale-article' AS code, 'warning' AS severity, age::VARCHAR AS detail FROM a WHERE age > lim")
def c6_stale_articles(spark, d):
    return quality.stale(_markdown(spark, d), "2024-12-31")


@query(_DOCS + "SELECT path, 'orphan-math' AS code, 'warning' AS severity, '1' AS detail FROM md WHERE doc_id % 10 = 0")
def c6_orphan_math(spark, d):
    return quality.orphan_math(_markdown(spark, d))


def _conversions(spark, d) -> DataFrame:
    x = table(spark, d, "documents")
    k = F.col("doc_id")
    md = F.concat(F.coalesce("text", F.lit("")), F.when(k % 3 == 0, " \\cite{a} and \\ref{b}").otherwise(""), F.when(k % 5 == 0, " ![x](figs/a.png)").otherwise(""))
    return x.select(k.cast("string").alias("path"), md.alias("md"), F.when(k % 11 == 0, F.lit(b"%PDF-1.4")).otherwise(F.lit(b"\\doc")).alias("payload"), F.lit(None).cast("string").alias("tex_source"), (k % 4).cast("int").alias("figures_referenced"), F.lit(2).alias("figures_resolved"), F.lit(None).cast("string").alias("expected_arxiv_id"))


@query(r"""WITH x AS (SELECT doc_id, doc_id::VARCHAR AS path, len(regexp_extract_all(coalesce(text, ''), '\S+')) + CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS n FROM documents)
SELECT path, 'payload-is-pdf' AS code, 'block' AS severity, 'the payload is a PDF' AS detail FROM x WHERE doc_id % 11 = 0 UNION ALL SELECT path, 'suspiciously-short', 'flag', n::VARCHAR FROM x WHERE n < 100
UNION ALL SELECT path, 'leftover-tex', 'flag', '2' FROM x WHERE doc_id % 3 = 0 UNION ALL SELECT path, 'figure-count-mismatch', 'flag', '1' FROM x WHERE doc_id % 4 = 3
UNION ALL SELECT path, 'image-references', 'block', 'elsewhere' FROM x WHERE doc_id % 5 = 0 UNION ALL SELECT path, 'no-frontmatter', 'flag', 'no frontmatter' FROM x""")
def c6_conversion_gates(spark, d):
    return quality.conversion_gates(_conversions(spark, d))


@query("""SELECT sum((doc_id % 11 = 0)::INT + (doc_id % 5 = 0)::INT)::BIGINT AS critical FROM documents""")
def c6_findings_summary(spark, d):
    return quality.summary(quality.conversion_gates(_conversions(spark, d))).select("critical")


@query("SELECT 'b' || user_id AS path, event_id AS line, (SELECT max(e2.event_id) FROM events e2 WHERE e2.user_id = e.user_id AND e2.event_type = 'view' AND e2.event_id BETWEEN e.event_id - 99 AND e.event_id) AS source_line FROM events e WHERE event_type = 'error'")
def c6_error_lines(spark, d):
    """The last view before each error of a user, at most 99 events back: a backward as-of join with tolerance."""
    e = table(spark, d, "events").select(F.concat(F.lit("b"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("line"), "event_type")
    views = e.where("event_type = 'view'").select("path", "line", F.col("line").alias("source_line"))
    return quality.compile_errors(e.where("event_type = 'error'").select("path", "line", F.lit("e").alias("error")), views, 99).select("path", "line", "source_line")


@query("SELECT 'raw/' || source || '/d' || doc_id || '.md' AS path FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 1")
def c7_uncompiled(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.concat(F.lit("raw/"), "source", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    refs = x.where("doc_id % 3 = 0").select(F.concat(F.lit("wiki/references/r"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("path").alias("source"))
    by_name = x.where("doc_id % 5 = 1").select(F.concat(F.lit("wiki/references/D"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit(None).cast("string").alias("source"))
    return stats.uncompiled(x.select("path"), refs.union(by_name))


@query("SELECT doc_id::VARCHAR AS path, 'orphan-source' AS code, 'warning' AS severity, 'not referenced' AS detail FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def c6_unlabelled(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.array().cast("array<string>").alias("tags"))
    return quality.unreferenced(x, table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("source")))


@query("SELECT source AS directory, count(*) AS files, max(doc_id) AS newest FROM documents GROUP BY 1")
def c7_tree(spark, d):
    x = table(spark, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").alias("mtime"))
    return stats.tree(x)


@query(r"""SELECT doc_id::VARCHAR AS path, len(string_split(text, chr(10)))::BIGINT AS lines, len(regexp_extract_all(text, '\S+'))::BIGINT AS words FROM documents""")
def c7_document_map(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    m = stats.document_map(x).select("path", F.col("lines").cast("long").alias("lines"))
    return m.join(stats.concept_density(x.select("path", F.regexp_replace("text", r"[$`]", "x").alias("text"))).select("path", F.col("words").cast("long").alias("words")), "path")


@query("SELECT round(sum(w * s) / sum(w), 3) AS sync_ratio FROM (SELECT l_linenumber::DOUBLE AS w, l_discount AS s FROM lineitem WHERE l_linenumber < 5)")
def c7_sync_ratio(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("double").alias("weight"), F.when(F.col("l_linenumber") < 5, F.col("l_discount")).alias("score"))
    return stats.sync_ratio(s)


@query("SELECT sum((o_orderstatus = 'O' AND o_orderkey % 4 <> 0)::INT)::BIGINT AS ready, sum((o_orderstatus = 'P')::INT)::BIGINT AS in_progress, sum((o_orderkey % 4 = 0 AND o_orderstatus <> 'F')::INT)::BIGINT AS blocked, sum((o_orderstatus <> 'F')::INT)::BIGINT AS open FROM orders")
def c7_task_counts(spark, d):
    s = F.col("o_orderstatus")
    return stats.task_counts(table(spark, d, "orders").select(F.when(s == "O", "open").when(s == "P", "in_progress").otherwise("closed").alias("status"), F.when(F.col("o_orderkey") % 4 == 0, 1).otherwise(0).alias("blocked_by")))


@query("SELECT n_name AS slug, CASE WHEN n_nationkey % 2 = 0 THEN 'active' ELSE 'unregistered' END AS status FROM nation WHERE n_nationkey % 6 <> 0")
def s_topics(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("slug"), F.concat(F.lit("topics/"), "n_name").alias("path"))
    registered = n.where("n_nationkey % 2 = 0").select("slug", "path", F.when(F.col("n_nationkey") % 6 == 0, "archived").otherwise("active").alias("status"))
    return corpus.topics(registered, n.select("slug", "path")).select("slug", "status")


@query("SELECT c_custkey AS ord, c_mktsegment || CASE WHEN r = 1 THEN '' ELSE '-' || r END AS given FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer)")
def s_unique_names(spark, d):
    return corpus.unique_names(table(spark, d, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("name"))).select("ord", "given")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def w_first_wins(spark, d):
    return first_wins(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def z_windowed_counts(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 4) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def n7_sql_passthrough(spark, d):
    from lexquarry.operators.sqlviews import read_only

    return read_only(spark, "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 4) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2", {"lineitem": table(spark, d, "lineitem")})


@query("SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def n7_sql_joins(spark, d):
    from lexquarry.operators.sqlviews import read_only

    views = {n: table(spark, d, n) for n in ("region", "nation", "customer")}
    return read_only(spark, "SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2", views)


@query(r"""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'external' WHEN 1 THEN 'absolute' WHEN 2 THEN 'backslash' WHEN 3 THEN 'escaping' WHEN 4 THEN 'bare' WHEN 5 THEN 'elsewhere' WHEN 6 THEN 'nested' ELSE 'portable' END AS kind FROM orders""")
def f_image_kinds(spark, d):
    forms = ["https://x/a.png", "C:/a.png", "img\\a.png", "images/../a.png", "a.png", "figs/a.png", "images/x/a.png", "images/a.png"]
    return table(spark, d, "orders").select("o_orderkey", t.image_kind(F.element_at(F.array(*map(F.lit, forms)), (F.col("o_orderkey") % 8 + 1).cast("int"))).alias("kind"))


@query("SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id ORDER BY turn) AS seen, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations")
def w_context(spark, d):
    """Each turn with its neighbours."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.count("*").over(w).alias("seen"), F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"))
