"""Staged records, identifiers, citations, statistics and link rules over the test tables, and their SQL.

The tables' keys make up the records' texts, so that each case of a rule occurs and SQL can name its result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexquarry.functions import text as t
from lexquarry.functions import vectors as v
from lexquarry.operators import bibliography, claims, quality, stats
from lexquarry.plans.adapters import table
from lexquarry.sources import records

Q, SQL = {}, {}


def query(sql: str):
    def put(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


def _text(*parts):
    return F.concat(*(p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts))


def _serial(k):
    return F.lpad((k % 100000).cast("string"), 5, "0")


@query("""SELECT p_partkey, p_partkey % 2 = 0 AS legacy, 'https://arxiv.org/abs/' || CASE WHEN p_partkey % 2 = 0 THEN 'hep-th/' || lpad(p_partkey::VARCHAR, 7, '0') ELSE '2405.' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') END AS url FROM part""")
def f_abs_urls(spark, d):
    """Identifiers of both schemes as addresses."""
    k = F.col("p_partkey")
    i = F.when(k % 2 == 0, F.concat(F.lit("hep-th/"), F.lpad(k.cast("string"), 7, "0"))).otherwise(F.concat(F.lit("2405."), _serial(k)))
    return table(spark, d, "part").select(k, t.is_legacy_arxiv(i).alias("legacy"), t.abs_url(i).alias("url"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '2405.' || s WHEN 1 THEN '2301.' || s END AS arxiv_id, CASE p_partkey % 3 WHEN 0 THEN '10.1000/x' || p_partkey WHEN 1 THEN '10.48550/arxiv.2301.' || s END AS doi,
CASE WHEN p_partkey % 3 = 2 THEN '' ELSE 'text' END AS source FROM (SELECT p_partkey, lpad((p_partkey % 100000)::VARCHAR, 5, '0') AS s FROM part)""")
def f_identities(spark, d):
    """What a text says about its paper: an identifier and a DOI, a DOI that holds an identifier, nothing."""
    k = F.col("p_partkey")
    x = F.when(k % 3 == 0, _text("see arXiv:2405.", _serial(k), "v2, doi 10.1000/X", k, ".")).when(k % 3 == 1, _text("at https://doi.org/10.48550/arXiv.2301.", _serial(k))).otherwise("no paper")
    return table(spark, d, "part").select(k, t.identity(x).alias("i")).select("p_partkey", "i.*")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'doi' ELSE 'url' END AS kind FROM part""")
def f_target_kinds(spark, d):
    k = F.col("p_partkey")
    x = F.when(k % 3 == 0, _text("2405.", _serial(k))).when(k % 3 == 1, _text("10.1000/x", k)).otherwise(_text("https://x.org/", k))
    return table(spark, d, "part").select(k, t.target_kind(x).alias("kind"))


@query("""SELECT c_custkey, concat_ws('|', c_name, 'X' || c_custkey, 'Y', 'Z') AS authors, 'Lattice ' || c_custkey AS name, 'a b ' || c_custkey AS snippet,
CASE WHEN c_custkey % 2 = 0 THEN rtrim(repeat('word ', 100)) || '…' ELSE 'short ' || c_custkey END AS ellipsized FROM customer""")
def f_names(spark, d):
    """Author lists, display names, and texts cut for display."""
    k = F.col("c_custkey")
    long = F.when(k % 2 == 0, F.repeat(F.lit("word "), F.lit(120))).otherwise(_text("short ", k))
    return table(spark, d, "customer").select(
        k, F.array_join(t.authors(_text(F.col("c_name"), "; X", k, " and Y, Z")), "|").alias("authors"), t.display_name(_text("lattice-", k)).alias("name"),
        t.snippet(_text("  a\n\tb   ", k, " ")).alias("snippet"), t.ellipsized(long).alias("ellipsized"))


@query("""SELECT s_suppkey AS item_id, '@' || CASE WHEN s_suppkey % 2 = 0 THEN 'article' ELSE 'misc' END || '{doe' || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '2004' END || ',' || chr(10) || concat_ws(',' || chr(10), '  title = {On \\{' || s_suppkey || '\\}}',
'  author = {Jane Doe and ' || s_name || '}', CASE WHEN s_suppkey % 3 <> 0 THEN '  year = {2004}' END, CASE WHEN s_suppkey % 2 = 0 THEN '  journal = {J}' END, CASE WHEN s_suppkey % 5 = 0 THEN '  doi = {10.1/' || s_suppkey || '}' END) || chr(10) || '}' AS entry FROM supplier""")
def k_bibtex(spark, d):
    """Suppliers as papers with and without a venue, a year and a DOI."""
    k = F.col("s_suppkey")
    x = table(spark, d, "supplier").select(
        k.alias("item_id"), _text("On {", k, "}").alias("title"), _text("Jane Doe and ", F.col("s_name")).alias("authors"), F.when(k % 3 != 0, "May 2004").alias("date"), F.when(k % 2 == 0, "J").alias("venue"),
        F.when(k % 5 == 0, _text("10.1/", k)).alias("doi"), F.lit(None).cast("string").alias("arxiv_id"))
    return bibliography.bibtex(x)


@query("""SELECT coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'x' || o_orderkey END, CASE WHEN o_orderkey % 3 = 0 THEN 'd' || o_orderkey END, 'p' || o_orderkey) AS id, 'T ' || o_orderkey AS title, CASE WHEN o_orderkey % 5 <> 0 THEN year(o_orderdate) END AS year, 'Ann|Bob' AS authors
FROM orders WHERE o_orderkey % 11 <> 0 AND NOT (o_orderkey % 5 = 0 AND o_orderkey % 2 <> 0 AND o_orderkey % 3 <> 0)""")
def s_recommendations(spark, d):
    """Orders as recommended papers: some without a title, some with nothing to know them by."""
    k = F.col("o_orderkey")
    name = lambda n: F.struct(F.lit(n).alias("name"))
    ids = F.struct(F.when(k % 2 == 0, _text("x", k)).alias("ArXiv"), F.when(k % 3 == 0, _text("d", k)).alias("DOI"))
    paper = F.struct(
        _text("p", k).alias("paperId"), F.when(k % 11 != 0, _text(" T  ", k)).otherwise(" ").alias("title"), F.when(k % 5 != 0, F.year("o_orderdate")).alias("year"), F.lit(None).cast("string").alias("abstract"),
        F.lit("").alias("url"), ids.alias("externalIds"), F.array(name("Ann"), name("Bob")).alias("authors"))
    out = records.recommendations(table(spark, d, "orders").select(k.alias("ord"), paper.alias("paper")))
    return out.select("id", "title", "year", F.array_join("authors", "|").alias("authors"))


@query("""SELECT '2405.' || lpad((c_custkey * 2 % 100000 + n)::VARCHAR, 5, '0') AS id, 'On ' || c_custkey AS title, 2024 AS year, 'Ann|Bob' AS authors FROM customer, (VALUES (0), (1)) AS e(n) WHERE n = 1 OR c_custkey % 4 <> 0""")
def s_feed_entries(spark, d):
    """Customers as feeds of two entries, the first of which is too old in every fourth."""
    k = F.col("c_custkey")
    entry = lambda n, day: _text("<entry><id>http://arxiv.org/abs/2405.", F.lpad((k * 2 % 100000 + n).cast("string"), 5, "0"), "v1</id><title>On\n  ", k, "</title><summary>s</summary><published>", day, "T12:00:00Z</published><author><name>Ann</name></author><author><name> Bob</name></author></entry>")
    x = table(spark, d, "customer").select(k.alias("ord"), _text("<feed>", entry(0, F.when(k % 4 == 0, "2023-01-02").otherwise("2024-05-02")), entry(1, F.lit("2024-05-03")), "</feed>").alias("xml"))
    return records.feed_entries(x, "2024-01-01", "cs").select("id", "title", "year", F.array_join("authors", "|").alias("authors"))


@query("""SELECT 'a' || c_custkey AS doi, 'p' || c_custkey AS paper FROM customer UNION ALL SELECT 'c' || c_custkey, 'r' || c_custkey FROM customer WHERE c_custkey % 2 = 0""")
def s_batch_lookup(spark, d):
    """Customers as requests for three DOIs, the second of which is never known."""
    k = F.col("c_custkey")
    x = table(spark, d, "customer").select(F.array(_text("a", k), _text("b", k), _text("c", k)).alias("dois"), F.array(_text("p", k), F.lit(None).cast("string"), F.when(k % 2 == 0, _text("r", k))).alias("papers"))
    return records.batch_lookup(x)


@query("""SELECT page_id, reason IS NULL AS ok, reason FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'redirected to the abstract' WHEN strlen(coalesce(html, '')) < 1000 THEN 'too short' WHEN NOT contains(html, 'alttext') THEN 'no formulas' END AS reason
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN html || ' alttext' ELSE html END AS html FROM pages))""")
def s_accepted_pages(spark, d):
    """Pages as served papers: a third are redirected, half hold a formula."""
    k = F.col("page_id")
    final = F.when(k % 3 == 0, "https://x.org/abs/1").otherwise("https://x.org/html/1")
    x = table(spark, d, "pages").select(k.alias("url"), final.alias("final_url"), F.when(k % 2 == 0, F.concat("html", F.lit(" alttext"))).otherwise(F.col("html")).alias("html"))
    return records.accepted_page(x, 1000).withColumnRenamed("url", "page_id")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'b_' || p_partkey || ' c' ELSE 'a_' || p_partkey END AS formulas FROM part""")
def s_tex_formulas(spark, d):
    """Annotations of formulas, else their alternative texts."""
    k = F.col("p_partkey")
    note = lambda x: _text('<annotation id="1" encoding="application/x-tex">', x, "</annotation>")
    page = _text('<math alttext="a_', k, '">', F.when(k % 2 == 0, F.concat(note(_text("b_", k)), note(F.lit("c")))).otherwise(""), "</math>")
    return table(spark, d, "part").select(k, F.array_join(t.tex_formulas(page), " ").alias("formulas"))


@query("""SELECT pdf, reason IS NULL AS usable, reason FROM (SELECT l_orderkey AS pdf, CASE WHEN avg(l_quantity * 10) < 200 THEN 'too little text' WHEN avg((l_linenumber % 2)::DOUBLE) > 0.5 THEN 'scanned pages' WHEN avg(CASE WHEN l_linenumber % 2 = 0 THEN 1.0 ELSE 0.0 END) > 0.5 THEN 'unmapped glyphs' END AS reason FROM lineitem GROUP BY 1)""")
def s_text_layer(spark, d):
    """Orders as papers whose lines are pages: few characters, images of whole pages, glyphs without characters."""
    odd = F.col("l_linenumber") % 2 == 1
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pdf"), (F.col("l_quantity") * 10).alias("chars"), F.when(odd, 1.0).otherwise(0.0).alias("image_share"), F.when(odd, "plain text").otherwise("(cid:12)(cid:3)").alias("text"))
    return records.text_layer(x)


@query("""SELECT l_orderkey AS doc, string_agg(l_returnflag || l_linenumber, chr(10) || chr(10) ORDER BY l_linenumber, l_returnflag) AS text FROM lineitem GROUP BY 1""")
def s_assembled_pages(spark, d):
    """Orders as papers whose lines are pages, put in the order of the numbers in their names, then of their texts."""
    n = F.col("l_linenumber")
    return records.assembled(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), _text("Page_", n, ".md").alias("name"), _text(F.col("l_returnflag"), n).alias("text")))


@query("SELECT DISTINCT user_id::VARCHAR AS id FROM events WHERE event_type NOT IN ('click', 'view')")
def s_seen_ids(spark, d):
    """Events as a ledger in which clicks have no id and views an empty one."""
    kind = F.col("event_type")
    return records.seen_ids(table(spark, d, "events").select(F.when(kind == "view", "").when(kind != "click", F.col("user_id").cast("string")).alias("id")))


@query("""SELECT lang AS directory, count(*) AS files, sum(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) AS without_sources, round(avg(len(regexp_extract_all(x, '\\[\\[([^\\]|]+)(?:\\|[^\\]]+)?\\]\\]')))::DOUBLE, 2) AS links_per_file
FROM (SELECT doc_id, lang, coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN ' [[a]] [[b|c]]' ELSE '' END AS x FROM documents) GROUP BY 1""")
def g_wiki_summary(spark, d):
    k = F.col("doc_id")
    x = table(spark, d, "documents").select(
        F.concat(F.lit("wiki/"), "lang", F.lit("/d.md")).alias("path"), F.concat(F.coalesce("text", F.lit("")), F.when(k % 2 == 0, " [[a]] [[b|c]]").otherwise("")).alias("text"),
        F.when(k % 3 == 1, F.array(F.lit("s"))).when(k % 3 == 2, F.array(F.lit("s"), F.lit("u"))).alias("sources"))
    return stats.summary(x)


@query("""SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 2 = 0 THEN 5 ELSE 4 END AS words, 1 AS links, CASE WHEN doc_id % 2 = 0 THEN 200.0 ELSE 250.0 END::DOUBLE AS per_1000 FROM documents""")
def g_concept_density(spark, d):
    """Links of texts with and without a formula, an environment and code, which don't count as words."""
    k = F.col("doc_id")
    x = F.concat(F.lit("one two [[c]] three"), F.when(k % 2 == 0, " $x + y$ four\n\\begin{align*}a b\\end{align*}").otherwise("\n```\ncode [[d]]\n```\n"))
    return stats.concept_density(table(spark, d, "documents").select(_text("d", k).alias("path"), x.alias("text")))


@query("""SELECT count(*) AS claims, sum(CASE WHEN o_orderkey % 6 < 3 THEN 1 ELSE 0 END) AS verified, sum(CASE WHEN o_orderkey % 6 = 3 THEN 1 ELSE 0 END) AS failed, sum(CASE WHEN o_orderkey % 6 > 3 THEN 1 ELSE 0 END) AS unusable FROM orders""")
def g_claim_results(spark, d):
    names = F.array(*map(F.lit, ("exact", "whitespace", "loose", "not-found", "malformed", "no-source")))
    return claims.result_counts(table(spark, d, "orders").select(F.get(names, (F.col("o_orderkey") % 6).cast("int")).alias("result")))


@query("""SELECT p_partkey, round(0.7 * CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.3 END + 0.3 * (p_partkey % 4) / 4.0, 3)::DOUBLE AS health, p_size > 2 * greatest(p_partkey % 10, 1) AS overdue FROM part""")
def g_retrieval_health(spark, d):
    """Parts as indexes, fresh or not, with four degrees of coverage, and as papers of an age and a window."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k, stats.retrieval_health(F.when(k % 2 == 0, 1.0).otherwise(0.3), (k % 4) / 4).alias("health"), stats.overdue(F.col("p_size"), k % 10).alias("overdue"))


@query("""SELECT lang || '/' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN 'stale-index' ELSE 'dead-index-entry' END AS code FROM documents WHERE (doc_id % 3 = 0) <> (doc_id % 4 = 0)""")
def q_index_gaps(spark, d):
    """Documents as files, a quarter of which are gone, and index entries, a third of which were never made."""
    x = table(spark, d, "documents").select("doc_id", F.col("lang").alias("folder"), F.col("doc_id").cast("string").alias("name"))
    return quality.index_gaps(x.where("doc_id % 3 <> 0").drop("doc_id"), x.where("doc_id % 4 <> 0").drop("doc_id")).select("path", "code")


@query("""SELECT 'raw/' || doc_id AS path, 'orphan-source' AS code FROM documents WHERE doc_id % 2 = 1 AND doc_id % 5 <> 0""")
def q_unreferenced(spark, d):
    """Documents as sources; the even ones are referred to, every fifth is a manifest."""
    k = F.col("doc_id")
    x = table(spark, d, "documents").select("doc_id", _text("raw/", k).alias("path"), F.when(k % 5 == 0, F.array(F.lit("collection-manifest"))).when(k % 3 == 0, F.array(F.lit("x"))).alias("tags"))
    return quality.unreferenced(x.drop("doc_id"), x.where("doc_id % 2 = 0").select(F.col("path").alias("source"))).select("path", "code")


@query("""SELECT 'wiki/x/' || doc_id || '.md' AS path, CASE doc_id % 3 WHEN 0 THEN 'illegal character: a:' || doc_id ELSE 'TeX: $x$' END AS detail FROM documents WHERE doc_id % 3 < 2""")
def q_bad_wikilinks(spark, d):
    k = F.col("doc_id")
    x = F.when(k % 3 == 0, _text("[[a:", k, "]] [[ok]] [[a:", k, "]]")).when(k % 3 == 1, "[[$x$]]").otherwise("[[fine|$x$]]")
    return quality.bad_wikilinks(table(spark, d, "documents").select(_text("wiki/x/", k, ".md").alias("path"), x.alias("raw_text"))).select("path", "detail")


@query("""SELECT 'wiki/x/' || doc_id || '.md' AS path, '../y/' || doc_id || '.md' AS detail FROM documents WHERE doc_id % 3 = 0""")
def q_dead_links(spark, d):
    """Links to a file that is there, to one that isn't, and to the web."""
    k = F.col("doc_id")
    x = F.when(k % 3 == 0, _text("[a](../y/", k, ".md)")).when(k % 3 == 1, _text("[a](<../x/./", k, ".md#part>)")).otherwise("[a](https://x.org/b.md)")
    return quality.dead_markdown_links(table(spark, d, "documents").select(_text("wiki/x/", k, ".md").alias("path"), x.alias("raw_text"))).select("path", "detail")


@query("SELECT vec_id, len(embedding)::INT AS width FROM embeddings")
def v_guarded_width(spark, d):
    """Vectors of a stated width; another one is an error."""
    return table(spark, d, "embeddings").select("vec_id", F.size(v.guarded(F.col("embedding"), 64)).alias("width"))
