"""Library queries over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexquarry.functions import text as t
from lexquarry.operators import library
from lexquarry.plans.adapters import table

Q, SQL = {}, {}


def query(sql: str):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query("""SELECT 'd' || doc_id AS ref, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'wiki/references/d' || doc_id || '.md' ELSE 'raw/papers/2024-01-01-d' || doc_id || '.md' END AS path, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 2 ELSE 3 END AS tier FROM documents""")
def j_sources(spark, d):
    """References by stem: cards, dated raw files, and names that two files share."""
    k = F.col("doc_id")
    x = table(spark, d, "documents").select("doc_id", F.concat(F.when(k % 2 == 0, "wiki/references/d").otherwise("raw/papers/2024-01-01-d"), k.cast("string"), F.lit(".md")).alias("path"))
    twice = x.where("doc_id % 5 = 0").select("doc_id", F.when(k % 2 == 0, F.concat(F.lit("wiki/topics/d"), k.cast("string"), F.lit(".md"))).otherwise(F.concat(F.lit("raw/b/d"), k.cast("string"), F.lit(".md"))).alias("path"))
    files = x.union(twice).select("path", F.lit("").alias("title"), F.array().cast("array<string>").alias("aliases"))
    return library.resolved_sources(x.select(F.concat(F.lit("d"), k.cast("string")).alias("ref")), files)


@query("""SELECT doc_id::VARCHAR AS path, CASE WHEN source = 'src1' THEN lang WHEN source = 'src2' THEN lang ELSE source || ' ' || CASE WHEN lang = 'en' THEN 'english' ELSE lang END END AS tags FROM documents""".replace("WHEN source = 'src1' THEN lang WHEN source = 'src2' THEN lang", "WHEN source IN ('src1', 'src2') THEN CASE WHEN lang = 'en' THEN 'english' ELSE lang END"))
def n_tag_mapping(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.array("source", "lang").alias("tags"))
    m = spark.createDataFrame([("src1", ""), ("src2", ""), ("en", "english")], "tag string, canonical string")
    return library.mapped_tags(x, m).select("path", F.array_join("tags", " ").alias("tags"))


@query("""SELECT category, count(*) AS files, md5('# ' || upper(substr(category, 1, 1)) || substr(category, 2) || chr(10) || chr(10) || '| Page | Summary |' || chr(10) || '|---|---|' || chr(10) || string_agg('| [[p' || page_id || ']] | ' || replace(s, '|', '/') || ' |', chr(10) ORDER BY lower(s), p) || chr(10)) AS page
FROM (SELECT page_id, 'wiki/x/p' || page_id || '.md' AS p, regexp_extract(html, 'lang="([a-z]+)"', 1) AS category, regexp_extract(url, '//([a-z.]+)', 1) AS s FROM pages) GROUP BY 1""")
def k_index_pages(spark, d):
    p = table(spark, d, "pages")
    host = F.regexp_extract("url", "//([a-z.]+)", 1)
    c = p.select(F.concat(F.lit("wiki/x/p"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"), host.alias("title"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("category"), host.alias("summary"))
    return library.index_pages(c).select("category", "files", F.md5("page").alias("page"))


@query("""SELECT 'inbox/' || CASE WHEN doc_id % 3 = 0 THEN '2024-05-06-' ELSE '' END || 'n' || doc_id || '.md' AS path, CASE WHEN doc_id % 2 = 0 THEN 'Head ' || doc_id ELSE 'N' || doc_id END AS title,
'raw/' || CASE WHEN doc_id % 3 = 0 THEN '2024-05-06' ELSE '2025-01-01' END || '-' || CASE WHEN doc_id % 2 = 0 THEN 'head-' || doc_id ELSE 'n' || doc_id END || '.md' AS target FROM documents""")
def k_inbox(spark, d):
    k = F.col("doc_id").cast("string")
    x = table(spark, d, "documents").select(F.concat(F.lit("inbox/"), F.when(F.col("doc_id") % 3 == 0, "2024-05-06-").otherwise(""), F.lit("n"), k, F.lit(".md")).alias("path"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# Head "), k, F.lit("\nbody"))).otherwise("body").alias("text"))
    return library.inbox(x, "2025-01-01").select("path", "title", "target")


@query("SELECT page_id, length(replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '<', '')) > 0 AS any_text FROM pages".replace("\\\\", "\\"))
def f_html_text(spark, d):
    return table(spark, d, "pages").select("page_id", (F.length(t.html_text("html")) > 0).alias("any_text"))
