"""Listings and pages over documents, pages and customers, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexquarry.operators import listings
from lexquarry.plans.adapters import cards, table

Q, SQL = {}, {}


def query(sql: str):
    def put(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


def _numbered(lines: DataFrame) -> DataFrame:
    """(page, n, line): the lines of each page counted from 1."""
    return lines.select("page", F.row_number().over(Window.partitionBy("page").orderBy("place")).cast("long").alias("n"), "line")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as drafts and reports, titled by their first characters in the frontmatter, a heading or not at all."""
    d, n = table(spark, sf_dir, "documents"), F.col("n_chars")
    title = F.trim(F.substring(F.translate("text", "\n#\"'|", "     "), 1, 20))
    head = F.when(n % 3 == 0, F.concat(F.lit("---\nstatus: "), F.when(n % 2 == 0, "pending-review").otherwise("reviewed"), F.lit('\ntitle: "'), title, F.lit('"\n---\n'))).when(n % 3 == 1, F.concat(F.lit("\n# "), title, F.lit("\n"))).otherwise("")
    path = F.when(F.col("lang") == "en", F.concat(F.lit("drafts/"), "source", F.lit("/"))).otherwise("inbox/radar/")
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("lang") == "fr", "-digest-2.md").when(F.col("lang") == "de", "-citation-gaps.md").otherwise(".md"))
    return d.select(F.concat(path, name).alias("path"), F.concat(head, "text").alias("text"), n.alias("mtime"), F.length("text").cast("long").alias("size"))


_TITLE = "trim(substr(translate(text, chr(10) || '#\"''|', '     '), 1, 20))"


@query(f"""SELECT doc_id || '.md' AS name, 'drafts/' || source || '/' || doc_id || '.md' AS path, CASE WHEN n_chars % 3 < 2 THEN nullif({_TITLE}, '') END AS title, n_chars AS mtime, length(text) AS size FROM documents WHERE lang = 'en'""")
def s_drafts(spark, d):
    return listings.drafts(_files(spark, d))


@query("""SELECT name, kind, status, 'inbox/radar/' || name AS path, n_chars AS mtime FROM (SELECT doc_id || CASE lang WHEN 'fr' THEN '-digest-2.md' ELSE '-citation-gaps.md' END AS name, CASE lang WHEN 'fr' THEN 'digest' ELSE 'citation-gap' END AS kind, CASE WHEN n_chars % 6 = 0 THEN 'pending-review' ELSE 'reviewed' END AS status, n_chars FROM documents WHERE lang IN ('fr', 'de'))""")
def s_reports(spark, d):
    return listings.reports(_files(spark, d)).drop("size")


@query(r"""WITH e AS (SELECT regexp_extract(url, '//([^/?#]+)', 1) AS archive, page_id, CASE WHEN contains(url, '?') THEN regexp_extract(url, '//[^/]+/([a-z]+)', 1) || '/full.md' WHEN contains(url, '#') THEN regexp_extract(url, '//[^/]+/([a-z]+)', 1) || '/x-full.md' ELSE regexp_replace(regexp_extract(url, '//[^/]+/(.*)$', 1), '(\.html|/)$', '.md') END AS name, strlen(html) AS size FROM pages)
SELECT archive, arg_min(name, (CASE WHEN regexp_matches(name, '(^|/)full\.md$') THEN 1 WHEN name LIKE '%full.md' THEN 2 ELSE 3 END, CASE WHEN name LIKE '%full.md' THEN 0 ELSE -size END, page_id)) AS name FROM e WHERE name LIKE '%.md' GROUP BY archive""")
def s_archive_documents(spark, d):
    """Hosts as archives of their pages."""
    lang = F.regexp_extract("url", "//[^/]+/([a-z]+)", 1)
    name = F.when(F.contains("url", F.lit("?")), F.concat(lang, F.lit("/full.md"))).when(F.contains("url", F.lit("#")), F.concat(lang, F.lit("/x-full.md"))).otherwise(F.regexp_replace(F.regexp_extract("url", "//[^/]+/(.*)$", 1), r"(\.html|/)$", ".md"))
    return listings.chosen_documents(table(spark, d, "pages").select(F.regexp_extract("url", "//([^/?#]+)", 1).alias("archive"), F.col("page_id").alias("ord"), name.alias("name"), F.octet_length("html").alias("size")))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as topics: the market segment tells how a path is given, the nation's number whether it is archived."""
    c, s = table(spark, sf_dir, "customer"), F.col("c_mktsegment")
    slug = F.lower(F.replace("c_name", F.lit("#"), F.lit("-")))
    path = F.when(s == "BUILDING", "").when(s == "MACHINERY", F.concat(F.lit("<HUB>/m/"), slug)).when(s == "HOUSEHOLD", F.concat(F.lit("/abs dir/"), slug)).when(s == "FURNITURE", F.concat(F.lit("topics/.archive/"), slug)).otherwise("HUB")
    # rounded as doubles are, so that a small debt is one of -0.0
    owed = F.round(F.abs("c_acctbal") * 10) / 10 * F.when(F.col("c_acctbal") < 0, -1.0).otherwise(1.0)
    return c.select(slug.alias("slug"), path.alias("path"), F.when(F.col("c_nationkey") > 12, "archived").otherwise("active").alias("status"), F.when(F.col("c_acctbal") > 0, F.concat("c_name", F.lit(" | "), s)).alias("title"), F.concat(F.lit("  owes  "), owed.cast("string")).alias("description"))


_REGISTRY = """r AS (SELECT lower(replace(c_name, '#', '-')) AS slug, CASE c_mktsegment WHEN 'BUILDING' THEN '' WHEN 'MACHINERY' THEN '<HUB>/m/' || lower(replace(c_name, '#', '-')) WHEN 'HOUSEHOLD' THEN '/abs dir/' || lower(replace(c_name, '#', '-')) WHEN 'FURNITURE' THEN 'topics/.archive/' || lower(replace(c_name, '#', '-')) ELSE 'HUB' END AS path,
CASE WHEN c_nationkey > 12 THEN 'archived' ELSE 'active' END AS status, CASE WHEN c_acctbal > 0 THEN c_name || ' \\| ' || c_mktsegment END AS title, 'owes ' || round(c_acctbal, 1) AS description FROM customer)"""


@query(f"""WITH {_REGISTRY} SELECT slug, CASE WHEN path = '' THEN '/hub/topics/' || CASE status WHEN 'archived' THEN '.archive/' ELSE '' END || slug WHEN path = 'HUB' THEN '/hub' WHEN path LIKE '<HUB>/%' THEN '/hub/' || path[7:] WHEN path LIKE '/%' THEN path ELSE '/hub/' || path END AS path FROM r""")
def s_topic_paths(spark, d):
    return listings.topic_paths(_registry(spark, d), "/hub")


@query(f"""WITH {_REGISTRY}, a AS (SELECT *, status = 'archived' OR path LIKE 'topics/.archive/%' AS gone FROM r),
l AS (SELECT 0 AS p, unnest(range(8)) AS k, '' AS slug, unnest(['# Hub Index', '', 'Last updated: 2024-06-01', '', '- Active topics: ' || count(*) FILTER (WHERE NOT gone), '- Archived topics: ' || count(*) FILTER (WHERE gone), '', '| Topic | Title | Description |']) AS line FROM a
  UNION ALL SELECT 0, 8, '', '|------|-------|-------------|'
  UNION ALL SELECT 1, 0, slug, '| [' || slug || '](' || CASE WHEN path = '' THEN 'topics/' || slug WHEN path LIKE '% %' THEN '<' || path || '>' ELSE path END || ') | ' || coalesce(title, 'Customer ' || split_part(slug, '-', 2)) || ' | ' || description || ' |' FROM a WHERE NOT gone)
SELECT '_index.md' AS page, row_number() OVER (ORDER BY p, k, slug) AS n, line FROM l""")
def k_hub_page(spark, d):
    return _numbered(listings.hub_page(_registry(spark, d), "2024-06-01"))


@query(r"""WITH c AS (SELECT 'wiki/' || CASE page_id % 3 WHEN 0 THEN 'concepts' WHEN 1 THEN 'references' ELSE 'topics' END AS f, 'p' || page_id AS stem, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang, page_id, url FROM pages WHERE html IS NOT NULL),
l AS (SELECT f, 0 AS p, '' AS k, i, x AS line FROM (SELECT f, unnest(range(8)) AS i, unnest(['# ' || upper(split_part(f, '/', 2)[1]) || split_part(f, '/', 2)[2:] || ' Index', '', 'Last updated: 2024-06-01', '', '## Contents', '', '| File | Summary | Tags | Updated |', '|------|---------|------|---------|']) AS x FROM (SELECT DISTINCT f FROM c))
  UNION ALL SELECT f, 1, stem || '.md', 0, '| [' || replace(coalesce(nullif(trim(regexp_replace(title, '\s+', ' ', 'g')), ''), stem), '|', '\|') || '](' || stem || '.md) | ' || replace(url, '|', '\|') || ' | ' || lang || ', q' || page_id % 4 || ' | 2024 |' FROM c)
SELECT f || '/_index.md' AS page, row_number() OVER (PARTITION BY f ORDER BY p, k, i) AS n, line FROM l""")
def k_directory_pages(spark, d):
    """Pages as cards by folder, summarised by their address."""
    p = table(spark, d, "pages").select(F.concat(F.lit("/p"), F.col("page_id").cast("string"), F.lit(".md")).alias("end"), "url")
    c = cards(spark, d).withColumn("end", F.regexp_extract("path", "(/[^/]*)$", 1)).join(p, "end")
    return _numbered(listings.directory_pages(c.select("path", "title", F.col("url").alias("summary"), "tags", F.lit(" 2024").alias("updated")), "2024-06-01"))


@query(r"""WITH w AS (SELECT page_id AS ord, 'raw/' || regexp_extract(html, 'lang="([a-z]+)"', 1) || '/p' || regexp_extract(html, '<title>([A-Za-z])', 1) AS stem FROM pages),
t AS (SELECT DISTINCT 'raw/' || lang || '/p' || regexp_extract(text, '([A-Za-z])', 1) AS stem, CASE WHEN n_chars % 9 < 2 THEN 1 ELSE n_chars % 9 END AS number FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY ord) AS k FROM w),
f AS (SELECT stem, n, row_number() OVER (PARTITION BY stem ORDER BY n) AS k FROM (SELECT stem, unnest(range(1, 600)) AS n FROM (SELECT DISTINCT stem FROM w)) x WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.stem = x.stem AND t.number = x.n))
SELECT ord, stem || '.md' AS path, stem || CASE WHEN n = 1 THEN '' ELSE '-' || n END || '.md' AS given FROM k JOIN f USING (stem, k)""")
def k_free_names(spark, d):
    """Pages want files named by the first letters of their titles; documents are there already."""
    p, x = table(spark, d, "pages"), table(spark, d, "documents")
    wanted = p.select(F.col("page_id").alias("ord"), F.concat(F.lit("raw/"), F.regexp_extract("html", 'lang="([a-z]+)"', 1), F.lit("/p"), F.regexp_extract("html", "<title>([A-Za-z])", 1), F.lit(".md")).alias("path"))
    n = F.col("n_chars") % 9
    there = x.select(F.concat(F.lit("raw/"), "lang", F.lit("/p"), F.regexp_extract("text", "([A-Za-z])", 1), F.when(n < 2, "").otherwise(F.concat(F.lit("-"), n.cast("string"))), F.lit(".md")).alias("path"))
    return listings.free_names(wanted, there)


@query(r"""WITH l AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
y AS (SELECT doc_id, i, x, length(x) % 97 AS num, CASE length(x) % 4 WHEN 0 THEN 'FIG' WHEN 1 THEN 'Figure' WHEN 2 THEN 'Table' ELSE 'Fig' END AS word, length(x) % 5 AS k FROM l)
SELECT doc_id, i, CASE WHEN k = 0 OR word = 'FIG' OR k = 1 OR (k >= 3 AND regexp_matches(x, '^\s*\p{Lu}')) OR (k >= 2 AND trim(x) = '') OR (k >= 2 AND regexp_matches(x, '^\s*[.:|]')) THEN upper(word[1]) || lower(word[2:]) || ' ' || num END AS label FROM y WHERE k <> 2 OR word = 'FIG'""")
def f_captions(spark, d):
    """Lines of documents as captions: a label alone, before a stop, before a comma, or before the line itself."""
    x = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "x"))
    n, k = F.length("x"), F.length("x") % 5
    word = F.when(n % 4 == 0, "FIG").when(n % 4 == 1, "Figure").when(n % 4 == 2, "Table").otherwise("Fig")
    text = F.concat(word, F.when(n % 2 == 0, ". ").otherwise(" "), (n % 97).cast("string"), F.when(k == 0, "").when(k == 1, F.concat(F.lit(": "), "x")).when(k == 2, F.concat(F.lit(", where "), "x")).otherwise(F.concat(F.lit(" "), "x")))
    return x.where((k != 2) | (word == "FIG")).select("doc_id", "i", listings.caption_label(text).alias("label"))
