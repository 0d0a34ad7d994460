"""Figures, links and images looked up and rewritten, over texts made of the anchors and titles of pages, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.operators import rewriting
from lexquarry.plans.adapters import table

Q, SQL = {}, {}


def query(sql: str):
    def put(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, lang, site, words, title): the anchors of a page and the words of its title."""
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract("url", r"example\.([a-z]+)", 1).alias("site"),
        F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), 1).alias("words"), F.regexp_extract_all(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(r"([\p{L}]+)"), 1).alias("title"),
    )


_PAGES = r"""p AS (SELECT page_id, url, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang, regexp_extract(url, 'example\.([a-z]+)', 1) AS site,
  regexp_extract_all(html, '<a href="/([^"]*)"', 1) AS words, regexp_extract_all(regexp_extract(html, '<title>([^<]*)</title>', 1), '[\p{L}]+') AS title FROM pages)"""


def tex_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as TeX: a figure for each anchor, with an extension if the address has a query or fragment, and a graphics
    path of the first two words of the title."""
    p = _pages(spark, sf_dir)
    figure = lambda x: F.concat(F.lit("\\includegraphics[width=1]{"), x, F.when(F.contains("url", F.lit("?")), ".png").when(F.contains("url", F.lit("#")), ".JPG").otherwise(""), F.lit("}\n"))
    return p.select(F.concat_ws("", "lang", F.lit("/p"), "page_id", F.lit(".tex")).alias("path"), F.concat(F.lit("\\graphicspath{{./"), F.coalesce(F.get("title", F.lit(0)), F.lit("")), F.lit("/}{../"), F.coalesce(F.get("title", F.lit(1)), F.lit("")), F.lit("}}\n"), F.array_join(F.transform("words", figure), "")).alias("text"))


def figure_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each anchor of a page as a file, in a folder by the page's site, with an extension by the anchor's first letter."""
    p = _pages(spark, sf_dir).select("page_id", "lang", "site", "title", F.explode("words").alias("w"))
    folder = F.when(F.col("site") == "com", F.concat("lang", F.lit("/figs/"))).when(F.col("site") == "net", F.concat("lang", F.lit("/"))).otherwise(F.concat(F.coalesce(F.get("title", F.lit(1)), F.lit("x")), F.lit("/")))
    extension = F.when(F.col("w").rlike("^[a-f]"), ".pdf").when(F.col("w").rlike("^[g-n]"), ".JPG").when(F.col("w").rlike("^[o-r]"), ".svg").when(F.col("w").rlike("^t"), ".png").otherwise(".txt")
    return p.select(F.concat(folder, "w", extension).alias("path")).distinct()


_EXTENSIONS = "[" + ", ".join(f"'{x}'" for x in rewriting.FIGURE_EXTENSIONS) + "]"
_FOLDERS = "[" + ", ".join(f"'{x}'" for x in rewriting.FIGURE_FOLDERS) + "]"


@query(rf"""WITH {_PAGES},
files AS (SELECT DISTINCT CASE site WHEN 'com' THEN lang || '/figs/' WHEN 'net' THEN lang || '/' ELSE coalesce(title[2], 'x') || '/' END || w
    || CASE WHEN regexp_matches(w, '^[a-f]') THEN '.pdf' WHEN regexp_matches(w, '^[g-n]') THEN '.JPG' WHEN regexp_matches(w, '^[o-r]') THEN '.svg' WHEN starts_with(w, 't') THEN '.png' ELSE '.txt' END AS file FROM (SELECT *, unnest(words) AS w FROM p)),
t AS (SELECT concat(lang, '/p', page_id, '.tex') AS path, lang, title, unnest(range(len(words))) AS ord, unnest(list_transform(words, lambda x: trim(x || CASE WHEN contains(url, '?') THEN '.png' WHEN contains(url, '#') THEN '.JPG' ELSE '' END))) AS target FROM p),
s AS (SELECT path, ord, target, regexp_extract(target, '^\.*[^.].*(\.[^.]*)$', 1) AS x, unnest(list_concat([lang, lang || '/' || coalesce(title[1], ''), coalesce(title[2], '')], list_transform({_FOLDERS}, lambda f: lang || '/' || f))) AS folder, unnest(range(3 + len({_FOLDERS}))) AS folder_ord FROM t),
c AS (SELECT path, ord, target, folder_ord, 0 AS rank, folder || '/' || target AS file FROM s WHERE list_contains({_EXTENSIONS}, lower(x))
  UNION ALL SELECT path, ord, target, folder_ord, unnest(range(1, len({_EXTENSIONS}) + 1)), folder || '/' || target[:len(target) - len(x)] || unnest({_EXTENSIONS}) FROM s),
n AS (SELECT path, ord, target, folder_ord, rank, ltrim(regexp_replace(file, '/+', '/', 'g'), '/') AS file FROM c)
SELECT path, CAST(ord AS INTEGER) AS ord, target, arg_min(files.file, [folder_ord, rank]) AS file FROM n LEFT JOIN files USING (file) GROUP BY path, ord, target""")
def j_figures(spark, d):
    docs = tex_documents(spark, d)
    return rewriting.resolved_figures(rewriting.figure_targets(docs), rewriting.figure_folders(docs), figure_files(spark, d))


def linked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, raw_text, aliases): pages as wiki articles that link to what their anchors name, after their title; the first
    words of titles are the aliases of concepts."""
    p = _pages(spark, sf_dir)
    folder = F.when(F.col("site") == "net", "wiki/concepts/").when(F.col("site") == "org", "raw/papers/").otherwise("wiki/topics/")
    link = lambda w, i: F.when(i % 3 == 0, F.concat(F.lit("["), w, F.lit("](<"), w, F.lit(".md>) "))).otherwise(F.concat(F.lit("["), w, F.lit("](../concepts/"), w, F.when(i % 3 == 1, ".md#a) ").otherwise(".md) ")))
    # every fourth article is a file that links may really mean
    name = F.when(F.col("page_id") % 4 == 0, F.coalesce(F.get("title", F.lit(0)), F.lit("p"))).otherwise("p")
    path = F.concat(folder, name, F.when(F.col("page_id") % 8 == 0, "").otherwise(F.concat(F.lit("-"), F.col("page_id").cast("string"))), F.lit(".md"))
    d = p.select(path.alias("path"), F.concat(F.array_join("title", " "), F.lit(": "), F.array_join(F.transform("words", link), "")).alias("raw_text"), F.slice(F.transform("title", lambda x: F.lower(x)), 1, 3).alias("aliases"), "page_id")
    return d.groupBy("path").agg(*(F.min_by(c, "page_id").alias(c) for c in ("raw_text", "aliases")))


@query(rf"""WITH {_PAGES},
a AS (SELECT CASE site WHEN 'net' THEN 'wiki/concepts/' WHEN 'org' THEN 'raw/papers/' ELSE 'wiki/topics/' END || CASE WHEN page_id % 4 = 0 THEN coalesce(title[1], 'p') ELSE 'p' END || CASE WHEN page_id % 8 = 0 THEN '' ELSE '-' || page_id END || '.md' AS path, * FROM p),
d AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY path ORDER BY page_id) = 1),
m AS (SELECT alias, max(name) AS name FROM (SELECT unnest(list_transform(title[1:3], lambda x: lower(x))) AS alias, split_part(path, '/', 3) AS name FROM d WHERE site = 'net') GROUP BY 1),
l AS (SELECT path, array_to_string(title, ' ') AS title, split_part(path, '/', 2) AS folder, unnest(range(len(words))) AS i, unnest(words) AS w FROM d),
r AS (SELECT l.*, m.name, CASE WHEN l.path NOT LIKE 'raw/%' AND m.name <> w || '.md' AND NOT EXISTS (SELECT 1 FROM d x WHERE x.path = 'wiki/' || CASE WHEN i % 3 = 0 THEN l.folder ELSE 'concepts' END || '/' || w || '.md') THEN m.name END AS new FROM l LEFT JOIN m ON m.alias = w)
SELECT path, any_value(title) || ': ' || string_agg('[' || w || '](' || CASE WHEN i % 3 = 0 AND new IS NULL THEN '<' || w || '.md>' WHEN i % 3 = 0 THEN new ELSE '../concepts/' || coalesce(new, w || '.md') || CASE WHEN i % 3 = 1 THEN '#a' ELSE '' END END || ') ', '' ORDER BY i) AS raw_text, CAST(count(new) AS INTEGER) AS n_replaced
FROM r GROUP BY path HAVING count(new) > 0""")
def j_repaired_links(spark, d):
    docs = linked_documents(spark, d)
    concepts = docs.where("startswith(path, 'wiki/concepts/')").select("path", "aliases")
    return rewriting.repaired_links(docs.drop("aliases"), concepts)


@query(rf"""WITH {_PAGES},
i AS (SELECT 'raw/p' || page_id || '.md' AS path, page_id, unnest(range(len(words))) AS i, unnest(words) AS w, array_to_string(title, ' ') AS title FROM p),
k AS (SELECT *, CASE i % 5 WHEN 0 THEN 'figs/' || w WHEN 1 THEN w || '.png' WHEN 2 THEN 'https://x.org/' || w WHEN 3 THEN 'images/' || w ELSE '../' || w || '.JPG' END AS target FROM i),
s AS (SELECT *, trim(regexp_replace(regexp_extract(target, '[^/]*$'), '[^\p{{L}}\p{{M}}\p{{N}}_.\-]+', '_', 'g'), '._') AS safe FROM k),
n AS (SELECT *, CASE WHEN i % 5 IN (0, 1, 4) THEN 'images/' || CASE WHEN starts_with(lower(safe), 'p' || page_id || '-') THEN safe ELSE 'p' || page_id || '-' || CASE WHEN safe = '' THEN 'image' ELSE safe END END END AS new FROM s)
SELECT path, any_value(title) || chr(10) || string_agg(CASE WHEN i % 2 = 0 THEN '![' || w || '](' || coalesce(new, target) || ' "t")' ELSE '<img alt="' || w || '" src="' || coalesce(new, target) || '">' END, chr(10) ORDER BY i) AS text, CAST(count(new) AS INTEGER) AS n_replaced
FROM n GROUP BY path HAVING count(new) > 0""")
def f_image_rewrite(spark, d):
    """Images named by anchors, in Markdown and HTML, under addresses of five kinds."""
    p = _pages(spark, d)
    target = lambda w, i: F.when(i % 5 == 0, F.concat(F.lit("figs/"), w)).when(i % 5 == 1, F.concat(w, F.lit(".png"))).when(i % 5 == 2, F.concat(F.lit("https://x.org/"), w)).when(i % 5 == 3, F.concat(F.lit("images/"), w)).otherwise(F.concat(F.lit("../"), w, F.lit(".JPG")))
    image = lambda w, i: F.when(i % 2 == 0, F.concat(F.lit("!["), w, F.lit("]("), target(w, i), F.lit(' "t")'))).otherwise(F.concat(F.lit('<img alt="'), w, F.lit('" src="'), target(w, i), F.lit('">')))
    slug = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    docs = p.select(F.concat(F.lit("raw/"), slug, F.lit(".md")).alias("path"), slug.alias("slug"), F.concat_ws("\n", F.array_join("title", " "), F.array_join(F.transform("words", image), "\n")).alias("text"))
    return rewriting.rewritten_images(docs, rewriting.image_names(docs, F.col("slug"))).drop("slug")
