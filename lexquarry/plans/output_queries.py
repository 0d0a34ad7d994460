"""Logs, written articles and their summaries, over the lines and words of documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.functions import text as t
from lexquarry.operators import library as cards
from lexquarry.operators import logs, outputs, quality
from lexquarry.plans.adapters import table

Q, SQL = {}, {}


def query(sql: str):
    def put(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, line, text): the lines of documents as logs: those of one to three words tell a place, of which the line's
    length is the number, and those that begin with T or A are errors."""
    d = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.posexplode(F.split("text", "\n", -1)).alias("i", "x"))
    mark = F.when(F.col("x").rlike(r"^\S+( \S+){0,2}$"), F.concat(F.lit("l."), F.length("x").cast("string"), F.lit(" "), F.col("x"))).when(F.col("x").rlike("^[TA]"), F.concat(F.lit("! "), F.col("x"))).otherwise(F.col("x"))
    return d.select("path", (F.col("i") + 1).cast("long").alias("line"), mark.alias("text"))


@query(r"""WITH x AS (SELECT source || '/' || doc_id AS path, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS x FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents)),
y AS (SELECT path, line, CASE WHEN regexp_matches(x, '^[^ \t\r\f\x0B]+( [^ \t\r\f\x0B]+){0,2}$') THEN 'l.' || length(x) || ' ' || x WHEN regexp_matches(x, '^[TA]') THEN '! ' || x ELSE x END AS text FROM x),
m AS (SELECT *, lag(line) OVER w AS before, lag(text) OVER w AS error FROM y WHERE starts_with(text, '! ') OR starts_with(text, 'l.') WINDOW w AS (PARTITION BY path ORDER BY line))
SELECT m.path, m.before AS ord, trim(m.error[3:]) AS error, CAST(regexp_extract(m.text, '^l\.([0-9]+)', 1) AS BIGINT) AS line,
  concat_ws(chr(10), regexp_extract(m.text, '^l\.[0-9]+\s*(.*)$', 1), CASE WHEN NOT starts_with(b.text, '!') AND NOT starts_with(b.text, 'l.') THEN b.text END) AS context
FROM m LEFT JOIN y b ON b.path = m.path AND b.line = m.line + 1 WHERE starts_with(m.text, 'l.') AND starts_with(m.error, '! ')""")
def f_log_records(spark, d):
    return logs.records(log_lines(spark, d))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, path, raw_text): documents as articles: a blank line after every second line, words in -er and -ea as
    wikilinks, frontmatter of what the row has, sources named by the document's first words."""
    d = table(spark, sf_dir, "documents")
    first = lambda k: F.regexp_extract("text", r"^\W*(\w+)\W+(\w+)", k)
    k, words = F.col("doc_id"), F.regexp_replace("text", r" ([A-Za-z]{2,5}(?:er|ea)) ", " [[$1]] ")
    body = F.regexp_replace(words, r"\n([^\n]*\n)", "\n$1\n")
    fields = F.concat_ws(
        "\n", F.when(k % 5 > 0, F.concat(F.lit("title: "), F.col("source"))), F.when(k % 7 > 0, "created: 2024-01-01"), F.when(k % 3 == 0, "type: thesis").when(k % 3 == 1, "type: 'essay'"),
        F.when(k % 4 > 0, F.concat(F.lit("sources:\n  - raw/papers/"), first(1), F.lit(".md\n  - \"/home/u/wiki/concepts/"), first(2), F.lit(".md\"\n  - https://x.org/a"))),
    )
    head = F.when(k % 11 > 0, F.concat(F.lit("---\n"), fields, F.lit("\n---\n"))).otherwise("")
    return d.select("doc_id", "lang", F.concat(F.lit("output/"), "source", F.lit("/"), k.cast("string"), F.lit(".md")).alias("path"), F.concat(head, F.when(k % 2 == 0, F.concat(F.lit("# "), F.col("source"), F.lit("\n\n"))).otherwise(""), body).alias("raw_text"))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path): the words of benchmark items as files, short ones as papers, others as concepts or references."""
    w = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z]+)"), 1)).alias("w")).distinct()
    folder = F.when(F.length("w") <= 3, "raw/papers/").when(F.length("w") % 2 == 0, "wiki/concepts/").otherwise("wiki/references/")
    return w.select(F.concat(folder, "w", F.lit(".md")).alias("path"))


_ARTICLES = r"""
x AS (SELECT doc_id, lang, source, 'output/' || source || '/' || doc_id || '.md' AS path, regexp_extract(text, '^[^A-Za-z0-9_]*([A-Za-z0-9_]+)[^A-Za-z0-9_]+([A-Za-z0-9_]+)', 1) AS one, regexp_extract(text, '^[^A-Za-z0-9_]*([A-Za-z0-9_]+)[^A-Za-z0-9_]+([A-Za-z0-9_]+)', 2) AS two,
  CASE WHEN doc_id % 2 = 0 THEN '# ' || source || chr(10) || chr(10) ELSE '' END || regexp_replace(regexp_replace(text, ' ([A-Za-z]{2,5}(?:er|ea)) ', ' [[\1]] ', 'g'), '\n([^\n]*\n)', chr(10) || '\1' || chr(10), 'g') AS body, doc_id % 11 > 0 AS has FROM documents),
files AS (SELECT DISTINCT CASE WHEN length(w) <= 3 THEN 'raw/papers/' WHEN length(w) % 2 = 0 THEN 'wiki/concepts/' ELSE 'wiki/references/' END || w || '.md' AS file FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark)),
fields AS (SELECT path, 'missing-field' AS code, f AS detail, lang FROM x, (VALUES ('title', 5), ('created', 7)) v(f, m) WHERE has AND doc_id % m = 0),
bare AS (SELECT path, 'no-frontmatter' AS code, '' AS detail, lang FROM x WHERE NOT has),
links AS (SELECT DISTINCT path, lang, unnest(regexp_extract_all(body, '\[\[([^\]|]+)\]\]', 1)) AS link FROM x WHERE has)"""


@query(f"""WITH {_ARTICLES},
refs AS (SELECT path, lang, 'raw/papers/' || one || '.md' AS ref, 'raw/papers/' || one || '.md' AS file FROM x WHERE has AND doc_id % 4 > 0 UNION ALL SELECT path, lang, '/home/u/wiki/concepts/' || two || '.md', 'wiki/concepts/' || two || '.md' FROM x WHERE has AND doc_id % 4 > 0),
p AS (SELECT path, lang, trim(unnest(string_split_regex(body, '\\n\\n+')), ' ' || chr(10)) AS p FROM x WHERE has),
n AS (SELECT path, 'uncited-paragraphs' AS code, CAST(count(*) AS VARCHAR) AS detail, lang FROM p WHERE length(p) >= {outputs.LEAST_CLAIM} AND NOT regexp_matches(p, '^([#|>]|[-*] )') AND NOT contains(p, '[[') AND NOT contains(p, '](') AND NOT contains(p, '$$') AND NOT contains(p, '\\begin{{') AND NOT contains(p, '\\int') AND NOT contains(p, '\\sum')
  AND NOT list_contains({list(outputs.DERIVATIONS)}, trim(lower(regexp_extract(p, '^[^ \\n\\t]+')), '.,:;()')) GROUP BY path, lang)
SELECT path, code, detail FROM (SELECT * FROM bare UNION ALL SELECT * FROM fields UNION ALL SELECT * FROM n UNION ALL SELECT path, 'lost-source', ref, lang FROM refs WHERE file NOT IN (FROM files)) WHERE lang = 'en'""")
def q_research_outputs(spark, d):
    return outputs.research(articles(spark, d).where("lang = 'en'"), library(spark, d)).drop("severity")


@query(f"""WITH {_ARTICLES},
out AS (SELECT * FROM bare UNION ALL SELECT * FROM fields UNION ALL SELECT path, 'wrong-type', 'essay', lang FROM x WHERE has AND doc_id % 3 = 1 UNION ALL SELECT path, 'no-sources', '', lang FROM x WHERE has AND doc_id % 4 = 0
  UNION ALL SELECT path, 'no-heading', '', lang FROM x WHERE has AND NOT regexp_matches(body, '(^|\\n)# ') UNION ALL SELECT path, 'no-wikilinks', '', lang FROM x WHERE has AND NOT regexp_matches(body, '\\[\\[([^\\]|]+)\\]\\]')
  UNION ALL SELECT path, 'dangling-wikilink', link, lang FROM links WHERE 'wiki/concepts/' || link || '.md' NOT IN (FROM files) AND 'wiki/references/' || link || '.md' NOT IN (FROM files))
SELECT path, code, detail FROM out WHERE lang IN ('fr', 'de')""")
def q_thesis_outputs(spark, d):
    return outputs.thesis(articles(spark, d).where("lang IN ('fr', 'de')"), library(spark, d)).drop("severity")


@query(f"""WITH {_ARTICLES}
SELECT path, code, detail FROM bare WHERE lang = 'es' UNION ALL SELECT path, 'orphan-concepts', string_agg(link, ', ' ORDER BY link) FROM links WHERE lang = 'es' AND 'wiki/concepts/' || link || '.md' NOT IN (FROM files) GROUP BY path""")
def q_enrichment_outputs(spark, d):
    return outputs.enrichment(articles(spark, d).where("lang = 'es'"), library(spark, d)).drop("severity")


@query("""SELECT doc_id::VARCHAR AS path, 'wrong-paper' AS code, '2401.' || lpad((length(text) % 100000)::VARCHAR, 5, '0') AS detail FROM documents
WHERE doc_id % 4 < 2 AND length(text) % 100000 <> CASE WHEN doc_id % 4 = 1 THEN n_chars % 100000 + ascii(text) % 2 ELSE n_chars % 100000 END""")
def c6_paper_identity(spark, d):
    """Papers whose own identifier is made of their length, and what was asked for; all cite another paper first."""
    k = F.col("doc_id")
    number = lambda n: F.concat(F.lit("2401."), F.lpad((n % 100000).cast("string"), 5, "0"))
    field = F.when(k % 4 < 2, F.concat(F.lit('arxiv_id: "arXiv:'), number(F.length("text")), F.lit('v2"\n'))).when(k % 4 == 2, "").otherwise("arxiv_id: none yet\n")
    md = F.concat(F.lit("---\ntitle: see arXiv:1912.00001\n"), field, F.lit("---\nfollows arXiv:1912.00001\n"), F.coalesce("text", F.lit("")))
    expected = F.when(k % 4 == 1, F.concat(number(F.col("n_chars") + F.ascii("text") % 2), F.lit("v1"))).otherwise(number(F.col("n_chars")))
    x = table(spark, d, "documents").select(k.cast("string").alias("path"), md.alias("md"), F.lit(b"").alias("payload"), F.lit(None).cast("string").alias("tex_source"), F.lit(0).alias("figures_referenced"), F.lit(0).alias("figures_resolved"), expected.alias("expected_arxiv_id"))
    return quality.conversion_gates(x).where("code = 'wrong-paper'").drop("severity")


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, body): the lines of documents as Markdown, of the kind that their first letters tell, some words as links."""
    line = lambda x: (
        F.when(x.rlike("^(An|De)"), "```").when(x.rlike("^(In|La)"), F.concat(F.lit("## "), x)).when(x.rlike("^(On|En)"), F.concat(F.lit("| "), x)).when(x.rlike("^(Of|El)"), F.concat(F.lit("3. "), x))
        .when(x.rlike("^(Er|Es)"), "").when(x.rlike("^(Wh|Ou)"), F.concat(F.lit("- "), x)).when(x.rlike("^Ti"), F.concat(F.lit("**Summary**: "), x)).otherwise(x)
    )
    linked = F.regexp_replace(F.regexp_replace("text", " ([a-z]{3}er) ", " [[w/$1|$1]] "), " ([a-z]{2}ea) ", " [$1](u/$1.md) *`$1`* ")
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.array_join(F.transform(F.split(linked, "\n", -1), line), "\n").alias("body"))


_BODIES = r"""
t AS (SELECT doc_id, source, regexp_replace(regexp_replace(text, ' ([a-z]{3}er) ', ' [[w/\1|\1]] ', 'g'), ' ([a-z]{2}ea) ', ' [\1](u/\1.md) *`\1`* ', 'g') AS x FROM documents),
l AS (SELECT doc_id, source, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x FROM (SELECT *, string_split(x, chr(10)) AS l FROM t)),
m AS (SELECT doc_id, source, i, CASE WHEN regexp_matches(x, '^(An|De)') THEN '```' WHEN regexp_matches(x, '^(In|La)') THEN '## ' || x WHEN regexp_matches(x, '^(On|En)') THEN '| ' || x WHEN regexp_matches(x, '^(Of|El)') THEN '3. ' || x
  WHEN regexp_matches(x, '^(Er|Es)') THEN '' WHEN regexp_matches(x, '^(Wh|Ou)') THEN '- ' || x WHEN starts_with(x, 'Ti') THEN '**Summary**: ' || x ELSE x END AS x FROM l)"""
_CLEAN = r"rtrim(substr(trim(regexp_replace(translate(regexp_replace(regexp_replace({}, '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '\[\[(?:[^|\]]+\|)?([^\]]+)\]\]', '\1', 'g'), '*_`', ''), '\s+', ' ', 'g')), 1, 260))"


@query(rf"""WITH {_BODIES},
c AS (SELECT *, trim(x) AS line, sum(CASE WHEN starts_with(trim(x), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 OR starts_with(trim(x), '```') AS code FROM m),
g AS (SELECT *, CASE WHEN line IN ('', '---') OR regexp_matches(line, '^(#|\||- |[0-9]+\.\s)') THEN 1 ELSE 0 END AS apart, sum(CASE WHEN line IN ('', '---') OR regexp_matches(line, '^(#|\||- |[0-9]+\.\s)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM c WHERE NOT code),
p AS (SELECT doc_id, g, {_CLEAN.format("string_agg(line, ' ' ORDER BY i)")} AS p FROM g WHERE apart = 0 GROUP BY doc_id, g),
s AS (SELECT doc_id, {_CLEAN.format("arg_min(x, i)[13:]")} AS s FROM m WHERE starts_with(x, '**Summary**: ') GROUP BY doc_id),
f AS (SELECT doc_id, arg_min(p, g) AS p FROM p WHERE length(p) >= 40 GROUP BY doc_id)
SELECT doc_id, coalesce(s, p, 'Compiled wiki article.') AS summary FROM documents LEFT JOIN s USING (doc_id) LEFT JOIN f USING (doc_id)""")
def f_summaries(spark, d):
    return _bodies(spark, d).select("doc_id", t.summary("body").alias("summary"))


@query(rf"""WITH {_BODIES},
b AS (SELECT doc_id, source, string_agg(x, chr(10) ORDER BY i) AS body FROM m GROUP BY 1, 2),
e AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(regexp_replace(body, '\[\[(.*?)\]\]', '\1', 'g'), '\[(.*?)\]\(.*?\)', '\1', 'g'), '#+\s*', '', 'g'), chr(10) || ' ') AS x FROM b)
SELECT doc_id, x || CASE doc_id % 4 WHEN 0 THEN chr(10) || chr(10) || '[Metadata Context: Tags include ' || source || ', x y.]' WHEN 1 THEN chr(10) || chr(10) || '[Metadata Context: Tags include ' || source || '. Known aliases: a, b.]' WHEN 2 THEN chr(10) || chr(10) || '[Metadata Context: Known aliases: ' || source || '.]' ELSE '' END AS text FROM e""")
def f_embedding_texts(spark, d):
    k = F.col("doc_id")
    head = F.when(k % 4 == 0, F.concat(F.lit("tags: ["), F.col("source"), F.lit(", 'x y']\naliases: []"))).when(k % 4 == 1, F.concat(F.lit("tags: "), F.col("source"), F.lit("\naliases:\n  - a\n  - b"))).when(k % 4 == 2, F.concat(F.lit("title: t\naliases: "), F.col("source"))).otherwise("title: t")
    whole = F.concat(F.lit("---\n"), head, F.lit("\n---\n"), F.when(k % 3 == 0, t.BOILERPLATE[2]).otherwise(""), "body")
    return _bodies(spark, d).select("doc_id", t.embedding_text(whole).alias("text"))


@query(r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark),
f AS (SELECT CASE WHEN length(w) <= 6 THEN 'raw/papers/' ELSE 'wiki/references/' END || w || '.md' AS path, w AS name, lower(w) AS slug, CASE WHEN length(w) <= 6 THEN 1 ELSE 2 END AS tier FROM w),
r AS (SELECT DISTINCT array_to_string(regexp_extract_all(text, '[A-Za-z]+')[doc_id % 9 + 1:doc_id % 9 + 1 + doc_id % 2], ' ') AS ref FROM documents),
p AS (SELECT ref, arg_min(path, (tier, name)) AS path, arg_min(name, (tier, name)) AS name FROM r JOIN f ON contains(replace(lower(ref), ' ', '-'), slug) OR contains(slug, replace(lower(ref), ' ', '-')) WHERE ref <> '' GROUP BY ref)
SELECT ref, coalesce(path, ref) AS path, coalesce(name, ref) AS name FROM r LEFT JOIN p USING (ref)""")
def j_concept_sources(spark, d):
    """One or two words of each document as sources, the words of benchmark items as papers and references."""
    w = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("w")).distinct()
    files = w.select(F.concat(F.when(F.length("w") <= 6, "raw/papers/").otherwise("wiki/references/"), "w", F.lit(".md")).alias("path"))
    k = F.col("doc_id")
    refs = table(spark, d, "documents").select(F.array_join(F.slice(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1), (k % 9 + 1).cast("int"), (1 + k % 2).cast("int")), " ").alias("ref"))
    return cards.concept_sources(refs, files)
