"""Rules, routes and reports over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexquarry.operators import rules
from lexquarry.plans.adapters import table

Q, SQL = {}, {}


def query(sql: str):
    def put(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


def _pick(column, *values):
    return F.element_at(F.array(*map(F.lit, values)), (column % len(values) + 1).cast("int"))


@query("""SELECT path, expected AS detail FROM (SELECT 'wiki/' || ['concepts', 'topics', 'references'][doc_id % 3 + 1] || '/d' || doc_id || '.md' AS path,
'wiki/' || ['concepts', 'topics', 'references', 'theses'][doc_id % 4 + 1] || '/d' || doc_id || '.md' AS expected FROM documents) WHERE path <> expected""")
def q_misplaced(spark, d):
    """Articles in one of three folders, of one of three categories or theses."""
    k = F.col("doc_id")
    path = F.concat(F.lit("wiki/"), _pick(k, "concepts", "topics", "references"), F.lit("/d"), k.cast("string"), F.lit(".md"))
    head = F.concat(F.lit("---\n"), _pick(k, "category: concept", "category: topic", "category: reference", "type: thesis"), F.lit("\n---\n"), F.coalesce("text", F.lit("")))
    return rules.misplaced(table(spark, d, "documents").select(path.alias("path"), head.alias("raw_text"))).select("path", "detail")


@query("""SELECT 'wiki/' || CASE WHEN doc_id % 2 = 0 THEN 'concepts' ELSE 'references' END || '/d' || doc_id || '.md' AS path, unnest(list_filter(CASE WHEN doc_id % 2 = 0 THEN
[CASE WHEN doc_id % 3 <> 0 THEN 'Core Definition' END, 'Mathematical Formalism'] ELSE ['Key Contributions', CASE WHEN doc_id % 3 <> 1 THEN 'Theoretical Framework' END] END, lambda x: x IS NOT NULL)) AS detail FROM documents""")
def q_missing_headings(spark, d):
    """Texts below a heading that a third of the articles need."""
    k = F.col("doc_id")
    path = F.concat(F.lit("wiki/"), F.when(k % 2 == 0, "concepts").otherwise("references"), F.lit("/d"), k.cast("string"), F.lit(".md"))
    head = F.concat(_pick(k, "## 1. core  definition", "## Theoretical Framework", "# Key Contributions"), F.lit("\n"), F.coalesce("text", F.lit("")))
    return rules.missing_headings(table(spark, d, "documents").select(path.alias("path"), head.alias("raw_text"))).select("path", "detail")


@query("""SELECT route, count(*) AS n FROM (SELECT CASE o_orderkey % 7 WHEN 0 THEN 'arxiv-html' WHEN 1 THEN 'add' WHEN 2 THEN 'tex' WHEN 3 THEN CASE WHEN o_custkey % 2 = 0 THEN 'textlayer' ELSE 'mineru' END WHEN 4 THEN 'tex' ELSE 'mineru' END AS route FROM orders) GROUP BY 1""")
def g_import_routes(spark, d):
    """Orders as sources of seven forms: how many start on each route."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    value = _pick(k, "2405.00208", "a.MD", "a.tar.gz", "b.pdf", "c.tex", "d.docx", "nothing")
    return rules.counts_by(o.select(rules.first_route(F.when(k % 7 == 0, "arxiv").otherwise("file"), value, F.col("o_custkey") % 2 == 0).alias("route")), "route")


@query("""SELECT p_partkey, array_to_string(CASE WHEN p_size <= 6 THEN range(0, p_size) ELSE list_sort(list_distinct(list_transform(range(0, 6), lambda i: round_even(i * (p_size - 1) / 5.0, 0)::INT))) END, ' ') AS pages FROM part""")
def w_sampled_pages(spark, d):
    """Parts as papers of p_size pages."""
    return table(spark, d, "part").select("p_partkey", F.array_join(rules.sampled_pages(F.col("p_size")), " ").alias("pages"))


@query("""SELECT user_id::VARCHAR AS path, ord, error FROM (SELECT user_id, min(event_id) AS ord, 'e' || event_type AS error, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS r FROM events WHERE event_type <> 'click' GROUP BY user_id, event_type) WHERE r <= 2""")
def t_compile_issues(spark, d):
    """Events as a compiler's errors; clicks only follow from others."""
    e = table(spark, d, "events")
    error = F.when(F.col("event_type") == "click", "Missing $ inserted.").otherwise(F.concat(F.lit("e"), "event_type"))
    e = e.select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("ord"), F.lit(1).alias("line"), error.alias("error"), F.lit("").alias("context"))
    return rules.compile_issues(e, 2).select("path", "ord", "error")


@query("SELECT count_if(c_nationkey % 5 = 3) AS here, count_if(c_nationkey % 5 <> 3) AS elsewhere FROM customer".replace("c_nationkey", "c_custkey"))
def g_tasks_here(spark, d):
    """Customers as tasks of five topics; the first has none."""
    k = F.col("c_custkey")
    topic = F.concat(F.lit("t"), (k % 5).cast("string"))
    c = table(spark, d, "customer").select(k.alias("id"), F.concat(F.lit("["), topic, F.lit("] "), "c_name").alias("title"), F.when(k % 5 == 0, F.array(F.lit("bug"))).otherwise(F.array(F.lit("bug"), F.concat(F.lit("topic:"), topic))).alias("labels"))
    split = rules.split_tasks(c, "t3")
    return rules.tasks_here(split)


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'pending-review' ELSE 'reviewed' END AS status FROM documents")
def p_report_status(spark, d):
    """The status counts in the frontmatter only."""
    head = F.when(F.col("doc_id") % 3 == 0, "---\nstatus: pending-review\n---\n").otherwise("---\nx: 1\n---\nstatus: pending-review\n")
    return table(spark, d, "documents").select("doc_id", rules.report_status(F.concat(head, F.coalesce("text", F.lit("")))).alias("status"))
