"""Upkeep over the test tables, and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexquarry.operators import upkeep
from lexquarry.plans.adapters import table
from lexquarry.plans.record_queries import _text

Q, SQL = {}, {}


def query(sql: str):
    def put(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


@query("""SELECT 'output/projects/' || CASE doc_id % 4 WHEN 1 THEN 'P' ELSE 'p-2024-01-02-' END || doc_id AS path, c AS code FROM documents, (VALUES ('project-why'), ('project-name')) AS x(c) WHERE doc_id % 4 IN (1, 2)""")
def q_projects(spark, d):
    """Documents as projects: sound ones, one with an empty reason and a capital, one with a date and no reason."""
    k = F.col("doc_id")
    name = F.when(k % 4 == 0, _text("p-", k)).when(k % 4 == 1, _text("P", k)).when(k % 4 == 2, _text("p-2024-01-02-", k)).otherwise(_text("q", k))
    x = table(spark, d, "documents").select(
        F.concat(F.lit("output/projects/"), name, F.when(k % 4 == 2, "/x.md").otherwise("/WHY.md")).alias("path"), F.when(k % 4 == 1, " \n").otherwise("because").alias("text"))
    return upkeep.project_findings(x).select("path", "code")


@query("""SELECT p_partkey, 'title: t' || chr(10) || 'tags:' || CASE WHEN p_partkey % 4 = 3 THEN ' []' ELSE chr(10) || '  - "n' || p_partkey || '"' || chr(10) || '  - "a\\"b$1"' END || CASE WHEN p_partkey % 3 < 2 THEN chr(10) || 'x: 1' ELSE '' END AS block FROM part""")
def n_replaced_lists(spark, d):
    """Frontmatter whose tags are one line, several lines or missing."""
    k = F.col("p_partkey")
    block = F.when(k % 3 == 0, "title: t\ntags: [a, b]\nx: 1").when(k % 3 == 1, "title: t\ntags:\n  - a\n  - b\nx: 1").otherwise("title: t\n")
    values = F.when(k % 4 == 3, F.array().cast("array<string>")).otherwise(F.array(_text("n", k), F.lit('a"b$1')))
    return table(spark, d, "part").select(k, upkeep.replaced_list(block, "tags", values).alias("block"))


@query("SELECT DISTINCT unnest([source, lang]) AS tag FROM documents")
def n_ontology(spark, d):
    return upkeep.ontology(table(spark, d, "documents").select(F.explode(F.array("source", "lang", F.lit(""))).alias("tag")))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 = 2")
def j_unfiled(spark, d):
    """Customers as a backlog; a third have an issue of today's form, a third one of the old form."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k, _text("Compile ", k).alias("title"), _text("compile: ", k).alias("legacy_title"))
    issues = c.where("c_custkey % 3 = 0").select("title").union(c.where("c_custkey % 3 = 1").select("legacy_title"))
    return upkeep.unfiled(c, issues).select("c_custkey")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'On {X} y ' || p_partkey END AS title FROM part""")
def f_tex_titles(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k, upkeep.tex_title(F.when(k % 2 == 0, _text("\\title[short]{On {X} \\\\\n y ", k, "}\\author{a}")).otherwise("\\section{title}")).alias("title"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN 'my-lattice-' ELSE 'gas-' END || p_partkey AS slug FROM part""")
def f_plain_concepts(spark, d):
    k = F.col("p_partkey")
    x = F.when(k % 4 == 0, _text("lattice-gas-", k)).when(k % 4 == 1, _text("quantum-gas-", k)).when(k % 4 == 2, _text("topological-gas-", k)).otherwise(_text("my-lattice-", k))
    return table(spark, d, "part").select(k, upkeep.without_field(x).alias("slug"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1997-01-31' - 29 AND DATE '1997-01-31'")
def z_within_days(spark, d):
    return upkeep.within_days(table(spark, d, "orders"), "o_orderdate", "1997-01-31", 30).select("o_orderkey")
