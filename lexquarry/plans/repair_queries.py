"""Repaired articles, merged stores and runs of a queue, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.operators import ledger, repair
from lexquarry.plans.adapters import folder, table
from lexquarry.sources import store

Q, SQL = {}, {}


def query(sql: str):
    def put(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, raw_text): documents on one line as articles; their length decides what of the frontmatter is there."""
    d, n = table(spark, sf_dir, "documents"), F.col("n_chars")
    folder = F.when(F.col("lang") == "en", "concepts").when(F.col("lang") == "fr", "theses").when(F.col("lang") == "de", "topics").otherwise("notes")
    block = F.concat_ws(
        "\n", F.concat(F.lit("title: "), F.col("source")), F.when(n % 2 == 0, "category: concept"), F.when(n % 3 > 0, "summary: s").when(n % 2 == 0, "summary:"),
        F.when(n % 5 < 2, "tags: [a]").when(n % 5 == 2, "tags: []").when(n % 5 == 3, "tags:\n  - x"), F.when(n % 7 < 3, F.concat(F.lit("created: 2024-01-0"), (n % 7 + 1).cast("string"))),
        F.when(n % 11 < 5, "updated: 2024-02-01"), F.when(n % 4 == 0, "verified: 2024-03-01"), F.when(n % 13 < 6, "volatility: hot"),
    )
    return d.select(F.concat(F.lit("wiki/"), folder, F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("---\n"), block, F.lit("\n---\n"), F.translate("text", '\n"', " \\")).alias("raw_text"))


@query(r"""WITH x AS (SELECT doc_id, source, n_chars AS n, translate(text, chr(10) || '"', ' \') AS body, CASE lang WHEN 'en' THEN 'concepts' WHEN 'fr' THEN 'theses' WHEN 'de' THEN 'topics' ELSE 'notes' END AS folder FROM documents),
s AS (SELECT *, rtrim(substr(trim(regexp_replace(translate(body, '*_`', ''), '\s+', ' ', 'g')), 1, 260)) AS p FROM x),
y AS (SELECT *, CASE WHEN length(p) >= 40 AND NOT regexp_matches(trim(body), '^(#|\||- |[0-9]+\.\s|---$)') THEN p ELSE 'Compiled wiki article.' END AS summary,
  CASE WHEN n % 7 < 3 THEN '2024-01-0' || (n % 7 + 1) WHEN n % 11 < 5 THEN '2024-02-01' WHEN n % 4 = 0 THEN '2024-03-01' ELSE '2024-12-31' END AS created FROM s),
z AS (SELECT *, CASE WHEN n % 11 < 5 THEN '2024-02-01' ELSE created END AS updated FROM y)
SELECT 'wiki/' || folder || '/d' || doc_id || '.md' AS path, '---' || chr(10) || concat_ws(chr(10), 'title: ' || source, CASE WHEN n % 3 = 0 THEN 'summary: "' || replace(replace(summary, '\', '\\'), '"', '\"') || '"' END,
    CASE WHEN n % 2 = 1 AND folder IN ('concepts', 'topics') THEN 'category: ' || folder[:-2] END, CASE WHEN n % 2 = 0 THEN 'category: concept' END, CASE WHEN n % 3 > 0 THEN 'summary: s' END,
    CASE WHEN n % 5 < 2 THEN 'tags: [a]' WHEN n % 5 = 3 THEN 'tags:' || chr(10) || '  - x' END, CASE WHEN n % 7 < 3 THEN 'created: ' || created END, CASE WHEN n % 11 < 5 THEN 'updated: 2024-02-01' END, CASE WHEN n % 4 = 0 THEN 'verified: 2024-03-01' END, CASE WHEN n % 13 < 6 THEN 'volatility: hot' END,
    CASE WHEN n % 5 IN (2, 4) THEN 'tags: [' || CASE folder WHEN 'theses' THEN 'thesis' ELSE folder[:-2] END || ']' END, CASE WHEN n % 7 >= 3 THEN 'created: ' || created END, CASE WHEN n % 11 >= 5 THEN 'updated: ' || updated END, CASE WHEN n % 13 >= 6 THEN 'volatility: warm' END)
  || chr(10) || '---' || chr(10) || body AS raw_text
FROM z WHERE n % 3 = 0 OR n % 5 IN (2, 4) OR n % 7 >= 3 OR n % 11 >= 5 OR n % 13 >= 6 OR (n % 2 = 1 AND folder IN ('concepts', 'topics'))""")
def q_completed(spark, d):
    return repair.completed(_articles(spark, d), "2024-12-31").drop("added")


@query("""SELECT user_id, event_type, max(event_id) AS event_id, arg_max(props, event_id) AS props, arg_min(value, event_id) AS value, max(ts) AS ts FROM events GROUP BY user_id, event_type""")
def k_merged_store(spark, d):
    """Events merged in three batches into the last properties, first value and latest time of each user and kind."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "props", "value", "ts")
    s = store.Store(folder(spark), "user_id long, event_type string, event_id long, props string, value double, ts timestamp", ("user_id", "event_type"), "event_id", 8, {"value": store.first, "ts": store.largest})
    cuts = e.selectExpr("max(event_id) div 3").first()[0] or 0
    for k in range(3):
        s.merge(e.where((F.col("event_id") > k * cuts - (k == 0)) & ((F.col("event_id") <= (k + 1) * cuts) | F.lit(k == 2))))
    return s.read(spark)


@query("""WITH e AS (SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN 'b' || event_id END AS opened FROM events WHERE event_type IN ('error', 'signup', 'view'))
SELECT * FROM (SELECT event_id AS offset, 'r' || event_id AS req_id, first_value(opened IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS run, event_type FROM e) WHERE event_type <> 'error'""")
def z_runs(spark, d):
    """Signups and views are enqueued, errors open runs."""
    e = table(spark, d, "events").where("event_type IN ('error', 'signup', 'view')")
    kind = F.when(F.col("event_type") == "error", "open").otherwise("enqueue")
    id_ = F.col("event_id").cast("string")
    return ledger.runs(e.select(F.col("event_id").alias("offset"), kind.alias("kind"), F.concat(F.lit("r"), id_).alias("req_id"), F.concat(F.lit("b"), id_).alias("batch_id"))).join(e.select(F.col("event_id").alias("offset"), "event_type"), "offset")
