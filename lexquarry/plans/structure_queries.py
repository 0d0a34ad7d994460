"""Folder rules over libraries made of the addresses and titles of pages, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.operators import structure
from lexquarry.plans.adapters import table

Q, SQL = {}, {}


def query(sql: str):
    def put(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


AREAS = {"en": "raw/articles", "fr": "wiki/concepts", "de": "datasets", "es": "inventory/items"}
BY_LETTER = {"T": "_index.md", "A": "config.md", "O": "raw/_index.md", "I": "wiki/concepts/_index.md", "R": "wikis.json", "E": "topics/", "L": "notes.txt", "D": "wiki/concepts/.backup/"}


def library_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root, path): a host is a library; an address lies in the folder of its language, with its own extension or closing
    slash, and a page's title adds one of the usual files."""
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "//([^/?#]+)", 1).alias("root"), F.regexp_extract("url", "//[^/]+/([a-z]+)/", 1).alias("lang"), F.regexp_extract("url", "//[^/]+/[a-z]+/([^?#]*)", 1).alias("rest"), "url", F.regexp_extract("html", "<title>([A-Z])", 1).alias("letter"))
    area = F.coalesce(*(F.when(F.col("lang") == k, a) for k, a in AREAS.items()), F.col("lang"))
    tail = F.when(F.col("lang") == "de", F.when(F.contains("url", F.lit("?")), "/MANIFEST.md").when(F.contains("url", F.lit("#")), "/samples/a.md").otherwise("/queries/a.sql")).otherwise("")
    own = p.select("root", F.concat(area, F.lit("/"), F.regexp_replace("rest", r"\.html$", ".md"), tail).alias("path"))
    usual = p.select("root", F.coalesce(*(F.when(F.col("letter") == k, x) for k, x in BY_LETTER.items()), F.lit("inbox/")).alias("path"))
    return own.unionByName(usual)


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"[{', '.join(repr(y) for y in x)}]::VARCHAR[]" if isinstance(x, tuple) else str(x) for x in r) + ")" for r in rows)


_ENTRIES = f"""
p AS (SELECT regexp_extract(url, '//([^/?#]+)', 1) AS root, regexp_extract(url, '//[^/]+/([a-z]+)/', 1) AS lang, regexp_extract(url, '//[^/]+/[a-z]+/([^?#]*)', 1) AS rest, url, regexp_extract(html, '<title>([A-Z])', 1) AS letter FROM pages),
f AS (SELECT root, CASE lang {" ".join(f"WHEN '{k}' THEN '{a}'" for k, a in AREAS.items())} ELSE lang END || '/' || regexp_replace(rest, '\\.html$', '.md')
    || CASE WHEN lang <> 'de' THEN '' WHEN contains(url, '?') THEN '/MANIFEST.md' WHEN contains(url, '#') THEN '/samples/a.md' ELSE '/queries/a.sql' END AS path FROM p
  UNION ALL SELECT root, CASE letter {" ".join(f"WHEN '{k}' THEN '{x}'" for k, x in BY_LETTER.items())} ELSE 'inbox/' END FROM p),
w AS (SELECT root, list_filter(string_split(path, '/'), lambda x: x <> '') AS w, path LIKE '%/' AS empty FROM f),
e AS (SELECT root, w, bool_or(is_folder) AS is_folder FROM (SELECT root, w[1:n] AS w, empty OR n < len(w) AS is_folder FROM (SELECT *, unnest(range(1, len(w) + 1)) AS n FROM w)) GROUP BY 1, 2),
kinds AS (SELECT root, CASE WHEN count(*) FILTER (WHERE w IN (['wikis.json'], ['topics'])) = 2 THEN 'hub' ELSE 'topic' END AS kind FROM e GROUP BY 1)"""


@query(f"""WITH {_ENTRIES},
n(rule, kind, need, severity, conditions) AS (VALUES {_values([(i, x.kind, x.path, x.severity, x.when) for i, x in enumerate(structure.NEEDS)])}),
k AS (SELECT root, array_to_string(w, '/') AS key, '' AS bound FROM e UNION ALL SELECT root, array_to_string(list_concat([w[1], '*'], w[3:]), '/'), w[2] FROM e WHERE len(w) > 1),
held AS (SELECT k.root, kind, severity, replace(need, '*', bound) AS need FROM n JOIN k ON list_contains(conditions, key) GROUP BY k.root, rule, kind, severity, need, bound, conditions HAVING count(DISTINCT key) = len(conditions)),
asked AS (SELECT root, need, severity FROM kinds JOIN n USING (kind) WHERE len(conditions) = 0 UNION SELECT root, need, severity FROM held JOIN kinds USING (root, kind))
SELECT root, need AS path, severity, CASE WHEN need LIKE '%\\_index.md' ESCAPE '\\' THEN 'index' WHEN contains(need, '.') THEN 'file' ELSE 'folder' END AS detail
FROM asked WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.root = asked.root AND array_to_string(e.w, '/') = asked.need)""")
def q_missing_structure(spark, d):
    return structure.missing(library_files(spark, d)).drop("code")


@query(f"""WITH {_ENTRIES},
c(kind, folder, names, folders, notes, ignored) AS (VALUES {_values([(x.kind, x.folder, x.names, x.folders, x.notes, x.ignored.replace("(?!)", "^$")) for x in structure.CLOSED])}),
k AS (SELECT *, array_to_string(w[:-2], '/') AS folder, w[-1] AS name FROM e),
m AS (SELECT root, w, is_folder, name, folder AS key FROM k UNION ALL SELECT root, w, is_folder, name, array_to_string(list_concat([w[1], '*'], w[3:-2]), '/') FROM k WHERE len(w) > 2),
j AS (SELECT m.root, m.w, is_folder, list_contains(names, name) OR (folders AND is_folder) OR (notes AND NOT is_folder AND name LIKE '%_.md') OR regexp_matches(name, ignored) AS fits
  FROM m JOIN c ON c.folder = m.key JOIN kinds ON kinds.root = m.root AND c.kind IN ('any', kinds.kind))
SELECT root, array_to_string(w, '/') AS path, CASE WHEN is_folder THEN 'folder' ELSE 'file' END AS detail FROM j GROUP BY root, w, is_folder HAVING NOT bool_or(fits)""")
def q_unknown_entries(spark, d):
    return structure.unknown(library_files(spark, d)).drop("code", "severity")
