"""Upkeep of a workspace: project folders, lists of tags, the backlog, titles and time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.functions import text as t
from lexquarry.operators import quality

PROJECTS = "output/projects/"
# A project's longest name, and words before a concept's name that say only its field.
LONGEST_NAME = 40
FIELD_PREFIXES = ("lattice-", "quantum-", "topological-")


def project_findings(files: DataFrame) -> DataFrame:
    """Warnings on projects without a WHY.md that says something, and on names that aren't short lower case words joined by
    hyphens, or hold a date. files(path, text); a project is a folder with any file in it."""
    d = files.where(F.startswith("path", F.lit(PROJECTS))).select(F.regexp_extract("path", f"^{PROJECTS}([^/]+)/", 1).alias("name"), "path", "text").where("name <> ''")
    says = (F.col("path") == F.concat(F.lit(PROJECTS), "name", F.lit("/WHY.md"))) & F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")
    p = d.groupBy("name").agg(F.max(says).alias("says")).withColumn("path", F.concat(F.lit(PROJECTS), "name"))
    good = F.col("name").rlike("^[a-z0-9][a-z0-9-]*$") & (F.length("name") <= LONGEST_NAME) & ~F.col("name").rlike("[0-9]{4}-[0-9]{2}-[0-9]{2}")
    return quality.findings(p.where("not says"), "project-why", "warning", F.lit("")).unionByName(quality.findings(p.where(~good), "project-name", "warning", F.col("name")))


def replaced_list(block: Column, name: str, values: Column, plain: bool = False) -> Column:
    """A frontmatter block with `values` as the list of a field, one a line, quoted unless they are to stay plain; a block
    without that list gets it at its end, and a null or empty array is written as `[]`."""
    quoted = values if plain else F.transform(values, lambda v: F.regexp_extract(F.to_json(F.array(v)), r"(?s)^\[(.*)\]$", 1))
    lines = F.array_join(F.transform(quoted, lambda q: F.concat(F.lit("\n  - "), q)), "")
    new = F.concat(F.lit(f"{name}:"), F.when(F.coalesce(F.size(values), F.lit(0)) > 0, lines).otherwise(" []"))
    # a split at the first list, as a replacement would read signs of the values as groups
    parts = F.split(block, rf"(?m)^{name}:[ \t]*(?:\[.*\][ \t]*$|$(?:\n[ \t]+- .*)*)", 2)
    return F.when(F.size(parts) > 1, F.concat(F.get(parts, F.lit(0)), new, F.get(parts, F.lit(1)))).otherwise(F.concat(F.rtrim(block, F.lit(" \n")), F.lit("\n"), new))


def ontology(tags: DataFrame) -> DataFrame:
    """The distinct tags that aren't empty, sorted."""
    return tags.select("tag").where("tag <> ''").distinct().orderBy("tag")


def unfiled(backlog: DataFrame, issues: DataFrame) -> DataFrame:
    """Rows of backlog(title, legacy_title, ...) that no issue(title) has under its title of either form."""
    titles = issues.select("title").where("title is not null").distinct()
    return backlog.join(titles, "title", "left_anti").join(titles.withColumnRenamed("title", "legacy_title"), "legacy_title", "left_anti")


def tex_title(c: t.Col) -> Column:
    """The title of a TeX source on one line; braces may nest once."""
    raw = t.found(c, r"\\title\s*(?:\[[^\]]*\]\s*)?\{((?:[^{}]|\{[^{}]*\})*)\}")
    return F.nullif(t.squeezed(F.replace(raw, F.lit("\\\\"), F.lit(" "))), F.lit(""))


def without_field(slug: Column) -> Column:
    """A concept's name without the word that says its field."""
    return F.regexp_replace(slug, "^(?:" + "|".join(FIELD_PREFIXES) + ")", "")


def within_days(rows: DataFrame, column: str, today: str, days: int) -> DataFrame:
    """Rows of the last `days` days up to `today`, which is counted; later ones and those without a date are left out."""
    age = F.datediff(F.lit(today).cast("date"), F.col(column))
    return rows.where((age >= 0) & (age < days))
