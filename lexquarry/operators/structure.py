"""What a library's folders must and may hold: rules with placeholders, matched against every level of every path.

files(root, path) are the files of any number of libraries; a path that ends with a slash is an empty folder. A rule's
path may have `*` for one part, and what it stood for in a condition is put in where the rule asks for something. Every
entry is looked up under its own path and under its path with stars, so rules meet entries in equi-joins with a small
table, and what is asked for meets the entries in one anti-join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The folders that every library has, those that need an index once they are there, and the names that
# each folder may hold.
FOLDERS = (
    "raw", "raw/articles", "raw/papers", "raw/repos", "raw/notes", "raw/data", "wiki", "wiki/concepts", "wiki/topics", "wiki/references",
    "wiki/theses", "output",
)
OPTIONAL = ("inventory", "inventory/items", "inventory/candidates", "inventory/entities", "inventory/corpora", "inventory/views", "datasets")
DATASET_FOLDERS = ("samples", "profiles", "queries")
HUB_NAMES = ("wikis.json", "_index.md", "log.md", "topics")
ROOT_NAMES = (
    "_index.md", "config.md", "config.yaml", "CLAUDE.md", "AGENTS.md", "log.md", "scratch", "raw", "wiki", "drafts", "inventory", "datasets",
    "output", "inbox",
)
AREA_NAMES = {
    "raw": ("articles", "papers", "repos", "notes", "data"),
    "wiki": ("concepts", "topics", "references", "theses"),
    "inventory": ("items", "candidates", "entities", "corpora", "views"),
}
BESIDE_NOTES = ("_index.md", ".backup", "images", ".images")


@dataclass(frozen=True)
class Need:
    """In libraries of this kind, where all of `when` are there, `path` must be."""

    path: str
    severity: str = "critical"
    when: tuple[str, ...] = ()
    kind: str = "topic"


@dataclass(frozen=True)
class Closed:
    """A folder that holds nothing but `names`, what `ignored` fits, and, if so said, any folder or any Markdown file."""

    folder: str
    names: tuple[str, ...]
    folders: bool = False
    notes: bool = False
    ignored: str = "(?!)"
    kind: str = "any"


NEEDS = (
    *(Need(n, kind="hub") for n in HUB_NAMES), Need("_index.md"), Need("config.md"), Need("inbox", "warning"), *(Need(f) for f in FOLDERS),
    *(Need(f"{f}/_index.md", when=(f,)) for f in (*FOLDERS, *OPTIONAL)), Need("datasets/*/_index.md", when=("datasets/*/MANIFEST.md",)),
    *(Need(f"datasets/*/{f}/_index.md", when=("datasets/*/MANIFEST.md", f"datasets/*/{f}")) for f in DATASET_FOLDERS),
)
CLOSED = (
    Closed("", ROOT_NAMES, ignored=r"^\.", kind="topic"), Closed("", HUB_NAMES, ignored=r"^\.", kind="hub"),
    *(Closed(a, ("_index.md", *names)) for a, names in AREA_NAMES.items()), Closed("datasets", ("_index.md",), folders=True),
    Closed("datasets/*", ("_index.md", "MANIFEST.md", *DATASET_FOLDERS)), *(Closed(f"datasets/*/{f}", ("_index.md",), notes=True) for f in DATASET_FOLDERS),
    *(Closed(f"{a}/{n}", BESIDE_NOTES, notes=True, ignored=r"^\.embeddings_cache|\.lock$") for a, names in AREA_NAMES.items() for n in names),
)


def entries(files: DataFrame) -> DataFrame:
    """(root, path, folder, name, is_folder): the files and all folders above them, each once."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    d = files.select("root", parts.alias("parts"), F.endswith("path", F.lit("/")).alias("empty"))
    level = F.explode(F.when(F.size("parts") > 0, F.sequence(F.lit(1), F.size("parts")))).alias("n")
    d = d.select("root", "parts", "empty", level).select("root", F.array_join(F.slice("parts", 1, F.col("n")), "/").alias("path"), (F.col("empty") | (F.col("n") < F.size("parts"))).alias("is_folder"))
    d = d.groupBy("root", "path").agg(F.max("is_folder").alias("is_folder"))  # a folder's files are counted out where they are read
    return d.withColumn("folder", F.regexp_replace("path", "/?[^/]*$", "")).withColumn("name", F.element_at(F.split("path", "/"), -1))


def kinds(found: DataFrame, roots: DataFrame) -> DataFrame:
    """roots(root) with `kind`: hub if wikis.json and topics are there, otherwise topic."""
    marks = found.where(F.col("path").isin("wikis.json", "topics")).groupBy("root").agg(F.count("*").alias("marks"))
    return roots.join(marks, "root", "left").select("root", F.when(F.col("marks") == 2, "hub").otherwise("topic").alias("kind"))


def _stars(patterns: Sequence[str]) -> list[tuple[int, ...]]:
    """The places of stars that occur."""
    return sorted({tuple(i for i, x in enumerate(p.split("/")) if x == "*") for p in patterns})


def _keyed(path: Column, patterns: Sequence[str]) -> Column:
    """An array of (key, bound) for a path: the path with stars at each set of places, and what stood there."""
    parts = F.split(path, "/")
    one = lambda at: F.struct(
        F.array_join(F.transform(parts, lambda x, i: F.when(i.isin(*at), "*").otherwise(x)) if at else parts, "/").alias("key"),
        F.array(*(F.get(parts, F.lit(i)) for i in at)).cast("array<string>").alias("bound"),
    )
    return F.array_compact(F.array(*(F.when(F.size(parts) > max(at, default=-1), one(at)) for at in _stars(patterns))))


def _filled(pattern: Column, bound: Column) -> Column:
    """A pattern with its stars replaced from left to right."""
    return F.aggregate(bound, pattern, lambda p, x: F.concat(F.substring_index(p, "*", 1), x, F.substr(p, F.instr(p, "*") + 1)))


def missing(files: DataFrame, roots: DataFrame | None = None, needs: Sequence[Need] = NEEDS) -> DataFrame:
    """findings(root, path, code, severity, detail) for what must be there and isn't. roots(root) also names libraries
    without files. If a library lacks a folder, only the folder is missing, not its index."""
    found = entries(files)
    roots = files.select("root").distinct() if roots is None else roots.select("root").distinct()
    rules = [(i, n.kind, n.path, n.severity, list(n.when), len(n.when)) for i, n in enumerate(needs)]
    table = F.broadcast(files.sparkSession.createDataFrame(rules, "rule int, kind string, need string, severity string, conditions array<string>, many int"))
    libraries = kinds(found, roots)
    always = libraries.join(table.where("many = 0"), "kind").select("root", "need", "severity")
    asked = [w for n in needs for w in n.when]
    if asked:
        conditions = table.select("rule", "kind", "need", "severity", "many", F.explode("conditions").alias("key"))
        held = found.select("root", F.inline(_keyed(F.col("path"), asked))).join(F.broadcast(conditions), "key")
        # all conditions of a rule by what the stars stand for; a rule's conditions have the same stars
        held = held.groupBy("root", "rule", "kind", "need", "severity", "many", "bound").agg(F.count_distinct("key").alias("n")).where("n = many")
        held = held.join(libraries, ["root", "kind"]).select("root", _filled(F.col("need"), F.col("bound")).alias("need"), "severity")
        always = always.unionByName(held)
    lost = always.distinct().join(found.select("root", F.col("path").alias("need")), ["root", "need"], "left_anti")
    what = F.when(F.endswith("need", F.lit("_index.md")), "index").when(F.contains("need", F.lit(".")), "file").otherwise("folder")
    return lost.select("root", F.col("need").alias("path"), F.lit("missing-structure").alias("code"), "severity", what.alias("detail"))


def unknown(files: DataFrame, closed: Sequence[Closed] = CLOSED) -> DataFrame:
    """findings(root, path, code, severity, detail) for files and folders where they don't belong. What lies in a folder
    that is itself unknown isn't judged."""
    found = entries(files)
    rules = [(c.kind, c.folder, list(c.names), c.folders, c.notes, c.ignored) for c in closed]
    table = F.broadcast(files.sparkSession.createDataFrame(rules, "rule_kind string, key string, names array<string>, folders boolean, notes boolean, ignored string"))
    d = found.select("root", "path", "name", "is_folder", F.explode(_keyed(F.col("folder"), [c.folder for c in closed])["key"]).alias("key")).join(table, "key")
    fits = F.array_contains("names", F.col("name")) | (F.col("folders") & F.col("is_folder")) | F.expr("name rlike ignored")
    fits |= F.col("notes") & ~F.col("is_folder") & F.col("name").rlike(r".\.md$")
    # an entry may come under several keys of one folder: any rule that allows it counts
    d = d.join(kinds(found, files.select("root").distinct()), "root").where("rule_kind IN ('any', kind)")
    d = d.groupBy("root", "path").agg(F.bool_or(fits).alias("fits"), F.max("is_folder").alias("is_folder"))
    return d.where("NOT fits").select("root", "path", F.lit("unknown-entry").alias("code"), F.lit("warning").alias("severity"), F.when(F.col("is_folder"), "folder").otherwise("file").alias("detail"))
