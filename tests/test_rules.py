from pyspark.sql import functions as F

from lexquarry.operators import rules


def found(df):
    return sorted((r.path, r.code, r.detail) for r in df.collect())


def test_misplaced(spark):
    rows = [("wiki/topics/a.md", "---\ncategory: concept\n---\n"), ("raw/papers/b.md", "---\ntype: papers\n---\n"), ("inventory/views/c.md", "---\nkind: item\n---\n"), ("datasets/x/MANIFEST.md", "---\ndataset_id: y\n---\n"), ("wiki/topics/d.md", None)]
    got = found(rules.misplaced(spark.createDataFrame(rows, "path string, raw_text string")))
    assert got == [("datasets/x/MANIFEST.md", "dataset-folder", "y"), ("wiki/topics/a.md", "misplaced", "wiki/concepts/a.md")]


def test_headings_and_provenance(spark):
    rows = [("wiki/concepts/a.md", "## 1. core definition\n"), ("wiki/references/b.md", "---\nexclude_structure_check: true\nsources: [raw/x.md, raw/y.md, https://z]\n---\n"), ("wiki/topics/c.md", "---\ncompiled-from: mixed\n---\nRETRACTED-SOURCE"), ("wiki/topics/d.md", "---\nsources: raw/x.md\n---\n")]
    d = spark.createDataFrame(rows, "path string, raw_text string")
    assert found(rules.missing_headings(d)) == [("wiki/concepts/a.md", "missing-heading", "Mathematical Formalism")]
    got = found(rules.provenance(d, spark.createDataFrame([("raw/x.md", "raw/x.md"), ("raw/y.md", None)], "ref string, path string")))
    assert got == [("wiki/concepts/a.md", "no-sources", ""), ("wiki/references/b.md", "lost-source", "raw/y.md"), ("wiki/topics/c.md", "retracted-source", ""), ("wiki/topics/d.md", "sources-no-list", "raw/x.md")]


def test_small_rules(spark, one):
    assert one(rules.sampled_pages(F.lit(4))) == [0, 1, 2, 3] and one(rules.sampled_pages(F.lit(0))) == [] and one(rules.sampled_pages(F.lit(100))) == [0, 20, 40, 59, 79, 99]
    assert one(rules.is_checked(F.lit("raw/a.md"))) and not one(rules.is_checked(F.lit("raw/.x/a.md"))) and not one(rules.is_checked(F.lit("x/a.md")))
    assert rules.not_stubs(spark.createDataFrame([("a", None), ("b", "stub"), ("c", "done")], "path string, status string")).first().path == "c"
    t = rules.split_tasks(spark.createDataFrame([(1, "[x] do", ["topic:x", "bug"]), (2, "[y] do", ["bug"])], "id int, title string, labels array<string>"), "x").orderBy("id").collect()
    assert [(r.title, r.topic, r.labels, r.is_here) for r in t] == [("do", "x", ["bug"], True), ("[y] do", None, ["bug"], False)]
