from pyspark.sql import functions as F

from lexquarry.functions import text as t
from lexquarry.operators import upkeep
from lexquarry.sources import records


def test_projects(spark):
    rows = [("output/projects/a-b/WHY.md", "so"), ("output/projects/a-b/x.md", None), ("output/projects/c/WHY.md", None), ("output/projects/" + "d" * 41 + "/WHY.md", "so"), ("output/projects/loose.md", "x"), (None, None)]
    got = sorted((r.path[16:19], r.code) for r in upkeep.project_findings(spark.createDataFrame(rows, "path string, text string")).collect())
    assert got == [("c", "project-why"), ("ddd", "project-name")]
    assert upkeep.project_findings(spark.createDataFrame([], "path string, text string")).count() == 0


def test_lists_and_titles(spark, one):
    tags = F.array(F.lit("x"), F.lit("é\\"))
    assert one(upkeep.replaced_list(F.lit("tags:\n  - a\nz: 1"), "tags", tags)) == 'tags:\n  - "x"\n  - "é\\\\"\nz: 1'
    assert one(upkeep.replaced_list(F.lit("a: 1\ntags: [b]"), "tags", F.lit(None).cast("array<string>"))) == "a: 1\ntags: []"
    assert one(upkeep.replaced_list(F.lit("a: 1\n"), "tags", tags)) == 'a: 1\ntags:\n  - "x"\n  - "é\\\\"'
    assert one(upkeep.tex_title(F.lit("\\title{A {b} c}"))) == "A {b} c" and one(upkeep.tex_title(F.lit("\\title{ }"))) is None
    assert one(upkeep.without_field(F.lit("quantum-lattice-x"))) == "lattice-x"


def test_windows_and_backlog(spark):
    d = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-02"), ("c", "2024-01-03"), ("d", None)], "id string, day string").withColumn("day", F.to_date("day"))
    assert sorted(r.id for r in upkeep.within_days(d, "day", "2024-01-02", 1).collect()) == ["b"]
    b = spark.createDataFrame([("A", "a"), ("B", "b"), ("C", None)], "title string, legacy_title string")
    assert [r.title for r in upkeep.unfiled(b, spark.createDataFrame([("A",), ("b",), (None,)], "title string")).collect()] == ["C"]


def test_identities_and_pages(spark, one):
    assert tuple(one(t.identity(F.lit("10.48550/arXiv.2301.00001v2")))) == ("2301.00001", "10.48550/arxiv.2301.00001v2", "text")
    assert tuple(one(t.identity(F.lit(None).cast("string")))) == (None, None, "") and one(t.arxiv_id(F.lit("COND-MAT.aa/0101001"))) == "cond-mat.AA/0101001"
    p = records.accepted_page(spark.createDataFrame([("u", None, None)], "url string, final_url string, html string")).first()
    assert (p.ok, p.reason) == (False, "too short")
