from lexquarry.operators import structure

WHOLE = [f"{f}/_index.md" for f in structure.FOLDERS] + ["_index.md", "config.md", "inbox/"]


def files(spark, **roots):
    return spark.createDataFrame([(r, p) for r, ps in roots.items() for p in ps], "root string, path string")


def found(df):
    return sorted((r.root, r.path, r.detail) for r in df.collect())


def test_a_whole_library_has_no_findings(spark):
    f = files(spark, a=[*WHOLE, "wiki/concepts/x.md", ".git/config", "raw/papers/images/p.png", "raw/papers/.embeddings_cache.db", "wiki/theses/t.md.lock"])
    assert structure.missing(f).count() == 0 and structure.unknown(f).count() == 0


def test_missing(spark):
    f = files(
        spark,
        a=[p for p in WHOLE if not p.startswith(("inbox", "wiki/topics", "raw/data/"))] + ["raw/data/d.md", "inventory/items/i.md", "datasets/d1/MANIFEST.md", "datasets/d1/samples/s.md", "datasets/d2/queries/q.md"],
        hub=["wikis.json", "topics/t/config.md", "log.md"],
    )
    assert found(structure.missing(f)) == [
        ("a", "datasets/_index.md", "index"), ("a", "datasets/d1/_index.md", "index"), ("a", "datasets/d1/samples/_index.md", "index"), ("a", "inbox", "folder"), ("a", "inventory/_index.md", "index"),
        ("a", "inventory/items/_index.md", "index"), ("a", "raw/data/_index.md", "index"), ("a", "wiki/topics", "folder"), ("hub", "_index.md", "index"),
    ]
    assert {r.path: r.severity for r in structure.missing(f).collect()}["inbox"] == "warning"
    # a library without a single file lacks everything
    roots = spark.createDataFrame([("empty",)], "root string")
    assert structure.missing(files(spark, a=WHOLE), roots).count() == 3 + len(structure.FOLDERS)
    assert structure.missing(f.where("false")).count() == 0


def test_unknown(spark):
    f = files(
        spark,
        a=[*WHOLE, "misc/x/y.md", "todo.txt", "raw/papers/a.pdf", "raw/papers/deep/b.md", "raw/other/c.md", "datasets/loose.csv", "datasets/d/MANIFEST.md", "datasets/d/extra/e.md", "datasets/d/samples/s.csv", "datasets/d/samples/ok.md"],
        hub=["wikis.json", "topics/t/anything.bin", "raw/odd.txt", "wiki/x", ".hidden"],
    )
    assert found(structure.unknown(f)) == [
        ("a", "datasets/d/extra", "folder"), ("a", "datasets/d/samples/s.csv", "file"), ("a", "datasets/loose.csv", "file"), ("a", "misc", "folder"), ("a", "raw/other", "folder"),
        ("a", "raw/papers/a.pdf", "file"), ("a", "raw/papers/deep", "folder"), ("a", "todo.txt", "file"), ("hub", "raw", "folder"), ("hub", "raw/odd.txt", "file"), ("hub", "wiki", "folder"), ("hub", "wiki/x", "file"),
    ]


def test_rules_are_parameters(spark):
    f = files(spark, r=["x/a/mark", "x/b/mark", "x/b/need", "x/c/other"])
    assert found(structure.missing(f, needs=[structure.Need("x/*/need", "warning", ("x/*/mark",))])) == [("r", "x/a/need", "folder")]
    two = structure.Need("*/*/both", when=("*/*/mark", "*/*/need"))
    assert found(structure.missing(f, needs=[two])) == [("r", "x/b/both", "folder")]
    assert found(structure.unknown(f, [structure.Closed("x/*", ("mark",))])) == [("r", "x/b/need", "file"), ("r", "x/c/other", "file")]
