from pyspark.sql import functions as F

from lexquarry.operators import library as lib


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_sources(spark):
    files = spark.createDataFrame([("wiki/references/spin-ice.md", "Spin Ice Review", ["SIR"]), ("raw/papers/2024-01-02-fractons.md", "F", []), ("raw/papers/tensor-network-methods.md", "T", None), ("raw/a/dup.md", "", []), ("raw/b/dup.md", "", [])], "path string, title string, aliases array<string>")
    refs = spark.createDataFrame([(x,) for x in ("raw/a/dup.md", "Spin Ice Review", "sir.md", "fractons.pdf", "network-methods", "dup.md", "nothing", None)], "ref string")
    assert rows(lib.resolved_sources(refs, files)) == {("raw/a/dup.md", "raw/a/dup.md", 1), ("Spin Ice Review", "wiki/references/spin-ice.md", 2), ("sir.md", "wiki/references/spin-ice.md", 2), ("fractons.pdf", "raw/papers/2024-01-02-fractons.md", 3), ("network-methods", "raw/papers/tensor-network-methods.md", 4), ("dup.md", None, None), ("nothing", None, None), (None, None, None)}


def test_cards(spark):
    c = spark.createDataFrame([("wiki/references/a-one.md",), ("wiki/references/a-two.md",)], "path string")
    x = spark.createDataFrame([("references/a-one.md",), ("a-two",), ("one",), ("a-",)], "target string")
    assert rows(lib.found_cards(x, c)) == {("references/a-one.md", "wiki/references/a-one.md", 1), ("a-two", "wiki/references/a-two.md", 1), ("one", "wiki/references/a-one.md", 1), ("a-", None, 2)}


def test_many_cards(spark):
    c = spark.createDataFrame([("wiki/references/a-one.md",), ("wiki/x.md",), ("plain.md",)], "path string")
    x = spark.range(10_500).selectExpr("concat('zz', id) as target").union(spark.createDataFrame([("on",), ("x",), ("n",), ("",), ("plain.md",), (None,)], "target string"))
    assert rows(lib.found_cards(x, c).where("matches > 0")) == {("on", "wiki/references/a-one.md", 1), ("x", "wiki/x.md", 1), ("n", None, 2), ("plain.md", "plain.md", 1)}
    assert lib.found_cards(x, c).count() == 10_506


def test_boxes_that_join_one_by_one(spark):
    # a spiral: each box meets the cluster only after the next inner one has joined it
    spiral, (x0, y0, x1, y1) = [], (0.0, 0.0, 1.0, 1.0)
    for k in range(12):
        box = [(x1 + 1, y0, x1 + 2, y1 + 2), (x0, y1 + 1, x1 + 2, y1 + 2)][k % 2]
        spiral.append((1, *box))
        x1, y1 = max(x1, box[2]), max(y1, box[3])
    b = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), *spiral[::-1], (1, 900.0, 0.0, 901.0, 1.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    assert rows(lib.clustered_boxes(b, 1.5).select("x0", "y0", "x1", "y1")) == {(0.0, 0.0, x1, y1), (900.0, 0.0, 901.0, 1.0)}


def test_names(spark):
    new, known = (spark.createDataFrame([(x,) for x in xs], "name string") for xs in (["spin liquids", "topological order", "zzz"], ["Spin Liquid", "Order", "Topological Orders"]))
    assert rows(lib.similar_names(new, known)) == {("spin liquids", "Spin Liquid"), ("topological order", "Topological Orders")}


def test_tags(spark):
    c = spark.createDataFrame([("a", ["x", "y", "drop", "x2"]), ("b", None)], "path string, tags array<string>")
    m = spark.createDataFrame([("x2", "x"), ("drop", "")], "tag string, canonical string")
    assert {r.path: r.tags for r in lib.mapped_tags(c, m).collect()} == {"a": ["x", "y"], "b": []}


def test_renames(spark):
    d = spark.createDataFrame([("p", "[[Spin Liquid]] [[spin-liquid|x]] [y](../concepts/spin-liquid.md) [[spin liquids]]")], "path string, text string")
    assert lib.renamed_links(d, "spin-liquid", "qsl").first().text == "[[qsl]] [[qsl|x]] [y](../concepts/qsl.md) [[spin liquids]]"


def test_merges(spark):
    c = spark.createDataFrame([("a", ["x"], ["A1"], "A", "one"), ("b", ["y", "x"], None, "B", "two"), ("c", [], [], "C", "three")], "path string, tags array<string>, aliases array<string>, title string, body string")
    got = {r.path: (r.tags, r.aliases, r.body) for r in lib.merged_cards(c, spark.createDataFrame([("a", "b")], "kept string, merged string")).collect()}
    assert got == {"a": (["x", "y"], ["A1", "B"], "one\n\ntwo"), "c": ([], [], "three")}


def test_pages(spark):
    c = spark.createDataFrame([("wiki/c/b.md", "b", "concepts", "x|y"), ("wiki/c/a.md", "A", "concepts", None)], "path string, title string, category string, summary string")
    r = lib.index_pages(c).first()
    assert r.files == 2 and r.page.endswith("| [[a]] |  |\n| [[b]] | x/y |\n")


def test_inbox(spark):
    f = spark.createDataFrame([("inbox/2024-03-01-my_note.md", "text"), ("inbox/x.md", "---\ntitle: T: t\ndate: 2024-02-03T01\n---\n"), ("inbox/y.md", "# Head line\n")], "path string, text string")
    assert rows(lib.inbox(f, "2025-01-01").select("title", "target")) == {("My Note", "raw/2024-03-01-my-note.md"), ("T: t", "raw/2024-02-03-t-t.md"), ("Head line", "raw/2025-01-01-head-line.md")}


def test_symptoms(spark):
    d = spark.createDataFrame([("m", "x\n| Symptom | Fix |\n|---|---|\n| slow | index |\n| odd | |\n\n| A | B |\n|---|---|\n| 1 | 2 |")], "path string, text string")
    assert rows(lib.symptoms(d)) == {("m", 4, "slow", "index"), ("m", 5, "odd", "")}


def test_boxes(spark):
    b = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (1, 5.0, 0.0, 6.0, 1.0), (1, 1.5, 0.0, 4.6, 1.0), (1, 20.0, 0.0, 21.0, 1.0), (2, 0.0, 0.0, 1.0, 1.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    assert rows(lib.clustered_boxes(b, 0.5).select("page", "x0", "x1")) == {(1, 0.0, 6.0), (1, 20.0, 21.0), (2, 0.0, 1.0)}


def test_concept_sources(spark):
    paths = ("raw/papers/Spin_Ice.md", "raw/papers/spin-ice.md", "wiki/references/spin.md", "wiki/references/a.md", "raw/papers/_index.md", "raw/papers/x/deep.md", "raw/papers/!.md")
    files = spark.createDataFrame([(x,) for x in paths], "path string")
    texts = ["the Spin Ice review", "spin ice", "PIN", "?", "zz", "../spin", "nothing deep", None, "spin ice"]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def named(x):
        seen.add(1)
        return x

    d = spark.createDataFrame([(x,) for x in texts], "text string").repartition(2).select(named("text").alias("ref"))
    first = ("raw/papers/Spin_Ice.md", "Spin_Ice")
    assert rows(lib.concept_sources(d, files)) == {("the Spin Ice review", *first), ("spin ice", *first), ("PIN", *first), ("?", "?", "?"), ("zz", "zz", "zz"), ("../spin", None, None), ("nothing deep", "nothing deep", "nothing deep")}
    # what the references are made of is worked out once for each
    assert seen.value == len(texts)
