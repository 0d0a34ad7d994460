import itertools
import os
import random

from pyspark.sql import functions as F

from lexquarry.operators import rewriting


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_put_in(spark, one):
    new = F.array(F.lit("<1>"), F.lit(None), F.lit("$2\\"))
    assert one(rewriting.put_in(F.col("x"), "[0-9]+", new), x="a1b22c333") == "a<1>b22c$2\\"
    assert one(rewriting.put_in(F.col("x"), "[0-9]+", new), x="1223") == "<1>"
    assert one(rewriting.put_in(F.col("x"), "[0-9]+", F.array().cast("array<string>")), x="none") == "none"


def test_normal_path(spark):
    cases = {"a//b/./c": "a/b/c", "a/../b": "b", "../x": None, "a/b/../../c": "c", "": "", "a/../../b": None, "/r/s": "r/s"}
    got = {r.p: r.n for r in frame(spark, [(k,) for k in cases], "p string").select("p", rewriting.normal_path(F.col("p")).alias("n")).collect()}
    assert got == cases


def test_figures_against_every_candidate(spark):
    """All folders and extensions tried one after another."""
    r = random.Random(6)
    names = ["a", "b.v2", "sub/c", "../d", ".e", "f"]
    found = [*rewriting.FIGURE_EXTENSIONS[:5], ".PDF", ".txt", ""]
    files = {f"{d}{n}{x}" for d in ("p/", "p/figs/", "p/own/", "p/img/", "") for n in ("a", "b", "b.v2", "sub/c", "d", ".e", "f") for x in found if r.random() < 0.12}
    docs, targets = [], []
    for k in range(25):
        own = r.choice([["own/"], ["./own", "../"], [], ["../../up"]])
        t = [r.choice(names) + r.choice(["", ".pdf", ".PDF", ".png", ".txt"]) for _ in range(4)]
        path = "" .join(["" if k % 5 == 0 else "p/", f"m{k}.tex"])
        text = ("\\graphicspath{" + "".join(f"{{{x}}}" for x in own) + "}\n" if own else "") + "\n".join(f"\\includegraphics[w=1]{{ {x} }} text" for x in t)
        docs.append((path, text))
        base = path.rpartition("/")[0]
        for i, x in enumerate(t):
            stem, ext = os.path.splitext(x)
            tries = ([x] if ext.lower() in rewriting.FIGURE_EXTENSIONS else []) + [stem + e for e in rewriting.FIGURE_EXTENSIONS]
            dirs = [os.path.normpath(os.path.join(base, d)) for d in ["", *own, *rewriting.FIGURE_FOLDERS]]
            dirs = ["" if d == "." else d for d in dirs]
            hit = next((p for d, c in itertools.product(dirs, tries) if not d.startswith("..") and (p := os.path.normpath(os.path.join(d, c))) in files), None)
            targets.append((path, i, x, hit))
    d = frame(spark, [*docs, ("none.tex", "no figures"), ("null.tex", None)], "path string, text string")
    f = frame(spark, [(x,) for x in files] * 2, "path string")
    got = rewriting.resolved_figures(rewriting.figure_targets(d), rewriting.figure_folders(d), f).collect()
    assert sorted(map(tuple, got), key=str) == sorted(targets, key=str)
    assert sum(x[3] is not None for x in targets) > 20 and sum(x[3] is None for x in targets) > 5


def test_repaired_links(spark):
    docs = [
        ("wiki/concepts/Spin_Liquid.md", "[ok](Spin_Liquid.md) [self](qsl.md)"),
        ("wiki/topics/t.md", "a [x](qsl.md) b [y](../concepts/qsl.md#sec) c [z](<old name.md>) [d](gone.md) [e](https://h/qsl.md) [f](/wiki/concepts/Spin_Liquid.md) [g](../../qsl.md) $1 \\2"),
        ("inventory/i.md", "[p](a_b.md)[p](a_b.md) tail"), ("raw/r.md", "[x](qsl.md)"), ("wiki/topics/n.md", None), ("wiki/topics/e.md", ""),
    ]
    d = frame(spark, docs, "path string, raw_text string")
    concepts = frame(spark, [("wiki/concepts/Spin_Liquid.md", ["QSL", "A b", "old name"]), ("wiki/concepts/Other.md", ["a-b"]), ("wiki/concepts/None.md", None)], "path string, aliases array<string>")
    got = {r.path: (r.raw_text, r.n_replaced) for r in rewriting.repaired_links(d, concepts).collect()}
    assert got == {
        "wiki/concepts/Spin_Liquid.md": ("[ok](Spin_Liquid.md) [self](Spin_Liquid.md)", 1),
        "wiki/topics/t.md": ("a [x](Spin_Liquid.md) b [y](../concepts/Spin_Liquid.md#sec) c [z](<old name.md>) [d](gone.md) [e](https://h/qsl.md) [f](/wiki/concepts/Spin_Liquid.md) [g](../../Spin_Liquid.md) $1 \\2", 3),
        "inventory/i.md": ("[p](Spin_Liquid.md)[p](Spin_Liquid.md) tail", 2),
    }
    found = rewriting.repairable_links(d, rewriting.aliases(concepts)).where("new_link is null").collect()
    assert {(r.path, r.link) for r in found} == {("wiki/topics/t.md", "gone.md"), ("wiki/topics/t.md", "old name.md")}
    # a second run changes nothing
    after = d.join(rewriting.repaired_links(d, concepts).select("path", F.col("raw_text").alias("new")), "path", "left").select("path", F.coalesce("new", "raw_text").alias("raw_text"))
    assert rewriting.repaired_links(after, concepts).count() == 0


def test_rewritten_images(spark):
    text = 'x ![a b.png](figs/b.png "t") ![](<two words.png>) ![k](images/ok.png) <img class="c" src=\'C:\\f.gif\'> <IMG SRC="https://x/y.png"> ![a](figs/b.png) ![u](other.png)'
    d = frame(spark, [("r/p.md", text), ("r/q.md", "nothing"), ("r/n.md", None)], "path string, text string")
    names = rewriting.image_names(d, F.lit("pp"))
    assert {(r.target, r.name) for r in names.collect()} == {("figs/b.png", "pp-b.png"), ("two words.png", "pp-two_words.png"), ("C:\\f.gif", "pp-f.gif"), ("other.png", "pp-other.png")}
    got = rewriting.rewritten_images(d, names.where("target <> 'other.png'")).collect()
    assert [(r.path, r.n_replaced) for r in got] == [("r/p.md", 4)]
    assert got[0].text == 'x ![a b.png](images/pp-b.png "t") ![](<images/pp-two_words.png>) ![k](images/ok.png) <img class="c" src=\'images/pp-f.gif\'> <IMG SRC="https://x/y.png"> ![a](images/pp-b.png) ![u](other.png)'
    assert rewriting.rewritten_images(d.where("false"), names).count() == 0
