import random
import re

import pytest
from pyspark.sql import functions as F

from lexquarry.operators import listings


def text_of(lines):
    """The lines of one page in their order."""
    return [r.line for r in lines.orderBy("place").collect()]


def test_reports_and_drafts(spark):
    rows = [
        ("inbox/radar/2024-01-02-digest.md", "---\nstatus: pending-review\n---\n", 2.0, 1), ("inbox/radar/2024-01-03-citation-gaps.md", "status: pending-review", 1.0, 1), ("inbox/radar/2024-01-02-digest-2.md", None, 1.0, 0),
        ("inbox/radar/notes.md", "", 1.0, 1), ("inbox/radar/old/2023-digest.md", "", 1.0, 1), ("drafts/a.md", "---\ntitle: 'It''s'\n---\n# H", 5.0, 9), ("drafts/s/b.md", "x\n#  Head line \n", 6.0, 9), ("drafts/c.md", None, 6.0, 0), ("drafts/d.txt", "", 9.0, 0),
        ("drafts/e.md", "y" * 3000 + "\n# far", 1.0, 9), ("drafts/f.md", "---\ntitle:\n---\n# T", 0.0, 1),
    ]
    f = spark.createDataFrame(rows, "path string, text string, mtime double, size long")
    got = listings.reports(f).orderBy(F.desc("name")).collect()
    assert [(r.name, r.kind, r.status) for r in got] == [("2024-01-03-citation-gaps.md", "citation-gap", "reviewed"), ("2024-01-02-digest.md", "digest", "pending-review"), ("2024-01-02-digest-2.md", "digest", "reviewed")]
    assert [(r.name, r.title) for r in listings.drafts(f).collect()] == [("c.md", None), ("b.md", "Head line"), ("a.md", "It''s"), ("e.md", None), ("f.md", "T")]


def test_chosen_documents(spark):
    rows = [("a", 0, "x.md", 9), ("a", 1, "z/full.md", 1), ("a", 2, "full.md", 5), ("b", 0, "my-full.md", 1), ("b", 1, "big.md", 99), ("c", 0, "s.md", 5), ("c", 1, "l.md", 7), ("c", 2, "l2.md", 7), ("d", 0, "x.txt", 1)]
    got = dict(listings.chosen_documents(spark.createDataFrame(rows, "archive string, ord int, name string, size long")).collect())
    assert got == {"a": "z/full.md", "b": "my-full.md", "c": "l.md"}


def test_topic_paths(spark):
    rows = [("a", None, None), ("b", "", "archived"), ("c", "<HUB>/x", None), ("d", "HUB", None), ("e", "~/w", None), ("f", "/abs", None), ("g", "rel/p", None), ("h", ".", None)]
    got = dict(listings.topic_paths(spark.createDataFrame(rows, "slug string, path string, status string"), "/hub/", "/home/u").collect())
    assert got == {"a": "/hub/topics/a", "b": "/hub/topics/.archive/b", "c": "/hub/x", "d": "/hub/", "e": "/home/u/w", "f": "/abs", "g": "/hub/rel/p", "h": "/hub/"}


def test_free_names_one_after_another(spark):
    r = random.Random(8)
    paths = ["a/x.md", "a/x-2.md", "a/x", "x.tar.gz", "a/.md", "a/x-02.md", "a/y.md", "a/x-1.md"]
    existing = {p for p in paths + [f"a/y-{k}.md" for k in (2, 3, 5, 6, 10)] + ["a/x-3.md"] if r.random() < 0.8}
    wanted = [r.choice([p for p in paths if p != "a/x-2.md"]) for _ in range(30)]

    def number(path, taken):
        head, _, name = path.rpartition("/")
        stem, ext = (name[: name.rindex(".")], name[name.rindex(".") :]) if "." in name.lstrip(".") else (name, "")
        head = head + "/" if head else ""
        n = 1
        while (c := f"{head}{stem}{'' if n == 1 else f'-{n}'}{ext}") in taken:
            n += 1
        return c

    taken, want = set(existing), {}
    for k, p in enumerate(wanted):
        want[k] = number(p, taken)
        taken.add(want[k])
    got = listings.free_names(spark.createDataFrame(list(enumerate(wanted)), "ord int, path string"), spark.createDataFrame([(p,) for p in existing] * 2, "path string"))
    assert {x.ord: x.given for x in got.collect()} == want


def test_pages(spark, tmp_path):
    c = spark.createDataFrame([("wiki/concepts/b.md", "B | b", "s\n s", ["x", "y"], "2024"), ("wiki/concepts/a b.md", None, None, None, None), ("wiki/_index.md", "I", "", [], ""), ("wiki/w.md", "W", "", [], "")], "path string, title string, summary string, tags array<string>, updated string")
    lines = listings.directory_pages(c, "2024-06-01")
    assert text_of(lines.where("page = 'wiki/concepts/_index.md'"))[-2:] == ["| [a b](<a b.md>) |  |  |  |", "| [B \\| b](b.md) | s s | x, y | 2024 |"]
    assert text_of(lines.where("page = 'wiki/_index.md'"))[0] == "# Wiki Index"
    listings.write_pages(lines, f"{tmp_path}/pages")
    back = listings.pages_of(spark, f"{tmp_path}/pages").collect()
    assert sorted((r.page, r.line) for r in back) == sorted((r.page, r.line) for r in lines.collect())
    before = spark.createDataFrame([("raw/old.md",), ("wiki/x.md",)], "path string")
    lost = spark.createDataFrame([("raw/a.md",), ("raw/old.md",)], "path string")
    page = text_of(listings.coverage_page(lost, before, c, "2024-06-01"))
    assert page[7:11] == ["sources:", "  - raw/a.md", "  - raw/old.md", "---"] and page[-1] == "| [old](../../raw/old.md) | `raw/old.md` |  |  |"
    assert listings.coverage_page(lost.where("false"), before.where("false"), c, "d").count() == 0
    g = spark.createDataFrame([("24`1", "T\n t", 2024, "2401.1", 3, ["r1", "r2"], "word " * 200), ("2402.2", None, None, "2401.1", 9, [], None)], "id string, title string, year int, own_paper string, shared_refs long, shared_titles array<string>, abstract string")
    page = text_of(listings.gap_page(g, "2024-06-01"))
    assert page.index("## (untitled)") < page.index("## T t") and "candidates: 2" in page and "- id: `24'1` · 2024 · source: citation-gap" in page and "- shared references include: r1; r2" in page
    assert any(x.startswith("- abstract: word") and x.endswith("…") for x in page) and listings.gap_page(g.where("false"), "d").count() == 0


def test_harvest(spark, tmp_path):
    c = spark.createDataFrame([("a", "s2", "T"), ("b", "x", "U")], "id string, source string, title string")
    listings.harvest(c, str(tmp_path), "2024-06-01")
    listings.harvest(c.where("id = 'b'"), str(tmp_path), "2024-06-02")
    assert sorted((r.id, r.first_seen) for r in spark.read.json(f"{tmp_path}/seen").collect()) == [("a", "2024-06-01"), ("b", "2024-06-01"), ("b", "2024-06-02")]
    assert spark.read.json(f"{tmp_path}/candidates").count() == 3
    (tmp_path / "blocked").mkdir()
    (tmp_path / "blocked" / "candidates").write_text("a file where a folder must be")
    with pytest.raises(Exception, match="candidates"):
        listings.harvest(c, f"{tmp_path}/blocked", "d")
    assert spark.read.json(f"{tmp_path}/blocked/seen").count() == 2  # seen, though not logged


@pytest.mark.parametrize(("text", "label"), [
    ("Fig. 5", "Fig 5"), ("FIG. 16 where we", "Fig 16"), ("Fig. 16, where we", None), ("Figure 2: x", "Figure 2"), ("Table 3 Results", "Table 3"), ("Table 3 shows", None), ("figure 2: x", None), ("Figures 2: x", None), ("  Scheme 1|x", "Scheme 1"),
    ("Figure x", None), ("Fig 12a", None), ("TABLE 7, y", "Table 7"),
])
def test_captions(one, text, label):
    assert one(listings.caption_label("x"), x=text) == label


def test_small_helpers(spark, one):
    p = listings.alias_pattern(["Spin", "C++", "自旋", "", "a_"])
    assert [bool(re.search(p, x)) for x in ("the spin.", "spins", "in C++ code", "一自旋二", "ba_", "A_ x")] == [True, False, True, True, False, True]
    assert one(F.lit("the SPIN").rlike(p)) and not one(F.lit("spinning").rlike(p))
    assert one(listings.figure_slug(F.lit("cond-mat/0001"))) == "cond-mat-0001"
    assert [one(listings.archive_slug(F.lit(x))) for x in ("a.tar.gz", "B.TGZ", "m.tex", "x.y.pdf", "none", ".hidden")] == ["a", "B", "m", "x.y", "none", ".hidden"]
    d = spark.createDataFrame([("p", "![x](/static/i.svg) ![y](f.png) <img src='/a.png'>")], "path string, text string")
    assert listings.with_site(d).first().text == "![x](https://arxiv.org/static/i.svg) ![y](f.png) <img src='https://arxiv.org/a.png'>"
