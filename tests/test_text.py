import pytest
from pyspark.sql import functions as F

from lexquarry.functions import text as t


@pytest.mark.parametrize(
    ("fn", "value", "expected"),
    [
        (t.slug, "Spin_Liquids: a (short) Review", "spin-liquids-a-short-review"),
        (t.slug, "量子 自旋 Néel", "量子-自旋-néel"),
        (t.slug, "word " * 30, "-".join(["word"] * 16)),
        (t.link_key, "  Spin_Liquid ", "spin liquid"),
        (t.index_text, "量子自旋x液", " 量子 子自 自旋 x 液 "),
        (t.terms, "Néel 量子自旋 cond-mat", ["néel", "量子", "子自", "自旋", "cond", "mat"]),
        (t.wikilinks, "[[A]] and [[b|c]] [[d#e]]", ["A", "b", "d#e"]),
        (t.markdown_links, "[x](a.md) [y](<b c.md>) (z)", ["a.md", "b c.md"]),
        (t.image_targets, '![x](a.png) <img src="b.png"> ![y](<c d.png> "t")', ["a.png", "c d.png", "b.png"]),
        (t.image_targets, "<IMG alt=x src=a.png><embed src='b c.pdf'/> <img data-x='1'>", ["a.png", "b c.pdf"]),
        (t.image_targets, None, None),
        (t.image_kind, "images/../x.png", "escaping"),
        (t.image_kind, "//cdn/x.png", "external"),
        (t.image_kind, "C:\\x.png", "absolute"),
        (t.image_kind, "images/x.png", "portable"),
        (t.safe_name, "a\\b c(1).png", "b_c_1_.png"),
        (t.safe_name, "...", "image"),
        (t.arxiv_id, "arXiv:2405.00208v3 [physics]", "2405.00208"),
        (t.arxiv_id, "COND-MAT/0506438", "cond-mat/0506438"),
        (t.arxiv_id, "math.ag/0601001", "math.AG/0601001"),
        (t.arxiv_id, "figures/1234567", None),
        (t.arxiv_id, "see 1234.567890 and abs/2101.00001v2", "2101.00001"),
        (t.arxiv_id, "hep-th/9711200v3", "hep-th/9711200"),
        (t.arxiv_id, "x2405.00208", None),
        (t.doi, "<https://doi.org/10.1000/A-b(c)1>, 10.1/x", "10.1000/a-b(c)1"),
        (t.doi, "110.1000/x", None),
        (t.prose, "a $$x\ny$$ b $c$", "a   b  "),
        (t.prose, "a\n```py\nx\n```\nb\n```\nopen", "a\n \nb\n \nopen"),
        (t.prose, "a $x$ costs $5", "a   costs  5"),
        (t.doi, "see https://doi.org/10.1103/PhysRevB.1.2).", "10.1103/physrevb.1.2"),
        (t.arxiv_in_doi, "10.48550/arXiv.2405.00208", "2405.00208"),
        (t.arxiv_in_doi, "10.1000/182", None),
        (t.source_type, "https://x.org", "url"),
        (t.source_type, "10.1000/182", "doi"),
        (t.source_type, "cond-mat/0001002", "arxiv"),
        (t.source_type, "notes/a.b.pdf", "file"),
        (t.snippet, "a \n b", "a b"),
        (t.ellipsized, "word " * 200, ("word " * 99).strip() + " word…"),
        (t.authors, "A B; C and D, E", ["A B", "C", "D", "E"]),
        (t.frontmatter, "---\r\na: 1\r\n---\r\nx", "a: 1"),
        (t.frontmatter, "x\n---\na\n---\n", None),
        (t.body, "---\na: 1\n---\nx\n", "x\n"),
        (t.collection_of, "wiki/concepts/a.md", "concepts"),
        (t.collection_of, "raw/papers/a.md", "raw"),
        (t.collection_of, "a.md", "other"),
        (t.page_number, "out/page_012.md", 12),
        (t.page_number, "cover.md", 999999),
        (t.html_title, "<title>[2405.1] A &amp; B</title>", "A & B"),
        (t.redacted, "llm.api_key: abc\nname: x", "llm.api_key: ***\nname: x"),
        (t.prose, "a $x$ b\n```\n\\ref{}\n```\nc", "a   b\n \nc"),
    ],
)
def test_functions(one, fn, value, expected):
    assert one(fn(F.lit(value))) == expected


def test_nulls(one):
    for fn in (t.slug, t.arxiv_id, t.doi, t.image_kind, t.snippet, t.frontmatter, t.safe_name):
        assert one(fn(F.lit(None).cast("string"))) in (None, "bare", "portable", "elsewhere") or fn is t.safe_name


def test_fields(one):
    block = "title: 'A: b'\ntags: [x, \"y,z\"]\naliases:\n  - q\n  - \"r s\"\nempty:\n"
    assert one(t.scalar_field(F.lit(block), "title")) == "A: b"
    assert one(t.scalar_field(F.lit(block), "empty")) is None
    assert one(t.list_field(F.lit(block), "tags")) == ["x", "y,z"]
    assert one(t.list_field(F.lit(block), "aliases")) == ["q", "r s"]


def test_names_and_globs(one):
    assert one(t.namespaced(F.lit("2401.1"), F.lit("fig 1.png"))) == "2401.1-fig_1.png"
    assert one(t.namespaced(F.lit("s"), F.lit("s-fig.png"))) == "s-fig.png"
    assert len(one(t.namespaced(F.lit("s"), F.lit("x" * 200 + "1.png")))) == 110
    assert one(F.lit("raw/src3/a1.md").rlike(t.glob_pattern("raw/*[0-9].md")))
    assert not one(F.lit("raw/x.mdx").rlike(t.glob_pattern("raw/?.md")))


def test_titles(one):
    assert one(t.titles_match(F.lit("Fractons"), F.lit("Fractons!")))
    assert one(t.titles_match(F.lit(None).cast("string"), F.lit("x")))
    assert not one(t.titles_match(F.lit("spin ice in two"), F.lit("spin glass review")))
