import random

from lexquarry.operators import logs, outputs


def found(df):
    return sorted((r.path, r.code, r.detail) for r in df.collect())


def docs(spark, **texts):
    return spark.createDataFrame([(f"output/{k}.md", v) for k, v in texts.items()], "path string, raw_text string")


def files(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def test_thesis(spark):
    d = docs(
        spark, good="---\ntitle: t\ncreated: d\ntype: \"thesis\"\nsources:\n  - raw/a.md\n---\n# H\n[[Spin Liquid]] [[x|shown]]\n",
        bad="---\ntype: essay\nsources: [raw/a.md]\n---\nno heading [[gone]]", bare="# only text", none=None,
    )
    f = files(spark, "wiki/concepts/Spin_Liquid.md", "wiki/references/x.md", "wiki/topics/gone.md")
    assert found(outputs.thesis(d, f)) == [
        ("output/bad.md", "dangling-wikilink", "gone"), ("output/bad.md", "missing-field", "created"), ("output/bad.md", "missing-field", "title"), ("output/bad.md", "no-heading", ""),
        ("output/bad.md", "no-sources", ""), ("output/bad.md", "wrong-type", "essay"), ("output/bare.md", "no-frontmatter", ""), ("output/none.md", "no-frontmatter", ""),
    ]
    assert outputs.thesis(d.where("false"), f).count() == 0


def test_research(spark):
    long = "This paragraph claims something at length, and it cites nothing at all."
    body = "\n\n".join([
        "# " + long, "| " + long, "> " + long, "- " + long, "* " + long, "*" + long, long, "  " + long + " [[a]]", long + " [b](c)", "short", "Proof: " + long, "let, " + long, "We have " + long, long + " $$x$$", "\\int " + long,
        "<!-- " + long + "\n\n" + long + " -->", long + "\nof two lines",
    ])
    d = docs(spark, r="---\ntitle: t\ncreated: d\nsources:\n  - raw/a.md\n  - 'raw/papers'\n  - raw/../raw/a.md\n  - https://x\n  - gone.md\n  - /home/u/raw/x/wiki/b.md\n  - /home/u/b.md\n   note\n---\n" + body)
    f = files(spark, "raw/a.md", "raw/papers/p.md", "wiki/b.md")
    assert found(outputs.research(d, f)) == [("output/r.md", "lost-source", "/home/u/b.md"), ("output/r.md", "lost-source", "gone.md"), ("output/r.md", "uncited-paragraphs", "4")]


def test_enrichment(spark):
    d = docs(spark, e="---\na: b\n---\n[[k]] [[m n]] [[z]] [[k]] [[a b]]", n="x")
    f = files(spark, "wiki/concepts/m_n.md", "wiki/references/z.md")
    assert found(outputs.enrichment(d, f)) == [("output/e.md", "orphan-concepts", "a b, k, z"), ("output/n.md", "no-frontmatter", "")]


def brute(lines):
    """Line by line, as one reads a log."""
    out, error = [], None
    for i, x in enumerate(lines):
        if x.startswith("! "):
            error = (i + 1, x[2:].strip())
        elif x.startswith("l."):
            digits = x[2:].lstrip()[:0] + "".join(c for k, c in enumerate(x[2:]) if x[2 : 3 + k].isdigit())
            if error and digits:
                below = lines[i + 1] if i + 1 < len(lines) and not lines[i + 1].startswith(("!", "l.")) else None
                out.append((*error, int(digits), "\n".join(y for y in (x[2 + len(digits) :].lstrip(), below) if y is not None)))
            error = None
    return out


def test_log_records(spark, tmp_path):
    r = random.Random(9)
    kinds = ["! Missing $ inserted.", "! Undefined control sequence.", "l.12 \\foo", "l.7", "l.x", "text", "", "!", "l.", "!!", " ! x", "l.3   a  b"]
    texts = {f"{k}.log": [r.choice(kinds) for _ in range(n)] for k, n in enumerate((0, 1, 2, 60, 400))}
    for name, lines in texts.items():
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        lines = logs.numbered_lines(spark, str(tmp_path))
        got = {}
        for x in lines.collect():
            got.setdefault(x.path.rpartition("/")[2], {})[x.line] = x.text
        assert got == {k: dict(enumerate(v, 1)) for k, v in texts.items() if v}
        assert lines.rdd.getNumPartitions() >= 1
        for block in (1, 2, 7, 10_000):
            found = {}
            for x in logs.records(lines, block).collect():
                found.setdefault(x.path.rpartition("/")[2], []).append((x.ord, x.error, x.line, x.context))
            assert {k: sorted(v) for k, v in found.items()} == {k: w for k, v in texts.items() if (w := brute(v))}, block
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(brute(texts["4.log"])) > 20


def test_worklist(spark):
    errors = spark.createDataFrame([("raw/a.md", 7, "Undefined control sequence \\x", "c"), ("raw/a.md", 120, "Missing $", "d"), ("b.md", 5, "Missing $", "e"), ("b.md", 300, "Extra }", None)], "path string, line long, error string, context string")
    formulas = spark.createDataFrame([("raw/a.md", 5, 9, "block"), ("raw/a.md", 60, 180, "block"), ("b.md", 5, 5, "inline"), ("b.md", 299, 299, "inline")], "path string, line long, end_line long, kind string")
    got = {r.id: (r.end_line, r.kind, r.confidence, r.collection, r.context) for r in logs.worklist(errors, formulas).collect()}
    assert got == {"raw/a.md:5": (9, "block", "likely-macro", "raw", "c"), "raw/a.md:60": (180, "block", "certain", "raw", "d"), "b.md:5": (5, "inline", "certain", "", "e")}
