"""Radar, ledger, quality, claims, chunking, streaming on small literal tables."""

import random

import pytest
from pyspark.sql import functions as F

from lexquarry.operators import chunking, claims, ledger, quality, radar, retrieval, similarity, sqlviews, stats
from lexquarry.sources import records
from lexquarry.streaming import folds


def test_budget_halves(spark):
    rows = [(f"s{i}", "s2-recommendation", 0.9 - i / 1000, 0, i) for i in range(30)] + [(f"a{i}", "arxiv-new:cs", 0.1 - i / 1000, 1, i) for i in range(30)]
    c = spark.createDataFrame(rows, "id string, source string, score double, source_ord int, ord int")
    kept = [r.source for r in radar.budgeted(c, 20).collect()]
    assert len(kept) == 20 and kept.count("s2-recommendation") == 10
    assert radar.budgeted(c.limit(5), 20).count() == 5


def test_digest_round_trip(spark):
    rows = [("2401.1", "A `tick`\n### forged", 2024, ["X, Y"] * 8, "s2-recommendation", 0.5, "words " * 200, 1), ("2401.2", "B", None, [], "arxiv-new:cs", None, None, 2)]
    c = spark.createDataFrame(rows, "id string, title string, year int, authors array<string>, source string, score double, abstract string, ord int")
    text = radar.digest_lines(c).groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("text")).select(F.lit("r").alias("report"), "text")
    back = {r.id: (r.title, r.year, r.source, r.score) for r in radar.digest_entries(text).collect()}
    assert back == {"2401.1": ("A 'tick' ### forged", 2024, "s2-recommendation", 0.5), "2401.2": ("B", None, "arxiv-new:cs", None)}


TRIAGE = [("r", "a", "accept", 1), ("r", "a", "dismiss", 2), ("r", "b", "accept", 3), ("r", "b", "reset", 4), ("r", None, "accept", 5), ("q", "a", "task", 6), ("r", "c", None, 8), ("r", "c", "accept", 7)]


def test_triage(spark):
    log = spark.createDataFrame(TRIAGE, "report string, id string, decision string, offset long")
    assert {tuple(r) for r in radar.triage_state(log).collect()} == {("r", "a", "dismiss"), ("q", "a", "task")}


def test_triage_stream_equals_batch(spark, tmp_path):
    schema = "report string, id string, decision string, offset long"
    for i, part in enumerate((TRIAGE[:3], TRIAGE[3:6], TRIAGE[6:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/state"
    q = folds.merged(folds.triage_updates(stream), out, ["report", "id"]).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = max(int(p.name) for p in (tmp_path / "state").iterdir())
    got = {(r.report, r.id, r.decision) for r in spark.read.parquet(f"{out}/{last}").where("decision is not null").collect()}
    assert got == {("r", "a", "dismiss"), ("q", "a", "task")}


def test_seen_stream(spark, tmp_path):
    spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "id string").write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("id string").parquet(f"{tmp_path}/in")
    q = folds.first_seen(s).writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.id for r in spark.table("seen").collect()) == ["a", "b"]


LOG = "offset long, kind string, req_id string, batch_id string, item_id string, title string, status string, error string, route string, decision string, committed_path string, source_type string, source_value string, retry_of string"


def event(offset, kind, **x):
    names = [n.split()[0] for n in LOG.split(", ")]
    return tuple({"offset": offset, "kind": kind, **x}.get(n) for n in names)


def test_ledger(spark):
    log = spark.createDataFrame([
        event(1, "enqueue", req_id="1", route="arxiv-html"), event(2, "enqueue", req_id="2", route="tex"), event(3, "decision", batch_id="b", item_id="x", decision="approve"),
        event(4, "item", batch_id="b", item_id="x", req_id="1", route="arxiv-html"), event(5, "decision", batch_id="b", item_id="x", decision="approve"), event(6, "decision", batch_id="b", item_id="x", decision="reject"),
        event(7, "item", batch_id="b", item_id="y", route="ocr"), event(8, "decision", batch_id="b", item_id="y", decision="approve"), event(9, "decision", batch_id="b", item_id="y", decision="reset"), event(10, "commit", batch_id="b", item_id="ghost", committed_path="p"),
    ], LOG)
    assert [r.req_id for r in ledger.pending(log).collect()] == ["2"]
    items = ledger.batch_items(log)
    assert {r.item_id: r.decision for r in items.collect()} == {"x": "reject", "y": None}
    assert [(r.route, r.retry_of) for r in ledger.retries(items).collect()] == [("tex", "1")]
    assert [r.eligible for r in ledger.settled(items).collect()] == [False]
    assert ledger.batch_counts(items).first().undecided == 1


def test_json_lines_skip_broken(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id": "a"}\n\n{"id": "b", "x"\n{"id": "c"}\n')
    assert sorted(r.id for r in records.json_lines(spark, str(tmp_path / "l.jsonl"), "id string").collect()) == ["a", "c"]


def test_heading_chunks(spark):
    text = "intro\n## One\nbody\n```\n# in fence\n```\n" + "\n".join(f"l{i}" for i in range(251))
    d = spark.createDataFrame([("raw/a.md", text), ("raw/b.md", ""), ("wiki/c.md", "x\n## See Also:\nlinks")], "path string, text string")
    got = [(r.path, r.heading, r.start_line, r.end_line) for r in chunking.without_boilerplate(chunking.heading_chunks(d)).orderBy("path", "start_line").collect()]
    assert got == [("raw/a.md", "", 1, 1), ("raw/a.md", "One", 2, 4), ("raw/a.md", "in fence", 5, 254), ("raw/a.md", "", 255, 257), ("wiki/c.md", "", 1, 1)]


def test_window_chunks(spark):
    d = spark.createDataFrame([("a", "\n".join(["x", "", "```", "", "```", "y", "", "z"]))], "path string, text string")
    assert [(r.start_line, r.end_line) for r in chunking.window_chunks(d, 3).orderBy("chunk").collect()] == [(1, 7), (8, 8)]


def test_sections(spark):
    d = spark.createDataFrame([("m", "# T\n## A\na\n```\n## no\n```\n### B\nfind me\n## C\n")], "path string, text string")
    s = chunking.sections(d)
    assert [(r.h2, r.h3, r.start_line) for r in s.orderBy("start_line").collect()] == [("A", None, 2), ("A", "B", 7), ("C", None, 9)]
    assert [(r.h3, r.matches) for r in chunking.search_sections(s, "FIND").collect()] == [("B", 1)]


def test_context(spark):
    d = spark.createDataFrame([("p", "one\n\ntwo X\n\nthree\n\nfour\n\nfive X")], "path string, text string")
    assert [r.block for r in chunking.paragraph_context(d, r"\bX\b").collect()] == ["one\n\ntwo X\n\nthree", "four\n\nfive X"]


def chunk_rows(spark, rows):
    return spark.createDataFrame([("k", i, f"raw/{i}.md", "c", "", t) for i, t in enumerate(rows)], "kb string, chunk_id long, path string, collection string, heading string, content string")


def test_bm25(spark):
    c = chunk_rows(spark, ["量子自旋 liquid", "spin cond-mat ice", "cond of mat", "nothing", "else", "more", "text"])
    assert [r.chunk_id for r in retrieval.bm25(c, "自旋").collect()] == [0]
    assert [r.chunk_id for r in retrieval.bm25(c, "cond-mat").collect()] == [1]
    assert retrieval.bm25(c, '""').count() == 0
    assert [r.chunk_id for r in retrieval.search(c, "ice", k=3, glob="raw/1*").collect()] == [1]


def test_similarity(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0])], "key string, embedding array<float>")
    assert [(r.a, r.b) for r in similarity.cosine_pairs(v, 0.9, 3).collect()] == [("a", "b")]
    p = spark.createDataFrame([("long", "ab", 0.99), ("ab", "xy", 0.98), ("xy", "qq", 0.97), ("long", "qq", 0.96)], "a string, b string, score double")
    assert {(r.kept, r.merged) for r in similarity.greedy_merges(p).collect()} == {("ab", "long"), ("ab", "xy")}


def greedy(pairs):
    out, gone = set(), set()
    for a, b, score in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in gone and b not in gone:
            kept, merged = (a, b) if len(a) <= len(b) else (b, a)
            gone.add(merged)
            out.add((kept, merged, score))
    return out


def test_greedy_merges_decide_every_pair(spark):
    r = random.Random(6)
    schema = "a string, b string, score double"
    equal = spark.createDataFrame([(f"n{i:03}", [1.0, 2.0]) for i in range(100)], "key string, embedding array<float>")
    p = similarity.cosine_pairs(equal, 0.9, 3).select("a", "b", F.round("similarity", 6).alias("score"))
    assert {tuple(x) for x in similarity.greedy_merges(p).collect()} == {("n000", f"n{i:03}", 1.0) for i in range(1, 100)}
    names = [f"{i}" * r.randint(1, 3) for i in range(40)]
    some = {tuple(r.sample(names, 2)): r.choice([0.5, 0.6, 0.7, 0.8]) for _ in range(300)}
    some = [(a, b, s) for (a, b), s in some.items()] + [(f"c{i:02}", f"c{i + 1:02}", 1 - i / 100) for i in range(12)]
    assert {tuple(x) for x in similarity.greedy_merges(spark.createDataFrame(some, schema)).collect()} == greedy(some)


@pytest.mark.parametrize(("quote", "result"), [("plain words", "exact"), ("plain  words", "whitespace"), ("ﬁne hyphen-\nation “q”", "loose"), ("made up", "not-found"), ("", "malformed")])
def test_claims(spark, quote, result):
    c = spark.createDataFrame([("c", quote, "local_wiki", "raw/s.md")], "claim string, evidence string, source_type string, source string")
    s = spark.createDataFrame([("raw/s.md", 'plain words, fine hyphenation "q"')], "path string, text string")
    assert claims.verified(c, s).first().result == result


def test_claim_paths(spark):
    c = spark.createDataFrame([("c", "x", "local_wiki", "../s.md"), ("c", "x", "web", "https://x"), ("c", "x", "web", "x")], "claim string, evidence string, source_type string, source string")
    assert [r.result for r in claims.verified(c, spark.createDataFrame([("../s.md", "x")], "path string, text string")).collect()] == ["no-source", "format-ok", "malformed"]


def test_gates(spark):
    row = ("p", "---\ntitle: x\n---\nshort \\cite{a} $\\ref{b}$ ![f](x.png)", b"%PDF-1", None, 3, 1, "2401.00001")
    c = spark.createDataFrame([row], "path string, md string, payload binary, tex_source string, figures_referenced int, figures_resolved int, expected_arxiv_id string")
    assert [r.code for r in quality.conversion_gates(c).collect()] == ["payload-is-pdf", "suspiciously-short", "leftover-tex", "figure-count-mismatch", "image-references"]


def test_document_rules(spark):
    d = spark.createDataFrame([("wiki/a.md", "---\ntitle: A\ncategory: c\ncreated: 2024-01-01\nupdated: 2024-01-01\ntags: [x]\nsummary: s\n---\n[[b]] [[zz]] [l](no.md) $$\n"), ("wiki/x/b.md", "no frontmatter [up](../a.md)")], "path string, raw_text string")
    assert {r.detail for r in quality.missing_fields(d).collect()} == {"title", "category", "created", "updated", "tags", "summary"}
    assert [r.detail for r in quality.broken_wikilinks(d).collect()] == ["zz"]
    assert [r.detail for r in quality.dead_markdown_links(d).collect()] == ["no.md"]
    deep = "/".join("abcdefghijkl") + "/x.md"
    far = spark.createDataFrame([(deep, "[up](" + "../" * 12 + "top.md) [no](" + "../" * 13 + "top.md) [here](./y/../x.md) [dead](./../x.md)"), ("top.md", "")], "path string, raw_text string")
    assert {r.detail for r in quality.dead_markdown_links(far).collect()} == {"../" * 13 + "top.md", "./../x.md"}
    assert {(r.path, r.code) for r in quality.stale(d, "2024-12-31").collect()} == {("wiki/a.md", "missing-volatility"), ("wiki/x/b.md", "missing-volatility")}
    old = spark.createDataFrame([("wiki/o.md", "---\nvolatility: hot\nupdated: 2024-01-01\ncategory: idea\n---\n[[a/b]] [[$x$]] [[fine]]")], "path string, raw_text string")
    assert [(r.code, r.detail) for r in quality.stale(old, "2024-12-31").collect()] == [("stale-article", "365")]
    assert [r.detail for r in quality.bad_enums(old).collect()] == ["category=idea"]
    assert {r.detail for r in quality.bad_wikilinks(old).collect()} == {"illegal character: a/b", "TeX: $x$"}
    assert [(r.line, r.kind) for r in quality.placeholders(spark.createDataFrame([("a", "x\n* **Name**:\n[STUB: Awaiting synthesis]")], "path string, raw_text string")).collect()] == [(2, "empty_bullet"), (3, "stub_tag")]


def test_formulas(spark):
    d = spark.createDataFrame([("a", "x $a$\n$$\nb\n$$\n```\n$no$\n```\n$c$ $d$")], "path string, raw_text string")
    got = {(r.kind, r.formula) for r in quality.formulas(d).collect()}
    assert got == {("inline", "a"), ("display", "b"), ("inline", "c"), ("inline", "d")}
    assert [r.detail for r in quality.prose_in_math(spark.createDataFrame([("a", "$$ we see that this is not math $$")], "path string, raw_text string")).collect()] == ["0:7"]


def test_as_of(spark):
    e = spark.createDataFrame([("p", 12, "e"), ("p", 40, "f")], "path string, line int, error string")
    f = spark.createDataFrame([("p", 3, 30), ("p", 9, 90), ("p", 25, 250)], "path string, line int, source_line int")
    assert {(r.line, r.source_line) for r in quality.compile_errors(e, f).collect()} == {(12, 90), (40, None)}


def test_sql_guard(spark):
    t = spark.range(3)
    assert sqlviews.read_only(spark, "select count(*) as n from t -- drop", {"t": t}).first().n == 3
    for bad in ("drop table t", "select 1; select 2", "with x as (select 1) insert into t select * from x", "set a=b"):
        with pytest.raises(sqlviews.Refused):
            sqlviews.read_only(spark, bad, {"t": t})


def test_health(one):
    assert one(stats.core_health(F.lit(1.0), F.lit(0.5), F.lit(0.25))) == 0.725
    assert one(stats.freshness(F.lit(1), F.lit(2))) == 0.3
    assert one(ledger.next_rung(F.lit("ocr"))) is None


def test_feeds(spark):
    xml = "<feed><entry><id>http://arxiv.org/abs/2401.00001v2</id><title>A\n B</title><published>2024-01-02T00:00:00Z</published><summary>s</summary><author><name>X Y</name></author></entry><entry><id>http://arxiv.org/abs/2301.00001v1</id><title>old</title><published>2023-01-02T00:00:00Z</published></entry><entry><title>no id</title></entry></feed>"
    r = records.feed_entries(spark.createDataFrame([(0, xml)], "ord int, xml string"), "2024-01-01", "cs.LG").collect()
    assert [(x.id, x.title, x.authors, x.source) for x in r] == [("2401.00001", "A B", ["X Y"], "arxiv-new:cs.LG")]


def test_main_tex(spark):
    f = spark.createDataFrame([("b", "s", "main.tex", r"\begin{document}\input{intro}"), ("b", "s", "intro.tex", "x"), ("b", "s", "supp/supplement.tex", r"\begin{document}")], "bundle string, slug string, path string, text string")
    assert records.main_tex(f).first().path == "main.tex"
