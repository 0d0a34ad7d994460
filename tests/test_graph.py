import pytest

from lexquarry.operators import graph as g
from lexquarry.sources import corpus

SCHEMA = "path string, title string, type string, category string, summary string, created string, updated string, tags array<string>, aliases array<string>, links array<string>"


def card(path, title, kind="concept", tags=(), aliases=(), links=()):
    return (path, title, kind, "", "", "", "", list(tags), list(aliases), list(links))


@pytest.fixture(scope="module")
def graph(spark):
    rows = [
        card("wiki/concepts/a.md", "Alpha", tags=["t", "t"], aliases=["First"], links=["Beta", "beta", "Ghost", "Alpha"]),
        card("wiki/concepts/b.md", "Beta", tags=["t", "u"], links=["first", "Page#Section"]),
        card("wiki/references/c.md", "Beta", "reference", aliases=["Alpha"], links=["a"]),
        card("wiki/references/d.md", "", "reference", links=["C"]),
    ]
    claims = spark.createDataFrame([("claim:1", "wiki/concepts/a", "x", "verified", "local_wiki", "wiki/references/c.md"), ("claim:2", "wiki/concepts/a", "y", "unverified", "local_wiki", "nowhere.md")], "id string, doc_id string, text string, status string, source_type string, source string")
    return g.with_claims(g.build(spark.createDataFrame(rows, SCHEMA)), claims), claims


def test_links_resolve_to_the_first(graph):
    e = {(r.source_id, r.target_id, r.type) for r in graph[0].edges.collect()}
    a, b, c, d = "wiki/concepts/a", "wiki/concepts/b", "wiki/references/c", "wiki/references/d"
    assert {x for x in e if x[2] == "wikilink"} == {(a, b, "wikilink"), (a, "Ghost", "wikilink"), (a, a, "wikilink"), (b, a, "wikilink"), (b, "Page#Section", "wikilink"), (c, a, "wikilink"), (d, c, "wikilink")}
    assert ("claim:1", c, "supported_by") in e and ("claim:2", "nowhere", "supported_by") in e
    assert {x for x in e if x[2] == "has_tag"} == {(a, "tag:t", "has_tag"), (b, "tag:t", "has_tag"), (b, "tag:u", "has_tag")}


def test_views(graph):
    gr, claims = graph
    o = {(r.section, r.key): r.n for r in g.overview(gr, claims).collect()}
    assert o["nodes", "concept"] == 2 and o["nodes", "tag"] == 2 and o["nodes", "claim"] == 2
    assert o["broken_links", "all"] == 3 and o["tags", "distinct"] == 2 and o["claims", "verified"] == 1
    deg = {r.id: r.degree for r in g.degrees(gr).collect()}
    assert deg["wiki/concepts/a"] == 5  # its loop counts once here: a-b, b-a, a-Ghost, a-a, c-a
    assert deg["claim:1"] == 0
    assert [r.id for r in g.hubs(gr, 1).collect()] == ["wiki/concepts/a"]
    assert {(r.text, r.node_id) for r in g.resolved(gr, gr.nodes.sparkSession.createDataFrame([("FIRST",), ("d",), ("zzz",)], "text string")).collect()} == {("FIRST", "wiki/concepts/a"), ("d", "wiki/references/d"), ("zzz", None)}


def test_map(graph):
    nodes, edges = g.graph_map(graph[0])
    n = {r.id: (r.type, r.degree) for r in nodes.collect()}
    assert n["Ghost"] == ("ghost", 1) and n["nowhere"] == ("ghost", 1) and "tag:t" not in n
    assert n["wiki/concepts/a"][1] == 8  # the loop twice, two claims
    assert edges.count() == 11
    nodes, edges = g.graph_map(graph[0], include_tags=True)
    assert {r.id: r.degree for r in nodes.collect()}["tag:t"] == 2
    nodes, edges = g.graph_map(graph[0], limit=2)
    kept = {r.id for r in nodes.collect()}
    assert len(kept) == 2 and all(r.source in kept and r.target in kept for r in edges.collect())


def test_paths(graph):
    assert [tuple(r) for r in g.paths(graph[0], "wiki/references/d", "wiki/concepts/b").collect()] == [("wiki/references/d > wiki/references/c > wiki/concepts/a > wiki/concepts/b", 3)]


def test_cards_from_files(spark, tmp_path):
    for name, text in {"wiki/concepts/a.md": "---\ntitle: A\ntags: [x]\naliases:\n  - AA\n---\n[[B]]\n<!-- x:claims\nCLAIM: c1\nEVIDENCE: \"e\nf\"\nSOURCE_TYPE: local_wiki\nSOURCE: raw/s.md\nSTATUS: Verified\n-->\n", "wiki/_index.md": "no", "raw/.hidden/x.md": "no", "raw/s.md": "e f"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    docs = corpus.markdown(spark, str(tmp_path))
    assert sorted(r.path for r in docs.collect()) == ["raw/s.md", "wiki/concepts/a.md"]
    c = corpus.cards(docs.where("path like 'wiki%'")).first()
    assert (c.title, c.type, c.category, c.tags, c.aliases, c.links) == ("A", "concept", "concept", ["x"], ["AA"], ["B"])
    x = corpus.claims(docs).first()
    assert (x.text, x.status, x.source, x.quote) == ("c1", "verified", "raw/s.md", "e\nf") and x.id.startswith("claim:") and len(x.id) == 18
