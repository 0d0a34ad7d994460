import random

import pytest

from lexquarry.operators import claims, quality


def squeezed(x):
    return " ".join(x.split())


def test_quotations_against_brute_force(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 6)))
    texts = {i: r.choice(["", " "]).join([word() + r.choice([" ", "  ", "\n", " "]) for _ in range(r.randint(0, 12))]) for i in range(40)} | {100: None, 101: "", 102: "alpha beta gamma delta foobarbaz"}
    quotes = ["gamma", "delta foo", "ta gamma de", "lpha", "a", "foobarbaz ", " alpha", "zz", "alpha  beta", "beta gamma", "", "  ", None, "z", "alpha beta gamma delta foobarbaz"]
    for _ in range(120):
        t = r.choice([x for x in texts.values() if x])
        a = r.randrange(len(t))
        quotes.append(t[a : a + r.randint(1, 14)].replace(" ", r.choice([" ", " ", "  ", "\n"])))
    want = {}
    for k, x in enumerate(quotes):
        found = [t for t in texts.values() if t]
        want[k] = "malformed" if not (x or "").strip() else "exact" if any(x in t for t in found) else "whitespace" if any(squeezed(x) in squeezed(t) for t in found) else "not-found"
    q = spark.createDataFrame(list(enumerate(quotes)), "id int, quote string")
    s = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    assert dict(claims.found_anywhere(q, s).collect()) == want
    assert set(want.values()) == {"malformed", "exact", "whitespace", "not-found"}
    assert {x.result for x in claims.found_anywhere(q.where("quote = 'gamma'"), s.where("false")).collect()} == {"not-found"}


def test_short_quotations_meet_no_texts(spark):
    s = spark.createDataFrame([(k, "\t ab  cd\nef gh ") for k in range(20)] + [(100, "\u00a0xab cd"), (101, None), (102, " ")], "doc_id int, text string")
    quotes = ["b  c", "b c", "b   cd\n", "h ", "h\t", "\t ab", "\tab", " ab  cd\n", "f\ng", "cd", "d ef g", "\u00a0x", "x ab", "a b"]
    want = ["exact", "exact", "whitespace", "exact", "whitespace", "exact", "whitespace", "exact", "whitespace", "exact", "whitespace", "exact", "not-found", "not-found"]
    q = spark.createDataFrame(list(enumerate(quotes)), "id int, quote string")
    assert [r.result for r in claims.found_anywhere(q, s).orderBy("id").collect()] == want
    short = claims.found_anywhere(q.where("quote <> 'd ef g'"), s)
    # pairs of a quotation and a text would meet the texts by number
    assert not [x for x in short._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x and "doc_id" in x]


@pytest.mark.parametrize(("a", "b", "same"), [
    ("文本、内容。", "文本,内容.", True), ("文本，内容", "文本,内容", True), ("“q” ‘r’", "\"q\" 'r'", True), ("a–b — c−d", "abcd", True), ("ﬁne­ly", "FINELY", True), ("q", '"q"', False), ("a.b", "ab", False), ("Straße", "strasse", True), ("«q»", "q", False),
])
def test_folded(a, b, same):
    assert (claims.folded(a) == claims.folded(b)) is same


def test_paper_gate(spark):
    own = "---\ntitle: t\narxiv_id: 'arXiv:2401.00001v3'\n---\n"
    rows = [("agrees", own, "2401.00001"), ("version", own, "arXiv:2401.00001v1"), ("differs", own, "2401.00002"), ("cites", "---\ntitle: arXiv:1912.1\n---\nsee arXiv:1912.00001", "2401.00001"), ("none", "text 1912.00001", "2401.00001"), ("unasked", own, None), ("old", "---\narxiv_id: hep-th/9901001\n---\n", "HEP-TH/9901001v2")]
    c = spark.createDataFrame([(p, m, b"", None, 0, 0, e) for p, m, e in rows], "path string, md string, payload binary, tex_source string, figures_referenced int, figures_resolved int, expected_arxiv_id string")
    assert [(r.path, r.detail) for r in quality.conversion_gates(c).where("code = 'wrong-paper'").collect()] == [("differs", "2401.00001")]
