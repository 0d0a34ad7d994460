import math
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lexquarry.functions import text as t
from lexquarry.operators import claims, library, quality, radar


def test_report_order(spark):
    rows = [("b", "x", "info", "1"), ("b", "a", "critical", "2"), ("a", "z", "flag", "3"), ("a", "z", "block", "4"), ("a", "b", "warning", "6"), ("a", "b", "warning", "5")]
    f = spark.createDataFrame(rows, "path string, code string, severity string, detail string").repartition(3)
    assert [r.detail for r in quality.in_report_order(f).collect()] == ["4", "2", "5", "6", "3", "1"]


def test_candidates_by_score(spark):
    c = spark.createDataFrame([("a", None, 0, 1), ("b", 0.5, 1, 2), ("c", -2.0, 0, 3), ("d", 0.5, 0, 9), ("e", None, 0, 0)], "id string, score double, source_ord int, ord int")
    assert [r.id for r in radar.by_score(c).collect()] == ["d", "b", "e", "a", "c"]


def test_sequence_ratio(spark):
    names = ["spin-liquid", "spin-liquids", "liquid-spin", "", "a", "topological-order", "topological-orders-x", None]
    d = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    for r in d.select("a", "b", library.sequence_ratio("a", "b").alias("x")).collect():
        assert r.x == SequenceMatcher(None, r.a or "", r.b or "").ratio()


def test_library_ids(one):
    assert one(t.arxiv_ids("x"), x="see 2401.00001v2, cond-mat/9901001 and 2401.00001; not 12401.00001 or 2401.000") == ["2401.00001", "cond-mat/9901001"]
    assert one(t.arxiv_ids("x"), x="") == []


def test_claim_blocks_with_quotations(spark):
    text = "prose\nCLAIM: one\nEVIDENCE: \"first line\nCLAIM: inside the quotation\nlast\"\nSOURCE: a.md\nFINDING: two\nEVIDENCE: plain\nSTATUS: Verified\n  CLAIM: three"
    got = claims.parsed(spark.createDataFrame([("p", text), ("q", None), ("r", "")], "path string, text string")).where("claim is not null").collect()
    assert [(r.claim, r.evidence, r.source, r.status) for r in got] == [("one", "first line\nCLAIM: inside the quotation\nlast", "a.md", "unverified"), ("two", "plain", None, "verified"), ("three", None, None, "unverified")]


def test_harvest_is_the_composition(spark):
    """Fresh ones, scored by the centroid, over the bound, half the places for new listings."""
    rows = [(f"c{i}", f"x{i}", "arxiv-new:cs" if i % 3 == 0 else "s2", 0, i) for i in range(12)] + [("c1", "x1", "s2", 1, 99), (None, "x", "s2", 0, 100)]
    c = spark.createDataFrame(rows, "id string, arxiv_id string, source string, source_ord int, ord int").withColumn("score", F.lit(None).cast("double"))
    vectors = {f"c{i}": [math.cos(i / 8), math.sin(i / 8)] for i in range(11)}
    e = spark.createDataFrame(list(vectors.items()), "id string, embedding array<float>")
    center = spark.createDataFrame([([1.0, 0.0],)], "centroid array<double>")
    out = library.harvested(c, spark.createDataFrame([("c2",)], "id string"), spark.createDataFrame([("x4",), (None,)], "arxiv_id string"), e, center, 0.6, 4).collect()
    score = {k: round(v[0] / math.hypot(*v), 3) for k, v in vectors.items()}
    left = [x for x in rows[:12] if x[0] not in ("c2", "c4") and score.get(x[0], 1) >= 0.6]
    rank = lambda x: (-score.get(x[0], -1), x[3], x[4])
    new = sorted((x for x in left if x[2].startswith("arxiv-new")), key=rank)[:2]
    rest = sorted((x for x in left if x not in new), key=rank)[: 4 - len(new)]
    assert [r.id for r in out] == [x[0] for x in sorted(new + rest, key=rank)]
