from lexquarry.operators import radar


def test_group_neighbours_against_all_pairs(spark):
    papers = [(k, k % 3, 2024, [5, None, k % 4][k % 3]) for k in range(30)]
    anchors = [(k, k % 3) for k in range(0, 40, 2)]
    rank = lambda p: (p[3] is None, -(p[3] or 0), p[0])
    want = {(a, p[0]) for a, g in anchors for p in sorted((p for p in papers if p[1] == g and p[0] != a), key=rank)[:4]}
    p = spark.createDataFrame(papers, "paper_id long, group long, year int, score long")
    got = radar.group_neighbours(spark.createDataFrame(anchors, "anchor long, group long"), p, 4)
    assert {(r.anchor, r.paper_id) for r in got.collect()} == want and got.count() == len(want)
