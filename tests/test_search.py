import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexquarry.operators import retrieval, similarity


def corpus(spark, n=60):
    r = random.Random(11)
    words = ["spin", "liquid", "Topo-logical", "order", "自旋", "自旋液体", "液体", "a", "x9", "哈哈哈哈"]
    rows = [(r.choice(["k1", "k2"]), i, f"raw/{r.choice('ab')}/{i}.md", r.choice(["a", "b"]), "", " ".join(r.choice(words) for _ in range(r.randint(0, 25)))) for i in range(n)]
    return spark.createDataFrame([*rows, ("k3", 900, "p", "a", "", ""), ("k3", 901, "p", "a", "", None)], "kb string, chunk_id long, path string, collection string, heading string, content string")


def rounded(hits):
    return {(x.kb, x.chunk_id): round(x.score, 9) for x in hits.collect()}


def test_stored_postings_agree(spark, tmp_path):
    """The same scores from texts, from lists of terms and from postings, phrases of CJK and of two terms too."""
    c = corpus(spark).where("content IS NOT NULL")
    retrieval.write_postings(c, f"{tmp_path}/p", 5)
    found = 0
    for query, how in [("spin", {}), ("spin liquid", {}), ("自旋液体 order", {}), ("topo-logical", {}), ("哈哈哈", {}), ("旋液", {}), ("missing", {}), ("spin missing", {}), ("", {}), ("!! ", {}), ("order", {"collection": "a"}), ("自旋", {"glob": "raw/b/*"})]:
        a, b = rounded(retrieval.bm25(c, query, **how)), rounded(retrieval.bm25_stored(spark, f"{tmp_path}/p", query, **how))
        assert a == b, query
        found += len(a)
    assert found > 100
    scan = retrieval.bm25_stored(spark, f"{tmp_path}/p", "spin")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in scan or "PartitionFilters: [bucket" in scan
    assert "In(term" in scan or "EqualTo(term,spin)" in scan


def test_scores_by_hand(spark):
    c = spark.createDataFrame([("k", 1, "p", "c", "", "spin spin liquid"), ("k", 2, "p", "c", "", "order 自旋液"), ("k", 3, "p", "c", "", "liquid")], "kb string, chunk_id long, path string, collection string, heading string, content string")
    lengths, df, n = {1: 3, 2: 3, 3: 1}, 1, 3
    idf = math.log((n - df + 0.5) / (df + 0.5))
    want = -idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / (sum(lengths.values()) / n)))
    assert rounded(retrieval.bm25(c, "spin")) == {("k", 1): pytest.approx(want, abs=1e-8)}
    assert set(rounded(retrieval.bm25(c, "旋液"))) == {("k", 2)} and not rounded(retrieval.bm25(c, "液旋"))


@pytest.mark.parametrize("blocks", [1, 2, 5, None])
def test_cosine_pairs_against_all_pairs(spark, blocks):
    r = random.Random(4)
    rows = [(f"n{i:02}", [r.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(r.choice([3, 3, 4]))]) for i in range(40)]
    rows += [("dup", [1.0, 2.0, 3.0]), ("dup", [1.0, 2.0, 3.0]), ("zero", [0.0, 0.0, 0.0]), ("none", None), ("n00b", rows[0][1])]

    def cosine(u, v):
        return sum(a * b for a, b in zip(u, v, strict=True)) / math.sqrt(sum(a * a for a in u)) / math.sqrt(sum(b * b for b in v))

    ok = [(k, v) for k, v in rows if v and any(v)]
    want = sorted((a, b, round(c, 9)) for a, u in ok for b, v in ok if a < b and len(u) == len(v) and (c := cosine(u, v)) >= 0.8)
    got = similarity.cosine_pairs(spark.createDataFrame(rows, "key string, embedding array<float>"), 0.8, blocks)
    assert sorted((x.a, x.b, round(x.similarity, 9)) for x in got.collect()) == want and len(want) > 20
    empty = spark.createDataFrame(rows, "key string, embedding array<float>").where(F.lit(False))
    assert similarity.cosine_pairs(empty, 0.8, blocks).count() == 0


def test_places_listed_where_a_chunk_is_read(spark, tmp_path, monkeypatch):
    words = [["b", "a", "b"], [], ["a"], None, ["c", "c"], ["a", "b"]]
    batch = pa.RecordBatch.from_pydict({"kb": ["k"] * 6, "chunk_id": list(range(6)), "where": [0] * 6, "dl": [3, 0, 1, -1, 2, 2], "w": pa.array(words, pa.list_(pa.string()))})
    want = sorted((k, x, [i for i, y in enumerate(w) if y == x]) for k, w in enumerate(words) for x in set(w or []))
    for many in (1, 2, 3, 100):
        monkeypatch.setattr(retrieval, "WORDS", many)
        for part in (batch, batch.slice(0, 3), batch.slice(2)):
            ids = part["chunk_id"].to_pylist()
            got = [(r["chunk_id"], r["term"], r["places"]) for out in retrieval._listed(iter([part])) for r in out.to_pylist()]
            assert sorted(got) == [x for x in want if x[0] in ids]
    # paths aren't repeated for each term
    retrieval.write_postings(corpus(spark), f"{tmp_path}/p", 3)
    assert not {"path", "collection"} & set(spark.read.parquet(f"{tmp_path}/p/terms").columns)
