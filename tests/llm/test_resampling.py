import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexquarry.llm import resampling
from brute_force import words


def found(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def runs(text, n):
    w = found(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, n=1, buckets=10_000, percent=10, least=20):
    bucket = lambda f: crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in runs(x, n)) for texts in (docs.values(), target))
    s_all, t_all, rows = sum(s.values()), sum(t.values()), {}
    for i, x in docs.items():
        f = runs(x, n)
        g = [math.floor(1000 * math.log((t[bucket(y)] + 1) * (s_all + buckets) / ((s[bucket(y)] + 1) * (t_all + buckets)))) for y in f]
        weight = sum(g) // len(g) if g else 0
        u = (int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        rows[i] = (len(f), weight, weight + math.floor(-1000 * math.log(-math.log(u))))
    order = sorted((i for i in docs if len(found(docs[i])) >= least), key=lambda i: (-rows[i][2], i))
    rank = {i: k + 1 for k, i in enumerate(order[: percent * len(order) // 100])}
    return {i: (*rows[i], rank.get(i)) for i in rows}


@pytest.mark.parametrize(("n", "buckets", "percent"), [(1, 10_000, 10), (2, 50, 33), (3, 10_000, 100)])
def test_against_brute_force(spark, n, buckets, percent):
    r = random.Random(n)
    docs = {i: " ".join(r.choice("alpha beta Gamma, delta é漢 x9_y").strip() + "abc"[r.randint(0, 2)] + words(1, r.randint(0, 40)) for _ in range(r.randint(0, 60))) for i in range(150)}
    docs |= {200: None, 201: "", 202: ".,;", 203: words(5000, 3), 204: "A" * 5000, 205: docs[3], 206: docs[3]}
    target = [words(30, k) for k in range(5)] + [None, ""]
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5).withColumns({c: F.lit(1) for c in ("score", "rank", "segment", "weight", "place", "n_words")})
    t = spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string")
    got = resampling.resampled(d, t, percent=percent, words=n, buckets=buckets, segment_rows=7).collect()
    assert {x.doc_id: (x.n_features, x.weight, x.score, x.rank) for x in got} == brute(docs, target, n, buckets, percent)
    assert len(got) == len(docs)


def test_runs_across_pieces(monkeypatch):
    text = " ".join(words(400, 2).split()) + " "
    whole = sorted(np.concatenate([x for _, x in resampling.features(text.encode(), 3, 1000)]).tolist())
    monkeypatch.setattr(resampling, "PIECE", 11)
    pieces = list(resampling.features(text.encode(), 3, 1000))
    assert len(pieces) > 50 and sum(n for n, _ in pieces) == 400
    assert sorted(np.concatenate([x for _, x in pieces]).tolist()) == whole == sorted(crc32(f.encode()) % 1000 for f in runs(text, 3))


@pytest.mark.parametrize("kind", ["spread", "one score", "sorted", "few"])
def test_ranks_of_regular_sampling(spark, kind):
    r = random.Random(4)
    n = 3 if kind == "few" else 2000
    rows = [(i, {"spread": r.randint(-9999, 9999), "one score": 7 if i % 3 else r.randint(0, 9), "sorted": i, "few": i}[kind]) for i in range(n)]
    r.shuffle(rows)
    got = resampling.ranked(spark.createDataFrame(rows, "doc_id long, score long").repartition(7), segment_rows=100)
    want = {i: k + 1 for k, (i, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])))}
    assert {x.doc_id: x["rank"] for x in got.collect()} == want
    # no segment holds more than about two even shares
    per = [c for (c,) in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(per) <= 2.2 * 100 + 20


def test_ties_nulls_and_empty_tables(spark):
    d = spark.createDataFrame([(None, words(30)), (7, words(30)), (7, words(30)), (8, None)], "doc_id long, text string")
    t = d.where("false").select(F.col("doc_id").alias("item_id"), "text")
    got = resampling.resampled(d, t, percent=100).collect()
    assert len(got) == 4 and sorted(x["rank"] for x in got if x["rank"]) == [1, 2, 3] and {x.doc_id for x in got if x["rank"] is None} == {8}
    assert resampling.resampled(d.where("false"), t).count() == 0
    ids = spark.createDataFrame([(f"k{i}", words(25, i)) for i in range(40)], "doc_id string, text string")
    assert resampling.drawn(ids.withColumn("lang", F.lit("en")), t, percent=25, segment_rows=5).count() == 10
