import random

from pyspark.sql import functions as F

import corpus_pipeline
from lexquarry.llm import bpe
from brute_force import brute_stages, words


def test_stages_against_brute_force(spark, tmp_path):
    r = random.Random(8)
    benchmark = [(i, words(20, 900 + i)) for i in range(3)]
    texts = {i: "\n".join(words(12, 100 * i + k) for k in range(r.randint(3, 9))) for i in range(40)}
    texts |= {50: texts[3], 51: texts[4] + " tail", 52: texts[5] + "\n" + benchmark[1][1], 53: "too short", 54: None, 55: "same words again and again " * 20, 56: words(60, 7) + "\n" + "\n".join(texts[6].split("\n"))}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    docs, want = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(texts)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        want = brute_stages[k](want, benchmark)
        assert {x.doc_id: x.text for x in docs.collect()} == want, name
        assert docs.where("n_chars <> char_length(text)").count() == 0
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    v = bpe.load(bpe.default_path())
    assert {x.doc_id: list(x.ids) for x in last} == {i: v.encode([t])[0].tolist() for i, t in want.items()}
    assert all(x.round_trip for x in last) and corpus_pipeline.ORACLE_SQL is None
    assert 50 not in want and 52 not in want and 53 not in want and 54 not in want and 55 not in want and len(want) > 35


def test_near_copies_by_five_words(spark):
    r = random.Random(5)
    texts = {}
    for i, n in enumerate((50, 40)):  # one word in the middle changed: 41 of 51 shingles of five words are shared, then 31 of 41
        w = ["".join(r.choice("abcdefghik") for _ in range(8)) for _ in range(n)]
        texts |= {2 * i: " ".join(w), 2 * i + 1: " ".join([*w[: n // 2], "other", *w[n // 2 + 1 :]])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(x.doc_id for x in corpus_pipeline.ngram_jaccard(spark, docs, "").collect()) == [0, 2, 3]
