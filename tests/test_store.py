import os
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lexquarry.operators import concepts
from lexquarry.sources import store
from lexquarry.streaming import folds

SCHEMA = "k string, g long, name string, old string, top long, low long, tags array<string>, at long"
RULES = {"old": store.first, "top": store.largest, "low": store.smallest, "tags": store.united}


def row(r, at):
    return (r.choice("abcdefgh"), r.choice([1, None]), r.choice(["x", "y", None]), r.choice(["p", "q", None]), r.choice([1, 5, None]), r.choice([2, 7, None]), r.choice([["s"], ["t", "s"], [], None]), at)


def fold(rows):
    out = {}
    for x in rows:
        k = x[:2]
        o = out.get(k)
        if o is None:
            out[k] = [*x[2:4], x[4], x[5], list(dict.fromkeys(x[6] or [])), x[7]]
            continue
        if x[7] >= o[5]:
            o[0], o[5] = x[2], x[7]
        o[1] = x[3] if o[1] is None else o[1]
        o[2] = max((v for v in (o[2], x[4]) if v is not None), default=None)
        o[3] = min((v for v in (o[3], x[5]) if v is not None), default=None)
        o[4] = list(dict.fromkeys([*o[4], *(x[6] or [])]))
    return {k: tuple(tuple(v) if isinstance(v, list) else v for v in x) for k, x in out.items()}


def got(s, spark):
    return {tuple(x)[:2]: tuple(tuple(v or []) if i == 4 else v for i, v in enumerate(tuple(x)[2:])) for x in s.read(spark).collect()}


def test_merges_against_a_fold(spark, tmp_path):
    r = random.Random(3)
    s = store.Store(f"{tmp_path}/t", SCHEMA, ("k", "g"), "at", 5, RULES)
    assert s.read(spark).count() == 0
    rows, at = [], 0
    for size in (12, 0, 1, 20):
        batch = []
        for _ in range(size):
            at += 1
            batch.append(row(r, at))
        rows += batch
        r.shuffle(batch)
        s.merge(spark.createDataFrame(batch, SCHEMA))
        want = fold(rows)
        assert got(s, spark) == want
        # a batch that is merged again changes nothing
        s.merge(spark.createDataFrame(batch, SCHEMA))
        assert got(s, spark) == want


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    s = store.Store(f"{tmp_path}/t", "k long, v string, at long", ("k",), "at", 16)
    s.merge(spark.range(200).selectExpr("id AS k", "'a' AS v", "1L AS at"))
    before = files(s.folder)
    s.merge(spark.createDataFrame([(7, "late", 0), (8, "new", 2)], "k long, v string, at long"))
    after = files(s.folder)
    same = before.keys() & after.keys()
    assert len(before) == 16 and len(same) >= 14 and all(before[f] == after[f] for f in same) and len(after) == 16
    rows = {x.k: x.v for x in s.read(spark).collect()}
    assert len(rows) == 200 and rows[7] == "a" and rows[8] == "new"
    # clashes: of rows at one place the same one wins for all columns, in any order
    clash = [(9, "x", 5), (9, "y", 5), (9, "z", 4)]
    seen = set()
    for part in (clash, clash[::-1]):
        s.merge(spark.createDataFrame(part, "k long, v string, at long"))
        seen.add({x.k: x.v for x in s.read(spark).collect()}[9])
    assert len(seen) == 1 and seen <= {"x", "y"}


def test_stream_into_a_store(spark, tmp_path):
    schema = "report string, id string, decision string, offset long"
    s = store.Store(f"{tmp_path}/state", "report string, id string, offset long, decision string", ("report", "id"), "offset", 4)
    os.makedirs(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    r, want = random.Random(1), {}
    for i in range(6):
        part = [("r", r.choice("abc"), r.choice(["accept", "dismiss", "reset"]), 10 * i + k) for k in range(3)]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        for x in part:
            want[x[1]] = None if x[2] == "reset" else x[2]
        if i % 3 == 2:  # the query is stopped and started again
            q = folds.kept(folds.triage_updates(stream), s).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
            q.awaitTermination(120)
            assert {x.id: x.decision for x in s.read(spark).collect()} == want


def alike(a, b):
    short, long = sorted((a, b), key=len)
    return a == b or SequenceMatcher(None, a, b).ratio() >= 0.82 or ((long.startswith(short) or long.endswith(short)) and len(short) / len(long) >= 0.65)


def test_concepts(spark, tmp_path):
    s = concepts.concept_store(f"{tmp_path}/c", 4)
    files_ = spark.createDataFrame([("raw/papers/smith-2020-spin-liquids.md",), ("wiki/references/jones.md",), ("raw/papers/_index.md",)], "path string")
    batches = [
        [("Spin Liquid", "smith-2020", "one", 1), ("spin liquid", "jones", "two", 2), ("Topological Order", "unknown paper", "three", 3), ("!!", "x", "no name", 4), ("Evil", "../x", "left out", 5)],
        [("Spin Liquids", "jones", "four", 6), ("Topological Orders", "jones", "five", 7), ("Anyon", "jones", "six", 8)],
        [("Spin-Liquids", "jones", "seven", 9), ("Anyons", "jones", "eight", 10)],
    ]
    for k, b in enumerate(batches):
        for _ in range(2):  # a repeated batch adds nothing
            s.merge(concepts.changes(spark.createDataFrame(b, "name string, source string, content string, at long"), s.read(spark), files_, f"2024-01-0{k + 1}"))
    rows = {x.slug: x for x in s.read(spark).collect()}
    assert set(rows) == {"spin-liquid", "topological-order", "anyon"} and all(alike(a, b) for a, b in (("spin-liquids", "spin-liquid"), ("anyons", "anyon")))
    spin = rows["spin-liquid"]
    assert spin.title == "Spin Liquid" and spin.aliases == ["Spin Liquids", "Spin-Liquids"] and spin.sources == ["raw/papers/smith-2020-spin-liquids.md"]
    assert [p.content for p in spin.perspectives] == ["one", "two", "four", "seven"] and (spin.created, spin.updated) == ("2024-01-01", "2024-01-03")
    assert rows["topological-order"].sources == ["unknown paper"] and rows["anyon"].sources == ["wiki/references/jones.md"]
    text = s.read(spark).where("slug = 'anyon'").select(concepts.page().alias("p")).first().p
    assert "title: Anyon\n" in text and 'aliases:\n  - "Anyons"\n' in text and "### Perspective from jones\neight\n" in text and "\n## 1. Core Definition" in text


def test_cache(spark, tmp_path):
    items = spark.createDataFrame([("a", "t1"), ("b", "t2"), ("c", None)], "name string, text string")
    cache = store.Store(f"{tmp_path}/e", "name string, md5 string, embedding array<float>, at long", ("name",), "at", 4)
    for at, (texts, todo) in enumerate([((("a", "t1"), ("b", "t2")), {"a", "b"}), ((("a", "t1"), ("b", "new")), {"b"}), ((("a", "t1"), ("b", "new"), ("c", "x")), {"c"})]):
        d = concepts.to_embed(spark.createDataFrame(texts, "name string, text string"), cache.read(spark))
        assert {x.name for x in d.collect()} == todo
        cache.merge(d.select("name", "md5", F.array(F.lit(1.0).cast("float")).alias("embedding"), F.lit(at).cast("long").alias("at")))
    assert {x.name for x in concepts.to_embed(items, cache.read(spark)).collect()} == {"b", "c"}


@pytest.mark.parametrize("n", [1, 3])
def test_versions_of_small_states(spark, tmp_path, n):
    """The last two versions stay, and a batch finds the version before its own."""
    schema = "k string, v string, offset long"
    os.makedirs(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for i in range(n + 2):
        spark.createDataFrame([("a", f"v{i}", i), (f"k{i}", "x", i)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    folds.merged(stream, f"{tmp_path}/out", ["k"]).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    left = sorted(int(p) for p in os.listdir(f"{tmp_path}/out"))
    assert left == [n, n + 1]
    rows = {x.k: x.v for x in spark.read.parquet(f"{tmp_path}/out/{n + 1}").collect()}
    assert rows["a"] == f"v{n + 1}" and len(rows) == n + 3
