import random
import struct
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow.orc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexquarry.llm import tokenfiles
from brute_force import words

BYTE_BPE, WORD_BPE = (public_tokenizers.path(f"{x}.json") for x in ("byte_bpe_50k", "word_bpe_49k"))


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def table(spark, texts, parts=4):
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(parts)
    return d.withColumns({c: F.lit(1) for c in ("ids", "at", "part", "start", "tie", "n_tokens")})


HARD = ["", " ", "\n\n  x", "it's  We'LL don't", "a<|endoftext|>b", "<|endoftext|>", "é漢字🙂 é", "1234 5,6", "\0\x1c   y", "!'s \t\t\n tail ", "word" * 3000]


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_files_against_the_library(spark, path):
    r, encode = random.Random(3), library(path)
    texts = {5 * i: " ".join(r.choice(HARD) for _ in range(r.randint(0, 4))) for i in range(60)} | {1000 + i: t for i, t in enumerate(HARD)} | {-3: None, 7: words(3000, 1), 9: words(40, 2), 11: words(40, 2)}
    folder = tokenfiles.written(table(spark, texts), path=path)
    rows = tokenfiles.read(spark, folder)
    at, want = 0, {}
    for i in sorted(texts):
        ids = [*encode(texts[i]), 2]
        want[i] = (at, ids)
        at += len(ids)
    assert {x.doc_id: (x.start, list(x.ids)) for x in rows.collect()} == want
    assert {tuple(x) for x in tokenfiles.digests(rows).collect()} == {(i, s, len(ids), crc32(struct.pack(f"<{len(ids)}I", *ids))) for i, (s, ids) in want.items()}
    parts = spark.read.orc(f"{folder}/parts").orderBy("part").collect()
    assert sum(p.tokens for p in parts) == at and sum(p.documents for p in parts) == len(texts)
    assert all(a.last_id < b.first_id and a.start + a.tokens == b.start for a, b in zip(parts, parts[1:]))


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), "<i4").tolist()


def test_all_kinds_of_characters():
    """Every character up to U+3100 between letters, blanks and numbers."""
    encode, own = library(BYTE_BPE), tokenfiles.Encoder(BYTE_BPE)
    for a in range(0, 0x3100, 16):
        text = "".join(f"x{chr(c)} {chr(c)}1{chr(c)}{chr(c)} \n{chr(c)}'s" for c in range(a, a + 16))
        assert ids(own, text) == encode(text), a
        mixed = f"plain words here {text} and 12 more"
        assert ids(own, mixed) == encode(mixed), a


def test_long_texts_are_cut_between_words(monkeypatch):
    encode, text = library(BYTE_BPE), " ".join(words(600, 5).split()) + "  \n end. " + "q" * 3000 + " and more 12 of it"
    text += " " + text.replace("a", "漢")
    monkeypatch.setattr(tokenfiles, "PIECE", 50)
    own = tokenfiles.Encoder(BYTE_BPE)
    assert own.by_words and ids(own, text) == encode(text)
    monkeypatch.setattr(tokenfiles, "CACHED_CHARS", 100)
    small = tokenfiles.Encoder(BYTE_BPE)
    assert ids(small, text) == encode(text) and small.known.chars < 400


def test_stripes_and_pruning(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfiles, "STRIDE", 1000)
    monkeypatch.setattr(tokenfiles, "STRIPE_BYTES", 1 << 14)
    texts = {10 * i: words(12, i % 50) for i in range(6000)}
    folder = tokenfiles.written(table(spark, texts), folder=f"{tmp_path}/t")
    files = [pyarrow.orc.ORCFile(str(p)) for p in (tmp_path / "t/tokens").glob("*.orc")]
    assert sum(f.nrows for f in files) == 6000 and max(f.nstripes for f in files) > 1

    def read_rows(ids):
        """How many rows the scan hands on, and the rows found."""
        df = tokenfiles.lookup(spark, folder, ids)
        got = df.collect()
        plan, todo, n = None, [df._jdf.queryExecution().executedPlan()], 0
        while todo:
            plan = todo.pop()
            if "AdaptiveSparkPlan" in plan.nodeName():
                todo.append(plan.executedPlan())
                continue
            if plan.nodeName().startswith("QueryStage") or "QueryStage" in plan.getClass().getSimpleName():
                todo.append(plan.plan())
            if plan.nodeName().startswith("Scan orc") and "ids" in plan.simpleString(100):
                n += plan.metrics().apply("numOutputRows").value()
            todo += [plan.children().apply(k) for k in range(plan.children().length())]
        return n, got

    n, got = read_rows([20_000])
    assert [x.doc_id for x in got] == [20_000] and 0 < n <= 2000
    # 20,005 lies between the ids of a row group: only its Bloom filter tells that it isn't there
    n, got = read_rows([20_005])
    assert not got and n == 0


def test_repeated_and_null_ids_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (None, "b c"), (0, "z")], "doc_id long, text string")
    rows = tokenfiles.read(spark, tokenfiles.written(d)).orderBy("start").collect()
    assert [x.doc_id for x in rows] == [None, 0, 1, 1, 1] and [x.start for x in rows] == [0, 3, 5, *sorted(x.start for x in rows[3:])]
    assert sorted(len(x.ids) for x in rows[2:]) == [1, 2, 2]
    assert tokenfiles.digests(tokenfiles.read(spark, tokenfiles.written(d.where("false")))).count() == 0
    named = spark.createDataFrame([("b", "x"), ("a", "y")], "doc_id string, text string")
    assert [x.doc_id for x in tokenfiles.read(spark, tokenfiles.written(named)).orderBy("start").collect()] == ["a", "b"]
