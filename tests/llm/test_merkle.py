import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lexquarry.llm import merkle, queries

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves, arity):
    """The root, and for each leaf its siblings level by level with its slot."""
    proofs, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(proofs):
            run = at[i] // arity * arity
            p.append((at[i] - run, [x for j, x in enumerate(level[run : run + arity], run) if j != at[i]]))
        level, at = [h(*level[k : k + arity]) for k in range(0, len(level), arity)], [x // arity for x in at]
    return level[0], proofs


def fold(own, proof):
    for slot, others in proof:
        own = h(*others[:slot], own, *others[slot:])
    return own


def brute(rows, arity=2):
    """{doc_id: (leaf, subroot, root, proof)}"""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], h(*map(field, r))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: tree([x[1] for x in sorted(groups[g])], arity) for g in order}
    root, above = tree([built[g][0] for g in order], arity)
    out = {}
    for g, up in zip(order, above, strict=True):
        for (i, leaf), proof in zip(sorted(groups[g]), built[g][1], strict=True):
            out[i] = (leaf, built[g][0], root, proof + up)
    return out


def table(sizes, seed=1):
    r, rows, i = random.Random(seed), [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            i += r.randint(1, 5)
            rows.append((i, r.choice(["a", None, "é:1"]), lang, r.choice([None, 0, 7]), r.choice([None, "", "x", "漢\0字" * 3, "long " * 2000])))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("sizes", "arity"), [({"en": 13, None: 2, "": 1, "é": 8}, 2), ({"a": 1}, 2), ({"a": 2}, 2), ({"a": 1, "b": 1, "c": 1}, 2), ({None: 9, "b": 10, "c": 1, "d": 27}, 3), ({"a": 70, "b": 5}, 4)])
def test_proofs_against_brute_force(spark, sizes, arity):
    rows = table(sizes)
    docs = spark.createDataFrame(rows, DOCS).repartition(3).withColumns({c: F.lit(1) for c in ("tree", "at", "hash", "size", "leaf", "proof")})
    got = merkle.manifest(docs, arity=arity).collect()
    want = brute(rows, arity)
    assert {r.doc_id: (r.leaf, r.subroot, r.root, [(x.slot, list(x.siblings)) for x in r.proof]) for r in got} == want and len(got) == len(rows)
    assert all(fold(leaf, proof) == root for leaf, _, root, proof in want.values())


def test_repeated_rows_and_null_ids(spark):
    rows = [(5, "s", "en", 1, "same")] * 3 + [(5, "s", "en", 1, "other"), (None, "s", "en", 1, "x"), (None, None, None, None, None)]
    got = merkle.manifest(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 6 and len({r.root for r in got}) == 1
    assert all(fold(r.leaf, [(x.slot, x.siblings) for x in r.proof]) == r.root for r in got)
    leaves = [h(*map(field, rows[4])), *sorted(h(*map(field, r)) for r in rows[:4])]
    assert {r.subroot for r in got} == {tree(leaves, 2)[0], h(*map(field, rows[5]))}
    assert merkle.manifest(spark.createDataFrame(rows, DOCS).where("false")).count() == 0


def test_query_finds_what_was_tampered_with(spark, tmp_path):
    rows = table({"en": 60, "de": 21, None: 3})
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_merkle(spark, str(tmp_path)).collect()}
    want, by = brute(rows), {r[0]: r for r in rows}
    assert got.keys() == want.keys()
    for i, (leaf, subroot, root, proof) in want.items():
        hit = zlib.crc32(str(i).encode()) % 7 == 0 and by[i][3] is not None
        changed = h(*map(field, (*by[i][:3], by[i][3] + 1, by[i][4]))) if hit else leaf
        r = got[i]
        assert (r.leaf, r.subroot, r.root, r.verified) == (leaf, subroot, root, not hit)
        assert r.proof_sha256 == h(*(x for _, level in proof for x in level)) and r.folded_root == fold(changed, proof)
    assert 0 < sum(not r.verified for r in got.values()) < 30
