import random

import pytest

from lexquarry.functions import text as t
from lexquarry.operators import quality


@pytest.mark.parametrize(("text", "found"), [
    ("https://arxiv.org/abs/2401.00001v2", "2401.00001"), ("arXiv: 2401.00001", "2401.00001"), ("arXiv.2401.0001", "2401.0001"), ("1912.00002 but arxiv:2401.00001", "2401.00001"), ("see 2401.00001.", "2401.00001"), ("x2401.00001", None),
    ("12401.00001", None), ("2401.000012", None), ("2401.00001v3x", None), ("2401.00001v3", "2401.00001"), ("HEP-TH/9901001", "hep-th/9901001"), ("math.ag/0101001", "math.AG/0101001"), ("pdf/cond-mat/0001002", "cond-mat/0001002"),
    ("other/0001002", None), ("arxiv\n2401.00001", "2401.00001"), ("", None), (None, None), ("2401.0000", "2401.0000"), ("arXiv2401.00001", "2401.00001"), ("2401.000022401.00001", None),
])
def test_arxiv_id(spark, text, found):
    d = spark.createDataFrame([(text,)], "x string")
    assert d.select(t.arxiv_id("x").alias("i")).first().i == found


@pytest.mark.parametrize(("text", "found"), [
    ("doi:10.1000/Abc.1).", "10.1000/abc.1"), ("https://doi.org/10.1103/PhysRev/5/6, x", "10.1103/physrev/5/6"), ("<10.1234/x>", "10.1234/x"), ("10.123/x", None), ("110.1234/x", None), ("10.1234/", None), ("10.1234567890/x", None),
    ("(10.1000/a(b)c);", "10.1000/a(b)c"), ("no 10.5 and 10.1000/é漢", "10.1000/é漢"), ("10.1000 / x", None), ("a/10.1000/b/10.1001/c", "10.1000/b/10.1001/c"), (None, None), ("", None),
])
def test_doi(spark, text, found):
    d = spark.createDataFrame([(text,)], "x string")
    assert d.select(t.doi("x").alias("i")).first().i == found


def test_leftover_commands(spark):
    r = random.Random(2)
    parts = {"\\begin{x}": 1, "\\cite {a}": 1, "\\citep[x]{y}": 1, "\\textbf[": 1, "\\alpha{x}": 0, "\\begin": 0, "\\beginx{": 0, "begin{": 0, "\\Ref{": 0, "\\ref\n{": 1, "plain": 0, "\\footnote{\\label{z}}": 2, "\\cite*{a}": 0}
    texts = [[r.choice(list(parts)) for _ in range(r.randint(0, 9))] for _ in range(60)]
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "i int, x string")
    got = {row.i: row.n for row in d.select("i", quality.leftover_commands(d["x"]).alias("n")).collect()}
    assert got == {i: sum(parts[p] for p in x) for i, x in enumerate(texts)}
