"""Queries on small tables of rows that the test tables lack."""

import datetime
import math

import pyarrow as pa
import pyarrow.parquet as pq

from lexquarry import plans


def rows(spark, tmp_path, query, **tables):
    """The rows of a query over tables(rows, schema)."""
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return [tuple(r) for r in plans.queries()[query](spark, str(tmp_path)).collect()]


def test_boosted_pairs_of_equal_vectors(spark, tmp_path):
    vectors = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 2), (3, [0.36, math.sqrt(1 - 0.36**2)], 3)]
    got = rows(spark, tmp_path, "c3_boosted_pairs", embeddings=(vectors, "vec_id long, embedding array<float>, label int"))
    assert sorted(got) == [(1, 2, 1.0, "suggest"), (1, 3, 0.36, "link"), (2, 3, 0.36, "link")]


def test_html_titles_as_they_stand(spark, tmp_path):
    titles = {1: "<title>a &quot;b&quot;  &amp; c</title>", 2: "<title>[x] y</title>", 3: "<p>", 4: None}
    got = rows(spark, tmp_path, "f_html", pages=(list(titles.items()), "page_id long, html string"))
    assert {r[0]: r[2] for r in got} == {1: "a &quot;b&quot; & c", 2: "[x] y", 3: "", 4: None}


def test_hub_page_of_small_debts(spark, tmp_path):
    customers = [(k, f"Customer#{k}", 1, x, "BUILDING") for k, x in enumerate((-0.04, 0.04, -0.05, 0.25, -1234.35, 0.0))]
    got = rows(spark, tmp_path, "k_hub_page", customer=(customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"))
    assert [r[2].split(" owes ")[1] for r in sorted(got) if " owes " in r[2]] == ["-0.0 |", "0.0 |", "-0.1 |", "0.3 |", "-1234.4 |", "0.0 |"]


def test_library_items_of_repeated_lines(spark, tmp_path):
    orders = [(k, datetime.datetime(2024, 1, 1)) for k in range(40)]
    lines = [(k, part, line) for line, part in ((1, 5), (7, 6), (7, 9), (7, 4), (4, 2), (4, 1)) for k in range(40)]
    got = rows(spark, tmp_path, "s_library_items", orders=(orders, "o_orderkey long, o_orderdate timestamp"), lineitem=(lines, "l_orderkey long, l_partkey long, l_linenumber int"))
    assert {r[2:] for r in got} == {(None, "v6", "v2")} and len(got) == 30


def test_library_items_of_lines_in_several_files(spark, tmp_path):
    # the first file's row comes first, though further down in its file
    (tmp_path / "lineitem.parquet").mkdir()
    for name, parts in (("a", [1, 2, 3, 5]), ("b", [6, 7]), ("c", [4])):
        lines = {"l_orderkey": [9] * (len(parts) - 1) + [0], "l_partkey": parts, "l_linenumber": pa.array([7] * len(parts), pa.int32())}
        pq.write_table(pa.table(lines), tmp_path / "lineitem.parquet" / f"{name}.parquet")
    got = rows(spark, tmp_path, "s_library_items", orders=([(0, datetime.datetime(2024, 1, 1))], "o_orderkey long, o_orderdate timestamp"))
    assert got == [(0, "journalArticle", None, "v5", None)]
