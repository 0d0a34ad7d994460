import pytest

from lexquarry.operators import sqlviews

GOOD = [
    ("select load, `set` from t", 3), ("SELECT count(*) AS n FROM t WHERE load > (SELECT min(load) FROM t)", 1), ("with x as (select load from t), y as (select * from x) select * from y join t using (load);", 3), ("values (1), (2)", 2),
    ("explain select * from t", 1), ("select 'drop table t; insert' as x -- delete", 1), ("select * from (select * from T where load in (select load from t))", 3), ("select exists(select 1 from t)", 1), ("from t select load", 3), ("select * from range(4)", 4),
    ("with x as (with z as (select * from t) select * from z) select * from x", 3),
]
BAD = [
    "drop table t", "insert into t values (1)", "select 1; select 2", "set x = 1", "create table z as select * from t", "with x as (select 1) insert into t select * from x", "select * from parquet.`{0}`", "select * from other", "select * from t where load in (select id from other)",
    "select * from t join (select * from parquet.`{0}`)", "with x as (select * from parquet.`{0}`) select * from x", "select (select max(id) from parquet.`{0}`)", "explain drop table t", "explain select * from other", "select java_method('java.lang.Math', 'random')", "select reflect('java.lang.Math', 'random') from t",
    "show tables", "describe t", "refresh table t", "cache table t", "from t insert into other select *", "", "selec 1", "select * from global_temp.t", "select load from t where exists (select 1 from parquet.`{0}`)", "call x.y()", "truncate table t", "load data inpath 'x' into table t", "use other",
]


@pytest.fixture(scope="module")
def views(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("other") / "p")
    spark.range(2).write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("other")
    return {"t": spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "load int, `set` string")}, path


@pytest.mark.parametrize(("sql", "rows"), GOOD)
def test_queries(spark, views, sql, rows):
    assert len(sqlviews.read_only(spark, sql, views[0]).collect()) == rows


@pytest.mark.parametrize("sql", BAD)
def test_refused(spark, views, sql):
    with pytest.raises(sqlviews.Refused):
        sqlviews.read_only(spark, sql.format(views[1]), views[0])
