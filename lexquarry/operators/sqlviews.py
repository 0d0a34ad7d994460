"""Read-only SQL over named DataFrames, judged by the plan that Spark's own parser makes of it."""

from __future__ import annotations

import re
from collections.abc import Iterator

from py4j.java_gateway import JavaObject
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

#: Functions that call any static method of the JVM.
REFLECTING = re.compile(r"'?\b(reflect|try_reflect|java_method)\(", re.IGNORECASE)
#: Nodes that act while they are analysed.
CALLS = ("Call",)
_RELATION = re.compile(r"UnresolvedRelation \[([^\]]*)\]")


class Refused(ValueError):
    pass


def _nodes(plan: JavaObject) -> Iterator[JavaObject]:
    yield plan
    for many in (plan.children(), plan.innerChildren()):
        for k in range(many.length()):
            child = many.apply(k)
            if hasattr(child, "children"):
                yield from _nodes(child)


def _named(plan: JavaObject) -> set[str]:
    """The names that WITH gives in a plan."""
    out = set()
    for node in _nodes(plan):
        if node.getClass().getSimpleName() == "UnresolvedWith":
            many = node.cteRelations()
            out |= {many.apply(k)._1().lower() for k in range(many.length())}
    return out


def checked(spark: SparkSession, sql: str, views: set[str]) -> None:
    """Raises Refused unless sql is one query, or EXPLAIN of one, whose tables are all views or its own WITH."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise Refused(f"not one statement that Spark can read: {e.getMessage()}") from e
    if plan.getClass().getSimpleName() == "ExplainCommand":
        plan = plan.logicalPlan()
    command = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    writing = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.ParsedStatement")
    for node in _nodes(plan):
        if command.isInstance(node) or writing.isInstance(node) or node.getClass().getSimpleName() in CALLS:
            raise Refused(f"{node.getClass().getSimpleName()} is no query")
    text = plan.toString()  # with the plans of subqueries
    if REFLECTING.search(text):
        raise Refused("functions that call methods aren't allowed")
    known = {v.lower() for v in views} | _named(plan)
    for found in _RELATION.findall(text):
        if found.lower() not in known:
            raise Refused(f"{found} is none of the views")


def read_only(spark: SparkSession, sql: str, views: dict[str, DataFrame]) -> DataFrame:
    """The result of one SELECT, WITH, VALUES or EXPLAIN over the views; anything else is refused before it runs. Tables of
    the catalog and files aren't views."""
    sql = sql.strip().rstrip(";")
    checked(spark, sql, set(views))
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)
