"""A table with one row a key, kept as Parquet in buckets of the key: a merge reads and replaces only the buckets that its
changes fall into, and the files of all others stay as they are.

A bucket's rows are merged by rules, one a column, over what is stored and what comes, in the order of a column. Rules
give the same again if a merge is repeated, so a batch that failed midway is simply merged once more. One writer at a
time; readers that began before a merge may have to read again. The number of buckets stays the same for a table's life.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A rule makes a column's value of the stored row and of the changes: rule(name, place), place being what rows are ordered
#: by: the stored row first, then the changes in their order.
Rule = Callable[[str, Column], Column]
BUCKET = "bucket"


def last(name: str, place: Column) -> Column:
    """The value of the last row; of equal places, of the row that the other columns' `last` comes from too."""
    return F.max_by(name, place)


def first(name: str, place: Column) -> Column:
    """The value that was there first; null counts as none."""
    return F.min_by(name, F.when(F.col(name).isNotNull(), place))


def largest(name: str, place: Column) -> Column:
    return F.max(name)


def smallest(name: str, place: Column) -> Column:
    return F.min(name)


def united(name: str, place: Column) -> Column:
    """The distinct elements of all arrays, in the order in which they came."""
    lists = F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct(place.alias("place"), F.col(name).alias("list")))))
    return F.array_distinct(F.flatten(F.transform(lists, lambda x: x["list"])))


@dataclass(frozen=True)
class Store:
    """folder: where it lies, reachable for all executors. schema: as `name type, ...`. order: a column that says which of a
    key's rows is the latest. rules: by column; `last` where none is named."""

    folder: str
    schema: str
    keys: Sequence[str]
    order: str
    buckets: int = 64
    rules: dict[str, Rule] = field(default_factory=dict)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _exists(self, spark: SparkSession) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def _stored(self, spark: SparkSession) -> DataFrame:
        schema = f"{self.schema}, {BUCKET} int"
        return spark.read.schema(schema).parquet(self.folder) if self._exists(spark) else spark.createDataFrame([], schema)

    def read(self, spark: SparkSession) -> DataFrame:
        """The table; without rows before the first merge."""
        return self._stored(spark).drop(BUCKET)

    def merged(self, changes: DataFrame) -> DataFrame:
        """What the buckets of changes will hold, with their bucket: all of their keys, changed or not."""
        spark, columns = changes.sparkSession, T.StructType.fromDDL(self.schema).fieldNames()
        new = changes.select(*columns).withColumn(BUCKET, self._bucket())
        touched = [b for (b,) in new.select(BUCKET).distinct().collect()]  # as many as there are buckets at most
        old = self._stored(spark).where(F.col(BUCKET).isin(touched))
        # the stored row comes first; equal places are told apart by the rows themselves, so that all columns agree
        both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
        place = F.struct(F.col("__new").alias("n"), F.col(self.order).alias("o"), F.xxhash64(*columns).alias("h"))
        late = F.struct(F.col(self.order).alias("o"), F.col("__new").alias("n"), F.xxhash64(*columns).alias("h"))
        values = []
        for name in columns:
            if name not in self.keys:
                rule = self.rules.get(name, last)
                values.append(rule(name, late if rule is last else place).alias(name))
        return both.groupBy(BUCKET, *self.keys).agg(*values).select(*columns, BUCKET)

    def merge(self, changes: DataFrame) -> None:
        """Writes merged(changes) over the buckets it has; a table of changes without rows changes nothing."""
        out = self.merged(changes).repartition(BUCKET)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.folder)
