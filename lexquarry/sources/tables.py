"""Tables of a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt out evenly if a scan would give them to fewer tasks than can work at once, as small files and files of
    one row group do; what a later step doesn't read isn't shuffled. Larger tables are left as they are."""
    many = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(many) if rows.rdd.getNumPartitions() < many else rows
