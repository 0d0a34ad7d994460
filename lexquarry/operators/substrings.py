"""Which strings contain which, by equi-joins on letter runs: no string meets all others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _runs(c: str, n: Column | int) -> Column:
    """The distinct runs of n characters of a string; a shorter string has none."""
    n = F.lit(n) if isinstance(n, int) else n
    at = F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - n + 1))
    return F.array_distinct(F.transform(at, lambda k: F.substr(F.col(c), k, n)))


def containing(pieces: DataFrame, texts: DataFrame, letters: int = 3) -> DataFrame:
    """(id, w): the distinct texts(w) that contain pieces(id, piece), which aren't empty.

    Each piece looks under the one of its runs of `letters` characters that the fewest texts have, or, if it is shorter,
    under itself; texts are listed under their runs of the lengths that occur, of which there are `letters` at most.
    """
    # strings are few bytes and their runs many rows: dealt out by number, not by the bytes that a shuffle would be cut into
    many = texts.sparkSession.sparkContext.defaultParallelism
    pieces, texts = pieces.select("id", "piece").repartition(many), texts.select("w").distinct().repartition(many)
    size = F.least(F.length("piece"), F.lit(letters))
    sizes = [n for (n,) in pieces.where("piece <> ''").select(size).distinct().collect()]
    if not sizes:
        return pieces.select("id", F.col("piece").alias("w")).where("false")
    listed = texts.select("w", F.explode(F.flatten(F.array_compact(F.array(*(_runs("w", n) for n in sizes))))).alias("run"))
    p = pieces.where("piece <> ''").withColumn("n", size).select("id", "piece", F.explode(_runs("piece", F.col("n"))).alias("run"))
    # rows are estimated without the runs that explode makes of them, so the planner would broadcast any number of runs
    often = listed.join(p.select("run").distinct().hint("merge"), "run").groupBy("run").agg(F.count("*").alias("often"))
    key = p.join(often.hint("merge"), "run", "left").groupBy("id", "piece").agg(F.min_by("run", F.struct(F.coalesce("often", F.lit(0)), "run")).alias("run"))
    return key.join(listed.hint("merge"), "run").where("contains(w, piece)").select("id", "w").distinct()


def either_contains(a: DataFrame, b: DataFrame, letters: int = 8) -> DataFrame:
    """(id, w): for a(id, text) and b(w) the pairs of which one contains the other."""
    inside = containing(a.select("id", F.col("text").alias("piece")), b, letters)
    around = containing(b.select(F.col("w").alias("id"), F.col("w").alias("piece")).distinct(), a.select(F.col("text").alias("w")), letters)
    return inside.union(around.select(F.col("w").alias("text"), F.col("id").alias("w")).join(a.hint("merge"), "text").select("id", "w")).distinct()
