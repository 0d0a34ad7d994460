"""Records of compilers' logs, which may be of any length: lines are rows, and no log is gathered in one place.

lines(path, line, text) are numbered from 1 without gaps. An error begins with `! `; what tells its place is the next
line that begins with `l.` and a number, if no other error stands before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Lines a block: what a log's blocks have to hand on to each other is one row each.
BLOCK = 10_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text) of text files. A file may be read by many tasks: lines are counted within each block of a file,
    and the counts of the blocks before are added."""
    d = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))
    counts = d.groupBy("path", "at").agg(F.count("*").alias("many"), F.min("id").alias("first"))
    counts = counts.withColumn("before", F.sum("many").over(Window.partitionBy("path").orderBy("at")) - F.col("many"))
    return d.join(counts, ["path", "at"]).select("path", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "text")


def records(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """(path, ord, error, line, context): an error, the source line it was met in, and the text around that place, which
    goes on in the line below. ord is the number of the log's line where the error begins."""
    marks = lines.where("startswith(text, '! ') OR startswith(text, 'l.')").withColumn("block", F.floor(F.col("line") / block))
    own = Window.partitionBy("path", "block").orderBy("line")
    marks = marks.withColumn("before", F.lag(F.struct("line", "text")).over(own))
    # the first mark of a block follows the last one of the blocks before
    last = marks.groupBy("path", "block").agg(F.max_by(F.struct("line", "text"), "line").alias("last"))
    last = last.withColumn("handed_on", F.lag("last").over(Window.partitionBy("path").orderBy("block"))).drop("last")
    d = marks.where("startswith(text, 'l.')").join(last, ["path", "block"]).withColumn("error", F.coalesce("before", "handed_on"))
    place = r"^l\.([0-9]+)\s*(.*)$"
    d = d.where(F.startswith("error.text", F.lit("! ")) & F.col("text").rlike(place))
    below = lines.select("path", (F.col("line") - 1).alias("line"), F.col("text").alias("below")).where("NOT startswith(below, '!') AND NOT startswith(below, 'l.')")
    d = d.join(below, ["path", "line"], "left")
    context = F.concat_ws("\n", F.regexp_extract("text", place, 2), F.col("below"))
    return d.select("path", F.col("error.line").alias("ord"), F.trim(F.substr("error.text", F.lit(3))).alias("error"), F.regexp_extract("text", place, 1).cast("long").alias("line"), context.alias("context"))


def confidence(error: Column) -> Column:
    """likely-macro for a command that the compiler doesn't know, which may only lack its package; otherwise certain."""
    return F.when(F.contains(F.lower(error), F.lit("undefined control sequence")), "likely-macro").otherwise("certain")


def worklist(found: DataFrame, formulas: DataFrame) -> DataFrame:
    """(id, path, line, end_line, kind, error, confidence, context, collection) for found(path, line, error, context) and
    formulas(path, line, end_line, kind): each error with the formula it stands in, the latest that begins at or before
    its line and hasn't ended. The id is stable, so that entries can be ticked off.

    Formulas don't overlap; a formula is dealt to every bucket of lines it reaches, so an error meets those of its own."""
    size = 50
    f = formulas.select("path", F.col("line").alias("start"), "end_line", "kind", F.explode(F.sequence(F.floor(F.col("line") / size), F.floor(F.col("end_line") / size))).alias("bucket"))
    d = found.withColumn("bucket", F.floor(F.col("line") / size)).join(f, ["path", "bucket"]).where("line BETWEEN start AND end_line")
    d = d.groupBy("path", "line", "error", "context").agg(F.max_by(F.struct("start", "end_line", "kind"), "start").alias("f"))
    collection = F.when(F.contains("path", F.lit("/")), F.split_part("path", F.lit("/"), F.lit(1))).otherwise("")
    return d.select(F.concat_ws(":", "path", F.col("f.start").cast("string")).alias("id"), "path", F.col("f.start").alias("line"), "f.end_line", "f.kind", "error", confidence(F.col("error")).alias("confidence"), "context", collection.alias("collection"))
