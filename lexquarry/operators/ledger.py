"""The ingest log: an append-only event table folded into queue and batch state.

events(offset, kind, at, req_id, batch_id, item_id, source_type, source_value, route, retry_of, title, status, error,
decision, committed_path): kinds enqueue, open, item, decision and commit. Order is by offset; `at` has whole seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LADDER = ("arxiv-html", "tex", "textlayer", "mineru", "ocr")


def pending(events: DataFrame) -> DataFrame:
    """Enqueued requests that no batch item has taken up."""
    taken = events.where("kind = 'item' and req_id is not null").select("req_id").distinct()
    return events.where("kind = 'enqueue'").join(taken, "req_id", "left_anti").select("req_id", "offset", "source_type", "source_value", "route", "retry_of")


def runs(events: DataFrame, block: int = 10_000) -> DataFrame:
    """(req_id, offset, run): the run that takes each enqueued request: the batch that is opened first after it, as a run
    takes what was queued when it began and leaves what comes later to the next; null if none has been opened since.

    Events are looked at in blocks of offsets; what blocks tell each other is one row a block.
    """
    marks = events.where("kind IN ('enqueue', 'open')").select("offset", "kind", "req_id", "batch_id", F.floor(F.col("offset") / block).alias("block"))
    opened = F.when(F.col("kind") == "open", F.col("batch_id"))
    # backwards, as a frame that grows is added to, while one that shrinks is gone through again for each row
    before = lambda w, by: w.orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, -1)
    own = F.last(opened, ignorenulls=True).over(before(Window.partitionBy("block"), "offset"))
    firsts = marks.groupBy("block").agg(F.min_by("batch_id", F.when(F.col("kind") == "open", F.col("offset"))).alias("first"))
    later = firsts.select("block", F.last("first", ignorenulls=True).over(before(Window.partitionBy(F.lit(0)), "block")).alias("later"))
    d = marks.withColumn("own", own).where("kind = 'enqueue'").join(later, "block")
    return d.select("req_id", "offset", F.coalesce("own", "later").alias("run"))


def batch_items(events: DataFrame) -> DataFrame:
    """(batch_id, item_id, req_id, title, status, error, route, decision, committed_path, offset), one row an item.

    An item's row comes from its first `item` event; later decisions overwrite (`reset` clears), commits set the path.
    Events of items that were never created are ignored. One aggregation, no sort.
    """
    item, decision, commit = (F.col("kind") == k for k in ("item", "decision", "commit"))
    first = F.min_by(F.struct("req_id", "title", "status", "error", "route"), F.when(item, F.col("offset"))).alias("i")
    when_decided = F.when(decision, F.col("offset"))
    d = events.where("batch_id is not null and item_id is not null").groupBy("batch_id", "item_id").agg(
        F.min(F.when(item, F.col("offset"))).alias("offset"), first,
        F.max_by(F.coalesce("decision", F.lit("reset")), when_decided).alias("decision"), F.max(when_decided).alias("decided"),
        F.max_by("committed_path", F.when(commit, F.col("offset"))).alias("committed_path"),
    )
    # what comes before the item's own event doesn't count
    valid = F.when((F.col("decided") > F.col("offset")) & (F.col("decision") != "reset"), F.col("decision"))
    return d.where("offset is not null").select("batch_id", "item_id", "i.req_id", "i.title", "i.status", "i.error", "i.route", valid.alias("decision"), "committed_path", "offset")


def batch_counts(items: DataFrame) -> DataFrame:
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return items.groupBy("batch_id").agg(F.count("*").alias("items"), one(F.col("decision").isNull() & F.col("committed_path").isNull()).alias("undecided"), one(F.col("committed_path").isNotNull()).alias("committed"), one(F.col("error").isNotNull()).alias("failed"))


def settled(items: DataFrame) -> DataFrame:
    """(batch_id, eligible): every item is decided or committed."""
    return items.groupBy("batch_id").agg(F.every(F.col("decision").isNotNull() | F.col("committed_path").isNotNull()).alias("eligible"))


def next_rung(route: Column) -> Column:
    """The route after this one; null at the bottom and for routes that aren't on the ladder."""
    return F.coalesce(*(F.when(route == a, b) for a, b in zip(LADDER, LADDER[1:], strict=False)))


def retries(items: DataFrame) -> DataFrame:
    """Enqueue events for rejected items, one rung down."""
    d = items.where("decision = 'reject'").withColumn("next", next_rung(F.col("route"))).where("next is not null")
    return d.select(F.lit("enqueue").alias("kind"), F.concat_ws(":", "batch_id", "item_id", "next").alias("req_id"), F.col("next").alias("route"), F.col("req_id").alias("retry_of"))


def committable(items: DataFrame) -> DataFrame:
    return items.where("decision = 'approve' and committed_path is null and error is null")


def image_collisions(images: DataFrame) -> DataFrame:
    """Names that occur with different bytes: images(name, bytes)."""
    return images.groupBy("name").agg(F.min(F.sha1("bytes")).alias("a"), F.max(F.sha1("bytes")).alias("b")).where("a <> b").select("name")


def last_rows(log: DataFrame, key: str, most: int = 40) -> DataFrame:
    """The last `most` rows of each key by offset."""

    return log.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("offset")))).where(F.col("__r") <= most).drop("__r")
