"""Streaming forms of the folds. Each agrees with its batch form on the same log.

Decisions and seen ids never expire, so their state isn't bounded by a watermark: it is one small row a key, kept in
the state store, and grows with the number of keys as the tables it replaces do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexquarry.sources.store import Store, smallest


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    offset, decision = state.get if state.exists else (-1, None)
    for f in frames:
        if len(f):
            last = f.loc[f["offset"].idxmax()]
            if last["offset"] > offset:
                offset, decision = int(last["offset"]), last["decision"]
    decision = None if decision is None or pd.isna(decision) or decision == "reset" else decision
    state.update((offset, decision))
    yield pd.DataFrame({"report": [key[0]], "id": [key[1]], "offset": [offset], "decision": [decision]})


def triage_updates(log: DataFrame) -> DataFrame:
    """A stream of (report, id, offset, decision): the present decision of every key that a batch touches, null if it
    was taken back. log(report, id, decision, offset); rows of one key may come in any order."""
    keyed = log.where("id is not null").groupBy("report", "id")
    return keyed.applyInPandasWithState(_fold, "report string, id string, offset long, decision string", "offset long, decision string", "update", GroupStateTimeout.NoTimeout)


def first_seen(candidates: DataFrame) -> DataFrame:
    """A stream of candidates, each id once ever."""
    return candidates.where("id is not null").dropDuplicates(["id"])


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total): tumbling windows of event time; rows later than `late` are dropped."""
    d = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return d.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def kept(stream: DataFrame, table: Store, done: Callable[[SparkSession, int], None] | None = None) -> DataStreamWriter:
    """Merges every batch into a store: only the buckets that its keys fall into are read and written. A batch that runs
    again gives the same rows."""

    def write(batch: DataFrame, number: int) -> None:
        table.merge(batch)
        if done is not None:
            done(batch.sparkSession, number)

    return stream.writeStream.foreachBatch(write)


#: A queue's requests: which run took them is decided once.
QUEUE = "req_id string, offset long, source_type string, source_value string, route string, run long"


def queue_store(folder: str, buckets: int = 64) -> Store:
    return Store(folder, QUEUE, ("req_id",), "offset", buckets, {"run": smallest})


def run_queue(log: DataFrame, table: Store, run: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Runs over a queue: every micro-batch of log(offset, kind, ...) is one. What the log held when it began is queued, and
    run(queue, number) gets all requests that no earlier run has taken; what is enqueued meanwhile, by the run itself too,
    is in the next. Say with .trigger() when runs begin. A run that failed is given the same queue again."""

    def write(batch: DataFrame, number: int) -> None:
        columns = [c.split()[0] for c in QUEUE.split(", ")]
        table.merge(batch.where("kind = 'enqueue' AND req_id IS NOT NULL").withColumn("run", F.lit(None).cast("long")).select(columns))
        queue = table.read(batch.sparkSession).where((F.col("run").isNull()) | (F.col("run") == number)).drop("run")
        run(queue, number)
        table.merge(queue.withColumn("run", F.lit(number).cast("long")).select(columns))

    return log.writeStream.foreachBatch(write)


def merged(stream: DataFrame, path: str, keys: list[str], offset: str = "offset", done: Callable[[DataFrame], None] | None = None) -> DataStreamWriter:
    """Keeps the last row of each key in versions of a Parquet table under `path`, which suits small states: each batch
    writes the whole table; kept() doesn't. A batch that runs again reads the version before its own and writes its own
    again, so a restart neither loses nor doubles rows. The last two versions stay."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        top = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(top)] if fs.exists(top) else []
        whole = sorted(int(n) for n in names if n.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))
        before = [n for n in whole if n < number]
        old = spark.read.schema(batch.schema).parquet(f"{path}/{before[-1]}") if before else batch.limit(0)
        cols = [c for c in batch.columns if c not in keys]
        new = old.unionByName(batch).groupBy(*keys).agg(F.max_by(F.struct(*cols), offset).alias("r")).select(*keys, "r.*").select(batch.columns)
        new.write.mode("overwrite").parquet(f"{path}/{number}")
        for n in before[:-1]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}"), True)
        if done is not None:
            done(new)

    return stream.writeStream.foreachBatch(write)
