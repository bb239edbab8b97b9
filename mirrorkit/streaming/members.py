"""Membership from a stream of add and remove events.

An event is ``mirror, folder, key, seq, op, uid``. The highest ``seq`` of a key decides, so files
may arrive in any order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mirrorkit.operators.membership import PLACE
from mirrorkit.schemas import columns
from mirrorkit.session import remove

EVENTS = columns("mirror string, folder string, key string, seq long, op string, uid long")
TRANSITIONS = columns(
    "mirror string, folder string, key string, seq long, was_present boolean, present boolean, was_uid long, uid long"
)
_LAST = columns("seq long, op string, uid long")
# Batches of a transition stream after which its logs are folded.
FOLD_EVERY = 32


def last_events(events: DataFrame) -> DataFrame:
    """Last event per key: one row per key and task before the shuffle."""
    last = F.max(F.struct("seq", "op", "uid")).alias("e")
    return events.groupBy(*PLACE).agg(last).select(*PLACE, "e.seq", "e.op", "e.uid")


def member_feed(events: DataFrame) -> DataFrame:
    """Change feed with the state kept by Spark: for update mode, a row for every key a batch touched.

    The state of a key is its last event, uid included, so a key that comes back under another uid is
    told as well, and an event that arrives late changes nothing.
    """
    return last_events(events)


def start_feed(events: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write the change feed below ``path``. A batch overwrites its own directory, so a replay changes nothing."""
    def handle(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = member_feed(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(handle)
    return (writer.trigger(availableNow=True) if once else writer).start()


def member_transitions(last: DataFrame, known: DataFrame) -> DataFrame:
    """What a batch has changed: a row per key whose presence or uid is another than before.

    ``last`` are the last events of the batch's keys, written, one row per key; ``known`` any events from
    before it, of which the last one of a key counts. Repeated events, events older than the one that
    decides, and removals of what was not there give no row. A key without a uid is present with a null one.

    ``known`` is first cut to the keys of the batch, by a broadcast while those are small. Both sides then
    meet in one aggregation, so a hot key is one row per task. Nulls in a key are a value like any other.
    """
    asked = last.select(*[F.col(c).alias(f"_{c}") for c in PLACE])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PLACE])
    event = F.struct(*_LAST.names)
    none = F.lit(None).cast(_LAST)
    sides = known.join(asked, same, "left_semi").select(*PLACE, event.alias("_held"), none.alias("_last")).unionByName(
        last.select(*PLACE, none.alias("_held"), event.alias("_last"))
    )
    met = sides.groupBy(*PLACE).agg(F.max("_held").alias("_held"), F.max("_last").alias("_last"))
    newer = met.filter(F.col("_held").isNull() | (F.col("_last") > F.col("_held")))

    def shown(of: str) -> tuple[Column, Column]:
        there = F.coalesce(F.col(f"{of}.op") == "add", F.lit(False))
        return there, F.when(there, F.col(f"{of}.uid"))

    (was_present, was_uid), (present, uid) = shown("_held"), shown("_last")
    told = newer.select(
        *PLACE, "_last.seq", was_present.alias("was_present"), present.alias("present"), was_uid.alias("was_uid"), uid.alias("uid"),
    ).select(*TRANSITIONS.names)
    return told.filter((F.col("was_present") != F.col("present")) | ~F.col("was_uid").eqNullSafe(F.col("uid")))


def start_transitions(
    events: DataFrame, path: str, checkpoint: str, snapshot: DataFrame | None = None, once: bool = True,
    fold_every: int = FOLD_EVERY,
) -> StreamingQuery:
    """Write the transitions of every batch below ``path``. A batch overwrites its own directories, so a replay
    changes nothing.

    ``snapshot`` has the last event of every key known before the stream starts, in the columns of ``EVENTS``
    (``last_events`` makes such rows); it is what a new checkpoint starts from. What is known lies in tables
    below the checkpoint: ``log/epoch=N`` are the last events of batch N, ``base/epoch=N`` those of all keys
    before it, folded anew every ``fold_every`` batches. A batch reads the base before it and the logs since.
    """
    root = f"{checkpoint}/transitions"

    def read(spark: SparkSession, start: int, end: int) -> DataFrame:
        """What was known before batch ``end``, from the base of batch ``start`` on."""
        tables = [f"{root}/base/epoch={start}", *[f"{root}/log/epoch={n}" for n in range(start, end)]]
        return spark.read.schema(EVENTS).parquet(*tables)

    def handle(batch: DataFrame, epoch: int) -> None:
        spark, start = batch.sparkSession, epoch - epoch % fold_every
        if epoch == start:
            if epoch:
                base = last_events(read(spark, epoch - fold_every, epoch))
            else:
                base = spark.createDataFrame([], EVENTS) if snapshot is None else snapshot.select(*EVENTS.names)
            base.write.mode("overwrite").parquet(f"{root}/base/epoch={epoch}")
            # A replay of this batch folds the span before it again; what lies before that is read no more.
            old = epoch - 2 * fold_every
            if old >= 0:
                for table in (f"base/epoch={old}", *[f"log/epoch={n}" for n in range(old, old + fold_every)]):
                    remove(spark, f"{root}/{table}")
        log = f"{root}/log/epoch={epoch}"
        last_events(batch).write.mode("overwrite").parquet(log)
        told = member_transitions(spark.read.schema(EVENTS).parquet(log), read(spark, start, epoch))
        told.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_members(events: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """The same without state: every batch adds its last event per key to a log.

    A batch overwrites its own directory, so a replay changes nothing. ``present_members`` folds the log.
    """
    def handle(batch: DataFrame, epoch: int) -> None:
        last_events(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if once else writer).start()


def present_members(log: DataFrame) -> DataFrame:
    """Members after a change feed or a log of last events."""
    return last_events(log).filter(F.col("op") == "add").select(*PLACE, "uid")
