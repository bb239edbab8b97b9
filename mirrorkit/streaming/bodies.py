"""Bodies that arrive in a stream of their own, after the metadata of their records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mirrorkit.sources.tables import RECORD


def with_late_bodies(
    records: DataFrame, bodies: DataFrame, wait: str, delay: str = "1 hour",
    record_time: str = "internal_date", body_time: str = "arrived_at",
) -> DataFrame:
    """Records with the body that arrives within ``wait`` of them; ``raw`` is null where none does.

    ``bodies`` has the columns of a record's identity, ``raw`` and ``body_time``. A record leaves as soon
    as its body is there, and without one once both streams have passed the end of its wait; until then
    it is kept as state, which is bounded by what arrives within ``wait`` and ``delay``. Rows that come
    more than ``delay`` after later ones are late and dropped, so is a body that misses the wait: a pass
    finds it. Empty and null bodies do not count. A body delivered twice gives two rows. Records without
    a time have no place in the wait and are left out; a pass finds them as well.
    """
    there = bodies.filter(F.length("raw") > 0).select(*[F.col(c).alias(f"_{c}") for c in RECORD], "raw", body_time)
    mine = records.filter(F.col(record_time).isNotNull()).drop("raw", body_time)
    theirs = there.filter(F.col(body_time).isNotNull())
    on = F.expr(f"{body_time} >= {record_time} and {body_time} <= {record_time} + interval {wait}")
    for c in RECORD:
        on = (F.col(c) == F.col(f"_{c}")) & on
    joined = mine.withWatermark(record_time, delay).join(theirs.withWatermark(body_time, delay), on, "left_outer")
    return joined.select(*mine.columns, "raw")


def start_bodies(
    records: DataFrame, bodies: DataFrame, path: str, checkpoint: str, wait: str, once: bool = True, **more: str
) -> StreamingQuery:
    """Write records with their bodies below ``path``. A batch overwrites its own directory."""
    def handle(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = with_late_bodies(records, bodies, wait, **more).writeStream.option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(handle)
    return (writer.trigger(availableNow=True) if once else writer).start()


def without_body(rows: DataFrame) -> DataFrame:
    """Records that waited in vain. One that was also delivered with a body is not among them."""
    full = F.max(F.col("raw").isNotNull()).alias("full")
    return rows.groupBy(*RECORD).agg(full).filter(~F.col("full")).select(*RECORD)
