"""Full passes over tables bucketed by key: the large side of a plan is read where it lies.

A full pass compares all candidates with the whole ledger, destination and membership. Those grow with the
corpus, the plan of one pass is asked for often, so they are kept bucketed and sorted by (mirror, key). A
bucket is then read by one task, and its rows are folded and joined there: no exchange stands above a
bucketed scan. Candidates are the one side that moves, folded per key before they do.

Every side is unique on the key when it is joined, so a key that holds a third of all rows is one row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorkit.operators.dedup import KEY
from mirrorkit.operators.membership import CHANGE_COLUMNS, PLACE
from mirrorkit.operators.routing import fact_columns, fact_rows, place
from mirrorkit.session import work_dir


def write_bucketed(rows: DataFrame, buckets: int, table: str | None = None, partition: str | None = None) -> str:
    """Append rows to a table bucketed by (mirror, key), sorted within buckets, in the shared folder; returns its name.

    Rows are dealt out by bucket before they are written, so a bucket is one file and not one per task.
    """
    spark = rows.sparkSession
    name = table or f"bucketed_{uuid.uuid4().hex}"
    writer = rows.repartition(buckets, *KEY).write.mode("append").bucketBy(buckets, *KEY).sortBy(*KEY)
    if partition is not None:
        writer = writer.partitionBy(partition)
    if not spark.catalog.tableExists(name):
        writer = writer.option("path", work_dir(spark, name))
    writer.saveAsTable(name)
    return name


def write_snapshot(members: DataFrame, snapshot: int, buckets: int, table: str | None = None) -> str:
    """Append one membership snapshot (mirror, folder, key, is_synth, uid) to a bucketed table of snapshots."""
    rows = members.select(*PLACE, "is_synth", "uid", F.lit(snapshot).cast("long").alias("snapshot"))
    return write_bucketed(rows, buckets, table, "snapshot")


def diff_snapshots(spark: SparkSession, table: str, old: int, new: int) -> DataFrame:
    """The rows of :func:`~mirrorkit.operators.membership.diff_by_key` for two snapshots of one table.

    Both are read by one scan of their two partitions and meet in one aggregation within each bucket.
    """
    rows = spark.table(table).filter(F.col("snapshot").isin(old, new))
    before, now = (F.max(F.when(F.col("snapshot") == which, F.col("uid"))) for which in (old, new))
    op = F.when(F.col("_old").isNull(), "add").when(F.col("_new").isNull(), "remove").otherwise("same")
    return (
        rows.groupBy(*PLACE).agg(before.alias("_old"), now.alias("_new"), F.max("is_synth").alias("is_synth"))
        .withColumn("op", op).withColumn("uid", F.coalesce("_new", "_old")).select(*CHANGE_COLUMNS)
    )


def plan_bucketed(
    candidates: DataFrame, ledger: DataFrame, dest_keys: DataFrame, members: DataFrame, specs: DataFrame, buckets: int,
) -> DataFrame:
    """The rows of :func:`~mirrorkit.plans.ingest.ingest_plan` where ledger, destination keys and members are bucketed.

    ``buckets`` is their number of buckets. Candidates are folded per key and dealt out to as many partitions.
    """
    first = candidates.groupBy(*KEY).agg(
        F.min("uid").alias("uid"), F.count(F.lit(1)).alias("n_records"), F.max("is_synth").alias("is_synth"),
    ).repartition(buckets, *KEY)
    held = ledger.groupBy(*KEY).agg(F.lit(True).alias("in_ledger"))
    there = dest_keys.groupBy(*KEY).agg(F.lit(True).alias("_there"))
    facts = fact_rows(members, specs).groupBy(*KEY).agg(*fact_columns())
    known = first.join(held, KEY, "left").join(there, KEY, "left").join(facts, KEY, "left")
    guarded = F.col("_there") & ~F.col("is_synth") & F.col("dest_guard")
    status = F.when(F.col("in_ledger"), "in_ledger").when(guarded, "in_dest").otherwise("copy")
    judged = known.join(specs.select("mirror", "dest_guard"), "mirror").withColumn("status", status)
    return place(judged, specs).select(*KEY, "uid", "n_records", "is_synth", "status", "wanted", "tags")
