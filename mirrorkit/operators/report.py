"""Counters and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ledger_count(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("mirror").agg(F.count(F.lit(1)).alias("n_keys"))


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def run_summary(plan: DataFrame) -> DataFrame:
    """Counters of one pass from its ingest plan (``n_records, status, tags`` per distinct key)."""
    copied = F.col("status") == "copy"
    return plan.groupBy("mirror").agg(
        F.sum("n_records").alias("candidates"),
        count_where(copied).alias("copied"),
        (F.sum("n_records") - count_where(copied)).alias("skipped_dup"),
        count_where(copied & (F.size("tags") > 0)).alias("tags_set"),
    )


def move_counts(moves: DataFrame, specs: DataFrame) -> DataFrame:
    """Completed moves per mirror by kind of target bucket."""
    rules = specs.select("mirror", "archive_on", "archive_folder", "sent_on", "sent_folder")
    to_archive = F.col("archive_on") & (F.col("folder") == F.col("archive_folder"))
    to_sent = F.col("sent_on") & (F.col("folder") == F.col("sent_folder"))
    return moves.join(rules, "mirror").groupBy("mirror").agg(
        count_where(to_archive).alias("moved_to_archive"),
        count_where(~to_archive & to_sent).alias("moved_to_sent"),
        count_where(~to_archive & ~to_sent).alias("moved_to_inbox"),
    )


def stale_mirrors(heartbeats: DataFrame, specs: DataFrame, now: Column | int) -> DataFrame:
    """Age of the newest progress per mirror; stale beyond three poll intervals.

    ``heartbeats`` has ``mirror, heartbeat`` in seconds. A mirror without progress is stale.
    """
    now_col = F.lit(now) if isinstance(now, int) else now
    last = heartbeats.groupBy("mirror").agg(F.max("heartbeat").alias("heartbeat"))
    age = now_col - F.col("heartbeat")
    return (
        specs.select("mirror", "poll_seconds").join(last, "mirror", "left")
        .withColumn("age_seconds", age)
        .withColumn("stale", F.coalesce(F.col("age_seconds") > 3 * F.col("poll_seconds"), F.lit(True)))
        .select("mirror", "heartbeat", "age_seconds", "stale")
    )
