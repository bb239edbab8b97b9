"""Deduplication against the batch itself, the ledger and the destination."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["mirror", "key"]


def first_per_key(keyed: DataFrame) -> DataFrame:
    """One row per (mirror, key): its lowest uid and how many records share the key.

    An aggregation, not a ranking: every task keeps one row per key before the shuffle, so a key
    that holds a large share of all rows costs no more than any other. The result is unique on the
    key, which also keeps the joins after it free of skew.
    """
    return keyed.groupBy(*KEY).agg(
        F.min("uid").alias("uid"),
        F.count(F.lit(1)).alias("n_records"),
        F.max("is_synth").alias("is_synth"),
    )


def first_record_per_key(records: DataFrame) -> DataFrame:
    """The same with the record itself (``folder, epoch, uid``): uids alone do not name one."""
    return records.groupBy(*KEY).agg(
        F.min(F.struct("uid", "epoch", "folder")).alias("r"), F.count(F.lit(1)).alias("n_records"),
        F.max("is_synth").alias("is_synth"),
    ).select(*KEY, "r.folder", "r.epoch", "r.uid", "n_records", "is_synth")


def among(known: DataFrame, asked: DataFrame | None) -> DataFrame:
    """``known`` cut to the keys ``asked`` for (all of it when None).

    ``known`` is a large table (the ledger, the destination, the members) and ``asked`` the written
    candidates of a small pass. As the right side of a semi join, those are broadcast while they are
    below the threshold, and the large table is neither shuffled nor sorted.
    """
    return known if asked is None else known.join(asked.select(*KEY), KEY, "left_semi")


def flag_known(candidates: DataFrame, known: DataFrame, flag: str) -> DataFrame:
    """Add a boolean: is (mirror, key) among ``known``?"""
    hits = known.select(*KEY).distinct().withColumn("_hit", F.lit(True))
    return (
        candidates.join(hits, KEY, "left")
        .withColumn(flag, F.coalesce(F.col("_hit"), F.lit(False)))
        .drop("_hit")
    )


def ledger_antijoin(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """Candidates the ledger does not hold yet."""
    return candidates.join(ledger.select(*KEY), KEY, "left_anti")


def dest_guard(candidates: DataFrame, dest_keys: DataFrame, specs: DataFrame | None = None) -> DataFrame:
    """Flag candidates already present in any bucket. Synthesized keys are not looked up,
    and neither are those of mirrors that switch the guard off."""
    flagged = flag_known(candidates, dest_keys, "_present")
    on = ~F.col("is_synth") & F.col("_present")
    if specs is not None:
        flagged = flagged.join(specs.select("mirror", F.col("dest_guard").alias("_guard")), "mirror")
        on = on & F.col("_guard")
    return flagged.withColumn("in_dest", on).drop("_present", "_guard")


def seed_keys(dest: DataFrame, ledger: DataFrame) -> DataFrame:
    """Destination keys the ledger lacks, with the number of records scanned for each."""
    distinct = dest.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_records"), F.max("is_synth").alias("is_synth"))
    return ledger_antijoin(distinct, ledger)


def ledger_upsert(ledger: DataFrame, records: DataFrame) -> DataFrame:
    """Ledger after inserting ``records`` where absent.

    Copies of a key inside the batch collapse to the one recorded first; stored rows never change.
    """
    first = F.min(F.struct("copied_at", "uid")).alias("r")
    fresh = records.groupBy(*KEY).agg(first).select(*KEY, "r.uid", "r.copied_at")
    return ledger.select(*KEY, "uid", "copied_at").unionByName(ledger_antijoin(fresh, ledger))


def key_collisions(keyed: DataFrame) -> DataFrame:
    """Keys whose records differ in content. The first is copied, the others are skipped by design."""
    content = F.sha2(
        F.concat_ws("\u0001", "sender", "subject", F.col("size").cast("string"),
                    F.unix_micros(F.col("internal_date").cast("timestamp")).cast("string")), 256
    )
    return (
        keyed.filter(~F.col("is_synth")).withColumn("content", content)
        .groupBy(*KEY, "content").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*KEY).agg(F.sum("n").alias("n_records"), F.count(F.lit(1)).alias("n_contents"))
        .filter(F.col("n_contents") > 1)
    )
