"""Membership snapshots, their differences and the operations those cause.

A member row is ``mirror, folder, key, is_synth, uid``: one row per record in the folder, so a key
stays a member until its last record is gone. Uid 0 is a placeholder for a row whose uid is unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorkit.operators.dedup import KEY, among
from mirrorkit.operators.sequence import number_rows
from mirrorkit.session import stored

PLACE = ["mirror", "folder", "key"]
CHANGE_COLUMNS = ("mirror", "folder", "key", "is_synth", "uid", "op")


def latest_member_uid(rows: DataFrame) -> DataFrame:
    """Presence per (mirror, folder, key); the last uid wins."""
    return rows.groupBy(*PLACE).agg(F.max("uid").alias("uid"), F.max("is_synth").alias("is_synth"))


def removed_uids(members: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Stored rows whose uid left the folder. Placeholders have no uid to compare and stay."""
    return members.filter(F.col("uid") != 0).join(snapshot, ["mirror", "folder", "uid"], "left_anti")


def diff_by_uid(members: DataFrame, snapshot: DataFrame, fresh: DataFrame) -> DataFrame:
    """Changes inside one epoch.

    A key is removed when none of its stored uids is left. Every key among ``fresh`` (records above
    the high-water mark) is added. A key that left and came back gives both, removal first.
    """
    placeholders = members.filter(F.col("uid") == 0).select(*PLACE, "is_synth", "uid", F.lit(True).alias("_alive"))
    known = (
        members.filter(F.col("uid") != 0)
        .join(snapshot.withColumn("_hit", F.lit(True)), ["mirror", "folder", "uid"], "left")
        .select(*PLACE, "is_synth", "uid", F.coalesce(F.col("_hit"), F.lit(False)).alias("_alive"))
    )
    removed = (
        known.unionByName(placeholders).groupBy(*PLACE)
        .agg(F.max("_alive").alias("_alive"), F.max("uid").alias("uid"), F.max("is_synth").alias("is_synth"))
        .filter(~F.col("_alive")).withColumn("op", F.lit("remove"))
    )
    added = latest_member_uid(fresh).withColumn("op", F.lit("add"))
    return removed.select(*CHANGE_COLUMNS).unionByName(added.select(*CHANGE_COLUMNS))


def diff_by_key(old: DataFrame, new: DataFrame) -> DataFrame:
    """Compare two snapshots by key: 'add', 'remove' or 'same' (with the uid refreshed).

    Both sides go through one aggregation instead of a full outer join, so there is one shuffle,
    duplicates collapse before it, and no key can become a hot join key.
    """
    sides = old.select(*PLACE, "is_synth", F.col("uid").alias("_old"), F.lit(None).cast("long").alias("_new")).unionByName(
        new.select(*PLACE, "is_synth", F.lit(None).cast("long").alias("_old"), F.col("uid").alias("_new"))
    )
    op = F.when(F.col("_old").isNull(), "add").when(F.col("_new").isNull(), "remove").otherwise("same")
    return (
        sides.groupBy(*PLACE)
        .agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"), F.max("is_synth").alias("is_synth"))
        .withColumn("op", op).withColumn("uid", F.coalesce("_new", "_old"))
        .select(*CHANGE_COLUMNS)
    )


def row_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Member rows to write so that ``old`` becomes ``new``; identical rows give nothing."""
    row = ["mirror", "folder", "key", "uid"]
    sides = old.select(*row, "is_synth", F.lit(1).alias("_old"), F.lit(0).alias("_new")).unionByName(
        new.select(*row, "is_synth", F.lit(0).alias("_old"), F.lit(1).alias("_new"))
    )
    return (
        sides.groupBy(*row)
        .agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"), F.max("is_synth").alias("is_synth"))
        .filter(F.col("_old") != F.col("_new"))
        .withColumn("op", F.when(F.col("_new") == 1, "add").otherwise("remove"))
        .select(*CHANGE_COLUMNS)
    )


def with_first_scan(changes: DataFrame, members: DataFrame) -> DataFrame:
    """Mark changes of folders that had no stored rows. Those activate the folder and cause no operations.

    Only a full scan (first scan or new epoch) asks this. Inside one epoch every change counts.
    """
    # Written first: one row per folder, broadcast by its size, so changes are not shuffled by folder.
    known = stored(members.select("mirror", "folder").distinct().withColumn("_stored", F.lit(True)), "first-scan")
    return changes.join(known, ["mirror", "folder"], "left").withColumn(
        "first_scan", F.col("_stored").isNull()
    ).drop("_stored")


def gate_ops(
    changes: DataFrame, watch: DataFrame, ledger: DataFrame, asked: DataFrame | None = None
) -> DataFrame:
    """Changes that cause an operation: the folder has a kind, the key is real and already copied.

    ``asked`` are the changes once written: the ledger is then cut to their keys before it is shuffled.
    """
    kinds = stored(watch.filter(F.col("kind").isNotNull()).select("mirror", "folder", "kind"), "kinds")
    caused = changes.filter(
        F.col("op").isin("add", "remove") & ~F.col("is_synth") & ~F.col("first_scan")
    ).join(kinds, ["mirror", "folder"])
    copied = among(ledger.select(*KEY), asked)
    return caused.join(copied, KEY, "left_semi").select("mirror", "kind", "key", "folder", "op", "uid")


def sequence_ops(ops: DataFrame) -> DataFrame:
    """Number the operations of a batch per mirror: removals of a folder before its additions, then by uid."""
    ranked = ops.withColumn("_add", (F.col("op") == "add").cast("int"))
    return number_rows(ranked, ["mirror"], ["folder", "_add", "uid", "key"]).drop("_add")


def net_member_change(changes: DataFrame) -> DataFrame:
    """Last change per (mirror, folder, key) decides presence. ``changes`` carries ``seq``."""
    last = F.max(F.struct("seq", "op", "uid")).alias("c")
    return changes.groupBy(*PLACE).agg(last).select(*PLACE, F.col("c.op").alias("op"), F.col("c.uid").alias("uid"))


def members_next(presence: DataFrame, changes: DataFrame) -> DataFrame:
    """Presence after a batch of changes: upserts replace the uid, removals drop the row."""
    held = presence.select(*PLACE, F.lit(-1).cast("long").alias("seq"), F.lit("add").alias("op"), "uid")
    both = held.unionByName(changes.select(*PLACE, F.col("seq").cast("long").alias("seq"), "op", "uid"))
    return net_member_change(both).filter(F.col("op") == "add").drop("op")


def folder_state_next(state: DataFrame, scanned: DataFrame) -> DataFrame:
    """Scan state after a pass: scanned folders replaced, others kept."""
    kept = state.join(scanned.select("mirror", "folder"), ["mirror", "folder"], "left_anti")
    cols = ["mirror", "folder", "epoch", "last_uid"]
    return kept.select(*cols).unionByName(scanned.select(*cols))


def vanished(members: DataFrame, watch: DataFrame, specs: DataFrame) -> DataFrame:
    """Rows of folders that are no longer watched, for mirrors that sweep them."""
    sweep = specs.filter("sweep_missing_folders").select("mirror")
    return members.join(sweep, "mirror", "left_semi").join(watch, ["mirror", "folder"], "left_anti")


def upgrade_labels(labels: DataFrame) -> DataFrame:
    """Members from an older state's ``mirror, key, label`` rows: uid 0 until the next full scan."""
    return labels.groupBy("mirror", F.col("label").alias("folder"), "key").agg(
        F.lit(0).cast("long").alias("uid"), F.max("is_synth").alias("is_synth")
    )
