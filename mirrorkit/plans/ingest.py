"""From candidate records to what is copied, where, and with which tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorkit.operators.routing import fact_columns, fact_rows, place
from mirrorkit.sources.tables import within_spans


def plan_candidates(
    candidates: DataFrame, ledger: DataFrame, dest_keys: DataFrame, members: DataFrame, specs: DataFrame
) -> DataFrame:
    """Status, bucket and tags of every candidate key.

    Candidates (``mirror, key, uid, n_records, is_synth``), ledger, destination and members meet in
    one aggregation per (mirror, key) instead of three joins: each table is read once and shuffled
    once, after every task has folded its rows per key, and no key can become a hot join key.

    A small pass first cuts the three large tables to its candidates (``among``), which costs no
    shuffle while those are small enough to broadcast.
    """
    no = F.lit(None).cast("boolean")
    # With them, candidates name a record of their own; otherwise the caller knows the folder.
    place_of = [c for c in ("folder", "epoch") if c in candidates.columns]
    blank = {
        **{c: F.lit(None).cast(candidates.schema[c].dataType) for c in place_of},
        "uid": F.lit(None).cast("long"), "n_records": F.lit(None).cast("long"), "is_synth": no, "in_ledger": no,
        "in_dest": no, "in_inbox": no, "in_sent": no, "label": F.lit(None).cast("string"),
    }

    def side(rows: DataFrame, **have) -> DataFrame:
        given = {c: F.col(c) for c in rows.columns}
        return rows.select("mirror", "key", *[{**blank, **given, **have}[c].alias(c) for c in blank])

    yes = F.lit(True)
    mixed = (
        side(candidates.select("mirror", "key", *place_of, "uid", "n_records", "is_synth"))
        .unionByName(side(ledger.select("mirror", "key"), in_ledger=yes))
        .unionByName(side(dest_keys.select("mirror", "key"), in_dest=yes))
        .unionByName(side(fact_rows(members, specs)))
    )
    known = mixed.groupBy("mirror", "key").agg(
        *[F.max(c).alias(c) for c in place_of], F.min("uid").alias("uid"), F.sum("n_records").alias("n_records"), F.max("is_synth").alias("is_synth"),
        F.max("in_ledger").alias("in_ledger"), F.max("in_dest").alias("in_dest"), *fact_columns(),
    ).filter(F.col("n_records").isNotNull())
    guard = specs.select("mirror", "dest_guard")
    guarded = F.col("in_dest") & ~F.col("is_synth") & F.col("dest_guard")
    status = F.when(F.col("in_ledger"), "in_ledger").when(guarded, "in_dest").otherwise("copy")
    return place(known.join(guard, "mirror").withColumn("status", status), specs).select(
        "mirror", "key", *place_of, "uid", "n_records", "is_synth", "status", "wanted", "tags"
    )


def ingest_plan(
    keyed: DataFrame, ledger: DataFrame, dest_keys: DataFrame, members: DataFrame, specs: DataFrame
) -> DataFrame:
    """One row per candidate key: ``mirror, key, uid, n_records, is_synth, status, wanted, tags``.

    Duplicates inside the batch collapse, the lowest uid wins. The status is 'in_ledger' (skip),
    'in_dest' (skip, but record) or 'copy'.
    """
    rows = keyed.select("mirror", "key", "uid", F.lit(1).cast("long").alias("n_records"), "is_synth")
    return plan_candidates(rows, ledger, dest_keys, members, specs)


def source_candidates(
    messages: DataFrame, specs: DataFrame, status: DataFrame, marks: DataFrame,
    full: bool = False, max_uids: int | Column | None = None,
) -> DataFrame:
    """Records of every mirror's source folder above its mark.

    A new epoch makes every record a candidate; the first epoch ever seen does not count as changed.
    ``full`` ignores the mark and so finds records that appeared late below it. ``max_uids`` bounds
    the uid range one batch takes per mirror, which makes a long first run resumable.
    """
    return within_spans(messages, source_spans(specs, status, marks, full, max_uids))


def source_spans(
    specs: DataFrame, status: DataFrame, marks: DataFrame, full: bool = False, max_uids: int | Column | None = None
) -> DataFrame:
    """Per mirror: current epoch, whether it changed, and the uid range ``(_from, _to]`` to scan.

    ``max_uids`` may be a column of the settings, such as ``uid_batch``. A full scan has no mark to
    resume from, so the two do not go together.
    """
    if full and max_uids is not None:
        raise ValueError("a full scan cannot be cut into windows: give full or max_uids, not both")
    stored = marks.select("mirror", F.col("epoch").alias("_stored"), F.col("last_uid").alias("_last"))
    most = max_uids if isinstance(max_uids, Column) else F.lit(max_uids)
    folder = specs.select("mirror", F.col("source_folder").alias("folder"), most.cast("long").alias("_most"))
    known = F.coalesce(F.col("_stored"), F.lit(0))
    same = known == F.col("epoch")
    spans = (
        folder.join(status, ["mirror", "folder"]).join(stored, "mirror", "left")
        .withColumn("epoch_changed", (known != 0) & ~same)
        .withColumn("_mark", F.when(same, F.col("_last")).otherwise(0))
        .withColumn("_from", F.lit(0).cast("long") if full else F.col("_mark"))
    )
    top = F.col("uid_next") - 1
    if max_uids is not None:
        top = F.least(top, F.col("_from") + F.col("_most"))
    return spans.withColumn("_to", F.greatest(top, F.col("_mark")))


def epoch_reset(messages: DataFrame, specs: DataFrame, status: DataFrame, marks: DataFrame) -> DataFrame:
    """Per mirror: did the epoch change, and how many candidates follow from that?"""
    spans = source_spans(specs, status, marks).select("mirror", "epoch", "epoch_changed")
    counted = source_candidates(messages, specs, status, marks).groupBy("mirror").agg(
        F.count(F.lit(1)).alias("candidates"), F.min("uid").alias("first_uid")
    )
    return spans.join(counted, "mirror", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
