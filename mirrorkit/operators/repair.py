"""Repair of records copied under earlier rules, and the audit of the whole mirror."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorkit.functions.settings import rule_fingerprint
from mirrorkit.functions.tags import missing_keywords, no_strings, tag_signature
from mirrorkit.operators.changes import split_rejected_tags
from mirrorkit.operators.dedup import KEY, first_per_key
from mirrorkit.operators.routing import with_placement
from mirrorkit.sources.tables import scan_buckets


def mirrors_needing_backfill(specs: DataFrame, stored: DataFrame) -> DataFrame:
    """Mirrors whose rules differ from those of their last completed repair (or that never had one).

    ``stored`` has ``mirror, batch_id, fingerprint``; the newest row counts.
    """
    last = stored.groupBy("mirror").agg(F.max(F.struct("batch_id", "fingerprint")).alias("s")).select(
        "mirror", F.col("s.fingerprint").alias("stored")
    )
    now = specs.select("mirror", rule_fingerprint().alias("fingerprint"))
    changed = F.col("stored").isNull() | (F.col("stored") != F.col("fingerprint"))
    return now.join(last, "mirror", "left").filter(changed).select("mirror", "fingerprint")


def backfill_plan(placements: DataFrame, specs: DataFrame, facts: DataFrame) -> DataFrame:
    """What every destination record in a bucket needs: another bucket, more tags, or nothing.

    Adds ``wanted``, ``missing`` (tags to add; none are ever removed) and ``needs``. Move and tags
    are decided on the same row, so a record that moves gets its tags too. Tags the destination
    refuses are not missing.
    """
    rules = specs.select(
        "mirror", (F.col("archive_on") | F.col("sent_on")).alias("_routed"), F.col("labels_on").alias("_labels")
    )
    wants, _ = split_rejected_tags(
        with_placement(placements.withColumnRenamed("tags", "present"), facts, specs), specs
    )
    plan = (
        wants.join(rules, "mirror")
        .withColumn("missing", F.when(F.col("_labels"), missing_keywords(F.col("tags"), F.col("present")))
                    .otherwise(no_strings()))
        .withColumn("wanted", F.when(F.col("_routed"), F.col("wanted")).otherwise(F.col("folder")))
    )
    move, tag = F.col("wanted") != F.col("folder"), F.size("missing") > 0
    needs = (
        F.when(move & tag, "move+tag").when(move, "move").when(tag, "tag").otherwise("nothing")
    )
    return plan.withColumn("needs", needs).drop("_routed", "_labels", "tags")


def backfill_move_rows(plan: DataFrame) -> DataFrame:
    """Rows for the placement log."""
    return plan.filter(F.col("folder") != F.col("wanted")).select(
        *KEY, "copy_id", F.col("folder").alias("from_folder"), F.col("wanted").alias("folder")
    )


def backfill_tag_rows(plan: DataFrame) -> DataFrame:
    """Rows for the tag log: add-only."""
    return plan.select(*KEY, "copy_id", F.explode("missing").alias("tag")).withColumn("op", F.lit("add"))


def backfill_moves(plan: DataFrame) -> DataFrame:
    """Misplaced records per current and wanted bucket."""
    return (
        plan.filter(F.col("folder") != F.col("wanted"))
        .groupBy("mirror", "folder", "wanted").agg(F.count(F.lit(1)).alias("n"))
    )


def backfill_tag_groups(plan: DataFrame) -> DataFrame:
    """Records per set of missing tags."""
    return (
        plan.filter(F.size("missing") > 0)
        .groupBy("mirror", tag_signature(F.col("missing")).alias("signature")).agg(F.count(F.lit(1)).alias("n"))
    )


def audit(keyed: DataFrame, dest: DataFrame, specs: DataFrame, facts: DataFrame) -> DataFrame:
    """For every source key: is it in the destination exactly once, in the wanted bucket, fully tagged?

    Copies with the same key, bucket and tags are counted together before the join, so a key with
    many copies stays one row.
    """
    wants, _ = split_rejected_tags(
        with_placement(first_per_key(keyed).select(*KEY, "n_records"), facts, specs), specs
    )
    held = (
        scan_buckets(dest.select(*KEY, "folder", "tags"), specs)
        .groupBy(*KEY, "folder", F.array_sort(F.coalesce("tags", no_strings())).alias("present"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    checked = wants.join(held, KEY, "left").withColumns({
        "_placed": F.col("folder") == F.col("wanted"),
        "_lacking": F.size(missing_keywords(F.col("tags"), F.col("present"))),
    })
    summed = checked.groupBy(*KEY).agg(
        F.max("wanted").alias("wanted"),
        F.max("n_records").alias("n_records"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("copies"),
        F.min("_placed").alias("_placed"),
        F.max("_lacking").alias("_lacking"),
    )
    status = (
        F.when(F.col("copies") == 0, "missing")
        .when(F.col("copies") > 1, "duplicated")
        .when(~F.col("_placed"), "misplaced")
        .when(F.col("_lacking") > 0, "untagged")
        .otherwise("ok")
    )
    return summed.withColumn("status", status).drop("_placed", "_lacking")


def audit_report(audited: DataFrame) -> DataFrame:
    """Audit results counted per mirror, wanted bucket and status."""
    return audited.groupBy("mirror", "wanted", "status").agg(
        F.count(F.lit(1)).alias("n_keys"), F.sum("copies").alias("n_copies")
    )
