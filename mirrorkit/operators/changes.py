"""Changes to copied records: locating copies, moving them, tagging them, and their current view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorkit.functions.tags import keyword, no_strings, tag_allowed
from mirrorkit.operators.dedup import KEY
from mirrorkit.operators.routing import with_placement
from mirrorkit.operators.sequence import number_rows
from mirrorkit.sources.tables import BUCKET_COLUMNS, BUCKET_RANKS, bucket_name, bucket_rank

OP_ID = ["mirror", "batch_id", "seq"]


def queue_remaining(pending: DataFrame, applied: DataFrame) -> DataFrame:
    """Operations not yet confirmed. ``applied`` names them by ``mirror, op_batch, seq``."""
    done = applied.select("mirror", F.col("op_batch").alias("batch_id"), "seq")
    return pending.join(done, OP_ID, "left_anti")


def queue_prefix(pending: DataFrame, n: int) -> DataFrame:
    """The first ``n`` operations of each mirror's queue, by batch and number.

    Ranks come from row counts of range partitions, so no mirror's queue has to fit one task.
    """
    ranked = number_rows(pending.withColumnRenamed("seq", "_seq"), ["mirror"], ["batch_id", "_seq"])
    return ranked.filter(F.col("seq") <= n).drop("seq").withColumnRenamed("_seq", "seq").select(*pending.columns)


def oldest_ops(pending: DataFrame, n: int) -> DataFrame:
    """Preview of the queue's head."""
    return pending.orderBy("batch_id", "seq", "mirror").limit(n)


def bucket_presence(placements: DataFrame) -> DataFrame:
    """Per (mirror, key): which bucket ranks hold a copy. One row per key, however many copies there are."""
    return placements.groupBy(*KEY).agg(
        *[F.max(F.col("bucket_rank") == rank).alias(f"_in{rank}") for rank in BUCKET_RANKS]
    )


def first_rank(skip: Column | None = None) -> Column:
    """Lowest bucket rank that holds the key, leaving out the rank ``skip``; null when there is none."""
    found = F.lit(None).cast("int")
    for rank in reversed(BUCKET_RANKS):
        here = F.coalesce(F.col(f"_in{rank}"), F.lit(False))
        if skip is not None:
            here = here & (F.coalesce(skip, F.lit(0)) != rank)
        found = F.when(here, rank).otherwise(found)
    return found


def locate_copies(ops: DataFrame, placements: DataFrame, specs: DataFrame, facts: DataFrame) -> DataFrame:
    """Where every move operation's copy is found, and where it should be.

    The first bucket in lookup order counts, the wanted one left out. Keys found in no other bucket
    are consumed silently.
    """
    keys = ops.filter(F.col("kind") == "move").select(*KEY).distinct()
    wants = with_placement(keys, facts, specs).drop("tags")
    located = (
        wants.join(bucket_presence(placements), KEY, "left").join(specs.select(*BUCKET_COLUMNS), "mirror")
        .withColumn("found_rank", first_rank(skip=bucket_rank(F.col("wanted"))))
        .withColumn("found", bucket_name(F.col("found_rank")))
    )
    status = F.when(F.col("found_rank").isNull(), "not_found").otherwise("found")
    return located.select(*KEY, "wanted", "found_rank", "found", status.alias("status"))


def apply_moves(ops: DataFrame, placements: DataFrame, specs: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows for the placement log.

    The wanted bucket is recomputed from current membership, whatever the operation said. All
    copies of the key in the first other bucket that holds it move. Mirrors without routing drop
    their moves.
    """
    routed = specs.filter(F.col("archive_on") | F.col("sent_on")).select("mirror")
    located = locate_copies(ops.join(routed, "mirror", "left_semi"), placements, specs, facts)
    target = located.filter(F.col("found_rank").isNotNull()).select(
        *KEY, "wanted", F.col("found_rank").alias("bucket_rank")
    )
    return placements.join(target, [*KEY, "bucket_rank"]).select(
        *KEY, "copy_id", F.col("folder").alias("from_folder"), F.col("wanted").alias("folder")
    )


def tag_deltas(ops: DataFrame, specs: DataFrame, facts: DataFrame) -> DataFrame:
    """Net tag change per (mirror, key, tag).

    The last operation wins. Two labels may map to one tag, so a removal counts only when no
    remaining label still gives that tag. Tags the destination refuses are left out. ``ops``
    carries ``batch_id`` and ``seq``.
    """
    rules = specs.filter("propagate").select("mirror", "keyword_prefix", "keyword_replacement", "allowed_tags")
    tagged = (
        ops.filter(F.col("kind") == "keyword").join(rules, "mirror")
        .withColumn("tag", keyword(F.col("folder"), F.col("keyword_prefix"), F.col("keyword_replacement")))
        .filter(F.col("tag").isNotNull() & tag_allowed(F.col("tag"), F.col("allowed_tags")))
    )
    last = (
        tagged.groupBy(*KEY, "tag").agg(F.max(F.struct("batch_id", "seq", "op")).alias("o"))
        .select(*KEY, "tag", F.col("o.op").alias("op"))
    )
    still = F.exists("tags", lambda t: F.lower(t) == F.lower(F.col("tag")))
    return (
        with_placement(last, facts, specs)
        .filter((F.col("op") == "add") | ~still)
        .select(*KEY, "tag", "op")
    )


def apply_tag_deltas(ops: DataFrame, placements: DataFrame, specs: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows for the tag log: one tag added or removed on copies in the first bucket holding the key.

    Other tags stay as they are, and only real changes are written. Keys found in no bucket are
    consumed silently.
    """
    # Deltas fold to one row per key, so the copies meet a side that is unique on its join columns.
    deltas = tag_deltas(ops, specs, facts).groupBy(*KEY).agg(F.collect_list(F.struct("tag", "op")).alias("_deltas"))
    target = deltas.join(bucket_presence(placements), KEY).select(*KEY, first_rank().alias("bucket_rank"), "_deltas")
    copies = placements.join(target, [*KEY, "bucket_rank"]).select(
        *KEY, "copy_id", "tags", F.inline("_deltas")
    )
    has = F.exists(F.coalesce(F.col("tags"), no_strings()), lambda t: F.lower(t) == F.lower(F.col("tag")))
    changed = F.when(F.col("op") == "add", ~has).otherwise(has)
    return copies.filter(changed).select(*KEY, "copy_id", "tag", "op")


def split_rejected_tags(rows: DataFrame, specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags a destination refuses are dropped and reported; the record itself always stays.

    ``rows`` has ``mirror, key, tags``. Gives the rows with allowed tags and the refused tags.
    """
    rules = specs.select("mirror", F.col("allowed_tags").alias("_allowed"))
    judged = rows.join(rules, "mirror")

    allowed = F.col("_allowed")
    kept = judged.withColumn("tags", F.filter("tags", lambda t: tag_allowed(t, allowed)))
    refused = judged.select(
        "mirror", "key", F.explode(F.filter("tags", lambda t: ~tag_allowed(t, allowed))).alias("tag")
    )
    return kept.select(*rows.columns), refused


def dest_current(dest: DataFrame, placement_log: DataFrame, tag_log: DataFrame) -> DataFrame:
    """Destination as it stands: records are immutable, the logs say where each is and how it is tagged.

    The logs are folded to one row per copy first, so the record table meets each of them once.
    Log rows carry ``batch_id`` and ``seq``; tags compare without regard to case.
    """
    copy = ["mirror", "copy_id"]
    order = F.struct("batch_id", "seq")
    moved = placement_log.groupBy(*copy).agg(F.max(F.struct("batch_id", "seq", "folder")).alias("p")).select(
        *copy, F.col("p.folder").alias("_moved")
    )
    last = (
        tag_log.withColumn("_tag", F.lower("tag")).groupBy(*copy, "_tag")
        .agg(F.max(F.struct(order.alias("o"), "op", "tag")).alias("t"))
        .select(*copy, "_tag", F.col("t.op").alias("op"), F.col("t.tag").alias("tag"))
    )
    folded = last.groupBy(*copy).agg(
        F.array_sort(F.collect_list(F.when(F.col("op") == "add", F.col("tag")))).alias("_adds"),
        F.collect_list("_tag").alias("_touched"),
    )
    base = F.coalesce(F.col("tags"), no_strings())
    kept = F.filter(base, lambda t: ~F.array_contains(F.col("_touched"), F.lower(t)))
    tags = F.when(F.col("_touched").isNull(), base).otherwise(F.concat(kept, F.col("_adds")))
    return (
        dest.join(moved, copy, "left").join(folded, copy, "left")
        .withColumns({"folder": F.coalesce("_moved", "folder"), "tags": tags})
        .select(*dest.columns)
    )
