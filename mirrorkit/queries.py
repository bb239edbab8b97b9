"""Registered queries: every operator over the whole test tables.

Arrays leave as joined text, so results compare the same way in any engine.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mirrorkit import fixtures as fx
from mirrorkit.functions.headers import parse_headers
from mirrorkit.functions.keys import content_key, is_real_key, with_key
from mirrorkit.functions.settings import meta_long, meta_status, rule_fingerprint, uid_window
from mirrorkit.functions.tags import keyword, keyword_slug, keywords, missing_keywords, safe_flags
from mirrorkit.operators import bands, changes, dedup, membership, repair, report, routing
from mirrorkit.plans.bucketed import diff_snapshots, plan_bucketed, write_bucketed, write_snapshot
from mirrorkit.plans.ingest import epoch_reset, ingest_plan
from mirrorkit.plans.membership import sync_bands, sync_membership, watch_state
from mirrorkit.plans.propagate import propagate_plan
from mirrorkit.plans.reconcile import Source, drain_queue, reconcile, reconcile_until_done
from mirrorkit.session import configure, stored, work_dir
from mirrorkit.sources import tables
from mirrorkit.sources.state import StateStore
from mirrorkit.spec import specs_frame
from mirrorkit.streaming.arrivals import dedup_within, read_arrivals, start_ingest
from mirrorkit.streaming.bodies import start_bodies
from mirrorkit.streaming.members import last_events, present_members, start_feed, start_members, start_transitions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a query under its name; a trailing underscore only avoids a clash with an operator."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__.rstrip("_")] = run
    return fn


def joined(c: Column | str) -> Column:
    return F.array_join(c, ",")


# Scans and projections


def _marks(spark, sf):
    """Scan state as of the half: per folder the highest uid seen, in epoch 1."""
    return fx.before(fx.messages(spark, sf), fx.HALF).groupBy("mirror", "folder").agg(
        F.lit(1).cast("long").alias("epoch"), F.max("uid").alias("last_uid")
    )


@query
def scan_uid_range(spark, sf):
    rows = tables.scan_above_mark(fx.messages(spark, sf), _marks(spark, sf))
    return rows.select("mirror", "folder", "epoch", "uid", "message_id", "size")


def _lake(spark, sf) -> str:
    """The records as ``write_messages`` lays them out."""
    path = f"{work_dir(spark, 'lake')}/messages"
    tables.write_messages(fx.messages(spark, sf).drop("value"), path)
    return path


@query
def scan_messages(spark, sf):
    """Range scans of a laid-out table: a whole mirror, one from a uid on, one up to a uid, one between two."""
    path = _lake(spark, sf)
    n = fx.table(spark, sf, "events").count()
    asked = (("m0", None, None), ("m1", n // 3, None), ("m2", None, n // 2), ("m3", n // 4, n // 2))
    scans = [tables.scan_messages(spark, path, mirror, lo=lo, hi=hi) for mirror, lo, hi in asked]
    return functools.reduce(DataFrame.unionByName, scans).select("mirror", "folder", "epoch", "uid", "message_id", "size")


@query
def sorted_files(spark, sf):
    """Per folder: records, and those that lie in their file behind one with a greater uid."""
    rows = spark.read.parquet(_lake(spark, sf)).select(
        "mirror", "folder", "uid", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")
    )
    before = F.max("uid").over(Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("behind", F.coalesce(before > F.col("uid"), F.lit(False)).cast("long")).groupBy("mirror", "folder").agg(
        F.count(F.lit(1)).alias("n"), F.sum("behind").alias("n_behind")
    )


@query
def snapshot_uids(spark, sf):
    return tables.snapshot_uids(fx.messages(spark, sf))


@query
def parse_headers_(spark, sf):
    return parse_headers(fx.raw_mail(spark, sf)).select(
        "conv_id", "turn", "message_id", "sender", "subject", "size"
    )


def _first(spark, sf):
    return dedup.first_per_key(fx.keyed(spark, sf))


def _first_records(spark, sf):
    return dedup.first_record_per_key(fx.keyed(spark, sf).withColumn("folder", F.lit("All")))


@query
def attach_bodies(spark, sf):
    plan = dedup.ledger_antijoin(_first_records(spark, sf), fx.ledger(spark, sf))
    return tables.attach_bodies(plan, fx.bodies(spark, sf)).select("mirror", "uid", "key", "raw")


@query
def missing_bodies(spark, sf):
    return tables.missing_bodies(_first_records(spark, sf), fx.bodies(spark, sf))


@query
def resolve_folders(spark, sf):
    roles = ("\\All", "\\Sent", "\\Trash", "\\Junk")
    wanted = fx.specs(spark).select("mirror", F.explode(F.array(*[F.lit(r) for r in (*roles, "view")])).alias("role"))
    return routing.resolve_folder(fx.folders(spark, sf), wanted, "role", strict=False).select(
        "mirror", "role", F.coalesce("role_name", F.lit("unresolved")).alias("folder")
    )


@query
def folder_status(spark, sf):
    return tables.folder_status(fx.messages(spark, sf))


@query
def dest_bucket_scan(spark, sf):
    return tables.scan_buckets(fx.copies(spark, sf), fx.specs(spark)).select(
        "mirror", "copy_id", "key", "folder", F.col("bucket_rank").cast("long").alias("bucket_rank")
    )


# Keys, flags and tags


@query
def dedup_key(spark, sf):
    return fx.keyed(spark, sf).select("mirror", "uid", "key", "is_synth")


@query
def document_keys(spark, sf):
    """Content keys of records without any id: exact copies of a document share one."""
    docs = fx.table(spark, sf, "documents")
    key = content_key(F.lit(""), F.lit(0).cast("long"), F.col("source"), F.col("text"), F.col("n_chars"))
    return docs.withColumn("key", key).groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_records")
    )


@query
def real_vs_synth(spark, sf):
    return fx.keyed(spark, sf).groupBy("mirror", is_real_key(F.col("key")).alias("is_real")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def safe_flags_(spark, sf):
    rules = fx.specs(spark).select("mirror", "carry_seen")
    kept = safe_flags(F.col("flags"), F.col("carry_seen"))
    return fx.messages(spark, sf).join(rules, "mirror").select("mirror", "uid", joined(kept).alias("flags"))


@query
def keyword_slug_(spark, sf):
    return fx.label_names(spark, sf).select(
        "p_partkey", "label",
        keyword_slug(F.col("label"), F.lit("_")).alias("underscore"),
        keyword_slug(F.col("label"), F.lit("-")).alias("dash"),
    )


@query
def keyword_prefix(spark, sf):
    """Whole texts as labels: those with no usable character give no tag."""
    tag = keyword(F.col("text"), F.lit("$label:"), F.lit("-"))
    return fx.table(spark, sf, "documents").select("doc_id", tag.alias("tag"))


@query
def label_keywords(spark, sf):
    labels = F.array("label", F.upper("label"), "p_type", F.lit("..."), F.concat(F.lit("["), "p_type", F.lit("]")))
    tags = keywords(labels, F.lit("$label:"), F.lit("_"))
    return fx.label_names(spark, sf).select("p_partkey", joined(tags).alias("tags"))


@query
def label_folders(spark, sf):
    return routing.label_folders(fx.folders(spark, sf), fx.specs(spark)).select(
        "mirror", "folder", joined("attrs").alias("attrs"), "list_pos"
    )


@query
def labels_of_key(spark, sf):
    return routing.labels_of_key(fx.members(spark, sf), fx.specs(spark)).select(
        "mirror", "key", joined("labels").alias("labels")
    )


@query
def missing_keywords_(spark, sf):
    facts = stored(routing.key_facts(fx.members_new(spark, sf), fx.specs(spark)), "facts")
    rows = fx.copies(spark, sf).withColumnRenamed("tags", "present")
    wants = routing.with_placement(rows, facts, fx.specs(spark))
    return wants.select(
        "mirror", "copy_id", joined(missing_keywords(F.col("tags"), F.col("present"))).alias("missing")
    )


@query
def mirrors_needing_backfill(spark, sf):
    days = fx.messages(spark, sf).select("mirror", F.dayofmonth("internal_date").cast("long").alias("batch_id"))
    stored = days.distinct().join(
        specs_frame(spark, fx.OLD_SPECS).select("mirror", rule_fingerprint().alias("fingerprint")), "mirror"
    )
    due = repair.mirrors_needing_backfill(fx.specs(spark), stored)
    return fx.copies(spark, sf).join(due, "mirror").groupBy("mirror").agg(F.count(F.lit(1)).alias("n_records"))


@query
def uid_windows(spark, sf):
    rows = fx.messages(spark, sf).join(fx.specs(spark).select("mirror", "uid_batch"), "mirror")
    return rows.groupBy("mirror", uid_window(F.col("uid"), F.lit(1), F.col("uid_batch")).alias("window")).agg(
        F.count(F.lit(1)).alias("n"), F.min("uid").alias("lo"), F.max("uid").alias("hi")
    )


@query
def meta_typed(spark, sf):
    """Stored settings, one per record: a number, nothing, or text that is not a number."""
    value = (
        F.when(F.col("event_type") == "view", F.regexp_extract("props", "([0-9]+)", 1))
        .when(F.col("event_type") == "click", "")
        .when(F.col("event_type") == "signup", F.concat(F.lit("99999"), F.col("event_id").cast("string")))
        .otherwise(F.col("props"))
    )
    return fx.table(spark, sf, "events").select(
        "event_id", meta_status(value).alias("status"), meta_long(value).alias("number")
    )


# Joins


@query
def ledger_antijoin(spark, sf):
    return dedup.ledger_antijoin(_first(spark, sf), fx.ledger(spark, sf)).select("mirror", "key", "uid", "n_records")


@query
def dest_guard(spark, sf):
    fresh = dedup.ledger_antijoin(_first(spark, sf), fx.ledger(spark, sf))
    return dedup.dest_guard(fresh, fx.dest_keys(spark, sf), fx.specs(spark)).select("mirror", "key", "uid", "in_dest")


@query
def route_bucket(spark, sf):
    keys = _first(spark, sf).select("mirror", "key")
    return routing.route_bucket(keys, fx.members_new(spark, sf), fx.specs(spark))


@query
def folders_of_key(spark, sf):
    return routing.folders_of_key(fx.members(spark, sf)).select("mirror", "key", joined("folders").alias("folders"))


def _uid_changes(spark, sf):
    old = fx.members_old(spark, sf)
    current = fx.members_new(spark, sf)
    marks = old.groupBy("mirror", "folder").agg(F.max("uid").alias("last_uid"))
    fresh = current.join(marks, ["mirror", "folder"], "left").filter(
        F.col("uid") > F.coalesce("last_uid", F.lit(0))
    ).drop("last_uid")
    return membership.diff_by_uid(old, current.select("mirror", "folder", "uid"), fresh)


@query
def membership_diff_uid(spark, sf):
    return _uid_changes(spark, sf).select("mirror", "folder", "key", "uid", "op")


@query
def membership_diff_key(spark, sf):
    return membership.diff_by_key(fx.members_old(spark, sf), fx.members_new(spark, sf)).select(
        "mirror", "folder", "key", "uid", "op"
    )


@query
def bucketed_diff(spark, sf):
    """The same difference between two snapshots of a table bucketed by key: nothing is shuffled."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = write_snapshot(fx.members_old(spark, sf), 1, buckets)
    write_snapshot(fx.members_new(spark, sf), 2, buckets, table)
    return diff_snapshots(spark, table, 1, 2).select("mirror", "folder", "key", "uid", "op")


@query
def membership_removed(spark, sf):
    now = fx.members_new(spark, sf).select("mirror", "folder", "uid")
    return membership.removed_uids(fx.members_old(spark, sf), now).select("mirror", "folder", "uid", "key")


@query
def watch_list(spark, sf):
    return routing.watch_list(fx.folders(spark, sf), fx.specs(spark)).select(
        "mirror", "folder", F.coalesce("kind", F.lit("none")).alias("kind")
    )


def _ops(spark, sf):
    old, new = fx.members_old(spark, sf), fx.members_new(spark, sf)
    diff = membership.with_first_scan(membership.diff_by_key(old, new).filter(F.col("op") != "same"), old)
    watch = routing.watch_list(fx.folders(spark, sf), fx.specs(spark))
    return membership.gate_ops(diff, watch, _copied(spark, sf))


def _copied(spark, sf):
    """Ledger at the time of the diff: everything copied up to the old snapshot."""
    return fx.before(fx.keyed(spark, sf), fx.OLD_END).select("mirror", "key").distinct()


@query
def gate_ops(spark, sf):
    return _ops(spark, sf).select("mirror", "kind", "key", "folder", "op", "uid")


def _placements(spark, sf):
    return tables.scan_buckets(fx.copies(spark, sf), fx.specs(spark))


@query
def locate_copies(spark, sf):
    facts = routing.key_facts(fx.members_new(spark, sf), fx.specs(spark))
    found = changes.locate_copies(_ops(spark, sf), _placements(spark, sf), fx.specs(spark), facts)
    return found.select("mirror", "key", "wanted", F.coalesce("found", F.lit("")).alias("found"), "status")


# Aggregations


@query
def ledger_count(spark, sf):
    return report.ledger_count(dedup.ledger_upsert(fx.ledger(spark, sf), fx.dated(fx.keyed(spark, sf))))


def _plan(spark, sf):
    return ingest_plan(
        fx.keyed(spark, sf), fx.ledger(spark, sf), fx.dest_keys(spark, sf), fx.members_new(spark, sf), fx.specs(spark)
    )


@query
def ingest_plan_(spark, sf):
    return _plan(spark, sf).select("mirror", "key", "uid", "n_records", "status", "wanted", joined("tags").alias("tags"))


@query
def bucketed_ingest_plan(spark, sf):
    """The same plan over tables bucketed by key: only candidates are shuffled."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = [write_bucketed(rows, buckets) for rows in (fx.ledger(spark, sf), fx.dest_keys(spark, sf), fx.members_new(spark, sf))]
    plan = plan_bucketed(fx.keyed(spark, sf), *[spark.table(name) for name in held], fx.specs(spark), buckets)
    return plan.select("mirror", "key", "uid", "n_records", "status", "wanted", joined("tags").alias("tags"))


@query
def run_summary(spark, sf):
    return report.run_summary(_plan(spark, sf))


@query
def tags_per_key(spark, sf):
    return routing.tags_per_key(fx.members(spark, sf), fx.specs(spark)).select(
        "mirror", "key", joined("tags").alias("tags")
    )


@query
def seed_keys(spark, sf):
    return dedup.seed_keys(_placements(spark, sf), fx.ledger(spark, sf)).select("mirror", "key", "n_records", "is_synth")


@query
def seed_counts(spark, sf):
    """Records scanned and distinct keys per mirror."""
    return _placements(spark, sf).groupBy("mirror", "key").agg(F.count(F.lit(1)).alias("n")).groupBy("mirror").agg(
        F.sum("n").alias("n_scanned"), F.count(F.lit(1)).alias("n_keys")
    )


@query
def stale_mirrors(spark, sf):
    """Sign-ups play the progress marks; the newest record of all gives the time of the check."""
    rows = fx.messages(spark, sf).withColumn("heartbeat", F.unix_seconds(F.col("internal_date").cast("timestamp")))
    now = rows.agg(F.max("heartbeat").alias("now"))
    beats = rows.filter(F.col("folder") == "signup").groupBy("mirror").agg(F.max("heartbeat").alias("heartbeat"))
    return report.stale_mirrors(beats.select("mirror", "heartbeat"), fx.specs(spark), now.scalar())


@query
def first_per_key(spark, sf):
    return _first(spark, sf)


@query
def latest_member_uid(spark, sf):
    return membership.latest_member_uid(fx.keyed(spark, sf)).select("mirror", "folder", "key", "uid")


@query
def net_member_change(spark, sf):
    return membership.net_member_change(fx.change_log(spark, sf))


@query
def op_sequence(spark, sf):
    return membership.sequence_ops(_ops(spark, sf)).select("mirror", "seq", "kind", "key", "folder", "op")


@query
def oldest_ops(spark, sf):
    """Head of the queue, one page of it."""
    rows = fx.queue(spark, sf).select("mirror", "batch_id", "seq", "kind", "key", "folder", "op")
    return changes.oldest_ops(rows, 200)


@query
def key_collisions(spark, sf):
    return dedup.key_collisions(fx.keyed(spark, sf))


# State tables


@query
def ledger_upsert(spark, sf):
    return dedup.ledger_upsert(fx.ledger(spark, sf), fx.dated(fx.keyed(spark, sf)))


@query
def members_next(spark, sf):
    stored = membership.latest_member_uid(fx.members_old(spark, sf))
    return membership.members_next(stored, fx.since(fx.change_log(spark, sf), fx.NEW_START))


@query
def queue_remaining(spark, sf):
    rows = fx.queue(spark, sf)
    applied = rows.filter(F.col("value") >= 10).select("mirror", F.col("batch_id").alias("op_batch"), "seq")
    return changes.queue_remaining(rows, applied).select("mirror", "batch_id", "seq", "kind", "key", "folder", "op")


@query
def folder_state_next(spark, sf):
    """Marks from the even uids; the odd ones are scanned next, in one mirror under other folder names."""
    rows = fx.messages(spark, sf)
    stored = rows.filter("uid % 2 = 0").groupBy("mirror", "folder").agg(
        F.lit(1).cast("long").alias("epoch"), F.max("uid").alias("last_uid")
    )
    name = F.when(F.col("mirror") == "m3", F.concat(F.lit("[Mail]/"), "folder")).otherwise(F.col("folder"))
    scanned = rows.filter("uid % 2 = 1").withColumn("folder", name).groupBy("mirror", "folder").agg(
        F.max("epoch").alias("epoch"), F.max("uid").alias("last_uid")
    )
    return membership.folder_state_next(stored, scanned)


@query
def upgrade_labels(spark, sf):
    old = fx.keyed(spark, sf).select("mirror", "key", F.col("folder").alias("label"), "is_synth")
    return membership.upgrade_labels(old).select("mirror", "folder", "key", "uid")


# Changes to copied records


@query
def apply_moves(spark, sf):
    facts = routing.key_facts(fx.members_new(spark, sf), fx.specs(spark))
    return changes.apply_moves(_ops(spark, sf), _placements(spark, sf), fx.specs(spark), facts)


def _tag_ops(spark, sf):
    return fx.queue(spark, sf).filter(F.col("kind") == "keyword")


@query
def apply_tag_deltas(spark, sf):
    facts = routing.key_facts(fx.members_new(spark, sf), fx.specs(spark))
    return changes.apply_tag_deltas(_tag_ops(spark, sf), _placements(spark, sf), fx.specs(spark), facts)


@query
def tag_rejects(spark, sf):
    tagged = routing.tags_per_key(fx.members(spark, sf), fx.specs(spark))
    kept, refused = changes.split_rejected_tags(tagged, fx.specs(spark))
    return kept.select("mirror", "key", F.lit("kept").alias("outcome"), joined("tags").alias("tags")).unionByName(
        refused.select("mirror", "key", F.lit("refused").alias("outcome"), F.col("tag").alias("tags"))
    )


@query
def dest_current(spark, sf):
    """Copies with a log that moves and tags them by the membership events of their key."""
    rows = fx.copies(spark, sf)
    log = fx.queue(spark, sf).join(rows.select("mirror", "key", "copy_id"), ["mirror", "key"])
    moves = log.filter(F.col("kind") == "move").select(
        "mirror", "copy_id", "batch_id", "seq",
        F.when(F.col("op") == "add", "Mirror").otherwise("Archive").alias("folder"),
    )
    tags = log.filter(F.col("kind") == "keyword").select(
        "mirror", "copy_id", "batch_id", "seq", F.col("folder").alias("tag"), "op"
    )
    return changes.dest_current(rows, moves, tags).select(
        "mirror", "copy_id", "key", "folder", joined(F.array_sort("tags")).alias("tags")
    )


# Repair and audit


def _repair(spark, sf):
    facts = stored(routing.key_facts(fx.members_new(spark, sf), fx.specs(spark)), "facts")
    return repair.backfill_plan(_placements(spark, sf), fx.specs(spark), facts)


@query
def backfill_plan(spark, sf):
    return _repair(spark, sf).select(
        "mirror", "copy_id", "key", "folder", "wanted", joined("missing").alias("missing"), "needs"
    )


@query
def backfill_moves(spark, sf):
    return repair.backfill_moves(_repair(spark, sf))


@query
def backfill_tags(spark, sf):
    return repair.backfill_tag_rows(_repair(spark, sf)).select("mirror", "copy_id", "tag", "op")


@query
def backfill_tag_groups(spark, sf):
    groups = repair.backfill_tag_groups(_repair(spark, sf))
    return groups.withColumn("signature", F.replace("signature", F.lit("\u0000"), F.lit("|")))


def _audited(spark, sf):
    facts = routing.key_facts(fx.members_new(spark, sf), fx.specs(spark))
    return repair.audit(fx.keyed(spark, sf), fx.copies(spark, sf), fx.specs(spark), facts)


@query
def audit_keys(spark, sf):
    return _audited(spark, sf).select("mirror", "key", "wanted", "n_records", "copies", "status")


@query
def audit_report(spark, sf):
    return repair.audit_report(_audited(spark, sf))


# Passes


@query
def epoch_reset_(spark, sf):
    """Source marks from an earlier epoch for one mirror and none at all for another."""
    rows = fx.messages(spark, sf).withColumn("folder", F.lit("All"))
    seen = fx.before(rows, fx.HALF).filter(F.col("mirror") != "m3")
    marks = seen.groupBy("mirror").agg(F.lit(1).cast("long").alias("epoch"), F.max("uid").alias("last_uid"))
    return epoch_reset(rows, fx.specs(spark), tables.current_epoch(rows), marks)


@query
def multi_mirror(spark, sf):
    """The same ids in every mirror: each keeps its own ledger, so one mirror's copy hides nothing elsewhere."""
    rows = fx.messages(spark, sf)
    shared = F.concat(F.lit("<"), "sender", F.lit("."), F.col("size").cast("string"), F.lit("@shared>"))
    keyed = with_key(rows.withColumn("message_id", shared).withColumn("sender", F.lit("any")))
    known = fx.before(keyed, fx.LEDGER_END).filter(F.col("mirror") == "m0").select("mirror", "key").distinct()
    plan = dedup.flag_known(dedup.first_per_key(keyed), known, "in_ledger")
    return plan.groupBy("mirror", "in_ledger").agg(
        F.count(F.lit(1)).alias("n_keys"), F.sum("n_records").alias("n_records")
    )


@query
def membership_ops(spark, sf):
    """A whole membership pass: folders of one mirror changed epoch, those of the others did not."""
    rows = fx.since(fx.messages(spark, sf), fx.NEW_START)
    stored = fx.members_old(spark, sf)
    state = fx.before(fx.messages(spark, sf), fx.OLD_END).groupBy("mirror", "folder").agg(
        F.lit(1).cast("long").alias("epoch"), F.max("uid").alias("last_uid")
    )
    watch = routing.watch_list(fx.folders(spark, sf), fx.specs(spark))
    folders = watch_state(watch, tables.current_epoch(rows), state)
    change = sync_membership(rows, stored, folders, watch, fx.specs(spark))
    ops = membership.gate_ops(change.changes, change.kinds, _copied(spark, sf))
    return membership.sequence_ops(ops).select("mirror", "seq", "kind", "key", "folder", "op")


# Narrow bands, so the small test tables have many.
NARROW_BAND = 400


def _band_pass(spark, sf):
    """Digests of the older records, and the pass that meets the newer ones: bands between have not changed."""
    before = fx.before(fx.messages(spark, sf), fx.OLD_END)
    marks = before.groupBy("mirror", "folder", "epoch").agg(F.max("uid").alias("last_uid"))
    return before, marks, fx.since(fx.messages(spark, sf), fx.NEW_START)


@query
def membership_changed_bands(spark, sf):
    before, _, now = _band_pass(spark, sf)
    return bands.changed_bands(bands.band_digests(now, NARROW_BAND), bands.band_digests(before, NARROW_BAND))


@query
def membership_band_diff(spark, sf):
    """The changes of a membership pass that reads changed bands only; they are those of the full comparison."""
    before, marks, now = _band_pass(spark, sf)
    members = stored(fx.members_old(spark, sf), "members")
    folders = watch_state(marks.select("mirror", "folder"), tables.current_epoch(now), marks)
    change = sync_bands(
        now, lambda cut: cut(members), folders, stored(bands.band_digests(before, NARROW_BAND), "digests"),
        marks.select("mirror", "folder", F.lit("keyword").alias("kind")), fx.specs(spark), band_uids=NARROW_BAND,
    )
    return change.changes.select("mirror", "folder", "key", "uid", "op")


@query
def propagate_plan_(spark, sf):
    ops = fx.queue(spark, sf)
    return propagate_plan(ops, _placements(spark, sf), fx.members_new(spark, sf), fx.specs(spark))


@query
def propagate_prefix(spark, sf):
    """What two pages of a long queue leave queued; the operations before them are applied and confirmed."""
    state = StateStore(spark, work_dir(spark, "state"))
    held = state.begin()
    queue = fx.queue(spark, sf)
    held.write("pending_ops", queue.withColumn("seq", F.col("batch_id") * 10**9 + F.col("seq")))
    held.write("member_log", fx.members_new(spark, sf).withColumn("op", F.lit("add")))
    held.commit()
    foreign = fx.foreign(spark, sf)
    source = Source(fx.mailbox(spark, sf), fx.bodies(spark, sf), fx.listing(spark, sf), foreign=foreign)
    page = queue.count() // 12
    drain_queue(spark, fx.SPECS, source, state, page, pages=2)
    return state.pending().select("mirror", "seq", "kind", "key", "folder", "op")


@query
def reconcile_pass(spark, sf):
    """Destination after two whole passes: the first sees the older records, by the second new ones
    arrived and old ones left their folders."""
    state = StateStore(spark, work_dir(spark, "state"))
    box, listing = fx.mailbox(spark, sf), fx.listing(spark, sf)
    here = (F.col("folder") == "All") | (F.col("internal_date") >= fx.day(fx.NEW_START))
    bodies = fx.arrivals(spark, sf).select(*tables.RECORD, "raw")
    for now, rows in enumerate((fx.before(box, fx.OLD_END), box.filter(here)), start=1):
        reconcile(spark, fx.SPECS, Source(rows, bodies, listing), state, now)
    return _copied_bodies(state).select(
        "mirror", "key", "uid", "sender", "size", "folder", joined(F.array_sort("tags")).alias("tags"),
        joined("flags").alias("flags"), "raw",
    )


def _copied_bodies(state):
    """The destination with the bodies of its copies."""
    raw = state.read("dest_messages").select("mirror", "copy_id", "raw")
    return state.dest().join(raw, ["mirror", "copy_id"])


@query
def reconcile_missing_bodies(spark, sf):
    """Two passes over the same records: in the first some bodies are empty, in the second all are there.

    A key is copied from its first record with a body; a key without any is copied by the second pass.
    """
    state = StateStore(spark, work_dir(spark, "state"))
    box = fx.mailbox(spark, sf).filter("folder = 'All'")
    for now, bodies in enumerate((fx.bodies(spark, sf), fx.arrivals(spark, sf)), start=1):
        reconcile(spark, fx.SPECS, Source(box, bodies.select(*tables.RECORD, "raw"), fx.listing(spark, sf)), state, now)
    return _copied_bodies(state).select("mirror", "key", "uid", "raw")


@query
def reconcile_windows(spark, sf):
    """A first run in windows of each mirror's ``uid_batch``, over banded tables, resumed after its first window."""
    state, lake = StateStore(spark, work_dir(spark, "state")), work_dir(spark, "lake")
    box = fx.mailbox(spark, sf).filter("folder = 'All'")
    tables.write_messages(box, f"{lake}/messages")
    tables.write_bodies(fx.bodies(spark, sf), f"{lake}/bodies")
    source = Source(spark.read.parquet(f"{lake}/messages"), spark.read.parquet(f"{lake}/bodies"), fx.listing(spark, sf))
    wide = [dataclasses.replace(s, uid_batch=s.uid_batch * fx.table(spark, sf, "events").count() // 2000) for s in fx.SPECS]
    reconcile(spark, wide, source, state, 1, max_uids=F.col("uid_batch"))
    reconcile_until_done(spark, wide, source, state, 2)
    return _copied_bodies(state).select("mirror", "key", "raw")


@query
def seed_modes(spark, sf):
    """Where the ledger rows of one pass come from: each mirror takes over destination keys by its own mode."""
    state = StateStore(spark, work_dir(spark, "state"))
    known = state.begin()
    ledger = fx.ledger(spark, sf).filter("mirror <> 'm0'")
    known.write("ledger", ledger.withColumns({"is_synth": F.lit(False), "source": F.lit("known")}))
    known.commit()
    modes = dict(zip(("m0", "m1", "m2", "m3"), ("empty", "empty", "always", "never"), strict=True))
    specs = [dataclasses.replace(s, seed=modes[s.mirror]) for s in fx.SPECS]
    box = fx.mailbox(spark, sf).filter("folder = 'All'")
    bodies = fx.arrivals(spark, sf).select(*tables.RECORD, "raw")
    reconcile(spark, specs, Source(box, bodies, fx.listing(spark, sf), foreign=fx.foreign(spark, sf)), state, 1)
    return state.read("ledger").select("mirror", "key", "source")


@query
def change_summary(spark, sf):
    """The counters of a pass that tell what happened to records copied before."""
    facts = routing.key_facts(fx.members_new(spark, sf), fx.specs(spark))
    held = _placements(spark, sf)
    moves = report.move_counts(changes.apply_moves(_ops(spark, sf), held, fx.specs(spark), facts), fx.specs(spark))
    tags = changes.apply_tag_deltas(_tag_ops(spark, sf), held, fx.specs(spark), facts)
    tagged = tags.select("mirror", "copy_id").distinct().groupBy("mirror").agg(F.count(F.lit(1)).alias("tags_updated"))
    counted = fx.specs(spark).select("mirror").join(moves, "mirror", "left").join(tagged, "mirror", "left")
    return counted.na.fill(0)


# Streams


def _daily(rows: DataFrame) -> DataFrame:
    """The rows as a stream over daily files, ten files per batch."""
    spark = rows.sparkSession
    path = fx.daily_files(rows, work_dir(spark, "arrivals"))
    return read_arrivals(spark, path, rows.schema, max_files=10)


def _drain(started) -> None:
    started.awaitTermination()


@query
def stream_equals_batch(spark, sf):
    """Keys copied by a stream in several batches: those of one batch over the whole table."""
    state = StateStore(spark, work_dir(spark, "state"))
    _drain(start_ingest(
        _daily(fx.arrivals(spark, sf)), list(fx.SPECS), state, work_dir(spark, "checkpoint"), name="all", once=True
    ))
    return state.read("ledger").select("mirror", "key", "is_synth", "source")


@query
def stream_multi_folder(spark, sf):
    """Arrivals of all folders and of an epoch before, in one batch, with the source named by its role."""
    state = StateStore(spark, work_dir(spark, "state"))
    main = fx.arrivals(spark, sf)
    others = fx.beside(spark, sf)
    before = main.withColumns({"epoch": F.col("epoch") + 5, "uid": F.col("uid") % 11 + 1, "raw": F.lit("before")})
    rows = main.unionByName(others).unionByName(before)
    path = fx.daily_files(rows, work_dir(spark, "arrivals"))
    specs = [dataclasses.replace(s, source_folder="\\All") for s in fx.SPECS]
    listing = fx.listing(spark, sf).filter("folder not like '[Mail]/%'")
    _drain(start_ingest(
        read_arrivals(spark, path, rows.schema), specs, state, work_dir(spark, "checkpoint"), name="folders", once=True,
        folders=listing, status=tables.current_epoch(main),
    ))
    return _copied_bodies(state).select("mirror", "key", "uid", "sender", "raw")


@query
def stream_dedup(spark, sf):
    """A stream against a ledger and a destination that already hold some of the keys."""
    state = StateStore(spark, work_dir(spark, "state"))
    known = state.begin()
    known.write("ledger", fx.ledger(spark, sf).withColumns({"is_synth": F.lit(False), "source": F.lit("seed")}))
    known.commit()
    foreign = fx.foreign(spark, sf)
    _drain(start_ingest(
        _daily(fx.arrivals(spark, sf)), list(fx.SPECS), state, work_dir(spark, "checkpoint"), name="dedup",
        foreign=foreign, once=True,
    ))
    return state.read("ledger").filter(F.col("source") != "seed").select("mirror", "key", "source")


def _events(spark, sf):
    return fx.change_log(spark, sf).drop("value")


@query
def stream_members(spark, sf):
    """Members by Spark's own keyed state, read back from the change feed."""
    feed = work_dir(spark, "feed")
    _drain(start_feed(_daily(_events(spark, sf)), feed, work_dir(spark, "checkpoint")))
    return present_members(spark.read.parquet(feed))


@query
def stream_members_log(spark, sf):
    """The same members without state, by a log of last events."""
    log = work_dir(spark, "log")
    _drain(start_members(_daily(_events(spark, sf)), log, work_dir(spark, "checkpoint")))
    return present_members(spark.read.parquet(log))


@query
def stream_transitions(spark, sf):
    """What two batches changed after a snapshot: the first repeats events of the snapshot, the second those of the first."""
    events = _events(spark, sf)
    inbox, feed, checkpoint = work_dir(spark, "arrivals"), work_dir(spark, "feed"), work_dir(spark, "checkpoint")
    known = stored(last_events(fx.before(events, fx.NEW_START)), "snapshot")
    for part, rows in enumerate((fx.before(events, fx.HALF), events)):
        rows.write.parquet(f"{inbox}/part{part}")
        _drain(start_transitions(read_arrivals(spark, inbox, events.schema), feed, checkpoint, known))
    return spark.read.parquet(feed).select(
        "mirror", "folder", "key", "seq", "was_present", "present", "was_uid", "uid", F.col("epoch").cast("long").alias("batch"),
    )


@query
def stream_late_bodies(spark, sf):
    """Records and their bodies as two streams: bodies come an hour or a day later, three days later, or never."""
    records = fx.arrivals(spark, sf).withColumn("internal_date", F.col("internal_date").cast("timestamp"))
    hours = F.when(F.col("uid") % 4 == 0, 1).when(F.col("uid") % 4 == 1, 24).when(F.col("uid") % 4 == 2, 72)
    arrived = F.timestamp_add("HOUR", hours, F.col("internal_date"))
    late = records.filter(hours.isNotNull()).select(*tables.RECORD, "raw", arrived.alias("arrived_at"))
    records = records.drop("raw")
    boxes = work_dir(spark, "records"), work_dir(spark, "bodies")
    out, checkpoint = work_dir(spark, "joined"), work_dir(spark, "checkpoint")
    half, end = (F.lit(day).cast("timestamp") for day in (fx.HALF, fx.CLOSING))
    for part in range(3):
        for rows, when, box in ((records, "internal_date", boxes[0]), (late, "arrived_at", boxes[1])):
            if part < 2:
                rows = rows.filter(F.col(when) < half if part == 0 else F.col(when) >= half)
            else:
                # Sources that send nothing more tell the time, so what still waits can leave.
                rows = rows.groupBy().agg(*[F.max(c).alias(c) for c in rows.columns]).withColumns({"mirror": F.lit(""), when: end})
            rows.select(*(records if when == "internal_date" else late).columns).write.parquet(f"{box}/part{part}")
        _drain(start_bodies(
            read_arrivals(spark, boxes[0], records.schema), read_arrivals(spark, boxes[1], late.schema),
            out, checkpoint, "2 days",
        ))
    joined_rows = spark.read.parquet(out).filter("mirror <> ''")
    return joined_rows.select("mirror", "uid", F.coalesce("raw", F.lit("missing")).alias("raw"))


@query
def stream_dedup_within(spark, sf):
    """Bounded deduplication: a key seen again five or ten days later is dropped, fifteen days later it passes."""
    first = F.to_date(F.lit(fx.FIRST_DAY))
    period = F.floor(F.datediff(F.to_date("internal_date"), first) / 5).cast("int")
    polled = F.date_add(first, period * 5).cast("timestamp")
    rows = fx.messages(spark, sf).drop("value").withColumns({"internal_date": polled, "size": F.lit(0).cast("long"), "period": period})
    rows = stored(rows.withColumns({"sender": F.lit(""), "subject": F.lit("")}), "polled")
    inbox, out, checkpoint = work_dir(spark, "arrivals"), work_dir(spark, "kept"), work_dir(spark, "checkpoint")
    for n in range(7):
        rows.filter(F.col("period") == n).write.parquet(f"{inbox}/part{n}")
        kept = dedup_within(read_arrivals(spark, inbox, rows.schema), "5 days")
        writer = kept.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        _drain(writer.trigger(availableNow=True).start(out))
    return spark.read.parquet(out).select("mirror", "key", F.col("period").cast("long").alias("period"))


@query
def stream_epoch_change(spark, sf):
    """A source folder gets a new epoch between two batches of a running stream.

    All its records have new uids then, and only the newest of them arrive; the stream finds the others.
    One mirror keeps its epoch, so of its records only the arrivals are copied.
    """
    state = StateStore(spark, work_dir(spark, "state"))
    main = fx.arrivals(spark, sf)
    new = F.col("mirror") != "m3"
    again = main.withColumns({
        "epoch": F.when(new, F.col("epoch") + 5).otherwise(F.col("epoch")),
        "uid": F.when(new, F.col("uid") + 7).otherwise(F.col("uid")),
        "raw": F.when(new, F.concat(F.lit("again "), "raw")).otherwise(F.col("raw")),
    })
    inbox, checkpoint = work_dir(spark, "arrivals"), work_dir(spark, "checkpoint")
    held = [fx.before(main, fx.HALF)]
    for part, arrived in enumerate((held[0], fx.since(again, fx.LATE_START))):
        arrived.write.parquet(f"{inbox}/part{part}")
        _drain(start_ingest(
            read_arrivals(spark, inbox, main.schema), list(fx.SPECS), state, checkpoint, name="epochs", once=True,
            bodies=lambda: held[-1].select(*tables.RECORD, "raw"), messages=lambda: held[-1].drop("raw"),
            status=lambda: tables.current_epoch(held[-1]),
        ))
        held.append(again)
    return _copied_bodies(state).select("mirror", "key", "uid", "raw")
