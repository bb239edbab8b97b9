"""One whole pass over all mirrors: members, repair, copy, propagate, commit."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorkit.functions.keys import is_real_key, with_key
from mirrorkit.functions.settings import rule_fingerprint
from mirrorkit.functions.tags import safe_flags, tag_allowed
from mirrorkit.operators.changes import queue_prefix
from mirrorkit.operators.dedup import among, first_record_per_key, seed_keys
from mirrorkit.operators.membership import folder_state_next, gate_ops, sequence_ops, upgrade_labels
from mirrorkit.operators.repair import (
    backfill_move_rows,
    backfill_plan,
    backfill_tag_rows,
    mirrors_needing_backfill,
)
from mirrorkit.operators.report import move_counts, run_summary
from mirrorkit.operators.routing import key_facts, resolve_specs, watch_list
from mirrorkit.plans.ingest import plan_candidates, source_spans
from mirrorkit.plans.membership import sync_bands, watch_state
from mirrorkit.plans.propagate import propagate
from mirrorkit.schemas import STATE_TABLES
from mirrorkit.session import stored
from mirrorkit.sources.state import CURRENT_TABLES, Attempt, StateStore
from mirrorkit.sources.tables import RECORD, attach_bodies, current_epoch, scan_buckets, with_body, within_spans
from mirrorkit.spec import MirrorSpec, specs_frame

# Order of log rows within one batch: repair first, queued operations on top of it.
REPAIR_SEQ, OPS_SEQ = 0, 1


@dataclass(frozen=True)
class Source:
    """Tables a pass reads. ``status`` (mirror, folder, epoch, uid_next) is derived when not given;
    ``foreign`` are destination records this toolkit did not write."""

    messages: DataFrame
    bodies: DataFrame
    folders: DataFrame
    status: DataFrame | None = None
    foreign: DataFrame | None = None


def reconcile(
    spark: SparkSession, specs: Iterable[MirrorSpec], source: Source, state: StateStore, now: int,
    batch_id: int | None = None, full: bool = False, apply_ops: bool = True, max_uids: int | Column | None = None,
    members_snapshot: bool = False, compact_every: int | None = None, clock: Callable[[], float] = time.time,
) -> DataFrame:
    """Run one pass and return its ``run_log`` rows.

    Running it again is free of effect: a committed ``batch_id`` is not repeated, and a pass without
    changes writes empty batches. ``apply_ops=False`` leaves operations queued. ``members_snapshot``
    rewrites the member log as one snapshot, which bounds what later passes fold; ``compact_every``
    folds all logs and clears what is left of old batches after so many of them. Destination keys
    are taken over first, by each mirror's ``seed`` mode. Each phase leaves a row in ``phase_log``.
    """
    if batch_id is not None and state.is_committed(batch_id):
        return state.read_batch("run_log", batch_id)
    if full and max_uids is not None:
        raise ValueError("a full scan cannot be cut into windows: give full or max_uids, not both")
    spec_list = list(specs)
    attempt = state.begin(batch_id)
    phases = _Phases(clock)
    rules = attempt.scratch("specs", resolve_specs(specs_frame(spark, spec_list), source.folders))
    marks = state.read_batch("mirror_state", attempt.last)
    status = attempt.scratch("status", source.status if source.status is not None else current_epoch(source.messages))
    seeds = _seed_phase(attempt, rules, source)
    phases.done("seed", seeds)

    members = _members_phase(attempt, spec_list, rules, source, status, seeds, members_snapshot)
    phases.done("members", attempt.written("member_log"))
    repair = _repair_phase(attempt, rules, source, members, marks)
    phases.done("repair")
    spans = attempt.scratch("spans", source_spans(rules, status, marks, full, max_uids))
    plan = _copy_phase(attempt, spec_list, rules, source, members, status, spans, seeds, now)
    phases.done("copy", attempt.written("dest_messages"))
    moves, tags, applied = _propagate_phase(attempt, rules, source, members, repair, apply_ops)
    phases.done("propagate", applied)

    _write_mirror_state(attempt, rules, spans, marks, now)
    log = attempt.write("run_log", pass_log(attempt, rules, spans, plan, moves, tags, applied))
    phases.done("log")
    attempt.write("phase_log", phases.rows(spark))
    attempt.commit(members_base=attempt.batch_id if members_snapshot else None)
    if compact_every is not None and attempt.batch_id - attempt.logs >= compact_every:
        state.compact()
        state.vacuum()
    return log


class _Phases:
    """Seconds and rows of each phase of a pass, a handful of rows in all."""

    def __init__(self, clock: Callable[[], float]):
        self._clock, self._since, self._rows = clock, clock(), []

    def done(self, phase: str, rows: DataFrame | None = None) -> None:
        now = self._clock()
        self._rows.append((phase, int(now - self._since), 0 if rows is None else rows.count()))
        self._since = now

    def rows(self, spark: SparkSession) -> DataFrame:
        listed = ", ".join(f"('{phase}', {seconds}L, {n}L)" for phase, seconds, n in self._rows)
        return spark.sql(f"select * from values {listed} as t(phase, seconds, n_rows)")


def _seed_phase(attempt: Attempt, rules: DataFrame, source: Source) -> DataFrame:
    """Ledger rows for destination keys of other origin, for mirrors whose ``seed`` mode asks for it."""
    state = attempt.store
    empty = attempt.written("ledger").drop("batch_id")
    if source.foreign is None:
        return empty
    ledger = state.read("ledger")
    due = attempt.scratch("seed_due", _seeding(rules, ledger).select("mirror"))
    if due.isEmpty():
        return empty
    held = scan_buckets(with_dest_key(source.foreign), rules.join(due, "mirror", "left_semi"))
    return attempt.scratch("seeds", _seed_rows(held, ledger))


def _seeding(rules: DataFrame, ledger: DataFrame) -> DataFrame:
    filled = ledger.select("mirror").distinct()
    return rules.filter(F.col("seed") == "always").unionByName(
        rules.filter(F.col("seed") == "empty").join(filled, "mirror", "left_anti")
    )


def _seed_rows(held: DataFrame, ledger: DataFrame) -> DataFrame:
    return seed_keys(held.select("mirror", "key", "is_synth"), ledger).select(
        "mirror", "key", "is_synth", F.lit(0).cast("long").alias("uid"),
        F.lit(0).cast("long").alias("copied_at"), F.lit("seed").alias("source"),
    )


# Members as of this pass, all of them or those of some keys only.
MembersOf = Callable[[DataFrame | None], DataFrame]


def _members_phase(attempt: Attempt, spec_list, rules, source: Source, status, seeds, snapshot: bool) -> MembersOf:
    """Member rows, scan state and new operations. Operations are gated by the ledger as it was
    before this pass copies anything, so new records cause none."""
    state = attempt.store
    watch = attempt.scratch("watch", watch_list(source.folders, rules))
    before = state.read_batch("folder_state", attempt.last)
    folders = attempt.scratch("folders", watch_state(watch, status, before))
    bands = state.read_batch("folder_bands", attempt.last)
    change = sync_bands(
        source.messages, lambda cut: state.members(cut=cut), folders, bands, watch, rules, spec_list, attempt.scratch,
    )
    attempt.write("folder_state", folder_state_next(before, change.scanned))
    attempt.write("folder_bands", change.bands)
    changes = attempt.scratch("changes", change.changes)
    kinds = attempt.scratch("kinds", change.kinds)
    known = state.read("ledger", changes).select("mirror", "key").unionByName(seeds.select("mirror", "key"))
    ops = attempt.scratch("ops", gate_ops(changes, kinds, known, asked=changes))
    if not ops.isEmpty():
        attempt.write("pending_ops", sequence_ops(ops))
    rows = attempt.scratch("member_rows", change.rows)
    if not snapshot:
        # Without a change nothing is written: no file, and no row.
        log = attempt.written("member_log") if rows.isEmpty() else attempt.write("member_log", rows)
        return lambda keys: state.members(log, keys)
    rows = rows.withColumn("batch_id", F.lit(attempt.batch_id).cast("long"))
    # As the new base this batch holds every present row; earlier batches are not read again.
    present = state.members(rows).withColumn("op", F.lit("add"))
    written = attempt.write("member_log", present).drop("batch_id", "op")
    return lambda keys: among(written, keys)


def _repair_phase(attempt: Attempt, rules, source: Source, members: MembersOf, marks) -> tuple[DataFrame, DataFrame]:
    """Moves and tags for mirrors whose rules changed. With no such mirror nothing is scanned."""
    state = attempt.store
    stored = marks.select("mirror", "batch_id", "fingerprint").filter(F.col("fingerprint").isNotNull())
    due = attempt.scratch("due", mirrors_needing_backfill(rules, stored))
    if due.isEmpty():
        return attempt.written("placement_log"), attempt.written("tag_log")
    due_rules = rules.join(due.select("mirror"), "mirror", "left_semi")
    held = scan_buckets(state.dest(source.foreign), due_rules)
    managed = due_rules.select("mirror", "managed_only")
    held = held.join(managed, "mirror").filter(F.col("managed") | ~F.col("managed_only"))
    placements = held.select("mirror", "key", "copy_id", "folder", "tags", "bucket_rank")
    # As a written table the facts are shuffled on their own, which lets adaptive execution split
    # the copies of a hot key; joined straight from their aggregation they would not.
    facts = attempt.scratch("facts", key_facts(members(None), due_rules))
    plan = attempt.scratch("repair", backfill_plan(placements, due_rules, facts))
    stamp = _stamp(attempt, REPAIR_SEQ, "repair")
    return backfill_move_rows(plan).withColumns(stamp), backfill_tag_rows(plan).withColumns(stamp)


def _stamp(attempt: Attempt, seq: int, reason: str) -> dict[str, Column]:
    return {
        "seq": F.lit(seq).cast("long"), "reason": F.lit(reason), "batch_id": F.lit(attempt.batch_id).cast("long"),
    }


def _copy_phase(
    attempt: Attempt, spec_list, rules, source: Source, members: MembersOf, status, spans, seeds, now: int
) -> DataFrame:
    """Copy the records of the source folders that are above their marks, and those an earlier pass
    found without a body."""
    candidates = within_spans(source.messages, spans)
    waiting = attempt.store.read_batch("missing_bodies", attempt.last).select(*RECORD)
    if not waiting.isEmpty():
        inside = (F.col("uid") > F.col("_from")) & (F.col("uid") <= F.col("_to"))
        late = attempt.scratch("waiting", waiting.join(
            spans.select("mirror", "folder", "epoch", "_from", "_to"), ["mirror", "folder", "epoch"]
        ).filter(~inside).select(*RECORD))
        retry = source.messages.join(late, RECORD, "left_semi")
        candidates = candidates.unionByName(retry.select(*candidates.columns))
    # Read once: what a copy is described by goes along with its key.
    keyed = attempt.scratch("records", with_key(candidates, spec_list).select(*RECORD, "key", "is_synth", *DESCRIBED))
    return copy_records(attempt, rules, keyed, source.bodies, members, source.foreign, now, seeds)


DESCRIBED = ("sender", "subject", "internal_date", "size", "flags")


def copy_records(
    attempt: Attempt, rules: DataFrame, keyed: DataFrame, bodies: DataFrame, members: MembersOf,
    foreign: DataFrame | None, now: int, seeds: DataFrame | None = None, waiting: DataFrame | None = None,
) -> DataFrame:
    """Copy what neither the ledger nor the destination holds, and record it. Returns the plan.

    ``keyed`` are the candidates, written once, with ``RECORD``, key and description. Of records with
    one key the first that has a body is copied. Destination rows are written before ledger rows, and
    the ledger rows come from what was written; all records of a key without any body are listed in
    ``missing_bodies``, with the ``waiting`` ones of before, and stay candidates of later passes.
    """
    state = attempt.store
    first = attempt.scratch("candidates", first_record_per_key(keyed))
    n_keys = first.count()
    if n_keys >= state.large_batch:
        attempt.lay_out()
    dest_keys = scan_buckets(state.dest(foreign, keys=first), rules)
    ledger = state.read("ledger", first).select("mirror", "key")
    if seeds is not None:
        ledger = ledger.unionByName(among(seeds.select("mirror", "key"), first))
    planned = plan_candidates(first, ledger, dest_keys, members(first), rules)
    if not n_keys:
        if seeds is not None:
            attempt.write("ledger", seeds)
        if waiting is not None:
            attempt.write("missing_bodies", waiting)
        return planned.filter(F.lit(False))
    # Everything a copy needs is settled before the plan is written: from here on the small side of
    # each join is a written table whose size the optimizer knows, and the bodies, by far the
    # largest table, are met last and not shuffled while the accepted records can be broadcast.
    plan = attempt.scratch("plan", planned.join(rules.select("mirror", "carry_seen", "allowed_tags"), "mirror"))
    copies = plan.filter(F.col("status") == "copy")
    refused = F.filter("tags", lambda t: ~tag_allowed(t, F.col("allowed_tags")))
    attempt.write("rejected_tags", copies.select("mirror", "key", F.explode(refused).alias("tag")))
    accepted = attempt.scratch("accepted", _first_with_body(attempt, keyed, copies, bodies))
    described = attach_bodies(accepted, bodies)
    written = attempt.write("dest_messages", described.withColumns({
        "copy_id": F.concat(F.lit(f"{attempt.batch_id}-"), F.col("uid").cast("string")),
        "folder": F.col("wanted"),
        "flags": safe_flags(F.col("flags"), F.col("carry_seen")),
        "tags": F.filter("tags", lambda t: tag_allowed(t, F.col("allowed_tags"))),
    })).select("mirror", "key", "is_synth", "uid")
    lacking = copies.join(written.select("mirror", "key"), ["mirror", "key"], "left_anti").select("mirror", "key")
    missing = keyed.select(*RECORD, "key").join(lacking, ["mirror", "key"], "left_semi")
    if waiting is not None:
        missing = missing.unionByName(waiting.select(*RECORD, "key").join(missing, RECORD, "left_anti"))
    attempt.write("missing_bodies", missing)
    guarded = plan.filter(F.col("status") == "in_dest").select("mirror", "key", "is_synth", "uid")
    records = written.withColumn("source", F.lit("copy")).unionByName(guarded.withColumn("source", F.lit("guard")))
    records = records.withColumn("copied_at", F.lit(now).cast("long"))
    attempt.write("ledger", records if seeds is None else records.unionByName(seeds.select(*records.columns)))
    return plan


def _first_with_body(attempt: Attempt, keyed: DataFrame, copies: DataFrame, bodies: DataFrame) -> DataFrame:
    """The record to copy for each key of ``copies``, with its description.

    A key with one record has no choice. Only where several share a key are their bodies looked up.
    """
    rest = [c for c in copies.columns if c == "mirror" or c not in RECORD]
    records = keyed.select(*RECORD, "key", F.col("internal_date").cast("timestamp").alias("internal_date"), *[
        c for c in DESCRIBED if c != "internal_date"
    ])
    single = records.join(copies.filter("n_records = 1").select(*rest), ["mirror", "key"])
    several = copies.filter("n_records > 1")
    if several.isEmpty():
        return single
    choices = attempt.scratch("choices", records.join(several.select("mirror", "key"), ["mirror", "key"], "left_semi"))
    chosen = F.min(F.struct("uid", "epoch", "folder")).alias("r")
    best = attempt.scratch("chosen", with_body(choices, bodies).groupBy("mirror", "key").agg(chosen).select(
        "mirror", "key", "r.folder", "r.epoch", "r.uid"
    ))
    found = choices.join(best, [*RECORD, "key"], "left_semi").join(several.select(*rest), ["mirror", "key"])
    return single.unionByName(found.select(*single.columns))


def _propagate_phase(
    attempt: Attempt, rules, source: Source, members: MembersOf, repair, apply_ops: bool, page: int | None = None,
):
    """Apply the queued operations, those of this pass included, on top of the repair: all of them, or the
    first ``page`` of each mirror."""
    state = attempt.store
    moves, tags = repair
    if apply_ops:
        queue = state.pending().unionByName(attempt.written("pending_ops"))
        live = attempt.scratch("live", queue if page is None else queue_prefix(attempt.scratch("queue", queue), page))
        if not live.isEmpty():
            held = state.dest(source.foreign, live.select("mirror", "key").distinct(), moves, tags)
            placements = scan_buckets(held, rules).select("mirror", "key", "copy_id", "folder", "tags", "bucket_rank")
            found_moves, found_tags = propagate(live, attempt.scratch("placements", placements), members(live), rules)
            stamp = _stamp(attempt, OPS_SEQ, "membership")
            moves = moves.unionByName(found_moves.withColumns(stamp))
            tags = tags.unionByName(found_tags.withColumns(stamp))
            attempt.write("applied_ops", live.select(
                "mirror", F.col("batch_id").alias("op_batch"), "seq", F.lit("applied").alias("status")
            ))
    return attempt.write("placement_log", moves), attempt.write("tag_log", tags), attempt.written("applied_ops")


def _write_mirror_state(attempt: Attempt, rules, spans, marks, now: int) -> None:
    """Marks, fingerprints and heartbeats. The mark is written with everything it covers, or not at all."""
    stored = marks.select("mirror", F.col("epoch").alias("_epoch"), F.col("last_uid").alias("_last"))
    top = spans.select("mirror", "epoch", F.col("_to").alias("last_uid"))
    gone = marks.join(rules.select("mirror"), "mirror", "left_anti")
    rows = rules.join(top, "mirror", "left").join(stored, "mirror", "left").select(
        "mirror", F.coalesce("epoch", "_epoch").alias("epoch"), F.coalesce("last_uid", "_last").alias("last_uid"),
        rule_fingerprint().alias("fingerprint"), F.lit(now).cast("long").alias("heartbeat"),
    )
    attempt.write("mirror_state", rows.unionByName(gone.select(*rows.columns)))


def pass_log(attempt: Attempt, rules, spans, plan, moves, tags, applied) -> DataFrame:
    """Counters of the pass, one row per mirror."""

    def count(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("mirror").agg(F.count(F.lit(1)).alias(name))

    retagged = tags.select("mirror", "copy_id").distinct()
    summary = run_summary(plan).drop("copied", "skipped_dup", "tags_set")
    landed = attempt.written("dest_messages").groupBy("mirror").agg(
        F.count(F.lit(1)).alias("copied"), F.count(F.when(F.size("tags") > 0, 1)).alias("tags_set")
    )
    known = plan.groupBy("mirror").agg(
        F.sum(F.col("n_records") - F.when(F.col("status") == "copy", 1).otherwise(0)).alias("skipped_dup")
    )
    row = rules.select("mirror").join(spans.select("mirror", "epoch_changed"), "mirror", "left")
    for part in (
        summary, landed, known, move_counts(moves, rules), count(retagged, "tags_updated"),
        count(applied, "ops_applied"), count(attempt.written("missing_bodies"), "missing_bodies"),
        count(attempt.written("rejected_tags"), "rejected_tags"),
    ):
        row = row.join(part, "mirror", "left")
    counters = [c for c in STATE_TABLES["run_log"].names if c not in ("mirror", "epoch_changed")]
    return row.select(
        "mirror", F.coalesce("epoch_changed", F.lit(False)).alias("epoch_changed"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counters],
    )


def reconcile_until_done(
    spark, specs, source: Source, state: StateStore, now: int, max_uids: int | None = None
) -> int:
    """Bounded batches until no mirror has records above its mark; each batch commits on its own.

    This is the resumable first run: a crash costs at most one batch. A batch takes ``max_uids`` per
    mirror, by default each mirror's own ``uid_batch``. Returns the batches run.
    """
    window = F.col("uid_batch") if max_uids is None else max_uids
    spec_list, ran = list(specs), 0
    while True:
        reconcile(spark, spec_list, source, state, now, max_uids=window)
        ran += 1
        last, _ = state.last()
        rules = resolve_specs(specs_frame(spark, spec_list), source.folders)
        status = source.status if source.status is not None else current_epoch(source.messages)
        spans = source_spans(rules, status, state.read_batch("mirror_state", last))
        if spans.filter(F.col("_to") > F.col("_from")).isEmpty():
            return ran


def drain_queue(
    spark: SparkSession, specs: Iterable[MirrorSpec], source: Source, state: StateStore, page: int, pages: int | None = None,
) -> int:
    """Apply the queue in pages of ``page`` operations per mirror, each a batch of its own; returns the pages applied.

    What a page confirmed stays confirmed: a crash in page k leaves the pages before it applied and the rest
    queued. ``pages`` bounds how many are taken. A long queue is left by a pass with ``apply_ops=False``.
    """
    spec_list, done = list(specs), 0
    while pages is None or done < pages:
        if state.pending().isEmpty():
            break
        attempt = state.begin()
        rules = attempt.scratch("specs", resolve_specs(specs_frame(spark, spec_list), source.folders))
        none = attempt.written("placement_log"), attempt.written("tag_log")
        _propagate_phase(attempt, rules, source, lambda keys: state.members(keys=keys), none, True, page)
        attempt.carry(*CURRENT_TABLES)
        attempt.commit()
        done += 1
    return done


def seed(spark: SparkSession, specs: Iterable[MirrorSpec], dest: DataFrame, state: StateStore) -> DataFrame:
    """Record every key the destination already holds, as its own batch.

    ``seed='empty'`` does so for mirrors with an empty ledger, ``'always'`` for every pass,
    ``'never'`` not at all. A pass does the same by itself for the foreign records it is given. Gives
    per mirror the records scanned and the keys inserted.
    """
    rules = specs_frame(spark, specs)
    ledger = state.read("ledger")
    attempt = state.begin()
    wanted = attempt.scratch("wanted", _seeding(rules, ledger))
    held = scan_buckets(with_dest_key(dest), wanted).select("mirror", "key", "is_synth")
    scanned = stored(held.groupBy("mirror").agg(F.count(F.lit(1)).alias("n_scanned")), "seed-scanned")
    rows = attempt.write("ledger", _seed_rows(held, ledger))
    attempt.carry(*CURRENT_TABLES)
    attempt.commit()
    return scanned.join(rows.groupBy("mirror").agg(F.count(F.lit(1)).alias("n_keys")), "mirror", "left").select(
        "mirror", "n_scanned", F.coalesce("n_keys", F.lit(0)).alias("n_keys")
    )


def with_dest_key(dest: DataFrame) -> DataFrame:
    """Destination records with a key; records scanned as plain messages get theirs derived."""
    return dest if "key" in dest.columns else with_key(dest)


def upgrade(
    state: StateStore, copied: DataFrame, meta: DataFrame, labels: DataFrame
) -> None:
    """Take over an older state: ``copied(mirror, key, uid, copied_at)``, ``meta(mirror, epoch, last_uid)``
    and ``labels(mirror, key, label)``.

    The ledger and marks stay. Labels become members with placeholder uids, and no folder scan state
    is carried, so the next pass scans every folder in full and compares by key.
    """
    last, _ = state.last()
    if last:
        raise ValueError("the state root already holds batches")
    attempt = state.begin()
    synth = ~is_real_key(F.col("key"))
    attempt.write("ledger", copied.withColumns({"is_synth": synth, "source": F.lit("copy")}))
    rows = upgrade_labels(labels.withColumn("is_synth", synth))
    attempt.write("member_log", rows.withColumn("op", F.lit("add")))
    attempt.write("mirror_state", meta.select(
        "mirror", "epoch", "last_uid", F.lit(None).cast("string").alias("fingerprint"),
        F.lit(None).cast("long").alias("heartbeat"),
    ))
    attempt.commit()


def record_changes(state: StateStore, placement: DataFrame | None = None, tags: DataFrame | None = None) -> None:
    """Record what others did to copies, as a batch of its own: ``placement(mirror, copy_id, key,
    from_folder, folder)`` and ``tags(mirror, copy_id, key, tag, op)``."""
    attempt = state.begin()
    stamp = {"seq": F.lit(OPS_SEQ).cast("long"), "reason": F.lit("foreign")}
    if placement is not None:
        attempt.write("placement_log", placement.withColumns(stamp))
    if tags is not None:
        attempt.write("tag_log", tags.withColumns(stamp))
    attempt.carry(*CURRENT_TABLES)
    attempt.commit()
