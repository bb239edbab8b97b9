from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from mirrorkit.operators import changes, dedup, membership, report, routing
from mirrorkit.operators.sequence import number_rows
from mirrorkit.plans.ingest import ingest_plan, source_candidates
from mirrorkit.spec import MirrorSpec, specs_frame
from mirrorkit.streaming.members import last_events

MEMBER = "mirror string, folder string, key string, is_synth boolean, uid long"


def members(spark, *rows):
    return spark.createDataFrame([("m", f, k, False, u) for f, k, u in rows], MEMBER)


def ops_of(df):
    return sorted((r["folder"], r["key"], r["op"]) for r in df.collect())


def test_same_epoch_diff(spark):
    old = members(spark, ("A", "gone", 1), ("A", "kept", 2), ("A", "twice", 3), ("A", "twice", 4), ("A", "back", 5),
                  ("A", "legacy", 0), ("B", "gone", 1))
    now = members(spark, ("A", "kept", 2), ("A", "twice", 3), ("A", "back", 9), ("A", "new", 10), ("B", "gone", 1))
    snapshot = now.select("mirror", "folder", "uid")
    got = ops_of(membership.diff_by_uid(old, snapshot, now.filter("uid > 5")))
    assert got == [("A", "back", "add"), ("A", "back", "remove"), ("A", "gone", "remove"), ("A", "new", "add")]
    removed = membership.removed_uids(old, snapshot).collect()
    assert sorted(r["uid"] for r in removed) == [1, 4, 5]


def test_key_diff_and_row_changes(spark):
    old = members(spark, ("A", "same", 1), ("A", "same", 2), ("A", "gone", 3))
    new = members(spark, ("A", "same", 41), ("A", "new", 42))
    got = {r["key"]: (r["op"], r["uid"]) for r in membership.diff_by_key(old, new).collect()}
    assert got == {"same": ("same", 41), "gone": ("remove", 3), "new": ("add", 42)}
    rows = sorted((r["key"], r["uid"], r["op"]) for r in membership.row_changes(old, new).collect())
    assert rows == [("gone", 3, "remove"), ("new", 42, "add"), ("same", 1, "remove"), ("same", 2, "remove"), ("same", 41, "add")]
    assert membership.row_changes(old, old).isEmpty()


def test_gate(spark):
    change = spark.createDataFrame([
        ("m", "Work", "ok", False, 1, "add", False), ("m", "Work", "synth", True, 2, "add", False),
        ("m", "Work", "uncopied", False, 3, "add", False), ("m", "Quiet", "ok", False, 4, "add", False),
        ("m", "Work", "first", False, 5, "add", True), ("m", "Work", "same", False, 6, "same", False),
    ], MEMBER + ", op string, first_scan boolean")
    watch = spark.createDataFrame([("m", "Work", "keyword"), ("m", "Quiet", None)], "mirror string, folder string, kind string")
    ledger = spark.createDataFrame([("m", k) for k in ("ok", "synth", "first", "same")] + [("other", "uncopied")],
                                   "mirror string, key string")
    for asked in (None, change):
        got = membership.gate_ops(change, watch, ledger, asked).collect()
        assert [(r["folder"], r["key"], r["kind"]) for r in got] == [("Work", "ok", "keyword")]


def test_order_inside_a_batch(spark):
    """The last change decides presence; every change stays in the queue."""
    rows = spark.createDataFrame([
        ("m", "Work", "a", 1, "add", 1), ("m", "Work", "b", 2, "add", 2), ("m", "Work", "a", 3, "remove", 1),
    ], "mirror string, folder string, key string, seq long, op string, uid long")
    stored = spark.createDataFrame([("m", "Work", "a", 7), ("m", "Work", "c", 8)],
                                   "mirror string, folder string, key string, uid long")
    net = {r["key"]: r["op"] for r in membership.net_member_change(rows).collect()}
    assert net == {"a": "remove", "b": "add"}
    assert sorted((r["key"], r["uid"]) for r in membership.members_next(stored, rows).collect()) == [("b", 2), ("c", 8)]
    assert {r["key"]: r["op"] for r in last_events(rows).collect()} == net


def test_ledger_upsert_keeps_the_first(spark):
    ledger = spark.createDataFrame([("m", "old", 1, 5)], "mirror string, key string, uid long, copied_at long")
    rows = spark.createDataFrame([("m", "old", 9, 9), ("m", "a", 1, 1), ("m", "a", 3, 3), ("n", "old", 2, 2)], ledger.schema)
    got = sorted(tuple(r) for r in dedup.ledger_upsert(ledger, rows).collect())
    assert got == [("m", "a", 1, 1), ("m", "old", 1, 5), ("n", "old", 2, 2)]


def test_numbering_against_a_plain_sort(spark):
    """One group holds most rows, and it is spread over many tasks."""
    rng = random.Random(7)
    rows = [(("hot" if rng.random() < 0.9 else f"g{rng.randrange(5)}"), rng.randrange(10**6), f"k{i}") for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, n long, k string")
    got = number_rows(df, ["g"], ["n", "k"]).withColumn("pid", F.spark_partition_id())
    want = {}
    for g in {r[0] for r in rows}:
        for i, (_, n, k) in enumerate(sorted(r for r in rows if r[0] == g), start=1):
            want[g, n, k] = i
    assert {(r["g"], r["n"], r["k"]): r["seq"] for r in got.collect()} == want


def test_first_per_key_is_exact_under_a_hot_key(spark):
    df = spark.range(100_000).select(
        F.lit("m").alias("mirror"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"),
        (F.col("id") + 1).alias("uid"), F.lit(False).alias("is_synth"),
    )
    row = dedup.first_per_key(df).filter("key = 'hot'").first()
    assert (row["uid"], row["n_records"]) == (1, 33_334)


def test_moves_and_tags_reach_every_copy_of_a_hot_key(spark):
    """A third of all copies share one key; each is moved, none is dropped."""
    held = spark.range(9_000).select(
        F.lit("m").alias("mirror"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"),
        F.col("id").cast("string").alias("copy_id"), F.lit("DEST").alias("folder"),
        F.array().cast("array<string>").alias("tags"), F.lit(1).alias("bucket_rank"),
    )
    spec = specs_frame(spark, [MirrorSpec("m", dest_folder="DEST", archive_on=True, labels_on=True, propagate=True)])
    ops = spark.createDataFrame([("m", 1, 1, "move", "hot", "INBOX", "remove"), ("m", 1, 2, "keyword", "hot", "Work", "add")],
                                "mirror string, batch_id long, seq long, kind string, key string, folder string, op string")
    facts = routing.key_facts(members(spark, ("Work", "hot", 1)), spec)
    moved = changes.apply_moves(ops, held, spec, facts)
    assert moved.count() == 3_000 and {r["folder"] for r in moved.select("folder").distinct().collect()} == {"Archive"}
    assert changes.apply_tag_deltas(ops, held, spec, facts).count() == 3_000


def test_bucket_order_decides_where_a_copy_is_looked_for(spark):
    spec = specs_frame(spark, [MirrorSpec("m", dest_folder="DEST", archive_on=True, sent_on=True, sent_source="S", sent_folder="SENT",
                                          archive_folder="ARCH")])
    held = spark.createDataFrame([
        ("m", "k", "1", "ARCH", [], 3), ("m", "k", "2", "SENT", [], 2), ("m", "k", "3", "SENT", [], 2), ("m", "only", "4", "ARCH", [], 3),
    ], "mirror string, key string, copy_id string, folder string, tags array<string>, bucket_rank int")
    ops = spark.createDataFrame([("m", 1, 1, "move", k, "INBOX", "add") for k in ("k", "only", "nowhere")],
                                "mirror string, batch_id long, seq long, kind string, key string, folder string, op string")
    facts = routing.key_facts(members(spark, ("INBOX", "k", 1)), spec)
    found = {r["key"]: (r["found"], r["wanted"], r["status"]) for r in changes.locate_copies(ops, held, spec, facts).collect()}
    assert found == {"k": ("SENT", "DEST", "found"), "only": (None, "ARCH", "not_found"), "nowhere": (None, "ARCH", "not_found")}
    assert sorted(r["copy_id"] for r in changes.apply_moves(ops, held, spec, facts).collect()) == ["2", "3"]


def test_unrouted_mirror_drops_moves(spark):
    spec = specs_frame(spark, [MirrorSpec("m", dest_folder="DEST")])
    held = spark.createDataFrame([("m", "k", "1", "ARCH", [], 3)],
                                 "mirror string, key string, copy_id string, folder string, tags array<string>, bucket_rank int")
    ops = spark.createDataFrame([("m", 1, 1, "move", "k", "INBOX", "add")],
                                "mirror string, batch_id long, seq long, kind string, key string, folder string, op string")
    facts = routing.key_facts(members(spark), spec)
    assert changes.apply_moves(ops, held, spec, facts).isEmpty()


def test_roles_labels_and_watch_list(spark):
    listing = spark.createDataFrame([
        ("m", "All", ["\\All"], 0), ("m", "inbox", [], 1), ("m", "Work", [], 2), ("m", "Gone", ["\\Noselect"], 3),
        ("m", "Junk", ["\\Junk"], 4), ("m", "Out", ["\\Sent"], 5), ("m", "Out2", ["\\Sent"], 6), ("m", "Skip", [], 7),
        ("m", "In", [], 8),
    ], "mirror string, folder string, attrs array<string>, list_pos long")
    spec = specs_frame(spark, [MirrorSpec("m", "\\All", "In", "DEST", sent_on=True, labels_on=True, label_exclude=("Skip",))])
    found = routing.resolve_specs(spec, listing)
    row = found.first()
    assert (row["source_folder"], row["sent_source"]) == ("All", "Out")
    assert sorted(r["folder"] for r in routing.label_folders(listing, found).collect()) == ["In", "Work"]
    watch = sorted((r["folder"], r["kind"] or "") for r in routing.watch_list(listing, found).collect())
    assert watch == [("In", "move"), ("Out", "move"), ("Work", "")]


def test_unresolved_role_fails(spark):
    listing = spark.createDataFrame([("m", "x", [], 0)], "mirror string, folder string, attrs array<string>, list_pos long")
    with pytest.raises(Exception, match="no folder carries"):
        routing.resolve_specs(specs_frame(spark, [MirrorSpec("m", "\\All")]), listing).collect()
    # Sent is looked up only where it is used.
    assert routing.resolve_specs(specs_frame(spark, [MirrorSpec("m", "x")]), listing).count() == 1


def test_current_view_folds_logs(spark):
    dest = spark.createDataFrame([("m", "1", "DEST", ["Work", "mine"]), ("m", "2", "DEST", None)],
                                 "mirror string, copy_id string, folder string, tags array<string>")
    moves = spark.createDataFrame([("m", "1", 1, 0, "A"), ("m", "1", 2, 1, "C"), ("m", "1", 2, 0, "B")],
                                  "mirror string, copy_id string, batch_id long, seq long, folder string")
    tags = spark.createDataFrame([("m", "1", 1, 0, "work", "remove"), ("m", "1", 2, 0, "new", "add"), ("m", "1", 3, 0, "NEW", "add"),
                                  ("m", "2", 1, 0, "x", "add"), ("m", "2", 1, 1, "x", "remove")],
                                 "mirror string, copy_id string, batch_id long, seq long, tag string, op string")
    got = {r["copy_id"]: (r["folder"], sorted(r["tags"])) for r in changes.dest_current(dest, moves, tags).collect()}
    assert got == {"1": ("C", ["NEW", "mine"]), "2": ("DEST", [])}


def test_stale_after_three_intervals(spark):
    spec = specs_frame(spark, [MirrorSpec(m, poll_seconds=10) for m in ("fresh", "edge", "old", "silent")])
    beats = spark.createDataFrame([("fresh", 99), ("fresh", 1), ("edge", 70), ("old", 69)], "mirror string, heartbeat long")
    got = {r["mirror"]: r["stale"] for r in report.stale_mirrors(beats, spec, 100).collect()}
    assert got == {"fresh": False, "edge": False, "old": True, "silent": True}


def test_ingest_plan_of_a_repeated_key(spark):
    keyed = spark.createDataFrame([("m", "k", 5, False), ("m", "k", 3, False), ("m", "s", 1, True), ("m", "l", 2, False),
                                   ("m", "d", 4, False)], "mirror string, key string, uid long, is_synth boolean")
    known = spark.createDataFrame([("m", "l"), ("n", "k")], "mirror string, key string")
    held = spark.createDataFrame([("m", "d"), ("m", "s"), ("m", "other")], "mirror string, key string")
    spec = specs_frame(spark, [MirrorSpec("m")])
    got = {r["key"]: (r["uid"], r["n_records"], r["status"]) for r in
           ingest_plan(keyed, known, held, members(spark, ("Work", "unrelated", 1)), spec).collect()}
    assert got == {"k": (3, 2, "copy"), "s": (1, 1, "copy"), "l": (2, 1, "in_ledger"), "d": (4, 1, "in_dest")}


def test_candidates_by_mark_epoch_and_bound(spark):
    rows = spark.createDataFrame([(m, "All", 2, uid) for m in ("same", "reset", "new") for uid in range(1, 11)],
                                 "mirror string, folder string, epoch long, uid long")
    status = spark.createDataFrame([(m, "All", 2, 11, 10) for m in ("same", "reset", "new")],
                                   "mirror string, folder string, epoch long, uid_next long, n long")
    marks = spark.createDataFrame([("same", 2, 7), ("reset", 1, 7)], "mirror string, epoch long, last_uid long")
    spec = specs_frame(spark, [MirrorSpec(m, "All") for m in ("same", "reset", "new")])

    def counts(**options):
        found = source_candidates(rows, spec, status, marks, **options).groupBy("mirror").count().collect()
        return {r["mirror"]: r["count"] for r in found}

    assert counts() == {"same": 3, "reset": 10, "new": 10}
    assert counts(max_uids=2) == {"same": 2, "reset": 2, "new": 2}
    assert counts(full=True) == {"same": 10, "reset": 10, "new": 10}
