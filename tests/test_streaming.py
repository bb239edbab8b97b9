from __future__ import annotations

import os
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mirrorkit.fixtures import daily_files
from mirrorkit.operators.membership import latest_member_uid
from mirrorkit.plans.reconcile import reconcile
from mirrorkit.schemas import columns
from mirrorkit.session import work_dir
from mirrorkit.sources.state import StateStore
from mirrorkit.spec import MirrorSpec
from mirrorkit.streaming.arrivals import dedup_within, ingest_batch, read_arrivals, start_ingest, with_trigger
from mirrorkit.streaming.bodies import start_bodies, with_late_bodies, without_body
from mirrorkit.streaming.members import present_members, start_feed, start_members, start_transitions
from mirrorkit.sources.tables import RECORD
from mirrorkit.streaming.progress import ProgressLog, observed, read_progress
from tests.world import MAIN, Folder, dest_rows, frame, msg, source, spec, with_msgs

BOX = {
    MAIN: Folder(tuple([*(msg(i, f"<m{i % 5}@x>") for i in range(1, 9)), msg(9, "", "no id"), msg(10, "", "no id")])),
    "Work": Folder((msg(1, "<m1@x>"), msg(9, "", "no id")), epoch=71),
}
RULES = {"labels_on": True, "propagate": True, "archive_on": True}


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def view(state):
    return sorted((r["mirror"], r["key"], r["folder"], tuple(r["tags"])) for r in dest_rows(state))


def test_stream_then_pass_equals_one_pass(spark, tmp_path):
    """Arrivals in several batches, replayed in part, then a snapshot pass: same destination as one pass."""
    specs = [spec("m", **RULES)]
    tables = source(spark, {"m": BOX})
    arrivals = tables.messages.filter(F.col("folder") == MAIN).join(tables.bodies, RECORD)
    path = str(tmp_path / "in")
    for lo in (1, 5):
        arrivals.filter(F.col("uid").between(lo, lo + 5)).coalesce(1).write.mode("append").parquet(path)
    state = StateStore(spark, str(tmp_path / "state"))
    stream = read_arrivals(spark, path, arrivals.schema, max_files=1)
    start_ingest(stream, specs, state, str(tmp_path / "ck"), once=True, clock=lambda: 5).awaitTermination()
    assert state.commits().count() == 2
    # The same epoch again is not a new batch.
    ingest_batch(spark, specs, arrivals, "ingest:0", state, tables.bodies, 9)
    assert state.commits().count() == 2
    keys = [r["key"] for r in state.read("ledger").collect()]
    assert len(keys) == len(set(keys)) == 7
    marks = state.read_batch("mirror_state", state.last()[0]).first()
    # A stream has not seen what lies below its arrivals, so the mark and the fingerprint are not its to move.
    assert (marks["epoch"], marks["last_uid"], marks["fingerprint"], marks["heartbeat"]) == (None, None, None, 5)

    log = reconcile(spark, [spec("m", **{**RULES, "keyword_prefix": "x"})], tables, state, 1).first()
    assert log["copied"] == 0
    # Memberships were unknown while streaming. Repair, due to the changed rules, now tags the copies.
    assert len(view(state)) == 7 and {f for _, _, f, _ in view(state)} == {"ARCHIVE"}
    tags = {k: t for _, k, _, t in view(state)}
    assert tags["<m1@x>"] == ("xwork",) and tags["<m2@x>"] == ()


def events(spark):
    rows = [("m", "Work", "a", 1, "add", 1), ("m", "Work", "a", 4, "remove", 1), ("m", "Work", "a", 6, "add", 9),
            ("m", "Work", "b", 2, "add", 2), ("m", "Work", "b", 5, "remove", 2), ("m", "Home", "b", 3, "add", 3),
            ("m", "Home", "c", 7, "remove", 4)]
    return spark.createDataFrame(rows, "mirror string, folder string, key string, seq long, op string, uid long")


def test_member_feeds_agree_whatever_the_file_order(spark, tmp_path):
    rows = events(spark)
    path = str(tmp_path / "in")
    for seqs in ([6, 2], [1, 5, 7], [3, 4]):
        rows.filter(F.col("seq").isin(seqs)).coalesce(1).write.mode("append").parquet(path)

    def stream():
        return read_arrivals(spark, path, rows.schema, max_files=1)

    feed, log = str(tmp_path / "feed"), str(tmp_path / "log")
    start_feed(stream(), feed, str(tmp_path / "ck1")).awaitTermination()
    start_members(stream(), log, str(tmp_path / "ck2")).awaitTermination()
    for path in (feed, log):
        members = present_members(spark.read.parquet(path))
        assert sorted((r["folder"], r["key"], r["uid"]) for r in members.collect()) == [("Home", "b", 3), ("Work", "a", 9)]
    assert latest_member_uid(rows.withColumn("is_synth", F.lit(False))).count() == 4


def test_bounded_dedup_and_progress(spark, tmp_path):
    schema = columns("mirror string, folder string, epoch long, uid long, message_id string, sender string, subject string, "
                     "internal_date timestamp, size long")
    base = datetime(2026, 1, 1, tzinfo=UTC)
    rows = [("m", "All", 1, i, f"<m{i % 3}@x>", "", "", base + timedelta(minutes=i), 1) for i in range(9)]
    path = str(tmp_path / "in")
    frame(spark, rows, schema).coalesce(1).write.parquet(path)
    log = ProgressLog(spark, str(tmp_path / "progress"))
    assert log.rows().isEmpty()
    spark.streams.addListener(log)
    try:
        stream = observed(read_arrivals(spark, path, schema), "arrivals", top=F.max("uid"))
        out = str(tmp_path / "out")
        writer = dedup_within(stream, "1 hour").writeStream.queryName("bounded").format("parquet")
        writer = writer.option("checkpointLocation", str(tmp_path / "ck"))
        with_trigger(writer, [MirrorSpec("m")], once=True).start(out).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(log)
    assert spark.read.parquet(out).count() == 3
    reports = [r for r in read_progress(spark, log.path).collect() if r["query"] == "bounded"]
    assert any('"n_rows": 9' in r["metrics"] and '"top": 8' in r["metrics"] for r in reports)


def streamed(spark, state, specs, mailbox, tag="s:0", **more):
    """One batch with the records of all folders, as a stream over all of them would bring it."""
    tables = source(spark, {"m": mailbox})
    batch = tables.messages.join(tables.bodies, RECORD)
    ingest_batch(spark, specs, batch, tag, state, tables.bodies, 1, **more)
    return {r["key"]: (r["uid"], r["raw"]) for r in state.read("dest_messages").collect()}


def test_a_stream_copies_source_folder_records_only(spark, tmp_path):
    """A key may lie under a smaller uid in another folder, where that uid is another record's in the main one."""
    box = {MAIN: Folder((msg(2, "<other@x>"), msg(5, "<k@x>"))), "Work": Folder((msg(2, "<k@x>", "wrong"),), epoch=900)}
    state = StateStore(spark, str(tmp_path / "state"))
    got = streamed(spark, state, [spec("m")], box)
    assert got == {"<other@x>": (2, "raw-<other@x>"), "<k@x>": (5, "raw-<k@x>")}
    log = state.read("run_log").first()
    assert (log["copied"], log["candidates"], log["missing_bodies"]) == (2, 2, 0)


def test_a_stream_finds_its_source_by_role_and_epoch(spark, tmp_path):
    """Two epochs share uids; the current one is told by the status table, and need not be the greater one."""
    specs = [spec("m", source_folder="\\All")]
    now, before = {MAIN: Folder((msg(1, "<a@x>"), msg(2, "<b@x>")), epoch=7, attrs=("\\All",))}, {
        MAIN: Folder((msg(1, "<b@x>", "old b"), msg(2, "<a@x>", "old a")), epoch=8, attrs=("\\All",))}
    tables, old = source(spark, {"m": now}), source(spark, {"m": before})
    batch = tables.messages.join(tables.bodies, RECORD).unionByName(old.messages.join(old.bodies, RECORD))
    state = StateStore(spark, str(tmp_path / "state"))
    with pytest.raises(ValueError, match="folder listing"):
        ingest_batch(spark, specs, batch, "s:0", state, batch, 1)
    ingest_batch(spark, specs, batch, "s:0", state, batch.select(*RECORD, "raw"), 1, folders=tables.folders, status=tables.status)
    assert {r["key"]: r["raw"] for r in state.read("dest_messages").collect()} == {"<a@x>": "raw-<a@x>", "<b@x>": "raw-<b@x>"}
    # Without a status table both epochs count, and a key is still copied once, with a body of its own.
    both = StateStore(spark, str(tmp_path / "both"))
    ingest_batch(spark, specs, batch, "s:0", both, batch.select(*RECORD, "raw"), 1, folders=tables.folders)
    rows = {r["key"]: r["raw"] for r in both.read("dest_messages").collect()}
    assert both.read("ledger").count() == 2 and rows["<a@x>"] == "raw-<a@x>" and rows["<b@x>"] == "old b"


def test_a_pass_after_a_stream_finds_what_the_stream_did_not_see(spark, tmp_path):
    whole = {MAIN: Folder(tuple(msg(i, f"<m{i}@x>") for i in range(1, 7)))}
    state = StateStore(spark, str(tmp_path / "state"))
    streamed(spark, state, [spec("m", archive_on=True)], {MAIN: Folder(whole[MAIN].msgs[4:])})
    foreign = [("m", "f1", "DEST", "<f@x>")]
    log = reconcile(spark, [spec("m", archive_on=True)], source(spark, {"m": whole}, foreign), state, 2).first()
    assert (log["copied"], log["skipped_dup"]) == (4, 2)
    # The stream has not repaired anything, so the pass still does.
    assert log["moved_to_archive"] == 1


def test_a_stream_without_a_body_counts_it_and_keeps_it(spark, tmp_path):
    state = StateStore(spark, str(tmp_path / "state"))
    streamed(spark, state, [spec("m")], {MAIN: Folder((msg(1, "<a@x>"), msg(2, "<b@x>", "")))})
    log = state.read("run_log").first()
    assert (log["copied"], log["missing_bodies"]) == (1, 1)
    streamed(spark, state, [spec("m")], {MAIN: Folder((msg(3, "<c@x>"),))}, tag="s:1")
    assert [r["key"] for r in state.read_batch("missing_bodies", 2).collect()] == ["<b@x>"]


def test_trigger_takes_the_shortest_interval():
    class Writer:
        def trigger(self, **how):
            self.how = how
            return self

    specs = [MirrorSpec("a", poll_seconds=100, idle_seconds=60), MirrorSpec("b")]
    assert with_trigger(Writer(), specs).how == {"processingTime": "60 seconds"}
    assert with_trigger(Writer(), specs, once=True).how == {"availableNow": True}


def test_work_dirs_are_fresh(spark):
    assert work_dir(spark, "x") != work_dir(spark, "x")
    assert work_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


EVENT_ROW = "mirror string, folder string, key string, seq long, op string, uid long"


def told(spark, path):
    rows = spark.read.parquet(path).collect()
    return sorted((r["epoch"], r["key"], r["seq"], r["was_present"], r["present"], r["was_uid"] or 0, r["uid"] or 0) for r in rows)


def test_daily_files_do_not_grow_with_the_tasks(spark, tmp_path):
    start = datetime(2026, 1, 1, tzinfo=UTC)
    rows = spark.range(600, numPartitions=6).select(
        "id", F.timestamp_add("HOUR", (F.col("id") % 72).cast("int"), F.lit(start)).alias("internal_date"),
    )
    path = daily_files(rows, str(tmp_path / "days"))
    assert spark.read.parquet(path).select("id", "internal_date").exceptAll(rows).isEmpty()
    assert spark.read.parquet(path).count() == 600
    assert len(list((tmp_path / "days").glob("day=*/*.parquet"))) == 3


def test_transitions_tell_changes_only(spark, tmp_path):
    box, out, ck = (str(tmp_path / name) for name in ("in", "out", "ck"))
    known = spark.createDataFrame([("m", "Work", "held", 1, "add", 1), ("m", "Work", "gone", 2, "remove", 2)], EVENT_ROW)
    batches = [
        # Nothing new, a removal of what was not there, a late event of a decided key, a first appearance.
        [("held", 1, "add", 1), ("gone", 3, "remove", 2), ("held", 0, "remove", 1), ("new", 4, "add", 4)],
        # The same again, another uid, one that comes and goes within the batch.
        [("new", 4, "add", 4), ("held", 5, "add", 9), ("brief", 6, "add", 6), ("brief", 7, "remove", 6)],
        # Out, and in without a uid.
        [("held", 8, "remove", 9), ("gone", 9, "add", None), ("gone", 9, "add", None)],
    ]
    for rows in batches:
        frame_of = spark.createDataFrame([("m", "Work", *r) for r in rows], EVENT_ROW)
        frame_of.coalesce(1).write.mode("append").parquet(box)
        start_transitions(read_arrivals(spark, box, frame_of.schema), out, ck, known).awaitTermination()
    assert told(spark, out) == [
        (0, "new", 4, False, True, 0, 4),
        (1, "held", 5, True, True, 1, 9),
        (2, "gone", 9, False, True, 0, 0), (2, "held", 8, True, False, 9, 0),
    ]


def test_transitions_hold_over_folds_and_null_folders(spark, tmp_path):
    box, out, ck = (str(tmp_path / name) for name in ("in", "out", "ck"))
    schema = columns(EVENT_ROW)
    known = frame(spark, [("m", None, "far", 1, "add", 1)], schema)
    for n in range(7):
        rows = [("m", "Work", "turns", n, "add" if n % 2 == 0 else "remove", 1), ("m", None, "far", n if n < 6 else 9, "add" if n < 6 else None, 1)]
        frame(spark, rows, schema).coalesce(1).write.mode("append").parquet(box)
        start_transitions(read_arrivals(spark, box, schema), out, ck, known, fold_every=2).awaitTermination()
    turns = [(n, "turns", n, n % 2 == 1, n % 2 == 0, n % 2, (n + 1) % 2) for n in range(7)]
    assert told(spark, out) == sorted([*turns, (6, "far", 9, True, False, 1, 0)])
    # What is known is a table: no row passes through a state store, and folded logs go.
    assert not os.path.exists(f"{ck}/state")
    assert sorted(d for d in os.listdir(f"{ck}/transitions/log") if "=" in d) == [f"epoch={n}" for n in range(4, 7)]


def test_a_running_stream_follows_a_new_epoch(spark, tmp_path):
    """The new epoch is the smaller number, uids are dealt anew, and one record never arrives on its own."""
    first = {MAIN: Folder((msg(1, "<a@x>"), msg(2, "<b@x>")), epoch=9)}
    second = {MAIN: Folder((msg(1, "<b@x>"), msg(2, "<quiet@x>"), msg(3, "<a@x>"), msg(4, "<c@x>")), epoch=3)}
    third = with_msgs(second, MAIN, *second[MAIN].msgs, msg(5, "<d@x>"))
    state, box, ck = StateStore(spark, str(tmp_path / "state")), str(tmp_path / "in"), str(tmp_path / "ck")
    now = {}
    marks = []
    for mailbox, arrived in ((first, (1, 2)), (second, (4,)), (third, (5,))):
        now["tables"] = tables = source(spark, {"m": mailbox})
        rows = tables.messages.filter(F.col("uid").isin(*arrived))
        rows.coalesce(1).write.mode("append").parquet(box)
        start_ingest(
            read_arrivals(spark, box, rows.schema), [spec("m")], state, ck, once=True, clock=lambda: 1,
            bodies=lambda: now["tables"].bodies, messages=lambda: now["tables"].messages, status=lambda: now["tables"].status,
        ).awaitTermination()
        mark = state.read_batch("mirror_state", state.last()[0]).first()
        log = state.read_batch("run_log", state.last()[0]).first()
        marks.append((mark["epoch"], mark["last_uid"], log["epoch_changed"], log["copied"]))
    assert marks == [(9, 0, False, 2), (3, 4, True, 2), (3, 4, False, 1)]
    got = sorted((r["key"], r["uid"]) for r in state.read("ledger").collect())
    assert got == [("<a@x>", 1), ("<b@x>", 2), ("<c@x>", 4), ("<d@x>", 5), ("<quiet@x>", 2)]
    # A pass finds nothing that the stream has left.
    assert reconcile(spark, [spec("m")], now["tables"], state, 2).first()["copied"] == 0


def test_following_epochs_needs_the_tables(spark, tmp_path):
    tables = source(spark, {"m": BOX})
    state = StateStore(spark, str(tmp_path / "state"))
    with pytest.raises(ValueError, match="bodies and of folder status"):
        start_ingest(tables.messages, [spec("m")], state, str(tmp_path / "ck"), messages=tables.messages)
    with pytest.raises(ValueError, match="status of its folders"):
        ingest_batch(spark, [spec("m")], tables.messages, "s:0", state, tables.bodies, 1, messages=tables.messages)


DELIVERY = columns("mirror string, folder string, epoch long, uid long, raw string, arrived_at timestamp")


def deliveries(spark, *rows):
    """Bodies by (uid, text, minute of arrival)."""
    base = datetime(2026, 1, 1, tzinfo=UTC)
    return frame(spark, [("m", MAIN, 7, uid, raw, base + timedelta(minutes=at)) for uid, raw, at in rows], DELIVERY)


def test_bodies_meet_their_records_within_the_wait(spark, tmp_path):
    """In the same batch, in a later one, empty, too late, never; and copies are made of what was found."""
    left, right, out = (str(tmp_path / name) for name in ("left", "right", "out"))
    records = source(spark, {"m": {MAIN: Folder(tuple(msg(i, f"<m{i}@x>") for i in range(1, 6)))}}).messages
    steps = [
        (records, deliveries(spark, (1, "one", 2), (3, "", 3), (3, None, 3))),
        (None, deliveries(spark, (2, "two", 10), (4, "four", 90), (1, "one", 11))),
        (source(spark, {"": {MAIN: Folder((msg(600, "<end@x>"),))}}).messages, deliveries(spark, (600, "end", 600))),
    ]
    for theirs, bodies in steps:
        if theirs is not None:
            theirs.coalesce(1).write.mode("append").parquet(left)
        bodies.coalesce(1).write.mode("append").parquet(right)
        start_bodies(
            read_arrivals(spark, left, records.schema), read_arrivals(spark, right, DELIVERY), out, str(tmp_path / "ck"),
            "30 minutes", delay="5 minutes",
        ).awaitTermination()
    rows = spark.read.parquet(out).filter("mirror = 'm'").drop("epoch").withColumn("epoch", F.lit(7).cast("long"))
    assert sorted((r["uid"], r["raw"] or "") for r in rows.collect()) == [
        (1, "one"), (1, "one"), (2, "two"), (3, ""), (4, ""), (5, "")]
    assert sorted(r["uid"] for r in without_body(rows).collect()) == [3, 4, 5]
    # As arrivals of a mirror: what waited in vain is listed, the rest is copied, once.
    state = StateStore(spark, str(tmp_path / "state"))
    ingest_batch(spark, [spec("m")], rows, "s:0", state, rows.select(*RECORD, "raw").dropDuplicates(RECORD), 1)
    assert sorted((r["key"], r["raw"]) for r in state.read("dest_messages").collect()) == [("<m1@x>", "one"), ("<m2@x>", "two")]
    assert sorted(r["uid"] for r in state.read_batch("missing_bodies", 1).collect()) == [3, 4, 5]


def test_late_bodies_keep_the_columns_of_records(spark):
    records = source(spark, {"m": BOX}).messages
    joined = with_late_bodies(records, deliveries(spark, (1, "one", 2)), "30 minutes")
    assert joined.columns == [*records.columns, "raw"] and joined.count() == records.count()


def test_bounded_dedup_forgets(spark, tmp_path):
    """State leaves once its horizon has passed, and the key passes again."""
    schema = columns("mirror string, folder string, epoch long, uid long, message_id string, sender string, subject string, "
                     "internal_date timestamp, size long")
    base, box, ck, out = datetime(2026, 1, 1, tzinfo=UTC), str(tmp_path / "in"), str(tmp_path / "ck"), str(tmp_path / "out")
    held = []
    for hour in range(5):
        when = base + timedelta(hours=hour)
        rows = [("m", "All", 1, hour, "<same@x>", "", "", when, 1), ("m", "All", 1, 100 + hour, f"<own{hour}@x>", "", "", when, 1)]
        frame(spark, rows, schema).coalesce(1).write.mode("append").parquet(box)
        writer = dedup_within(read_arrivals(spark, box, schema), "1 hour").writeStream.format("parquet")
        query = writer.option("checkpointLocation", ck).trigger(availableNow=True).start(out)
        query.awaitTermination()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    kept = spark.read.parquet(out)
    assert sorted(r["uid"] for r in kept.filter("uid < 100").collect()) == [0, 3]
    assert kept.filter("uid >= 100").count() == 5 and max(held) <= 4
