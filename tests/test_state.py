"""Commit protocol: crashes, replays, batches, seeding, upgrade."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from mirrorkit.plans.reconcile import drain_queue, reconcile, reconcile_until_done, seed, upgrade
from mirrorkit.schemas import STATE_TABLES
from mirrorkit.sources.state import LAYOUT_VERSION, StateStore
from tests.world import MAIN, Folder, dest_rows, msg, source, spec, with_msgs

MSGS = tuple(msg(i, f"<m{i}@x>") for i in range(1, 7))
BOX = {MAIN: Folder(MSGS), "INBOX": Folder(MSGS[:2], epoch=70), "Work": Folder(MSGS[1:3], epoch=71)}
RULES = {"archive_on": True, "labels_on": True, "propagate": True}


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.fixture
def state(spark, tmp_path):
    return StateStore(spark, str(tmp_path / "state"))


def view(state):
    return sorted((r["mirror"], r["key"], r["folder"], tuple(sorted(r["tags"]))) for r in dest_rows(state))


# A pass takes its time even on a small mailbox; TEST_ALL_CRASHES=1 dies after each write there is.
CRASH_POINTS = list(STATE_TABLES) if os.environ.get("TEST_ALL_CRASHES") else ["dest_messages", "missing_bodies", "ledger", "run_log"]


class Crash(RuntimeError):
    pass


def test_crash_after_every_write(spark, state, tmp_path):
    """One batch dies after each of its writes in turn; whatever it left is invisible, and the
    batch that gets through gives what an undisturbed one gives."""
    moved = with_msgs(with_msgs(BOX, "INBOX", MSGS[1]), "Work", *MSGS[3:5])
    moved = with_msgs(moved, MAIN, *MSGS, msg(7, "<m7@x>"))
    first, second = source(spark, {"m": BOX}), source(spark, {"m": moved})
    reconcile(spark, [spec("m", **RULES)], first, state, 1)
    before = view(state)
    for point in CRASH_POINTS:
        def crash(table, point=point):
            if table == point:
                raise Crash(point)

        broken = StateStore(spark, state.root, on_write=crash)
        with pytest.raises(Crash):
            reconcile(spark, [spec("m", **RULES)], second, broken, 2)
        assert state.last()[0] == 1
    assert view(state) == before
    log = reconcile(spark, [spec("m", **RULES)], second, state, 2).first()
    assert (log["moved_to_archive"], log["copied"], log["ops_applied"]) == (1, 1, 5)

    clean = StateStore(spark, str(tmp_path / "clean"))
    for now, tables in enumerate((first, second), start=1):
        reconcile(spark, [spec("m", **RULES)], tables, clean, now)
    assert view(state) == view(clean)
    for table in ("ledger", "pending_ops", "applied_ops", "member_log"):
        assert state.read(table).exceptAll(clean.read(table)).isEmpty()
        assert clean.read(table).exceptAll(state.read(table)).isEmpty()


def test_crash_before_the_first_commit_copies_once(spark, state):
    def crash(table):
        if table == "ledger":
            raise Crash(table)

    tables = source(spark, {"m": BOX})
    with pytest.raises(Crash):
        reconcile(spark, [spec("m", **RULES)], tables, StateStore(spark, state.root, on_write=crash), 1)
    assert dest_rows(state) == [] and state.read("ledger").isEmpty()
    log = reconcile(spark, [spec("m", **RULES)], tables, state, 1).first()
    assert log["copied"] == 6 and len(view(state)) == 6
    # The same batch number again is the same batch.
    again = reconcile(spark, [spec("m", **RULES)], tables, state, 9, batch_id=1).first()
    assert again["copied"] == 6 and state.last()[0] == 1


def test_batches_of_any_size_give_the_same(spark, state, tmp_path):
    tables = source(spark, {"m": BOX})
    assert reconcile_until_done(spark, [spec("m", **RULES)], tables, state, 1, max_uids=4) == 2
    whole = StateStore(spark, str(tmp_path / "whole"))
    reconcile(spark, [spec("m", **RULES)], tables, whole, 1)
    assert view(state) == view(whole)
    marks = state.read_batch("mirror_state", state.last()[0]).first()
    assert (marks["epoch"], marks["last_uid"]) == (7, 6)


def test_queue_waits_until_applied(spark, state):
    reconcile(spark, [spec("m", **RULES)], source(spark, {"m": BOX}), state, 1)
    left = with_msgs(BOX, "INBOX", MSGS[1])
    log = reconcile(spark, [spec("m", **RULES)], source(spark, {"m": left}), state, 2, apply_ops=False).first()
    assert (log["moved_to_archive"], log["ops_applied"]) == (0, 0)
    assert [(r["kind"], r["key"], r["op"]) for r in state.pending().collect()] == [("move", "<m1@x>", "remove")]
    # Back in the inbox before the queue is worked: both operations apply to what holds now.
    back = with_msgs(BOX, "INBOX", MSGS[1], msg(9, "<m1@x>"))
    log = reconcile(spark, [spec("m", **RULES)], source(spark, {"m": back}), state, 3).first()
    assert (log["moved_to_archive"], log["moved_to_inbox"], log["ops_applied"]) == (0, 0, 2)
    assert state.pending().isEmpty()


def test_a_crash_in_a_page_keeps_the_pages_before(spark, state):
    reconcile(spark, [spec("m", **RULES)], source(spark, {"m": BOX}), state, 1)
    moved = source(spark, {"m": with_msgs(with_msgs(BOX, "INBOX"), "Work", *MSGS[1:5])})
    reconcile(spark, [spec("m", **RULES)], moved, state, 2, apply_ops=False)
    queue = [tuple(r) for r in state.pending().select("seq", "kind", "key", "op").orderBy("seq").collect()]
    assert len(queue) == 4
    assert drain_queue(spark, [spec("m", **RULES)], moved, state, 2, pages=1) == 1

    def crash(table):
        if table == "applied_ops":
            raise Crash(table)

    with pytest.raises(Crash):
        drain_queue(spark, [spec("m", **RULES)], moved, StateStore(spark, state.root, on_write=crash), 1)
    assert [tuple(r) for r in state.pending().select("seq", "kind", "key", "op").orderBy("seq").collect()] == queue[2:]
    assert drain_queue(spark, [spec("m", **RULES)], moved, state, 2) == 1 and state.pending().isEmpty()
    want = {"<m1@x>": ("ARCHIVE", ()), "<m2@x>": ("ARCHIVE", ("Work",)), "<m4@x>": ("ARCHIVE", ("Work",))}
    got = {key: (folder, tags) for _, key, folder, tags in view(state)}
    assert {key: (got[key][0], tuple(t.split(":")[-1].capitalize() for t in got[key][1])) for key in want} == want


def test_member_snapshot_gives_the_same_members(spark, state):
    reconcile(spark, [spec("m", **RULES)], source(spark, {"m": BOX}), state, 1)
    moved = with_msgs(BOX, "Work", MSGS[5])
    reconcile(spark, [spec("m", **RULES)], source(spark, {"m": moved}), state, 2, members_snapshot=True)
    batch, base = state.last()
    assert (batch, base) == (2, 2)
    rows = sorted((r["folder"], r["key"]) for r in state.members().collect())
    assert rows == [("INBOX", "<m1@x>"), ("INBOX", "<m2@x>"), ("Work", "<m6@x>")]


def test_seed_modes(spark, state):
    box = {MAIN: Folder((*MSGS[:3], msg(4, "", "no id")))}
    names = ("empty", "always", "never")
    specs = [spec(m, seed=m, dest_guard=False) for m in names]
    held = source(spark, {m: {MAIN: Folder((*MSGS[:2], msg(4, "", "no id"), msg(9, "<m1@x>")))} for m in names}).messages
    held = held.withColumn("folder", F.lit("DEST")).drop("message_id").withColumn(
        "message_id", F.when(F.col("uid") == 4, "").when(F.col("uid") == 2, "<m2@x>").otherwise("<m1@x>"))
    counts = {r["mirror"]: (r["n_scanned"], r["n_keys"]) for r in seed(spark, specs, held, state).collect()}
    assert counts == {"empty": (4, 3), "always": (4, 3)}
    log = {r["mirror"]: (r["copied"], r["skipped_dup"]) for r in
           reconcile(spark, specs, source(spark, dict.fromkeys(names, box)), state, 1).collect()}
    assert log == {"empty": (1, 3), "always": (1, 3), "never": (4, 0)}
    # By now no ledger is empty, and seeding again adds nothing.
    again = {r["mirror"]: (r["n_scanned"], r["n_keys"]) for r in seed(spark, specs, held, state).collect()}
    assert again == {"always": (4, 0)}
    marks = {r["mirror"]: r["last_uid"] for r in state.read_batch("mirror_state", state.last()[0]).collect()}
    assert marks == dict.fromkeys(names, 4)


def test_upgrade_of_an_older_state(spark, state):
    copied = spark.createDataFrame([("m", "<m1@x>", 10, 1), ("m", "<m2@x>", 20, 2)],
                                   "mirror string, key string, uid long, copied_at long")
    meta = spark.createDataFrame([("m", 7, 2)], "mirror string, epoch long, last_uid long")
    labels = spark.createDataFrame([("m", "<m1@x>", "Work"), ("m", "<m1@x>", "Friends/Close"), ("m", "<m2@x>", "Work")],
                                   "mirror string, key string, label string")
    upgrade(state, copied, meta, labels)
    assert state.read("ledger").count() == 2
    assert sorted((r["folder"], r["key"], r["uid"]) for r in state.members().collect()) == [
        ("Friends/Close", "<m1@x>", 0), ("Work", "<m1@x>", 0), ("Work", "<m2@x>", 0)]
    # The next pass scans folders in full, compares by key and keeps the mark.
    box = {MAIN: Folder(MSGS[:3]), "Work": Folder(MSGS[:1], epoch=71), "Friends/Close": Folder(MSGS[:1], epoch=72)}
    foreign = [("m", "f1", "DEST", "<m1@x>"), ("m", "f2", "DEST", "<m2@x>")]
    rules = {"labels_on": True, "propagate": True}
    log = reconcile(spark, [spec("m", **rules)], source(spark, {"m": box}, foreign), state, 1).first()
    assert (log["candidates"], log["copied"], log["ops_applied"]) == (1, 1, 1)
    assert sorted((r["folder"], r["key"], r["uid"]) for r in state.members().collect()) == [
        ("Friends/Close", "<m1@x>", 1), ("Work", "<m1@x>", 1)]
    with pytest.raises(ValueError, match="already holds"):
        upgrade(state, copied, meta, labels)


def test_first_duplicate_with_a_body_is_copied_and_the_rest_wait(spark, state):
    """An empty body hides no record behind it, and a key without any body is tried again."""
    none = {MAIN: Folder((msg(1, "<a@x>", ""), msg(2, "<a@x>", "second"), msg(3, "<b@x>", ""), msg(4, "<c@x>")))}
    log = reconcile(spark, [spec("m")], source(spark, {"m": none}), state, 1).first()
    assert (log["copied"], log["missing_bodies"]) == (2, 1)
    rows = {r["key"]: (r["uid"], r["raw"]) for r in state.read("dest_messages").collect()}
    assert rows == {"<a@x>": (2, "second"), "<c@x>": (4, "raw-<c@x>")}
    log = reconcile(spark, [spec("m")], source(spark, {"m": none}), state, 2).first()
    assert (log["copied"], log["missing_bodies"]) == (0, 1)
    now = with_msgs(none, MAIN, *none[MAIN].msgs[:2], msg(3, "<b@x>", "late"), none[MAIN].msgs[3])
    log = reconcile(spark, [spec("m")], source(spark, {"m": now}), state, 3).first()
    assert (log["copied"], log["missing_bodies"]) == (1, 0)
    assert state.read("dest_messages").filter("key = '<b@x>'").first()["raw"] == "late"
    assert state.read("ledger").count() == 3


def test_one_writer_wins_a_batch(spark, state):
    """Two attempts at one batch: the second is refused, and were both published, one of them counts."""
    first, second = state.begin(), state.begin()
    rows = spark.createDataFrame([("m", "k", False, 1, 1, "copy")], STATE_TABLES["ledger"])
    for attempt in (first, second):
        attempt.write("ledger", rows)
    first.commit()
    with pytest.raises(ValueError, match="already committed"):
        second.commit()
    # Storage that let both through: a row of the loser beside the winner's.
    row = spark.sql(f"select '{second.name}' attempt, 0L members_base, 0L logs_base, {LAYOUT_VERSION} layout, '' tag, 0 parts")
    row.write.mode("append").parquet(f"{state.root}/commits/batch_id=1")
    assert state.commits().count() == 1 and state.read("ledger").count() == 1


def test_a_writer_that_died_while_publishing_blocks_nobody(spark, state, tmp_path):
    (tmp_path / "state" / "commits" / "batch_id=1" / "_temporary").mkdir(parents=True)
    attempt = state.begin()
    attempt.commit()
    assert state.last() == (1, 0)


def test_compaction_changes_nothing_but_the_files(spark, state):
    """Moves, tags and a waiting queue, folded: the same view before and after, and old files are gone."""
    rules = [spec("m", **RULES)]
    reconcile(spark, rules, source(spark, {"m": BOX}), state, 1)
    moved = with_msgs(with_msgs(BOX, "INBOX", MSGS[1]), "Work", *MSGS[3:5])
    reconcile(spark, rules, source(spark, {"m": moved}), state, 2)
    reconcile(spark, rules, source(spark, {"m": with_msgs(moved, "Work", MSGS[4])}), state, 3, apply_ops=False)

    def queue():
        return [(r["kind"], r["key"], r["folder"], r["op"]) for r in state.pending().orderBy("batch_id", "seq").collect()]

    before = view(state), queue(), state.members().count(), state.read("ledger").count()
    assert before[1]
    assert state.compact() == 4
    assert state.vacuum() > 0 and state.vacuum() == 0
    assert (view(state), queue(), state.members().count(), state.read("ledger").count()) == before
    log = reconcile(spark, rules, source(spark, {"m": with_msgs(moved, "Work", MSGS[4])}), state, 4, compact_every=1).first()
    assert log["ops_applied"] == len(before[1]) and state.pending().isEmpty()
    assert state.last() == (6, 6)


def test_parts_by_key_change_nothing_but_what_is_read(spark, state, tmp_path):
    """Large batches and folded ones lie in parts by key, small ones loose; a lookup opens the parts of its keys."""
    rules = [spec("m", **RULES)]
    laid = StateStore(spark, str(tmp_path / "laid"), key_parts=8, large_batch=1)
    moved = with_msgs(with_msgs(BOX, "INBOX", MSGS[1]), "Work", *MSGS[3:5])
    moved = with_msgs(moved, MAIN, *MSGS, msg(7, "<m7@x>"))
    for now, tables in enumerate((source(spark, {"m": BOX}), source(spark, {"m": moved})), start=1):
        for store in (state, laid):
            reconcile(spark, rules, tables, store, now)
    laid.compact()
    laid.large_batch = 10**9
    last = source(spark, {"m": with_msgs(moved, MAIN, *MSGS, msg(7, "<m7@x>"), msg(8, "<m8@x>"))})
    for store in (state, laid):
        assert reconcile(spark, rules, last, store, 3).first()["copied"] == 1
    assert view(state) == view(laid)
    assert state.view().parts == 0 and laid.view().parts == 8
    asked = spark.createDataFrame([("m", "<m2@x>"), ("m", "<m8@x>"), ("m", "<none@x>")], "mirror string, key string")
    for table in ("ledger", "dest_messages", "member_log"):
        found = [sorted((r["key"], r["uid"]) for r in store.read(table, asked).select("key", "uid").distinct().collect()) for store in (state, laid)]
        assert found[0] == found[1] and {"<m2@x>", "<m8@x>"} >= {key for key, _ in found[0]} and found[0]
    asked.write.parquet(str(tmp_path / "asked"))
    asked = spark.read.parquet(str(tmp_path / "asked"))
    for rows in (laid.read("ledger", asked), laid.dest(keys=asked), laid.members(keys=asked)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "dynamicpruning" in plan.split("PartitionFilters: ", 1)[1]


def test_windows_and_full_scans_do_not_mix(spark, state):
    with pytest.raises(ValueError, match="not both"):
        reconcile(spark, [spec("m")], source(spark, {"m": BOX}), state, 1, full=True, max_uids=2)
    assert reconcile_until_done(spark, [spec("m", uid_batch=4)], source(spark, {"m": {MAIN: Folder(MSGS)}}), state, 1) == 2


def test_newer_layout_is_refused(spark, state):
    attempt = state.begin()
    attempt.commit(layout=99)
    with pytest.raises(ValueError, match="newer"):
        state.last()


def test_mirrors_never_mix(spark, state):
    """The same ids in two mirrors with different rules and buckets."""
    a = {MAIN: Folder(MSGS[:2]), "INBOX": Folder(MSGS[:1], epoch=70)}
    b = {MAIN: Folder(MSGS[:3]), "INBOX": Folder((), epoch=70)}
    specs = [spec("a", archive_on=True), spec("b", dest_folder="OTHER")]
    reconcile(spark, specs, source(spark, {"a": a, "b": b}), state, 1)
    assert [(m, k, f) for m, k, f, _ in view(state)] == [
        ("a", "<m1@x>", "DEST"), ("a", "<m2@x>", "ARCHIVE"),
        ("b", "<m1@x>", "OTHER"), ("b", "<m2@x>", "OTHER"), ("b", "<m3@x>", "OTHER")]
    # A content of equal id is the same record; copies carry what their key was made from.
    row = state.read("dest_messages").filter("mirror = 'a' and key = '<m1@x>'").first()
    assert (row["raw"], row["size"], row["sender"], row["uid"]) == ("raw-<m1@x>", len("raw-<m1@x>"), "a@x", 1)
