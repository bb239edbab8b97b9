"""What the plans read, shuffle and broadcast."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mirrorkit import fixtures as fx
from mirrorkit.operators import dedup, membership, routing
from mirrorkit.plans.bucketed import diff_snapshots, plan_bucketed, write_bucketed, write_snapshot
from mirrorkit.plans.ingest import ingest_plan, plan_candidates
from mirrorkit.sources.state import StateStore
from mirrorkit.plans.membership import sync_membership, watch_state
from mirrorkit.schemas import columns
from mirrorkit.sources.tables import (
    RECORD,
    attach_bodies,
    current_epoch,
    read_raw_files,
    scan_above_mark,
    scan_messages,
    within_spans,
    write_bodies,
    write_messages,
)


def text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lake(spark, sf_dir, tmp_path_factory):
    """Messages, bodies, ledger, members and destination keys as files."""
    root = str(tmp_path_factory.mktemp("lake"))
    write_messages(fx.arrivals(spark, sf_dir).drop("raw"), f"{root}/messages")
    write_bodies(fx.arrivals(spark, sf_dir).select(*RECORD, "raw"), f"{root}/bodies")
    for name in ("ledger", "members_new", "dest_keys"):
        getattr(fx, name)(spark, sf_dir).write.parquet(f"{root}/{name}")
    keyed = fx.keyed(spark, sf_dir).withColumn("folder", F.lit("All"))
    dedup.first_record_per_key(keyed).write.parquet(f"{root}/first")
    return root


@pytest.fixture
def large_tables(spark):
    """No side is small enough to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_range_scan_prunes_and_pushes_down(spark, lake):
    df = scan_messages(spark, f"{lake}/messages", "m1", "All", 100, 200)
    plan = text(df)
    assert "PartitionFilters: [isnotnull(mirror" in plan and "= m1)" in plan
    assert "GreaterThanOrEqual(uid,100)" in plan and "LessThanOrEqual(uid,200)" in plan
    assert "raw" not in plan
    uids = [r["uid"] for r in df.collect()]
    assert uids and min(uids) >= 100 and max(uids) <= 200
    narrow = text(df.select("uid"))
    assert "message_id" not in narrow.split("ReadSchema")[1]


def test_ingest_plan_has_one_shuffle_and_no_python(spark, lake, large_tables):
    """Candidates, ledger, destination and members meet in one aggregation; mirrors of the settings aside."""
    read = {n: spark.read.parquet(f"{lake}/{n}") for n in ("first", "ledger", "dest_keys", "members_new")}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = text(plan_candidates(read["first"], read["ledger"], read["dest_keys"], read["members_new"], fx.specs(spark)))
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_small_candidates_leave_the_large_tables_unshuffled(spark, lake):
    read = {n: spark.read.parquet(f"{lake}/{n}") for n in ("first", "ledger", "dest_keys", "members_new")}
    asked = read["first"]
    cut = text(dedup.among(read["ledger"], asked))
    assert "BroadcastHashJoin" in cut and "LeftSemi" in cut and "hashpartitioning" not in cut


def test_bodies_are_not_shuffled_for_a_small_plan(spark, lake):
    accepted = spark.read.parquet(f"{lake}/first")
    plan = text(attach_bodies(accepted, spark.read.parquet(f"{lake}/bodies")))
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_large_plans_sort_merge_instead(spark, lake, large_tables):
    accepted = spark.read.parquet(f"{lake}/first")
    plan = text(attach_bodies(accepted, spark.read.parquet(f"{lake}/bodies")))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_key_work_never_reads_bodies(spark, sf_dir):
    keyed = fx.with_key(fx.arrivals(spark, sf_dir))
    plan = text(ingest_plan(keyed, fx.ledger(spark, sf_dir), fx.dest_keys(spark, sf_dir), fx.members_new(spark, sf_dir),
                            fx.specs(spark)))
    assert "raw" not in plan


def test_diff_by_key_is_one_aggregation(spark, lake, large_tables):
    rows = spark.read.parquet(f"{lake}/members_new")
    plan = text(membership.diff_by_key(rows, rows.filter("uid > 5"))).split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_member_log_is_cut_before_it_is_folded(spark, lake, tmp_path):
    state = StateStore(spark, str(tmp_path / "state"))
    attempt = state.begin()
    attempt.write("member_log", spark.read.parquet(f"{lake}/members_new").withColumn("op", F.lit("add")))
    attempt.commit()
    asked = spark.read.parquet(f"{lake}/first")
    plan = text(routing.key_facts(state.members(keys=asked), fx.specs(spark))).split("Initial Plan")[-1]
    # The cut by keys sits below the aggregation: deeper, so later in the printed tree.
    assert plan.rindex("LeftSemi, BuildRight") > plan.rindex("partial_max")
    # Which attempts are committed is a filter on their directories, no join.
    assert plan.count("LeftSemi") == 1 and "attempt" in plan.split("PartitionFilters")[1].split("]")[0]


def test_incremental_scan_opens_the_bands_above_the_mark(spark, lake):
    """Spans reach the scan as partition filters on the band; a pass over them reads what lies above the mark."""
    spans = spark.createDataFrame([("m1", "All", 1, 100, 200)], "mirror string, folder string, epoch long, _from long, _to long")
    rows = within_spans(spark.read.parquet(f"{lake}/messages"), _written(spark, spans))
    plan = text(rows)
    assert "dynamicpruning" in plan and "band" in plan.split("PartitionFilters")[1].split("]")[0]
    uids = [r["uid"] for r in rows.collect()]
    assert uids and min(uids) > 100 and max(uids) <= 200


def _written(spark, rows):
    from mirrorkit.session import stored

    return stored(rows, "test")


def test_no_shuffle_by_folder(spark, lake, sf_dir):
    """Marks, kinds and first scans have a row per folder; they are broadcast, and records stay where they are."""
    messages = spark.read.parquet(f"{lake}/messages").drop("band")
    marks = messages.groupBy("mirror", "folder").agg(F.lit(1).alias("epoch"), F.max("uid").alias("last_uid"))
    assert "hashpartitioning(mirror" not in text(scan_above_mark(messages, marks)).split("Initial Plan")[-1]
    diff = membership.diff_by_key(fx.members_old(spark, sf_dir), fx.members_new(spark, sf_dir))
    marked = text(membership.with_first_scan(diff, fx.members_old(spark, sf_dir))).split("Initial Plan")[-1]
    assert "BroadcastHashJoin" in marked and "SortMergeJoin" not in marked


def test_membership_scans_messages_once(spark, sf_dir):
    """What a membership pass compares is written first: no result reads messages or the member log again."""
    rows, state = fx.messages(spark, sf_dir), spark.createDataFrame([], columns("mirror string, folder string, epoch long, last_uid long"))
    watch = routing.watch_list(fx.folders(spark, sf_dir), fx.specs(spark))
    folders = watch_state(watch, current_epoch(rows), state)
    change = sync_membership(rows, fx.members_old(spark, sf_dir), folders, watch, fx.specs(spark))
    for part in (change.changes, change.rows):
        assert "events.parquet" not in "".join(part.inputFiles())


def test_raw_message_files(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(b"Message-Id: <a@x>\r\nSubject: hi\r\n\r\nbody")
    (tmp_path / "b.eml").write_bytes(b"Subject: no id\n\n\xff\xfe")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in read_raw_files(spark, str(tmp_path)).collect()}
    assert (rows["a.eml"]["message_id"], rows["a.eml"]["subject"], rows["a.eml"]["size"]) == ("<a@x>", "hi", 38)
    assert (rows["b.eml"]["message_id"], rows["b.eml"]["subject"]) == ("", "no id")


def test_bucketed_tables_are_not_shuffled(spark, sf_dir, large_tables):
    """No exchange stands above a bucketed scan: the diff has none at all, the plan only those of its candidates."""
    names = [write_bucketed(rows, 8) for rows in (fx.ledger(spark, sf_dir), fx.dest_keys(spark, sf_dir), fx.members_new(spark, sf_dir))]
    table = write_snapshot(fx.members_old(spark, sf_dir), 1, 8)
    write_snapshot(fx.members_new(spark, sf_dir), 2, 8, table)
    diff = text(diff_snapshots(spark, table, 1, 2))
    assert diff.count("Bucketed: true") == 1 and "Exchange" not in diff
    assert diff_snapshots(spark, table, 1, 2).exceptAll(
        membership.diff_by_key(fx.members_old(spark, sf_dir), fx.members_new(spark, sf_dir))
    ).isEmpty()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")  # the mirrors' settings are a handful of rows
    spark.conf.set("spark.sql.shuffle.partitions", "32")  # other than the number of buckets
    try:
        plan = plan_bucketed(fx.keyed(spark, sf_dir), *[spark.table(n) for n in names], fx.specs(spark), 8)
        lines = text(plan).splitlines()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    scans = [i for i, line in enumerate(lines) if "Bucketed: true" in line]
    assert len(scans) == 3
    for i in scans:
        depth = lines[i].index("FileScan")
        for line in reversed(lines[:i]):  # the operators above, each less deep than the one before
            at = len(line) - len(line.lstrip(" :+-*()0123456789"))
            if at < depth:
                depth = at
                assert "Exchange" not in line, line
    assert "Python" not in "".join(lines)


def test_shuffled_joins_that_fit_are_not_sorted(spark, tmp_path):
    spark.range(2000).withColumn("a", F.col("id") * 2).write.parquet(str(tmp_path / "a"))
    spark.range(3000).withColumn("b", F.col("id") * 3).write.parquet(str(tmp_path / "b"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        met = spark.read.parquet(str(tmp_path / "a")).join(spark.read.parquet(str(tmp_path / "b")), "id")
        assert len(met.collect()) == 2000
        assert "ShuffledHashJoin" in text(met) and "SortMergeJoin" not in text(met).split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        if adaptive is None:
            spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        else:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", adaptive)
