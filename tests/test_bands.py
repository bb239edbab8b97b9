"""Membership by band digests beside the full comparison."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrorkit.operators.bands import band_digests, changed_bands
from mirrorkit.plans.membership import sync_bands, sync_membership, watch_state
from mirrorkit.plans.reconcile import reconcile
from mirrorkit.schemas import MESSAGES
from mirrorkit.sources.state import StateStore
from mirrorkit.sources.tables import current_epoch, write_messages
from mirrorkit.spec import MirrorSpec, specs_frame
from tests.world import BASE, MAIN, Folder, frame, msg, source, spec, with_msgs


def messages(spark, rows):
    """Messages from (folder, epoch, uid, id)."""
    made = [("m", folder, epoch, uid, mid, "a@x", f"s{mid}", BASE, 1, []) for folder, epoch, uid, mid in rows]
    return frame(spark, made, MESSAGES)


def ids(rng, folder, epoch, uids):
    """Few ids, so keys have several records; some records have none."""
    return [(folder, epoch, int(u), "" if u % 11 == 0 else f"<{rng.integers(0, 40)}@x>") for u in uids]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_changes_give_what_the_full_comparison_gives(spark, seed):
    rng = np.random.default_rng(seed)
    before = {name: ids(rng, name, 1, range(1, 120)) for name in ("A", "B", "C", "D", "F")}
    after = {name: list(rows) for name, rows in before.items()}
    holes = set(rng.integers(1, 120, 12).tolist()) | set(range(40, 55))
    after["A"] = [r for r in before["A"] if r[2] not in holes] + ids(rng, "A", 1, range(120, 140))
    after["B"] = before["B"] + ids(rng, "B", 1, range(121, 124))
    after["D"] = ids(rng, "D", 2, range(1, 90))  # a new epoch
    after["E"] = ids(rng, "E", 1, range(1, 20))  # a new folder
    del after["F"]  # a folder that is gone
    old = messages(spark, [r for rows in before.values() for r in rows])
    new = messages(spark, [r for rows in after.values() for r in rows])
    rules = specs_frame(spark, [MirrorSpec("m", "A", "A", "Mirror", labels_on=True, propagate=True, sweep_missing_folders=True)])
    watch = frame(spark, [("m", n, "keyword") for n in "ABCDE"], sync_schema(spark))
    marks = old.groupBy("mirror", "folder", "epoch").agg(F.max("uid").alias("last_uid"))
    folders = watch_state(watch, current_epoch(new), marks)
    first = sync_membership(old, old.limit(0).selectExpr("mirror", "folder", "'' key", "true is_synth", "uid"),
                            watch_state(frame(spark, [("m", n, "keyword") for n in "ABCDF"], sync_schema(spark)), current_epoch(old), marks.limit(0)), watch, rules)
    members = first.rows.drop("op").union(spark.sql("select 'm', 'A', '<placeholder@x>', false, 0L"))
    full = sync_membership(new, members, folders, watch, rules)
    cut = sync_bands(new, lambda c: c(members), folders, band_digests(old, 16), watch, rules, band_uids=16)
    for mine, theirs in ((cut.changes, full.changes), (cut.rows, full.rows), (cut.scanned, full.scanned), (cut.kinds, full.kinds)):
        a, b = (sorted(map(tuple, x.select(*sorted(theirs.columns)).collect())) for x in (mine, theirs))
        assert a == b and a
    known = {(r["folder"], r["uid_band"]) for r in changed_bands(band_digests(new, 16), band_digests(old, 16)).collect()}
    assert not any(folder == "C" for folder, _ in known) and ("A", 2) in known and ("B", 3) not in known
    # Digests that are not known yet make every band a changed one.
    anew = sync_bands(new, lambda c: c(members), folders, band_digests(old, 16).limit(0), watch, rules, band_uids=16)
    assert sorted(map(tuple, anew.changes.collect())) == sorted(map(tuple, cut.changes.collect()))


def sync_schema(spark):
    from mirrorkit.schemas import columns

    return columns("mirror string, folder string, kind string")


def test_idle_pass_writes_no_member_row(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        state = StateStore(spark, str(tmp_path / "state"))
        box = {MAIN: Folder(tuple(msg(i, f"<m{i}@x>") for i in range(1, 5))), "Work": Folder((msg(1, "<m1@x>"),), epoch=9)}
        rules = [spec("m", labels_on=True, propagate=True)]
        for now in (1, 2):
            reconcile(spark, rules, source(spark, {"m": box}), state, now)
        assert state.read("member_log").select("batch_id").distinct().collect() == [(1,)]
        assert not os.path.exists(f"{state.root}/member_log/batch_id=2")
        assert state.read_batch("folder_bands", 2).count() == 1 == state.read_batch("folder_bands", 1).count()
        log = reconcile(spark, rules, source(spark, {"m": with_msgs(box, "Work", msg(1, "<m1@x>"), msg(2, "<m3@x>"))}), state, 3).first()
        assert log["tags_updated"] == 1
        assert [(r["key"], r["op"]) for r in state.read_batch("member_log", 3).collect()] == [("<m3@x>", "add")]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_unchanged_bands_are_not_opened(spark, tmp_path):
    """Over a banded table the records of a changed band come from its directories alone; digests read uids alone."""
    path = str(tmp_path / "messages")
    rows = messages(spark, [("A", 1, uid, f"<{uid}@x>") for uid in (*range(1, 40), *range(100_001, 100_040), *range(200_001, 200_040))])
    write_messages(rows, path)
    table = spark.read.parquet(path)
    plan = band_digests(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("ReadSchema: ")[1].startswith("struct<epoch:bigint,uid:bigint>")
    before = table.filter("uid <> 100005")
    marks = before.groupBy("mirror", "folder", "epoch").agg(F.max("uid").alias("last_uid"))
    watch = frame(spark, [("m", "A", "keyword")], sync_schema(spark))
    rules = specs_frame(spark, [MirrorSpec("m", "A", "A", "Mirror", labels_on=True, propagate=True)])
    members = table.selectExpr("mirror", "folder", "message_id key", "false is_synth", "uid")
    seen = {}

    def write(name, df):
        seen[name] = df
        out = str(tmp_path / name)
        df.write.parquet(out)
        return spark.read.schema(df.schema).parquet(out)

    change = sync_bands(before, lambda c: c(members), watch_state(watch, current_epoch(table), marks), band_digests(table), watch, rules, write=write)
    assert [(r["key"], r["op"]) for r in change.changes.collect()] == [("<100005@x>", "remove")]
    plan = seen["seen"]._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan or "BroadcastHashJoin" in plan
    assert seen["seen"].count() == 38
