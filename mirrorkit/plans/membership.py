"""One membership pass: compare every watched folder with what is stored."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorkit.functions.keys import with_key
from mirrorkit.operators.bands import BAND, band_digests, changed_bands, with_band
from mirrorkit.operators.membership import (
    CHANGE_COLUMNS,
    PLACE,
    diff_by_key,
    diff_by_uid,
    latest_member_uid,
    removed_uids,
    row_changes,
    vanished,
    with_first_scan,
)
from mirrorkit.session import stored
from mirrorkit.sources.tables import BAND_UIDS
from mirrorkit.spec import MirrorSpec

FOLDER = ["mirror", "folder"]
ROW = ["mirror", "folder", "key", "is_synth", "uid"]


@dataclass(frozen=True)
class MembershipChange:
    """``changes`` per key (they may cause operations), ``rows`` for the member log, ``scanned`` scan
    state, ``kinds`` of operation per folder: those of the watch list and of swept folders, and, where bands
    were compared, their digests as of now."""

    changes: DataFrame
    rows: DataFrame
    scanned: DataFrame
    kinds: DataFrame
    bands: DataFrame | None = None


# Cuts rows with mirror, folder, key and uid to those that are asked for.
Cut = Callable[[DataFrame], DataFrame]


def watch_state(watch: DataFrame, status: DataFrame, folder_state: DataFrame) -> DataFrame:
    """Per watched folder: stored mark, current epoch, and whether a full scan is due.

    A folder without any record has no status; its stored epoch then still holds. Epoch 0 stands
    for a folder that was scanned while empty: whatever appears in it later is an addition.
    """
    before = folder_state.select(*FOLDER, F.col("epoch").alias("_stored"), F.col("last_uid").alias("_last"))
    last = F.coalesce(F.col("_last"), F.lit(0).cast("long"))
    now = F.coalesce("epoch", "_stored", F.lit(0).cast("long"))
    known = F.col("_stored") != 0
    return (
        watch.select(*FOLDER).distinct()
        .join(status.select(*FOLDER, "epoch", "uid_next"), FOLDER, "left").join(before, FOLDER, "left")
        .select(
            *FOLDER,
            now.alias("epoch"),
            last.alias("last_uid"),
            F.coalesce(F.col("uid_next") - 1, last).alias("top_uid"),
            (F.col("_stored").isNull() | (known & (now != F.col("_stored")))).alias("rescan"),
        )
    )


def sync_membership(
    messages: DataFrame, members: DataFrame, folders: DataFrame, watch: DataFrame, specs: DataFrame,
    spec_list: list[MirrorSpec] | tuple[MirrorSpec, ...] = (),
    write: Callable[[str, DataFrame], DataFrame] | None = None,
) -> MembershipChange:
    """Diff by uid where the epoch is the stored one, by key where it is new or first seen.

    ``folders`` is the result of ``watch_state``. Messages are scanned once: every record gives its
    uid, and a key where one is needed (above the mark, or in a folder scanned anew). That and the
    folded members are written (by ``write``), as every result below is made from them.
    """
    write = write or (lambda name, rows: stored(rows, name))
    folders = write("watched", folders)
    here = messages.join(folders, [*FOLDER, "epoch"])
    needed = F.col("rescan") | (F.col("uid") > F.col("last_uid"))
    keyed = with_key(here, spec_list)
    seen = write("seen", keyed.select(*FOLDER, "uid", "rescan", *[F.when(needed, F.col(c)).alias(c) for c in ("key", "is_synth")]))
    same, again = folders.filter(~F.col("rescan")).select(*FOLDER), folders.filter("rescan").select(*FOLDER)

    snapshot = seen.filter(~F.col("rescan")).select(*FOLDER, "uid")
    fresh = seen.filter(~F.col("rescan") & F.col("key").isNotNull()).select(*ROW)
    current = seen.filter("rescan").select(*ROW)
    members = write("members", members.select(*ROW))
    stored_same = members.join(same, FOLDER, "left_semi")
    stored_again = members.join(again, FOLDER, "left_semi")

    by_uid = diff_by_uid(stored_same, snapshot, fresh).withColumn("first_scan", F.lit(False))
    by_key = with_first_scan(diff_by_key(stored_again, current).filter(F.col("op") != "same"), stored_again)
    swept = vanished(members, watch, specs).withColumn("op", F.lit("remove"))
    swept_keys = swept.groupBy(*PLACE, "op").agg(F.max("uid").alias("uid"), F.max("is_synth").alias("is_synth"))
    changes = by_uid.unionByName(by_key).unionByName(swept_keys.withColumn("first_scan", F.lit(False)))

    rows = (
        removed_uids(stored_same, snapshot).withColumn("op", F.lit("remove")).select(*ROW, "op")
        .unionByName(fresh.withColumn("op", F.lit("add")))
        .unionByName(row_changes(stored_again, current).select(*ROW, "op"))
        .unionByName(swept.select(*ROW, "op"))
    )
    return MembershipChange(changes, rows, _scanned(folders), _kinds(watch, swept, specs))


def _scanned(folders: DataFrame) -> DataFrame:
    return folders.select(
        *FOLDER, "epoch", F.when(F.col("rescan"), F.col("top_uid")).otherwise(F.greatest("top_uid", "last_uid"))
        .alias("last_uid")
    )


def _kinds(watch: DataFrame, swept: DataFrame, specs: DataFrame) -> DataFrame:
    """Only label folders can vanish: inbox and sent are watched whether listed or not."""
    return watch.unionByName(
        swept.select(*FOLDER).distinct().join(specs.filter("propagate").select("mirror"), "mirror", "left_semi")
        .withColumn("kind", F.lit("keyword"))
    )


def sync_bands(
    messages: DataFrame, members_of: Callable[[Cut], DataFrame], folders: DataFrame, bands: DataFrame, watch: DataFrame,
    specs: DataFrame, spec_list: list[MirrorSpec] | tuple[MirrorSpec, ...] = (),
    write: Callable[[str, DataFrame], DataFrame] | None = None, band_uids: int = BAND_UIDS,
) -> MembershipChange:
    """The changes of :func:`sync_membership`, found by comparing what changed and nothing else.

    ``bands`` are the digests of the last pass. Each pass digests the uids of the watched folders; records
    are read, keyed and compared in bands with another digest, and in folders scanned anew. ``members_of``
    gives the stored members within a cut, made before they are folded, so an unchanged folder costs its
    digests: no member of it is read, shuffled or written. Folders without stored digests are compared in full.

    A key is gone when none of its records is left, so the keys of records that left a changed band are looked
    up once more among all members.
    """
    write = write or (lambda name, rows: stored(rows, name))
    folders = write("watched", folders)
    same, again = folders.filter(~F.col("rescan")).select(*FOLDER), folders.filter("rescan").select(*FOLDER)
    now = write("bands", band_digests(messages.join(folders.select(*FOLDER, "epoch"), [*FOLDER, "epoch"], "left_semi"), band_uids))
    changed = write("changed_bands", changed_bands(now.join(same, FOLDER, "left_semi"), bands.join(same, FOLDER, "left_semi")))
    no_member = members_of(lambda rows: rows.filter(F.lit(False))).select(*ROW)

    def in_bands(rows: DataFrame) -> DataFrame:
        return with_band(rows, band_uids).join(changed, BAND, "left_semi").drop("uid_band")

    def of_folders(which: DataFrame) -> Cut:
        return lambda rows: rows.join(which, FOLDER, "left_semi")

    changes, rows = [], []
    if not changed.isEmpty():
        here = in_bands(messages.join(folders.filter(~F.col("rescan")).select(*FOLDER, "epoch", "last_uid"), [*FOLDER, "epoch"]))
        above = F.col("uid") > F.col("last_uid")
        keyed = with_key(here, spec_list)
        seen = write("seen", keyed.select(*FOLDER, "uid", *[F.when(above, F.col(c)).alias(c) for c in ("key", "is_synth")]))
        fresh = seen.filter(F.col("key").isNotNull()).select(*ROW)
        gone = write("gone", removed_uids(members_of(in_bands), seen.select(*FOLDER, "uid")).select(*ROW))
        left = gone.groupBy(*PLACE).agg(F.max("uid").alias("uid"), F.max("is_synth").alias("is_synth"))
        held = members_of(lambda log: log.join(gone.select(*PLACE), PLACE, "left_semi"))
        alive = held.join(gone, [*PLACE, "uid"], "left_anti").select(*PLACE)
        removed = left.join(alive, PLACE, "left_anti").withColumn("op", F.lit("remove"))
        added = latest_member_uid(fresh).withColumn("op", F.lit("add"))
        changes.append(removed.select(*CHANGE_COLUMNS).unionByName(added.select(*CHANGE_COLUMNS)).withColumn("first_scan", F.lit(False)))
        rows.append(gone.withColumn("op", F.lit("remove")).select(*ROW, "op").unionByName(fresh.withColumn("op", F.lit("add"))))
    if not again.isEmpty():
        anew = messages.join(folders.filter("rescan").select(*FOLDER, "epoch"), [*FOLDER, "epoch"], "left_semi")
        current = write("seen_anew", with_key(anew, spec_list).select(*ROW))
        before = write("members", members_of(of_folders(again)).select(*ROW))
        changes.append(with_first_scan(diff_by_key(before, current).filter(F.col("op") != "same"), before))
        rows.append(row_changes(before, current).select(*ROW, "op"))
    swept = no_member
    if not specs.filter("sweep_missing_folders").isEmpty():
        swept = members_of(lambda log: vanished(log, watch, specs)).select(*ROW)
        by_key = swept.groupBy(*PLACE).agg(F.max("uid").alias("uid"), F.max("is_synth").alias("is_synth"))
        changes.append(by_key.withColumn("op", F.lit("remove")).select(*CHANGE_COLUMNS).withColumn("first_scan", F.lit(False)))
        rows.append(swept.withColumn("op", F.lit("remove")).select(*ROW, "op"))
    nothing = no_member.withColumn("op", F.lit("add"))
    return MembershipChange(
        reduce(DataFrame.unionByName, changes, nothing.select(*CHANGE_COLUMNS).withColumn("first_scan", F.lit(False))),
        reduce(DataFrame.unionByName, rows, nothing), _scanned(folders), _kinds(watch, swept, specs), now,
    )
