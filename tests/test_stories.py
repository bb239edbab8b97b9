"""Multi-pass stories. Each is one mirror; pass n runs step n of all of them in one job."""

from __future__ import annotations

import pytest

from mirrorkit.plans.reconcile import reconcile, record_changes
from mirrorkit.sources.state import StateStore
from tests.world import MAIN, Folder, Step, dest_rows, msg, source, spec, with_msgs

A, B, C = msg(1, "<a@x>"), msg(2, "<b@x>"), msg(3, "<c@x>")
M1, M2, M3, M4 = (msg(i, f"<m{i}@x>") for i in (1, 2, 3, 4))
ROUTING = {"archive_on": True}
SENT = {"archive_on": True, "sent_on": True}
LABELS = {"labels_on": True, "propagate": True}

INBOXED = {MAIN: Folder((M1, M2, M3)), "INBOX": Folder((M1,), epoch=70)}
MAILED = {
    MAIN: Folder((M1, M2, M3, M4)), "INBOX": Folder((M1, M4), epoch=70),
    "SENTSRC": Folder((M2, M4), epoch=71, attrs=("\\Sent",)),
}
ONE = {MAIN: Folder((M1,)), "Work": Folder((M1,), epoch=71)}
EMPTY_WORK = {MAIN: Folder((M1,)), "Work": Folder((), epoch=71)}
NO_ID = msg(1, "", "raw-nomid")

STORIES: dict[str, list[Step]] = {
    "first-run-then-rerun": [
        Step({MAIN: Folder((A, B, C))}, log={"copied": 3, "skipped_dup": 0}, total=3),
        Step({MAIN: Folder((A, B, C))}, log={"copied": 0, "candidates": 0}, total=3),
    ],
    "repeated-id-in-one-batch": [
        Step({MAIN: Folder((A, B, msg(3, " <a@x> ", "other text"), msg(4, "", "no id")))},
             log={"candidates": 4, "copied": 3, "skipped_dup": 1}, total=3),
    ],
    "epoch-reset": [
        Step({MAIN: Folder((msg(10, "<a@x>"), msg(20, "<b@x>")))}, log={"copied": 2, "epoch_changed": False}),
        Step({MAIN: Folder((A, B, C), epoch=8)}, log={"epoch_changed": True, "copied": 1, "skipped_dup": 2}, total=3),
    ],
    "guard-heals-unrecorded-copy": [
        Step({MAIN: Folder((A,))}, foreign=[("f1", "DEST", "<a@x>")], log={"copied": 0, "skipped_dup": 1}, total=0),
        Step({MAIN: Folder((A,), epoch=8)}, rules={"dest_guard": False}, log={"copied": 0, "skipped_dup": 1}, total=0),
    ],
    "guard-off-copies-again": [
        Step({MAIN: Folder((A,))}, rules={"dest_guard": False}, foreign=[("f1", "DEST", "<a@x>")], log={"copied": 1}),
    ],
    "guard-looks-in-every-bucket": [
        Step(INBOXED, ROUTING, foreign=[("f1", "DEST", "<m1@x>"), ("f2", "ARCHIVE", "<m2@x>"), ("f3", "Custom", "<m3@x>")],
             log={"copied": 1, "skipped_dup": 2}, dest={"<m3@x>": "ARCHIVE"}),
    ],
    "no-id-bypasses-guard": [
        Step({MAIN: Folder((NO_ID,))}, foreign=[("f1", "DEST", "<other@x>")], log={"copied": 1}, total=1),
    ],
    "archive-routing": [
        Step(INBOXED, ROUTING, log={"copied": 3}, dest={"<m1@x>": "DEST", "<m2@x>": "ARCHIVE", "<m3@x>": "ARCHIVE"}),
        Step(with_msgs(INBOXED, "INBOX"), ROUTING, log={"moved_to_archive": 1}, dest={"<m1@x>": "ARCHIVE"}, total=3),
        Step(with_msgs(INBOXED, "INBOX"), ROUTING, log={"moved_to_archive": 0, "ops_applied": 0}, total=3),
    ],
    "back-to-inbox": [
        Step(INBOXED, ROUTING, log={"copied": 3}),
        Step(with_msgs(INBOXED, "INBOX", M1, msg(2, "<m2@x>")), ROUTING, log={"moved_to_inbox": 1},
             dest={"<m2@x>": "DEST"}, total=3),
    ],
    "manual-refile-respected": [
        Step(INBOXED, ROUTING, log={"copied": 3}),
        Step(with_msgs(INBOXED, "INBOX"), ROUTING, manual_moves=[("<m1@x>", "Custom/Elsewhere")],
             log={"moved_to_archive": 0, "ops_applied": 1}, dest={"<m1@x>": "Custom/Elsewhere"}),
        Step(with_msgs(INBOXED, "INBOX"), ROUTING, log={"ops_applied": 0}),
    ],
    "synthesized-key-never-moves": [
        Step({MAIN: Folder((NO_ID,)), "INBOX": Folder((NO_ID,), epoch=70)}, ROUTING, log={"copied": 1}),
        Step({MAIN: Folder((NO_ID,)), "INBOX": Folder((), epoch=70)}, ROUTING, log={"moved_to_archive": 0, "ops_applied": 0}),
    ],
    "label-added-and-removed": [
        Step(EMPTY_WORK, LABELS, log={"copied": 1, "tags_set": 0}, tags={"<m1@x>": []}),
        Step(ONE, LABELS, log={"tags_updated": 1}, tags={"<m1@x>": ["work"]}),
        Step(EMPTY_WORK, LABELS, manual_tags=[("<m1@x>", "mytag")], log={"tags_updated": 1}, tags={"<m1@x>": ["mytag"]}),
    ],
    "propagation-off": [
        Step(EMPTY_WORK, {"labels_on": True}, log={"copied": 1}),
        Step(ONE, {"labels_on": True}, log={"tags_updated": 0, "ops_applied": 0}, tags={"<m1@x>": []}),
    ],
    "prefix-at-copy-and-later": [
        Step({MAIN: Folder((M1, M2)), "Work": Folder((M1,), epoch=71)}, {**LABELS, "keyword_prefix": "$label:"},
             log={"tags_set": 1}, tags={"<m1@x>": ["$label:work"], "<m2@x>": []}),
        Step({MAIN: Folder((M1, M2)), "Work": Folder((M1, M2), epoch=71)}, {**LABELS, "keyword_prefix": "$label:"},
             tags={"<m1@x>": ["$label:work"], "<m2@x>": ["$label:work"]}),
    ],
    "prefix-change-tags-once": [
        Step(ONE, {"labels_on": True}, tags={"<m1@x>": ["work"]}),
        Step(ONE, {"labels_on": True, "keyword_prefix": "$label:"}, log={"tags_updated": 1},
             tags={"<m1@x>": ["$label:work", "work"]}),
        Step(ONE, {"labels_on": True, "keyword_prefix": "$label:"}, log={"tags_updated": 0}),
    ],
    "excluded-folder": [
        Step({MAIN: Folder((M1, M2, M3)), "Work": Folder((M1, M2)), "Friends/Close": Folder((M1,)),
              "Ignored": Folder((M1,)), "Trash": Folder((M1,), attrs=("\\Trash",))},
             {"labels_on": True, "label_exclude": ("Ignored",), "keyword_prefix": "$label:"}, log={"copied": 3},
             tags={"<m1@x>": ["$label:friends_close", "$label:work"], "<m2@x>": ["$label:work"], "<m3@x>": []}),
    ],
    "two-labels-one-tag": [
        Step({MAIN: Folder((M1,)), "Work": Folder((M1,)), "[Work]": Folder((M1,))}, LABELS, tags={"<m1@x>": ["work"]}),
        Step({MAIN: Folder((M1,)), "Work": Folder(()), "[Work]": Folder((M1,))}, LABELS,
             log={"ops_applied": 1, "tags_updated": 0}, tags={"<m1@x>": ["work"]}),
        Step({MAIN: Folder((M1,)), "Work": Folder(()), "[Work]": Folder(())}, LABELS,
             log={"tags_updated": 1}, tags={"<m1@x>": []}),
    ],
    "folder-epoch-reset": [
        Step(INBOXED, ROUTING, log={"copied": 3}),
        Step(with_msgs(INBOXED, "INBOX", msg(41, "<m1@x>"), epoch=999), ROUTING,
             log={"moved_to_archive": 0, "moved_to_inbox": 0, "ops_applied": 0}),
        Step(with_msgs(INBOXED, "INBOX", epoch=1000), ROUTING, log={"moved_to_archive": 1}),
    ],
    "older-record-keeps-membership": [
        Step({MAIN: Folder((M1,)), "INBOX": Folder((M1, msg(5, "<m1@x>")), epoch=70)}, ROUTING, dest={"<m1@x>": "DEST"}),
        Step({MAIN: Folder((M1,)), "INBOX": Folder((M1,), epoch=70)}, ROUTING, log={"ops_applied": 0}, dest={"<m1@x>": "DEST"}),
        Step({MAIN: Folder((M1,)), "INBOX": Folder((), epoch=70)}, ROUTING, log={"moved_to_archive": 1}),
    ],
    "inbox-beats-sent": [
        Step(MAILED, SENT, log={"copied": 4},
             dest={"<m1@x>": "DEST", "<m2@x>": "SENT-DEST", "<m3@x>": "ARCHIVE", "<m4@x>": "DEST"}, total=4),
        Step(with_msgs(MAILED, "INBOX", M1), SENT, log={"moved_to_sent": 1}, dest={"<m4@x>": "SENT-DEST"}, total=4),
    ],
    "sent-enabled-later": [
        Step(MAILED, ROUTING, dest={"<m2@x>": "ARCHIVE"}),
        Step(MAILED, SENT, log={"moved_to_sent": 1}, dest={"<m2@x>": "SENT-DEST", "<m4@x>": "DEST"}, total=4),
    ],
    "sent-is-no-label": [
        Step(MAILED, {**SENT, "labels_on": True},
             tags={"<m1@x>": [], "<m2@x>": [], "<m3@x>": [], "<m4@x>": []}),
    ],
    "routing-enabled-later": [
        Step(INBOXED, log={"copied": 3}, dest={"<m1@x>": "DEST", "<m2@x>": "DEST", "<m3@x>": "DEST"}),
        Step(INBOXED, ROUTING, log={"moved_to_archive": 2}, dest={"<m1@x>": "DEST", "<m2@x>": "ARCHIVE"}, total=3),
        Step(INBOXED, ROUTING, log={"moved_to_archive": 0}),
    ],
    "repair-adds-only": [
        Step(ONE, log={"copied": 1}, tags={"<m1@x>": []}),
        Step(ONE, {"labels_on": True}, manual_tags=[("<m1@x>", "mytag")], log={"tags_updated": 1},
             tags={"<m1@x>": ["mytag", "work"]}),
    ],
    "repair-moves-and-tags-at-once": [
        Step({**INBOXED, "Work": Folder((M2,))}, log={"copied": 3}),
        Step({**INBOXED, "Work": Folder((M2,))}, {**ROUTING, "labels_on": True},
             log={"moved_to_archive": 2, "tags_updated": 1}, dest={"<m2@x>": "ARCHIVE"}, tags={"<m2@x>": ["work"]}),
    ],
    "refused-tags-are-dropped": [
        Step({MAIN: Folder((M1,)), "Work": Folder((M1,)), "Home": Folder((M1,))},
             {"labels_on": True, "allowed_tags": "^home$"}, log={"copied": 1, "rejected_tags": 1}, tags={"<m1@x>": ["home"]}),
    ],
    "only-the-seen-flag": [
        Step({MAIN: Folder((msg(1, "<a@x>", flags=("\\Seen", "\\Deleted", "\\Recent", "custom")), msg(2, "<b@x>", flags=("\\Flagged",))))},
             flags={"<a@x>": ["\\Seen"], "<b@x>": []}),
    ],
    "no-flag-at-all": [
        Step({MAIN: Folder((msg(1, "<a@x>", flags=("\\Seen",)),))}, {"carry_seen": False}, flags={"<a@x>": []}),
    ],
    "vanished-folder-stays": [
        Step({**ONE, "Home": Folder((M1,))}, LABELS, tags={"<m1@x>": ["home", "work"]}),
        Step({MAIN: ONE[MAIN], "Home": Folder((M1,))}, LABELS, tags={"<m1@x>": ["home", "work"]}),
    ],
    "vanished-folder-is-swept": [
        Step({**ONE, "Home": Folder((M1,))}, {**LABELS, "sweep_missing_folders": True}, tags={"<m1@x>": ["home", "work"]}),
        Step({MAIN: ONE[MAIN], "Home": Folder((M1,))}, {**LABELS, "sweep_missing_folders": True},
             tags={"<m1@x>": ["home"]}),
    ],
    "repair-touches-foreign-records": [
        Step({MAIN: Folder((M1, M2)), "INBOX": Folder((M1,), epoch=70)}, ROUTING, foreign=[("f1", "DEST", "<m2@x>")],
             log={"copied": 1, "moved_to_archive": 1}),
    ],
    "repair-of-own-records-only": [
        Step({MAIN: Folder((M1, M2)), "INBOX": Folder((M1,), epoch=70)}, {**ROUTING, "managed_only": True},
             foreign=[("f1", "DEST", "<m2@x>")], log={"copied": 1, "moved_to_archive": 0}),
    ],
    "body-gone": [
        Step({MAIN: Folder((M1, msg(2, "<m2@x>", "")))}, log={"copied": 1, "missing_bodies": 1}, total=1),
    ],
}
ROUNDS = max(len(s) for s in STORIES.values())


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    """Every round once. Gives (story, step) -> (log row, destination rows, operations left)."""
    state = StateStore(spark, str(tmp_path_factory.mktemp("state")))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    out = {}
    for i in range(ROUNDS):
        live = {name: steps[i] for name, steps in STORIES.items() if i < len(steps)}
        _manual(spark, state, live)
        foreign = [(name, *row) for name, step in live.items() for row in step.foreign]
        tables = source(spark, {name: step.folders for name, step in live.items()}, foreign)
        specs = [spec(name, **step.rules) for name, step in live.items()]
        log = {r["mirror"]: r.asDict() for r in reconcile(spark, specs, tables, state, 1000 + i).collect()}
        rows = dest_rows(state)
        left = {r["mirror"] for r in state.pending().select("mirror").distinct().collect()}
        for name in live:
            out[name, i] = log[name], [r for r in rows if r["mirror"] == name], name in left
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    return out


def _manual(spark, state, live):
    moves = [(n, key, folder) for n, s in live.items() for key, folder in s.manual_moves]
    tags = [(n, key, tag) for n, s in live.items() for key, tag in s.manual_tags]
    if not moves and not tags:
        return
    ids = state.dest().select("mirror", "key", "copy_id", "folder")
    moved = spark.createDataFrame(moves or [("", "", "")], "mirror string, key string, target string")
    tagged = spark.createDataFrame(tags or [("", "", "")], "mirror string, key string, tag string")
    record_changes(
        state,
        ids.join(moved, ["mirror", "key"]).selectExpr("mirror", "copy_id", "key", "folder as from_folder", "target as folder"),
        ids.join(tagged, ["mirror", "key"]).selectExpr("mirror", "copy_id", "key", "tag", "'add' as op"),
    )


@pytest.mark.parametrize("name,i", [(n, i) for n, steps in STORIES.items() for i in range(len(steps))])
def test_story(results, name, i):
    step = STORIES[name][i]
    log, rows, left = results[name, i]
    assert {k: log[k] for k in step.log} == step.log
    if step.total is not None:
        assert len(rows) == step.total
    by_key = {r["key"]: r for r in rows}
    for key, folder in (step.dest or {}).items():
        assert by_key[key]["folder"] == folder
    for key, tags in (step.tags or {}).items():
        assert sorted(by_key[key]["tags"]) == tags
    for key, flags in (step.flags or {}).items():
        assert by_key[key]["flags"] == flags
    assert not left
