"""Small mailboxes for story tests: every story is one mirror, all stories share each pass."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from mirrorkit.plans.reconcile import Source
from mirrorkit.schemas import BODIES, FOLDER_STATUS, FOLDERS, MESSAGES, STATE_TABLES
from mirrorkit.sources.state import StateStore
from mirrorkit.spec import MirrorSpec

MAIN = "All"
BASE = datetime(2026, 1, 1, tzinfo=UTC)


def msg(uid: int, mid: str, raw: str | None = None, flags: tuple[str, ...] = (), sender="a@x", subject="s") -> dict:
    raw = f"raw-{mid or uid}" if raw is None else raw
    return {"uid": uid, "message_id": mid, "raw": raw, "flags": list(flags), "sender": sender, "subject": subject,
            "internal_date": BASE + timedelta(minutes=uid), "size": len(raw)}


@dataclass(frozen=True)
class Folder:
    msgs: tuple[dict, ...] = ()
    epoch: int = 7
    attrs: tuple[str, ...] = ()


@dataclass
class Step:
    """State of one mirror before a pass, and what the pass should leave."""

    folders: dict[str, Folder]
    rules: dict = field(default_factory=dict)
    foreign: list[tuple[str, str, str]] = field(default_factory=list)  # copy_id, folder, key
    manual_moves: list[tuple[str, str]] = field(default_factory=list)  # key, folder
    manual_tags: list[tuple[str, str]] = field(default_factory=list)  # key, tag
    log: dict[str, int | bool] = field(default_factory=dict)
    dest: dict[str, str] | None = None  # key -> folder
    tags: dict[str, list[str]] | None = None  # key -> tags
    flags: dict[str, list[str]] | None = None  # key -> flags
    total: int | None = None


def spec(mirror: str, **rules) -> MirrorSpec:
    base = {"source_folder": MAIN, "dest_folder": "DEST", "archive_folder": "ARCHIVE", "sent_folder": "SENT-DEST",
            "sent_source": "SENTSRC", "seed": "never"}
    return MirrorSpec(mirror, **{**base, **rules})


def frame(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    """A local relation: no Python worker reads it."""
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    arrow = to_arrow_schema(schema)
    return spark.createDataFrame(pa.table([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow))


def source(spark: SparkSession, mailboxes: dict[str, dict[str, Folder]], foreign=()) -> Source:
    """Tables of all mailboxes. ``foreign`` lists (mirror, copy_id, folder, key)."""
    listing, status, messages, bodies = [], [], [], []
    for mirror, folders in mailboxes.items():
        for pos, (name, folder) in enumerate(folders.items()):
            top = max((m["uid"] for m in folder.msgs), default=0)
            listing.append((mirror, name, list(folder.attrs), pos))
            status.append((mirror, name, folder.epoch, top + 1, len(folder.msgs)))
            for m in folder.msgs:
                row = {"mirror": mirror, "folder": name, "epoch": folder.epoch, **m}
                messages.append(tuple(row[c] for c in MESSAGES.names))
                bodies.append((mirror, name, folder.epoch, m["uid"], m["raw"]))
    theirs = None
    if foreign:
        rows = [(mirror, copy, folder, key, False, 0, "", "", None, 0, [], [], "") for mirror, copy, folder, key in foreign]
        theirs = frame(spark, rows, STATE_TABLES["dest_messages"])
    return Source(
        frame(spark, messages, MESSAGES), frame(spark, bodies, BODIES),
        frame(spark, listing, FOLDERS), frame(spark, status, FOLDER_STATUS), theirs,
    )


def dest_rows(state: StateStore, foreign=None) -> list:
    return state.dest(foreign).select("mirror", "copy_id", "key", "folder", "tags", "flags").collect()


def with_msgs(folders: dict[str, Folder], name: str, *msgs: dict, **changes) -> dict[str, Folder]:
    """The same folders with one of them holding other records."""
    old = folders.get(name, Folder())
    return {**folders, name: dataclasses.replace(old, msgs=tuple(msgs), **changes)}
