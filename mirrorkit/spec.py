"""Settings of one mirror, and the settings of all mirrors as a table."""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SEED_MODES = ("empty", "always", "never")
_NAME = re.compile(r"^[A-Za-z0-9][A-Za-z0-9_-]*$")
_KEYWORD_CHAR = re.compile(r"^[A-Za-z0-9_-]$")


@dataclass(frozen=True)
class MirrorSpec:
    """What one mirror copies, where it puts it and how it tags it.

    ``source_folder`` and ``sent_source`` may be a folder name or a role selector that
    starts with a backslash; ``resolve_folders`` turns selectors into names.
    """

    mirror: str
    source_folder: str = "INBOX"
    inbox: str = "INBOX"
    dest_folder: str = "INBOX"
    archive_on: bool = False
    archive_folder: str = "Archive"
    sent_on: bool = False
    sent_source: str = "\\Sent"
    sent_folder: str = "Sent"
    labels_on: bool = False
    propagate: bool = False
    label_exclude: tuple[str, ...] = ()
    keyword_prefix: str = ""
    keyword_replacement: str = "_"
    uid_batch: int = 2000
    seed: str = "empty"
    dest_guard: bool = True
    carry_seen: bool = True
    poll_seconds: int = 15 * 60
    idle_seconds: int = 25 * 60
    # A destination that refuses free-form tags: only tags matching this are kept.
    allowed_tags: str | None = None
    # Restrict repair to copies this toolkit made (False: every destination record).
    managed_only: bool = False
    # Emit removals for folders that left the listing (False: memberships stay).
    sweep_missing_folders: bool = False
    # SQL expression giving the native id where ``message_id`` is not it.
    key_expr: str | None = None

    def __post_init__(self) -> None:
        problems = list(self._problems())
        if problems:
            raise ValueError(f"mirror {self.mirror!r}: " + "; ".join(problems))

    def _problems(self) -> Iterable[str]:
        if not _NAME.match(self.mirror or ""):
            yield "name must be letters, digits, _ or -"
        if self.seed not in SEED_MODES:
            yield f"seed must be one of {', '.join(SEED_MODES)}"
        if self.propagate and not self.labels_on:
            yield "propagate requires labels_on"
        if not _KEYWORD_CHAR.match(self.keyword_replacement):
            yield "keyword_replacement must be one character of [A-Za-z0-9_-]"
        buckets = self.buckets()
        if len(set(buckets)) != len(buckets):
            yield f"bucket names must differ, got {buckets}"
        if self.uid_batch < 1:
            yield "uid_batch must be >= 1"
        if self.poll_seconds < 1 or self.idle_seconds < 1:
            yield "intervals must be >= 1 second"

    def buckets(self) -> list[str]:
        """Destination folders a copy may live in, in lookup order."""
        found = [self.dest_folder]
        if self.sent_on:
            found.append(self.sent_folder)
        if self.archive_on:
            found.append(self.archive_folder)
        return found

    def trigger_seconds(self) -> int:
        """Seconds between two passes when nothing arrives: the shorter interval wins."""
        return min(self.poll_seconds, self.idle_seconds)


_ARROW = {"str": pa.string(), "str | None": pa.string(), "bool": pa.bool_(), "int": pa.int64(),
          "tuple[str, ...]": pa.list_(pa.string())}
_ARROW_SCHEMA = pa.schema([(f.name, _ARROW[f.type]) for f in dataclasses.fields(MirrorSpec)])


def specs_frame(spark: SparkSession, specs: Iterable[MirrorSpec]) -> DataFrame:
    """One row per mirror.

    Built from an Arrow table, so the optimizer knows its size and broadcasts it only while
    it is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    rows = [dataclasses.asdict(s) for s in specs]
    names = [r["mirror"] for r in rows]
    if not rows:
        raise ValueError("at least one mirror is required")
    if len(set(names)) != len(names):
        raise ValueError(f"duplicate mirror names: {sorted(names)}")
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=_ARROW_SCHEMA))
