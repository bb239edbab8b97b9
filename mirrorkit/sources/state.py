"""State tables on shared storage, published one batch at a time.

Every pass writes its rows below ``<table>/batch_id=<n>/attempt=<id>`` and, last of all, one row in
``commits``. Readers see committed attempts only. An attempt that dies leaves files nobody reads,
and its replay writes under a new attempt id, so it can neither see nor overwrite the dead one's
rows. Nothing is updated in place: upserts are new rows, and views fold the logs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from mirrorkit.operators.changes import dest_current, queue_remaining
from mirrorkit.operators.dedup import among
from mirrorkit.operators.sequence import number_rows
from mirrorkit.schemas import STATE_TABLES, columns
from mirrorkit.session import remove, work_dir
from mirrorkit.sources.keyed import among_parts, lay_out, write_options

LAYOUT_VERSION = 4
COMMITS = columns("attempt string, members_base long, logs_base long, layout int, tag string, parts int, batch_id long")
# Tables small enough to be written whole by every batch: the newest batch is the state.
CURRENT_TABLES = ("folder_state", "folder_bands", "mirror_state", "missing_bodies")
# Logs that ``compact`` folds into one batch; those before it are not read again.
LOG_TABLES = ("ledger", "pending_ops", "applied_ops", "placement_log", "tag_log")
# Tables that are asked for keys: batches of ``LARGE_BATCH`` records and more, and folded ones, are laid out
# in ``KEY_PARTS`` parts by key.
KEYED_TABLES = ("ledger", "member_log", "dest_messages", "placement_log", "tag_log")
KEY_PARTS = 64
LARGE_BATCH = 1_000_000
# Up to so many batches are named in a filter, which prunes their directories; more are joined.
NAMED_BATCHES = 256


@dataclass(frozen=True)
class View:
    """What is committed: newest batch, where members and logs start, key parts, and the attempt of each batch."""

    last: int = 0
    members: int = 0
    logs: int = 0
    parts: int = 0
    attempts: tuple[tuple[int, str], ...] = ()


def _stored_schema(name: str) -> StructType:
    schema = StructType(list(STATE_TABLES[name].fields)).add("batch_id", LongType()).add("attempt", StringType())
    return schema.add("key_part", IntegerType()) if name in KEYED_TABLES else schema


class StateStore:
    """Reads and publishes the state below ``root``, which every executor must reach."""

    def __init__(
        self, spark: SparkSession, root: str, on_write: Callable[[str], None] | None = None,
        key_parts: int = KEY_PARTS, large_batch: int = LARGE_BATCH,
    ):
        self.spark, self.root, self.on_write = spark, root.rstrip("/"), on_write
        self.key_parts, self.large_batch = key_parts, large_batch
        self._during: View | None = None

    def commits(self) -> DataFrame:
        """One row per batch. Should two writers ever have published one batch, one of them counts."""
        rows = self._load(f"{self.root}/commits", COMMITS)
        rest = [c for c in COMMITS.names if c != "batch_id"]
        return rows.groupBy("batch_id").agg(F.min(F.struct(*rest)).alias("c")).select("c.*", "batch_id")

    def view(self) -> View:
        """What is committed now; while an attempt is open, what was committed when it began."""
        return self._during or self._look()

    def _look(self) -> View:
        rows = self._load(f"{self.root}/commits", COMMITS).collect()  # one row per batch
        if not rows:
            return View()
        won = {}
        for row in sorted(rows, key=lambda r: r["attempt"], reverse=True):
            won[row["batch_id"]] = row
        top = won[max(won)]
        for layout in {row["layout"] for row in won.values()} - {LAYOUT_VERSION}:
            age = "newer" if layout > LAYOUT_VERSION else "older"
            raise ValueError(f"state layout {layout} is {age} than {LAYOUT_VERSION}; refusing to use it")
        parts = max(row["parts"] for row in won.values())
        return View(top["batch_id"], top["members_base"], top["logs_base"], parts, tuple(sorted((n, r["attempt"]) for n, r in won.items())))

    def last(self) -> tuple[int, int]:
        """Newest committed batch and the batch its member rows start at; (0, 0) for a new state."""
        now = self._look()
        return now.last, now.members

    def is_committed(self, batch_id: int) -> bool:
        return not self.commits().filter(F.col("batch_id") == batch_id).isEmpty()

    def has_tag(self, tag: str) -> bool:
        """Whether a batch with this tag (say, one epoch of a stream) is committed."""
        return not self.commits().filter(F.col("tag") == tag).isEmpty()

    def read(self, table: str, keys: DataFrame | None = None, since: int = 0) -> DataFrame:
        """Committed rows of a table with their ``batch_id``; of a log, those since it was last folded.

        With ``keys`` only rows of those keys, and only batches from ``since`` on.
        """
        now = self.view()
        least = max(since, now.logs if table in LOG_TABLES else 0)
        rows = self._load(f"{self.root}/{table}", _stored_schema(table)).filter(F.col("batch_id") >= least)
        asked = [(n, attempt) for n, attempt in now.attempts if n >= least]
        if len(asked) <= NAMED_BATCHES:
            rows = rows.filter(F.col("attempt").isin([attempt for _, attempt in asked]) if asked else F.lit(False))
        else:
            rows = rows.join(self.commits().select("batch_id", "attempt"), ["batch_id", "attempt"], "left_semi")
        rows = rows.drop("attempt")
        if table not in KEYED_TABLES:
            return among(rows, keys)
        return rows.drop("key_part") if keys is None else among_parts(rows, keys, now.parts)

    def read_batch(self, table: str, batch_id: int) -> DataFrame:
        """Committed rows of one batch; the filter prunes the other directories."""
        return self.read(table, since=batch_id).filter(F.col("batch_id") == batch_id)

    def members(
        self, extra: DataFrame | None = None, keys: DataFrame | None = None, cut: Callable[[DataFrame], DataFrame] | None = None,
    ) -> DataFrame:
        """Member rows as of the last commit, or with ``extra`` log rows applied on top.

        With ``keys``, or a ``cut`` by mirror, folder, key and uid, the log is cut before it is folded.
        """
        log = self.read("member_log", keys, self.view().members)
        if extra is not None:
            log = log.unionByName(among(extra.select(*log.columns), keys))
        return fold_members(log if cut is None else cut(log))

    def pending(self) -> DataFrame:
        """Operations queued and not yet applied."""
        return queue_remaining(self.read("pending_ops"), self.read("applied_ops"))

    def dest(
        self, foreign: DataFrame | None = None, keys: DataFrame | None = None,
        placement_extra: DataFrame | None = None, tag_extra: DataFrame | None = None,
    ) -> DataFrame:
        """Current destination without bodies: committed copies plus ``foreign`` records.

        With ``keys``, records and logs are cut to those keys before they are joined, so a small
        pass reads the tables but shuffles only what it asks for.
        """
        described = [c for c in STATE_TABLES["dest_messages"].names if c != "raw"]
        records = self.read("dest_messages", keys).select(*described, F.lit(True).alias("managed"))
        if foreign is not None:
            records = records.unionByName(among(foreign.select(*described, F.lit(False).alias("managed")), keys))
        moves, tags = self.read("placement_log", keys), self.read("tag_log", keys)
        if placement_extra is not None:
            moves = moves.unionByName(among(placement_extra.select(*moves.columns), keys))
        if tag_extra is not None:
            tags = tags.unionByName(among(tag_extra.select(*tags.columns), keys))
        return dest_current(records, moves, tags)

    def begin(self, batch_id: int | None = None) -> Attempt:
        self._during = None
        now = self._during = self._look()
        return Attempt(self, now.last + 1 if batch_id is None else batch_id, now.last, now.members, now.logs, now.parts)

    def compact(self) -> int:
        """Fold members, ledger, queue and logs into one batch and return its number.

        Nothing a reader sees changes. Passes after it read this batch and what follows, however
        many batches there were before. Copies themselves are never rewritten.
        """
        attempt = self.begin()
        attempt.lay_out()
        attempt.write("member_log", self.members().withColumn("op", F.lit("add")))
        attempt.write("ledger", self.read("ledger"))
        # Numbers are unique within a batch only, so the queue is numbered anew, in its order.
        queue = self.pending().withColumnRenamed("seq", "old_seq")
        attempt.write("pending_ops", number_rows(queue, ["mirror"], ["batch_id", "old_seq"]))
        for table, by in (("placement_log", ["mirror", "copy_id"]), ("tag_log", ["mirror", "copy_id", "low"])):
            rows = self.read(table)
            rows = rows.withColumn("low", F.lower("tag")) if "low" in by else rows
            rest = [c for c in STATE_TABLES[table].names if c not in by]
            newest = F.max(F.struct("batch_id", *sorted(rest, key=lambda c: c != "seq"))).alias("r")
            attempt.write(table, rows.groupBy(*by).agg(newest).select(*by, "r.*"))
        attempt.carry(*CURRENT_TABLES)
        attempt.commit(members_base=attempt.batch_id, logs_base=attempt.batch_id)
        return attempt.batch_id

    def vacuum(self) -> int:
        """Delete what no reader can reach any more and return the number of folders deleted: logs from
        before they were folded, older versions of whole-state tables, and attempts that lost.

        Not while another writer is at work: its attempt is not committed yet.
        """
        now = self._look()
        winners = set(now.attempts)
        least = {**dict.fromkeys(LOG_TABLES, now.logs), "member_log": now.members, **dict.fromkeys(CURRENT_TABLES, now.last)}
        gone = 0
        for table in STATE_TABLES:
            for batch, attempt, path in self._attempts(table):
                if (batch, attempt) not in winners or batch < least.get(table, 0):
                    remove(self.spark, path)
                    gone += 1
        return gone

    def _attempts(self, table: str) -> list[tuple[int, str, str]]:
        """(batch, attempt, path) of every attempt's folder of a table: one entry per pass, no rows."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        store = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = store.globStatus(jvm.org.apache.hadoop.fs.Path(root, "batch_id=*/attempt=*")) or []
        out = []
        for status in found:
            path = status.getPath()
            batch, attempt = path.getParent().getName(), path.getName()
            out.append((int(batch.split("=")[1]), attempt.split("=")[1], path.toString()))
        return out

    def _load(self, path: str, schema: StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            # A constant false filter lets the optimizer drop the joins an empty table takes part in.
            nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
            return self.spark.range(1).select(*nulls).filter(F.lit(False))


class Attempt:
    """One try at one batch. Its rows become visible all together, or never."""

    def __init__(self, store: StateStore, batch_id: int, last: int, base: int, logs: int = 0, parts: int = 0):
        self.store, self.batch_id, self.last, self.base, self.logs = store, batch_id, last, base, logs
        self._known_parts, self.parts = parts, 0
        self.name = f"a{uuid.uuid4().hex}"
        self._scratch = work_dir(store.spark, "scratch")

    def lay_out(self) -> None:
        """From here on this attempt's rows are laid out by key, in as many parts as those of the batches before."""
        self.parts = self._known_parts or self.store.key_parts

    def write(self, table: str, rows: DataFrame) -> DataFrame:
        """Write this attempt's rows of a state table and read them back.

        Files are sorted by mirror and key where there is one, so later reads can skip row groups.
        """
        path = f"{self.store.root}/{table}/batch_id={self.batch_id}/attempt={self.name}"
        names = STATE_TABLES[table].names
        rows = rows.select(*names)
        if table in KEYED_TABLES:
            out = lay_out(rows, self.parts).write.options(**write_options(self.parts)).partitionBy("key_part")
        else:
            order = [c for c in ("mirror", "key", "folder") if c in names]
            out = (rows.sortWithinPartitions(*order) if order else rows).write
        out.mode("overwrite").parquet(path)
        if self.store.on_write:
            self.store.on_write(table)
        return self.written(table)

    def written(self, table: str) -> DataFrame:
        """What this attempt wrote, with its ``batch_id``; empty when it had nothing to write."""
        path = f"{self.store.root}/{table}/batch_id={self.batch_id}/attempt={self.name}"
        rows = self.store._load(path, STATE_TABLES[table]).select(*STATE_TABLES[table].names)
        return rows.withColumn("batch_id", F.lit(self.batch_id).cast("long"))

    def scratch(self, name: str, rows: DataFrame) -> DataFrame:
        """Write an intermediate result to the shared folder and read it back.

        This cuts the lineage, survives a lost executor, and gives the optimizer a true size, by
        which it decides whether the result may be broadcast.
        """
        path = f"{self._scratch}/{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.store.spark.read.schema(rows.schema).parquet(path)

    def carry(self, *tables: str) -> None:
        """Write the last version of whole-state tables again under this batch."""
        for table in tables:
            self.write(table, self.store.read_batch(table, self.last))

    def commit(
        self, members_base: int | None = None, layout: int = LAYOUT_VERSION, tag: str = "", logs_base: int | None = None,
    ) -> None:
        """Publish the attempt by one row, written last, in a folder of the batch that must not exist yet.

        Storage without an atomic create leaves a moment in which two writers may both publish. Readers
        then agree on one of them, and the other one is told here.
        """
        taken = ValueError(f"batch {self.batch_id} is already committed")
        self.store._during = None
        if self.store.is_committed(self.batch_id):
            raise taken
        base = self.base if members_base is None else members_base
        logs = self.logs if logs_base is None else logs_base
        row = self.store.spark.sql(
            f"select '{self.name}' attempt, cast({base} as long) members_base, cast({logs} as long) logs_base, "
            f"{layout} layout, '{tag}' tag, {self.parts} parts"
        ).coalesce(1)
        path = f"{self.store.root}/commits/batch_id={self.batch_id}"
        try:
            row.write.mode("error").parquet(path)
        except AnalysisException as found:
            if found.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            if self.store.is_committed(self.batch_id):
                raise taken from None
            row.write.mode("append").parquet(path)  # a writer died here before it published anything
        won = self.store.commits().filter(F.col("batch_id") == self.batch_id).first()
        if won is None or won["attempt"] != self.name:
            raise taken
        remove(self.store.spark, self._scratch)


def fold_members(log: DataFrame) -> DataFrame:
    """Member rows that are present after a log: the last batch decides, an addition beats a removal in it."""
    row = ["mirror", "folder", "key", "uid"]
    rank = F.col("batch_id") * 2 + (F.col("op") == "add").cast("long")
    return (
        log.groupBy(*row).agg(F.max(rank).alias("_rank"), F.max("is_synth").alias("is_synth"))
        .filter(F.col("_rank") % 2 == 1).drop("_rank")
    )
