"""Copy records as they arrive, with the ledger as the memory of what was copied."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from mirrorkit.functions.keys import with_key
from mirrorkit.operators.routing import resolve_specs
from mirrorkit.plans.ingest import source_spans
from mirrorkit.plans.reconcile import DESCRIBED, copy_records, pass_log
from mirrorkit.sources.state import Attempt, StateStore
from mirrorkit.sources.tables import RECORD, within_spans
from mirrorkit.spec import MirrorSpec, specs_frame
from mirrorkit.streaming.progress import ProgressLog, observed

# A table, or a function that reads it: a stream asks a function again for every batch, so it sees what
# the source has become since it started.
Live = DataFrame | Callable[[], DataFrame]


def current(table: Live | None) -> DataFrame | None:
    return table() if callable(table) else table


def read_arrivals(spark: SparkSession, path: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    """Stream over a growing folder of Parquet files. ``max_files`` bounds one batch, as a scan window does."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def with_trigger(writer: DataStreamWriter, specs: Iterable[MirrorSpec], once: bool = False) -> DataStreamWriter:
    """Poll at the shortest interval any mirror asks for, or take what is there and stop.

    One query runs its batches one after another, so passes never overlap.
    """
    if once:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=f"{min(s.trigger_seconds() for s in specs)} seconds")


def ingest_batch(
    spark: SparkSession, specs: list[MirrorSpec], batch: DataFrame, tag: str, state: StateStore,
    bodies: DataFrame, now: int, foreign: DataFrame | None = None, folders: DataFrame | None = None,
    status: DataFrame | None = None, messages: DataFrame | None = None,
) -> None:
    """Copy one batch of arrivals under ``tag``. A replay of a committed tag does nothing.

    The rules are those of a pass: only records of a mirror's source folder are copied, role selectors
    are looked up in the ``folders`` listing, and with a ``status`` table only records of the current
    epoch count. Marks and the rule fingerprint stay as the last pass left them, since a stream sees
    what arrives and not what lies below it; the ledger keeps what it copied from being copied again.

    With ``messages``, the source's own records, a new epoch of a source folder is met as a pass meets
    it: all its records become candidates, those that arrived before the change was seen included, and
    the mark moves to the top of what was read. The first epoch ever seen is only noted.
    Memberships are those of the last snapshot pass; a later pass moves and tags what has changed since.
    """
    if state.has_tag(tag):
        return
    attempt = state.begin()
    rules = attempt.scratch("specs", _resolved(specs_frame(spark, specs), specs, folders))
    # A file delivered twice brings the same records twice.
    arrived = batch.drop("raw").join(
        rules.select("mirror", F.col("source_folder").alias("folder")), ["mirror", "folder"], "left_semi"
    )
    if status is not None:
        arrived = arrived.join(status.select("mirror", "folder", "epoch"), ["mirror", "folder", "epoch"], "left_semi")
    before = state.read_batch("mirror_state", attempt.last).drop("batch_id")
    spans = None
    if messages is not None:
        if status is None:
            raise ValueError("a stream that follows epochs needs the status of its folders")
        spans = attempt.scratch("spans", source_spans(rules, status, before))
        renewed = attempt.scratch("renewed", spans.filter("epoch_changed"))
        if not renewed.isEmpty():
            again = within_spans(messages, renewed)
            arrived = arrived.unionByName(again.select(*arrived.columns))
    keyed = with_key(arrived.dropDuplicates(RECORD), specs).select(*RECORD, "key", "is_synth", *DESCRIBED)
    records = attempt.scratch("records", keyed)
    waiting = state.read_batch("missing_bodies", attempt.last).select(*RECORD, "key")
    plan = copy_records(attempt, rules, records, bodies, _members(state), foreign, now, waiting=waiting)
    attempt.carry("folder_state", "folder_bands")
    attempt.write("mirror_state", _marks(before, records, spans, now))
    if spans is None:
        spans = rules.select("mirror", F.lit(False).alias("epoch_changed"))
    none = attempt.written("placement_log"), attempt.written("tag_log"), attempt.written("applied_ops")
    attempt.write("run_log", pass_log(attempt, rules, spans, plan, *none))
    attempt.commit(tag=tag)


def _resolved(rules: DataFrame, specs: list[MirrorSpec], folders: DataFrame | None) -> DataFrame:
    if folders is not None:
        return resolve_specs(rules, folders)
    roles = [s.mirror for s in specs if s.source_folder.startswith("\\") or (s.sent_on and s.sent_source.startswith("\\"))]
    if roles:
        raise ValueError(f"mirrors {roles} name folders by role: the stream needs the folder listing")
    return rules


def _members(state: StateStore) -> Callable[[DataFrame | None], DataFrame]:
    return lambda keys: state.members(keys=keys)


def _marks(before: DataFrame, records: DataFrame, spans: DataFrame | None, now: int) -> DataFrame:
    """Marks and fingerprints; mirrors that had records get a new heartbeat.

    A mirror whose source folder was read again has its mark at the top of it. One that had no epoch
    gets it with a mark of zero, as nothing below the arrivals was seen. All others stay as they are.
    """
    beats = records.select("mirror").distinct().withColumn("_now", F.lit(now).cast("long"))
    rows = before.join(beats, "mirror", "full").withColumn("heartbeat", F.coalesce("_now", "heartbeat")).drop("_now")
    if spans is None:
        return rows
    seen = spans.select("mirror", F.col("epoch").alias("_epoch"), "epoch_changed", "_to")
    first = F.col("epoch").isNull()
    return rows.join(seen, "mirror", "full").withColumns({
        "last_uid": F.when(F.col("epoch_changed"), F.col("_to")).when(first & F.col("_epoch").isNotNull(), 0)
        .otherwise(F.col("last_uid")),
        "epoch": F.when(F.col("epoch_changed") | first, F.col("_epoch")).otherwise(F.col("epoch")),
    }).select(*rows.columns)


def start_ingest(
    arrivals: DataFrame, specs: list[MirrorSpec], state: StateStore, checkpoint: str, name: str = "ingest",
    bodies: Live | None = None, foreign: Live | None = None, once: bool = False,
    clock: Callable[[], float] = time.time, folders: Live | None = None, status: Live | None = None,
    progress: bool = False, messages: Live | None = None,
) -> StreamingQuery:
    """Stream arrivals into the mirror.

    Deduplication asks the ledger, so its horizon has no bound and needs no state store. Without a
    ``bodies`` table the arrivals carry their own ``raw``. Tables may be functions, which are asked again
    for every batch: a listing or status that changes while the stream runs has to be one. With
    ``messages`` the stream follows new epochs (see ``ingest_batch``) and needs ``bodies`` and ``status``.
    ``progress`` writes a report of every batch below the state root.
    """
    if messages is not None and (bodies is None or status is None):
        raise ValueError("a stream that follows epochs needs the tables of bodies and of folder status")
    _resolved(specs_frame(arrivals.sparkSession, specs), specs, current(folders))
    if progress:
        arrivals.sparkSession.streams.addListener(ProgressLog(arrivals.sparkSession, f"{state.root}/progress"))

    def handle(batch: DataFrame, epoch: int) -> None:
        own = current(bodies)
        if own is None:
            own = batch.select(*RECORD, "raw").dropDuplicates(RECORD)
        ingest_batch(
            batch.sparkSession, specs, batch, f"{name}:{epoch}", state, own, int(clock()), current(foreign),
            current(folders), current(status), current(messages),
        )

    if progress:
        arrivals = observed(arrivals, "arrivals")
    writer = arrivals.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(handle)
    return with_trigger(writer, specs, once).start()


def dedup_within(arrivals: DataFrame, horizon: str, time_column: str = "internal_date") -> DataFrame:
    """Bounded alternative for streams whose duplicates come close together: a key is remembered for
    ``horizon`` of event time only. Later duplicates pass, so the ledger stays the authority."""
    keyed = with_key(arrivals)
    return keyed.withWatermark(time_column, horizon).dropDuplicatesWithinWatermark(["mirror", "key"])
