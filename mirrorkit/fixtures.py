"""Views over the test tables that give every operator an input of its kind.

``events`` plays the mailbox: an event is a record, its type the folder it lies in, and four
mirrors share the table. State left by earlier passes is cut out of it by date. Views are lazy; the
few that others build on are kept per session, so their plans are analysed once.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorkit.functions.keys import with_key
from mirrorkit.spec import MirrorSpec, specs_frame

# Ends of earlier passes: what the ledger, the destination and the stored members have seen.
LEDGER_END, DEST_END, OLD_END, NEW_START, HALF = "2024-01-07", "2024-01-10", "2024-01-21", "2024-01-11", "2024-01-16"
# Days that streams are cut at: the first of all, that of the newest arrivals, and one after the last.
FIRST_DAY, LATE_START, CLOSING = "2024-01-01", "2024-01-25", "2030-01-01"

# The four combinations of the routing switches.
SPECS = (
    MirrorSpec("m0", "All", "view", "Mirror", archive_on=True, sent_on=True, sent_source="purchase",
               labels_on=True, propagate=True, poll_seconds=600),
    MirrorSpec("m1", "All", "view", "Mirror", archive_on=True, sent_source="purchase", labels_on=True,
               keyword_prefix="$label:", keyword_replacement="-", dest_guard=False, poll_seconds=300),
    MirrorSpec("m2", "All", "view", "Mirror", sent_on=True, sent_source="purchase", labels_on=True, propagate=True,
               keyword_prefix="$label:", allowed_tags="^\\$label:[a-d]", uid_batch=500, poll_seconds=60),
    MirrorSpec("m3", "All", "view", "Mirror", sent_source="purchase", labels_on=True, propagate=True,
               label_exclude=("signup",), carry_seen=False, uid_batch=1000),
)
# The rules an earlier release ran under: two mirrors changed since.
OLD_SPECS = (
    SPECS[0],
    MirrorSpec("m1", "All", "view", "Mirror", sent_source="purchase", labels_on=True, keyword_prefix="$label:",
               keyword_replacement="-"),
    MirrorSpec("m2", "All", "view", "Mirror", sent_on=True, sent_source="purchase", labels_on=True, propagate=True),
    SPECS[3],
)


@lru_cache(maxsize=64)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=64)
def specs(spark: SparkSession) -> DataFrame:
    return specs_frame(spark, SPECS)


def day(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


@lru_cache(maxsize=64)
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with repeated, missing and padded ids and non-ASCII subjects."""
    return messages_of(table(spark, sf_dir, "events"))


def messages_of(events: DataFrame) -> DataFrame:
    """The record view of an event table; batch and streaming reads share it."""
    number = F.regexp_extract("props", "([0-9]+)", 1)
    user = F.col("user_id").cast("string")
    return events.select(
        F.coalesce(F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")), F.lit("")).alias("mirror"),
        F.col("event_type").alias("folder"),
        F.when(F.col("user_id") % 4 == 2, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("epoch"),
        (F.col("event_id") + 1).alias("uid"),
        F.when(F.col("event_id") % 20 == 0, "").otherwise(
            F.concat(F.lit("  <u"), user, F.lit("."), number, F.lit("@ev> "))
        ).alias("message_id"),
        F.concat(F.lit("user"), user).alias("sender"),
        F.concat(F.lit("é "), "event_type").alias("subject"),
        F.col("ts").alias("internal_date"),
        F.length("props").cast("long").alias("size"),
        F.array_compact(F.array(
            F.when(F.col("value") >= 10, "\\Seen"), F.when(F.col("value") < 5, "\\Flagged"), F.lit("$Junk")
        )).alias("flags"),
        "value",
    )


@lru_cache(maxsize=64)
def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_key(messages(spark, sf_dir))


def before(df: DataFrame, date: str) -> DataFrame:
    return df.filter(F.col("internal_date") < day(date))


def since(df: DataFrame, date: str) -> DataFrame:
    return df.filter(F.col("internal_date") >= day(date))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys earlier passes recorded."""
    rows = before(keyed(spark, sf_dir), LEDGER_END)
    seconds = F.unix_seconds(F.col("internal_date").cast("timestamp"))
    return rows.groupBy("mirror", "key").agg(F.min("uid").alias("uid"), F.min(seconds).alias("copied_at"))


def dated(rows: DataFrame) -> DataFrame:
    """Records with their date as the time of copying."""
    return rows.withColumn("copied_at", F.unix_seconds(F.col("internal_date").cast("timestamp")))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record as a member of its folder."""
    return keyed(spark, sf_dir).select("mirror", "folder", "key", "is_synth", "uid")


def members_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return before(keyed(spark, sf_dir), OLD_END).select("mirror", "folder", "key", "is_synth", "uid")


def members_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return since(keyed(spark, sf_dir), NEW_START).select("mirror", "folder", "key", "is_synth", "uid")


def dest_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys the destination holds: some more than the ledger knows of."""
    return before(keyed(spark, sf_dir), DEST_END).select("mirror", "key")


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destination records: misplaced, refiled outside all buckets, doubled or missing ones among them."""
    rows = keyed(spark, sf_dir)
    half = F.when(F.col("internal_date") < day(HALF), 1).otherwise(2)
    least = F.col("least")
    return (
        rows.groupBy("mirror", "key", half.alias("half")).agg(
            F.min("uid").alias("least"), F.max("is_synth").alias("is_synth"))
        .select(
            "mirror", "key", "is_synth", least.cast("string").alias("copy_id"),
            F.when(least % 4 == 0, "Mirror").when(least % 4 == 1, "Sent").when(least % 4 == 2, "Archive")
            .otherwise("Custom").alias("folder"),
            F.when(least % 2 == 0, F.array(F.lit("Click"), F.lit("mytag"))).otherwise(
                F.array().cast("array<string>")).alias("tags"),
        )
    )


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder listing in order of first record, with role folders beside the plain ones."""
    rows = messages(spark, sf_dir).select("mirror", "folder", "uid")
    none = F.lit("\\HasNoChildren")
    plain = rows.withColumn("role", F.when(F.col("folder") == "purchase", "\\Sent"))
    role = (
        F.when(F.col("folder") == "view", "\\All").when(F.col("folder") == "click", "\\Trash")
        .when(F.col("folder") == "error", "\\Sent").when(F.col("folder") == "purchase", "\\Important")
    )
    roles = rows.withColumn("role", role).withColumn("folder", F.concat(F.lit("[Mail]/"), "folder"))
    return (
        plain.unionByName(roles).groupBy("mirror", "folder", "role").agg(F.min("uid").alias("list_pos"))
        .select("mirror", "folder", F.array_compact(F.array(none, F.col("role"))).alias("attrs"), "list_pos")
    )


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership events in order: a small value takes the record out of the folder, others put it in."""
    return keyed(spark, sf_dir).select(
        "mirror", "folder", "key", "is_synth", "uid", F.col("uid").alias("seq"), "internal_date", "value",
        F.when(F.col("value") < 15, "remove").otherwise("add").alias("op"),
    )


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations caused by those events, one batch per day."""
    kind = F.when(F.col("folder").isin("view", "purchase"), "move").otherwise("keyword")
    return change_log(spark, sf_dir).select(
        "mirror", F.dayofmonth("internal_date").cast("long").alias("batch_id"), "seq", kind.alias("kind"),
        "key", "folder", "op", "value",
    )


def raw_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw messages with a folded id line and a body that has blank lines."""
    end = F.lit("\r\n")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(
        F.lit("Message-ID:"), end, F.lit(" <"), conv, F.lit("."), turn, F.lit("@c>"), end,
        F.lit("From: "), "role", F.lit("@example.com"), end, F.lit("Subject: turn "), turn, end, end, "text",
    ).alias("raw"))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of all records in the main folder; some are empty."""
    return messages(spark, sf_dir).select("mirror", F.lit("All").alias("folder"), "epoch", "uid", body().alias("raw"))


def body() -> Column:
    return F.when(F.col("value") < 2, "").otherwise(
        F.concat(F.lit("From: "), "sender", F.lit("\r\nSubject: "), "subject", F.lit("\r\n\r\n"), "message_id")
    )


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the main folder with their bodies."""
    text = F.concat(F.lit("From: "), "sender", F.lit("\r\nSubject: "), "subject", F.lit("\r\n\r\n"), "message_id")
    return messages(spark, sf_dir).withColumns({"folder": F.lit("All"), "raw": text}).drop("value")


def beside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records in their other folders, under uids and with bodies that must not be taken for those of the main one."""
    rows = messages(spark, sf_dir).drop("value")
    return rows.withColumns({"uid": F.col("uid") % 7 + 1, "raw": F.lit("other")})


def daily_files(rows: DataFrame, path: str) -> str:
    """One Parquet file per day of ``internal_date``, as a stream would find them, and more where a day is large.

    Rows are dealt out by day first: written as they lie, every task would leave a file for every day. Adaptive
    execution splits a day that is too much for one task.
    """
    rows.withColumn("day", F.to_date("internal_date")).hint("rebalance", F.col("day")).write.partitionBy("day").parquet(path)
    return path


def mailbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main folder with every record, and beside it one folder per event type holding the same records."""
    rows = messages(spark, sf_dir).drop("value")
    return rows.withColumn("folder", F.lit("All")).unionByName(rows)


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder listing of that mailbox."""
    main = specs(spark).select(
        "mirror", F.lit("All").alias("folder"), F.array(F.lit("\\All")).alias("attrs"), F.lit(-1).cast("long").alias("list_pos")
    )
    return folders(spark, sf_dir).unionByName(main)


def foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destination records of other origin, one for each of ``dest_keys``."""
    none = F.array().cast("array<string>")
    rows = before(keyed(spark, sf_dir), DEST_END)
    return rows.groupBy("mirror", "key").agg(F.min("uid").alias("uid"), F.max("is_synth").alias("is_synth")).select(
        "mirror", F.concat(F.lit("f"), F.col("uid").cast("string")).alias("copy_id"), F.lit("Mirror").alias("folder"),
        "key", "is_synth", "uid", F.lit("").alias("sender"), F.lit("").alias("subject"),
        F.lit(None).cast("timestamp").alias("internal_date"), F.lit(0).cast("long").alias("size"),
        none.alias("flags"), none.alias("tags"),
    )


def label_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard label strings."""
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit("["), "p_name", F.lit("]/"), "p_brand", F.lit(" Bü")).alias("label"), "p_type"
    )
