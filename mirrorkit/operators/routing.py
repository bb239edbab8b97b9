"""Folder roles, buckets and tags of a key, derived from the folders it is in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorkit.functions.tags import keywords, no_strings

# Attributes that make a folder a mailbox role instead of a label.
ROLE_ATTRS = (
    "\\Noselect", "\\NonExistent", "\\All", "\\Archive", "\\Drafts",
    "\\Flagged", "\\Junk", "\\Sent", "\\Trash", "\\Important",
)


def resolve_folder(folders: DataFrame, wanted: DataFrame, selector: str, strict: bool = True) -> DataFrame:
    """Resolve a column of folder selectors against the folder listing.

    ``wanted`` has ``mirror`` and the selector column. A selector that starts with a backslash is
    the first listed folder carrying that attribute; a plain name passes through. The result adds
    ``<selector>_name``; with ``strict`` an unresolved selector fails the job, else it stays null.
    """
    by_attr = (
        folders.select("mirror", "folder", "list_pos", F.explode("attrs").alias(selector))
        .groupBy("mirror", selector).agg(F.min_by("folder", F.struct("list_pos", "folder")).alias("_found"))
    )
    name = F.when(F.col(selector).startswith("\\"), F.col("_found")).otherwise(F.col(selector))
    if strict:
        name = F.when(
            name.isNull() & F.col(selector).isNotNull(),
            F.raise_error(F.concat(F.lit("no folder carries "), F.col(selector), F.lit(" on "), F.col("mirror"))),
        ).otherwise(name)
    return (
        wanted.join(by_attr, ["mirror", selector], "left").withColumn(f"{selector}_name", name).drop("_found")
    )


def resolve_specs(specs: DataFrame, folders: DataFrame) -> DataFrame:
    """Specs with role selectors replaced by folder names. Sent is looked up only where it is used."""
    used = specs.withColumn(
        "sent_source", F.when(F.col("sent_on") | ~F.col("sent_source").startswith("\\"), F.col("sent_source"))
    )
    out = resolve_folder(folders, used, "source_folder")
    out = resolve_folder(folders, out, "sent_source")
    return out.withColumns({
        "source_folder": F.col("source_folder_name"), "sent_source": F.col("sent_source_name"),
    }).select(*specs.columns)


def is_role(attrs: Column) -> Column:
    return F.arrays_overlap(F.coalesce(attrs, no_strings()), F.array(*[F.lit(a) for a in ROLE_ATTRS]))


def label_folders(folders: DataFrame, specs: DataFrame) -> DataFrame:
    """Folders that count as labels: not the main source, not the inbox, not excluded, no role attribute."""
    rules = specs.select("mirror", "source_folder", "label_exclude")
    keep = (
        (F.col("folder") != F.col("source_folder"))
        & (F.lower("folder") != "inbox")
        & ~F.array_contains(F.coalesce(F.col("label_exclude"), no_strings()), F.col("folder"))
        & ~is_role(F.col("attrs"))
    )
    return folders.join(rules, "mirror").filter(keep).select(*folders.columns)


def watch_list(folders: DataFrame, specs: DataFrame) -> DataFrame:
    """Folders whose membership is tracked, with the kind of change a membership change causes.

    Label folders tag ('keyword', or nothing while propagation is off); inbox and sent route ('move').
    """
    rules = specs.select(
        "mirror", F.col("labels_on").alias("_on"), F.col("propagate").alias("_prop"), F.col("inbox").alias("_inbox")
    )
    labels = (
        label_folders(folders, specs).join(rules, "mirror")
        .filter(F.col("_on") & (F.col("folder") != F.col("_inbox")))
        .select("mirror", "folder", F.when(F.col("_prop"), "keyword").alias("kind"))
    )
    inbox = specs.filter(F.col("archive_on") | F.col("sent_on")).select(
        "mirror", F.col("inbox").alias("folder"), F.lit("move").alias("kind")
    )
    sent = specs.filter("sent_on").select(
        "mirror", F.col("sent_source").alias("folder"), F.lit("move").alias("kind")
    )
    routing = inbox.unionByName(sent).distinct()
    # A folder that routes does not tag, so each folder is watched once.
    return labels.join(routing, ["mirror", "folder"], "left_anti").unionByName(routing)


def wanted_bucket(in_inbox: Column, in_sent: Column) -> Column:
    """Bucket of a key under a spec row: inbox, then sent, then archive, then primary."""
    return (
        F.when((F.col("archive_on") | F.col("sent_on")) & in_inbox, F.col("dest_folder"))
        .when(F.col("sent_on") & in_sent, F.col("sent_folder"))
        .when(F.col("archive_on"), F.col("archive_folder"))
        .otherwise(F.col("dest_folder"))
    )


def is_label(folder: Column) -> Column:
    """Whether a membership is a label under a spec row: inbox and sent are placement, not labels."""
    return (folder != F.col("inbox")) & ~(F.col("sent_on") & (folder == F.coalesce(F.col("sent_source"), F.lit(""))))


_FACT_RULES = (
    "inbox", "dest_folder", "archive_on", "archive_folder", "sent_on", "sent_source", "sent_folder",
    "labels_on", "keyword_prefix", "keyword_replacement",
)


def fact_rows(members: DataFrame, specs: DataFrame) -> DataFrame:
    """What every membership says about its key: ``mirror, key, in_inbox, in_sent, label``."""
    rules = specs.select("mirror", "inbox", "sent_on", "sent_source")
    return members.select("mirror", "key", "folder").join(rules, "mirror").select(
        "mirror", "key",
        (F.col("folder") == F.col("inbox")).alias("in_inbox"),
        F.coalesce(F.col("folder") == F.col("sent_source"), F.lit(False)).alias("in_sent"),
        F.when(is_label(F.col("folder")), F.col("folder")).alias("label"),
    )


def fact_columns() -> list[Column]:
    """Aggregates over fact rows. They pass over nulls, so rows of other kinds may be mixed in."""
    return [
        F.max("in_inbox").alias("in_inbox"),
        F.max("in_sent").alias("in_sent"),
        F.array_sort(F.collect_set("label")).alias("labels"),
    ]


def key_facts(members: DataFrame, specs: DataFrame) -> DataFrame:
    """Everything placement and tagging need to know about a key, in one shuffle.

    Gives ``mirror, key, in_inbox, in_sent, labels`` with labels distinct and sorted. Map-side
    aggregation keeps at most one row per key and folder in flight.
    """
    return fact_rows(members, specs).groupBy("mirror", "key").agg(*fact_columns())


def with_placement(keys: DataFrame, facts: DataFrame, specs: DataFrame) -> DataFrame:
    """Add ``wanted`` (bucket) and ``tags`` to rows that carry (mirror, key).

    Keys in no watched folder have no facts and get the default bucket and no tags.
    """
    return place(keys.join(facts, ["mirror", "key"], "left"), specs).select(*keys.columns, "wanted", "tags")


def place(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """Add ``wanted`` and ``tags`` to rows that carry their facts."""
    no = F.lit(False)
    tags = F.when(
        F.col("labels_on"),
        keywords(F.coalesce(F.col("labels"), no_strings()), F.col("keyword_prefix"), F.col("keyword_replacement")),
    ).otherwise(no_strings())
    return rows.join(specs.select("mirror", *_FACT_RULES), "mirror").withColumns({
        "wanted": wanted_bucket(F.coalesce(F.col("in_inbox"), no), F.coalesce(F.col("in_sent"), no)),
        "tags": tags,
    })


def route_bucket(keys: DataFrame, members: DataFrame, specs: DataFrame) -> DataFrame:
    """Bucket of every key by its memberships."""
    return with_placement(keys, key_facts(members, specs), specs).drop("tags")


def folders_of_key(members: DataFrame) -> DataFrame:
    """Folders every key is in, sorted."""
    return members.groupBy("mirror", "key").agg(F.array_sort(F.collect_set("folder")).alias("folders"))


def labels_of_key(members: DataFrame, specs: DataFrame) -> DataFrame:
    """Labels of every key: its folders without the routing folders."""
    return key_facts(members, specs).filter(F.size("labels") > 0).select("mirror", "key", "labels")


def tags_per_key(members: DataFrame, specs: DataFrame) -> DataFrame:
    """Tags of every key that has a membership."""
    facts = key_facts(members, specs)
    return with_placement(facts.select("mirror", "key"), facts, specs).select("mirror", "key", "tags")
