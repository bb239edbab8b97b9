"""Mixing sources to target weights by weighted fair queueing.

Sources share a budget of words by weight; a source that would be read more than ``epochs`` times
stops there, and what it leaves is shared again. Documents of a source are shuffled by a hash. Copy k
of a document has the virtual time (k x source size + words of the source up to its middle) / target:
the moment half of it is served when every source is served in proportion to its target. All copies
up to time 1 are sorted by it and cut at the total budget, so each source ends within about one
document of its target, and any prefix of the mix has the same proportions.

Cumulative sums never put a source in one task: both orders are cut into bins of a known uniform
distribution (the hash, and the virtual time), bins are summed first, and only the sums of bins meet
in one window. The cut is one position (epoch, hash) per source, so texts are joined to a table of
one row per source and are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirrorkit.llm.common import free_name, n_words, partitions
from mirrorkit.session import stored

WEIGHTS = (5, 2, 1)
EPOCHS = 3
BINS_PER_PARTITION = 16


def shuffle_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(F.lit("mix"), doc_id, text)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, epochs: int = EPOCHS) -> DataFrame:
    """``source, source_size, n_docs`` (one row per source) with ``place, weight, target``.

    Water filling: with sources ordered by cap per weight, a source is full if its cap is at most its
    part of what the full ones before it left.
    """
    everything = Window.partitionBy()
    cap, weight = F.col("cap"), F.col("weight")
    filled = Window.orderBy((cap / weight).asc(), "place")
    rest = Window.orderBy((cap / weight).desc(), F.col("place").desc()).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
        .withColumns({
            "cap": F.col("source_size") * F.lit(float(epochs)),
            "budget": F.sum("source_size").over(everything) * F.lit(float(share)),
        })
        .withColumns({
            "before": F.coalesce(F.sum(cap).over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "weights_left": F.sum(weight).over(rest),
            "rank": F.row_number().over(filled),
        })
        .withColumn("level", (F.col("budget") - F.col("before")) / F.col("weights_left"))
        .withColumn("full", cap <= weight * F.col("level"))
        .withColumn("open", F.min(F.when(~F.col("full"), F.struct("rank", "level"))).over(everything))
    )
    # A source can be full only while all before it in this order are.
    full = F.col("open").isNull() | (F.col("rank") < F.col("open.rank"))
    return placed.withColumn("target", F.when(full, cap).otherwise(weight * F.col("open.level"))).select(
        "source", "source_size", "n_docs", "place", "weight", "target",
    )


def _bin(share: Column, bins: Column) -> Column:
    return F.least(F.floor(share * bins).cast("long"), bins.cast("long") - 1)


def plan_mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, epochs: int = EPOCHS,
) -> tuple[DataFrame, DataFrame]:
    """(rows, reach): ``rows`` has ``doc_id, source, size, h`` for each document, ``reach`` one row per source.

    ``reach`` holds the source's size and target, and the last position the mix takes from it:
    ``last_epoch`` and ``last_h``, null where it takes nothing.
    """
    spark = docs.sparkSession
    rows = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        n_words(F.col("text")).alias("size"), shuffle_key(F.col("doc_id"), F.col("text")).alias("h"),
    ), "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    plan = stored(targets(sizes, weights, share, epochs), "mix-targets")

    bins = F.lit(float(BINS_PER_PARTITION * partitions(spark)))
    of = plan.select(
        F.col("source").alias("s"), "source_size", "place", "target",
        F.ceil(bins * F.col("n_docs") / F.sum("n_docs").over(Window.partitionBy())).cast("double").alias("bins"),
        F.least(F.ceil(F.try_divide("target", "source_size")), F.lit(epochs)).cast("int").alias("copies"),
        F.sum("target").over(Window.partitionBy()).alias("budget"),
    ).filter(F.col("target") > 0)
    spread = F.col("h").cast("double") / F.lit(float(1 << 64)) + 0.5
    dealt = rows.filter("size > 0").join(of, F.col("source").eqNullSafe(F.col("s"))).withColumn("bin", _bin(spread, F.col("bins")))
    order = Window.partitionBy("place").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(
        dealt.groupBy("place", "bin").agg(F.sum("size").alias("words"))
        .select("place", "bin", F.coalesce(F.sum("words").over(order), F.lit(0)).alias("start")), "mix-bins",
    )
    # Equal keys (rows equal in id and text) share one cumulative sum, hence one fate.
    inside = F.sum("size").over(Window.partitionBy("place", "bin").orderBy("h"))
    queue = (
        dealt.withColumn("inside", inside).join(starts, ["place", "bin"])
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        .withColumn("time", (F.col("epoch") * F.col("source_size") + F.col("start") + F.col("inside") - F.col("size") / 2) / F.col("target"))
        .filter(F.col("time") <= 1)
        .select("place", "epoch", "h", "size", "time", "budget", _bin(F.col("time"), bins).alias("slot"))
    )
    queue = stored(queue, "mix-queue")
    before = stored(
        queue.groupBy("slot").agg(F.sum("size").alias("words")).select(
            "slot", F.coalesce(F.sum("words").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("served"),
        ), "mix-slots",
    )
    total = F.col("served") + F.sum("size").over(Window.partitionBy("slot").orderBy("time", "place", "h"))
    last = (
        queue.join(before, "slot").withColumn("total", total)
        .filter(F.col("total") - F.col("size") / 2 <= F.col("budget"))
        .groupBy("place").agg(F.max(F.struct("epoch", "h")).alias("last"))
    )
    reach = plan.join(last, "place", "left").select(
        "source", "source_size", "target", F.col("last.epoch").alias("last_epoch"), F.col("last.h").alias("last_h"),
    )
    return rows, stored(reach, "mix-reach")


def copies_taken(h: Column, size: Column) -> Column:
    """How often the mix takes a document, from its source's row of ``reach``."""
    taken = F.col("last_epoch") + F.when(h <= F.col("last_h"), 1).otherwise(0)
    return F.when(size > 0, F.coalesce(taken, F.lit(0))).otherwise(0).cast("int")


def mix_shares(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, epochs: int = EPOCHS,
) -> DataFrame:
    """What the mix takes of each document: ``doc_id, size, source_size, target, taken, source, copies``.

    Needs ``doc_id, text, source``; other columns are ignored. A null text has size 0; documents of
    size 0 are never taken. A null source is a source of its own, the last one. Rows equal in id, text
    and source are taken equally often. A null ``doc_id`` is treated like any other. An empty table
    gives no rows. Texts of any length are counted whole, and only whole documents are taken.
    """
    rows, reach = plan_mix(docs, weights, share, epochs)
    of = reach.withColumnRenamed("source", "s")
    taken = copies_taken(F.col("h"), F.col("size"))
    return (
        rows.join(of, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", taken)
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, epochs: int = EPOCHS) -> DataFrame:
    """The mixed documents, a row per copy taken, with the columns of ``docs``; see ``mix_shares``."""
    _, reach = plan_mix(docs, weights, share, epochs)
    names = {old: free_name(docs, f"mix_{old}") for old in ("source", "last_epoch", "last_h")}
    of = reach.select(*[F.col(old).alias(new) for old, new in names.items()])
    size, h = n_words(F.col("text")), shuffle_key(F.col("doc_id"), F.col("text"))
    taken = F.col(names["last_epoch"]) + F.when(h <= F.col(names["last_h"]), 1).otherwise(0)
    copies = F.when(F.col(names["last_epoch"]).isNotNull() & (size > 0), taken).otherwise(0).cast("int")
    copy = free_name(docs, "mix_copy")
    return (
        docs.join(of, F.col("source").cast("string").eqNullSafe(F.col(names["source"])))
        .withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies))).select(*docs.columns)
    )
