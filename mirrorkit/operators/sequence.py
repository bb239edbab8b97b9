"""Dense row numbers without sending a whole group through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mirrorkit.session import cut_lineage

# ``monotonically_increasing_id`` keeps the partition number above this many bits.
_ROW_BITS = 33


def number_rows(df: DataFrame, within: Sequence[str], order: Sequence[str], name: str = "seq") -> DataFrame:
    """``row_number() over (partition by within order by order)`` as a distributed sort.

    A window would collect each group (say, one mirror with a third of all rows) in one task.
    Here rows are range-partitioned on group *and* order, numbered inside their partition, and
    shifted by the number of rows in the partitions before. Only those counts, one per group and
    partition, meet in a window. The ranged rows are written once, because range bounds are
    sampled and a recomputed partition could otherwise get different ones.
    """
    ranged = (
        df.repartitionByRange(*within, *order)
        .sortWithinPartitions(*within, *order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    stored = cut_lineage(ranged).withColumn("_part", F.shiftright("_at", _ROW_BITS))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = stored.groupBy(*within, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_start"))
    offsets = spans.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    number = F.col("_at") - F.col("_start") + F.col("_before") + 1
    return (
        stored.join(offsets, [*within, "_part"])
        .withColumn(name, number.cast("long"))
        .select(*df.columns, name)
    )
