"""Apply queued operations to copied records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorkit.operators.changes import apply_moves, apply_tag_deltas
from mirrorkit.operators.routing import key_facts


def propagate(
    ops: DataFrame, placements: DataFrame, members: DataFrame, specs: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Move rows and tag rows that the queue calls for. Every operation counts as consumed afterwards.

    ``members`` may be cut to the keys of the operations.
    """
    facts = key_facts(members, specs)
    return apply_moves(ops, placements, specs, facts), apply_tag_deltas(ops, placements, specs, facts)


def propagate_plan(ops: DataFrame, placements: DataFrame, members: DataFrame, specs: DataFrame) -> DataFrame:
    """Both kinds of change in one table."""
    moves, tags = propagate(ops, placements, members, specs)
    return moves.select(
        "mirror", "copy_id", F.lit("move").alias("change"), "from_folder", F.col("folder").alias("target")
    ).unionByName(
        tags.select("mirror", "copy_id", F.concat(F.lit("tag-"), "op").alias("change"),
                    F.lit("").alias("from_folder"), F.col("tag").alias("target"))
    )
