"""Key parts: tables laid out by a hash of (mirror, key), and lookups that open the parts asked for.

Rows of a large batch lie in one directory per key part, in files sorted by key; those of a small batch
lie loose, in the part ``LOOSE``, until they are folded into a large one. A lookup of some keys is a semi
join on the part as well, so dynamic partition pruning leaves out the parts that no asked key falls in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorkit.operators.dedup import KEY

LOOSE = -1


def key_part(parts: int) -> Column:
    return F.pmod(F.xxhash64("mirror", "key"), F.lit(parts)).cast("int")


def lay_out(rows: DataFrame, parts: int) -> DataFrame:
    """Rows with their ``key_part``, dealt out and sorted for writing; ``parts`` 0 leaves them loose."""
    if not parts:
        return rows.withColumn("key_part", F.lit(LOOSE)).sortWithinPartitions(*KEY)
    # The salt spreads a part over several tasks, so a part is not bound to one.
    dealt = rows.withColumn("key_part", key_part(parts))
    return dealt.repartition("key_part", F.pmod(F.xxhash64("mirror", "key", F.lit(1)), F.lit(4))).sortWithinPartitions("key_part", *KEY)


def write_options(parts: int) -> dict[str, str]:
    """Spark's own Parquet options: files of key parts carry a Bloom filter of their keys, sized by what they hold."""
    if not parts:
        return {}
    return {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def among_parts(known: DataFrame, asked: DataFrame, parts: int) -> DataFrame:
    """``known`` (with its ``key_part``) cut to the keys of ``asked``.

    ``parts`` is the number of parts that large batches of the table are laid out in, 0 if there are none.
    The filter on the asked side is what makes the optimizer prune: without any it expects no gain.
    """
    asked = asked.select(*KEY)
    loose = known.filter(F.col("key_part") == LOOSE).join(asked, KEY, "left_semi")
    if not parts:
        return loose.drop("key_part")
    wanted = asked.withColumn("key_part", key_part(parts)).filter(F.col("key_part") >= 0)
    laid = known.filter(F.col("key_part") >= 0).join(wanted, ["key_part", *KEY], "left_semi")
    return laid.unionByName(loose).drop("key_part")
