"""Digests of uid bands: which parts of a folder have changed, without comparing records.

A band is a range of uids of one folder in one epoch. Its digest is the number of its uids and a sum of
their hashes, which does not depend on their order. A source is digested by one scan of its uids and one
aggregation; the digests are a row per band, some hundred-thousandth of the records, and are kept with
the scan state. Only bands whose digest is another than at the last pass can hold a difference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorkit.sources.tables import BAND_UIDS, uid_band

FOLDER = ["mirror", "folder"]
BAND = [*FOLDER, "uid_band"]


def with_band(rows: DataFrame, band_uids: int = BAND_UIDS) -> DataFrame:
    """``rows`` with their ``uid_band``; a table laid out in bands of this width gives it by its directories."""
    own = "band" in rows.columns and band_uids == BAND_UIDS
    return rows.withColumn("uid_band", F.col("band").cast("long") if own else uid_band(F.col("uid"), band_uids))


def band_digests(messages: DataFrame, band_uids: int = BAND_UIDS) -> DataFrame:
    """``mirror, folder, epoch, uid_band, n, digest`` of every band that holds a record.

    Hashes are added as decimals, so no number of them overflows; the sum is kept as text.
    """
    hashed = F.xxhash64("uid").cast("decimal(20,0)")
    return with_band(messages, band_uids).groupBy(*FOLDER, "epoch", "uid_band").agg(
        F.count(F.lit(1)).alias("n"), F.sum(hashed).cast("string").alias("digest"),
    )


def changed_bands(now: DataFrame, before: DataFrame) -> DataFrame:
    """``mirror, folder, uid_band`` of bands that are new, gone, or have another digest or epoch."""
    told = F.struct("epoch", "n", "digest")
    none = F.lit(None).cast(now.select(told.alias("s")).schema["s"].dataType)
    sides = now.select(*BAND, told.alias("_now"), none.alias("_before")).unionByName(
        before.select(*BAND, none.alias("_now"), told.alias("_before"))
    )
    met = sides.groupBy(*BAND).agg(F.max("_now").alias("_now"), F.max("_before").alias("_before"))
    return met.filter(~F.col("_now").eqNullSafe(F.col("_before"))).select(*BAND)
