"""Header projection from raw message text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorkit.functions.keys import trim_space


def header_block(raw: Column) -> Column:
    """Everything before the first blank line, with folded lines joined by one space."""
    block = F.split(raw, r"(?:\A|\n)\r?\n", 2)[0]
    return F.regexp_replace(block, r"[ \t]*\r?\n[ \t]+", " ")


def header_value(block: Column, name: str) -> Column:
    """First value of a header, trimmed; empty when the header is missing.

    Only a line that starts with the name counts, so malformed lines are passed over.
    """
    return trim_space(F.regexp_extract(block, rf"(?imd)^{name}[ \t]*:(.*)$", 1))


def parse_headers(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Add ``message_id``, ``sender``, ``subject`` and ``size`` taken from a raw-message column."""
    raw = F.coalesce(F.col(raw_col).cast("string"), F.lit(""))
    return (
        df.withColumn("_block", header_block(raw))
        .withColumns({
            "message_id": header_value(F.col("_block"), "message-id"),
            "sender": header_value(F.col("_block"), "from"),
            "subject": header_value(F.col("_block"), "subject"),
            "size": F.octet_length(F.col(raw_col)).cast("long"),
        })
        .drop("_block")
    )
