"""Content keys: a record's native id, or a hash of its fields when it has none."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from mirrorkit.spec import MirrorSpec

# The mark of a synthesized key, and the Unicode white space trimmed from ids.
SYNTH_PREFIX = "synth-sha256:"
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def trim_space(c: Column) -> Column:
    """Drop white space of any kind at both ends (Spark's plain ``trim`` drops blanks only)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def epoch_seconds(df: DataFrame, name: str) -> Column:
    """Whole seconds since 1970 in UTC, rounded down, whatever the session zone."""
    c = df[name]
    if isinstance(df.schema[name].dataType, TimestampNTZType):
        days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
        return days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    return F.unix_seconds(c)


def synth_key(seconds: Column, sender: Column, subject: Column, size: Column) -> Column:
    """Hash over length-prefixed fields. Lengths count bytes, so text cannot move across a field
    boundary and collide."""

    def sized(c: Column) -> Column:
        text = F.coalesce(c, F.lit(""))
        return F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)

    joined = F.concat(
        F.coalesce(seconds, F.lit(0)).cast("string"), F.lit("|"), sized(sender), F.lit("|"), sized(subject), F.lit("|"),
        F.coalesce(size, F.lit(0)).cast("string"),
    )
    return F.concat(F.lit(SYNTH_PREFIX), F.sha2(joined, 256))


def content_key(message_id: Column, seconds: Column, sender: Column, subject: Column, size: Column) -> Column:
    """The trimmed id, else the synthesized key."""
    native = trim_space(F.coalesce(message_id, F.lit("")))
    return _key_of(native, seconds, sender, subject, size)


def _key_of(native: Column, seconds: Column, sender: Column, subject: Column, size: Column) -> Column:
    # Never null, so joins on the key need not test for null and evaluate it twice.
    return F.coalesce(F.when(native != "", native).otherwise(synth_key(seconds, sender, subject, size)), F.lit(""))


def is_real_key(key: Column) -> Column:
    """Whether a key is a native id, which a destination can be searched for."""
    return ~key.startswith(SYNTH_PREFIX)


def with_key(messages: DataFrame, specs: Iterable[MirrorSpec] = ()) -> DataFrame:
    """Add ``key`` and ``is_synth``.

    ``is_synth`` is kept next to the key, because a native id could itself begin with the mark.
    A spec with ``key_expr`` takes its native id from that expression.
    """
    native = messages["message_id"]
    for spec in specs:
        if spec.key_expr:
            native = F.when(F.col("mirror") == spec.mirror, F.expr(spec.key_expr)).otherwise(native)
    # The trimmed id is a column of its own: it is used three times and computed once.
    trimmed = messages.withColumn("_native", trim_space(F.coalesce(native, F.lit(""))))
    key = _key_of(
        F.col("_native"), epoch_seconds(messages, "internal_date"), F.col("sender"), F.col("subject"), F.col("size")
    )
    return trimmed.withColumns({"key": key, "is_synth": F.col("_native") == ""}).drop("_native")
