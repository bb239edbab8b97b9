"""Rule fingerprints, scan windows and typed reads of text settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The settings that decide placement and tags. A change in any of them calls for repair.
PLACEMENT_SETTINGS = (
    "archive_on", "inbox", "dest_folder", "archive_folder", "sent_on", "sent_source", "sent_folder",
    "labels_on", "propagate", "keyword_prefix", "keyword_replacement",
)

MAX_U32 = 4294967295


def rule_fingerprint() -> Column:
    """Hash of the placement settings of a spec row."""
    return F.sha2(F.to_json(F.struct(*PLACEMENT_SETTINGS)), 256)


def uid_window(uid: Column, lo: Column, size: Column) -> Column:
    """Number of the scan window a uid falls into, counting from ``lo``."""
    past = uid - lo
    return F.call_function("div", past - F.pmod(past, size), size)


def meta_status(value: Column) -> Column:
    """'absent', 'ok' or 'corrupt' for a text setting that should hold an unsigned 32-bit number."""
    text = F.coalesce(value, F.lit(""))
    number = text.try_cast("long")
    fits = text.rlike("^[0-9]+$") & F.coalesce(number <= MAX_U32, F.lit(False))
    return F.when(text == "", "absent").when(fits, "ok").otherwise("corrupt")


def meta_long(value: Column) -> Column:
    """Typed value: 0 when absent, null when corrupt."""
    status = meta_status(value)
    return F.when(status == "absent", F.lit(0).cast("long")).when(status == "ok", value.try_cast("long"))


def meta_long_strict(value: Column) -> Column:
    """Typed value that fails the job on a corrupt setting."""
    bad = F.raise_error(F.concat(F.lit("corrupt setting value: "), value)).cast("long")
    return F.when(meta_status(value) == "corrupt", bad).otherwise(meta_long(value))
