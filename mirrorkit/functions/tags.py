"""Flags, labels and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the one system flag a copy may carry.
SEEN = "\\Seen"


def no_strings() -> Column:
    return F.array().cast("array<string>")


def safe_flags(flags: Column, carry_seen: Column) -> Column:
    """Keep the seen flag when asked to, and nothing else."""
    return F.when(carry_seen & F.array_contains(F.coalesce(flags, no_strings()), SEEN), F.array(F.lit(SEEN))).otherwise(
        no_strings()
    )


def keyword_slug(label: Column, replacement: Column) -> Column:
    """Label to tag text: every run of other characters becomes the replacement, which is then
    trimmed at both ends; lower case. May be empty."""
    return F.lower(F.btrim(F.regexp_replace(label, F.lit("[^A-Za-z0-9_-]+"), replacement), replacement))


def keyword(label: Column, prefix: Column, replacement: Column) -> Column:
    """Tag of one label. The prefix stays as written; an empty slug gives no tag (null)."""
    slug = keyword_slug(label, replacement)
    return F.when(slug != "", F.concat(prefix, slug))


def keywords(labels: Column, prefix: Column, replacement: Column) -> Column:
    """Distinct tags of a label list, in label order."""
    tags = F.transform(labels, lambda label: keyword(label, prefix, replacement))
    return F.array_distinct(F.filter(tags, lambda tag: tag.isNotNull()))


def missing_keywords(wanted: Column, present: Column) -> Column:
    """Wanted tags that are not present, compared without regard to case."""
    have = F.transform(F.coalesce(present, no_strings()), lambda tag: F.lower(tag))
    return F.filter(wanted, lambda tag: ~F.array_contains(have, F.lower(tag)))


def tag_signature(tags: Column) -> Column:
    """Canonical text of a tag set, for grouping."""
    return F.array_join(F.array_sort(tags), "\u0000")


def tag_allowed(tag: Column, allowed: Column) -> Column:
    """Whether a destination takes a tag; without a rule (null) it takes all."""
    return allowed.isNull() | F.regexp_like(tag, allowed)
