"""Quality rules as a short-circuit cascade, in built-in column expressions only.

A rule is a predicate that is true where a text fails it. Each rule's cost and its share of rejected
texts are measured on a sample; rules then run in the order of rejection per cost, and a text that one
rule rejects is not looked at by the rules behind it. The order changes the time taken and which of
several failed rules is named, never which texts are kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorkit.llm.common import SPACE, WORD, free_name
from mirrorkit.session import stored

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SAMPLE_ROWS = 2000
SEED = 17


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("long")


def chars_of(text: Column, chars: str) -> Column:
    """How many characters of the text are among ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(f"[^{SPACE}]"))


def windows(found: Column) -> Column:
    """Hash and place of each window of three words, sorted by hash."""
    places = F.sequence(F.lit(0), F.size(found) - 3)
    built = F.transform(places, lambda i: F.struct(
        F.xxhash64(F.get(found, i), F.get(found, i + 1), F.get(found, i + 2)).alias("h"), i.alias("p"),
    ))
    return F.sort_array(F.when(F.size(found) >= 3, built).otherwise(F.array().cast("array<struct<h:bigint,p:int>>")))


def repeated_places(ordered: Column) -> Column:
    """Places of windows found more than once, ascending; ``ordered`` must be a column, not an expression."""
    def again(item: Column, i: Column) -> Column:
        return (item["h"] == F.get(ordered, i + 1)["h"]) | (item["h"] == F.get(ordered, i - 1)["h"])

    return F.sort_array(F.transform(F.filter(ordered, lambda x, i: F.coalesce(again(x, i), F.lit(False))), lambda x: x["p"]))


def covered(places: Column) -> Column:
    """Number of words within the windows of three that start at these places."""
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(places, start, lambda acc, p: F.struct(
        p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"),
    ), lambda acc: acc["n"])


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def measured(docs: DataFrame, names: Sequence[str] = MEASURES) -> DataFrame:
    """``docs`` (with a text that is never null) and the measures, in steps that share what they can.

    Each step is a projection of its own: the optimizer does not merge projections whose results are
    used more than once, so words, lines and windows are made once.
    """
    keep = list(docs.columns)
    text = F.col("text")
    step = docs.withColumns({"q_words": words(text), "q_lines": lines(text)})
    step = step.withColumns({"q_windows": windows(F.col("q_words")), "q_distinct": F.array_distinct("q_lines")})
    step = step.withColumn("q_places", repeated_places(F.col("q_windows")))
    all_of = {
        "n_words": F.size("q_words").cast("long"), "word_chars": word_chars(text), "n_symbols": chars_of(text, SYMBOLS),
        "n_dup_lines": (F.size("q_lines") - F.size("q_distinct")).cast("long"), "n_repeat_words": covered(F.col("q_places")),
        "n_lines": F.size("q_lines").cast("long"), "n_capitals": chars_of(text, CAPITALS),
    }
    return step.select(*keep, *[all_of[name].alias(name) for name in names])


@dataclass(frozen=True)
class Rule:
    """``fails`` takes the measures' columns; ``needs`` names those it uses."""

    name: str
    needs: tuple[str, ...]
    fails: Callable[[dict[str, Column]], Column]


BASE_RULES = (
    Rule("short", ("n_words",), lambda m: m["n_words"] < 50),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 50),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", ("n_words", "n_symbols"), lambda m: m["n_symbols"] * 10 > m["n_words"] * 4),
    Rule("dup_lines", ("n_lines", "n_dup_lines"), lambda m: m["n_dup_lines"] * 10 > m["n_lines"] * 4),
    Rule("word_length", ("n_words", "word_chars"),
         lambda m: (m["word_chars"] < m["n_words"] * 2) | (m["word_chars"] > m["n_words"] * 15)),
    Rule("capitals", ("word_chars", "n_capitals"), lambda m: m["n_capitals"] * 10 > m["word_chars"] * 4),
)


def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` texts drawn at random from the whole table, written once."""
    total = docs.count()
    part = docs if total <= rows else docs.sample(fraction=rows / total, seed=SEED)
    return stored(part.select("text"), "rule-sample")


def ranked(
    sample: DataFrame, rules: Sequence[Rule] = RULES, runs: int = 3, clock: Callable[[], float] = time.perf_counter,
) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) by rejection per cost, best first; ties keep the given order.

    A rule's cost is the least of ``runs`` runs after one that compiles it.
    """
    out = []
    for rule in rules:
        told = measured(sample, rule.needs)
        fails = rule.fails({name: F.col(name) for name in rule.needs})
        counted = told.agg(F.count(F.lit(1)), F.coalesce(F.sum(fails.cast("int")), F.lit(0)))
        n, failed = counted.first()
        seconds = []
        for _ in range(runs):
            began = clock()
            counted.collect()
            seconds.append(clock() - began)
        out.append((rule, max(min(seconds), 1e-6), failed / max(n, 1)))
    return sorted(out, key=lambda x: -x[2] / x[1])


def cascade(rules: Sequence[Rule], measures: dict[str, Column]) -> Column:
    """Name of the first rule that fails, null where none does."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.fails(measures), F.lit(rule.name)).otherwise(verdict)
    return verdict


def quality(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id``, the measures, ``failed_rule`` (null where kept), ``base_failed`` and ``kept``.

    Needs ``doc_id`` and ``text``; other columns are ignored. A null text has no words and fails as
    short. A null ``doc_id`` stays null; equal rows are judged alike, each once. An empty table gives
    no rows. Long texts are measured whole. The sample serves only to order the rules.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [rule for rule, _, _ in ranked(sample_of(narrow, sample_rows), rules)]
    told = measured(narrow)
    columns = {name: F.col(name) for name in MEASURES}
    base = [rule for rule in order if rule in BASE_RULES]
    failed = cascade(order, columns)
    return told.select(
        "doc_id", *MEASURES, failed.alias("failed_rule"),
        cascade(base, columns).isNotNull().alias("base_failed") if base else F.lit(False).alias("base_failed"),
        failed.isNull().alias("kept"),
    )


def quality_filter(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that every rule keeps, with their own columns.

    The rules run one behind the other as filters, so a text that is rejected costs nothing more.
    """
    order = [rule for rule, _, _ in ranked(sample_of(docs, sample_rows), rules)]
    hidden = free_name(docs, "quality_row")
    row = docs.select(F.struct(*docs.columns).alias(hidden), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for rule in order:
        told = measured(row, rule.needs)
        row = told.filter(~rule.fails({name: F.col(name) for name in rule.needs})).select(hidden, "text")
    return row.select(f"{hidden}.*")


def quality_rows(docs: DataFrame) -> DataFrame:
    return quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


# The same rows in SQL.
QUALITY_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls from d),
p as (select doc_id, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) >= 3),
g as (select doc_id, i, count(*) over (partition by doc_id, ws[i], ws[i + 1], ws[i + 2]) as n from p),
r as (select doc_id, count(distinct i + k) as n_repeat_words
      from (select * from g where n > 1), (select unnest(range(3)) as k) group by doc_id),
m as (select w.doc_id, cast(len(ws) as bigint) as n_words,
             cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
             cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
             cast(len(ls) as bigint) as n_lines, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
             cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
             length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_capitals
      from w left join r using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not (n_symbols * 10 > n_words * 4 or n_dup_lines * 10 > n_lines * 4
         or word_chars < n_words * 2 or word_chars > n_words * 15 or n_capitals * 10 > word_chars * 4) as kept
from (select *, n_words < 50 or n_repeat_words * 100 > n_words * 50 as base_failed from m)
"""
