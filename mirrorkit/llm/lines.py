"""Lines that repeat across documents, found by range-partitioned hashes and reported as bitmaps.

Each line of a document becomes a narrow row: a 128-bit hash of the line's key, the document, the
place. The rows are range-partitioned by hash and sorted within a partition by hash, document (largest
first) and place, so a task streams through its lines and meets, for each key, the document that may
keep it first. What leaves is a compressed bitmap for each text that loses a line: the runs of dropped
places, as start and length. Texts take no part in any of this.

A line that a large share of all documents holds cannot be split by its hash. A frequency sketch of
bounded size names such hashes; they skip the range partitions and are decided by two numbers each
(documents, largest document), summed before they are shuffled. The sketch only balances the work: a
hash it names or misses gets the same decision. Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirrorkit.llm.common import free_name, partitions
from mirrorkit.session import stored

LEAST_CHARS = 40
LEAST_DOCS = 5
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Most hashes that are treated as hot, and the places of the sketch that finds them.
HOT = 10_000
SKETCH = 100_000


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hashes(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``doc, tk, place, h, g`` for each line whose key has ``least_chars`` characters; ``tk`` hashes the text."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc"), F.xxhash64(_text(docs)).alias("tk"), _lines(_text(docs)).alias("lines"))
    line = F.col("line")
    # The test of bytes is cheap and passes every line that the test of characters passes.
    rows = rows.select("doc", "tk", F.posexplode("lines").alias("place", "line")).filter(F.octet_length(line) >= least_chars)
    rows = rows.withColumn("line", F.btrim(line, F.lit(BLANKS))).filter(F.char_length(line) >= least_chars)
    # lower() maps more than A-Z, but not in a line of ASCII; translate() is right for all and slower.
    plain = F.octet_length(line) == F.char_length(line)
    rows = rows.withColumn("line", F.when(plain, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER)))
    return rows.select("doc", "tk", "place", F.xxhash64(line).alias("h"), F.xxhash64(F.lit(7), line, F.lit(11)).alias("g"))


def hot_hashes(entries: DataFrame) -> DataFrame:
    """``h`` of lines that alone would fill about a partition; never more than ``HOT`` rows."""
    parts = min(partitions(entries.sparkSession), HOT // 2)
    told = entries.agg(F.expr(f"approx_top_k(h, {2 * parts}, {SKETCH})").alias("top"), F.count(F.lit(1)).alias("n"))
    top = told.select("n", F.explode("top").alias("top")).filter(F.col("top.count") * 2 * parts > F.col("n"))
    return top.select(F.col("top.item").alias("h"))


def _streamed(rows: DataFrame, least_docs: int) -> DataFrame:
    """Lines to drop, from a stream over each range of hashes."""
    sorted_rows = rows.repartitionByRange("h", "g").sortWithinPartitions("h", "g", F.col("doc").desc_nulls_last(), "place")
    one = Window.partitionBy("h", "g")
    nth = F.dense_rank().over(one.orderBy(F.col("doc").desc_nulls_last()))  # 1: the document that keeps the line
    return (
        sorted_rows.withColumn("nth", nth).withColumn("n_docs", F.max("nth").over(one))
        .filter((F.col("nth") > 1) & (F.col("n_docs") >= least_docs)).select("doc", "tk", "place")
    )


def _counted(rows: DataFrame, least_docs: int) -> DataFrame:
    """Lines to drop among the hot ones: their facts are a few rows, and the lines stay where they are."""
    facts = rows.select("h", "g", "doc").distinct().groupBy("h", "g").agg(
        F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last"),
    ).filter(F.col("n_docs") >= least_docs)
    return rows.join(F.broadcast(facts), ["h", "g"]).filter(~F.col("doc").eqNullSafe(F.col("last"))).select("doc", "tk", "place")


def _runs(places: Column) -> Column:
    """Runs of consecutive numbers as (at, n); ``places`` is a sorted column of distinct ones."""
    starts = F.filter(places, lambda p, i: F.coalesce(F.get(places, i - 1) < p - 1, F.lit(True)))
    ends = F.filter(places, lambda p, i: F.coalesce(F.get(places, i + 1) > p + 1, F.lit(True)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("at"), (b - a + 1).alias("n")))


def drop_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``doc, tk, runs``: for each text that loses lines, the dropped places as runs (at, n), ascending.

    Needs ``doc_id`` and ``text``; other columns are ignored. ``tk`` is ``xxhash64`` of the text, null
    taken as empty. A line's key is the line without ASCII white space at its ends, A-Z lower-cased. A key
    of ``least_chars`` characters that ``least_docs`` different ``doc_id`` hold is dropped from all but
    the largest; rows without an id count as one document, the smallest. Rows equal in id and text share
    one bitmap; rows equal in id only are one document with several texts. Texts that lose nothing, and
    empty tables, give no rows.
    """
    entries = stored(line_hashes(docs, least_chars), "line-hashes")
    hot = stored(hot_hashes(entries), "line-hot")
    rest = entries.join(F.broadcast(hot), "h", "left_anti")
    common = entries.join(F.broadcast(hot), "h", "left_semi")
    drops = _streamed(rest, least_docs).unionByName(_counted(common, least_docs))
    # A text's own lines meet here, and nothing else.
    places = drops.groupBy("doc", "tk").agg(F.sort_array(F.collect_set("place")).alias("places"))
    return places.select("doc", "tk", _runs(F.col("places")).alias("runs"))


def kept_lines(lines: Column, runs: Column) -> Column:
    """The lines outside the runs; both must be columns, ``runs`` not null."""
    def stretch(i: Column) -> Column:
        before = F.coalesce(F.get(runs, i - 1)["at"] + F.get(runs, i - 1)["n"], F.lit(0))
        return F.slice(lines, before + 1, F.coalesce(F.get(runs, i)["at"], F.size(lines)) - before)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), stretch))


def _with_bitmaps(docs: DataFrame, columns: list[Column], least_chars: int, least_docs: int) -> DataFrame:
    """``columns`` of ``docs``, the text as ``text``, and ``runs`` (null: nothing goes).

    The texts meet their bitmaps by one shuffle, whatever the bitmaps' size: they grow with the corpus.
    """
    maps = stored(drop_bitmaps(docs, least_chars, least_docs), "line-bitmaps")
    rows = docs.select(*columns, docs["doc_id"].cast("long").alias("line_doc"), F.xxhash64(_text(docs)).alias("line_tk"), _text(docs).alias("line_text"))
    same = rows["line_doc"].eqNullSafe(maps["doc"]) & (rows["line_tk"] == maps["tk"])
    return rows.join(maps.hint("merge"), same, "left").select(*[c for c in rows.columns if c != "line_tk"], "runs")


def _kept_text() -> Column:
    return F.when(F.col("runs").isNull(), F.col("line_text")).otherwise(F.array_join(kept_lines(F.col("lines"), F.col("runs")), "\n"))


def without_repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` with all their columns and rows, repeated lines taken out of ``text`` as by :func:`drop_bitmaps`.

    A null text stays null.
    """
    hidden = free_name(docs, "line_row")
    rows = _with_bitmaps(docs, [F.struct(*docs.columns).alias(hidden)], least_chars, least_docs)
    rows = rows.withColumn("lines", _lines(F.col("line_text")))
    text = F.when(F.col(f"{hidden}.text").isNull(), F.lit(None)).otherwise(_kept_text())
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"{hidden}.`{c}`") for c in docs.columns])


def line_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of each document; null and empty texts have one empty line."""
    rows = _with_bitmaps(docs, [], LEAST_CHARS, LEAST_DOCS).withColumn("lines", _lines(F.col("line_text")))
    dropped = F.aggregate(F.col("runs"), F.lit(0).cast("long"), lambda n, run: n + run["n"])
    return rows.select(
        F.col("line_doc").alias("doc_id"), F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(dropped, F.lit(0).cast("long")).alias("n_dropped"), F.sha2(_kept_text(), 256).alias("kept_sha256"),
    )


# The same rows in SQL.
LINES_SQL = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as place from d),
k as (select doc_id, place, line,
             translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key, max(doc_id) as last from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
j as (select k.doc_id, k.place, k.line, f.key is not null and k.doc_id <> f.last as gone from k left join f on k.key = f.key)
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (where gone) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not gone), '')) as kept_sha256
from j group by doc_id
"""
