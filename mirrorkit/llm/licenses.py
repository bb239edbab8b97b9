"""Known licences by the digest of a canonical text, in built-in column expressions only.

A text is brought into a canonical form: lower case, equivalent spellings made one, copyright lines and
comment marks dropped, punctuation and white space reduced to single spaces. Its SHA-256 digest is then
joined with the digests of known texts. The whole text of a document is looked up, and so is each of its
lines, since short notices stand between other lines. The digests are one row per known text; the
optimizer broadcasts them while they are small, and nothing is shuffled but the few rows that match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorkit.llm.common import SPACE, text_key
from mirrorkit.session import stored

# Spellings that count as equal, in the order in which they are replaced. All are lower case.
SPELLINGS = (
    ("licence", "license"), ("licensor s", "licensors"), ("sub license", "sublicense"), ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"), ("organisation", "organization"), ("favour", "favor"), ("honour", "honor"),
    ("redistributions", "redistribution"), ("copyright owner", "copyright holder"), ("https ", "http "), (" version ", " v "),
)

# Public licence texts and the usual one-line notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""

ZERO_BSD = ISC.replace(
    " granted, provided that the above copyright notice and this permission notice appear in all copies.", " granted.",
).replace("\ngranted, provided that the above copyright notice and this permission notice appear in all copies.", "\ngranted.")

KNOWN = (
    ("MIT", "text", MIT),
    ("MIT", "text", "MIT License\n\n" + MIT),
    ("ISC", "text", ISC),
    ("ISC", "text", "ISC License\n\n" + ISC),
    ("0BSD", "text", ZERO_BSD),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def canonical(text: Column) -> Column:
    """The canonical form; empty where nothing is left."""
    out = F.lower(text)
    # Comment marks at the start of a line, then lines that only claim a copyright.
    out = F.regexp_replace(out, r"(?m)^[\x20\x09]*(?://+|#+|\*+|;+|--+|/\*+)", "")
    out = F.regexp_replace(out, r"(?m)^[\x20\x09]*(?:copyright\b[^\n]*(?:[0-9]{4}|\(c\)|©)|\(c\)|©|all rights reserved\.?$)[^\n]*", "")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")
    out = F.concat(F.lit(" "), F.trim(out), F.lit(" "))
    for spelling, common in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(common))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: tuple[tuple[str, str, str], ...] = KNOWN) -> DataFrame:
    """``digest, license, kind``; ``kind`` is text (a whole document) or notice (a line)."""
    rows = spark.createDataFrame(list(known), "license string, kind string, text string")
    return rows.select(digest(F.col("text")).alias("digest"), "license", "kind").groupBy("digest", "kind").agg(F.min("license").alias("license"))


def license_scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``doc_id, text_digest, license, notices, n_notices``, a row per document.

    Needs ``doc_id`` and ``text``; other columns are ignored. ``license`` names the known text that the
    whole document equals, else null; ``notices`` lists, sorted, the licences whose notice is a line of it,
    and ``n_notices`` counts such lines, repeats included. A null or empty text matches nothing; its digest
    is that of an empty text. A null ``doc_id`` stays null; equal rows each get their row. An empty table
    gives no rows. Texts of any length are digested whole.
    """
    spark = docs.sparkSession
    known = stored(known if known is not None else known_digests(spark), "license-digests").filter(
        F.col("digest") != F.sha2(F.lit(""), 256),
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    told = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("key"), digest(text).alias("text_digest"), text.alias("text"),
    )
    texts = known.filter("kind = 'text'").select(F.col("digest").alias("text_digest"), "license")
    notices = known.filter("kind = 'notice'").select("digest", F.col("license").alias("notice"))
    # Rows of the same text get the same answer, so lines of copies are counted once per text.
    lines = (
        told.filter(F.col("text").rlike(rf"[^{SPACE}]")).select("key", F.posexplode(F.split("text", "\n", -1)).alias("line", "value"))
        .select("key", "line", digest(F.col("value")).alias("digest")).join(notices, "digest")
    )
    found = stored(
        lines.groupBy("key").agg(F.array_sort(F.collect_set("notice")).alias("names"), F.collect_set("line").alias("lines"))
        .select("key", F.array_join("names", ",").alias("notices"), F.size("lines").cast("long").alias("n_notices")), "license-notices",
    )
    rows = told.select("doc_id", "key", "text_digest").join(texts, "text_digest", "left").join(found, "key", "left")
    return rows.select(
        "doc_id", "text_digest", "license", F.coalesce("notices", F.lit("")).alias("notices"),
        F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
    )


def _sql_canonical(expr: str) -> str:
    out = f"lower({expr})"
    out = rf"regexp_replace({out}, '(?m)^[\x20\x09]*(?://+|#+|\*+|;+|--+|/\*+)', '', 'g')"
    out = (rf"regexp_replace({out}, '(?m)^[\x20\x09]*(?:copyright\b[^\n]*(?:[0-9]{{4}}|\(c\)|©)|\(c\)|©|"
           rf"all rights reserved\.?$)[^\n]*', '', 'g')")
    out = rf"regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')"
    out = f"(' ' || trim({out}) || ' ')"
    for spelling, common in SPELLINGS:
        out = f"replace({out}, '{spelling}', '{common}')"
    return f"trim({out})"


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


LICENSE_SQL = f"""
with known as (
  select distinct license, kind, sha256({_sql_canonical('text')}) as digest
  from (values {', '.join(f"({_quoted(a)}, {_quoted(b)}, {_quoted(c)})" for a, b, c in KNOWN)}) as v(license, kind, text)),
d as (select doc_id, coalesce(text, '') as text from documents),
lines as (select doc_id, sha256({_sql_canonical('line')}) as digest
          from (select doc_id, unnest(string_split(text, chr(10))) as line from d)),
found as (select doc_id, string_agg(distinct license, ',' order by license) as notices, count(*) as n_notices
          from lines join known using (digest) where kind = 'notice' group by doc_id)
select d.doc_id, sha256({_sql_canonical('d.text')}) as text_digest, t.license,
       coalesce(f.notices, '') as notices, coalesce(f.n_notices, 0) as n_notices
from d left join found f using (doc_id)
left join known t on t.kind = 'text' and t.digest = sha256({_sql_canonical('d.text')})
"""
