"""Language identification by Bayesian fusion of four kinds of evidence.

* The text: log likelihoods under letter n-gram models, one per language, and under a flat model that
  stands for "none of them".
* The declared language of the markup (or of a table column): how often each language is declared so.
* The suffix of the address: how often each language is found under it.
* The host: its own mix of languages, smoothed toward that of its domain, which is smoothed toward the
  whole table's. A document's own share is taken out of its host's and domain's counts.

Every declared language that has text with a letter is modelled, however small its share of the table. The
n-gram models are fitted on a bounded sample of each (about ``FIT_TEXTS`` texts, lowest hash first), by
declared language, and refitted once with the languages that the first models see. A model takes 1 MB of the
driver and 0.5 MB of a Python worker. All other tables are grouped sums of text posteriors over all rows. Texts are read once; what follows works on a narrow table of
likelihoods, where the small tables are joined by key, broadcast only while they are small.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorkit.llm.common import free_name, small_batches, table, text_key
from mirrorkit.session import stored

FIT_TEXTS = 1000
FIT_CHARS = 20_000
BUCKETS = 1 << 16
ADDED = 0.5
TEMPER = 0.1
UNKNOWN = "und"
UNKNOWN_PRIOR = 1e-3
HOST_WEIGHT = 20.0
DOMAIN_WEIGHT = 50.0
EVIDENCE_WEIGHT = 1.0
LEAST_CONFIDENCE = 0.5

# Only letters tell: ASCII bytes that are none become spaces; bytes of longer code points stay.
_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
_SPACES = re.compile(rb" +")
_LETTER = r"[A-Za-z]|[^\x00-\x7F]"


def grams(text: str) -> np.ndarray:
    """Buckets of all letter bigrams and trigrams; empty without letters."""
    data = _SPACES.sub(b" ", b" " + text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS) + b" ")
    if len(data) < 3:
        return np.empty(0, dtype=np.int64)
    codes = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    two = codes[:-1] * 256 + codes[1:]
    three = ((two[:-1] * 256 + codes[2:]) * 40_503 >> 4) % BUCKETS
    return np.concatenate([two, three + BUCKETS])


class TextModel:
    """Log probabilities of n-grams per language, with the flat model last."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = [*languages, UNKNOWN]
        self.table = np.full((2 * BUCKETS, len(languages) + 1), -math.log(BUCKETS), dtype=np.float32)
        for k, row in enumerate(counts):
            for half in (slice(0, BUCKETS), slice(BUCKETS, None)):
                self.table[half, k] = np.log((row[half] + ADDED) / (row[half].sum() + ADDED * BUCKETS))

    def likelihoods(self, text: str) -> list[float] | None:
        """Tempered log likelihoods, greatest 0; None without letters."""
        found = grams(text)
        if not len(found):
            return None
        total = np.zeros(len(self.languages))
        for at in range(0, len(found), 1 << 16):
            total += self.table[found[at:at + (1 << 16)]].sum(axis=0, dtype=np.float64)
        total *= TEMPER
        return (total - total.max()).tolist()


def fit_text_model(languages: list[str], sample: Callable[[], Iterable[tuple[str, str]]]) -> TextModel:
    """Models of all ``languages``; each call of ``sample`` gives the same (declared, text) rows, one at a time."""
    def count(text: str) -> np.ndarray:  # one text at a time: all n-grams together would take far more room than the texts
        return np.bincount(grams(text), minlength=2 * BUCKETS).astype(np.uint32)

    told = np.zeros((len(languages), 2 * BUCKETS), dtype=np.uint32)
    if not languages:
        return TextModel(languages, told)
    for declared, text in sample():
        told[languages.index(declared)] += count(text)
    first, seen = TextModel(languages, told), np.zeros_like(told)
    for _, text in sample():
        known = first.likelihoods(text)
        if known is not None:
            seen[int(np.argmax(known[:-1]))] += count(text)
    # A language that the first models see nowhere keeps its first model.
    lost = ~seen.any(axis=1)
    seen[lost] = told[lost]
    return TextModel(languages, seen)


def normal_language(value: Column) -> Column:
    """The primary subtag in lower case; null where there is none."""
    found = F.regexp_extract(F.lower(F.trim(value.cast("string"))), "^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(found != "", found)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.lower(url.cast("string")), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    return F.when(host != "", host)


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.when(host.isNotNull(), F.substring_index(host, ".", -2))


def suffix_of(host: Column) -> Column:
    return F.when(host.contains("."), F.substring_index(host, ".", -1))


def _score(batches, model: TextModel):
    import pyarrow as pa

    for batch in batches:
        found = [model.likelihoods(text or "") for text in batch.column("text").to_pylist()]
        columns = [batch.column(name) for name in batch.schema.names if name != "text"]
        names = [name for name in batch.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(pa.float64()))], names=[*names, "known"])


def fit_sample(rows: DataFrame, fit_texts: int = FIT_TEXTS) -> tuple[DataFrame, list[str]]:
    """(stored ``declared, text``, about ``fit_texts`` texts or all there are of each language; the languages).

    Of a language with about n distinct texts those whose hashes lie in the lowest fit_texts / n share are
    drawn, so nothing is ranked and no language has a task of its own. Copies of a text count once.
    """
    text = F.substring("text", 1, FIT_CHARS)
    told = rows.select("declared", text.alias("text")).filter(
        F.col("declared").isNotNull() & (F.col("declared") != UNKNOWN) & F.col("text").rlike(_LETTER),
    ).withColumn("order", F.xxhash64("text", F.lit(5)))
    counts = stored(told.groupBy("declared").agg(F.approx_count_distinct("order").alias("n")), "language-declared")  # a row per language
    near = F.col("order") / F.lit(2.0 ** 64) + 0.5 <= F.lit(float(fit_texts)) / F.col("n")
    drawn = (
        told.join(counts, "declared").filter(near)
        .groupBy("declared", text_key(F.col("text")).alias("key")).agg(F.first("text").alias("text")).select("declared", "text")
    )
    return stored(drawn, "language-sample"), sorted(r.declared for r in counts.collect())


def text_evidence(rows: DataFrame, fit_texts: int = FIT_TEXTS) -> tuple[DataFrame, list[str]]:
    """(stored rows without texts but with likelihoods ``known``, the languages).

    ``rows`` has ``id, key, declared, suffix, host, domain, text``.
    """
    small_batches(rows.sparkSession)
    sample, languages = fit_sample(rows, fit_texts)
    # The driver holds one partition of the sample at a time.
    model = fit_text_model(languages, lambda: ((r.declared, r.text) for r in sample.toLocalIterator()))
    kinds = "id long, key struct<a:long,b:long>, declared string, suffix string, host string, domain string, known array<double>"
    return stored(rows.mapInArrow(lambda batches: _score(batches, model), kinds), "language-evidence"), model.languages


def _softmax(logs: np.ndarray) -> np.ndarray:
    parts = np.exp(logs - logs.max(axis=1, keepdims=True))
    return parts / parts.sum(axis=1, keepdims=True)


def _matrix(column, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A column of arrays of n numbers as a matrix, nulls as zeros, and which rows are null."""
    gone = np.asarray(column.is_null())
    out = np.zeros((len(column), n))
    if not gone.all():
        out[~gone] = np.asarray(column.drop_null().flatten()).reshape(-1, n)
    return out, gone


def _posteriors(batches, flat: list[float]):
    """Text posteriors ``r``; a text without letters tells nothing and counts for nothing."""
    import pyarrow as pa

    for batch in batches:
        known, blank = _matrix(batch.column("known"), len(flat))
        share = _softmax(known + np.array(flat))
        share[blank] = 0
        keep = [name for name in batch.schema.names if name != "known"]
        arrays = [batch.column(name) for name in keep]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(list(known + np.array(flat))), pa.array(blank), pa.array(list(share))], names=[*keep, "k", "blank", "r"])


def _fused(batches, languages: list[str], total: list[float], kinds: dict[str, int]):
    """Adds the logs of all evidence, each group's sums without the row's own share."""
    import pyarrow as pa

    n, total = len(languages), np.array(total)
    prior = (total + EVIDENCE_WEIGHT) / (total.sum() + n * EVIDENCE_WEIGHT)
    for batch in batches:
        logs, _ = _matrix(batch.column("k"), n)
        share, _ = _matrix(batch.column("r"), n)
        others = {}
        for name in ("declared", "suffix", "domain", "host"):
            sums, gone = _matrix(batch.column(f"by_{name}"), n)
            others[name] = np.maximum(sums - share, 0), gone
        domain = (others["domain"][0] + DOMAIN_WEIGHT * prior) / (others["domain"][0].sum(axis=1, keepdims=True) + DOMAIN_WEIGHT)
        host = (others["host"][0] + HOST_WEIGHT * domain) / (others["host"][0].sum(axis=1, keepdims=True) + HOST_WEIGHT)
        logs = logs + np.log(host)
        for name in ("declared", "suffix"):
            sums, gone = others[name]
            rate = (sums + EVIDENCE_WEIGHT) / (np.maximum(total - 1, 0) + EVIDENCE_WEIGHT * kinds[name])
            logs = logs + np.where(gone[:, None], 0.0, np.log(rate))
        post = _softmax(logs)
        blank = np.asarray(batch.column("blank"))
        best = post.argmax(axis=1)  # ties go to the language that is first by name
        names = np.array(languages, dtype=object)
        yield pa.RecordBatch.from_arrays([
            batch.column("id"), batch.column("key"), batch.column("declared"),
            pa.array(np.where(blank, UNKNOWN, names[share.argmax(axis=1)]), pa.string()),
            pa.array(np.where(blank, UNKNOWN, names[best]), pa.string()),
            pa.array(np.where(blank, 0.0, post[np.arange(len(best)), best])),
        ], names=["id", "key", "declared", "text_language", "language", "confidence"])


def fuse(evidence: DataFrame, languages: list[str]) -> DataFrame:
    """``id, key, declared, text_language, language, confidence`` from a stored evidence table.

    Spark groups, sums and joins; the arithmetic on a row's few numbers is done on Arrow batches.
    """
    n = len(languages)
    flat = [math.log(UNKNOWN_PRIOR) if name == UNKNOWN else 0.0 for name in languages]
    names = "id long, key struct<a:long,b:long>, declared string, suffix string, host string, domain string"
    rows = stored(
        evidence.mapInArrow(lambda batches: _posteriors(batches, flat), f"{names}, k array<double>, blank boolean, r array<double>"),
        "language-posteriors",
    )
    sums = F.array(*[F.coalesce(F.sum(F.get("r", F.lit(k))), F.lit(0.0)) for k in range(n)])
    total = list(rows.agg(sums.alias("t")).first()["t"])  # one row
    kinds = {}
    for name in ("declared", "suffix", "domain", "host"):
        counts = stored(
            rows.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias(f"{name}_of")).agg(sums.alias(f"by_{name}")), f"language-by-{name}",
        )
        kinds[name] = max(1, counts.count())
        rows = rows.join(counts, F.col(name) == F.col(f"{name}_of"), "left").drop(f"{name}_of")
    return rows.mapInArrow(
        lambda batches: _fused(batches, languages, total, kinds),
        "id long, key struct<a:long,b:long>, declared string, text_language string, language string, confidence double",
    )


def identified(rows: DataFrame, wanted: tuple[str, ...] | None = None, least: float = LEAST_CONFIDENCE, fit_texts: int = FIT_TEXTS) -> DataFrame:
    """The fused result with ``kept``: a wanted language (all of them by default) with enough confidence."""
    evidence, languages = text_evidence(rows, fit_texts)
    good = (F.col("language") != UNKNOWN) & (F.col("confidence") >= least)
    if wanted is not None:
        good = good & F.col("language").isin(*wanted)
    return fuse(evidence, languages).withColumn("kept", good)


def _document_rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lang, source = F.col("lang").cast("string"), F.col("source").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("id"), text_key(text, lang, source).alias("key"), normal_language(lang).alias("declared"),
        F.lit(None).cast("string").alias("suffix"), source.alias("host"), F.lit(None).cast("string").alias("domain"), text.alias("text"),
    )


def document_languages(docs: DataFrame, wanted: tuple[str, ...] | None = None, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """``doc_id, declared, text_language, language, confidence, kept`` for each document.

    Needs ``doc_id, text, lang, source``: the column ``lang`` is the declared language and the source
    stands for the host. A text without letters (null and empty ones too) is ``und`` with confidence 0 and
    not kept; so is a text that the flat model fits best. A null ``lang`` or ``source`` is no evidence. A
    null ``doc_id`` stays null; equal rows get equal results, each its own. An empty table, or one without
    declared languages, gives every row ``und``. Texts count whole. Every language declared by a text with
    a letter in its first ``FIT_CHARS`` characters is modelled; ``und`` declares none.
    """
    told = identified(_document_rows(docs), wanted, least)
    return told.select(F.col("id").alias("doc_id"), "declared", "text_language", "language", "confidence", "kept")


def page_text(html: Column) -> Column:
    """The visible text of a page, roughly: scripts, styles, comments and tags dropped."""
    out = F.regexp_replace(F.coalesce(html.cast("string"), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*+>", " ")
    return F.regexp_replace(out, r"&[a-zA-Z]{2,8};|&#[0-9xXa-fA-F]{1,8};", " ")


def page_languages(pages: DataFrame, wanted: tuple[str, ...] | None = None, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """``page_id, declared, text_language, language, confidence, kept`` for each page.

    Needs ``page_id, url, html``. The declared language is the ``lang`` attribute of the ``html`` element,
    the suffix and host are those of the address. Special cases are those of ``document_languages``.
    """
    html, host = F.col("html").cast("string"), host_of(F.col("url"))
    declared = normal_language(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z_-]+)", 1))
    rows = pages.select(
        F.col("page_id").cast("long").alias("id"), text_key(F.col("url").cast("string"), html).alias("key"), declared.alias("declared"),
        suffix_of(host).alias("suffix"), host.alias("host"), domain_of(host).alias("domain"), page_text(html).alias("text"),
    )
    told = identified(rows, wanted, least)
    return told.select(F.col("id").alias("page_id"), "declared", "text_language", "language", "confidence", "kept")


def language_filter(docs: DataFrame, wanted: tuple[str, ...] | None = None, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """The documents kept, with their columns.

    The rejected ones are removed by what their verdict depends on (text, language, source), so the join
    has one row for each rejected combination, however often it occurs.
    """
    told = identified(_document_rows(docs), wanted, least)
    key = free_name(docs, "language_key")
    gone = stored(told.filter(~F.col("kept")).select(F.col("key").alias(key)).distinct(), "language-rejected")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumn(key, text_key(text, F.col("lang").cast("string"), F.col("source").cast("string")))
    return keyed.join(gone, key, "left_anti").select(*docs.columns)


def language_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_languages(table(spark, sf_dir, "documents"))


def page_language_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_languages(table(spark, sf_dir, "pages"))
