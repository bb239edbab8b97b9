"""Personal data by bootstrapped contextual extraction, in built-in column expressions only.

1. Base patterns find e-mail addresses, IP addresses, payment cards and phone numbers; checks on ranges,
   digit counts and the Luhn sum drop matches that are none. What is left are the seeds.
2. Every seed, every other word that holds a digit or an at sign and every run of such words on a line is
   an occurrence with its context: the two words before and the one after. A run stands for its first word,
   which has the same words before it; next to a seed, the other words of a run have the context of the run
   as well. Contexts make lexical patterns of three forms.
3. Patterns and instances form a graph. A pattern's confidence for a kind is the mean score of its
   distinct instances (unknown ones count as zero); patterns with enough support and confidence pass
   their confidence on to their unknown instances. This is repeated a few times.
4. Occurrences of unknown instances that stand in a confident pattern become spans of that kind.

Steps 2 to 4 work on occurrences only, a table without texts, written once. Copies of a text cannot raise
a pattern's support, as instances count once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorkit.llm.common import SPACE, free_name, text_key
from mirrorkit.session import stored

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Where nothing that follows could use what a quantifier gives back, it is possessive,
# and a match starts where its first run starts: both keep the time linear on very long runs.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

# A word with a digit or an at sign.
MARKED = rf"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"
# Two or more of them on one line.
RUN = rf"{MARKED}(?:[\x20\x09]++[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+)++"

SPAN = "array<struct<kind:int,start:int,end:int>>"
OCCURRENCE = "array<struct<kind:int,start:int,end:int,surface:string,left2:string,left1:string,right1:string>>"


@dataclass(frozen=True)
class Bootstrap:
    """Rounds of scoring, and what a pattern and an instance need to be believed.

    ``support`` is the least sum of instance scores of a pattern, ``confidence`` the least mean score,
    ``smoothing`` is added to the number of instances. ``instance`` is the least score of a new one.
    """

    rounds: int = 3
    support: float = 4.0
    confidence: float = 0.7
    smoothing: float = 1.0
    instance: float = 0.7


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a Luhn sum divisible by ten."""
    def worth(digit: Column, i: Column) -> Column:
        value = digit.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(value > 9, value - 9).otherwise(value)

    parts = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(F.reverse(digits), i, 1))
    return F.aggregate(F.transform(parts, worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def _is_kind(kind: int, value: Column) -> Column:
    if KINDS[kind] == "ip":
        return value.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if KINDS[kind] == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if KINDS[kind] == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _places(text: Column, pattern: str, kind: Column, good) -> Column:
    """Matches of a pattern with places in code points and the words around them, other matches included.

    The texts between matches and the matches alternate, so their lengths give the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(OCCURRENCE)
    between = F.split(text, pattern, -1)
    pairs = F.arrays_zip(
        F.slice(between, F.lit(1), F.size(found)).alias("before"), found.alias("value"),
        F.slice(between, F.lit(2), F.size(found)).alias("after"), F.slice(found, F.lit(2), F.size(found)).alias("next"),
        F.slice(between, F.lit(3), F.size(found)).alias("then"),
    )
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), none.alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["before"])
        end = begin + F.length(x["value"])
        tail = F.concat(acc["tail"], x["before"])
        left, right = _words_before(tail), _word_after(F.concat(x["after"], F.coalesce(x["next"], F.lit("")), F.coalesce(x["then"], F.lit(""))))
        one = F.struct(
            kind.alias("kind"), begin.alias("start"), end.alias("end"), x["value"].alias("surface"),
            left[0].alias("left2"), left[1].alias("left1"), right.alias("right1"),
        )
        more = F.when(good(x["value"]), F.array(one).cast(OCCURRENCE)).otherwise(none)
        tail = F.substring(F.concat(F.substring(tail, -80, 80), x["value"]), -80, 80)
        return F.struct(end.alias("at"), tail.alias("tail"), F.concat(acc["out"], more).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(pairs, start, add, lambda acc: acc["out"])).otherwise(none)


def _tidy(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"^[^\p{L}0-9]+|[^\p{L}0-9]+$", ""))


def _words_before(text: Column) -> tuple[Column, Column]:
    """(the word before the last, the last word); both lie in the last 80 characters or are empty."""
    tail = F.substring(text, -80, 80)
    words = F.regexp_extract_all(tail, F.lit(rf"[^{SPACE}]++"), F.lit(0))
    return (
        _tidy(F.coalesce(F.get(words, F.size(words) - 2), F.lit(""))),
        _tidy(F.coalesce(F.get(words, F.size(words) - 1), F.lit(""))),
    )


def _word_after(text: Column) -> Column:
    return _tidy(F.regexp_extract(F.substring(text, 1, 80), rf"^[{SPACE}]*([^{SPACE}]+)", 1))


def _spans(occurrences: Column) -> Column:
    return F.transform(occurrences, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def find_base(docs: DataFrame) -> DataFrame:
    """``doc_id, key, base, occurrences`` for each row; ``base`` are the base spans, kind by kind."""
    text = F.col("text")
    seeds = [_places(text, p, F.lit(k), lambda v, k=k: _is_kind(k, v)) for k, p in enumerate((EMAIL, IP, CARD, PHONE))]
    email = F.when(F.contains(text, F.lit("@")), seeds[0]).otherwise(F.array().cast(OCCURRENCE))
    phone = F.when(F.contains(text, F.lit("+")), seeds[3]).otherwise(F.array().cast(OCCURRENCE))
    step = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("key", text_key(text)).withColumn("digits", text.rlike("[0-9@]"))
    step = step.select("doc_id", "key", "text", F.when(F.col("digits"), F.concat(email, seeds[1], seeds[2], phone)).otherwise(F.array().cast(OCCURRENCE)).alias("seeds"), "digits")
    marked, runs = (
        F.when(F.col("digits"), _places(text, pattern, F.lit(None).cast("int"), lambda v: F.lit(True))).otherwise(F.array().cast(OCCURRENCE))
        for pattern in (MARKED, RUN)
    )
    step = step.select("doc_id", "key", "seeds", marked.alias("marked"), runs.alias("runs"))
    base = _spans(F.col("seeds"))
    step = step.select("doc_id", "key", "seeds", F.transform("marked", _trim).alias("marked"), F.transform("runs", _trim).alias("runs"), base.alias("base"))

    def free(x: Column) -> Column:
        return (x["start"] < x["end"]) & ~F.exists(F.col("base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))

    step = step.select(
        "doc_id", "key", "seeds", "base", F.filter("marked", free).alias("words"), F.filter("runs", free).alias("runs"),
        F.filter("runs", lambda x: (x["start"] < x["end"]) & ~free(x)).alias("mixed"),
    )
    words = F.filter("words", lambda w: ~F.exists("runs", lambda r: r["start"] == w["start"]))
    inside = F.flatten(F.transform("mixed", lambda r: F.transform(
        F.filter("words", lambda w: (w["start"] >= r["start"]) & (w["end"] <= r["end"])),
        lambda w: F.struct(
            w["kind"].alias("kind"), w["start"].alias("start"), w["end"].alias("end"), w["surface"].alias("surface"),
            r["left2"].alias("left2"), r["left1"].alias("left1"), r["right1"].alias("right1"),
        ),
    )))
    return step.select("doc_id", "key", "base", F.concat("seeds", words, "runs", inside).alias("occurrences"))


def _trim(x: Column) -> Column:
    """An occurrence without the punctuation around it."""
    lead = F.length(F.regexp_extract(x["surface"], r"^[^\p{L}0-9]*", 0))
    trail = F.length(F.regexp_extract(x["surface"], r"[^\p{L}0-9]*$", 0))
    size = F.greatest(F.length(x["surface"]) - lead - trail, F.lit(0))
    return F.struct(
        x["kind"].alias("kind"), (x["start"] + lead).alias("start"), (x["start"] + lead + size).alias("end"),
        F.substring(x["surface"], lead + 1, size).alias("surface"), x["left2"].alias("left2"),
        x["left1"].alias("left1"), x["right1"].alias("right1"),
    )


def _patterns(x: str = "o") -> Column:
    left1, left2, right1 = F.col(f"{x}.left1"), F.col(f"{x}.left2"), F.col(f"{x}.right1")
    forms = F.array(
        F.when(left1 != "", F.concat(F.lit("L "), left1)),
        F.when((left1 != "") & (left2 != ""), F.concat(F.lit("LL "), left2, F.lit(" "), left1)),
        F.when((left1 != "") & (right1 != ""), F.concat(F.lit("LR "), left1, F.lit(" "), right1)),
    )
    return F.filter(forms, lambda form: form.isNotNull())


def bootstrap(found: DataFrame, settings: Bootstrap = Bootstrap()) -> tuple[DataFrame, DataFrame]:
    """(patterns, instances): confident ``pattern, kind, conf`` and new ``surface, kind, score``.

    ``found`` is the stored result of ``find_base``.
    """
    edges = stored(
        found.select(F.explode("occurrences").alias("o"))
        .select(F.lower("o.surface").alias("surface"), F.col("o.kind").alias("kind"), F.explode(_patterns()).alias("pattern"))
        .groupBy("pattern", "surface").agg(F.max("kind").alias("kind")), "pii-edges",
    )
    # A surface that is a seed anywhere is one everywhere.
    seeds = stored(edges.filter("kind is not null").groupBy("surface").agg(F.max("kind").alias("kind")).withColumn("score", F.lit(1.0)), "pii-seeds")
    n = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    # Only patterns with a seed can ever be believed before others are found through them.
    known, learned, patterns = seeds, None, None
    for _ in range(settings.rounds):
        support = (
            edges.select("pattern", "surface").join(known, "surface")
            .groupBy("pattern", "kind").agg(F.sum("score").alias("support"))
            .filter(F.col("support") >= settings.support)
        )
        conf = F.col("support") / (F.col("n") + F.lit(settings.smoothing))
        patterns = stored(
            support.join(n, "pattern").select("pattern", "kind", conf.alias("conf"))
            .filter(F.col("conf") >= settings.confidence), "pii-patterns",
        )
        miss = F.exp(F.sum(F.log(1 - F.col("conf"))))
        learned = stored(
            edges.select("pattern", "surface").join(patterns, "pattern")
            .join(seeds.select("surface"), "surface", "left_anti")
            .groupBy("surface", "kind").agg((1 - miss).alias("score"))
            .groupBy("surface").agg(F.max(F.struct("score", "kind")).alias("best"))
            .select("surface", F.col("best.kind").alias("kind"), F.col("best.score").alias("score"))
            .filter(F.col("score") >= settings.instance), "pii-instances",
        )
        known = seeds.unionByName(learned)
    return patterns, learned


def find_spans(docs: DataFrame, settings: Bootstrap = Bootstrap()) -> DataFrame:
    """``doc_id, key, base, added`` for each row of ``docs``; see ``pii_rows`` for special cases."""
    found = stored(find_base(docs), "pii-base")
    patterns, instances = bootstrap(found, settings)
    unknown = (
        found.filter(F.exists("occurrences", lambda o: o["kind"].isNull()))
        .select("key", F.explode("occurrences").alias("o")).filter("o.kind is null")
        .select("key", "o.start", "o.end", F.lower("o.surface").alias("surface"), F.explode(_patterns()).alias("pattern"))
    )
    added = stored(
        unknown.join(instances.select("surface", "kind"), "surface").join(patterns.select("pattern", "kind"), ["pattern", "kind"])
        .groupBy("key").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("added")), "pii-added",
    )
    return found.select("doc_id", "key", "base").join(added, "key", "left").withColumn(
        "added", F.coalesce(F.col("added"), F.array().cast(SPAN)),
    )


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"),
    )), ",")


def _count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def pii_rows(docs: DataFrame, settings: Bootstrap = Bootstrap()) -> DataFrame:
    """``doc_id``, base counts per kind, a digest of the base spans and all spans, a row per document.

    Needs ``doc_id`` and ``text``; other columns are ignored. A null or empty text has no spans. A null
    ``doc_id`` stays null; equal texts get equal spans, each row its own result. An empty table gives no
    rows. Whole texts are searched, however long; the search is linear in a text's length, the places of
    its matches are listed in time that grows with the square of their number (10,000 words of digits in
    one text take some seconds). Spans are ``kind:start:end`` in code points.
    """
    spans = find_spans(docs, settings)
    every = F.sort_array(F.concat(F.col("base"), F.col("added")))
    counts = [_count_of(F.col("base"), k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(every).alias("spans"))


def redact(docs: DataFrame, settings: Bootstrap = Bootstrap()) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; ``n_chars`` follows where it exists.

    All rows stay, a null text stays null. Overlapping spans are replaced once, by the first one's kind.
    """
    key, spans_name = free_name(docs, "pii_key"), free_name(docs, "pii_spans")
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"], s["end"], s["kind"])))
    # Copies have one row.
    spans = stored(
        find_spans(docs, settings).withColumn(spans_name, every).filter(F.size(spans_name) > 0)
        .groupBy(F.col("key").alias(key)).agg(F.first(spans_name).alias(spans_name)), "pii-spans",
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = F.array(*[F.lit(f"[{kind.upper()}]") for kind in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"]))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(F.col(spans_name), start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    # Every span holds a digit or an at sign. Texts without either pass straight through; the rest meet their
    # spans by one shuffle, whatever the number of spans.
    marked = F.coalesce(text.rlike("[0-9@]"), F.lit(False))
    joined = docs.filter(marked).withColumn(key, text_key(text)).join(spans.hint("merge"), key, "left")
    joined = joined.withColumn("text", F.when(F.col(spans_name).isNull(), F.col("text")).otherwise(clean))
    if "n_chars" in docs.columns:
        changed = F.when(F.col(spans_name).isNull(), F.col("n_chars")).otherwise(F.length("text"))
        joined = joined.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return docs.filter(~marked).unionByName(joined.select(*docs.columns))
