"""Licences, quality, personal data, language, toxicity and mixing beside brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrorkit.llm import licenses, quality, toxicity
from mirrorkit.llm.language import _document_rows, document_languages, fit_sample, language_filter, page_languages
from mirrorkit.llm.licenses import license_scan
from mirrorkit.llm.mixing import mix, mix_shares
from mirrorkit.llm.pii import Bootstrap, find_spans, pii_rows, redact
from mirrorkit.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import DOCS, ODD
from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_beside_sql(spark, name):
    assert compare(spark, connect(SMALL), name, QUERIES[name], ORACLES[name], SMALL) is None


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], DOCS)


# Licences


def test_licence_texts_are_known_in_any_dress(spark, odd, none):
    dressed = "# Copyright (c) 2019 Some One\n#\n# " + licenses.MIT.replace("\n", "\n# ").replace("license", "Licence").upper()
    comment = "/* (C) 2001 X */\n" + licenses.ISC.replace(".", " .")
    texts = [licenses.MIT, dressed, comment, licenses.ZERO_BSD, licenses.MIT + " and more",
             "hello\nReleased under the MIT Licence.\nreleased under the mit license!\nLicensed under CC BY 4.0", "", None]
    rows = license_scan(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [r["license"] for r in rows] == ["MIT", "MIT", "ISC", "0BSD", None, None, None, None]
    assert (rows[5]["notices"], rows[5]["n_notices"]) == ("CC-BY-4.0,MIT", 3)
    assert rows[6]["text_digest"] == rows[7]["text_digest"] == hashlib.sha256(b"").hexdigest()
    assert license_scan(odd).count() == len(ODD) and license_scan(none).count() == 0


# Quality


def measures(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(ws[i:i + 3]) for i in range(len(ws) - 2))
    repeated = {p for i in range(len(ws) - 2) if grams[tuple(ws[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    ls = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(ls) - len(set(ls)), len(repeated)


def test_quality_measures_by_brute_force(spark, odd, none):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab #\n\t|é😀"), 300)) for _ in range(40)] + ["a b c a b c", "x x x x", "a b", "one\n\none\none"]
    rows = {r["doc_id"]: r for r in quality.quality_rows(docs_of(spark, texts)).collect()}
    for i, text in enumerate(texts):
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == measures(text), text
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    odd_rows = quality.quality_rows(odd)
    assert odd_rows.count() == len(ODD) and odd_rows.filter("doc_id = 2").first()["n_words"] == 0
    assert quality.quality_rows(none).count() == 0


def test_cascade_orders_rules_and_keeps_the_same_texts(spark, odd):
    texts = ["w " * 10] * 30 + [" ".join(f"w{i}" for i in range(80))] * 5 + ["# " * 60 + " ".join(f"q{i}" for i in range(60))] * 3
    docs = docs_of(spark, texts)
    # The clock of the test gives each rule its cost, so the order does not depend on the machine.
    cost = {"short": 4.0, "repeats": 30.0, "symbols": 1.0, "dup_lines": 2.0, "word_length": 8.0, "capitals": 1.0}
    ticks = iter([t for rule in quality.RULES for t in (0.0, 9 * cost[rule.name], 0.0, cost[rule.name])])
    order = quality.ranked(quality.sample_of(docs), runs=2, clock=lambda: next(ticks))
    assert [(rule.name, seconds) for rule, seconds, _ in order] == [
        (name, cost[name]) for name in ("short", "word_length", "symbols", "repeats", "dup_lines", "capitals")
    ]
    assert [round(share * 38) for _, _, share in order] == [30, 33, 3, 30, 0, 0]
    kept = {r["doc_id"] for r in quality.quality_filter(docs).collect()}
    assert kept == {r["doc_id"] for r in quality.quality(docs, rules=quality.RULES[::-1]).filter("kept").collect()} == set(range(30, 35))
    assert quality.quality_filter(odd).columns == odd.columns


# Personal data

BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    values = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def base_spans(text):
    def good(kind, value):
        digits = re.sub("[^0-9]", "", value)
        return (kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in value.split(".")))
                or (kind == "card" and 16 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 8 <= len(digits) <= 15))

    return [(k, m.start(), m.end()) for k, p in BASE for m in re.finditer(p, text) if good(k, m.group())]


def test_base_spans_by_brute_force(spark, odd, none):
    rng = np.random.default_rng(5)
    parts = ["a@b.c", "x_y@z.d_q@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "001.02.3.255", "4539 1488 0343 6467", "4539148803436467-",
             "+1 (555) 010-9999", "+49 30 (", "++7 12345678", "é😀", " ", "\n", "..", "@", "-", "0", "@@a.b", "a@b", "%+a@b-.c."]
    texts = ["".join(rng.choice(parts, rng.integers(1, 14))) for _ in range(150)]
    # Long runs, short enough for the plain patterns here, which take time with the square of a run.
    texts += ["a" * 5000, "1" * 5000, "1." * 2000, "a@" + "b." * 5000 + "c", "+" + "1" * 5000 + " (" * 200, "9 " * 1000]
    rows = {r["doc_id"]: r for r in pii_rows(docs_of(spark, texts)).collect()}
    for i, text in enumerate(texts):
        want = base_spans(text)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert rows[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), text[:200]
        assert [rows[i][f"n_{k}"] for k, _ in BASE] == [sum(x[0] == k for x in want) for k, _ in BASE]
    got = pii_rows(odd)
    assert got.count() == len(ODD) and pii_rows(none).count() == 0
    assert got.filter("doc_id = 6").first()["spans"] == "ip:23:34,card:39:58"


def test_contexts_of_seeds_find_other_identifiers(spark):
    """Cards that fail the check stand where good ones stand; a price stands elsewhere."""
    stems = [f"4539{k:011d}" for k in range(10, 130, 10)]
    good = [next(s + d for d in "0123456789" if luhn(s + d)) for s in stems]
    texts = [f"please charge {c} today number {i}" for i, c in enumerate(good)] + [
        "please charge 1234567812345678 today again", "we paid 1234567812345679 there", "please charge 12-34 today", "it cost 77 only"]
    docs = docs_of(spark, texts)
    rows = {r["doc_id"]: r["spans"] for r in pii_rows(docs).collect()}
    assert rows[12] == "card:14:30" and rows[14] == "card:14:19" and rows[13] == rows[15] == ""
    clean = {r["doc_id"]: r["text"] for r in redact(docs).collect()}
    assert clean[0] == "please charge [CARD] today number 0" and clean[12] == "please charge [CARD] today again" and clean[15] == texts[15]
    # Copies of one text are one instance and support nothing.
    copies = docs_of(spark, [texts[0]] * 20 + [texts[12]])
    assert find_spans(copies, Bootstrap()).filter(F.size("added") > 0).count() == 0


def test_groups_of_an_identifier_are_one_span(spark):
    stems = [f"4539{k:011d}" for k in range(10, 210, 10)]
    good = [next(s + d for d in "0123456789" if luhn(s + d)) for s in stems]
    texts = [f"please charge {c} today number {i}" for i, c in enumerate(good)] + [
        "please charge 1234 5678 1234 5678 today again", "please charge 1234567812345678 1234567812345679 today", "we paid 12 34 there",
        f"please charge {good[0]}, 1234567812345671 today"]
    assert not luhn("1234567812345678") and luhn(good[0])
    docs = docs_of(spark, texts)
    rows = {r["doc_id"]: r["spans"] for r in pii_rows(docs).collect()}
    assert rows[20] == "card:14:33" and rows[21] == "card:14:47" and rows[22] == ""
    clean = {r["doc_id"]: r["text"] for r in redact(docs).collect()}
    assert clean[20] == "please charge [CARD] today again" and clean[21] == "please charge [CARD] today"
    assert clean[23] == "please charge [CARD], [CARD] today" and clean[22] == texts[22]


def test_redaction_keeps_rows_columns_and_lengths(spark, odd, none):
    rows = redact(odd)
    assert rows.columns == odd.columns and rows.count() == len(ODD) and redact(none).count() == 0
    got = {(r["doc_id"], r["source"]): r for r in rows.collect()}
    assert got[None, None]["text"] in (None, "mail [EMAIL] or call [PHONE] now")
    assert got[2, "a"]["text"] is None and got[6, ""]["text"].endswith("with [IP] and [CARD] in it")
    assert got[6, ""]["n_chars"] == len(got[6, ""]["text"])


# Language


def sentences(rng, words, n):
    return " ".join(rng.choice(words, n))


def corpus(rng):
    en, de = ["the", "and", "with", "from", "that", "there", "house"], ["der", "und", "mit", "von", "dass", "dort", "straße"]
    return [(i, sentences(rng, en if i % 2 else de, 30), "en" if i % 2 else "de", f"h{i % 5}", 0) for i in range(120)]


def test_language_by_text_even_where_declared_wrongly(spark, odd, none):
    rng = np.random.default_rng(1)
    rows = corpus(rng)
    rows[10] = (10, rows[11][1], "de", "h0", 0)
    rows += [(500, "привет мир это русский текст " * 5, None, "h1", 0), (501, "123 456 ###", "en", "h1", 0), (502, None, "en", "h1", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in document_languages(docs).collect()}
    assert all(got[i]["language"] == ("en" if i % 2 else "de") and got[i]["kept"] for i in range(120) if i != 10)
    assert got[10]["language"] == "en"
    assert [(got[i]["language"], got[i]["kept"]) for i in (500, 501, 502)] == [("und", False)] * 3
    kept = language_filter(docs.withColumn("language_key", F.lit(1)), wanted=("de",))
    assert {r["doc_id"] for r in kept.collect()} == set(range(0, 120, 2)) - {10}
    assert document_languages(odd).count() == len(ODD) and language_filter(odd).columns == odd.columns
    assert document_languages(none).count() == 0 and language_filter(none).count() == 0


def rare_corpus(rng):
    """12,000 rows, 30 of them in a language of its own words."""
    fi = ["ja", "että", "mutta", "kanssa", "täällä", "talossa", "yhdessä"]
    rows = [(i, t, lang, source, n) for j in range(100) for i, t, lang, source, n in [(j * 120 + r[0], *r[1:]) for r in corpus(rng)]]
    for i in range(0, 12_000, 400):
        rows[i] = (i, sentences(rng, fi, 30), "fi", "rare", 0)
    return rows


def test_language_of_a_small_share_is_modelled(spark):
    rows = rare_corpus(np.random.default_rng(4))
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in document_languages(docs).collect()}
    assert {(got[i]["text_language"], got[i]["language"], got[i]["kept"]) for i in range(0, 12_000, 400)} == {("fi", "fi", True)}
    assert language_filter(docs).filter("lang = 'fi'").count() == 30


def test_copies_take_no_place_in_the_language_sample(spark):
    """60,000 rows of 24 texts: each text is drawn once, and each language is known."""
    rng = np.random.default_rng(6)
    texts = [(lang, sentences(rng, words, 30)) for words, lang in zip((
        ["the", "with", "house"], ["der", "mit", "straße"], ["ja", "että", "kanssa"]), ("en", "de", "fi"), strict=True) for _ in range(8)]
    few = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(texts)], "at int, text string, lang string")
    # The first text is hot: a third of all rows.
    at = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 24).cast("int")
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), at.alias("at"), F.lit("s").alias("source"), F.lit(0).alias("n_chars")).join(few, "at")
    sample, languages = fit_sample(_document_rows(docs))
    assert languages == ["de", "en", "fi"]
    drawn = sorted((r.declared, r.text) for r in sample.collect())
    present = {(r.lang, r.text) for r in docs.select("lang", "text").distinct().collect()}
    assert len(present) > 16 and drawn == sorted(present)
    told = document_languages(docs).groupBy("declared", "text_language", "kept").count().collect()
    assert sorted((r["declared"], r["text_language"], r["kept"]) for r in told) == [(x, x, True) for x in languages]


def test_hosts_decide_where_texts_do_not(spark):
    """A text that fits both languages goes with its host's others; with no host evidence, with what is declared."""
    rng = np.random.default_rng(2)
    pages = [(i, f"https://{'www.deutsch.de' if i % 2 == 0 else 'news.english.uk'}/{i}",
              f"<html lang={'de' if i % 2 == 0 else 'en-GB'}><script>the</script><p>{t}</p></html>") for i, t, *_ in corpus(rng)]
    pages += [(900, "http://www.deutsch.de/x", "<p>ok ok</p>"), (901, "http://news.english.uk/y", "<p>ok ok</p>"), (902, None, None)]
    got = {r["page_id"]: r for r in page_languages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert (got[900]["language"], got[901]["language"], got[902]["language"]) == ("de", "en", "und")
    assert got[3]["declared"] == "en" and got[900]["declared"] is None


# Toxicity


def toxic_corpus(rng, n):
    plain = [f"{a}{b}" for a in ("ta", "mo", "li", "re", "su") for b in ("ra", "ne", "ko", "vi", "da", "pe")]
    bad = ["vreksnip", "grolbwarz", "zoqtrump"]
    rows, labels = [], []
    for i in range(n):
        words = list(rng.choice(plain, 60))
        if i % 4 == 0:
            for at in rng.choice(60, 6, replace=False):
                words[at] = str(rng.choice(bad))
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(i % 4 == 0)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, odd, none):
    rows, labels = toxic_corpus(np.random.default_rng(0), 500)
    docs = spark.createDataFrame(rows, DOCS)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, known).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(r["predicted"], i % 4 == 0) for i, r in got.items() if r["held_out"]]
    assert np.mean([bool(p) == t for p, t in held]) > 0.9 and all(0 <= r["score"] <= 1 for r in got.values())
    # The labels of held-out rows make no difference.
    flipped = known.withColumn("toxic", F.when(toxicity.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, flipped).collect()}
    assert all(again[i] == r["score"] for i, r in got.items())
    scored = toxicity.toxicity(odd, known)
    assert scored.count() == len(ODD) and scored.filter("score is null or held_out is null").isEmpty()
    assert toxicity.toxicity(none, known).count() == 0


def test_rare_toxic_words_tell_beside_very_common_ones():
    """One word in 2000 contexts, 700 in 5 each: more than 4096 bytes, each far below the first one's evidence."""
    rare = ["".join(chr(97 + (k // 26 ** j * 7 + j) % 26) for j in range(3)) * 3 for k in range(700)]
    toxic_texts = [" ".join(f"a{i} vreksnip" for i in range(j, 2000, 8)) for j in range(4)]
    toxic_texts += [" ".join(f"b{k % 97} {word} c{j}" for k, word in enumerate(rare)) for j in range(5)]
    ordinary = [" ".join(f"{x}{(i * 7 + j) % 2000}" for i in range(4000) for x in "abc") for j in range(20)]
    alone = toxic_texts[:4] + [f"b{j} grolbwarz c{j}" for j in range(5)]
    assert "grolbwarz" in toxicity.telling_words(alone, ordinary)  # 5 contexts beside 2000
    telling = toxicity.telling_words(toxic_texts, ordinary)
    assert "vreksnip" in telling and set(rare) <= set(telling)
    sample = [(half, text, toxic) for half in (0, 1) for toxic, texts in ((1, toxic_texts), (0, ordinary)) for text in texts]
    held = toxicity.fit(sample, {0: 1.0, 1: 1.0}).toxic.decode("utf-8", "replace").split()
    assert set(rare) <= set(held)


# Mixing


def fill(sizes, weights, epochs):
    """Targets by sharing the excess again and again."""
    total, target, full = sum(sizes), [0.0] * len(sizes), set()
    while True:
        rest = [i for i in range(len(sizes)) if i not in full]
        left = total - sum(target[i] for i in full)
        for i in rest:
            target[i] = left * weights[i] / sum(weights[j] for j in rest)
        over = [i for i in rest if target[i] > epochs * sizes[i] + 1e-9]
        if not over:
            return target
        for i in over:
            target[i] = epochs * sizes[i]
            full.add(i)


def test_targets_and_taken_words(spark):
    rng = np.random.default_rng(4)
    rows, doc = [], 0
    for source, n in (("big", 900), ("a", 60), ("tiny", 3), (None, 200), ("é", 120), ("z", 40)):
        for _ in range(n):
            rows.append((doc, " ".join(["w"] * int(rng.integers(0, 30))), "en", source, 0))
            doc += 1
    docs = spark.createDataFrame(rows, DOCS)
    got = mix_shares(docs).collect()
    size = defaultdict(int)
    for r in got:
        size[r["source"]] += r["size"]
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    want = dict(zip(names, fill([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3), strict=True))
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 45 for s in names), (dict(taken), want)
    again = {r["doc_id"]: r["taken"] for r in mix_shares(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    copies = Counter(r["doc_id"] for r in mix(docs).collect())
    assert copies == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})


def test_mixing_odd_tables(spark, odd, none):
    rows = mix_shares(odd).collect()
    assert len(rows) == len(ODD) and {r["size"] for r in rows if r["doc_id"] in (2, 3, 4)} == {0}
    assert len({r["taken"] for r in rows if r["doc_id"] == 1}) == 1
    assert mix(odd).columns == odd.columns
    assert mix_shares(none).count() == 0 and mix(none).count() == 0
