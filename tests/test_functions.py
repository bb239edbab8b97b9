from __future__ import annotations

from datetime import UTC, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mirrorkit.functions.headers import parse_headers
from mirrorkit.functions.keys import is_real_key, with_key
from mirrorkit.functions.settings import meta_long, meta_long_strict, meta_status, uid_window
from mirrorkit.functions.tags import keyword, keyword_slug, keywords, missing_keywords, safe_flags, tag_signature
from mirrorkit.schemas import columns
from mirrorkit.spec import MirrorSpec

KEY_INPUT = columns(
    "id long, mirror string, message_id string, sender string, subject string, internal_date timestamp, size long"
)
NOON = datetime(2026, 7, 2, 12, 0, 0, 900_000, tzinfo=UTC)


def keys(spark, *rows, specs=()):
    """rows: message_id, sender, subject, date, size"""
    data = [(i, "m", *row) for i, row in enumerate(rows)]
    found = with_key(spark.createDataFrame(data, KEY_INPUT), specs).select("id", "key", "is_synth").collect()
    return {r["id"]: (r["key"], r["is_synth"]) for r in found}


def test_real_ids_are_trimmed_of_any_white_space(spark):
    got = keys(spark, ("<abc@x>", "", "", NOON, 1), ("  <abc@x>\t", "", "", NOON, 2), ("  <abc@x>\r\n", "", "", NOON, 3))
    assert set(got.values()) == {("<abc@x>", False)}


def test_synthesized_keys(spark):
    base = ("", "a@b.c", "hi", NOON, 123)
    got = keys(
        spark, base, (" \t", *base[1:]), (None, *base[1:]), ("", "x@b.c", "hi", NOON, 123), ("", "a@b.c", "hi there", NOON, 123),
        ("", "a@b.c", "hi", NOON, 124), ("", "a@b.c", "hi", NOON.replace(second=1), 123),
        ("", "a@b.c", "hi", NOON.replace(microsecond=0), 123),
    )
    same = {got[i] for i in (0, 1, 2, 7)}
    assert len(same) == 1 and all(synth for _, synth in got.values())
    assert len({got[i] for i in (0, 3, 4, 5, 6)}) == 5
    key = got[0][0]
    import hashlib

    text = f"{int(NOON.timestamp())}|5:a@b.c|2:hi|123"
    assert key == "synth-sha256:" + hashlib.sha256(text.encode()).hexdigest()


def test_lengths_count_bytes_and_fields_do_not_run_together(spark):
    import hashlib

    got = keys(spark, ("", "a", "b\x00c", NOON, 1), ("", "a\x00b", "c", NOON, 1), ("", "", "é", NOON, 1), ("", "1:a|1", "", NOON, 1))
    assert len(set(got.values())) == 4
    text = f"{int(NOON.timestamp())}|0:|2:é|1"
    assert got[2][0].endswith(hashlib.sha256(text.encode()).hexdigest())


def test_seconds_round_down_and_zone_does_not_matter(spark):
    early = datetime(1969, 12, 31, 23, 59, 58, 500_000, tzinfo=UTC)
    rows = [(0, "m", "", "", "", early, 1), (1, "m", "", "", "", NOON, 1)]
    df = spark.createDataFrame(rows, KEY_INPUT)
    aware = {r["id"]: r["key"] for r in with_key(df).collect()}
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        naive = {r["id"]: r["key"] for r in with_key(spark.createDataFrame(
            [(i, m, a, b, c, d.replace(tzinfo=None), s) for i, m, a, b, c, d, s in rows],
            "id long, mirror string, message_id string, sender string, subject string, internal_date timestamp_ntz, size long",
        )).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert aware == naive


def test_key_expression_of_a_spec(spark):
    spec = MirrorSpec("m", key_expr="concat(sender, '/', size)")
    assert keys(spark, ("<x>", "s", "", NOON, 7), specs=[spec])[0] == ("s/7", False)


def test_mark_in_a_genuine_id(spark):
    key, synth = keys(spark, ("synth-sha256:mine", "", "", NOON, 1))[0]
    assert not synth
    assert not spark.range(1).select(is_real_key(F.lit(key)).alias("r")).first()["r"]


def test_keywords_are_the_slugs_without_empty_and_repeated_ones(spark):
    """A list of labels gives each label's tag once, in order of first appearance."""
    labels = [f"{head}{sep}{tail}" for head in ("", "Key", "kEY") for sep in (" ", "+") for tail in ("", "9", "ß9")]
    one = spark.createDataFrame(list(enumerate(labels)), "id int, label string")
    slugs = [r["s"] for r in one.select("id", keyword_slug(F.col("label"), F.lit("_")).alias("s")).orderBy("id").collect()]
    want = list(dict.fromkeys(s for s in slugs if s))
    assert "" in slugs and len(want) < len([s for s in slugs if s])
    many = spark.createDataFrame([(labels,)], "labels array<string>")
    for prefix in ("", "$Label:"):
        got = many.select(keywords(F.col("labels"), F.lit(prefix), F.lit("_")).alias("t"), keyword(F.lit("+"), F.lit(prefix), F.lit("_")).alias("n")).first()
        assert got["t"] == [prefix + s for s in want] and got["n"] is None


def test_flags_missing_tags_and_signature(spark):
    df = spark.createDataFrame(
        [(["\\Seen", "\\Deleted", "x"], ["Work", "b"], ["wORK"]), ([], ["b", "a"], None)],
        "flags array<string>, wanted array<string>, present array<string>",
    )
    rows = df.select(
        safe_flags(F.col("flags"), F.lit(True)).alias("on"), safe_flags(F.col("flags"), F.lit(False)).alias("off"),
        missing_keywords(F.col("wanted"), F.col("present")).alias("missing"), tag_signature(F.col("wanted")).alias("sig"),
    ).collect()
    assert [r["on"] for r in rows] == [["\\Seen"], []] and [r["off"] for r in rows] == [[], []]
    assert [r["missing"] for r in rows] == [["b"], ["b", "a"]]
    assert rows[1]["sig"] == "a\x00b"


HEADERS = [
    ("Subject: Tide table\r\nMessage-Id: <t1@sea>\r\nFrom: Harbour <h@sea>\r\n\r\n", "<t1@sea>", "Harbour <h@sea>", "Tide table"),
    ("From: h@sea\r\nMessage-ID:\r\n\t<t2@sea>\r\n\r\n", "<t2@sea>", "h@sea", ""),
    ("Subject: anonymous\r\nTo: x\r\n\r\n", "", "", "anonymous"),
    ("", "", "", ""),
    ("From: a\n\nSubject: in the body\n", "", "a", ""),
    ("\r\nMessage-Id: <body@x>\r\n", "", "", ""),
    ("broken line\r\nSubject : odd \r\nX-Subject: no\r\nsubject: second\r\n", "", "", "odd"),
    ("Subject: long\r\n\tfold\r\n  again\r\nFrom:x\r\n\r\nMessage-Id: <b@x>", "", "x", "long fold again"),
]


def test_headers(spark):
    df = spark.createDataFrame([(i, h[0]) for i, h in enumerate(HEADERS)], "id int, raw string")
    got = {r["id"]: r for r in parse_headers(df).collect()}
    for i, (raw, mid, sender, subject) in enumerate(HEADERS):
        assert (got[i]["message_id"], got[i]["sender"], got[i]["subject"]) == (mid, sender, subject), raw
        assert got[i]["size"] == len(raw.encode())


def test_settings_text(spark):
    values = ["", None, "42", "4294967295", "4294967296", "-1", "+5", " 7", "x", "99999999999999999999999"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string")
    got = df.select("id", meta_status(F.col("v")).alias("s"), meta_long(F.col("v")).alias("n")).orderBy("id").collect()
    assert [r["s"] for r in got] == ["absent", "absent", "ok", "ok"] + ["corrupt"] * 6
    assert [r["n"] for r in got[:4]] == [0, 0, 42, 4294967295] and all(r["n"] is None for r in got[4:])
    with pytest.raises(Exception, match="corrupt setting value"):
        df.select(meta_long_strict(F.col("v"))).collect()


def test_windows_of_large_uids(spark):
    big = 2**62
    row = spark.range(1).select(
        uid_window(F.lit(1), F.lit(1), F.lit(2)).alias("a"), uid_window(F.lit(3), F.lit(1), F.lit(2)).alias("b"),
        uid_window(F.lit(big + 1), F.lit(1), F.lit(2000)).alias("c"),
    ).first()
    assert (row["a"], row["b"], row["c"]) == (0, 1, big // 2000)


@settings(max_examples=20, deadline=None)
@given(labels=st.lists(st.text(max_size=12), min_size=1, max_size=20), repl=st.sampled_from(["_", "-", "x", "0"]))
def test_slug_against_a_plain_loop(spark, labels, repl):
    def plain(label: str) -> str:
        out, run = "", False
        for ch in label:
            if ch.isascii() and (ch.isalnum() or ch in "-_"):
                out, run = out + ch, False
            elif not run:
                out, run = out + repl, True
        return out.strip(repl).lower()

    labels = [text.encode("utf-8", "ignore").decode() for text in labels]
    df = spark.createDataFrame(list(enumerate(labels)), "id int, label string")
    got = {r["id"]: r["s"] for r in df.select("id", keyword_slug(F.col("label"), F.lit(repl)).alias("s")).collect()}
    assert [got[i] for i in range(len(labels))] == [plain(x) for x in labels]
