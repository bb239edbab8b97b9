"""Line deduplication beside brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from mirrorkit.llm import lines
from mirrorkit.llm.lines import drop_bitmaps, hot_hashes, line_hashes, line_rows, without_repeated_lines
from tests.llm.conftest import DOCS, ODD

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def slow_key(line):
    return re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(SPACE))


def slow_kept(rows):
    """(doc, number of lines, kept lines) of each (doc, text)."""
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(slow_key(line)) >= 40:
                holders[slow_key(line)].add(doc)
    last = {k: max((d for d in v if d is not None), default=None) for k, v in holders.items() if len(v) >= 5}
    out = []
    for doc, text in rows:
        own = (text or "").split("\n")
        out.append((doc, len(own), [x for x in own if slow_key(x) not in last or last[slow_key(x)] == doc]))
    return out


def slow_rows(rows):
    return Counter((doc, n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()) for doc, n, kept in slow_kept(rows))


def got_rows(docs):
    return Counter(tuple(r) for r in line_rows(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())


def made():
    """Documents that share lines: in four and five documents, twice in one, with case, blanks and letters beyond ASCII."""
    shared = "This line of text is long enough to be a key of its own"
    foreign = "ÜBER diese lange Zeile mit Umlauten wird mehrfach GEFUNDEN"
    rows = []
    for i in range(12):
        own = [f"line {i} that nobody else has, and long enough for a key", "short"]
        if i < 5:
            own = [shared.upper(), *own, f" \t{shared}\r", shared]
        if i < 4:
            own.append("held by four documents only, which is not enough for it")
        if i > 5:
            own = [foreign if i % 2 else f"  {foreign}", *own, foreign.replace("Z", "z"), "", ""]
        rows.append((i, "\n".join(own)))
    rows.append((100, "\n".join([foreign] * 50)))
    rows.append((99, foreign.lower()))  # another key: only A-Z are folded
    rows += [(None, shared), (None, shared), (3, foreign), (3, rows[3][1]), (200, "x" * 39), (201, shared[:39] + "é")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], DOCS)


def test_rows_by_brute_force(spark, odd, none):
    rows = made()
    assert got_rows(frame(spark, rows)) == slow_rows(rows)
    assert got_rows(odd) == slow_rows([(d, t) for d, t, *_ in ODD])
    assert line_rows(none).count() == 0 and drop_bitmaps(none).count() == 0


def test_hot_lines_get_the_same_decisions(spark, monkeypatch):
    rows = made() + [(1000 + i, f"A line that every one of these documents holds, alone\nrow {i}") for i in range(300)]
    docs = frame(spark, rows)
    assert hot_hashes(line_hashes(docs)).count() == 1
    assert got_rows(docs) == slow_rows(rows)
    monkeypatch.setattr(lines, "hot_hashes", lambda entries: entries.select("h").limit(0))
    assert got_rows(docs) == slow_rows(rows)
    monkeypatch.setattr(lines, "hot_hashes", lambda entries: entries.select("h").distinct())
    assert got_rows(docs) == slow_rows(rows)


def test_texts_keep_rows_and_columns(spark, odd, none):
    for docs in (odd.withColumns({"runs": F.lit(1), "line_row": F.lit(2), "lines": F.lit(3), "doc": F.lit(4)}), none):
        got = without_repeated_lines(docs)
        assert got.columns == docs.columns
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, docs.collect()))
    rows = made()
    got = Counter((r["doc_id"], r["text"]) for r in without_repeated_lines(frame(spark, rows)).collect())
    assert got == Counter((doc, "\n".join(kept)) for doc, _, kept in slow_kept(rows))


def test_bitmaps_are_runs(spark):
    same = [f"line number {i} of a page that six documents hold" for i in range(4)]
    rows = [(i, "\n".join([same[0], same[1], f"own {i}", same[2], same[3], "end"])) for i in range(6)]
    got = {r["doc"]: [tuple(x) for x in r["runs"]] for r in drop_bitmaps(frame(spark, rows)).collect()}
    assert got == {i: [(0, 2), (3, 2)] for i in range(5)}


def test_lines_are_ranged_once_and_python_is_not_used(spark, tmp_path):
    plan = lines._streamed(line_hashes(frame(spark, made())), 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan and "Python" not in plan
