"""Ranked search by term owners beside brute force."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from mirrorkit.llm import search as module
from mirrorkit.llm.search import OWNERS, Block, search, terms_of
from tests.llm.conftest import DOCS, ODD

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def slow_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def slow_ranks(docs, items, top):
    held = [(doc, Counter(slow_terms(text))) for doc, text in docs]
    held = [(doc, c) for doc, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item, text in items:
        asked, scored = Counter(slow_terms(text)), []
        for doc, c in held:
            m = 100 - 25 + (25 * c.total() * n_docs) // n_terms
            score = sum(
                q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                for t, q in asked.items() if t in c
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out.update((item, k + 1, None if none else doc, -s) for k, (s, none, doc) in enumerate(sorted(scored)[:top]))
    return out


def got_ranks(docs, items, top, **how):
    return Counter(tuple(r) for r in search(docs, items, top, **how).select("item_id", "rank", "doc_id", "score").collect())


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(d, t, "en", "s", 0) for d, t in docs], DOCS),
        spark.createDataFrame(items, "item_id long, text string").withColumns({"rank": F.lit("extra"), "doc_id": F.lit("extra"), "item": F.lit("extra")}),
    )


def corpus(n=400, seed=0):
    """Words of a steep frequency, some documents in many copies, some items taken from documents."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)] + ["ÄÖ", "漢字", "x1", "THE"]
    weights = 1.0 / np.arange(1, len(words) + 1)
    texts = [" ".join(rng.choice(words, rng.integers(1, 60), p=weights / weights.sum())) for _ in range(n)]
    docs = list(enumerate([*texts, *[texts[3]] * 90, *[texts[7] + " tail"] * 40]))
    items = [(i, texts[i * 5][:200]) for i in range(20)] + [(50, "the the THE-w0.w1"), (51, "unheard"), (52, None), (53, ""), (54, "!?"), (None, "w250 w3"), (50, "w9")]
    return docs, items


def test_ranks_by_brute_force(spark):
    docs, items = corpus()
    a, b = frames(spark, docs, items)
    for top in (20, 3):
        assert got_ranks(a, b, top) == slow_ranks(docs, items, top)
    assert got_ranks(a, b, 5, block_items=7) == slow_ranks(docs, items, 5)


def test_odd_and_empty_tables(spark, odd, none):
    docs = [(d, t) for d, t, *_ in ODD]
    items = [(1, "the CAT and word7 word7"), (2, "漢字 ünïcödé or call"), (3, None)]
    _, asked = frames(spark, [], items)
    assert got_ranks(odd, asked, 20) == slow_ranks(docs, items, 20)
    assert got_ranks(none, asked, 20) == Counter()
    assert got_ranks(odd, asked.limit(0), 20) == Counter()


def test_terms_of_long_texts(monkeypatch):
    text = "Ab.cd" * 500 + "é1_é2 x" + "\x80y" * 30
    want = Counter(t.encode() for t in slow_terms(text))
    assert terms_of(text) == want
    monkeypatch.setattr(module, "PIECE", 16)
    assert terms_of(text) == want


def test_owners_share_postings_and_bound_what_is_left():
    stats = {t: (1 + t * t, 3, 10) for t in range(60)}
    block = Block([{t: 1 + t % 2 for t in range(0, 60, 2)}, {1: 5}], stats, 10_000, 500_000, 60)
    held = [sum(stats[t][0] for t in stats if block.owner[t] == s) for s in range(OWNERS)]
    assert max(held) < 2 * sum(held) / OWNERS and (np.diff(block.owner) >= 0).all()
    assert (np.diff(block.rest, axis=1) <= 0).all() and (block.rest[:, -1] == 0).all()
    n = np.array([10**9, 7])
    big = Block([], {}, 10**12, 10**15, 0)
    assert big.parts(np.array([4, 1]), n).tolist() == [10**9 * f // (1000 * f + 12 * (75 + 25 * x * 10**12 // 10**15)) for f, x in ((4, 10**9), (1, 7))]


def test_bundles_shrink_where_bounds_allow():
    """A stage drops documents that cannot win and closes items that no new document can."""
    import pyarrow as pa

    stats = {t: (1 + 40 * t, 2, 10) for t in range(8)}
    block = Block([dict.fromkeys(range(8), 1)], stats, 1000, 20_000, 8)
    first = [t for t in stats if block.owner[t] == 0]
    right = pa.table({
        "shard": pa.array([0] * 30, pa.int32()), "row": pa.array(range(30)), "doc_id": pa.array(range(30)), "n": pa.array([10] * 30),
        "terms": pa.array([first if i < 4 else first[-1:] for i in range(30)], pa.list_(pa.int32())),
        "tfs": pa.array([[2] * len(first) if i < 4 else [1] for i in range(30)], pa.list_(pa.int32())),
    })
    left = module._BUNDLE().empty_table()
    wide = module.add_owner((pa.scalar(0),), left, right, 0, block, 20).to_pylist()
    assert len(wide[1]["places"]) == 30 and not wide[1]["closed"]
    block.rest[:, 0] = 1
    narrow = module.add_owner((pa.scalar(0),), left, right, 0, block, 3).to_pylist()
    assert narrow[0]["item"] == -1 and narrow[0]["rows"] == [0, 1, 2, 3]
    assert narrow[1]["closed"] and narrow[1]["places"] == [0, 1, 2, 3]
