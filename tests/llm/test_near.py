"""SimHash groups and edit fingerprints beside brute force; the pipeline as a whole."""

from __future__ import annotations

import hashlib
import re
import tracemalloc
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from mirrorkit.llm import simhash
from mirrorkit.llm.edits import PERIOD, _stays, edit_fingerprints, edit_near_copies, edited, fingerprint, likeness
from mirrorkit.llm.simhash import Forest, components, deduplicated, near_duplicates, near_pairs
from tests.llm.conftest import DOCS, ODD

SMALL = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(rows):
    """(fingerprint, least doc id of its component) for each (doc_id, text)."""
    prints = {slow_fingerprint(t or "") for _, t in rows}
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for doc, text in rows:
        r = find(slow_fingerprint(text or ""))
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    return Counter((doc, f"{slow_fingerprint(t or ''):016x}", least.get(find(slow_fingerprint(t or "")))) for doc, t in rows)


def got_groups(docs):
    return Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in near_duplicates(docs).collect())


def texts(n, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in "bcdfg" for b in ("ar", "el", "in", "ot", "un")]
    out = [list(rng.choice(words, 120)) for _ in range(n)]
    for i in range(1, n, 3):  # near copies, some in chains
        out[i] = [*out[i - 1][:-1], "Extra"]
    return [" ".join(x) for x in out] + [" ".join(out[0])] * 4


def test_groups_by_brute_force(spark, odd, none):
    rows = list(enumerate(texts(60)))
    assert got_groups(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)) == slow_groups(rows)
    assert got_groups(odd) == slow_groups([(doc, text) for doc, text, *_ in ODD])
    assert near_duplicates(none).count() == 0


def test_trees_miss_no_pair_and_leaves_may_be_cut(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    near = base[:900].copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)
    # A crowd that no tree can tell apart in one block: it differs in the others.
    crowd = np.uint64(0xABCDE) << np.uint64(43) | rng.integers(0, 1 << 40, 400, dtype=np.uint64)
    points = np.unique(np.concatenate([base, near, crowd]))
    i, j = np.nonzero(np.triu(np.bitwise_count(points[:, None] ^ points[None, :]) <= 4, 1))
    truth = set(zip(points[i].tolist(), points[j].tolist(), strict=True))
    forest, met = Forest(rng.choice(points, 800, replace=False), len(points), 3, 4, 64), set()
    for _, leaf, rows, lives in forest.route(points):
        for n in np.unique(leaf):
            here, own = points[rows[leaf == n]], points[rows[(leaf == n) & lives]]
            a, b = np.nonzero(np.bitwise_count(here[:, None] ^ own[None, :]) <= 4)
            met |= {(min(x, y), max(x, y)) for x, y in zip(here[a].tolist(), own[b].tolist(), strict=True) if x != y}
        assert lives.sum() == len(points)
    assert met == truth

    monkeypatch.setattr(simhash, "UNIT", 50)
    frame = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    found = simhash.links(simhash.stored(frame, "points"), leaf=100).collect()
    joined = {frozenset((r["a"], r["b"])) for r in found}
    signed = {frozenset(np.array(p, dtype=np.uint64).view(np.int64).tolist()) for p in truth}
    assert joined <= signed and part_count(joined) == part_count(signed)


def part_count(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for pair in pairs:
        a, b = pair
        root[find(a)] = find(b)
    return sorted(sorted(x for x in root if find(x) == r) for r in set(map(find, root)))


def test_a_group_of_copies_gives_few_links():
    points = np.array([1 << k for k in range(40)] + [0], dtype=np.uint64)
    a, b = near_pairs(points, points, 4)
    assert len(a) == 40 and len(set(a.tolist()) | set(b.tolist())) == 41


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(40)] + [(7, 7), (61, 59)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(62), 0), 100: 100, **{200 + i: 100 for i in range(40)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_the_walk_table_is_small_while_it_is_made():
    tracemalloc.start()
    one, three = _stays.__wrapped__()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20  # every Python worker makes it
    for step, trio in ((0, (0, 1, 2)), (77, (31, 4, 4)), (127, (9, 30, 17))):
        at = step
        for kind in trio:
            at += one[at % PERIOD, kind]
        assert three[step << 15 | trio[0] << 10 | trio[1] << 5 | trio[2]] == at - step


def test_one_document_of_each_group_stays(spark, odd, none):
    rows = list(enumerate(texts(40)))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    kept = deduplicated(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in slow_groups(rows)})
    left = deduplicated(odd)
    assert left.columns == odd.columns and deduplicated(none).count() == 0
    assert left.count() == len({(f, c) if c is None else c for _, f, c in slow_groups([(d, t) for d, t, *_ in ODD])})


# Edit fingerprints


def test_edits_by_brute_force(spark, odd, none):
    rows = [(i * 7 % 53, t) for i, t in enumerate(texts(30, 2) + ["", "a", "ab", "abc", "é😀漢" * 40])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = {r["doc_id"]: r for r in edit_fingerprints(docs).collect()}
    ordered = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for (doc, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        r, changed = got[doc], edited(text, following)
        assert changed == text[:len(text) - len(text) // 3] + following[:len(text) // 3]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprint(text), fingerprint(changed))
        assert r["near_edited"] == likeness(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == likeness(r["fingerprint"], fingerprint(following))
    assert edit_fingerprints(odd).count() == len(ODD) and edit_fingerprints(none).count() == 0
    assert edit_fingerprints(docs.limit(1)).first()["near_next"] == 1.0


def test_likeness_follows_edits():
    rng = np.random.default_rng(0)
    near, far = [], []
    for n in (300, 2000, 9000) * 5:
        text = "".join(rng.choice(list("abcdefghij klmnop"), n))
        other = "".join(rng.choice(list("abcdefghij klmnop"), n))
        edits = text[:n // 4] + "x" + text[n // 4 + 2:n // 2] + "yy" + text[n // 2:]
        near.append(likeness(fingerprint(text), fingerprint(edits)))
        far.append(likeness(fingerprint(text), fingerprint(other)))
        assert likeness(fingerprint(text), fingerprint(text)) == 1.0
        half = likeness(fingerprint(text), fingerprint(text[:n // 2]))
        assert 0.4 <= half <= 0.65
    # A walk may take long to fall into step again, but seldom does.
    assert np.median(near) > 0.9 and np.mean(near) > 0.75 and max(far) < 0.35
    assert likeness("00", "00") == 1.0 and likeness("00", fingerprint("abc")) == 0.0


def test_near_copies_are_found_and_verified(spark):
    rng = np.random.default_rng(6)
    base = ["".join(rng.choice(list("abcdefgh ijklmnop"), 400)) for _ in range(40)]
    close = [t[:100] + "!!" + t[104:] for t in base[:20]]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(base + close + [base[0]] * 3)]
    members, pairs = edit_near_copies(spark.createDataFrame(rows, DOCS))
    assert {r["class_id"] for r in members.collect() if r["doc_id"] >= 60} == {0}
    found = {(min(r["class_a"], r["class_b"]), max(r["class_a"], r["class_b"])): r["distance"] for r in pairs.collect()}
    truth = {(i, 40 + i) for i in range(20)}
    assert set(found) <= truth and len(found) >= 18 and max(found.values()) <= 80


# The pipeline


def test_pipeline_stages(spark, odd):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_near_dedup", "pii", "mixing", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = simhash.stored(stage(spark, docs, SMALL), "stage")
        if name != "packing":
            assert out.columns == docs.columns
            sizes.append({r["doc_id"] for r in out.select("doc_id").collect()})
        if name == "pii":
            assert out.filter(F.col("text").rlike(r"[a-z]@[a-z0-9]+\.")).isEmpty()
        docs = out
    assert sizes[0] >= sizes[1] == sizes[2] >= sizes[3]
    assert docs.agg(F.countDistinct("doc_id")).first()[0] == len(sizes[3])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SMALL).count() >= 1
