"""SimHash near duplicates, joined exactly by vantage-point trees over the Hamming metric.

Fingerprints have 64 bits. Two that differ in at most ``radius`` bits differ in at most
radius // blocks bits of one of ``blocks`` bit ranges, so there is one tree per range, whose metric is
the Hamming distance on that range. An inner node has a vantage point and a distance that splits the
points near it from those far from it. A point lives in one leaf of each tree. Where the triangle bound
says that a partner may lie beyond the split, the point also visits the other side; every pair of
partners so meets in a leaf in which at least one of them lives. Leaves are the shards that Spark deals
out; a leaf with many points is cut into blocks, and each pair of blocks is a unit of work of its own.

Trees are fitted on a bounded sample of fingerprints (``SAMPLE``). This only balances the leaves: every
fingerprint is routed through every tree, and no pair within the radius is missed.

Only links that join two parts of a unit of work leave it, so a group of n near copies gives about n
links per leaf instead of n squared. Components come from alternating star contractions of the links.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorkit.llm.common import free_name, partitions, small_batches
from mirrorkit.session import stored

SEED = 42
SHINGLE = 4
RADIUS = 4
BLOCKS = 3
SAMPLE = 32_768
LEAF = 1024
UNIT = 4096
SEEKERS = 16

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str, width: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text's word shingles as an unsigned number; 0 for a text without words."""
    import xxhash

    data = text.encode("utf-8").translate(_LOWER)
    words = _WORDS.findall(data)
    if not words:
        return 0
    hashed = xxhash.xxh64_digest
    if len(words) <= width:
        hashes = hashed(b" ".join(words), seed)
        n = 1
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        stops = ends[width - 1:].tolist()
        starts = [0, *(ends[:-width] + 1).tolist()]
        hashes = b"".join([hashed(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)])
        n = len(stops)
    set_bits = np.zeros(64, dtype=np.int64)
    rows = np.frombuffer(hashes, dtype=np.uint8).reshape(n, 8)
    for at in range(0, n, 65_536):
        set_bits += np.unpackbits(rows[at:at + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > n).tobytes(), "big")


def _fingerprints(batches):
    import pyarrow as pa

    for batch in batches:
        values = [fingerprint(text or "") for text in batch.column("text").to_pylist()]
        signed = np.asarray(values, dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("key"), pa.array(signed)], names=["doc_id", "key", "fp"],
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, key, fp`` for each row; ``key`` is a hash of the text, ``fp`` the signed 64-bit fingerprint."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    return narrow.mapInArrow(_fingerprints, "doc_id long, key long, fp long")


# --- trees ---------------------------------------------------------------------------------------------


def block_masks(blocks: int) -> list[int]:
    """Masks of ``blocks`` consecutive bit ranges that make up 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]


def fit_tree(sample: np.ndarray, mask: int, leaf: int, seed: int) -> np.ndarray:
    """Nodes (vantage, split, near, far) of a tree; near and far are nodes, or ~leaf number if negative.

    ``sample`` holds distinct fingerprints. The vantage point is the best of a few, by how evenly its
    median distance splits the node. A node whose points cannot be told apart stays a leaf.
    """
    rng = np.random.default_rng(seed)
    part, nodes, leaves = sample & np.uint64(mask), [], 0
    todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(sample)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        best = None
        if len(rows) > leaf:
            for vantage in part[rng.choice(rows, min(8, len(rows)), replace=False)]:
                dist = np.bitwise_count(part[rows] ^ vantage).astype(np.int64)
                split = int(np.median(dist))
                for cut in (split - 1, split):
                    near = dist <= cut
                    # Points just beside the split visit the other side, so they count against it.
                    cost = abs(2 * int(near.sum()) - len(rows)) + int(((dist == cut) | (dist == cut + 1)).sum())
                    if near.any() and not near.all() and (best is None or cost < best[0]):
                        best = (cost, vantage, cut, near)
        if best is None:
            here, leaves = ~leaves, leaves + 1
        else:
            here = len(nodes)
            nodes.append([int(best[1]), best[2], 0, 0])
            todo.append((rows[best[3]], here, 2))
            todo.append((rows[~best[3]], here, 3))
        if parent >= 0:
            nodes[parent][side] = here
    return np.array(nodes, dtype=object).reshape(-1, 4)


def route(points: np.ndarray, mask: int, tree: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, lives) of each point: the leaf it lives in and the leaves it visits.

    For a pair split by a node, only the point on the near side visits the far side. A visitor goes
    wherever the triangle bound allows a partner, on both sides.
    """
    rows = np.arange(len(points))
    if not len(tree):
        return rows, np.zeros(len(points), dtype=np.int64), np.ones(len(points), dtype=bool)
    vantage = tree[:, 0].astype(np.uint64)
    split, near_of, far_of = (tree[:, k].astype(np.int64) for k in (1, 2, 3))
    part = points & np.uint64(mask)
    at, lives = np.zeros(len(points), dtype=np.int64), np.ones(len(points), dtype=bool)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(rows):
        dist = np.bitwise_count(part[rows] ^ vantage[at]).astype(np.int64)
        near = dist <= split[at]
        to_far = near & (dist + radius > split[at])
        to_near = ~near & ~lives & (dist - radius <= split[at])
        own = np.where(near, near_of[at], far_of[at])
        rows, nodes, lives = (
            np.concatenate([rows, rows[to_far], rows[to_near]]),
            np.concatenate([own, far_of[at][to_far], near_of[at][to_near]]),
            np.concatenate([lives, np.zeros(int(to_far.sum() + to_near.sum()), dtype=bool)]),
        )
        out = nodes < 0
        done.append((rows[out], ~nodes[out], lives[out]))
        rows, at, lives = rows[~out], nodes[~out], lives[~out]
    return tuple(np.concatenate(x) for x in zip(*done, strict=True))


class Forest:
    """One tree per block of bits."""

    def __init__(self, sample: np.ndarray, total: int, blocks: int, radius: int, leaf: int) -> None:
        self.masks, self.reach = block_masks(blocks), radius // blocks
        least = max(1, round(leaf * len(sample) / max(total, 1)))
        self.trees = [fit_tree(sample, mask, least, SEED + k) for k, mask in enumerate(self.masks)]

    def route(self, points: np.ndarray):
        """(tree, leaf, row, lives) arrays per tree."""
        for k, (mask, tree) in enumerate(zip(self.masks, self.trees, strict=True)):
            rows, leaf, lives = route(points, mask, tree, self.reach)
            yield k, leaf, rows, lives


# --- links ---------------------------------------------------------------------------------------------


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the links that join two parts not joined by the links before."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[y] = x
            keep.append(i)
    return np.asarray(keep, dtype=np.int64)


def near_pairs(living: np.ndarray, seeking: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two arrays of fingerprints, enough to join all that are joined by any."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    width = max(1, (1 << 20) // max(1, len(living)))
    for at in range(0, len(seeking), width):
        part = seeking[at:at + width]
        i, j = np.nonzero(np.bitwise_count(part[:, None] ^ living[None, :]) <= radius)
        a, b = part[i], living[j]
        own = a != b
        if own.any():
            found.append((a[own], b[own]))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = spanning(a, b)
    return a[keep], b[keep]


def _routed(batches, shared):
    import pyarrow as pa

    forest = shared.value
    for batch in batches:
        points = np.asarray(batch.column("fp")).view(np.uint64)
        for tree, leaf, rows, lives in forest.route(points):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), tree, np.int32)), pa.array(leaf), pa.array(lives), pa.array(points[rows].view(np.int64))],
                names=["tree", "leaf", "lives", "fp"],
            )


def _unit_links(unit):
    """Links within one unit of work: points that live in it against points that seek in it."""
    import pandas as pd

    points = unit["fp"].to_numpy().view(np.uint64)
    lives, seeks = unit["lives"].to_numpy(dtype=bool), unit["seeks"].to_numpy(dtype=bool)
    a, b = near_pairs(points[lives], points[seeks], RADIUS)
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def links(points: DataFrame, blocks: int = BLOCKS, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints at ``RADIUS`` or fewer bits, enough to connect every group.

    ``points`` is a stored table of distinct values ``fp``.
    """
    spark = points.sparkSession
    total = points.count()
    part = points if total <= sample else points.sample(fraction=sample / total, seed=SEED)
    drawn = np.asarray(sorted(row.fp for row in part.collect()), dtype=np.int64).view(np.uint64)  # about ``sample`` rows
    shared = spark.sparkContext.broadcast(Forest(drawn, total, blocks, RADIUS, leaf))
    places = points.repartition(partitions(spark)).mapInArrow(lambda batches: _routed(batches, shared), "tree int, leaf long, lives boolean, fp long")
    places = stored(places, "simhash-places")
    # A leaf of many points is cut: those that live there into blocks, those that seek there into chunks,
    # and each block meets each chunk in a unit of its own.
    sizes = stored(
        places.groupBy("tree", "leaf").agg(
            F.ceil(F.sum(F.col("lives").cast("int")) / UNIT).cast("int").alias("blocks"),
            F.ceil(F.count(F.lit(1)) / (SEEKERS * UNIT)).cast("int").alias("chunks"),
        ).filter("blocks > 1 or chunks > 1"), "simhash-large-leaves",
    )
    whole = places.join(sizes, ["tree", "leaf"], "left").withColumns({
        "blocks": F.greatest(F.coalesce("blocks", F.lit(1)), F.lit(1)), "chunks": F.coalesce("chunks", F.lit(1)),
    })
    home = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks")).cast("int")
    chunks = F.col("chunks")
    seeking = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda block: block * chunks + F.col("own"))
    living = F.transform(F.sequence(F.lit(0), chunks - 1), lambda chunk: F.col("home") * chunks + chunk)
    units = F.explode(F.when(F.col("lives"), F.array_union(seeking, living)).otherwise(seeking))
    dealt = whole.withColumns({"home": home, "own": own}).withColumn("unit", units).select(
        "tree", "leaf", "unit", "fp", (F.col("unit") % chunks == F.col("own")).alias("seeks"),
        (F.col("lives") & (F.floor(F.col("unit") / chunks) == F.col("home"))).alias("lives"),
    )
    return dealt.groupBy("tree", "leaf", "unit").applyInPandas(_unit_links, "a long, b long")


# --- components ----------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b``; the root is the least node reachable.

    Alternates the large-star and small-star steps until nothing changes. Edges are kept distinct and
    stored after each round, so a round depends on files alone; star sizes never exceed a node's edges,
    which are aggregated by key and not gathered.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    now = stored(edges.filter("a <> b").select(least.alias("a"), most.alias("b")).distinct(), "links")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: each larger neighbour of a node goes to the least of the node and its neighbours.
        roots = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")), "roots")
        large = both.join(roots, F.col("a") == F.col("n")).filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        large = stored(large, "large-star")
        # Small star: a node and its smaller neighbours go to the least of them.
        least_of = stored(large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("n"), "m"), "least")
        joined = large.join(least_of, F.col("b") == F.col("n"))
        small = (
            joined.select(F.col("m").alias("a"), "b").unionByName(joined.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")))
            .distinct()
        )
        small = stored(small, "links")
        changed = small.exceptAll(now).limit(1).count() + now.exceptAll(small).limit(1).count()
        now = small
        if not changed:
            break
    stars = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): stored ``doc_id, key, fp`` of every row and, for each fingerprint ``of``, its ``first``.

    ``first`` is the least (no id, doc_id, key) of all rows in the fingerprint's component.
    """
    rows = stored(fingerprints(docs), "simhash-rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    points = stored(rows.groupBy("fp").agg(F.min(order).alias("first")), "simhash-points")
    roots = stored(components(links(points.select("fp"))), "simhash-components")
    joined = points.join(roots, points["fp"] == roots["node"])
    least = stored(joined.groupBy("root").agg(F.min("first").alias("least")), "simhash-least")
    moved = roots.join(least, "root").select("node", "least")
    groups = points.join(moved, points["fp"] == moved["node"], "left").select(
        F.col("fp").alias("of"), F.coalesce("least", "first").alias("first"),
    )
    return rows, stored(groups, "simhash-groups")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each document.

    Needs ``doc_id`` and ``text``; other columns are ignored. Null, empty and blank texts have the
    fingerprint zero and are linked like any other. A text of fewer than four words is one shingle.
    ``component_id`` is the least ``doc_id`` reachable by links, null where no row of the component has
    an id. Equal rows each get their row. An empty table gives no rows. Texts count whole.
    """
    rows, groups = grouped(docs)
    return rows.join(groups, F.col("fp") == F.col("of")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component, with the columns of ``docs``: that of the least ``doc_id``.

    A null ``doc_id`` comes after all others. Rows that agree in id and text are one document; one stays.
    Null texts count as empty. An empty table stays empty. Columns may have any names.
    """
    rows, groups = grouped(docs)
    firsts = groups.select("first").distinct()
    same = rows.join(firsts, rows["doc_id"].eqNullSafe(F.col("first.doc_id")) & (rows["key"] == F.col("first.key")))
    keep = stored(same.groupBy(rows["doc_id"], rows["key"]).agg(F.count(F.lit(1)).alias("n")), "simhash-keep")
    hidden = free_name(docs, "simhash_row")
    texts = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(hidden), docs["doc_id"].cast("long").alias("own_id"),
        F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("own_key"),
    )
    kept = texts.join(keep, texts["own_id"].eqNullSafe(keep["doc_id"]) & (texts["own_key"] == keep["key"]))
    single = kept.filter("n = 1").select(f"{hidden}.*")
    again = kept.filter("n > 1").dropDuplicates(["own_id", "own_key"]).select(f"{hidden}.*")
    return single.unionByName(again)
