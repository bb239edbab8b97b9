"""Ranked lexical search by pipelined term partitioning.

The terms of the items are dealt out to a few owners, the rarest to the first. A bundle holds the items'
accumulators: for each item, the documents that have scored so far and their integer scores. It passes
through the owners one after the other; at each stage it is cogrouped with the postings that the owner
has, and every term adds its contribution. Documents are dealt out to shards, and each shard has a bundle
of its own, so a frequent term is spread over all shards and a group is bounded by the documents of a shard.

Nothing is approximated. What later owners can still add to an item has an upper bound. A document that
cannot reach the shard's present 20th score any more leaves its accumulator, and once that bound alone is
below this score, no new document is taken in. Rare terms first, most documents never get in.

Items are taken in blocks of bounded size, each block in one pass over the documents.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mirrorkit.llm.common import partitions, small_batches
from mirrorkit.session import stored, work_dir

TOP = 20
OWNERS = 4
# Documents of a shard, and items and terms of a block, about.
SHARD = 8192
BLOCK_ITEMS = 1024
BLOCK_TERMS = 1 << 20
# Items whose accumulators are spread out in memory at once, and bytes of a text that are split at once.
AT_ONCE = 128
PIECE = 1 << 20

# Digits, ASCII letters in lower case and all bytes beyond ASCII make terms; the rest is a blank.
_TERMS = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)

FORWARD = "row long, doc_id long, n long, terms array<int>, tfs array<int>"
POSTINGS = "owner int, shard int, row long, doc_id long, n long, terms array<int>, tfs array<int>"
BUNDLE = "shard int, item int, closed boolean, rows array<long>, ids array<long>, places array<int>, scores array<long>"
RANKED = "item int, row long, doc_id long, score long"


def terms_of(text: str) -> Counter:
    """How often each term, as bytes, occurs in the text."""
    data = text.encode("utf-8").translate(_TERMS)
    found, at = Counter(), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        found.update(data[at:end].split())
        at = end
    return found


def _lists(values: list[np.ndarray], dtype) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of an Arrow list column."""
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return offsets, np.concatenate(values).astype(dtype) if values else np.empty(0, dtype)


def _list_array(values: list[np.ndarray], dtype):
    import pyarrow as pa

    offsets, flat = _lists(values, dtype)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _item_terms(batches):
    import pyarrow as pa

    for batch in batches:
        found = [terms_of(text or "") for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([
            batch.column("item"), batch.column("item_id"),
            pa.array([[t.decode("utf-8", "surrogatepass") for t in f] for f in found], pa.list_(pa.string())),
            pa.array([list(f.values()) for f in found], pa.list_(pa.int64())),
        ], names=["item", "item_id", "terms", "times"])


def _forward(batches, shared):
    """Per document its length and how often it holds each term of the block."""
    import pyarrow as pa

    number = shared.value
    for batch in batches:
        n, terms, tfs = [], [], []
        for text in batch.column("text").to_pylist():
            found = terms_of(text or "")
            own = found.keys() & number.keys()
            n.append(found.total())
            terms.append(np.array([number[t] for t in own], dtype=np.int32))
            tfs.append(np.array([found[t] for t in own], dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), pa.array(n, pa.int64()), _list_array(terms, np.int32), _list_array(tfs, np.int32)],
            names=["row", "doc_id", "n", "terms", "tfs"],
        )


def _flat(column, dtype) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=dtype)


def _by_owner(batches, shared, shards: int):
    """A document's postings, a row for each owner that has any of them."""
    import pyarrow as pa

    owner_of = shared.value
    for batch in batches:
        lengths = np.diff(np.asarray(batch.column("terms").offsets))
        terms, tfs = _flat(batch.column("terms"), np.int32), _flat(batch.column("tfs"), np.int32)
        place, owner = np.repeat(np.arange(batch.num_rows), lengths), owner_of[terms]
        shard = (np.asarray(batch.column("row")).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(shards)
        for s in range(OWNERS):
            own = owner == s
            rows, counts = np.unique(place[own], return_counts=True)
            if not len(rows):
                continue
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            part = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(rows), s, dtype=np.int32)), pa.array(shard[rows].astype(np.int32)),
                part.column("row"), part.column("doc_id"), part.column("n"),
                pa.ListArray.from_arrays(offsets, pa.array(terms[own])), pa.ListArray.from_arrays(offsets, pa.array(tfs[own])),
            ], names=["owner", "shard", "row", "doc_id", "n", "terms", "tfs"])


class Block:
    """The items of a block, their terms' weights and owners, and what each owner can add at most."""

    def __init__(self, items: list[dict[int, int]], stats: dict[int, tuple[int, int, int]], n_docs: int, n_terms: int, vocabulary: int) -> None:
        """``items`` maps terms to repeats; ``stats`` has (documents, largest tf, least length) of each term found."""
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = np.zeros(vocabulary, dtype=np.int64)
        for t, (df, _, _) in stats.items():
            self.weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        live = sorted((t for t in stats if self.weight[t] > 0), key=lambda t: (stats[t][0], t))
        # Owners hold about equal parts of all postings, the rarest terms first.
        self.owner = np.full(vocabulary, -1, dtype=np.int8)
        total, before = sum(stats[t][0] for t in live), 0
        for t in live:
            self.owner[t] = before * OWNERS // total
            before += stats[t][0]
        self.items: list[list[list[tuple[int, int]]]] = []
        self.rest = np.zeros((len(items), OWNERS), dtype=np.int64)
        for i, item in enumerate(items):
            mine: list[list[tuple[int, int]]] = [[] for _ in range(OWNERS)]
            for t, times in item.items():
                if (s := int(self.owner[t])) >= 0:
                    mine[s].append((t, times))
                    _, tf, n = stats[t]
                    self.rest[i, :s] += times * int(self.weight[t]) * int(self.parts(np.array([tf]), np.array([n]))[0])
            self.items.append(mine)

    def parts(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What a term of weight one adds to a document, as an integer."""
        exact = object if len(n) and 25 * int(n.max()) * self.n_docs >= 1 << 62 else np.int64
        m = (100 - 25 + (25 * n.astype(exact) * self.n_docs) // self.n_terms).astype(np.int64)
        return 1_000_000_000 * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + 12 * m)


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def _carried(left):
    """(rows, ids, known ids, accumulators) of a bundle; an accumulator is (closed, places, scores)."""
    rows, ids, has, held = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), {}
    for piece in left.to_batches():
        at = {name: piece.column(name) for name in ("item", "closed", "rows", "ids", "places", "scores")}
        for i, item in enumerate(at["item"].to_pylist()):
            if item < 0:
                rows, known = np.asarray(at["rows"][i].values), at["ids"][i].values
                has = np.asarray(known.is_valid().to_numpy(zero_copy_only=False))
                ids = np.asarray(known.fill_null(0))
            else:
                held[item] = (at["closed"][i].as_py(), np.asarray(at["places"][i].values), np.asarray(at["scores"][i].values))
    return rows, ids, has, held


def add_owner(key, left, right, stage: int, block: Block, top: int = TOP):
    """One stage of one shard: the bundle ``left`` after the owner's postings ``right`` are added.

    The last stage returns the best ``top`` documents of each item instead.
    """
    import pyarrow as pa

    last = stage == OWNERS - 1
    known, known_ids, known_has, held = _carried(left)
    right = right.combine_chunks()
    own = np.asarray(right.column("row").to_numpy())
    own_ids = right.column("doc_id").combine_chunks()
    rows, first = np.unique(np.concatenate([known, own]), return_index=True)
    ids = np.concatenate([known_ids, np.asarray(own_ids.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])[first]
    has = np.concatenate([known_has, np.asarray(own_ids.is_valid().to_numpy(zero_copy_only=False), dtype=bool)])[first]
    moved = np.searchsorted(rows, known)

    terms = np.concatenate([_flat(c, np.int32) for c in right.column("terms").chunks] or [np.empty(0, np.int32)])
    tfs = np.concatenate([_flat(c, np.int64) for c in right.column("tfs").chunks] or [np.empty(0, np.int64)])
    lengths = np.concatenate([np.diff(np.asarray(c.offsets)) for c in right.column("terms").chunks] or [np.empty(0, np.int64)])
    order = np.argsort(terms, kind="stable")
    place = np.repeat(np.searchsorted(rows, own), lengths)[order]
    terms = terms[order]
    adds = block.weight[terms] * block.parts(tfs[order], np.repeat(np.asarray(right.column("n").to_numpy()), lengths)[order])
    names, starts = np.unique(terms, return_index=True)
    edges = np.append(starts, len(terms)).tolist()
    span = {t: (edges[k], edges[k + 1]) for k, t in enumerate(names.tolist())}

    out, used = [], np.zeros(len(rows), dtype=bool)
    for at in range(0, len(block.items), AT_ONCE):
        chunk = range(at, min(at + AT_ONCE, len(block.items)))
        scores = np.zeros(len(rows), dtype=np.int64)
        for item in chunk:
            scores[:] = 0
            closed, places, before = held.get(item, (False, None, None))
            if places is not None:
                scores[moved[places]] = before
            allowed = scores > 0 if closed else None
            for t, times in block.items[item][stage]:
                if t in span:
                    a, b = span[t]
                    scores[place[a:b]] += times * adds[a:b]
            if closed:
                scores[~allowed] = 0
            found = np.flatnonzero(scores)
            kth = _kth(scores[found], top)
            if last:
                found = found[scores[found] >= kth]
                best = found[np.lexsort((rows[found], ids[found], ~has[found], -scores[found]))][:top]
                out.append((item, best, scores[best]))
                continue
            rest = int(block.rest[item, stage])
            found = found[scores[found] + rest >= kth]
            closed = closed or rest < kth
            if closed or len(found):
                used[found] = True
                out.append((item, closed, found, scores[found]))
    if last:
        at = np.concatenate([x[1] for x in out]) if out else np.empty(0, np.int64)
        return pa.table({
            "item": pa.array(np.repeat([x[0] for x in out], [len(x[1]) for x in out]).astype(np.int32)),
            "row": pa.array(rows[at]), "doc_id": pa.array(ids[at], mask=~has[at]),
            "score": pa.array(np.concatenate([x[2] for x in out]) if out else np.empty(0, np.int64)),
        })
    if not out:
        return pa.table([[], [], [], [], [], [], []], schema=_BUNDLE())
    new = np.cumsum(used) - 1
    none: np.ndarray = np.empty(0, np.int64)
    offsets = pa.array(np.array([0, int(used.sum()), *[int(used.sum())] * len(out)], dtype=np.int32))
    return pa.table([
        pa.array(np.full(len(out) + 1, key[0].as_py(), dtype=np.int32)), pa.array([-1, *[x[0] for x in out]], pa.int32()),
        pa.array([False, *[x[1] for x in out]]), _list_array([rows[used], *[none] * len(out)], np.int64),
        pa.ListArray.from_arrays(offsets, pa.array(ids[used], mask=~has[used])),
        _list_array([none, *[new[x[2]] for x in out]], np.int32), _list_array([none, *[x[3] for x in out]], np.int64),
    ], schema=_BUNDLE())


def _BUNDLE():
    import pyarrow as pa

    longs = pa.list_(pa.int64())
    return pa.schema([
        ("shard", pa.int32()), ("item", pa.int32()), ("closed", pa.bool_()), ("rows", longs), ("ids", longs),
        ("places", pa.list_(pa.int32())), ("scores", longs),
    ])


def _postings(forward: DataFrame, block: Block, shards: int) -> DataFrame:
    """Postings written by owner: each stage reads its owner's folder only."""
    spark = forward.sparkSession
    owners = spark.sparkContext.broadcast(block.owner)
    path = work_dir(spark, "search-postings")
    forward.mapInArrow(lambda batches: _by_owner(batches, owners, shards), POSTINGS).write.partitionBy("owner").parquet(path)
    return spark.read.schema(POSTINGS).parquet(path)


def _step(stage: int, shared, top: int):
    def step(key, left, right):
        return add_owner(key, left, right, stage, shared.value, top)

    return step


def _block(docs: DataFrame, items: list, top: int) -> DataFrame:
    """``item_id, rank, doc_id, score`` for one block of items (item, item_id, terms, times)."""
    spark = docs.sparkSession
    number: dict[bytes, int] = {}
    for row in items:
        for t in row.terms:
            number.setdefault(t.encode("utf-8", "surrogatepass"), len(number))
    vocabulary = spark.sparkContext.broadcast(number)
    numbered = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text")
    forward = stored(numbered.mapInArrow(lambda batches: _forward(batches, vocabulary), FORWARD).filter("n > 0"), "search-forward")
    whole = forward.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    found = forward.select("n", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).groupBy("p.terms").agg(
        F.count(F.lit(1)).alias("df"), F.max("p.tfs").alias("tf"), F.min("n").alias("n"),
    )
    stats = {row.terms: (row.df, row.tf, row.n) for row in found.collect()}  # a row for each term of the block
    own = [{number[t.encode("utf-8", "surrogatepass")]: q for t, q in zip(row.terms, row.times, strict=True)} for row in items]
    block = Block(own, stats, whole.docs, whole.terms or 0, len(number))
    shards = max(partitions(spark), math.ceil(whole.docs / SHARD))
    postings = _postings(forward, block, shards)
    shared = spark.sparkContext.broadcast(block)
    bundles = spark.createDataFrame([], BUNDLE)
    for stage in range(OWNERS):
        mine = postings.filter(F.col("owner") == stage).drop("owner")
        bundles = bundles.groupBy("shard").cogroup(mine.groupBy("shard")).applyInArrow(_step(stage, shared, top), RANKED if stage == OWNERS - 1 else BUNDLE)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    ranked = bundles.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    names = spark.createDataFrame([(i, row.item_id) for i, row in enumerate(items)], "item int, item_id long")
    return stored(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "search-ranked")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_items: int = BLOCK_ITEMS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of each item, scores above 0 only.

    ``docs`` needs ``doc_id`` and ``text``, ``items`` needs ``item_id`` and ``text``; other columns are
    ignored. Null, empty and blank texts have no terms: such documents count nowhere, such items have no
    rows. Every row is a document, or an item, of its own, equal ones too. Equal scores rank by ascending
    ``doc_id``, null last. Texts count whole. No documents or no items give no rows.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    asked = asked.withColumn("item", F.monotonically_increasing_id())
    split = asked.mapInArrow(_item_terms, "item long, item_id long, terms array<string>, times array<long>")
    asked = stored(split.filter(F.size("terms") > 0), "search-items")
    total = asked.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms")).first()
    blocks = max(math.ceil(total["items"] / block_items), math.ceil(total["terms"] / block_terms))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for k in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).orderBy("item").collect()  # about block_items rows
        out = out.unionByName(_block(narrow, part, top)) if part else out
    return out


# The same rows in SQL.
SEARCH_SQL = r"""
with w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents where text is not null),
d as (select doc_id, cast(len(ts) as bigint) as n, ts from w where len(ts) > 0),
g as (select cast(count(*) as bigint) as big_n, cast(sum(n) as bigint) as big_l from d),
p as (select doc_id, n, term, cast(count(*) as bigint) as tf from (select doc_id, n, unnest(ts) as term from d) group by all),
v as (select term, cast(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) as bigint) as weight from p, g group by term, big_n),
i as (select item_id, term, cast(count(*) as bigint) as times from
        (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by all),
s as (select item_id, doc_id,
             cast(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * big_n) // big_l)))) as bigint) as score
      from i join v using (term) join p using (term), g group by item_id, doc_id),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from s where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from r where rank <= 20
"""
