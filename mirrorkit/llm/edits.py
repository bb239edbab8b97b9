"""Fingerprints that follow edit distance: a randomised embedding into Hamming space, sampled.

All texts share one random walk: at each step the embedding repeats the current character, and a shared
random bit, chosen by the step and the character, says whether to go on to the next one. Texts that differ
by a few edits fall back into step soon after each edit, so their embeddings differ in few places.

A fingerprint samples the embedding of the whole text. Sample k lies at a random place of cell k; cells
have the width 2 ** scale, with the least scale that needs at most ``SAMPLES`` cells. The place in a cell
is that of one of its two halves' samples, so a coarse fingerprint is part of the finer one, and texts of
any two lengths can be compared. Each sample keeps four bits of a hash of its character.

The walk is sequential within a text. The steps that three characters stay are looked up at once, by the
step (modulo ``PERIOD``) and their classes, so it takes a third of a loop turn per character.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorkit.llm.common import partitions, small_batches, text_key
from mirrorkit.session import stored

SAMPLES = 256
PERIOD = 128
CLASSES = 32
SEED = 20_240_613
BATCH_CHARS = 1 << 21
FIRST_WIDTH = 3  # cells of the finest scale are 2 ** FIRST_WIDTH steps wide

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hash(values: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit mix of each value."""
    x = (values.astype(np.uint64) + np.uint64(salt)) * _MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _stays() -> tuple[np.ndarray, bytes]:
    """Steps that a character stays, by the step at which it is met and its class, and that three stay."""
    go = np.random.default_rng(SEED).integers(0, 2, (PERIOD, CLASSES), dtype=np.uint8)
    go[0] = 1  # bounds the stay
    one = np.empty((PERIOD, CLASSES), dtype=np.int64)
    wait = np.zeros(CLASSES, dtype=np.int64)
    for step in [0, *range(PERIOD - 1, 0, -1)]:
        wait = np.where(go[step] == 1, 1, wait + 1)
        one[step] = wait
    # One first character at a time: the whole table in steps of 64 bits would take hundreds of MB per worker.
    three = np.empty((PERIOD, CLASSES, CLASSES, CLASSES), dtype=np.uint8)
    for first in range(CLASSES):
        at = np.arange(PERIOD) + one[:, first]
        after = at[:, None] + one[at % PERIOD]
        three[:, first] = after[:, :, None] + one[after % PERIOD] - np.arange(PERIOD)[:, None, None]
    return one, three.tobytes()


@lru_cache(maxsize=64)
def sample_places(scale: int, count: int) -> np.ndarray:
    """The embedding places of the first ``count`` samples of a scale, ascending."""
    cells = np.arange(count, dtype=np.int64)
    for level in range(scale, 0, -1):  # into the half that holds the sample of the finer scale
        cells = 2 * cells + (_hash(cells, 1000 + level) >> np.uint64(40) & np.uint64(1)).astype(np.int64)
    return (cells << FIRST_WIDTH) + (_hash(cells, 7) >> np.uint64(64 - FIRST_WIDTH)).astype(np.int64)


def scale_of(length: int) -> int:
    """The least scale whose cells cover an embedding of this length."""
    scale = 0
    while (length - 1 >> FIRST_WIDTH + scale) >= SAMPLES:
        scale += 1
    return scale


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


_HEX = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


def fingerprint(text: str) -> str:
    """Two hex digits of scale, and one for each sample; ``00`` for an empty text."""
    codes = _codes(text)
    if not len(codes):
        return "00"
    one, three = _stays()
    classes = np.zeros(-(-len(codes) // 3) * 3, dtype=np.int64)
    classes[:len(codes)] = (codes ^ codes >> np.uint32(5) & np.uint32(2)) & np.uint32(CLASSES - 1)
    trios = classes.reshape(-1, 3)
    at, ends = 0, []
    for trio in (trios[:, 0] << 10 | trios[:, 1] << 5 | trios[:, 2]).tolist():
        at += three[(at & 127) << 15 | trio]
        ends.append(at)
    ends = np.array([0, *ends], dtype=np.int64)

    def inner(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the first and the second character of a block end."""
        begin = ends[block]
        first = begin + one[begin % PERIOD, trios[block, 0]]
        return first, first + one[first % PERIOD, trios[block, 1]]

    left = len(codes) % 3
    length = int(ends[-1]) if not left else int(inner(np.array([len(trios) - 1]))[left - 1][0])
    scale = scale_of(length)
    places = sample_places(scale, SAMPLES)
    places = places[:np.searchsorted(places, length)]
    block = np.searchsorted(ends, places, side="right") - 1
    first, second = inner(block)
    met = codes[3 * block + (places >= first) + (places >= second)]
    return f"{scale:02x}" + _HEX[(_hash(met, 31) >> np.uint64(60)).astype(np.int64)].tobytes().decode()


def likeness(a: str, b: str) -> float:
    """Share of samples that agree, of the larger number of samples; 1 for two empty texts."""
    first, second = int(a[:2], 16), int(b[:2], 16)
    if first > second:
        a, b, first, second = b, a, second, first
    x, y = _nibbles(a), _nibbles(b)
    if first < second:  # keep the finer samples that the coarser scale has
        fine = sample_places(first, SAMPLES)[:len(x)]
        kept = np.isin(fine, sample_places(second, SAMPLES))
        x = x[kept]
    n = max(len(x), len(y))
    if not n:
        return 1.0
    least = min(len(x), len(y))
    return float((x[:least] == y[:least]).sum()) / n


def _nibbles(value: str) -> np.ndarray:
    return np.frombuffer(value[2:].encode(), dtype=np.uint8)


# --- every document, its edited text and the next document ----------------------------------------------


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many of the first characters of ``following``."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


def _compared(batches):
    """Rows arrive in order; each but the last of a part is compared with the row behind it."""
    import pyarrow as pa

    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def rows(held: list[tuple]):
        texts = [text for _, _, text, _ in held]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        own, other = [fingerprint(text) for text in texts], [fingerprint(text) for text in changed]
        out = []
        for k in range(len(held) - 1):
            part, doc_id, text, ghost = held[k]
            if held[k + 1][0] == part and not ghost:
                sha = hashlib.sha256(changed[k].encode("utf-8", "surrogatepass")).hexdigest()
                out.append((doc_id, len(text), sha, own[k], other[k], likeness(own[k], other[k]), likeness(own[k], own[k + 1])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names) if out else None

    held, size = [], 0
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("part", "doc_id", "text", "ghost")]
        for row in zip(*columns, strict=True):
            held.append(row)
            size += len(row[2])
            if size > BATCH_CHARS and len(held) > 1:
                done = rows(held)
                if done is not None:
                    yield done
                held, size = held[-1:], len(row[2])
    if len(held) > 1:
        done = rows(held)
        if done is not None:
            yield done


def _parts(bounds: list[tuple[int, int, int]]):
    """Part of each (none, doc id, tie) in descending order, from the first row of every part but one."""
    keys = [(-none, doc_id, tie) for none, doc_id, tie in bounds][::-1]  # ascending

    def part(none, doc_id, tie):
        import pandas as pd

        rows = zip(none.tolist(), doc_id.tolist(), tie.tolist(), strict=True)
        return pd.Series([len(keys) - bisect_left(keys, (-n, d, t)) for n, d, t in rows], dtype="int32")

    return F.pandas_udf(part, "int")


def _order() -> list[Column]:
    # Descending ids, null last; rows of one id by the hash of their texts.
    return [F.col("none").asc(), F.col("id").desc(), F.col("tie").desc()]


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """For each document its fingerprint, that of its edited text, and how alike they and the next document are.

    The next document is the one behind in descending ``doc_id``; behind the last comes the first. Needs
    ``doc_id`` and ``text``; other columns are ignored. A null text is empty; a null ``doc_id`` comes last
    and stays null; rows with one id are ordered by the hash of their texts. A table of one row is its own
    next document; an empty table gives no rows. Texts count whole.

    One range shuffle of the texts. The ranges come from the ids alone; the first row of each range is
    copied to the end of the range before it, so every task has the next document of its last one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(
        F.col("doc_id").isNull().cast("int").alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(text).alias("tie"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
    )
    n = partitions(spark)
    ranged = stored(
        keyed.select("none", "id", "tie").repartitionByRange(n, *_order()).withColumn("part", F.spark_partition_id()), "edit-order",
    )
    first = F.max(F.struct((-F.col("none")).alias("some"), "id", "tie")).alias("first")
    heads = [(-row.first["some"], row.first["id"], row.first["tie"]) for row in ranged.groupBy("part").agg(first).orderBy("part").collect()]  # one per partition
    if not heads:
        heads = [(0, 0, 0)]
    # Equal rows may straddle a range; the first range that has them takes them all.
    heads = sorted(set(heads), key=lambda h: (-h[0], h[1], h[2]), reverse=True)
    part = _parts(heads[1:])
    dealt = keyed.withColumn("part", part("none", "id", "tie")).withColumn("ghost", F.lit(0))
    # Where each head is needed once more: behind the last row of the range before.
    before = stored(spark.createDataFrame(
        [(h[0], h[1], h[2], (k - 1) % len(heads)) for k, h in enumerate(heads)], "none int, id long, tie long, before int",
    ), "edit-heads")
    ghosts = (
        keyed.select("none", "id", "tie", "text").join(F.broadcast(before), ["none", "id", "tie"])  # one row per partition
        .groupBy("none", "id", "tie", "before").agg(F.first("text").alias("text"))
        .select("none", "id", "tie", F.lit(None).cast("long").alias("doc_id"), "text", F.col("before").alias("part"), F.lit(1).alias("ghost"))
    )
    rows = dealt.select("none", "id", "tie", "doc_id", "text", "part", "ghost").unionByName(stored(ghosts, "edit-ghosts"))
    ordered = rows.repartition(n, "part").sortWithinPartitions("part", "ghost", *_order())
    return ordered.select("part", "doc_id", "text", "ghost").mapInArrow(
        _compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


# --- near copies by edit distance -----------------------------------------------------------------------


def _bands(value, bands: int, rows: int):
    """Samples chosen at random from the coarse scales, so that texts of similar length share bands."""
    import pandas as pd

    out = []
    for text in value:
        scale, nibbles = int(text[:2], 16), text[2:]
        own = []
        for level in (scale, scale + 1):
            places = sample_places(level, SAMPLES)
            kept = nibbles if level == scale else "".join(
                n for n, k in zip(nibbles, np.isin(sample_places(scale, SAMPLES)[:len(nibbles)], places), strict=True) if k
            )
            size = max(len(kept), 1)
            for band in range(bands):
                # Places are drawn from the first half of the samples, which every text of this scale has.
                picks = (_hash(np.arange(band * rows, (band + 1) * rows), 77 + level) % np.uint64(SAMPLES // 2)).astype(int)
                own.append(f"{level}:{band}:" + "".join(kept[p] if p < size and kept else "-" for p in picks.tolist()))
        out.append(own)
    return pd.Series(out)


def edit_near_copies(docs: DataFrame, near: float = 0.8, bands: int = 24, rows: int = 6) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): ``doc_id, class_id`` for each row, and verified ``class_a, class_b, distance``.

    A class is the set of rows with one text; ``class_id`` is its least ``doc_id`` (null if none has one).
    Two classes are candidates if a band of their sampled bits agrees, and a pair if their edit distance is
    at most (1 - ``near``) of the longer text. Bands share a random choice of samples; a pair whose
    samples agree in a share s is found with probability 1 - (1 - s ** rows) ** bands at least. Members of a
    hot band are compared in blocks, so no task holds a band whole and no candidate is dropped.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("key"), text.alias("text"))
    members = stored(keyed.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.first("text").alias("text")), "edit-classes")
    listed = F.pandas_udf(lambda value: _bands([fingerprint(x) for x in value], bands, rows), "array<string>")
    banded = stored(members.select("key", F.explode(listed("text")).alias("band")), "edit-bands")
    # Blocks: with b blocks in a band, a row meets block pairs (own, any), each pair of blocks once.
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / 256).cast("int"))
    dealt = banded.join(stored(sizes.select("band", "blocks"), "edit-band-sizes"), "band").withColumn("own", F.pmod(F.hash("key"), "blocks"))
    left = dealt.select("band", F.col("own").alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"), F.col("key").alias("left"))
    right = dealt.select("band", F.col("own").alias("y"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"), F.col("key").alias("right"))
    candidates = stored(left.join(right, ["band", "x", "y"]).filter("left < right").select("left", "right").distinct(), "edit-candidates")
    of = members.select("key", "class_id", "text")
    both = candidates.join(of.select(F.col("key").alias("left"), F.col("class_id").alias("class_a"), F.col("text").alias("a")), "left").join(
        of.select(F.col("key").alias("right"), F.col("class_id").alias("class_b"), F.col("text").alias("b")), "right",
    )
    most = F.floor((1 - near) * F.greatest(F.length("a"), F.length("b"))).cast("int")
    pairs = both.withColumn("most", most).filter(F.abs(F.length("a") - F.length("b")) <= F.col("most"))
    pairs = pairs.withColumn("distance", F.levenshtein("a", "b")).filter("distance <= most").select("class_a", "class_b", "distance")
    return keyed.select("doc_id", "key").join(members.select("key", "class_id"), "key").select("doc_id", "class_id"), pairs
