"""Hierarchical packing of token ids into context windows of several lengths.

Every document becomes its ids and an end id. Whole windows of the longest tier are cut off first.
What remains is routed to the smallest tier that holds it. A task keeps a bounded pool of such
remainders; when the pool is full, each tier is packed from the longest to the shortest, a window
starts with a remainder of its own tier, and its gap is filled from shorter tiers: whole pieces first,
then one piece cut to the last id. So all windows are exactly full, but for one at the end of a task.
Finished windows of a tier are dealt to step groups of equal token counts so that the attention cost
(the sum of squared piece lengths) is about equal within each round of groups.

There is no shuffle: a task packs the rows of its own input split, memory is bounded by the pool, and
a lost task is packed again from its split. Sequence ids carry the task's number, so they are unique.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorkit.llm.common import small_batches
from mirrorkit.llm.tokens import id_batches, public_path

TIERS = (256, 512, 1024, 2048)
POOL_WINDOWS = 64
GROUP_WINDOWS = 8
ROUND_GROUPS = 4
END_ID = 1
_BITS = 33

PACKED = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long, ids binary"
)

# A piece: (length, order of arrival, doc id, first id's place in the document, id bytes, document's ids).
Piece = tuple[int, int, object, int, bytes, int]


class Packer:
    """Packs a stream of documents; ``add`` and ``close`` yield finished sequences as lists of pieces."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, pool_windows: int = POOL_WINDOWS) -> None:
        self.tiers = tuple(sorted(tiers))
        self.top = self.tiers[-1]
        self.limit = pool_windows * self.top
        self.pool: list[Piece] = []  # ascending by length
        self.held = 0
        self.arrived = 0

    def _put(self, doc, start: int, ids: bytes, total: int) -> None:
        self.arrived += 1
        insort(self.pool, (len(ids) // 4, self.arrived, doc, start, ids, total), key=lambda p: p[:2])
        self.held += len(ids) // 4

    def add(self, doc, ids: bytes) -> Iterator[tuple[int, list[Piece]]]:
        n = len(ids) // 4
        whole = n - n % self.top
        for at in range(0, whole, self.top):
            yield self.top, [(self.top, 0, doc, at, ids[4 * at:4 * (at + self.top)], n)]
        if whole < n:
            self._put(doc, whole, ids[4 * whole:], n)
        if self.held >= self.limit:
            yield from self._pack(keep=self.top)

    def close(self) -> Iterator[tuple[int, list[Piece]]]:
        yield from self._pack(keep=0)

    def _pack(self, keep: int) -> Iterator[tuple[int, list[Piece]]]:
        """Build windows until fewer than ``keep`` ids are pooled."""
        while self.pool and self.held >= keep:
            base = self.pool.pop()
            tier = next(t for t in self.tiers if t >= base[0])
            if self.held < tier and not keep:
                tier = self.top  # the last ids of a task share one window
            pieces, gap = [base], tier - base[0]
            while gap and self.pool:
                at = bisect_right(self.pool, gap, key=lambda p: p[0]) - 1
                if at >= 0:
                    piece = self.pool.pop(at)
                else:  # every piece is longer than the gap: cut the shortest
                    length, order, doc, start, ids, total = self.pool.pop(0)
                    piece = (gap, order, doc, start, ids[:4 * gap], total)
                    self.held -= length
                    self._put(doc, start + gap, ids[4 * gap:], total)
                    self.held += gap
                pieces.append(piece)
                gap -= piece[0]
            self.held -= sum(piece[0] for piece in pieces)
            yield tier, pieces


def balanced(windows: list[list[Piece]], groups: int, room: int) -> list[int]:
    """The group of each window: costly windows first, each to the cheapest group that has room."""
    cost, used, out = [0] * groups, [0] * groups, [0] * len(windows)
    weights = [sum(piece[0] ** 2 for piece in window) for window in windows]
    for i in sorted(range(len(windows)), key=lambda i: (-weights[i], i)):
        best = min((g for g in range(groups) if used[g] < room), key=lambda g: (cost[g], g))
        out[i] = best
        cost[best] += weights[i]
        used[best] += 1
    return out


def _rows(batches, path: str, end_id: int, tiers: tuple[int, ...]):
    import pyarrow as pa
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << _BITS
    packer, top = Packer(tiers), max(tiers)
    waiting: dict[int, list[list[Piece]]] = {tier: [] for tier in tiers}
    state = {"sequence": base, "group": base}
    kinds = [pa.int64()] * 6 + [pa.int32(), pa.int64(), pa.binary()]
    names = [part.split()[0] for part in PACKED.split(", ")]

    def release(tier: int) -> list[tuple]:
        windows, waiting[tier] = waiting[tier], []
        room = GROUP_WINDOWS * top // tier
        groups = -(-len(windows) // room)
        rows = []
        for window, group in zip(windows, balanced(windows, groups, room), strict=True):
            offset = 0
            for length, _, doc, start, ids, total in window:
                rows.append((doc, start, length, total, state["sequence"], offset, tier, state["group"] + group, ids))
                offset += length
            state["sequence"] += 1
        state["group"] += groups
        return rows

    def taken(sequences) -> list[tuple]:
        rows = []
        for tier, window in sequences:
            waiting[tier].append(window)
            if len(waiting[tier]) >= ROUND_GROUPS * GROUP_WINDOWS * top // tier:
                rows += release(tier)
        return rows

    def arrow(rows: list[tuple]):
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        for docs, ids in id_batches(batch, path, end_id):
            rows = []
            for doc, own in zip(docs, ids, strict=True):
                rows += taken(packer.add(doc, own))
            if rows:
                yield arrow(rows)
    rows = taken(packer.close())
    for tier in tiers:
        if waiting[tier]:
            rows += release(tier)
    if rows:
        yield arrow(rows)


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Pieces of packed sequences: ``PACKED``; the ids of a piece are little-endian unsigned 32-bit.

    Needs columns ``doc_id`` and ``text``; others are ignored. A null or empty text is the end id
    alone. A null ``doc_id`` is kept and stays null; equal rows are packed once each. An empty table
    gives no rows. A text of any length is cut into windows of the longest tier. ``tiers`` are powers
    of two; the sequence of a tier holds exactly so many ids, but for at most one sequence per task,
    which counts as padded to the longest tier.
    """
    if not tiers or any(t < 1 or t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    path, tiers = tokenizer or public_path(), tuple(sorted(tiers))
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(lambda batches: _rows(batches, path, end_id, tiers), PACKED)


def packed_pieces(docs: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pack(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        "tier", "step_group",
    )
