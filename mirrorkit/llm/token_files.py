"""Token files of independent zstandard frames, a document table and a trailing seek table.

Layout of a file, all numbers little-endian:

* frames: zstandard frames, each alone readable, of ids as unsigned 16-bit or 32-bit numbers;
* the document table: a skippable frame (magic 0x184D2A50) that holds one zstandard frame of, for each
  document, its id, the frame it starts in, its place there and its number of ids, as 64-bit numbers;
  a document lies in one frame;
* the seek table: a skippable frame (magic 0x184D2A5E) with the compressed size, the plain size and the
  low 32 bits of XXH64 of the plain bytes for each frame, then number of frames, a descriptor and the
  magic 0x8F92EAB1, as in zstandard's public seekable format. So ``zstd -d`` reads the file as well.

A reader takes the last bytes of the file, then the two tables, then only the frames that it wants.

Writing is one range shuffle of the texts by document id; tasks encode, write files under names that
no other attempt uses, and return a row per file. Only the rows of successful attempts reach the
manifest, so files left by lost executors are never read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mirrorkit.llm.common import partitions, small_batches
from mirrorkit.llm.tokens import id_batches, public_path
from mirrorkit.session import stored, work_dir

END_ID = 2
FRAME_IDS = 1 << 16
LEVEL = 3
# Rare words take most of the encoding, so more of them are remembered here, for some 120 MB a worker.
ROOM = 600_000

# Fixed values of zstandard's seekable format.
SKIP_MAGIC = 0x184D2A50
SEEK_SKIP_MAGIC = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

MANIFEST = "part long, file string, n_docs long, n_ids long, n_frames long, n_bytes long"
NO_ID = -(1 << 63)


def open_store(uri: str):
    """A file system and the path on it for a folder or file URI; plain paths are local."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class TokenWriter:
    """Writes one file; ``wide`` keeps ids in 32 bits instead of 16."""

    def __init__(self, sink, wide: bool, frame_ids: int = FRAME_IDS) -> None:
        import zstandard

        self.sink, self.kind, self.frame_ids = sink, "<u4" if wide else "<u2", frame_ids
        self.codec = zstandard.ZstdCompressor(level=LEVEL)
        self.open: list[np.ndarray] = []
        self.waiting = 0
        self.frames: list[tuple[int, int, int]] = []
        self.documents: list[tuple[int, int, int, int]] = []
        self.ids = 0
        self.bytes = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.waiting and self.waiting + len(ids) > self.frame_ids:
            self._close_frame()
        self.documents.append((NO_ID if doc_id is None else doc_id, len(self.frames), self.waiting, len(ids)))
        self.open.append(ids.astype(self.kind))
        self.waiting += len(ids)
        self.ids += len(ids)

    def _write(self, data: bytes) -> None:
        self.sink.write(data)
        self.bytes += len(data)

    def _close_frame(self) -> None:
        plain = np.concatenate(self.open).tobytes()
        frame = self.codec.compress(plain)
        self.frames.append((len(frame), len(plain), _checksum(plain)))
        self._write(frame)
        self.open, self.waiting = [], 0

    def close(self) -> None:
        if self.open:
            self._close_frame()
        width = np.dtype(self.kind).itemsize
        table = np.asarray(self.documents, dtype="<i8").reshape(-1, 4).T.tobytes()
        inner = struct.pack("<BQ", width, len(self.documents)) + self.codec.compress(table)
        inner += struct.pack("<II", _checksum(table), len(inner) + 8)
        self._write(struct.pack("<II", SKIP_MAGIC, len(inner)) + inner)
        seek = b"".join(struct.pack("<III", *frame) for frame in self.frames)
        foot = struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEK_MAGIC)
        self._write(struct.pack("<II", SEEK_SKIP_MAGIC, len(seek) + len(foot)) + seek + foot)


class TokenReader:
    """Random access to one file; ``source`` has read, seek and size. Frames are checked when read."""

    def __init__(self, source) -> None:
        import zstandard

        self.source, self.codec = source, zstandard.ZstdDecompressor()
        size = source.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table")
        seek = np.frombuffer(self._at(size - 9 - 12 * count, 12 * count), dtype="<u4").reshape(-1, 3).astype("i8")
        self.sizes, self.plain, self.sums = seek[:, 0], seek[:, 1], seek[:, 2]
        self.starts = np.cumsum(self.sizes) - self.sizes
        end = size - 9 - 12 * count - 8
        table_sum, back = struct.unpack("<II", self._at(end - 8, 8))
        inner = self._at(end - back, back)
        width, n_docs = struct.unpack("<BQ", inner[:9])
        table = self.codec.decompress(inner[9:-8], max_output_size=32 * n_docs) if n_docs else b""
        if _checksum(table) != table_sum:
            raise ValueError("the document table is damaged")
        self.kind = "<u4" if width == 4 else "<u2"
        self.doc_ids, self.frame_of, self.place, self.n_ids = np.frombuffer(table, dtype="<i8").reshape(4, -1)

    def _at(self, start: int, length: int) -> bytes:
        self.source.seek(start)
        data = self.source.read(length)
        if len(data) != length:
            raise ValueError("the file is cut short")
        return data

    def frame(self, k: int) -> np.ndarray:
        packed = self._at(int(self.starts[k]), int(self.sizes[k]))
        plain = self.codec.decompress(packed, max_output_size=int(self.plain[k]))
        if _checksum(plain) != self.sums[k]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(plain, dtype=self.kind)

    def rows(self, wanted: np.ndarray | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc id, ids) of the documents at the wanted places, ascending; of all without them."""
        last, ids = -1, None
        for i in range(len(self.doc_ids)) if wanted is None else wanted:
            if self.frame_of[i] != last:
                last = self.frame_of[i]
                ids = self.frame(int(last))
            at = int(self.place[i])
            doc_id = int(self.doc_ids[i])
            yield None if doc_id == NO_ID else doc_id, ids[at:at + int(self.n_ids[i])]

    def find(self, doc_ids: Iterable[int]) -> Iterator[tuple[int | None, np.ndarray]]:
        """The documents with these ids; frames without any of them are not read."""
        yield from self.rows(np.flatnonzero(np.isin(self.doc_ids, np.fromiter(doc_ids, dtype="i8"))))


def _write_part(batches, folder: str, path: str, end_id: int):
    import pyarrow as pa
    from pyspark import TaskContext

    part, store, writer, sink = TaskContext.get().partitionId(), None, None, None
    name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
    for batch in batches:
        for doc_ids, ids in id_batches(batch, path, end_id, room=ROOM):
            if writer is None:
                from mirrorkit.llm.tokens import encoder

                store, base = open_store(folder)
                store.create_dir(base, recursive=True)
                sink = store.open_output_stream(f"{base}/{name}")
                writer = TokenWriter(sink, encoder(path, ROOM).tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16)
            for doc_id, own in zip(doc_ids, ids, strict=True):
                writer.add(doc_id, np.frombuffer(own, dtype="<u4"))
    if writer is not None:
        writer.close()
        sink.close()
        row = [part, f"{folder}/{name}", len(writer.documents), writer.ids, len(writer.frames), writer.bytes]
        yield pa.RecordBatch.from_pylist([dict(zip((f.split()[0] for f in MANIFEST.split(", ")), row, strict=True))])


def write_token_files(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the ids of all texts in ascending ``doc_id`` order; returns the manifest, one row per file.

    Needs columns ``doc_id`` and ``text``. A null or empty text is the end id alone; a null ``doc_id``
    sorts first and reads back as null; rows with equal ids are ordered by their texts' hashes and kept
    one by one, so no id is hot. An empty table gives no files and an empty manifest. ``folder`` must
    be one that every executor reaches; by default a new one below the shared folder.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder, path = folder or work_dir(spark, "tokens"), tokenizer or public_path()
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("row")]
    ranged = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
        .repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    )
    return stored(ranged.mapInArrow(lambda batches: _write_part(batches, folder, path, end_id), MANIFEST), "manifest")


def _read_files(batches, wanted: list[int] | None):
    import pyarrow as pa

    names = ("file", "nth", "doc_id", "start", "n_tokens", "ids")
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    for batch in batches:
        for file in batch.column("file").to_pylist():
            store, path = open_store(file)
            with store.open_input_file(path) as source:
                reader = TokenReader(source)
                places = None if wanted is None else np.flatnonzero(np.isin(reader.doc_ids, np.asarray(wanted, "i8")))
                before = np.cumsum(reader.n_ids) - reader.n_ids
                rows, size = [], 0
                for i, (doc_id, ids) in zip(range(len(before)) if places is None else places, reader.rows(places), strict=True):
                    rows.append((file, int(i), doc_id, int(before[i]), len(ids), ids.astype("<u4").tobytes()))
                    size += len(ids)
                    if size > 1 << 20 or len(rows) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_token_files(manifest: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows ``doc_id, start, n_tokens, ids`` from the files; with ``doc_ids`` only their frames are read.

    ``start`` counts the ids of all documents before, over all files in order.
    """
    files = manifest.select(
        "file", (F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids")).alias("before"), "n_docs",
    )
    files = stored(files, "file-starts")  # one row per file
    rows = files.select("file").repartition(partitions(manifest.sparkSession)).mapInArrow(
        lambda batches: _read_files(batches, doc_ids),
        "file string, nth long, doc_id long, start long, n_tokens long, ids binary",
    )
    return rows.join(F.broadcast(files.select("file", "before")), "file").select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids",
    )



def token_file_rows(docs: DataFrame) -> DataFrame:
    """What the files hold of each document, with a checksum in place of its ids."""
    rows = read_token_files(write_token_files(docs))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
