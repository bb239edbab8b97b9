"""Packing and token files: exact ids, exact round trips."""

from __future__ import annotations

import io
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mirrorkit.llm.packing import Packer, balanced, pack, packed_pieces
from mirrorkit.llm.token_files import TokenReader, TokenWriter, read_token_files, token_file_rows, write_token_files
from mirrorkit.llm.tokens import WordEncoder, encoder, id_batches, public_path
from tests.llm.conftest import ODD

ENCODER = WordEncoder(public_path(), room=50)


def plain_ids(text: str) -> list[int]:
    return ENCODER.tokenizer.encode(text, add_special_tokens=False).ids


ALPHABET = st.sampled_from([
    "a", "b", "Z", "é", "ß", "Σ", "İ", "漢", "😀", "1", "²", "'", "s", "t", "re", "'s", "!", "?", ".", "-", "<|", "|>",
    "<|endoftext|>", " ", " ", "\n", "\t", "\x1c", "́", " ", " ", "=", "̸", "don't",
])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=25).map("".join), min_size=1, max_size=4))
def test_word_memory_gives_the_library_s_ids(texts):
    got = ENCODER.batch(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain_ids(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_any_text_and_a_file_without_words(texts):
    other = WordEncoder(public_path("byte_bpe_50k.json"))
    assert ENCODER.by_words and not other.by_words
    for own in (ENCODER, other):
        got = own.batch(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_rows_with_another_tokenizer_file(spark, odd):
    path = public_path("byte_bpe_50k.json")
    own = WordEncoder(path).tokenizer
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["doc_tokens"]) for r in pack(odd, tokenizer=path).filter("start = 0").collect())
    want = sorted((doc is None, doc or 0, len(own.encode(text or "", add_special_tokens=False).ids) + 1) for doc, text, *_ in ODD)
    assert got == want


def test_memory_keeps_a_generation():
    own = WordEncoder(public_path(), room=3)
    texts = ["alpha, beta gamma", "delta alpha, epsilon zeta", "beta gamma. (eta) Straße", "alpha, ÉTÉ x²"] * 3
    for text in texts:
        assert np.frombuffer(own.batch([text])[0], "<u4").tolist() == plain_ids(text)
    assert len(own.new) < 12


def expected(rows):
    """(doc id, ids with the end id) of every row, as a multiset."""
    return sorted(((doc is None, doc or 0, tuple(plain_ids(text or "") + [1])) for doc, text, *_ in rows))


@pytest.mark.parametrize("tiers", [(256, 512, 1024, 2048), (8,), (4, 16)])
def test_every_id_lies_in_one_piece_and_windows_are_full(spark, odd, tiers):
    rows = pack(odd.repartition(2), tiers=tiers).collect()
    sequences = defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] > 0
        sequences[r["sequence_id"]].append(r)
    short = 0
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        ends = np.cumsum([p["length"] for p in pieces])
        assert [p["offset"] for p in pieces] == [0, *ends[:-1]]
        assert ends[-1] <= max(tiers) and len({(p["tier"], p["step_group"]) for p in pieces}) == 1
        short += ends[-1] != pieces[0]["tier"]
    assert short <= 2  # at most one for each task
    # Pieces of a document, put together by their starts, are its ids. Equal rows are told apart by count.
    whole = defaultdict(list)
    for r in rows:
        whole[r["doc_id"], r["doc_tokens"], r["start"]].append(np.frombuffer(r["ids"], "<u4").tolist())
    total = sum(len(ids) for _, _, ids in expected(ODD))
    assert sum(r["length"] for r in rows) == total
    five = [i for (doc, _, _), parts in sorted(whole.items(), key=lambda x: x[0][2]) if doc == 5 for i in parts[0]]
    assert five == plain_ids(ODD[8][1]) + [1]


def test_piece_checksums_and_empty_table(spark, odd, none):
    rows = packed_pieces(odd.filter("doc_id = 2")).collect()
    assert [(r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["offset"]) for r in rows] == [(2, 0, 1, 1, 0)]
    assert rows[0]["ids_crc32"] == zlib.crc32(np.array([1], "<u4").tobytes())
    assert packed_pieces(none).count() == 0
    with pytest.raises(ValueError, match="powers of two"):
        pack(none, tiers=(100,))


def test_gaps_are_filled_from_shorter_tiers_and_pool_is_bounded():
    packer = Packer((4, 8), pool_windows=4)
    done = []
    for doc, n in enumerate([5, 3, 3, 2, 7, 1, 20, 6, 2, 1, 1, 5, 3] * 9):
        done += packer.add(doc, b"".join(i.to_bytes(4, "little") for i in range(n)))
        assert packer.held < 5 * 8 and packer.held == sum(p[0] for p in packer.pool)
    done += packer.close()
    assert sum(sum(p[0] for p in w) != tier for tier, w in done) <= 1
    assert any(tier == 8 and len(w) > 1 and w[0][0] > 4 and all(p[0] <= 4 for p in w[1:]) for tier, w in done)
    assert {tier for tier, _ in done} == {4, 8}


def test_step_groups_have_equal_rooms_and_about_equal_costs():
    windows = [[(n, 0, 0, 0, b"", 0)] for n in (10, 9, 8, 7, 2, 1, 1, 1)]
    groups = balanced(windows, 2, 4)
    assert sorted(groups) == [0] * 4 + [1] * 4
    cost = [sum(windows[i][0][0] ** 2 for i in range(8) if groups[i] == g) for g in (0, 1)]
    assert abs(cost[0] - cost[1]) <= 20


class Sized(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def file_of(docs, wide=False, frame_ids=50):
    sink = Sized()
    writer = TokenWriter(sink, wide, frame_ids)
    for doc, ids in docs:
        writer.add(doc, np.array(ids, "<u4"))
    writer.close()
    return sink


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-9, 9)), st.lists(st.integers(0, 65535), max_size=80)), max_size=30), st.booleans())
def test_file_round_trip(docs, wide):
    reader = TokenReader(file_of(docs, wide))
    assert [(d, ids.tolist()) for d, ids in reader.rows()] == docs


def test_reader_opens_wanted_frames_only_and_finds_damage():
    docs = [(i, [i] * 40) for i in range(20)]
    sink = file_of(docs)
    reader = TokenReader(sink)
    opened = []
    frame = reader.frame
    reader.frame = lambda k: opened.append(k) or frame(k)
    assert [(d, len(ids)) for d, ids in reader.find([3, 17])] == [(3, 40), (17, 40)]
    assert opened == [3, 17] and len(reader.sizes) == 20
    import zstandard

    # Any zstandard reader sees the frames one after another and skips both tables.
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(sink.getvalue()), read_across_frames=True).read()
    assert np.frombuffer(plain, "<u2").tolist() == [i for _, ids in docs for i in ids]
    damaged = bytearray(sink.getvalue())
    damaged[int(reader.starts[5]) + int(reader.sizes[5]) - 1] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(TokenReader(Sized(bytes(damaged))).find([5]))
    with pytest.raises(ValueError):
        TokenReader(Sized(sink.getvalue()[:-3]))


def test_token_files_hold_every_row_in_order(spark, odd, none):
    rows = sorted(token_file_rows(odd).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, None, 1, 1, 1, 2, 3, 4, 5, 6]
    at = 0
    want = defaultdict(list)
    for doc, text, *_ in ODD:
        want[doc].append(np.array(plain_ids(text or "") + [2], "<u4"))
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
        assert (r["n_tokens"], r["ids_crc32"]) in [(len(x), zlib.crc32(x.tobytes())) for x in want[r["doc_id"]]]
    assert token_file_rows(none).count() == 0
    some = read_token_files(write_token_files(odd.filter(F.col("doc_id") > 1)), [6, 3]).collect()
    assert sorted(r["doc_id"] for r in some) == [3, 6]


def test_the_ids_do_not_depend_on_the_words_remembered():
    texts = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": [f"word{n % 7} Other{n}, again{n % 5}!" for n in range(40)]})
    path = public_path()
    found = [[ids for _, part in id_batches(texts, path, 2, width=8, room=room) for ids in part] for room in (4, 600_000)]
    assert found[0] == found[1] and len(found[0]) == 40
    assert encoder(path, 4) is not encoder(path, 600_000)
