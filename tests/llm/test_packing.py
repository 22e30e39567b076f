import zlib

import numpy as np
import pytest
from conftest_data import documents
from hypothesis import given, settings
from hypothesis import strategies as st
from impactrank.llm import packing as P
from impactrank.llm.queries import op5_pack_sequences
from tokenizers import Tokenizer

PATH = P._tokenizer_path(None)
TOKENIZER = Tokenizer.from_file(PATH)


def brute_pieces(docs, capacity=4096):
    out = []
    for doc_id, text in docs:
        ids = np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out += [(doc_id, k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
    return sorted(out, key=repr)


def check_layout(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def pieces_of(rows):
    return sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr)


def test_query(spark, sf_dir):
    rows = op5_pack_sequences(spark, sf_dir).collect()
    assert pieces_of(rows) == brute_pieces(documents(sf_dir))
    least = -(-sum(r.length for r in rows) // 4096)
    assert check_layout(rows, 4096) <= least * 1.01 + 1


@pytest.mark.parametrize("block", [P.BLOCK, 3, 40])
def test_odd_rows_in_blocks(odd, block):
    rows = P.pack_documents(odd, 64, block=block).collect()
    assert pieces_of(rows) == brute_pieces([(r.doc_id, r.text) for r in odd.collect()], 64)
    check_layout(rows, 64)
    assert P.pack_documents(odd.limit(0), 64).count() == 0


def test_many_blocks_pack_well(spark):
    sizes = np.random.default_rng(3).integers(1, 900, 4000)
    pieces = spark.createDataFrame([(int(s),) for s in sizes], "length long")
    rows = P.pack(pieces, 1000, 500).collect()
    assert len(rows) == len(sizes) and sorted(r.length for r in rows) == sorted(sizes.tolist())
    assert check_layout(rows, 1000) <= -(-int(sizes.sum()) // 1000) * 1.02 + 1


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert P.encoder(PATH).encode([text.encode()])[0] == np.array(TOKENIZER.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_forgotten_words_come_again(monkeypatch):
    monkeypatch.setattr(P, "REMEMBERED", 3)
    own = P.WordIds(PATH)
    for text in ("one two three four five", "six seven", "one two eight", "it's its <|endoftext|>x", "four ten é"):
        assert own.encode([text.encode()])[0] == np.array(TOKENIZER.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_bytes_that_are_no_text(spark):
    for text in (b"\xff\xfe abc", b"ab\xc3 cd\x80ef", b"<|x \xff"):
        assert P.encoder(PATH).encode([text])[0] == np.array(TOKENIZER.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
    frame = spark.range(1).selectExpr("id AS doc_id", "CAST(unhex('FFFE20616263') AS STRING) AS text")
    assert P.pack_documents(frame).count() == 1


def plain_choice(sizes, capacity):
    """Each piece by falling size into the open bin that leaves the least sum of squared numbers of open bins by gap, all sums formed anew."""
    bins = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        best = None
        for gap in sorted({capacity - b for b in bins if capacity > b >= 0 and capacity - b >= sizes[i]}):
            counts = {}
            for b in bins:
                counts[capacity - b] = counts.get(capacity - b, 0) + 1
            counts[gap] -= 1
            counts[gap - sizes[i]] = counts.get(gap - sizes[i], 0) + 1
            total = sum(n * n for g, n in counts.items() if 0 < g < capacity)
            if best is None or total < best[0]:
                best = (total, gap)
        if best:
            bins[bins.index(capacity - best[1])] += sizes[i]
        else:
            bins.append(sizes[i])
    return sorted(bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_placement_is_the_least_sum_of_squares(sizes):
    _, _, fill = P.pack_block(np.array(sizes, np.int64), 20)
    assert sorted(fill.tolist()) == plain_choice(sizes, 20)


def test_sequences_hold_the_ids(spark, odd):
    packed = P.pack_documents(odd, 64, block=7, keep_ids=True)
    rows = {r.sequence_id: r for r in P.sequences(packed).collect()}
    for r in packed.collect():
        own = rows[r.sequence_id]
        assert bytes(own.ids)[4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids) and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        assert len(own.ids) == 4 * own.n_tokens <= 256


def test_a_repeated_word_is_looked_up_once():
    class Counted(P.Remembered):
        asked = 0

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

    own = P.WordIds(PATH)
    own.words = Counted()
    text = b"The same words " * 5000
    assert own.encode([text, text]) == [np.array(TOKENIZER.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()] * 2
    assert Counted.asked < 20


def test_any_white_space_and_control_bytes():
    own = P.WordIds(PATH)
    assert own.encode([]) == []
    texts = [b"", b" ", b"\n\n", *(b"Ab" + bytes([x]) + b"c  it's" + bytes([x]) for x in range(256)), " x y　z İ K".encode(), b"<|endoftext|> a", b"\x00"]
    assert own.encode(texts) == [np.array(TOKENIZER.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
