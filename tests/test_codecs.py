import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from impactrank.functions import codecs

SEQUENCES = {
    "empty": [],
    "zero": [0],
    "one": [7],
    "zero and ones": list(range(120)),
    "from one": list(range(1, 121)),
    "run of 256": list(range(5, 261)),
    "run of 240": list(range(9, 249)),
    "width edges": sorted({(1 << b) + d for b in range(1, 31) for d in (-1, 0, 1)}),
    "above 2**21": [1, 3_000_000, 2**31, 2**32 - 1],
    **{f"length {n}": [3 * i * i for i in range(n)] for n in range(1, 18)},
}


@pytest.mark.parametrize("codec", codecs.CODECS)
@pytest.mark.parametrize("name", SEQUENCES)
def test_round_trip(codec, name):
    encode, decode = codecs.CODECS[codec]
    values = np.array(SEQUENCES[name], np.int64)
    assert decode(encode([values]))[0].tolist() == SEQUENCES[name]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), unique=True, max_size=400).map(sorted))
def test_any_rising_sequence(values):
    for encode, decode in codecs.CODECS.values():
        assert decode(encode([np.array(values, np.int64)]))[0].tolist() == values


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**28) | st.just(1), max_size=300), max_size=6))
def test_unsorted_numbers_many_at_once(parts):
    """Sequences encoded together are those encoded each by itself."""
    arrays = [np.array(v, np.int64) for v in parts]
    for v in arrays:
        assert codecs.vbyte_decode(codecs.vbyte_encode(v)).tolist() == v.tolist()
    for encode, decode in ((codecs.simple8b_encode, codecs.simple8b_decode), (codecs.blocks_encode, codecs.blocks_decode)):
        coded = encode(arrays)
        assert coded == [encode([v])[0] for v in arrays]
        assert [v.tolist() for v in decode(coded)] == parts


def test_known_bytes():
    assert codecs.vbyte_encode(np.array([1, 128, 300])) == bytes([0x81, 0x01, 0x80, 0x02, 0xAC])
    assert codecs.simple8b_encode([np.ones(240, np.int64)]) == [bytes(8)]
    assert len(codecs.blocks_encode([np.ones(256 * 16, np.int64)])[0]) == 1 + 8


@pytest.mark.parametrize("wrong", [2**32, -1])
def test_docids_beyond_the_formats_are_refused(spark, wrong):
    bodies = spark.createDataFrame([("a", 1, 0, [5, wrong])], "term string, impact int, block long, docids array<long>")
    with pytest.raises(Exception, match="2\\*\\*32"):
        codecs.encoded(bodies, "none").collect()
