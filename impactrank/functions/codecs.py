"""Integer codecs for segment bodies, as functions on Arrow batches of (id, values) rows.

Results of ranking don't depend on a codec; these prove round trips and measure sizes. Sequences are of
non-negative numbers below 2**32. Gaps are taken by windows (operators.gaps) or by ``delta`` here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers in a 64-bit word by selector, and their bit widths. Selectors 0 and 1 mean runs of ones.
PER_WORD = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WORD_BITS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
#: Bit widths of a 128-bit block; width 0 means a block of ones.
BLOCK_BITS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 16, 21, 32)
#: Docids that are coded at once, a longer row alone, and blocks whose bits are taken apart at once: what a task holds beside its batch.
AT_ONCE, BLOCKS_AT_ONCE = 1 << 17, 1 << 12


def delta(values: np.ndarray, stride: int = 1) -> np.ndarray:
    """Each value less the one ``stride`` places earlier."""
    out = values.astype(np.int64).copy()
    out[stride:] -= values[:-stride] if stride < len(values) else 0
    return out


def undelta(gaps: np.ndarray, stride: int = 1) -> np.ndarray:
    out = gaps.astype(np.int64).copy()
    for lane in range(stride):
        out[lane::stride] = np.cumsum(out[lane::stride])
    return out


def vbyte_encode(values: np.ndarray) -> bytes:
    """Groups of 7 bits, high ones first; the last byte of a number has its top bit set."""
    v = values.astype(np.uint64)
    size = np.maximum(1, (bit_length(v) + 6) // 7)
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(v)), size)
    left = np.repeat(ends, size) - 1 - np.arange(ends[-1] if len(v) else 0)
    out = ((v[owner] >> (left * 7).astype(np.uint64)) & np.uint64(0x7F)).astype(np.uint8)
    out[left == 0] |= 0x80
    return out.tobytes()


def vbyte_decode(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    stop = raw >= 0x80
    ends = np.flatnonzero(stop)
    owner = np.cumsum(stop) - stop
    part = (raw & 0x7F).astype(np.int64) << (7 * (ends[owner] - np.arange(len(raw))))
    return np.bincount(owner, weights=part, minlength=len(ends)).astype(np.int64) if len(raw) else np.zeros(0, np.int64)


def bit_length(v: np.ndarray) -> np.ndarray:
    """Bits that each number needs; 0 for 0."""
    return np.frexp(v.astype(np.float64))[1].astype(np.int64)


def _choices(values: np.ndarray, stops: np.ndarray, shapes: list[tuple[int, int]], otherwise: int) -> np.ndarray:
    """For each place the first shape (integers, bits) that the integers from there on fill and fit before the place where theirs stop; ``otherwise`` where none does."""
    n = len(values)
    out = np.full(n, otherwise)
    at = np.arange(n)
    for number in reversed(range(len(shapes))):
        many, bits = shapes[number]
        odd = values != 1 if bits == 0 else values >> bits != 0
        clear = np.minimum.accumulate(np.where(odd, at, n)[::-1])[::-1]  # the next that doesn't fit
        out[np.minimum(clear, stops) - at >= many] = number
    return out


def _steps(choice: np.ndarray, stops: np.ndarray, many: list[int]) -> np.ndarray:
    """The places at which words begin, each word taking as many integers as its choice says, up to where they stop."""
    onward = np.minimum(np.arange(len(choice)) + np.array(many)[choice], stops).tolist()
    out, at = [], 0
    while at < len(onward):
        out.append(at)
        at = onward[at]
    return np.array(out, np.int64)


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences one behind the other, the place where each stops, and that place for every integer."""
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    return np.concatenate(parts).astype(np.int64), ends, np.repeat(ends, sizes)


def _bits_packed(values: np.ndarray, bits: int, room: int) -> np.ndarray:
    """Rows of numbers as rows of ``room`` bytes, the first number in the lowest bits."""
    out = np.zeros((len(values), room), np.uint8)
    for i in range(0, len(values), BLOCKS_AT_ONCE):
        own = values[i : i + BLOCKS_AT_ONCE]
        flags = np.zeros((len(own), 8 * room), np.uint8)
        flags[:, : own.shape[1] * bits] = ((own[:, :, None] >> np.arange(bits)) & 1).astype(np.uint8).reshape(len(own), -1)
        out[i : i + BLOCKS_AT_ONCE] = np.packbits(flags, axis=1, bitorder="little")
    return out


def _bits_unpacked(rows: np.ndarray, many: int, bits: int) -> np.ndarray:
    out = np.zeros((len(rows), many), np.int64)
    for i in range(0, len(rows), BLOCKS_AT_ONCE):
        own = rows[i : i + BLOCKS_AT_ONCE]
        flags = np.unpackbits(own, axis=1, bitorder="little")[:, : many * bits].reshape(len(own), many, bits).astype(np.int64)
        out[i : i + BLOCKS_AT_ONCE] = (flags << np.arange(bits)).sum(axis=2)
    return out


def _in_turn(groups: list[tuple[np.ndarray, np.ndarray]], sizes: np.ndarray) -> np.ndarray:
    """Rows of several widths in one sequence; each group has the numbers of its rows and their values."""
    begin = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.int64)
    for rows, values in groups:
        out[begin[rows][:, None] + np.arange(values.shape[1])] = values
    return out


def simple8b_encode(parts: list[np.ndarray]) -> list[bytes]:
    """Full 64-bit words, the selector in the low 4 bits: for each, the selector of most integers that all fit.

    A zero needs a bit as any other number, so that runs of ones stay runs of ones. Many sequences are encoded at once, each in words of its own.
    """
    if not parts:
        return []
    v, ends, stops = _joined(parts)
    choice = _choices(v, stops, list(zip(PER_WORD, WORD_BITS)), -1)
    begin = _steps(choice, stops, list(PER_WORD))
    words = choice[begin].astype("<u8")
    for selector, (many, bits) in enumerate(zip(PER_WORD, WORD_BITS)):
        rows = np.flatnonzero(choice[begin] == selector)
        if bits and len(rows):
            own = v[begin[rows][:, None] + np.arange(many)].astype(np.uint64)
            words[rows] |= np.bitwise_or.reduce(own << (4 + bits * np.arange(many)).astype(np.uint64), axis=1)
    data, cut = words.tobytes(), (8 * np.searchsorted(begin, ends)).tolist()
    return [data[i:j] for i, j in zip([0, *cut], cut)]


def simple8b_decode(parts: list[bytes]) -> list[np.ndarray]:
    words = np.frombuffer(b"".join(parts), "<u8")
    selector = (words & np.uint64(15)).astype(np.int64)
    groups = []
    for s in np.unique(selector):
        many, bits = PER_WORD[s], WORD_BITS[s]
        rows = np.flatnonzero(selector == s)
        own = (words[rows][:, None] >> (4 + bits * np.arange(many)).astype(np.uint64)) & np.uint64((1 << bits) - 1) if bits else np.ones((len(rows), many))
        groups.append((rows, own.astype(np.int64)))
    held = np.concatenate(([0], np.cumsum(np.array(PER_WORD)[selector])))
    values = _in_turn(groups, np.array(PER_WORD)[selector])
    cut = held[np.cumsum([0, *(len(p) // 8 for p in parts)])].tolist()
    return [values[i:j] for i, j in zip(cut, cut[1:])]


def blocks_encode(parts: list[np.ndarray]) -> list[bytes]:
    """Runs of 128-bit blocks of one width. Each selector byte holds a width's number and a run of up to 16 blocks; selectors stand reversed at the end.

    A block of width w holds 128 // w integers, of ones 256. A tail too short for its width's block goes into blocks of 32 bits,
    the last of them padded; the count at the very end says what counts. Many sequences are encoded at once, each in blocks of its own.
    """
    if not parts:
        return []
    v, ends, stops = _joined(parts)
    shapes = [(128 // b if b else 256, b) for b in BLOCK_BITS]
    choice = _choices(v, stops, shapes, len(BLOCK_BITS) - 1)
    begin = _steps(choice, stops, [n for n, _ in shapes])
    width = choice[begin]
    body = np.zeros((len(begin), 16), np.uint8)
    for w in np.unique(width):
        many, bits = shapes[w]
        rows = np.flatnonzero(width == w)
        if bits:
            at = begin[rows][:, None] + np.arange(many)
            inside = at < stops[begin[rows]][:, None]
            body[rows] = _bits_packed(np.where(inside, v[np.minimum(at, len(v) - 1)], 0), bits, 16)
    cut = np.searchsorted(begin, ends)
    filled = np.array(BLOCK_BITS)[width] > 0
    data, place = body[filled].tobytes(), (16 * np.concatenate(([0], np.cumsum(filled)))).tolist()
    out = []
    for low, high, part in zip([0, *cut.tolist()], cut.tolist(), parts):
        selectors: list[int] = []
        for w in width[low:high].tolist():
            if selectors and selectors[-1] >> 4 == w and selectors[-1] & 15 < 15:
                selectors[-1] += 1
            else:
                selectors.append(w << 4)
        out.append(data[place[low] : place[high]] + bytes(reversed(selectors)) + len(selectors).to_bytes(4, "little") + len(part).to_bytes(4, "little"))
    return out


def blocks_decode(parts: list[bytes]) -> list[np.ndarray]:
    widths, bodies, counts, blocks = [], [], [], []
    for data in parts:
        n_selectors = int.from_bytes(data[-8:-4], "little")
        own = [s >> 4 for s in data[-8 - n_selectors : -8][::-1] for _ in range((s & 15) + 1)]
        widths += own
        blocks.append(len(own))
        bodies.append(data[: len(data) - 8 - n_selectors])
        counts.append(int.from_bytes(data[-4:], "little"))
    width = np.array(widths, np.int64)
    body = np.zeros((len(width), 16), np.uint8)
    body[np.array(BLOCK_BITS)[width] > 0] = np.frombuffer(b"".join(bodies), np.uint8).reshape(-1, 16)
    groups = []
    for w in np.unique(width):
        bits = BLOCK_BITS[w]
        rows = np.flatnonzero(width == w)
        groups.append((rows, _bits_unpacked(body[rows], 128 // bits, bits) if bits else np.ones((len(rows), 256), np.int64)))
    many = np.array([128 // b if b else 256 for b in BLOCK_BITS])[width]
    values = _in_turn(groups, many)
    begin = np.concatenate(([0], np.cumsum(many)))[np.cumsum([0, *blocks])].tolist()
    return [values[i : i + n] for i, n in zip(begin, counts)]


#: A codec encodes many sequences at once, so that short ones cost little, and decodes them.
Codec = tuple[Callable[[list[np.ndarray]], list[bytes]], Callable[[list[bytes]], list[np.ndarray]]]


def _each(codec: tuple[Callable[[np.ndarray], bytes], Callable[[bytes], np.ndarray]]) -> Codec:
    return (lambda parts: [codec[0](v) for v in parts]), (lambda parts: [codec[1](b) for b in parts])


def _with_delta(codec: Codec, stride: int) -> Codec:
    return (lambda parts: codec[0]([delta(v, stride) for v in parts])), (lambda parts: [undelta(v, stride) for v in codec[1](parts)])


_RAW = _each((lambda v: v.astype("<u4").tobytes(), lambda b: np.frombuffer(b, "<u4").astype(np.int64)))
#: Codecs by name; docids rise strictly. Simple-8b and blocks take gaps in the stride that their name says.
CODECS: dict[str, Codec] = {
    "none": _RAW,
    "vbyte": _with_delta(_each((vbyte_encode, vbyte_decode)), 1),
    "simple8b": _with_delta((simple8b_encode, simple8b_decode), 1),
    "blocks": _with_delta((blocks_encode, blocks_decode), 1),
    "blocks_d0": (blocks_encode, blocks_decode),
    "blocks_d4": _with_delta((blocks_encode, blocks_decode), 4),
}


def _checked(docids: np.ndarray) -> np.ndarray:
    """The formats are of 32 bits; larger docids are no docids to them."""
    if len(docids) and (docids.max() >= 1 << 32 or docids.min() < 0):
        raise ValueError("codecs hold docids from 0 to 2**32 - 1")
    return docids


def _portions(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``AT_ONCE`` docids together; a row of more is one of its own."""
    ends, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + AT_ONCE, side="right")))
        yield begin, end
        begin = end


def encoded(bodies: DataFrame, codec: str) -> DataFrame:
    """(term, impact, block, codec, payload, n) of segment bodies (term, impact, block, docids)."""
    encode = CODECS[codec][0]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sizes = part["docids"].map(len).to_numpy(np.int64)
            for i, j in _portions(sizes):
                own = part.iloc[i:j]
                yield pd.DataFrame({"term": own["term"], "impact": own["impact"], "block": own["block"], "codec": codec, "payload": encode([_checked(np.asarray(d, np.int64)) for d in own["docids"]]), "n": sizes[i:j]})

    return bodies.select("term", "impact", "block", "docids").mapInPandas(run, "term string, impact int, block long, codec string, payload binary, n long")


def decoded(coded: DataFrame) -> DataFrame:
    """(term, impact, block, docids) of rows by ``encoded``, each by the codec that it names."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for codec, rows in part.groupby("codec", sort=False):
                for i, j in _portions(rows["n"].to_numpy(np.int64)):
                    own = rows.iloc[i:j]
                    docids = CODECS[codec][1]([bytes(p) for p in own["payload"]])
                    yield pd.DataFrame({"term": own["term"], "impact": own["impact"], "block": own["block"], "docids": pd.Series(docids, index=own.index, dtype=object)})

    return coded.select("term", "impact", "block", "codec", "payload", "n").mapInPandas(run, "term string, impact int, block long, docids array<long>")


def vbyte_length(value: Column) -> Column:
    """Bytes of a number in variable bytes."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(value)) / 7).cast("int"))


def width_class(value: Column) -> Column:
    """The block width of a number: 0 for one, else the least that holds it."""
    out = F.when(value == 1, F.lit(0))
    for bits in BLOCK_BITS[1:]:
        out = out.when(value < (1 << bits), F.lit(bits))
    return out.otherwise(F.lit(64))
