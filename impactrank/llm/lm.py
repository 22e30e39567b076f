"""N-gram language model over Elias-Fano tries, trained on and applied to all documents.

Documents are encoded in chunks, each with its own lists of distinct words, pairs and triples of words. A chunk asks the shards of the model for
them and says how often each stands in training text. A shard adds up what all chunks say, builds its trie once and answers. So shuffles
carry each n-gram once a chunk, in packed rows, and no task holds more than a shard or a chunk.

A trie has three levels: words, their successors, and the successors of those pairs. Shards own first words with all that follows them; first words that hold over 1/``HOT`` of
all tokens are spread over all shards by their successors, and their totals are added up afterwards. Each level has its nodes, relative to their
context's rank, in one Elias-Fano sequence, monotone pointers to their children in another, and quantised probabilities beside them; levels are memory-mapped.
A successor is searched for between its context's pointers.

The model interpolates absolutely discounted probabilities of all orders: P(w|h) = (c(h,w) - D) / c(h) + D n(h) / c(h) P(w|h'), where n(h) is the number of distinct
successors of h and h' is h without its first word; contexts that training text doesn't have pass on to h'. Tries hold the first term, quantised, for each n-gram and the weight D n(h) / c(h) for each
context. At the base is P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)), from exact counts. A text's first word has the start of a text as its context. Words are held as 64-bit hashes, contexts
as 48 bits besides their shard, successors as 40 and 32 bits within their context.
"""

from __future__ import annotations

import itertools
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, crc_fold, give_back, id_text, mix, slices, text_bytes, words

#: Bytes of text in a chunk, tokens of text for each shard, and the share of tokens from which a first word is spread.
CHUNK_BYTES, SHARD_TOKENS, HOT = 16 << 20, 2_500_000, 2000
#: Discounts of pairs and triples.
DISCOUNTS = (0.75, 0.9)
ALPHA = 0.1
FOLDS = 10
_U = np.uint64
END, START = _U(0x5EED0FE2D0C5), _U(0x57A27)
_SECOND, _THIRD = _U(40), _U(32)
#: Values of a sequence that are packed at once.
_PACKED = 1 << 18
_STEP, _LEAST = 100.0, -30.0
_VALUES = np.concatenate(([0.0], 10 ** (np.arange(65535) / _STEP + _LEAST).clip(max=300)))
_SELECT = np.zeros((256, 8), np.int64)
for _b in range(256):
    for _k, _i in enumerate(i for i in range(8) if _b >> i & 1):
        _SELECT[_b, _k] = _i


def quantised(values: np.ndarray) -> np.ndarray:
    """Codes 1 to 65535 of positive values: their decimal logarithms to a hundredth. 0 is left for what a trie does not hold."""
    return (np.round((np.log10(values) - _LEAST) * _STEP) + 1).clip(1, 65535).astype(np.uint16)


def value_of(codes: np.ndarray) -> np.ndarray:
    """The values of codes; 0 for code 0."""
    return _VALUES[codes]


def mapped(values: np.ndarray) -> np.ndarray:
    """The array in a memory-mapped scratch file of this task; it goes when it is no longer used, and a task that is run again makes its own."""
    if not values.size:
        return np.ascontiguousarray(values)
    with tempfile.TemporaryFile() as file:
        np.ascontiguousarray(values).tofile(file)
        file.flush()
        return np.memmap(file, values.dtype, "r", shape=values.shape)


def _select(words_: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the set bit of each rank in each 64-bit word."""
    held = words_.view(np.uint8).reshape(-1, 8)
    count = np.bitwise_count(held)
    upto = np.cumsum(count, axis=1, dtype=np.uint8)
    byte = (upto <= rank[:, None]).sum(axis=1)
    row = np.arange(len(rank))
    return 8 * byte + _SELECT[held[row, byte], rank - (upto[row, byte] - count[row, byte])]


class EliasFano:
    """A sequence of 64-bit values that never falls: low bits packed, high bits in unary."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.bits = max(0, (top // max(1, self.n)).bit_length() - 1)
        packed = np.zeros(self.n * self.bits // 64 + 2, _U)
        n_words = ((top >> self.bits) + self.n - 1) // 64 + 2 if self.n else 1
        flags = np.zeros(n_words * 64, np.uint8)
        for i in range(0, self.n, _PACKED):
            own = values[i : i + _PACKED]
            at = np.arange(i, i + len(own), dtype=np.int64)
            flags[(own >> _U(self.bits)).astype(np.int64) + at] = 1
            if self.bits:
                low, at = own & _U((1 << self.bits) - 1), at * self.bits
                word, shift = at >> 6, (at & 63).astype(_U)
                first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
                packed[word[first]] |= np.bitwise_or.reduceat(low << shift, first)
                over = np.flatnonzero((at & 63) + self.bits > 64)
                packed[word[over] + 1] |= low[over] >> (_U(64) - shift[over])
        self.low = mapped(packed)
        self.high = mapped(np.packbits(flags, bitorder="little").view("<u8"))
        del packed, flags
        before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.high), dtype=np.int64)))
        self.before = mapped(before)
        self.zeros = mapped(64 * np.arange(len(before), dtype=np.int64) - before)

    def _low(self, at: np.ndarray) -> np.ndarray:
        bit = at * self.bits
        word, shift = bit >> 6, (bit & 63).astype(_U)
        spill = np.where(shift > 0, self.low[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
        return ((self.low[word] >> shift) | spill) & _U((1 << self.bits) - 1)

    def access(self, at: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, at, side="right") - 1
        place = word * 64 + _select(self.high[word], at - self.before[word])
        return ((place - at).astype(_U) << _U(self.bits)) | self._low(at)

    def _upto(self, bucket: np.ndarray) -> np.ndarray:
        """How many values have a high part of at most ``bucket``."""
        inside = bucket < self.zeros[-1]
        rank = np.where(inside, bucket, 0)
        word = np.searchsorted(self.zeros, rank, side="right") - 1
        return np.where(inside, word * 64 + _select(~self.high[word], rank - self.zeros[word]) - rank, self.n)

    def _search(self, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each value, the first place in [low, high) that holds it or more, high where none does; the end of the places with its high bits; its low bits."""
        bucket = np.minimum(values >> _U(self.bits), _U(1 << 62)).astype(np.int64)
        begin = np.where(bucket > 0, self._upto(np.maximum(bucket, 1) - 1), 0)
        end = np.clip(self._upto(bucket), low, high)
        at, stop = np.clip(begin, low, high), end.copy()
        rest = values & _U((1 << self.bits) - 1)
        open_ = np.flatnonzero(at < stop)
        while len(open_):
            mid = (at[open_] + stop[open_]) >> 1
            less = self._low(mid) < rest[open_]
            at[open_[less]] = mid[less] + 1
            stop[open_[~less]] = mid[~less]
            open_ = open_[at[open_] < stop[open_]]
        return at, end, rest

    def successor(self, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self._search(values, low, high)[0]

    def find(self, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of each value in [low, high), or -1. A successor among the places with the value's high bits is the value if its low bits are."""
        out = np.full(len(values), -1)
        if self.n and len(values):
            at, end, rest = self._search(values, low, high)
            inside = np.flatnonzero(at < end)
            same = self._low(at[inside]) == rest[inside]
            out[inside[same]] = at[inside[same]]
        return out

    def place(self, values: np.ndarray) -> np.ndarray:
        return self.find(values, np.zeros(len(values), np.int64), np.full(len(values), self.n))


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values begin, and their lengths."""
    begin = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(values)))


def _places(n: int) -> type:
    """The short type that holds places among ``n``."""
    return np.int32 if n < 1 << 31 else np.int64


def _counted(keys: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys that are counted at all, rising, and their counts added up; where the counted keys stand, in their order, and the length of each run of equal ones."""
    held = np.flatnonzero(count > 0).astype(_places(len(keys)))
    own = keys[held]
    order = np.argsort(own)
    own, held = own[order], held[order]
    del order
    begin, many = _runs(own)
    return own[begin], np.add.reduceat(count[held], begin, dtype=np.int64) if len(begin) else np.zeros(0, np.int64), held, many


def _summed(keys: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys that are counted at all, rising, and their counts added up."""
    return _counted(keys, count)[:2]


def _placed(keys: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_summed``, and the place of each given key among them; 0 for keys not counted."""
    distinct, total, held, many = _counted(keys, count)
    place = np.zeros(len(keys), held.dtype)
    place[held] = np.repeat(np.arange(len(distinct), dtype=held.dtype), many)
    return distinct, total, place


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, rising, and the place of each value among them; at its peak in less memory than ``np.unique``."""
    order = np.argsort(values)
    own = values[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = own[1:] != own[:-1]
    own = own[fresh]
    place = np.empty(len(order), _places(len(order)))
    place[order] = np.cumsum(fresh, dtype=place.dtype) - place.dtype.type(1)
    return own, place


class Told:
    """What chunks tell a shard and ask of it: words, contexts, the ``pairs`` successors of each context in turn, and the ``triples`` successors of each pair in turn, with counts."""

    FIELDS = ("word", "n_word", "context", "pairs", "second", "n_second", "triples", "third", "n_third")

    def __init__(self, *parts: np.ndarray):
        for name, part in zip(self.FIELDS, parts):
            setattr(self, name, part)

    @staticmethod
    def together(rows: list[Told]) -> Told:
        """All rows as one. The rows become views of it, so that what they hold is held once."""
        whole = Told()
        for f in Told.FIELDS:
            parts = [getattr(r, f) for r in rows]
            held = np.concatenate(parts)
            setattr(whole, f, held)
            for r, part in zip(rows, np.split(held, np.cumsum([len(p) for p in parts])[:-1])):
                setattr(r, f, part)
        return whole


class Trie:
    """Words, successors and successors of pairs. Contexts may come in any order and repeat; counts of equal n-grams add up.

    Of the contexts in ``hot`` a shard has only some successors: their discounted counts are held as they are, for others to divide, and ``totals`` says what they come to here.
    """

    def __init__(self, told: Told, discounts: tuple[float, float], hot: np.ndarray):
        words_, count = _summed(told.word, told.n_word)
        self.words, self.counts = EliasFano(words_), mapped(count)
        keys, rank = np.unique(told.context, return_inverse=True)
        pair, count, place = _placed(_under(rank, told.pairs, _SECOND, told.second), told.n_second)
        of = (pair >> _SECOND).astype(np.int64)
        kinds = np.bincount(of, minlength=len(keys))
        known = np.flatnonzero(kinds)
        total = np.bincount(of, weights=count, minlength=len(keys))[known]
        keys, kinds = keys[known], kinds[known]
        of = np.repeat(np.arange(len(known)), kinds)
        shared = np.isin(keys, hot)
        self.totals = keys[shared], total[shared].astype(np.int64), kinds[shared]
        self.contexts = EliasFano(keys)
        self.pointers = EliasFano(np.concatenate(([0], np.cumsum(kinds))).astype(_U))
        self.seconds = EliasFano((of.astype(_U) << _SECOND) | (pair & _U((1 << 40) - 1)))
        self.weights = mapped(quantised(np.where(shared, 1.0, discounts[0] * kinds / total)))
        self.chances = mapped(quantised((count - discounts[0]) / np.where(shared, 1.0, total)[of]))
        triple, count = _summed(_under(place, told.triples, _THIRD, told.third), told.n_third)
        del place
        of = (triple >> _THIRD).astype(np.int64)
        kinds = np.bincount(of, minlength=len(pair))
        total = np.bincount(of, weights=count, minlength=len(pair))
        self.pair_pointers = EliasFano(np.concatenate(([0], np.cumsum(kinds))).astype(_U))
        self.thirds = EliasFano(triple)
        inner = np.zeros(len(pair), np.uint16)
        inner[kinds > 0] = quantised(discounts[1] * kinds[kinds > 0] / total[kinds > 0])
        self.pair_weights, self.pair_chances = mapped(inner), mapped(quantised((count - discounts[1]) / total[of]))

    def answer(self, asked: Told) -> tuple[np.ndarray, ...]:
        """Counts of the words, and codes: weights of the contexts, probabilities and weights of the pairs, probabilities of the triples; 0 for what is not held."""
        at = self.words.place(asked.word)
        counts = np.zeros(len(at), np.int64)
        counts[at >= 0] = self.counts[at[at >= 0]]
        rank = self.contexts.place(asked.context)
        pair = _children(rank, asked.pairs, asked.second, self.pointers, self.seconds, _SECOND)
        triple = _children(pair, asked.triples, asked.third, self.pair_pointers, self.thirds, _THIRD)
        return counts, _codes(self.weights, rank), _codes(self.chances, pair), _codes(self.pair_weights, pair), _codes(self.pair_chances, triple)


def _under(parent: np.ndarray, many: np.ndarray, shift: np.uint64, child: np.ndarray) -> np.ndarray:
    """The children, ``many`` of each parent in turn, below the number of their parent."""
    out = np.repeat(parent.astype(_U) << shift, many)
    out |= child
    return out


def _children(parent: np.ndarray, many: np.ndarray, child: np.ndarray, pointers: EliasFano, nodes: EliasFano, shift: np.uint64) -> np.ndarray:
    """Where the asked children of each parent stand, ``many`` of each in turn; -1 where parent or child is not held."""
    out = np.full(len(child), -1)
    held = np.flatnonzero(parent >= 0)
    if len(held):
        low, high = (pointers.access(parent[held] + d).astype(np.int64) for d in (0, 1))
        spread = lambda values: np.repeat(values, many[held])
        mine = np.flatnonzero(np.repeat(parent >= 0, many))
        out[mine] = nodes.find((spread(parent[held]).astype(_U) << shift) | child[mine], spread(low), spread(high))
    return out


def _codes(held: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.uint16)
    out[at >= 0] = held[at[at >= 0]]
    return out


class Chunk:
    """Some encoded documents: word hashes, and the texts as places in them, each text closed by the end.

    Pairs are (context, last) and triples (pair, last), in rising order; ``pair_of`` and ``triple_of`` say which ends at each token. The context one more than there are words is
    the start of a text, whose first token ends no triple.
    """

    def __init__(self, vocabulary: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, train: np.ndarray):
        self.vocabulary, self.tokens, self.lengths, self.train = vocabulary, tokens, lengths, train
        self.begin = np.cumsum(lengths) - lengths
        n = len(vocabulary)
        trained = np.repeat(train, lengths)
        self.n_word = np.bincount(tokens[trained], minlength=n)
        before = np.concatenate((tokens[:1], tokens[:-1])).astype(np.int64)
        before[self.begin] = n
        before *= n
        before += tokens
        pair, self.pair_of = _distinct(before)
        del before
        self.context, self.second = (x.astype(np.int32) for x in np.divmod(pair, n))
        self.n_second = np.bincount(self.pair_of[trained], minlength=len(pair)).astype(np.int32)
        inner = np.ones(len(tokens), bool)
        inner[self.begin] = False
        self.inner = np.flatnonzero(inner).astype(np.int32)
        after = self.pair_of[self.inner - 1].astype(np.int64)
        after *= n
        after += tokens[self.inner]
        triple, self.triple_of = _distinct(after)
        del after
        self.pair, self.third = (x.astype(np.int32) for x in np.divmod(triple, n))
        self.n_third = np.bincount(self.triple_of[trained[self.inner]], minlength=len(triple)).astype(np.int32)

    def context_hashes(self) -> np.ndarray:
        """48 bits of each context."""
        return mix(np.append(self.vocabulary, START)) >> _U(16)

    def dealt(self, shards: int, hot: np.ndarray) -> list[list[np.ndarray]]:
        """The words, pairs and triples that each shard is asked for, by their places."""
        spread = mix(np.append(self.vocabulary, START) + _U(7)) % _U(shards)
        of_word = spread[:-1].astype(np.int32)
        of_pair = np.where(np.isin(self.context_hashes(), hot)[self.context], of_word[self.second], spread.astype(np.int32)[self.context])
        small = np.min_scalar_type(shards)  # short numbers are sorted by their digits
        cut = lambda of: np.split(np.argsort(of.astype(small), kind="stable"), np.cumsum(np.bincount(of, minlength=shards))[:-1])
        return [cut(of_word), cut(of_pair), cut(of_pair[self.pair])]

    def told(self, words_: np.ndarray, pairs: np.ndarray, triples: np.ndarray) -> tuple[np.ndarray, ...]:
        """The fields of ``Told`` for a shard's words, pairs and triples."""
        successor = mix(self.vocabulary)
        begin, many = _runs(self.context[pairs])
        follow = np.bincount(np.searchsorted(pairs, self.pair[triples]), minlength=len(pairs))
        return self.vocabulary[words_], self.n_word[words_], self.context_hashes()[self.context[pairs][begin]], many, successor[self.second[pairs]] >> _U(24), self.n_second[pairs], follow, (successor[self.third[triples]] & _U((1 << 32) - 1)), self.n_third[triples]


def _bytes_of(values: np.ndarray, size: int) -> bytes:
    """The ``size`` low bytes of each value."""
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _from_bytes(data: bytes, size: int) -> np.ndarray:
    if size in (4, 8):
        return np.frombuffer(data, f"<u{size}")
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel()


_ZSTD = pa.Codec("zstd", compression_level=1)


def _pack(values: np.ndarray, size: int = 4) -> bytes:
    """Small numbers (of 4 bytes: below 2^31), byte by byte of their places, compressed; the number of bytes stands before."""
    planes = np.ascontiguousarray(values.astype(f"<u{size}")).view(np.uint8).reshape(-1, size).T
    data = np.ascontiguousarray(planes).tobytes()
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True) if data else b""


def _unpack(data: bytes, size: int = 4) -> np.ndarray:
    plain = _ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True) if data else b""
    planes = np.frombuffer(plain, np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view("<i4" if size == 4 else f"<u{size}").ravel()


#: How the fields of ``Told`` travel: whole bytes of hashes, or packed numbers.
_SIZES = {"word": 8, "context": 6, "second": 5, "third": 4}
_CHUNK = "chunk long, n_train long, n_tokens long, heavy array<long>, vocabulary binary, tokens binary, lengths binary, train binary, doc_ids array<long>"
_ASK = "shard int, chunk long, " + ", ".join(f"{f} binary" for f in Told.FIELDS)
_ANSWER = "shard int, chunk long, known long, hot array<long>, n_hot array<long>, kinds_hot array<long>, counts binary, weights binary, chances binary, pair_weights binary, pair_chances binary"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _row(shape: str, values: list) -> pa.RecordBatch:
    """One row of a Spark schema."""
    names, kinds = zip(*(c.split() for c in shape.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array([v], _ARROW[k]) for v, k in zip(values, kinds)], list(names))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = itertools.count(TaskContext.get().partitionId() << 24)
    ids: list[int | None] = []
    texts: list[bytes] = []

    def close() -> pa.RecordBatch:
        hashes, lengths = [], []
        for i, j in slices(texts):
            w = words(texts[i:j], lower=True)
            hashes.append(np.insert(w.hash, w.first[1:], END))
            lengths.append(np.diff(w.first) + 1)
            del w
        held = np.concatenate(hashes)
        hashes.clear()
        vocabulary, tokens = _distinct(held)
        del held
        count = np.bincount(tokens, minlength=len(vocabulary))
        order = np.argsort(-count, kind="stable")  # small numbers for common words
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        length = np.concatenate(lengths)
        train = np.array([crc_fold(i, FOLDS) != 0 for i in ids])
        heavy = mix(vocabulary[count * HOT >= len(tokens)]) >> _U(16)
        row = [next(number), int(length[train].sum()), len(tokens), heavy.view(np.int64).tolist(), vocabulary[order].tobytes(), _pack(place[tokens]), _pack(length), np.packbits(train).tobytes(), list(ids)]
        ids.clear()
        texts.clear()
        give_back()
        return _row(_CHUNK, row)

    held = 0
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), text_bytes(batch["text"])):
            ids.append(doc_id)
            texts.append(text)
            held += len(text)
            if held >= CHUNK_BYTES:
                yield close()
                held = 0
    if ids:
        yield close()


def _chunk(vocabulary: bytes, tokens: bytes, lengths: bytes, train: bytes) -> Chunk:
    length = _unpack(lengths).astype(np.int64)
    return Chunk(np.frombuffer(vocabulary, _U), _unpack(tokens), length, np.unpackbits(np.frombuffer(train, np.uint8), count=len(length)).astype(bool))


def _asks(shards: int, hot: np.ndarray):
    """One packed row for each chunk and shard."""

    def rows(name: int, *parts: bytes) -> Iterator[pa.RecordBatch]:
        c = _chunk(*parts)
        for shard, places in enumerate(zip(*c.dealt(shards, hot))):
            fields = zip(Told.FIELDS, c.told(*places))
            yield _row(_ASK, [shard, name, *(_bytes_of(v, _SIZES[f]) if f in _SIZES else _pack(v) for f, v in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                yield from rows(*(batch[c][at].as_py() for c in ("chunk", "vocabulary", "tokens", "lengths", "train")))
                give_back()

    return run


def _answers(discounts: tuple[float, float], hot: np.ndarray):
    """A row for each that asked; ``known`` of a shard's first row is its number of words in training text, and with it come its parts of hot contexts."""

    def close(shard: int, chunks: list[int], rows: list[Told]) -> Iterator[pa.RecordBatch]:
        trie = Trie(Told.together(rows), discounts, hot)
        keys, total, kinds = trie.totals
        for n, (chunk, row) in enumerate(zip(chunks, rows)):
            extra = [trie.words.n, keys.view(np.int64).tolist(), total.tolist(), kinds.tolist()] if not n else [0, [], [], []]
            counts, *codes = trie.answer(row)
            yield _row(_ANSWER, [shard, chunk, *extra, _pack(counts), *(_pack(c, 2) for c in codes)])
        del trie, row
        rows.clear()
        give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, chunks, rows = None, [], []
        for batch in batches:
            for at in range(batch.num_rows):
                own, chunk, *row = (c[at].as_py() for c in batch.columns)
                if own != shard:
                    if rows:
                        yield from close(shard, chunks, rows)
                    shard, chunks, rows = own, [], []
                chunks.append(chunk)
                rows.append(Told(*(_from_bytes(v, _SIZES[f]) if f in _SIZES else _unpack(v) for f, v in zip(Told.FIELDS, row))))
        if rows:
            yield from close(shard, chunks, rows)

    return run


def _scores(shards: int, hot: np.ndarray, totals: dict[int, tuple[int, int]], n_train: int, n_known: int, discount: float):
    """Scores of the documents of each chunk, from rows sorted by chunk and shard; a chunk itself comes as shard -1."""
    base_total = n_train + ALPHA * (n_known + 1)

    def close(head: list, answers: list[list]) -> pa.RecordBatch:
        c = _chunk(*head[:4])
        dealt = c.dealt(shards, hot)
        count, weight, total = np.zeros(len(c.vocabulary), np.int64), np.zeros(len(c.vocabulary) + 1), np.ones(len(c.vocabulary) + 1)
        chance, pair_weight, pair_chance = (np.zeros(n, np.float32) for n in (len(c.second), len(c.second), len(c.third)))
        for shard, counts, *codes in answers:
            words_, pairs, triples = (places[shard] for places in dealt)
            count[words_] = _unpack(counts)
            of_context, of_pair, of_inner, of_triple = (value_of(_unpack(x, 2)) for x in codes)
            context = c.context[pairs]
            weight[context[_runs(context)[0]]] = of_context
            chance[pairs], pair_weight[pairs], pair_chance[triples] = of_pair, of_inner, of_triple
        hashes = c.context_hashes()
        for i in np.flatnonzero(np.isin(hashes, hot)):  # at most as many as there are hot contexts
            n, kinds = totals.get(int(hashes[i]), (0, 0))
            total[i], weight[i] = max(n, 1), discount * kinds / max(n, 1)
        word = (count + ALPHA) / base_total
        two = np.where(weight[c.context] > 0, chance / total[c.context] + weight[c.context] * word[c.second], word[c.second])
        shorter = np.zeros(len(c.third), np.int32)
        shorter[c.triple_of] = c.pair_of[c.inner]
        three = np.where(pair_weight[c.pair] > 0, pair_chance + pair_weight[c.pair] * two[shorter], two[shorter])
        of_token = two[c.pair_of]
        of_token[c.inner] = three[c.triple_of]
        add = lambda values: np.add.reduceat(values, c.begin)
        cols = [pa.array(head[4], pa.int64()), pa.array(~c.train), pa.array(c.lengths), pa.array(add((count[c.tokens] > 0).astype(np.int64))), pa.array(np.full(len(c.begin), n_train)), pa.array(add(np.log10(word)[c.tokens])), pa.array(add(np.log10(of_token)))]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, answers = None, []
        for batch in batches:
            for at in range(batch.num_rows):
                row = [c[at].as_py() for c in batch.columns]
                if row[1] < 0:
                    if head:
                        yield close(head, answers)
                        give_back()
                    head, answers = row[2:7], []
                else:
                    answers.append([row[1], *row[7:]])
        if head:
            yield close(head, answers)
        give_back()

    return run


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Trained on the documents whose id's crc32 modulo 10 is not 0. A null or empty text is its end alone. A null
    id counts as an empty one, and so is held out. Repeated rows train and are scored each. An empty table gives an empty result; other columns are ignored.
    """
    chunks = checkpointed(id_text(docs, id_col, text_col).mapInArrow(_encode, _CHUNK))
    n_train, n_tokens = chunks.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_train", "n_tokens"))).first()
    heavy = chunks.select(F.explode("heavy").alias("context")).groupBy("context").count().orderBy(F.desc("count"), "context").limit(2 * HOT)
    hot = np.append(np.array([r.context for r in heavy.collect()], np.int64).view(_U), mix(np.array([START])) >> _U(16))
    shards = max(4, n_tokens // SHARD_TOKENS)
    asks = chunks.mapInArrow(_asks(shards, hot), _ASK)
    told = checkpointed(asks.repartition("shard").sortWithinPartitions("shard", "chunk").mapInArrow(_answers(DISCOUNTS, hot), _ANSWER))
    n_known = told.agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    parts = told.where(F.size("hot") > 0).select(F.explode(F.arrays_zip("hot", "n_hot", "kinds_hot")).alias("h")).groupBy("h.hot").agg(F.sum("h.n_hot").alias("n"), F.sum("h.kinds_hot").alias("kinds"))
    totals = {r.hot % 2**64: (r.n, r.kinds) for r in parts.collect()}  # at most as many as ``hot``
    codes = ["counts", "weights", "chances", "pair_weights", "pair_chances"]
    own = ["vocabulary", "tokens", "lengths", "train", "doc_ids"]
    heads = chunks.select("chunk", F.lit(-1).alias("shard"), *own)
    both = heads.unionByName(told.select("chunk", "shard", *codes), allowMissingColumns=True).select("chunk", "shard", *own, *codes)
    dealt = both.repartition("chunk").sortWithinPartitions("chunk", "shard")
    return dealt.mapInArrow(_scores(shards, hot, totals, n_train, n_known, DISCOUNTS[0]), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
