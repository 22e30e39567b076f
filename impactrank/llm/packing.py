"""Sum-of-squares packing of tokenised documents into fixed-length training sequences.

Pieces are dealt out in blocks of bounded size, and each block is packed by itself: a piece goes
where the sum over all residual gaps of the squared number of open bins with that gap becomes
smallest. The bins that a block leaves open are pieces of the next round, over far fewer blocks,
until one block is left. So no task and no driver sees more than a block.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, id_text, lean, slices, text_bytes

TOKENIZER = "word_bpe_49k.json"
EOS = 1
#: Pieces that one task packs.
BLOCK = 50_000
#: Words whose ids a Python worker remembers; as many again from before the last clearing.
REMEMBERED = 300_000
#: Bytes of text whose distinct words are looked up together; more of them repeat in more text.
TOGETHER = 1 << 21


def _tokenizer_path(path: str | None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path(TOKENIZER)


def read(text: bytes) -> str:
    """The characters of a text; bytes that are no UTF-8 count as replacement characters."""
    return text.decode("utf-8", "replace")


class Remembered(dict):
    """A bounded memory of two generations: what is asked for again outlives a clearing."""

    old: dict = {}

    def __missing__(self, key):
        value = self[key] = self.old[key]
        return value

    def unknown(self, keys: Iterable) -> list:
        """Those that are not remembered; the others are from now on of the young generation."""
        out, old = [], self.old.get
        for key in keys:
            if key not in self:
                value = old(key)
                if value is None:
                    out.append(key)
                else:
                    self[key] = value
        return out

    def make_room(self) -> None:
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()


class WordIds:
    """Ids of whole texts from remembered ids of their words and of the tokens' pre-tokens.

    The tokenizer lower-cases, drops white space and never joins characters across it, so the ids of
    a text are those of its words in turn, and those of a word are those of its letter runs,
    digits and symbol runs. Words beyond Latin letters, and texts that may hold a special token, go to it whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.parts = Tokenizer.from_file(path), Remembered(), Remembered()
        self.odd = regex.compile(r"[^\n\x21-\x7e\u00a1-\u024f]").search
        self.cut = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        """Ids by the tokenizer itself."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, new: list[bytes]) -> None:
        """Remember the ids of words of lower-case ASCII and any other letters."""
        text = read(b"\n".join(new))
        if self.odd(text):
            strange = {w for w in new if self.odd(read(w))}
            for word in strange:
                self.words[word] = self.whole(read(word))
            new = [w for w in new if w not in strange]
            text = read(b"\n".join(new))
        if not new:
            return
        parts = self.cut(text.lower())  # in these scripts nothing is left to compose
        self.parts["\n"] = b""
        missing = self.parts.unknown(set(parts))
        if missing:
            ids = np.array(self.tokenizer.encode(" ".join(missing), add_special_tokens=False).ids, "<u4")
            stops = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            self.parts.update(zip(missing, _cut(ids.tobytes(), stops)))
            if len(stops) != len(missing):  # a vocabulary without ends of words: each by itself
                self.parts.update((name, self.whole(name)) for name in missing)
        held = list(map(self.parts.__getitem__, parts))
        stops = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)))
        between = np.fromiter(map("\n".__eq__, parts), bool, len(parts))
        self.words.update(zip(new, _cut(b"".join(held), np.append(stops[between], stops[-1]))))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text.

        Arrow splits the texts, tells their distinct words and puts the words' ids in place; Python handles a distinct word once.
        """
        if not texts:
            return []
        special = [b"<|" in t for t in texts]
        plain = pa.array([b"" if s else t.lower() for t, s in zip(texts, special)], pa.binary())
        split = pc.ascii_split_whitespace(plain.view(pa.string()))  # bytes that are no UTF-8 stay as they are
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.view(pa.binary())
        seen = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct), pa.scalar(b"\n", pa.binary()))[0].as_py().split(b"\n")
        self.words.make_room()
        self.parts.make_room()
        self.words[b""] = b""  # before a text's first word and after its last
        self.learn(self.words.unknown(seen))
        ids = pa.array(list(map(self.words.__getitem__, seen)), pa.large_binary()).take(coded.indices)
        _, ends, data = ids.buffers()
        ends = np.frombuffer(ends, np.int64)[np.asarray(split.offsets)]
        data = memoryview(data or b"")
        return [self.whole(read(t)) if s else data[i:j].tobytes() for t, s, i, j in zip(texts, special, ends[:-1].tolist(), ends[1:].tolist())]


def _cut(data: bytes, stops: np.ndarray) -> Iterator[bytes]:
    """The pieces of ``data`` that end at ``stops``."""
    at = 0
    for stop in stops.tolist():
        yield data[at:stop]
        at = stop


_LOADED: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def cut_pieces(docs: DataFrame, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and the end id, cut only where longer than ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(_tokenizer_path(tokenizer))
        end = np.array([EOS], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            names, texts = batch["doc_id"].to_pylist(), text_bytes(batch["text"])
            for low, high in slices(texts, TOGETHER):
                for doc_id, ids in zip(names[low:high], own.encode(texts[low:high])):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        out.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece), piece if keep_ids else None))
            cols = list(zip(*out)) if out else [[]] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            heads = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if keep_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:n], types)], heads[:n])

    return id_text(docs, id_col, text_col).mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def pack_block(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece and the fill of each bin; every size is 1 to ``capacity``.

    Pieces come by falling size. Of all open bins that can hold a piece, and a new one only where
    none can, it takes the gap that makes the sum of squares smallest; the narrowest gap on ties.
    """
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fill: list[int] = []
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        # into gap g: N(g)^2 falls by 2 N(g) - 1 and N(g - size)^2 rises by 2 N(g - size) + 1; a full bin counts no more
        change = 2 * count[: capacity + 1 - size]
        change[0] = -1
        change -= 2 * count[size:]
        gaps = np.flatnonzero(count[size:])
        if len(gaps):
            gap = int(gaps[np.argmin(change[gaps])]) + size
            own = open_bins[gap].pop()
            count[gap] -= 1
        else:
            own, gap = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = own, fill[own]
        fill[own] += size
        if gap > size:
            count[gap - size] += 1
            open_bins[gap - size].append(own)
    return bins, offsets, np.array(fill, np.int64)


def _block_packer(capacity: int, base: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Packs the items of one block; ``base`` keeps the bins of the rounds apart."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "item"], ascending=[False, True])
        bins, offsets, fill = pack_block(part["size"].to_numpy(), capacity)
        own = base + (int(part["block"].iloc[0]) << 24) + bins
        return pd.DataFrame({"item": part["item"].to_numpy(), "bin": own, "at": offsets, "filled": fill[bins]})

    return run


def pack(pieces: DataFrame, capacity: int = 4096, block: int = BLOCK) -> DataFrame:
    """The pieces with (sequence_id, offset). ``pieces`` has ``length`` from 1 to ``capacity``; other columns stay."""
    whole = checkpointed(pieces.withColumn("_id", F.monotonically_increasing_id()))
    items = whole.select(F.col("_id").alias("item"), F.col("length").alias("size"))
    rounds: list[DataFrame] = []
    n, level = items.count(), 0
    while n:
        blocks = max(1, -(-n // block))
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(blocks)))
        placed = checkpointed(dealt.groupBy("block").applyInPandas(_block_packer(capacity, level << 59), "item long, bin long, at long, filled long"))
        rounds.append(placed)
        if blocks == 1:
            break
        items = placed.where(F.col("filled") < capacity).groupBy("bin").agg(F.first("filled").alias("size")).withColumnRenamed("bin", "item")
        left = items.count()
        if left > 0.9 * n:
            break
        n, level = left, level + 1
    if not rounds:
        return whole.drop("_id").withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    top = rounds[-1].select("item", "bin", "at")
    for lower in reversed(rounds[:-1]):
        up = top.select(F.col("item").alias("bin"), F.col("bin").alias("bin_up"), F.col("at").alias("at_up"))
        top = lower.join(up, "bin", "left").select("item", F.coalesce("bin_up", "bin").alias("bin"), (F.col("at") + F.coalesce("at_up", F.lit(0))).alias("at"))
    return whole.join(top, whole._id == top.item).drop("_id", "item").withColumnsRenamed({"bin": "sequence_id", "at": "offset"})


def pack_documents(docs: DataFrame, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, block: int = BLOCK, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset), a row per piece.

    A null or empty text is the end id alone. Bytes that are no UTF-8 are read as replacement characters. Repeated rows are packed each by itself, ids and
    null ids as they come. An empty table gives an empty result. Other columns are ignored.
    """
    return pack(cut_pieces(docs, capacity, id_col, text_col, tokenizer, keep_ids), capacity, block)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) of pieces that were packed with their ids: little-endian 32-bit ids, at most a capacity of them."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
