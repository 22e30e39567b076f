"""Vector code compression: product codes over integer vectors, exact to the last bit.

A vector's components become integers and its parts are coded apart, each by a codebook of its own. A part finds its nearest entry in a
vantage-point tree over the entries: triangle bounds, with radii rounded outwards, say which branches can't hold the nearest; branches
whose bound equals the best so far are visited too, so that ties go to the lower index; squared distances themselves are integers.

Every round is one pass: a task sums its parts by entry, and only the sums travel. Codebooks are all that the driver holds.

Odd input: rows whose vector is null or holds a null, NaN, infinite or out-of-range component (``RANGE`` or more in size, where integer
distances would overflow) are left out. Vectors shorter than the longest, or whose length is no multiple of the parts, count as filled
with zeros at the end. With fewer than 16 rows the codebooks have as many entries as there are rows. Null ids come last among the first
entries; rows that repeat an id count each, in the order of their vectors. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .vectors import matrix, usable, widest

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components of this size or more have no place: squares of their differences, summed, would leave 64 bits.
RANGE = 65536.0
#: Labels of at least this share of all rows are joined by broadcast: there are at most so many of them.
HOT_SHARE = 1000
_OUT, _IN = 1 + 2**-50, 1 - 2**-50


@dataclass
class Node:
    """A vantage point, an entry itself, and two branches with the least and largest distance of their entries from it."""

    entry: int
    near: Node | None = None
    far: Node | None = None
    near_ring: tuple[float, float] = (0.0, 0.0)
    far_ring: tuple[float, float] = (0.0, 0.0)


def vantage_tree(book: np.ndarray, entries: list[int] | None = None) -> Node | None:
    """A tree over the rows of ``book``. The vantage point is the entry farthest from the first one, so that distances from it spread."""
    entries = list(range(len(book))) if entries is None else entries
    if not entries:
        return None
    own = book[entries]
    at = int(np.argmax(((own - own[0]) ** 2).sum(1)))
    squares = ((own - own[at]) ** 2).sum(1)
    order = [int(i) for i in np.argsort(squares, kind="stable") if i != at]
    half = (len(order) + 1) // 2
    ring = lambda part: (float(np.sqrt(squares[part].min())) * _IN, float(np.sqrt(squares[part].max())) * _OUT) if part else (0.0, 0.0)
    near, far = order[:half], order[half:]
    return Node(entries[at], vantage_tree(book, [entries[i] for i in near]), vantage_tree(book, [entries[i] for i in far]), ring(near), ring(far))


def nearest(book: np.ndarray, tree: Node, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each point, the lowest index among equals, and its squared distance."""
    best = np.full(len(points), np.iinfo(np.int64).max)
    entry = np.full(len(points), len(book))

    def visit(node: Node | None, rows: np.ndarray, bound: np.ndarray | None = None) -> None:
        if bound is not None:
            rows = rows[bound <= np.sqrt(best[rows].astype(np.float64)) * _OUT]
        if node is None or not len(rows):
            return
        squares = ((points[rows] - book[node.entry]) ** 2).sum(1)
        better = (squares < best[rows]) | ((squares == best[rows]) & (node.entry < entry[rows]))
        best[rows[better]], entry[rows[better]] = squares[better], node.entry
        if node.near is None:
            return
        away = np.sqrt(squares.astype(np.float64))
        least, most = away * _IN, away * _OUT
        bounds = [np.maximum(least - high, low - most) for low, high in (node.near_ring, node.far_ring)]
        inside = away <= node.near_ring[1]
        visit(node.near, rows[inside], bounds[0][inside])
        visit(node.far, rows, bounds[1])
        visit(node.near, rows[~inside], bounds[0][~inside])

    visit(tree, np.arange(len(points)))
    return entry, best


def integers(column: pa.ListArray, width: int) -> np.ndarray:
    """(rows, parts, components of a part)."""
    return np.floor(matrix(column, width) * SCALE).astype(np.int64).reshape(len(column), PARTS, width // PARTS)


def _assigned(points: np.ndarray, books: np.ndarray, trees: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each row and part."""
    found = [nearest(books[j], trees[j], points[:, j]) for j in range(PARTS)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _next_books(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry replaced by the floor of the mean of its parts; unused ones stay."""
    size, width = books.shape[1], PARTS * books.shape[2]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [vantage_tree(book) for book in books]
        total, count = np.zeros((PARTS * size, width // PARTS), np.int64), np.zeros(PARTS * size, np.int64)
        for batch in batches:
            points = integers(batch["vector"], width)
            entry, _ = _assigned(points, books, trees)
            for j in range(PARTS):
                np.add.at(total, j * size + entry[:, j], points[:, j])
            count += np.bincount((entry + np.arange(PARTS) * size).ravel(), minlength=PARTS * size)
        cell, place = (x.ravel() for x in np.nonzero(np.broadcast_to(count[:, None], total.shape)))
        yield pa.RecordBatch.from_pydict({"cell": cell, "place": place, "total": total[cell, place], "n": count[cell]})

    summed = vectors.select("vector").mapInArrow(sums, "cell long, place long, total long, n long").groupBy("cell", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = books.copy()
    for r in summed.collect():  # at most one row a component of the codebooks
        out[r.cell // size, r.cell % size, r.place] = int(r.total) // r.n
    return out


def codebooks(vectors: DataFrame, width: int) -> np.ndarray:
    """(parts, entries, components of a part) after all rounds, from (vec_id, vector)."""
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).select("vector").collect()
    books = integers(pa.array([r.vector for r in first], pa.list_(pa.float64())), width).transpose(1, 0, 2)
    for _ in range(ROUNDS):
        books = _next_books(vectors, books)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable row."""
    rows = embeddings.select(embeddings[id_col].cast("long").alias("vec_id"), embeddings[vector_col].cast("array<double>").alias("vector"), embeddings[label_col].alias("label"))
    rows = rows.where(usable(F.col("vector"), RANGE))
    width = PARTS * max(1, -(-widest(rows) // PARTS))
    books = codebooks(rows.select("vec_id", "vector"), width)
    sha = digest(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [vantage_tree(book) for book in books]
        for batch in batches:
            entry, square = _assigned(integers(batch["vector"], width), books, trees)
            text = [row.tobytes().hex() for row in entry.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array(text, pa.string()), pa.array(square.sum(1))], names=["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    scored = checkpointed(rows.mapInArrow(coded, f"vec_id long, label {kind}, code string, error long"))
    return _with_label_error(scored).select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _with_label_error(scored: DataFrame) -> DataFrame:
    """Rows with the error of their label. Labels that hold a thousandth of the rows or more, at most a thousand, are broadcast, so no join deals out a hot one."""
    totals = checkpointed(scored.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    rows = totals.agg(F.sum("n")).first()[0] or 0
    hot = totals.withColumnRenamed("label", "of")
    often, seldom = hot.where(F.col("n") * HOT_SHARE >= rows).drop("n"), hot.where(F.col("n") * HOT_SHARE < rows).drop("n")
    same = F.col("label").eqNullSafe(F.col("of"))
    return scored.join(F.broadcast(often), same).unionByName(scored.join(F.broadcast(often.select("of")), same, "left_anti").join(seldom, same))
