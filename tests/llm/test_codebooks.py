import hashlib
import math
import random

import numpy as np
import pytest
from conftest_data import table
from impactrank.llm import codebooks as C
from impactrank.llm.queries import ORACLES, QUERIES
from oracle import oracle_rows, rows_of

SCHEMA = "vec_id long, embedding array<double>, label string, vector string, n long, code string"


def plain(rows):
    """Codes of (id, vector, label) rows by looking at every entry, in Python's own integers."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) and abs(x) < 65536 for x in v)]
    if not kept:
        return [], None
    width = -(-max([1, *(len(v) for _, v, _ in kept)]) // 8)
    parts = []
    for _, v, _ in kept:
        own = [math.floor(4096 * x) for x in v] + [0] * (8 * width - len(v))
        parts.append([own[j * width : (j + 1) * width] for j in range(8)])
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:16]
    codes, errors, final = [""] * len(kept), [0] * len(kept), []
    for j in range(8):
        book = [parts[r][j] for r in first]
        pick = lambda p, book: min((sum((a - b) ** 2 for a, b in zip(p, c)), e) for e, c in enumerate(book))
        for _ in range(6):
            at = [pick(p[j], book)[1] for p in parts]
            groups = [[p[j] for p, a in zip(parts, at) if a == e] for e in range(len(book))]
            book = [[sum(c) // len(g) for c in zip(*g)] if g else book[e] for e, g in enumerate(groups)]
        for r, p in enumerate(parts):
            square, e = pick(p[j], book)
            codes[r] += f"{e:02x}"
            errors[r] += square
        final += [str(x) for c in book for x in c]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    sha = hashlib.sha256(",".join(final).encode()).hexdigest()
    return sorted(((i, c, e, by_label[label], sha) for (i, _, label), c, e in zip(kept, codes, errors)), key=repr), sha


def found(spark, rows):
    frame = spark.createDataFrame([(i, v, label, None, None, None) for i, v, label in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in C.compress(frame).collect()), key=repr)


@pytest.mark.parametrize("hot", [1, 10**6])
def test_odd_rows_equal_a_plain_search(spark, monkeypatch, hot):
    """Ties, repeats, null labels and ids, vectors of other lengths; labels by broadcast and by shuffle."""
    monkeypatch.setattr(C, "HOT_SHARE", hot)
    chance = random.Random(4)
    rows = [(i, [chance.choice([-0.5, 0.25, 0.3, 0.0]) for _ in range(20)], chance.choice(["a", "b", None])) for i in range(60, 0, -1)]
    rows += [(1, None, "a"), (2, [None] * 20, "a"), (3, [math.nan] * 20, "b"), (4, [math.inf] + [0.0] * 19, "b"), (5, [1e9] * 20, "c"), (6, [], "c"), (7, [0.1] * 3, None), (8, [0.7] * 17, "d")]
    rows += [(9, [-0.0001] * 20, "hot")] * 40 + [(None, [0.9] * 20, None)] * 2 + [(10, [30000.5, -65535.9] * 10, "far")]
    assert found(spark, rows) == plain(rows)[0]


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_rows(spark, n):
    rows = [(i, [float(i), -1.0] * 8, "x") for i in range(n)]
    assert found(spark, rows) == plain(rows)[0]


def test_nothing_usable(spark):
    assert found(spark, [(1, None, "a"), (2, [None], "b")]) == []


@pytest.mark.parametrize("spread", [2, 40, 10**8])
def test_tree_equals_a_look_at_every_entry(spread):
    """Many equal entries and distances, and distances near the largest."""
    chance = np.random.default_rng(spread)
    for _ in range(20):
        book = chance.integers(-spread, spread, (chance.integers(1, 33), 3))
        points = np.concatenate((chance.integers(-spread, spread, (200, 3)), book, book + 1))
        entry, square = C.nearest(book, C.vantage_tree(book), points)
        want = ((points[:, None] - book[None]) ** 2).sum(2)
        assert (entry == want.argmin(1)).all() and (square == want.min(1)).all()


def test_tree_leaves_branches_out():
    chance = np.random.default_rng(0)
    book = chance.normal(0, 1, (16, 8)) * 40 + np.repeat(np.eye(8), 2, 0) * 4000
    looked = []

    class Book(np.ndarray):
        def __getitem__(self, at):
            looked.append(at)
            return np.asarray(super().__getitem__(at))

    book = book.astype(np.int64)
    tree = C.vantage_tree(book)
    for point in book:
        C.nearest(book.view(Book), tree, point[None])
    assert len(looked) < 0.7 * 16 * 16


def test_given_vectors_equal_sql_and_a_plain_search(spark, sf_dir):
    got = QUERIES["op12_vector_codes"](spark, sf_dir)
    assert rows_of(got) == oracle_rows(sf_dir, ORACLES["op12_vector_codes"])
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table(sf_dir, "embeddings")]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)[0]
