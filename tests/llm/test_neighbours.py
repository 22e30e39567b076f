import math
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest_data import table
from impactrank.llm import neighbours as N
from impactrank.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, entry long, query long, ids string"


def plain(rows, k, every):
    """Neighbours of (id, vector) rows by looking at every other row."""
    kept = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = {}
    for q in {i for i, _ in kept if i % every == 0}:
        seen = [(-dot(v, w), j) for i, v in kept if i == q for j, w in kept if j != q]
        out[q] = [(j, -s) for s, j in sorted(seen)[:k]]
    return {q: hits for q, hits in out.items() if hits}


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, None, None, None) for i, v in rows], SCHEMA).repartition(3)


def same(a, b):
    assert a.keys() == b.keys()
    for q in a:
        assert [i for i, _ in a[q]] == [i for i, _ in b[q]] and np.allclose([s for _, s in a[q]], [s for _, s in b[q]], 1e-12, 1e-12)


def test_odd_rows_with_fewer_candidates_than_asked_for(spark):
    rows = [(0, [1.0, 0.0, 0.5]), (1, [0.5, 0.5, 0.5]), (2, [-3.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [math.nan, 1.0]), (6, [1.0, None]), (8, [math.inf, 1.0]), (10, []), (None, [1.0, 1.0, 1.0])]
    rows += [(12, [1.0, 0.0, 0.5]), (7, [1.0, 0.0, 0.5]), (7, [1.0, 0.0, 0.5]), (14, [1e-3, 0.0, 0.0]), (-2, [250.0, 1.0, 1.0]), (16, [2.0]), (16, [0.0, 4.0])]
    same(found(N.nearest_neighbours(frame(spark, rows), 20, 2).collect()), plain(rows, 20, 2))


def test_nothing_to_search(spark):
    assert N.nearest_neighbours(frame(spark, [])).count() == 0
    assert N.nearest_neighbours(frame(spark, [(0, None), (1, [0.0])])).count() == 0
    assert N.nearest_neighbours(frame(spark, [(1, [1.0]), (3, [2.0])]), 20, 2).count() == 0
    assert N.nearest_neighbours(frame(spark, [(2, [1.0])]), 20, 2).count() == 0


@pytest.mark.parametrize("part", [7, 16_384])
def test_all_within_the_radius_is_exact(spark, monkeypatch, part):
    """At a radius of all bits nothing is missed: vectors of many lengths, ties, a vector of many ids; one group and many."""
    monkeypatch.setattr(N, "RECALL", 1.0)
    monkeypatch.setattr(N, "PART", part)
    monkeypatch.setattr(N, "_learned", lambda *a, f=N._learned: (f(*a)[0], 64))
    chance = random.Random(1)
    rows = [(i, [chance.gauss(0, 1) * 10 ** chance.choice([-2, 0, 1]) for _ in range(5)]) for i in range(150)] + [(i, [1.0, 2.0, 3.0, 0.0, 0.0]) for i in range(150, 230)]
    rows += [(i, [chance.choice([0.0, 1.0]) for _ in range(5)]) for i in range(230, 300)]
    same(found(N.nearest_neighbours(frame(spark, rows), 6, 5).collect()), plain(rows, 6, 5))


def test_a_radius_too_small_is_widened(spark, monkeypatch):
    monkeypatch.setattr(N, "_learned", lambda *a, f=N._learned: (f(*a)[0], 4))
    chance = random.Random(2)
    rows = [(i, [chance.gauss(0, 1) for _ in range(8)]) for i in range(120)]
    got = found(N.nearest_neighbours(frame(spark, rows), 5, 10).collect())
    want = plain(rows, 5, 10)
    assert got.keys() == want.keys() and all(len(got[q]) == 5 for q in got)
    assert sum(i in {j for j, _ in want[q]} for q in got for i, _ in got[q]) >= 0.9 * 5 * len(want)


@pytest.mark.parametrize("radius", [4, 9, 23, 30, 50, 64])
def test_probing_finds_every_code_within_the_radius_once(radius, monkeypatch):
    chance = np.random.default_rng(radius)
    base = chance.integers(0, 2**63, 40, dtype=np.int64).astype(np.uint64)
    flips = np.array([sum(1 << int(b) for b in chance.choice(64, n, replace=False)) for n in chance.integers(0, 40, 900)], dtype=np.uint64)
    codes = np.concatenate((base, chance.choice(base, 900) ^ flips, base[:5], np.full(100, base[0])))
    rows = pa.table({"vector": pa.array([[float(i)] for i in range(len(codes))]), "code": pa.array(codes.astype(np.int64)), "ids": pa.array([[i] for i in range(len(codes))]), "entry": pa.array(np.arange(len(codes)))})
    want = {(q, e) for q in range(40) for e in range(len(codes)) if int(base[q] ^ codes[e]).bit_count() <= radius}
    for at_once in (1, 1 << 20):
        monkeypatch.setattr(N, "CODES_AT_ONCE", at_once)
        got = []
        for s in range(N.SUBSTRINGS):
            group = N.Group(s, rows, 1)
            entries = np.asarray(group.rows["entry"])
            got += [(int(q), int(entries[e])) for queries, places in group.candidates(base, radius) for q, e in zip(queries, places)]
        assert len(got) == len(set(got)) and set(got) == want


def test_shares_leave_no_code_out():
    for radius in range(4, 65):
        assert sum(s + 1 for s in N.shares(radius)) > radius or max(N.shares(radius)) == 16


def test_recall_on_the_given_vectors(spark, sf_dir):
    got = found(QUERIES["op13_nearest_neighbours"](spark, sf_dir).collect())
    rows = table(sf_dir, "embeddings")
    vectors, ids = np.array([r["embedding"] for r in rows], np.float64), np.array([r["vec_id"] for r in rows])
    hits = 0
    asked = [q for q in range(len(rows)) if ids[q] % 20 == 0]
    assert sorted(got) == sorted(ids[q] for q in asked)
    for q in asked:
        score = vectors @ vectors[q]
        score[q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        own = got[ids[q]]
        assert len(own) == 20 and all(abs(s - score[ids == i][0]) < 1e-12 for i, s in own) and own == sorted(own, key=lambda x: (-x[1], x[0]))
        hits += len({i for i, _ in own} & set(best.tolist()))
    assert hits >= 0.9 * 20 * len(asked)
