import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from conftest_data import documents
from hypothesis import given, settings
from hypothesis import strategies as st
from impactrank.llm import lm
from impactrank.llm.common import crc_fold
from impactrank.llm.queries import op6_lm_scores


def tokens(text):
    return [*(text or "").encode().lower().split(), b" "]


def brute_scores(docs):
    """The interpolated model from plain counts, unquantised."""
    counts = [Counter() for _ in range(3)]
    grams = lambda own: [[(*["<s>"] * k, *own)[i : i + k + 1] for i in range(len(own))] for k in range(3)]
    for doc_id, text in docs:
        if crc_fold(doc_id, 10) != 0:
            for k, found in enumerate(grams(tokens(text))):
                counts[k].update(found)
    n, v = sum(counts[0].values()), len(counts[0])
    total, kinds = [Counter() for _ in range(3)], [Counter() for _ in range(3)]
    for k in (1, 2):
        for g, c in counts[k].items():
            total[k][g[:-1]] += c
            kinds[k][g[:-1]] += 1
    base = lambda g: (counts[0][g] + 0.1) / (n + 0.1 * (v + 1))

    def chance(g):
        k = len(g) - 1
        if not k:
            return base(g)
        lower = chance(g[1:])
        d, c = lm.DISCOUNTS[k - 1], total[k][g[:-1]]
        return (max(counts[k][g] - d, 0) + d * kinds[k][g[:-1]] * lower) / c if c else lower

    out = []
    for doc_id, text in docs:
        own = tokens(text)
        one, two, three = grams(own)
        three[0] = two[0]  # a first word has no more context than the start
        out.append((doc_id, crc_fold(doc_id, 10) == 0, len(own), sum(counts[0][g] > 0 for g in one), n, sum(math.log10(base(g)) for g in one), sum(math.log10(chance(g)) for g in three)))
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in frame.collect()), key=repr)


def assert_equal(got, want):
    """Counts are equal, and scores but for the rounding to a hundredth of a decade that quantised probabilities bring."""
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(abs(g[5] - w[5]) < 1e-6 * g[2] and abs(g[6] - w[6]) < 1e-2 * g[2] for g, w in zip(got, want))


def test_query_equals_brute_force(spark, sf_dir):
    got = rows_of(op6_lm_scores(spark, sf_dir))
    assert_equal(got, brute_scores(documents(sf_dir)))
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)  # contexts foretell unseen text better than words alone


def test_odd_rows_in_small_chunks_and_many_shards(odd, monkeypatch):
    want = brute_scores([(r.doc_id, r.text) for r in odd.collect()])
    assert_equal(rows_of(lm.language_model_scores(odd)), want)
    monkeypatch.setattr(lm, "SHARD_TOKENS", 10_000)
    assert_equal(rows_of(lm.language_model_scores(odd)), want)
    assert lm.language_model_scores(odd.limit(0)).count() == 0


def test_seen_and_unseen_contexts(spark):
    words = ["a", "b", "c", "d"]
    train = [(1, "a b a c a b d"), (2, "b a b c"), (3, "d d a")]
    asked = [(100_000 + 10 * i + j, f"{h} {w}".strip()) for i, h in enumerate(["a b", "b a", "d c", "zz", ""]) for j, w in enumerate([*words, "?", ""])]
    docs = [(i, t) for i, t in train if crc_fold(i, 10)] + [(k, t) for i, t in asked for k in [next(k for k in range(i * 1000, i * 1000 + 1000) if not crc_fold(k, 10))]]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    own = {r.doc_id: r for r in lm.language_model_scores(frame).collect()}
    model = dict((r[0], r[6]) for r in brute_scores(docs))
    assert all(abs(own[k].score - s) < 1e-2 * own[k].n_tokens for k, s in model.items())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5), st.integers(0, 5), st.integers(0, 3)), max_size=120), st.integers(0, 5))
def test_trie_answers_its_counts(grams, hot):
    """Against plain counts: all n-grams of the trie, absent ones, and one context whose successors are spread over shards."""
    triples = {(a, b, c): n for a, b, c, n in grams}
    pairs, total, kinds = Counter(), Counter(), Counter()
    for (a, b, _), n in triples.items():
        pairs[a, b] += n
    every = [(a, b, c) for a in range(6) for b in range(6) for c in range(6)]
    u = lambda values: np.array(values, np.uint64)
    ints = lambda values: np.array(values, np.int64)
    words = u(range(6))
    told = lm.Told(words, ints([3, 0, 1, 0, 2, 9]), words, ints([6] * 6), u([b for _ in range(6) for b in range(6)]), ints([pairs[a, b] for a in range(6) for b in range(6)]), ints([6] * 36), u([c for *_, c in every]), ints([triples.get(g, 0) for g in every]))
    trie = lm.Trie(lm.Told.together([told]), (0.75, 0.9), u([hot]))
    counts, *codes = trie.answer(told)
    weights, chances, inner_weights, inner_chances = map(lm.value_of, codes)
    close = lambda got, want: abs(got - want) <= 0.012 * want
    assert counts.tolist() == [3, 0, 1, 0, 2, 9] and trie.words.n == 4
    for (a, b), n in pairs.items():
        total[a] += n
        kinds[a] += n > 0
    for a in range(6):
        assert close(weights[a], 0 if not total[a] else 1 if a == hot else 0.75 * kinds[a] / total[a])
        for b in range(6):
            at, n = 6 * a + b, pairs[a, b]
            assert close(chances[at], 0 if not n else (n - 0.75) / (1 if a == hot else total[a]))
            follow = [triples.get((a, b, c), 0) for c in range(6)]
            assert close(inner_weights[at], 0.9 * sum(x > 0 for x in follow) / n if n else 0)
            assert all(close(inner_chances[6 * at + c], (x - 0.9) / n if x else 0) for c, x in enumerate(follow))
    assert [a.tolist() for a in trie.totals] == ([[hot], [total[hot]], [kinds[hot]]] if total[hot] else [[], [], []])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=200).map(sorted), st.lists(st.integers(0, 2**64 - 1), max_size=20))
def test_elias_fano(values, others):
    held = lm.EliasFano(np.array(values, np.uint64))
    assert held.access(np.arange(len(values))).tolist() == values
    asked = np.array([*values, *others], np.uint64)
    at = held.successor(asked, np.zeros(len(asked), np.int64), np.full(len(asked), len(values)))
    assert at.tolist() == [next((i for i, v in enumerate(values) if v >= a), len(values)) for a in asked.tolist()]


def test_compact_sequences_and_codes():
    held = lm.EliasFano(np.arange(5, 100_005, dtype=np.uint64))
    assert held.bits == 0 and held.access(np.array([0, 99_999])).tolist() == [5, 100_004]
    values = np.sort(np.random.default_rng(1).integers(0, 2**50, 100_000, dtype=np.uint64))
    held = lm.EliasFano(values)
    size = sum(a.nbytes for a in (held.low, held.high, held.before, held.zeros))
    assert size < 6 * len(values) and (held.place(values) >= 0).all() and (held.place(values + np.uint64(1)) >= 0).mean() < 0.01
    x = np.array([1e-12, 0.1, 0.25, 1.0, 1e9])
    assert (abs(lm.value_of(lm.quantised(x)) - x) <= 0.012 * x).all() and lm.value_of(np.zeros(1, np.uint16))[0] == 0


def test_tasks_hold_few_bytes_a_token():
    rng, n = np.random.default_rng(0), 30_000
    hot = lm.mix(np.array([lm.START])) >> np.uint64(16)

    def chunk(name):
        held, tokens = np.unique(rng.zipf(1.3, n).clip(max=20_000), return_inverse=True)
        return lm._row(lm._CHUNK, [name, n, n, [], lm.mix(held.astype(np.uint64)).tobytes(), lm._pack(tokens), lm._pack(np.full(n // 100, 100)), np.packbits(np.ones(n // 100, bool)).tobytes(), list(range(n // 100))])

    def peak(run, batches):
        tracemalloc.start()
        out = list(run(iter(batches)))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most

    asks, most = peak(lm._asks(1, hot), [chunk(i) for i in range(8)])
    assert most < 110 * n
    _, most = peak(lm._answers(lm.DISCOUNTS, hot), pa.Table.from_batches(asks).combine_chunks().to_batches())
    assert most < 80 * 8 * n


def test_rows_become_views_of_all_rows_together():
    rows = [lm.Told(*(np.arange(n) for _ in lm.Told.FIELDS)) for n in (3, 0, 5)]
    whole = lm.Told.together(rows)
    for f in lm.Told.FIELDS:
        assert getattr(whole, f).tolist() == [0, 1, 2, 0, 1, 2, 3, 4]
        assert [getattr(r, f).tolist() for r in rows] == [[0, 1, 2], [], [0, 1, 2, 3, 4]]
        assert np.shares_memory(getattr(whole, f), getattr(rows[2], f))


@given(st.lists(st.integers(0, 2**64 - 1), max_size=40))
def test_distinct_values_are_those_of_unique(values):
    values = np.array(values + values[::3], np.uint64)
    expected, place = np.unique(values, return_inverse=True)
    own, at = lm._distinct(values)
    assert own.tolist() == expected.tolist() and at.tolist() == place.tolist()
