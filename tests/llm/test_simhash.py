import numpy as np
import pytest
import xxhash
from conftest_data import documents
from impactrank.llm import simhash as S
from impactrank.llm.queries import op4_simhash_dedup


def brute_print(text, n=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids, radius=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    v = np.array(prints, np.uint64)
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i] ^ v[i + 1 :]) <= radius) + i + 1:
            root[find(int(j))] = find(i)
    least = {}
    for i, name in enumerate(ids):
        if name is not None:
            least[find(i)] = min(name, least.get(find(i), name))
    return [least.get(find(i)) for i in range(len(v))]


def test_query_equals_brute_force(spark, sf_dir):
    docs = documents(sf_dir)
    prints = [brute_print(t) for _, t in docs]
    want = sorted((i, f"{p:016x}", c) for (i, _), p, c in zip(docs, prints, brute_components(prints, [i for i, _ in docs])))
    assert sorted(map(tuple, op4_simhash_dedup(spark, sf_dir).collect())) == want


def test_odd_rows(odd):
    rows = odd.select("doc_id", "text").collect()
    prints = [brute_print(r.text) for r in rows]
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in S.near_duplicates(odd).collect()), key=repr)
    assert got == sorted(zip([r.doc_id for r in rows], prints, brute_components(prints, [r.doc_id for r in rows])), key=repr)
    assert S.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [4096, 10])
@pytest.mark.parametrize("radius", [4, 7])
def test_links_lose_no_component(spark, monkeypatch, bucket, radius):
    """Random prints, dense clusters and chains; a small bucket makes the blocks of large buckets work."""
    monkeypatch.setattr(S, "BUCKET", bucket)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = [base[0] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 3, replace=False))) for _ in range(150)]
    chain = [base[1]]
    for _ in range(40):
        chain.append(chain[-1] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 4, replace=False))))
    values = sorted({int(v) for v in [*base, *near, *chain]})
    nodes = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    roots = {r.node % 2**64: r.root % 2**64 for r in S.components(S.links(nodes, radius)).collect()}
    want = brute_components(values, list(range(len(values))), radius)
    groups, expected = {}, {}
    for i, v in enumerate(values):
        groups.setdefault(roots.get(v, v), set()).add(i)
        expected.setdefault(want[i], set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_masks_cover_all_pairs():
    rng = np.random.default_rng(2)
    sample = rng.integers(0, 2**63, 500, dtype=np.uint64)
    for n, radius in ((1000, 4), (10**7, 4), (10**10, 4), (10**5, 6)):
        masks = np.array(S.plan_masks(sample, n, radius), np.uint64)
        for _ in range(300):
            flip = np.uint64(sum(1 << int(b) for b in rng.choice(64, radius, replace=False)))
            assert ((flip & masks) == 0).any()


def shingles(text):
    words = (text or "").encode().lower().split()
    return set(zip(*[words[i:] for i in range(5)])) if len(words) >= 5 else {tuple(words)} - {()}


def brute_groups(docs, least=0.8):
    """(id, least id of its group) by all pairs of texts."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if docs[i][1] == docs[j][1] or not both or len(sets[i] & sets[j]) >= least * both:
                root[find(i)] = find(j)
    named = {}
    for i, (name, _) in enumerate(docs):
        named[find(i)] = min(name, named.get(find(i), name))
    return sorted((name, named[find(i)]) for i, (name, _) in enumerate(docs))


def test_similar_documents(spark, sf_dir):
    """Near copies with single words changed, added and dropped, beside the documents themselves."""
    docs = documents(sf_dir)[:120]
    chance = np.random.default_rng(8)
    more = []
    for i, (name, text) in enumerate(docs[:60]):
        words = text.split(" ")
        for at in chance.integers(0, len(words), max(1, len(words) // 60)):
            words[at] = ["changed", words[at] + " added", ""][i % 3]
        more.append((1000 + name, " ".join(words)))
    frame = spark.createDataFrame(docs + more, "doc_id long, text string")
    got = dict(S.similar_documents(frame).collect())
    want = dict(brute_groups(docs + more))
    found = [got[n] == want[n] for n in want if want[n] != n]
    assert np.mean(found) > 0.97
    assert all(got[n] == n for n in want if want[n] == n)


@pytest.mark.parametrize("block", [8 << 20, 4000])
def test_a_chain_of_near_copies_is_one_group(spark, monkeypatch, block):
    """Each text differs by a word from the one before, so most differ from the pivot; small blocks make the pairs of blocks work."""
    monkeypatch.setattr(S, "BLOCK_BYTES", block)
    chance = np.random.default_rng(4)
    words = [f"w{i}" for i in chance.permutation(3000)[:100]]
    docs = [(1, " ".join(words))]
    for i in range(2, 41):
        words[int(chance.integers(100))] = f"new{i}"
        docs.append((i, " ".join(words)))
    docs += [(100, " ".join(words[:50])), (101, ""), (102, " \n")]
    got = dict(S.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    want = dict(brute_groups(docs))
    want[102] = 101
    assert got == want and len(set(want.values())) == 3


def test_similar_links_equal_all_pairs():
    rng = np.random.default_rng(9)
    pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool[30 * (i % 7) : 30 * (i % 7) + 40], 36, replace=False)) for i in range(80)]
    for part in (np.zeros(80, bool), np.arange(80) % 7 < 2):
        root = list(range(80))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        def groups():
            out = {}
            for i in range(80):
                out.setdefault(find(i), []).append(i)
            return sorted(out.values())

        known = np.flatnonzero(part)
        for i, j in zip(known, known[1:]):
            root[find(i)] = find(j)
        start = list(root)
        for i in range(80):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
        want, root = groups(), start
        for i, j in zip(*S.similar_links(np.arange(80), sets, part, 0.8)):
            root[find(i)] = find(j)
        assert groups() == want and len(want) < 80


def test_one_of_each(spark, odd):
    kept = S.one_of_each(odd)
    assert kept.columns == odd.columns
    names = sorted(r.doc_id for r in kept.where("doc_id is not null").collect())
    assert names == [1, 4, 5, 7, 8] and kept.where("doc_id is null").count() == 2
    assert S.one_of_each(odd.limit(0)).count() == 0


@pytest.mark.parametrize("shared", [1 << 24, 1])
def test_copies_with_a_section_added_or_cut_off(spark, sf_dir, monkeypatch, shared):
    """Similarity of 0.8 or more with 10-25% appended, cut off or inserted in one piece; against all pairs."""
    monkeypatch.setattr(S, "SHARED", shared)
    monkeypatch.setattr(S, "BUCKET", 8)
    docs = [d for d in documents(sf_dir) if 60 <= len((d[1] or "").split()) <= 600][:90]
    chance = np.random.default_rng(3)
    more = []
    for i, (name, text) in enumerate(docs):
        words, share = text.split(), (0.1, 0.15, 0.19, 0.2, 0.24)[i % 5]
        n = int(len(words) * share)
        new = [f"new{j}" for j in chance.integers(0, 10**6, n)]
        at = int(chance.integers(len(words)))
        more.append((10_000 + name, " ".join([words + new, words[: len(words) - n], words[:at] + new + words[at:]][i % 3])))
    boiler = " ".join(f"b{j}" for j in range(40))
    more += [(20_000 + i, f"{boiler} " + " ".join(f"own{i}x{j}" for j in range(8 + i % 5))) for i in range(20)]
    got = dict(S.similar_documents(spark.createDataFrame(docs + more, "doc_id long, text string")).collect())
    want = dict(brute_groups(docs + more))
    assert got == want and sum(want[n] != n for n in want) > 50


def test_rows_of_one_id_with_other_texts_are_other_documents(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(5, one), (5, two), (5, one), (3, two + " end"), (9, None), (None, one), (None, one)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(S.one_of_each(frame).collect(), key=repr) == sorted([(5, one), (3, two + " end"), (9, None), (None, one), (None, one)], key=repr)
    assert sorted(S.similar_documents(frame).collect()) == [(3, 3), (5, 3), (5, 5), (5, 5), (9, 9)]


def test_long_texts_that_share_a_part(spark):
    """Long texts of which a third to nine tenths are shared; counts by cell must lose none that are similar."""
    chance = np.random.default_rng(12)
    base = [f"w{i}" for i in chance.integers(0, 10**6, 9000)]
    docs = [(1, " ".join(base))]
    for i, share in enumerate((0.35, 0.6, 0.75, 0.88, 0.89, 0.9, 0.95)):
        n = int(len(base) * share)
        docs.append((10 + i, " ".join(base[:n] + [f"v{i}x{j}" for j in range(len(base) - n)])))
    got = dict(S.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    want = dict(brute_groups(docs))
    assert got == want and len(set(want.values())) == 4 + (want[13] != 1)


def test_small_tables_need_few_tasks(spark, monkeypatch):
    """However many shuffle partitions the session has, rounds over a few links run in about as many tasks as there are cores; links beyond those that are sent give the same."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 7] + [(100, 3), (200, 201)], "a long, b long")
    tracker = spark.sparkContext.statusTracker()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spark.sparkContext.setJobGroup("stars", "")
        roots = S.components(edges)
        found = sorted(map(tuple, roots.collect()))
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("stars") for s in tracker.getJobInfo(j).stageIds]
        assert sum(1 for s in stages if s and s.numTasks >= 97) <= 4  # the links come in so many and are counted; rounds do not
        monkeypatch.setattr(S, "SENT_LINKS", 0)
        assert sorted(map(tuple, S.components(edges).collect())) == found
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (2, 1) in found and (7, 1) in found and (100, 1) in found and (201, 200) in found
