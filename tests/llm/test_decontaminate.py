import re

import numpy as np
from conftest_data import documents, table
from impactrank.llm import decontaminate as D
from impactrank.llm.queries import op10_decontaminate


def grams(text):
    words = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").encode().lower())
    return words, set(zip(*[words[i:] for i in range(5)]))


def brute_leaks(docs, items):
    out = set()
    for item_id, item in items:
        words, own = grams(item)
        for doc_id, text in docs:
            there, shingles = grams(text)
            if own:
                n = len(own & shingles)
                if n >= 0.8 * len(own):
                    out.add((doc_id, item_id, n, len(own)))
            elif words and any(there[i : i + len(words)] == words for i in range(len(there))):
                out.add((doc_id, item_id, 1, 1))
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted({(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in frame.collect()}, key=repr)


def test_query_equals_brute_force(spark, sf_dir):
    items = [(r["item_id"], r["text"]) for r in table(sf_dir, "benchmark")]
    want = brute_leaks(documents(sf_dir), items)
    assert want and rows_of(op10_decontaminate(spark, sf_dir)) == want


def test_hidden_short_and_edited_items(spark, odd, monkeypatch):
    rng = np.random.default_rng(4)
    noise = lambda n: " ".join(f"n{i}" for i in rng.integers(0, 5000, n))
    item = [f"q{i}" for i in range(60)]
    edited, broken = item.copy(), item.copy()
    edited[30], broken[10], broken[20], broken[30], broken[40] = ["x"] * 5
    docs = [(100 + i, f"{noise(int(a))} {' '.join(w)}. {noise(int(b))}") for i, (w, a, b) in enumerate(((item, 9000, 3), (edited, 77, 4001), (broken, 5, 5), (item[:20], 10, 10), (["tiny", "Item"], 50, 0)))]
    items = [(1, " ".join(item).upper()), (2, "TINY, item!"), (3, ""), (4, None), (5, " ".join(f"q{i}" for i in range(5, 12))), (1, " ".join(item).upper()), (None, "w0 w1 w4")]
    every = spark.createDataFrame(docs, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks([(r.doc_id, r.text) for r in every.collect()], items)
    assert rows_of(D.find_leaks(every, bench)) == want
    monkeypatch.setattr(D, "ITEMS", 4)  # several passes
    assert rows_of(D.find_leaks(every, bench)) == want
    tiny = {2, None}  # items of fewer words than a shingle
    assert {w[1] for w in want} & tiny
    for short in (True, False):
        gone = {w[0] for w in want if short or w[1] not in tiny}
        assert sorted((r.doc_id for r in D.without_leaks(every, bench, short=short).collect()), key=repr) == sorted((r.doc_id for r in every.collect() if r.doc_id not in gone), key=repr)


def test_empty_tables(spark, odd):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "item_id long, text string")
    assert D.find_leaks(odd.limit(0), bench).count() == D.find_leaks(odd, bench.limit(0)).count() == 0
    assert D.find_leaks(odd, bench).count() == 3 and D.without_leaks(odd, bench).columns == odd.columns


def test_short_items_word_for_word_in_long_documents():
    """Items of 5 to 12 words at many places, whole and with one shingle of five to eight lost; against brute force."""
    rng = np.random.default_rng(6)
    items = [(k, " ".join(f"i{k}x{j}" for j in range(5 + k % 8))) for k in range(400)]
    docs = []
    for k, text in items:
        noise = [f"n{i}" for i in rng.integers(0, 10**6, int(rng.integers(40, 400)))]
        at = int(rng.integers(len(noise)))
        own = text.split(" ")
        docs.append((k, " ".join(noise[:at] + (own if k % 3 else own[:-1]) + noise[at:])))
    known = D.benchmark_of(items)
    got = sorted(((d, known.item_ids[i], n, m) for d, i, n, m in D.leaks_in(known, [t.encode() for _, t in docs])), key=repr)
    assert got == brute_leaks(docs, items) and len(got) > 250
