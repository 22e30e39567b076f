import random
import re
import time

import pytest
from conftest_data import documents
from impactrank.llm import licenses as L
from impactrank.llm.queries import op2_license_scan


def brute_base(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    at, labels = [], set()
    for phrase, label in L.BASE.items():
        own = phrase.encode().split()
        hits = [i for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
        at += hits
        labels |= {label} if hits else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_equals_brute_force(spark, sf_dir, odd):
    texts = dict(documents(sf_dir))
    rows = op2_license_scan(spark, sf_dir).collect()
    assert len(rows) == len(texts) and any(r.n_base for r in rows)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(texts[r.doc_id])
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    names = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    found = L.scan_licenses(odd).collect()
    assert len(found) == odd.count() and L.scan_licenses(odd.limit(0)).count() == 0
    for r in found:
        if r.doc_id is not None:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(names[r.doc_id])


def test_overlapping_places():
    got = L.scan(b"The MIT license, mit License; GNU general public license. Apache-license apache licenses")
    assert (got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == (4, 1, 9, "apache,gpl,mit")


def test_automaton_equals_brute_force():
    chance = random.Random(1)
    for _ in range(60):
        templates = [[bytes([chance.choice(b"abc")]) for _ in range(chance.randint(3, 12))] for _ in range(3)]
        own = L.Automaton(templates)
        runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        text = [bytes([chance.choice(b"abcd")]) for _ in range(40)]
        length = [max((n for n in range(i + 2) if n == 0 or tuple(text[i + 1 - n : i + 1]) in runs)) for i in range(len(text))]
        want = [(i + 1, n) for i, n in enumerate(length) if n >= L.RUN and (i + 1 == len(text) or length[i + 1] != n + 1)]
        got = own.runs(text)
        assert [(end, n) for end, n, _ in got] == want
        for end, n, state in got:
            run = text[end - n : end]
            assert own.states[state].places == {(k, j) for k, t in enumerate(templates) for j in range(n, len(t) + 1) if t[j - n : j] == run}


def test_every_template_has_its_own_runs():
    """Against all pairs of places: the runs of each template that can't grow to the right, and are the longest that end there."""
    chance = random.Random(3)
    for _ in range(80):
        templates = [[bytes([chance.choice(b"abc")]) for _ in range(chance.randint(3, 12))] for _ in range(4)]
        text = [bytes([chance.choice(b"abcd")]) for _ in range(40)]
        got = L.Automaton(templates).runs_by_template(text)
        for k, own in enumerate(templates):
            runs = {tuple(own[i:j]) for i in range(len(own)) for j in range(i + 1, len(own) + 1)}
            length = [max(n for n in range(i + 2) if n == 0 or tuple(text[i + 1 - n : i + 1]) in runs) for i in range(len(text))]
            want = []
            for i, n in enumerate(length):
                if n >= L.RUN and (i + 1 == len(text) or length[i + 1] != n + 1):
                    want += [(i + 1 - n, j - n, n) for j in range(n, len(own) + 1) if own[j - n : j] == text[i + 1 - n : i + 1]]
            assert sorted(got.get(k, [])) == sorted(want)


def test_chained_spans():
    text = next(t for label, t in L.TEMPLATES if label == "isc").encode()
    words = text.split()
    changed = b"before " * 5 + b" ".join([*words[:12], b"WIDGET", *words[12:20], b"other", *words[21:]]) + b" after"
    got = L.scan(changed)
    assert got["labels"] == "isc" and got["n_base"] == 0
    span = next(s for s in got["spans"] if s["template"] == [label for label, _ in L.TEMPLATES].index("isc"))
    assert span["start"] == 5 and span["end"] == got["n_words"] - 1 and 0.8 <= span["covered"] < 1
    assert L.scan(b" ".join(words[:12]))["labels"] == ""


def test_templates_find_themselves():
    """Every template is found in itself, whole, among other words, with one word in thirty changed, and under its own label; ties between templates are all reported."""
    chance = random.Random(7)
    for number, (label, text) in enumerate(L.TEMPLATES):
        words = L.tokens(text.encode())
        got = L.scan(b"some words before " + text.encode() + b" and after")
        assert label in got["labels"].split(",") and got["score"] == 1
        assert any(s["template"] == number and (s["start"], s["end"], s["covered"]) == (3, 3 + len(words), 1) for s in got["spans"])
        if len(words) > 60:
            for at in range(chance.randrange(30), len(words), 30):
                words[at] = b"changed"
            assert any(s["template"] == number for s in L.scan(b" ".join(words))["spans"])
    every = L.scan(" ".join(t for _, t in L.TEMPLATES).encode())
    assert set(every["labels"].split(",")) == {label for label, _ in L.TEMPLATES}
    assert L.scan("\n".join(f"{n}. plain words of a text that grants nothing" for n in range(500)).encode())["labels"] == ""


def test_chains_bridge_gaps_and_end():
    label, text = next((label, t) for label, t in L.TEMPLATES if label == "zlib")
    words = L.tokens(text.encode())
    near = words[:40] + [b"x"] * (L.GAP - 1) + words[40:]
    far = words[:15] + [b"x"] * 60 + words[15:]
    assert L.scan(b" ".join(near))["labels"] == label and L.scan(b" ".join(far))["labels"] == label  # the longer part alone covers enough
    half = len(words) // 2
    assert L.scan(b" ".join(words[:half] + [b"x"] * 60 + words[half:]))["labels"] == ""
    assert L.scan(b"Licensed under CC BY-NC 4.0.")["labels"] == "cc-by-nc"
    assert L.scan(b"This work is licensed under the GNU General Public License, version 3.")["labels"] == "gpl"


def test_variants_are_told_apart():
    """GPL, LGPL and AGPL notices differ in a word; each has its own label alone."""
    for label in ("gpl", "lgpl", "agpl", "mpl"):
        for own, text in L.TEMPLATES:
            if own == label:
                found = L.scan(text.encode())
                assert {f["label"] for f in found["spans"]} == {label} and set(found["labels"].split(",")) == {label, *found["base_labels"].split(",")} - {""}, text
    assert L.scan(b"licensed under the GNU Lesser General Public License")["labels"] == "gpl,lgpl"  # the base phrase stays


def test_coverage_after_edits_is_what_the_edits_left():
    """Words changed at random: a template is found where the runs that are left cover enough of it with no long gap between them, never where the words left don't, and its score lies between both."""
    chance = random.Random(11)
    L.scan(b"")
    found = 0
    for number, (label, text) in enumerate(L.TEMPLATES):
        words = L.tokens(text.encode())
        size, long = len(words), len(words) >= L.LONG
        least, widest, need = L.LONG_RUN if long else L.RUN, L.LONG_GAP if long else L.GAP, L.COVERED if size >= L.WHOLE else 1
        for rate in (0.01, 0.03, 0.1, 0.3):
            own = [w if chance.random() >= rate else b"zzz" for w in words]
            marks = "".join("-" if w == b"zzz" else "w" for w in own)
            runs = [m.span() for m in re.finditer(f"w{{{least},}}", marks)]
            lower, upper = sum(e - s for s, e in runs) / size, marks.count("w") / size
            near = all(after[0] - before[1] <= widest for before, after in zip(runs, runs[1:]))
            text = b" ".join(own)
            covered = max((c for n, _, _, c in L._KNOWN[0].spans(L.tokens(text)) if n == number), default=None)
            if lower >= need and near:
                got = L.scan(b"before it " + text + b" after")
                assert covered is not None and covered >= lower - 1e-9 and got["score"] >= lower - 1e-9, (label, number, rate)
                found += 1
            if covered is not None:
                assert need <= covered <= upper + 1e-9, (label, number, rate)
    assert found > len(L.TEMPLATES)


def test_whole_licences_are_found_as_bodies():
    chance = random.Random(5)
    for label, text in L.bodies():
        words = text.split()
        for at in range(chance.randrange(40), len(words), 40):
            words[at] = "Changed"
        got = L.scan(" ".join(["A", "file", *words, "end"]).encode())
        assert f"{label}:body" in got["found_by"].split(",") and got["score"] > 0.8, label
        quarter = L.scan(" ".join(words[: len(words) // 4]).encode())
        assert f"{label}:body" not in quarter["found_by"].split(",")
    assert L.scan(b"it is released under the MIT License here")["found_by"] == "mit:line,mit:phrase"
    assert L.scan(b"see the mit license")["found_by"] == "mit:phrase" and L.scan(b"nothing")["found_by"] == ""


@pytest.mark.parametrize("unit", ["of the license ", "the ", "the terms of this license and the program or any work based on it ", "licensed under the ", "a b c d e "])
def test_hostile_texts_take_linear_time(unit):
    text = (unit * (1_000_000 // len(unit))).encode()
    L.scan(b"warm")
    began = time.perf_counter()
    L.scan(text)
    assert time.perf_counter() - began < 60
