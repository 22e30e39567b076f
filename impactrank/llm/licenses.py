"""Licence scans by a generalised suffix automaton over the tokens of licence templates.

The automaton holds every run of words that stands in any template. A text is streamed through it
once: at each word it gives the longest run that ends there, the shorter ones by suffix links, and where they stand in the templates
(matching statistics). So every template has its own runs, those that can't grow in it, though another template may hold a longer one. Long runs that follow each other both in the text and in a template are
chained into spans; a span that covers enough of a template is a finding. Templates are whole licences, notices and paragraphs, and lines
that name a licence; every label says what it comes from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import NOT_WORD, id_text, text_bytes
from .licencetexts import LINES, TEXTS, bodies

#: Phrases whose every place counts, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Templates with their labels, and of which kind they are.
TEMPLATES = [*TEXTS, *LINES, *(_bodies := bodies())]
KINDS = ["notice"] * len(TEXTS) + ["line"] * len(LINES) + ["body"] * len(_bodies)
#: Words of the shortest run that a chain uses, words that may lie between two runs, and the part of a template to be covered; a template of fewer than ``WHOLE`` words must be covered whole.
RUN, GAP, COVERED, WHOLE = 3, 6, 0.8, 20
#: Words from which on a template is long; runs and gaps in chains of long ones, where short runs have too many places and say little.
LONG, LONG_RUN, LONG_GAP = 500, 8, 24
_TABLE = bytes(0x20 if NOT_WORD[i] else i for i in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return text.lower().translate(_TABLE).split()


@dataclass
class State:
    length: int
    link: int = -1
    step: dict[int, int] = field(default_factory=dict)
    #: (template, end) places of the longest run of this state.
    places: set[tuple[int, int]] = field(default_factory=set)
    templates: frozenset[int] = frozenset()


class Automaton:
    """Suffix automaton of several token sequences."""

    def __init__(self, sequences: list[list[bytes]]):
        self.ids: dict[bytes, int] = {}
        self.states = [State(0)]
        self.sizes = [len(s) for s in sequences]
        self.least = [LONG_RUN if n >= LONG else RUN for n in self.sizes]
        self.gaps = [LONG_GAP if n >= LONG else GAP for n in self.sizes]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, self.ids.setdefault(word, len(self.ids)))
                self.states[last].places.add((number, at + 1))
        for state in sorted(self.states[1:], key=lambda s: -s.length):  # a run's suffixes end where it ends
            if state.link > 0:
                self.states[state.link].places |= state.places
        for state in self.states:
            state.templates = frozenset(n for n, _ in state.places)

    def _extend(self, last: int, c: int) -> int:
        states = self.states
        known = states[last].step.get(c)
        if known is not None and states[known].length == states[last].length + 1:
            return known
        fresh = -1
        if known is None:
            fresh = len(states)
            states.append(State(states[last].length + 1))
        at = last
        while at >= 0 and c not in states[at].step:
            states[at].step[c] = fresh
            at = states[at].link
        if at < 0:
            states[fresh].link = 0
            return fresh
        target = states[at].step[c]
        if states[target].length != states[at].length + 1:
            copy = len(states)
            states.append(State(states[at].length + 1, states[target].link, dict(states[target].step)))
            old = target
            while at >= 0 and states[at].step.get(c) == old:
                states[at].step[c] = copy
                at = states[at].link
            states[old].link = copy
            target = copy
        if fresh < 0:
            return target
        states[fresh].link = target
        return fresh

    def runs(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """Matching statistics where they stop growing: (end, length, state) of each run of ``RUN`` words or more."""
        out, states = [], self.states
        at = length = 0
        for i, c in enumerate(map(self.ids.get, words)):
            if c is None:
                if length >= RUN:
                    out.append((i, length, at))
                at = length = 0
                continue
            onward = states[at].step.get(c)
            if onward is None:
                if length >= RUN:
                    out.append((i, length, at))
                while at > 0 and onward is None:
                    at = states[at].link
                    onward = states[at].step.get(c)
                    length = states[at].length
                if onward is None:
                    at = length = 0
                    continue
            at, length = onward, length + 1
        if length >= RUN:
            out.append((len(words), length, at))
        return out

    def runs_by_template(self, words: list[bytes]) -> dict[int, list[tuple[int, int, int]]]:
        """For each template its runs of ``RUN`` words (``LONG_RUN`` for long ones) or more that stop growing: (start, place, length) for every place where one stands in it."""
        out: dict[int, list[tuple[int, int, int]]] = {}
        states, at, length = self.states, 0, 0
        before: dict[int, tuple[int, int]] = {}  # template: length and state of its run that ends at the word before

        def end(i: int, number: int, held: int, state: int) -> None:
            if held < self.least[number]:
                return
            own = out.setdefault(number, [])
            own += [(i - held, stop - held, held) for n, stop in states[state].places if n == number]

        for i, c in enumerate(map(self.ids.get, words)):
            onward = states[at].step.get(c) if c is not None else None
            while at > 0 and onward is None and c is not None:
                at = states[at].link
                onward = states[at].step.get(c)
                length = states[at].length
            at, length = (onward, length + 1) if onward is not None else (0, 0)
            now: dict[int, tuple[int, int]] = {}
            state, held = at, length
            while held >= RUN:
                for number in states[state].templates:
                    now.setdefault(number, (held, state))
                state = states[state].link
                held = states[state].length
            for number, (held, state) in before.items():
                if now.get(number, (0, 0))[0] != held + 1:
                    end(i, number, held, state)
            before = now
        for number, (held, state) in before.items():
            end(len(words), number, held, state)
        return out

    def spans(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(template, first word, end word, covered part) of every chain that covers ``COVERED`` of its template or more."""
        pieces = self.runs_by_template(words)
        out = []
        for number, own in pieces.items():
            gap = self.gaps[number]
            need = COVERED * self.sizes[number] if self.sizes[number] >= WHOLE else self.sizes[number]
            chains: list[list[int]] = []  # open chains: text start, text end, template end, covered words
            for start, place, length in sorted(own):
                chains = [c for c in chains if start - c[1] <= gap or self._finish(c, number, need, out)]
                best = None
                for c in chains:
                    fresh = length - max(0, c[1] - start, c[2] - place)  # what does not overlap the chain
                    if fresh > 0 and abs((place - c[2]) - (start - c[1])) <= gap and place + length > c[2] and (best is None or c[3] + fresh > best[0]):
                        best = (c[3] + fresh, c)
                if best:
                    chains.append([best[1][0], start + length, place + length, best[0]])
                else:
                    chains.append([start, start + length, place + length, length])
            for c in chains:
                self._finish(c, number, need, out)
        widest: dict[tuple[int, int], tuple[int, int, int, float]] = {}
        for found in out:
            key = (found[0], found[1])
            if key not in widest or found[3] > widest[key][3]:
                widest[key] = found
        return sorted(widest.values(), key=lambda f: (f[1], f[2], f[0]))

    def _finish(self, chain: list[int], number: int, need: float, out: list) -> None:
        if chain[3] >= need:
            out.append((number, chain[0], chain[1], min(1.0, chain[3] / self.sizes[number])))


def best_spans(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """The spans but for those that one of another label, covered to a larger part, overlaps by more than half: licences share most of their words with their variants."""
    open_: list[tuple[int, int, int, int, float]] = []
    gone: set[int] = set()
    for n, (number, start, end, covered) in enumerate(spans):  # by start
        open_ = [o for o in open_ if o[2] > start]
        for m, begin, stop, other, part in open_:
            if TEMPLATES[other][0] != TEMPLATES[number][0]:
                shared = min(end, stop) - start
                if part > covered and 2 * shared > end - start:
                    gone.add(n)
                if covered > part and 2 * shared > stop - begin:
                    gone.add(m)
        open_.append((n, start, end, number, covered))
    return [s for n, s in enumerate(spans) if n not in gone]


_KNOWN: list[Automaton] = []
_PHRASES = [(tuple(p.encode().split()), label) for p, label in BASE.items()]


def scan(text: bytes) -> dict:
    """Base places and template spans of one text."""
    if not _KNOWN:
        _KNOWN.append(Automaton([tokens(t.encode()) for _, t in TEMPLATES]))
    words = tokens(text)
    places, labels = [], set()
    at = -1
    while True:
        try:
            at = words.index(b"license", at + 1)
        except ValueError:
            break
        for phrase, label in _PHRASES:
            if at + 1 >= len(phrase) and tuple(words[at + 1 - len(phrase) : at + 1]) == phrase:
                places.append(at + 1 - len(phrase))
                labels.add(label)
    spans = best_spans(_KNOWN[0].spans(words))
    said = {(label, "phrase") for label in labels} | {(TEMPLATES[n][0], KINDS[n]) for n, *_ in spans}
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(labels)),
        "labels": ",".join(sorted({label for label, _ in said})),
        "score": max([c for *_, c in spans], default=0.5 if places else 0.0),
        "spans": [{"label": TEMPLATES[n][0], "template": n, "start": a, "end": b, "covered": c} for n, a, b, c in spans],
        "found_by": ",".join(sorted(f"{label}:{kind}" for label, kind in said)),
    }


_SPAN = pa.struct([("label", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())])
_SCHEMA = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(_SPAN), "found_by": pa.string()}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, labels and spans of every document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans, found_by.

    found_by names each label with what it was found by: a whole licence (body), a notice or paragraph (notice), a line that names it (line) or a base phrase (phrase).
    The score is the largest covered part of a template; 0.5 where a phrase alone is found, 0 where nothing
    is. Null and empty texts have no words. Repeated rows and null ids stay; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t) for t in text_bytes(batch["text"])]
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in _SCHEMA.items()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *cols], ["doc_id", *_SCHEMA])

    span = "array<struct<label: string, template: int, start: long, end: long, covered: double>>"
    return id_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {span}, found_by string")
