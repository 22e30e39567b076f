"""Text functions as Column -> Column: tokens, stems and the integer parser of query files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens are runs of letters or of digits; the second form takes letters of any script.
TOKEN = "[a-z]+|[0-9]+"
UNICODE_TOKEN = r"\p{L}+|[0-9]+"


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    """Array of the tokens of a text, lower-cased; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1))


def words(line: Column) -> Column:
    """Array of the white-space separated words of a line; runs of separators collapse."""
    return F.filter(F.split(line, r"\s+"), lambda w: w != "")


def strip_plural(term: Column) -> Column:
    """The S-stripper: ies becomes y, else a final es goes, else a final s."""
    cut = lambda n: F.substring(term, F.lit(1), F.length(term) - n)
    return F.when(F.endswith(term, F.lit("ies")), F.concat(cut(3), F.lit("y"))).when(F.endswith(term, F.lit("es")), cut(2)).when(F.endswith(term, F.lit("s")), cut(1)).otherwise(term)


#: A step of a rule machine: suffixes with what takes their place and what the stem before them must be like. The longest suffix that fits decides, whether or not its condition holds.
Rules = list[tuple[str, str, Callable[[Column], Column]]]


def _shape(stem: Column) -> Column:
    """A stem with V for each vowel and C for each consonant; y is a vowel after a consonant."""
    return F.regexp_replace(F.regexp_replace(stem, "[aeiou]|(?<=[^aeiou])y", "V"), "[^V]", "C")


def _measure(pattern: str) -> Callable[[Column], Column]:
    return lambda stem: _shape(stem).rlike(pattern)


#: Conditions: runs of a vowel and a consonant that a stem has, a vowel anywhere, a double consonant, and consonant, vowel, consonant (not w, x, y) at the end.
ANY = lambda stem: F.lit(True)
ONCE, TWICE, VOWEL = _measure("VC"), _measure("VC+V+C"), _measure("V")
DOUBLE = lambda stem: stem.rlike(r"([^aeiouy])\1$")
SHORT = lambda stem: _shape(stem).rlike("CVC$") & ~stem.rlike("[wxy]$")


def stripped(term: Column, rules: Rules) -> Column:
    """One step of a rule machine over a term."""
    out: Column | None = None
    for suffix, instead, fits in sorted(rules, key=lambda r: -len(r[0])):
        stem = F.substring(term, F.lit(1), F.length(term) - len(suffix))
        then = F.when(fits(stem), F.concat(stem, F.lit(instead))).otherwise(term)
        found = F.endswith(term, F.lit(suffix))
        out = F.when(found, then) if out is None else out.when(found, then)
    return out.otherwise(term)


def _with(condition: Callable[[Column], Column], pairs: str) -> Rules:
    return [(a, b, condition) for a, _, b in (p.partition(">") for p in pairs.split())]


#: The suffixes of the published suffix-stripping algorithm of 1980, step by step.
_PLURALS = _with(ANY, "sses>ss ies>i ss>ss s>")
_SECOND = _with(ONCE, "ational>ate tional>tion enci>ence anci>ance izer>ize abli>able alli>al entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble")
_THIRD = _with(ONCE, "icate>ic ative> alize>al iciti>ic ical>ic ful> ness>")
_FOURTH = _with(TWICE, "al> ance> ence> er> ic> able> ible> ant> ement> ment> ent> ou> ism> ate> iti> ous> ive> ize>") + [("ion", "", lambda stem: TWICE(stem) & stem.rlike("[st]$"))]


def _past(term: Column) -> Column:
    """eed, ed and ing; a stem that ed or ing leaves is made whole again: an e comes back, or one of two letters goes."""
    cut = lambda n: F.substring(term, F.lit(1), F.length(term) - n)

    def whole(stem: Column) -> Column:
        shorter = F.substring(stem, F.lit(1), F.length(stem) - 1)
        return F.when(stem.rlike("(at|bl|iz)$"), F.concat(stem, F.lit("e"))).when(DOUBLE(stem) & ~stem.rlike("[lsz]$"), shorter).when(ONCE(stem) & ~TWICE(stem) & SHORT(stem), F.concat(stem, F.lit("e"))).otherwise(stem)

    return (
        F.when(F.endswith(term, F.lit("eed")), F.when(ONCE(cut(3)), F.concat(cut(3), F.lit("ee"))).otherwise(term))
        .when(F.endswith(term, F.lit("ed")) & VOWEL(cut(2)), whole(cut(2)))
        .when(F.endswith(term, F.lit("ing")) & VOWEL(cut(3)), whole(cut(3)))
        .otherwise(term)
    )


def _last(term: Column) -> Column:
    """A final e, and one of two final l."""
    stem = F.substring(term, F.lit(1), F.length(term) - 1)
    bare = F.endswith(term, F.lit("e")) & (TWICE(stem) | (ONCE(stem) & ~SHORT(stem)))
    return F.when(bare, stem).otherwise(term)


def _one_l(term: Column) -> Column:
    stem = F.substring(term, F.lit(1), F.length(term) - 1)
    return F.when(F.endswith(term, F.lit("ll")) & TWICE(stem), stem).otherwise(term)


#: Stemmers by letter, as steps; add to it to register another.
STEMMERS: dict[str, list[Callable[[Column], Column]]] = {
    "-": [],
    "s": [strip_plural],
    "p": [
        lambda t: stripped(t, _PLURALS),
        _past,
        lambda t: stripped(t, [("y", "i", VOWEL)]),
        lambda t: stripped(t, _SECOND),
        lambda t: stripped(t, _THIRD),
        lambda t: stripped(t, _FOURTH),
        _last,
        _one_l,
    ],
}
#: Stemmers whose steps are worth running once a distinct term rather than once an occurrence; they leave terms of one and two letters alone.
BY_VOCABULARY = {"p"}


def stemmed(terms: Column, stemmer: str = "s") -> Column:
    """Array of stems, without those that come out empty. Steps go over the array one after the other, so that each sees the term before it once."""
    own = terms
    for step in STEMMERS[stemmer]:
        own = F.transform(own, (lambda f: lambda t: F.when(F.length(t) <= 2, t).otherwise(f(t)))(step) if stemmer in BY_VOCABULARY else step)
    return F.filter(own, lambda t: t != "") if STEMMERS[stemmer] else own


def parse_long(text: Column) -> Column:
    """The number that a text begins with; 0 where it begins with none or with too large a one."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([-+]?\d+)", 1).try_cast("long"), F.lit(0).cast("long"))
