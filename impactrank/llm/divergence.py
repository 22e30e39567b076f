"""Source divergence audit: how the sources of a language differ in their words, term by term.

Each term of a language is one wide row, an array with a place for each source. JVM higher-order functions turn an array into the
contributions of pairs of sources, which are summed map-side by pair; nothing but sums by (language, pair) travels.

Odd input: null text, language or source counts as ''. A group without terms gives zero counts. Without kept terms (V = 0) every
pair of a language's sources differs by 0 and no term is listed. A language of one source has no pairs. Each row is a document, so
repeated rows count again. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: A term is kept if so many documents of its language hold it.
MIN_DOCUMENTS = 30
#: Terms listed for a group.
LISTED = 50
#: Shares are whole numbers of this scale, over counts raised by the smoothing.
SCALE, SMOOTH = 1_000_000_000, 5
#: Terms and groups that a task holds before it sends its counts on.
HELD = 200_000
#: Groups that one broadcast may hold (some 40 bytes each); beyond, the arrays of a language are joined by shuffle.
BROADCAST_GROUPS = 100_000
#: All bytes but A-Z, a-z and those of characters beyond ASCII stand between terms.
_BLANKED = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's texts, summed within the task until it holds ``HELD`` entries."""
    total: dict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in total.items():
            terms = list(own)
            columns = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([own[t] for t in terms], pa.int64()), pa.array([docs[lang, source][t] for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=_COUNTS)
        total.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
            found = text.translate(_BLANKED).split()
            total[lang, source].update(found)
            docs[lang, source].update(set(found))
        if sum(map(len, total.values())) > HELD:
            yield from sent()
    yield from sent()


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group, as partial sums of tasks."""
    named = documents.select(*(F.coalesce(documents[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return named.mapInArrow(_count, "lang string, source string, term string, n long, docs long")


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept)), in decimals that no count overflows."""
    above = (count + F.lit(SMOOTH)).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = total.cast("decimal(20,0)") + kept.cast("decimal(15,0)") * F.lit(SMOOTH).cast("decimal(1,0)")
    return F.call_function("div", above, below) + F.lit(1).cast("long")


def source_divergence(documents: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` sums over kept terms how far the shares of two sources lie apart, for
    every other source; part ``term`` lists the terms that a source has more of than its language, at most ``LISTED``.

    The rows of part ``pair`` are as many as a language's ordered pairs of sources, and so are the sums that tasks hold.
    """
    counts = term_counts(documents).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("found"))
    kept = checkpointed(by_term.where(F.col("docs") >= MIN_DOCUMENTS).drop("docs"))
    langs = checkpointed(_languages(documents, kept))
    few = (langs.agg(F.sum(F.size("sources"))).first()[0] or 0) <= BROADCAST_GROUPS
    beside = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    wide = kept.join(beside(langs), "lang").select("lang", "term", "sources", "totals", "n_kept", "n_lang", F.transform("sources", lambda s: F.coalesce(F.try_element_at("found", s), F.lit(0).cast("long"))).alias("n"))
    shares = wide.select(
        "lang",
        "term",
        "sources",
        "n",
        F.zip_with("n", "totals", lambda n, total: _share(n, total, F.col("n_kept"))).alias("p"),
        _share(F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b), F.col("n_lang"), F.col("n_kept")).alias("q"),
    )
    return _pairs(shares, langs, beside).unionByName(_terms(shares))


def _languages(documents: DataFrame, kept: DataFrame) -> DataFrame:
    """A row a language: its sources in order with the occurrences of kept terms in each, those in all, and the number of kept terms."""
    groups = documents.select(*(F.coalesce(documents[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    own = kept.select("lang", F.explode("found").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    n_kept = kept.groupBy("lang").agg(F.count("*").alias("n_kept"))
    listed = groups.join(own, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0).cast("long")).alias("n")))).alias("held"), F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n_lang"))
    return listed.join(n_kept, "lang", "left").select("lang", F.col("held.source").alias("sources"), F.col("held.n").alias("totals"), F.coalesce("n_kept", F.lit(0).cast("long")).alias("n_kept"), "n_lang")


def _pairs(shares: DataFrame, langs: DataFrame, beside) -> DataFrame:
    """Part ``pair``. Each term gives a row a source, then one for each later source; the zeros of ``langs`` name all pairs, also where no term is kept."""
    later = lambda p, i: F.slice(p, i + 2, F.greatest(F.size(p) - i - 1, F.lit(0)))
    first = shares.select("lang", "p", F.posexplode("p").alias("i", "own"))
    each = first.select("lang", "i", F.posexplode(F.transform(later(F.col("p"), F.col("i")), lambda q: F.abs(F.col("own") - q))).alias("k", "value"))
    none = langs.select("lang", "sources", F.posexplode("sources").alias("i", "_own")).select("lang", "i", F.posexplode(F.transform(later(F.col("sources"), F.col("i")), lambda _: F.lit(0).cast("long"))).alias("k", "value"))
    summed = each.unionByName(none).groupBy("lang", "i", "k").agg(F.sum("value").alias("value"))
    at = lambda place: F.element_at("sources", place)
    named = summed.join(beside(langs.select("lang", "sources")), "lang").select("lang", at(F.col("i") + 1).alias("a"), at(F.col("i") + F.col("k") + 2).alias("b"), "value")
    sides = named.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("side"), "value")
    rows = sides.select("lang", "side.source", F.lit("pair").alias("part"), "side.item", "value")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def _terms(shares: DataFrame) -> DataFrame:
    """Part ``term``: only a group's best are sent on by each task, as the rank is cut to a constant."""
    each = shares.select("lang", "term", "q", F.explode(F.arrays_zip("sources", "n", "p")).alias("own"))
    more = each.where("own.n > 0 AND own.p > q").select("lang", F.col("own.sources").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("own.p") - F.col("q")).alias("value"))
    return more.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= LISTED)
