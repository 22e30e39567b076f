"""Impact-ordered inverted index: postings, segments, vocabulary and document list."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impactrank.functions import text as T
from impactrank.shared import checkpointed, written

#: Docids of one body row, as a power of two: a term of any frequency is as many rows as it needs.
BODY_BITS = 20
#: Docids that a block knows of those before it.
TAIL = 4
#: The largest impact; a term frequency above it counts as this much.
MAX_IMPACT = 255


def doc_list(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(docid, docno)."""
    docid = F.col(id_col).cast("long")
    return documents.select(docid.alias("docid"), F.concat(F.lit("doc-"), docid.cast("string")).alias("docno"))


def term_frequencies(documents: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", pattern: str = T.TOKEN, stemmer: str = "-") -> DataFrame:
    """(term, docid, tf). ``terms``, if given, keeps only its ``term`` values, before anything is shuffled.

    Identical (document, term) pairs are counted map-side first, so a frequent term costs a row a document, not a row an occurrence.
    Stemmers of many steps run once a distinct term, and their stems are joined back.
    """
    late = stemmer in T.BY_VOCABULARY
    found = documents.select(F.col(id_col).cast("long").alias("docid"), F.explode(T.stemmed(T.tokens(F.col(text_col), pattern), "-" if late else stemmer)).alias("term"))
    if late:
        raw = found.groupBy("term", "docid").agg(F.count("*").alias("n"))
        stems = raw.select("term").distinct().select("term", F.explode(T.stemmed(F.array("term"), stemmer)).alias("stem"))
        found = raw.join(stems, "term").select("docid", F.col("stem").alias("term"), "n")
    else:
        found = found.withColumn("n", F.lit(1).cast("long"))
    if terms is not None:
        found = found.join(terms.select("term").distinct(), "term", "left_semi")
    return found.groupBy("term", "docid").agg(F.sum("n").alias("tf"))


_CELLS = "term string, tf long, block long, docids array<long>, lengths array<long>"


def _counted(cuts: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Terms of the documents of a batch, counted: a row for each term, frequency and block, with docids that rise and the lengths of these documents."""
    bounds = np.array(cuts, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docid, lists = np.asarray(batch["docid"], np.int64), batch["terms"]
            size = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            coded = lists.flatten().dictionary_encode()
            rising = np.argsort(docid, kind="stable")
            place = np.empty(len(docid), np.int64)
            place[rising] = np.arange(len(docid))
            docid, size, owner = docid[rising], size[rising], np.repeat(place, size)
            cell, tf = np.unique(np.asarray(coded.indices, np.int64) * max(1, len(docid)) + owner, return_counts=True)
            term, doc = np.divmod(cell, max(1, len(docid)))
            order = np.lexsort((doc, tf, term))
            term, doc, tf = term[order], doc[order], tf[order]
            block = np.searchsorted(bounds, docid, side="right")[doc]
            first = np.ones(len(term), bool)
            first[1:] = (term[1:] != term[:-1]) | (tf[1:] != tf[:-1]) | (block[1:] != block[:-1])
            first = np.flatnonzero(first)
            ends = pa.array(np.append(first, len(term)), pa.int32())
            for i in range(0, len(first), 1 << 16):
                own = first[i : i + (1 << 16)]
                arrays = [pa.ListArray.from_arrays(ends.slice(i, len(own) + 1), pa.array(x[doc], pa.int64())) for x in (docid, size)]
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(term[own])), pa.array(tf[own], pa.int64()), pa.array(block[own], pa.int64()), *arrays], ["term", "tf", "block", "docids", "lengths"])

    return run


def repeated_ids(documents: DataFrame, id_col: str = "doc_id") -> DataFrame | None:
    """(docid) of ids that several rows have, and the null one; None if there are none."""
    found = written(documents.select(F.col(id_col).cast("long").alias("docid")).groupBy("docid").agg(F.count("*").alias("n")).where("n > 1 OR docid IS NULL").select("docid"))
    return None if found.isEmpty() else found


def term_cells(documents: DataFrame, cuts: list[int], id_col: str = "doc_id", text_col: str = "text", pattern: str = T.TOKEN, stemmer: str = "-") -> DataFrame:
    """(term, tf, block, docids, lengths): term frequencies as arrays of documents, several rows a (term, tf, block).

    A document is one row, so its terms are counted where it is read, and no row of an occurrence or of a posting is shuffled. Only documents whose id
    comes more than once are counted across rows.
    """
    own = documents.select(F.col(id_col).cast("long").alias("docid"), F.col(text_col).alias("text"))
    again = repeated_ids(documents, id_col)
    alone = own if again is None else own.where("docid IS NOT NULL").join(again, "docid", "left_anti")
    cells = alone.select("docid", T.stemmed(T.tokens(F.col("text"), pattern), stemmer).alias("terms")).mapInArrow(_counted(cuts), _CELLS)
    if again is None:
        return cells
    shared = own.where("docid IS NOT NULL").join(again, "docid", "left_semi")
    tf = term_frequencies(shared, None, "docid", "text", pattern, stemmer)
    length = tf.groupBy("docid").agg(F.sum("tf").alias("dl"))
    rows = tf.join(length, "docid").select("term", "tf", block_of(F.col("docid"), cuts).alias("block"), F.array("docid").alias("docids"), F.array("dl").alias("lengths"))
    return cells.unionByName(rows)


def stem_vocabulary(documents: DataFrame, stemmer: str = "p", id_col: str = "doc_id", **options: str) -> DataFrame:
    """(term, df, cf) of stems, as ``term_frequencies`` of the stemmer summed up; documents without an id count as one.

    Terms are counted where a document is read and stemmed once a batch; the documents of a stem's terms meet as arrays, block by block, as several of the terms may be in one document.
    """
    cells = term_cells(documents, block_cuts(doc_list(documents, id_col)), id_col, **options)
    stems = cells.select(F.explode(T.stemmed(F.array("term"), stemmer)).alias("term"), "block", "docids", (F.col("tf") * F.size("docids")).alias("cf"))
    found = stems.repartition("term", "block").groupBy("term", "block").agg(F.size(F.array_distinct(F.flatten(F.collect_list("docids")))).cast("long").alias("df"), F.sum("cf").alias("cf"))
    unnamed = term_frequencies(documents.where(F.col(id_col).isNull()), None, id_col, stemmer=stemmer, **options)
    every = found.select("term", "df", "cf").unionByName(unnamed.select("term", F.lit(1).cast("long").alias("df"), F.col("tf").alias("cf")))
    return every.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def bodies_of(cells: DataFrame) -> DataFrame:
    """Bodies (term, impact, block, docids), docids rising, of rows (term, impact, block, docids) of which several may belong to a body. Rows are dealt as they are: counting them by task first would only sort them."""
    return cells.repartition("term", "impact", "block").groupBy("term", "impact", "block").agg(F.sort_array(F.flatten(F.collect_list("docids"))).alias("docids"))


def document_bodies(documents: DataFrame, cuts: list[int], **options: str) -> DataFrame:
    """Bodies of documents: as ``segment_postings`` of their ``postings``, in one exchange of arrays."""
    return bodies_of(term_cells(documents, cuts, **options).select("term", capped_impact(F.col("tf")).alias("impact"), "block", "docids"))


def capped_impact(tf: Column) -> Column:
    """Impacts are at least 1 and at most MAX_IMPACT."""
    return F.least(tf, F.lit(MAX_IMPACT)).cast("int")


def postings(documents: DataFrame, terms: DataFrame | None = None, **options: str) -> DataFrame:
    """(term, docid, impact)."""
    return term_frequencies(documents, terms, **options).select("term", "docid", capped_impact(F.col("tf")).alias("impact"))


def bm25_weights(documents: DataFrame, k1: float = 0.9, b: float = 0.4, **options: str) -> DataFrame:
    """(term, docid, weight), checkpointed."""
    tf = checkpointed(term_frequencies(documents, None, **options))
    length = tf.groupBy("docid").agg(F.sum("tf").alias("dl"))
    whole = length.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    own = _with_row(tf.join(length, "docid").join(df, "term"), whole)
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = _weight(idf, F.col("dl"), F.col("avgdl"), k1, b)
    return checkpointed(own.select("term", "docid", weight.alias("weight")))


def _weight(idf: Column, length: Column, mean: Column, k1: float, b: float) -> Column:
    """The weight of a term, ``tf`` times in a document."""
    return F.round(idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * length / mean)), 9)


def _by_impact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (term, block, docids, impacts) as rows of one impact each."""
    for batch in batches:
        size, ids, impact = np.asarray(batch["docids"].value_lengths(), np.int64), np.asarray(batch["docids"].flatten(), np.int64), np.asarray(batch["impacts"].flatten(), np.int64)
        key = np.repeat(np.arange(len(size)), size) * (MAX_IMPACT + 1) + impact
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        row, own = np.divmod(key[first], MAX_IMPACT + 1)
        docids = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(ids[order]))
        yield pa.RecordBatch.from_arrays([batch["term"].take(pa.array(row)), pa.array(own, pa.int32()), batch["block"].take(pa.array(row)), docids], ["term", "impact", "block", "docids"])


def weighted_bodies(documents: DataFrame, cuts: list[int], quantiles: bool = False, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """Bodies of documents with BM25 weights as impacts: as ``segment_postings`` of their ``bm25_postings``, from arrays of documents and their lengths.

    Weights are computed where they are needed, once for the cuts and once for the impacts, and kept nowhere.
    """
    cells = written(term_cells(documents, cuts), "cells")
    terms = T.tokens(F.col("text"))
    length = documents.groupBy(F.col("doc_id").cast("long")).agg(F.sum(F.size(terms)).alias("dl")).where("dl > 0")
    n, mean = length.agg(F.count("*"), F.avg("dl")).first()
    unnamed = documents.where("doc_id IS NULL").select(F.explode(terms).alias("term")).distinct()  # a document for the counts, though none to be found
    counts = cells.select("term", F.size("docids").alias("n")).unionByName(unnamed.withColumn("n", F.lit(1)))
    df = counts.groupBy("term").agg(F.sum("n").alias("df"))
    idf = df.select("term", F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    rows = cells.join(idf, "term").select("term", "block", "docids", F.transform("lengths", lambda dl: _weight(F.col("idf"), dl, F.lit(mean), k1, b)).alias("weights"))
    if quantiles:
        cut = _quantile_cuts(rows.select(F.explode("weights").alias("weight")), MAX_IMPACT, 10_000)
        impact = lambda w: _above(cut, w)
    else:
        low, high = rows.agg(F.min(F.array_min("weights")), F.max(F.array_max("weights"))).first()
        impact = lambda w: _level(w, F.lit(low), F.lit(high))
    found = rows.select("term", "block", "docids", F.transform("weights", impact).alias("impacts"))
    return bodies_of(found.mapInArrow(_by_impact, "term string, impact int, block long, docids array<long>"))


def linear_impacts(weights: DataFrame) -> DataFrame:
    """(term, docid, impact): weights cut into MAX_IMPACT steps of equal height over the whole collection."""
    span = weights.agg(F.min("weight").alias("low"), F.max("weight").alias("high"))
    return _with_row(weights, span).select("term", "docid", _level(F.col("weight"), F.col("low"), F.col("high")).alias("impact"))


def _level(weight: Column, low: Column, high: Column) -> Column:
    step = (weight - low) / F.greatest(high - low, F.lit(1e-12))
    return F.greatest(F.lit(1), F.ceil(F.round(step * MAX_IMPACT, 6)).cast("int"))


def quantile_impacts(weights: DataFrame, levels: int = MAX_IMPACT, accuracy: int = 10_000) -> DataFrame:
    """(term, docid, impact): weights cut into steps of equal numbers of postings, so that heavy tails don't leave most impacts unused.

    Cuts come from a sketch that tasks make of their rows and that are merged: the rank of a cut is off by at most a share of 1 / ``accuracy``
    of all postings. An impact is one more than the number of cuts below the weight, so equal weights have equal impacts. No weights give no rows.
    """
    cuts = _quantile_cuts(weights, levels, accuracy)
    return weights.select("term", "docid", _above(cuts, F.col("weight")).alias("impact"))


def _quantile_cuts(weights: DataFrame, levels: int, accuracy: int) -> list[float]:
    return weights.agg(F.percentile_approx("weight", [i / levels for i in range(1, levels)], accuracy).alias("cuts")).first()["cuts"] or []


def _above(cuts: list[float], weight: Column) -> Column:
    """One more than the number of cuts below a weight."""
    return (count_below(F.array(*map(F.lit, cuts)), len(cuts), weight) + 1).cast("int")


def bm25_postings(documents: DataFrame, k1: float = 0.9, b: float = 0.4, quantiles: bool = False, **options: str) -> DataFrame:
    """(term, docid, impact): BM25 weights as impacts, by equal steps or by equal numbers of postings."""
    weights = bm25_weights(documents, k1, b, **options)
    return quantile_impacts(weights) if quantiles else linear_impacts(weights)


def segments(posts: DataFrame) -> DataFrame:
    """Headers: (term, impact, freq)."""
    return posts.groupBy("term", "impact").agg(F.count("*").alias("freq"))


def block_cuts(docs: DataFrame) -> list[int]:
    """The docids at which blocks begin, but for the first: every 2**BODY_BITS-th of all, by exact rank, so that blocks are full whatever the ids are.

    Ids are sorted by range and counted by partition; the driver gets a number for each partition and for each block, a millionth of the documents.
    """
    size = 1 << BODY_BITS
    if docs.count() <= size:
        return []
    ranged = checkpointed(docs.select("docid").where("docid IS NOT NULL").distinct().repartitionByRange("docid").sortWithinPartitions("docid").withColumn("at", F.monotonically_increasing_id()))
    own = ranged.select("docid", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    counts = sorted(tuple(r) for r in own.groupBy("part").count().collect())
    starts = [(part, sum(n for _, n in counts[:i])) for i, (part, _) in enumerate(counts)]
    begins = docs.sparkSession.createDataFrame(starts, "part long, start long")
    rank = F.col("start") + F.col("place")
    return sorted(r[0] for r in own.join(F.broadcast(begins), "part").where((rank % size == 0) & (rank > 0)).select("docid").collect())


def block_of(docid: Column, cuts: list[int] | None) -> Column:
    """The block of a docid: how many cuts it has reached, by halving; without a list of cuts, its bits above the lowest BODY_BITS."""
    if cuts is None:
        return F.shiftright(docid, BODY_BITS)
    if not cuts:
        return F.lit(0).cast("long")
    listed = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    return count_below(listed, len(cuts), docid, equal=True).cast("long")


def count_below(cuts: Column, n: int, value: Column, equal: bool = False) -> Column:
    """How many of ``n`` rising cuts lie below a value, or are equal to it where that counts; found by halving."""
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(n.bit_length()))))
    reached = lambda cut: cut <= value if equal else cut < value
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(reached(F.try_element_at(cuts, low + step)), low + step).otherwise(low)) if n else F.lit(0)


def segment_postings(posts: DataFrame, cuts: list[int] | None = None) -> DataFrame:
    """Bodies: (term, impact, block, docids), docids rising; a row holds the docids of one block of at most 2**BODY_BITS documents, so a frequent term meets in no one task."""
    own = posts.withColumn("block", block_of(F.col("docid"), cuts))
    return own.repartition("term", "impact", "block").groupBy("term", "impact", "block").agg(F.sort_array(F.collect_list("docid")).alias("docids"))


def with_heads(bodies: DataFrame) -> DataFrame:
    """Bodies with pos, how many postings of the segment come before the block, and before, the last ``TAIL`` docids there. Only a few numbers of each block are ordered by segment, and only blocks after the first meet them again."""
    own = Window.partitionBy("term", "impact").orderBy("block")
    tails = bodies.select("term", "impact", "block", F.size("docids").cast("long").alias("n"), F.slice("docids", F.greatest(F.lit(1), F.size("docids") - TAIL + 1), TAIL).alias("tail"))
    last = F.flatten(F.collect_list("tail").over(own.rowsBetween(-TAIL, -1)))
    heads = tails.select("term", "impact", "block", F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)).alias("pos"), F.slice(last, F.greatest(F.lit(1), F.size(last) - TAIL + 1), TAIL).alias("before"))
    joined = bodies.join(heads.where(F.col("pos") > 0), ["term", "impact", "block"], "left")
    return joined.withColumns({"pos": F.coalesce("pos", F.lit(0)), "before": F.coalesce("before", F.array().cast("array<bigint>"))})


def vocabulary(heads: DataFrame) -> DataFrame:
    """(term, df, cf, n_segments, max_impact) from segment headers; cf counts capped impacts."""
    return heads.groupBy("term").agg(F.sum("freq").alias("df"), F.sum(F.col("freq") * F.col("impact")).alias("cf"), F.count("*").alias("n_segments"), F.max("impact").alias("max_impact"))


def _with_row(rows: DataFrame, one: DataFrame) -> DataFrame:
    """Rows with the columns of a frame that is one row by its making, an aggregate without keys."""
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one").drop("_one")


def totals(heads: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: terms, postings, segments, max_impact, docs, max_docid."""
    own = heads.agg(F.countDistinct("term").alias("terms"), F.sum("freq").alias("postings"), F.count("*").alias("segments"), F.max("impact").alias("max_impact"))
    return _with_row(own, docs.agg(F.count("*").alias("docs"), F.max("docid").alias("max_docid")))


def without_metadata(heads: DataFrame) -> DataFrame:
    """Segments of terms that sort before '~', the first byte of metadata terms."""
    return heads.where(F.col("term") < "~")


@dataclass
class Index:
    """Headers, postings rows, the document list and, where the index is stored, bodies as docid arrays."""

    heads: DataFrame
    posts: DataFrame
    docs: DataFrame
    bodies: DataFrame | None = None
    cuts: list[int] | None = None

    def arrays(self) -> DataFrame:
        """(term, impact, block, docids)."""
        return segment_postings(self.posts, block_cuts(self.docs)) if self.bodies is None else self.bodies

    @staticmethod
    def of_bodies(bodies: DataFrame, docs: DataFrame, cuts: list[int]) -> Index:
        posts = bodies.select("term", "impact", F.explode("docids").alias("docid"))
        heads = bodies.groupBy("term", "impact").agg(F.sum(F.size("docids").cast("long")).alias("freq"))
        return Index(heads, posts, docs, bodies, cuts)

    @staticmethod
    def whole(documents: DataFrame, **options: str) -> Index:
        """All documents, to be stored: bodies in one exchange."""
        docs = doc_list(documents)
        cuts = block_cuts(docs)
        return Index.of_bodies(document_bodies(documents, cuts, **options), docs, cuts)

    @staticmethod
    def weighted(documents: DataFrame, quantiles: bool = False) -> Index:
        """All documents with BM25 weights as impacts, to be stored."""
        docs = doc_list(documents)
        cuts = block_cuts(docs)
        return Index.of_bodies(weighted_bodies(documents, cuts, quantiles), docs, cuts)

    @staticmethod
    def over(documents: DataFrame, terms: DataFrame | None = None, **options: str) -> Index:
        posts = postings(documents, terms, **options)
        return Index(segments(posts), posts, doc_list(documents))
