"""A stored index that grows: documents are added, replaced and taken out without rebuilding what is there.

An index is a list of generations, each an index of its own folder with the documents that came at once. Taking a document out (also by replacing
it) writes its docid to the generation at hand, which hides it in all earlier ones, and what each of their segment headers loses by it. So headers
are sums over generations, and postings are read from all of them less the hidden ones. Generations of like size are merged, so there are few.

Every change writes new folders and then a new list under the next number; a reader takes the last list, so a change that breaks off changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactrank.operators.index import Index, doc_list, segments
from impactrank.shared import written

from .indexio import postings_of, read_index, write_index

#: A generation is merged into the one before it unless that one is so many times as large.
TIER = 4
_LIST = "number long, folder string, postings long, hides boolean"


@dataclass
class Generation:
    number: int
    folder: str
    postings: int
    #: Whether it hides documents of earlier ones.
    hides: bool


def _generations(spark: SparkSession, path: str) -> tuple[int, list[Generation]]:
    """The number of the last list, 0 if there is none, and its generations, oldest first."""
    try:
        rows = spark.read.parquet(f"{path}/lists").collect()
    except AnalysisException:
        return 0, []
    last = max(r.list for r in rows)
    return last, sorted((Generation(r.number, r.folder, r.postings, r.hides) for r in rows if r.list == last), key=lambda g: g.number)


def _listed(spark: SparkSession, path: str, list_number: int, generations: list[Generation]) -> None:
    rows = [(g.number, g.folder, g.postings, g.hides) for g in generations]
    spark.createDataFrame(rows, _LIST).coalesce(1).write.parquet(f"{path}/lists/list={list_number}")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _live(spark: SparkSession, path: str, generations: list[Generation], qterms: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, documents and headers of generations, each with its ``generation``; postings and documents without hidden ones, headers as parts to sum up."""
    posts, docs, heads, hidden = [], [], [], []
    for g in generations:
        own = read_index(spark, f"{path}/{g.folder}/index", qterms)
        tag = F.lit(g.number).cast("long").alias("generation")
        posts.append(own.posts.select("*", tag))
        docs.append(own.docs.select("*", tag))
        heads.append(own.heads.select("term", "impact", "freq", tag))
        if g.hides:
            hidden.append(spark.read.parquet(f"{path}/{g.folder}/hidden").select(F.col("docid").alias("gone"), F.lit(g.number).cast("long").alias("since")))
            lost = spark.read.parquet(f"{path}/{g.folder}/lost")
            heads.append(lost if qterms is None else lost.join(qterms.select("term").distinct(), "term", "left_semi"))
    every, all_docs = _union(posts), _union(docs)
    if hidden:
        # a document may be hidden more than once; the last time counts
        gone = _union(hidden).groupBy("gone").agg(F.max("since").alias("since"))
        here = (F.col("docid") == F.col("gone")) & (F.col("generation") < F.col("since"))
        every, all_docs = every.join(gone, here, "left_anti"), all_docs.join(gone, here, "left_anti")
    return every, all_docs, _union(heads)


def read_grown(spark: SparkSession, path: str, qterms: DataFrame | None = None) -> Index:
    """The index as it stands, or what a query batch needs of it."""
    _, generations = _generations(spark, path)
    posts, docs, heads = _live(spark, path, generations, qterms)
    summed = heads.groupBy("term", "impact").agg(F.sum("freq").alias("freq")).where(F.col("freq") > 0)
    return Index(summed, posts.drop("generation"), docs.drop("generation"))


def change(spark: SparkSession, path: str, documents: DataFrame | None = None, taken_out: DataFrame | None = None, merge: bool = True, **options: str) -> None:
    """Add documents, in place of those of their ids, and take out others by ``docid``. Ids that are not there hide nothing."""
    number, generations = _generations(spark, path)
    number += 1
    folder = f"{path}/generation-{number}"
    none = spark.createDataFrame([], "doc_id long, text string")
    added = documents if documents is not None else none
    docs = doc_list(added)
    write_index(Index.whole(added, **options), f"{folder}/index")
    if generations:
        gone = docs.select("docid") if taken_out is None else docs.select("docid").union(taken_out.select(F.col("docid").cast("long")))
        every, all_docs, _ = _live(spark, path, generations, None)
        hidden = written(all_docs.join(gone.distinct(), "docid", "left_semi").select("docid").distinct())
        hidden.write.parquet(f"{folder}/hidden")
        lost = every.join(hidden, "docid", "left_semi").groupBy("term", "impact", "generation").agg((-F.count("*")).alias("freq"))
        lost.select("term", "impact", "freq", "generation").write.parquet(f"{folder}/lost")
    size = postings_of(spark, f"{folder}/index")
    hides = bool(generations) and not spark.read.parquet(f"{folder}/hidden").isEmpty()
    generations.append(Generation(number, f"generation-{number}", size, hides))
    _listed(spark, path, number, generations)
    if merge:
        merge_tiers(spark, path)


def merge_tiers(spark: SparkSession, path: str, tier: int = TIER) -> None:
    """Merge the newest generations as long as the one before them is less than ``tier`` times their size."""
    list_number, generations = _generations(spark, path)
    begin, size = len(generations) - 1, generations[-1].postings if generations else 0
    while begin > 0 and generations[begin - 1].postings < tier * max(1, size):
        begin -= 1
        size += generations[begin].postings
    merged = generations[begin:]
    if len(merged) < 2:
        return
    number, earlier = merged[-1].number, merged[0].number
    folder = f"generation-{number}-from-{earlier}"
    posts, docs, _ = _live(spark, path, merged, None)
    kept = posts.drop("generation")
    write_index(Index(segments(kept), kept, docs.drop("generation")), f"{path}/{folder}/index")
    hiding = [g for g in merged if g.hides]
    if begin and hiding:  # what they hide in generations before all of them stays hidden
        _union([spark.read.parquet(f"{path}/{g.folder}/hidden") for g in hiding]).distinct().write.parquet(f"{path}/{folder}/hidden")
        _union([spark.read.parquet(f"{path}/{g.folder}/lost") for g in hiding]).where(F.col("generation") < earlier).write.parquet(f"{path}/{folder}/lost")
    size = postings_of(spark, f"{path}/{folder}/index")
    _listed(spark, path, list_number + 1, [*generations[:begin], Generation(number, folder, size, bool(begin and hiding))])
