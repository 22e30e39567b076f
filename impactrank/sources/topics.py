"""Query files and topic files as DataFrames, and query lines back to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from impactrank.functions import text as T

#: Tag letters of a topic file and the columns that they choose.
TAGS = {"t": "title", "d": "description", "n": "narrative", "q": "query"}


def query_terms(lines: DataFrame, column: str = "value") -> DataFrame:
    """(query_id, term_pos, term) from lines of an id and terms. Blank lines are skipped; an id that is no number is 0."""
    parts = lines.where(F.trim(F.regexp_replace(F.col(column), r"\s", " ")) != "").select(T.words(F.col(column)).alias("w"))
    return parts.select(T.parse_long(F.col("w")[0]).alias("query_id"), F.posexplode(F.slice("w", F.lit(2), F.size("w"))).alias("term_pos", "term")).withColumn("term_pos", F.col("term_pos").cast("int"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return query_terms(spark.read.text(path))


def read_term_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct terms of a query file, to restrict an index to."""
    return read_queries(spark, path).select("term").distinct()


def read_sgml_topics(spark: SparkSession, path: str) -> DataFrame:
    """(number, title, description, narrative) of <top> records whose inner tags are not closed."""
    raw = spark.read.option("lineSep", "</top>").text(path)
    part = lambda tag, label="": F.trim(F.regexp_replace(F.regexp_extract("value", rf"(?is)<{tag}>\s*{label}(.*?)(?=<(?:num|title|desc|narr)>|\z)", 1), r"\s+", " "))
    number = F.regexp_extract("value", r"(?is)<num>\s*(?:Number:)?\s*(\d+)", 1)
    found = raw.select(number.try_cast("long").alias("number"), part("title").alias("title"), part("desc", "(?:Description:)?").alias("description"), part("narr", "(?:Narrative:)?").alias("narrative"))
    return found.where("number is not null")


XML_TOPIC = "_number long, _type string, query string, description string, subtopic array<struct<_VALUE: string, _number: long, _type: string>>"


def read_xml_topics(spark: SparkSession, path: str) -> DataFrame:
    """(number, type, query, description, subtopics) of <topic> records; any type is taken, subtopics may be missing."""
    raw = spark.read.format("xml").option("rowTag", "topic").schema(XML_TOPIC).load(path)
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    subtopics = F.transform(F.coalesce("subtopic", F.array().cast("array<struct<_VALUE: string, _number: bigint, _type: string>>")), lambda s: F.struct(s["_number"].alias("number"), s["_type"].alias("type"), clean(s["_VALUE"]).alias("text")))
    return raw.select(F.col("_number").alias("number"), F.col("_type").alias("type"), clean(F.col("query")).alias("query"), clean(F.col("description")).alias("description"), subtopics.alias("subtopics"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A topic file as plain lines, no tags parsed."""
    return spark.read.text(path)


def chosen_text(topics: DataFrame, tags: str) -> Column:
    """The text of the chosen tags, those that the topics have, in their order."""
    return F.concat_ws(" ", *(TAGS[t] for t in tags if TAGS[t] in topics.columns))


def topic_queries(topics: DataFrame, tags: str = "t", stemmer: str = "s") -> DataFrame:
    """(query_id, terms) from a topic's chosen text."""
    return topics.select(F.col("number").alias("query_id"), T.stemmed(T.tokens(chosen_text(topics, tags)), stemmer).alias("terms"))


def query_lines(queries: DataFrame) -> DataFrame:
    """One text column ``value``: id and terms, a blank between."""
    return queries.select(F.concat_ws(" ", F.col("query_id").cast("string"), "terms").alias("value"))


def write_queries(queries: DataFrame, path: str) -> None:
    query_lines(queries).write.mode("overwrite").text(path)
