"""Ranking from SQL: an index and a batch of queries as views, and a table function over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from impactrank.operators.index import Index
from impactrank.operators.scoring import SENT_SEGMENTS

#: rank_queries(k, budget): the k best documents of each query; a null budget takes all segments.
_FUNCTION = """
CREATE OR REPLACE TEMPORARY FUNCTION rank_queries(k INT, budget BIGINT)
RETURNS TABLE (query_id BIGINT, docid BIGINT, rsv BIGINT, rank INT)
RETURN
  WITH ordered AS (
    SELECT q.query_id, q.term, s.impact, sum(s.freq) OVER (PARTITION BY q.query_id ORDER BY s.impact DESC, s.freq, q.term_pos ROWS UNBOUNDED PRECEDING) AS taken
    FROM query_terms q JOIN index_segments s ON q.term = s.term),
  chosen AS (SELECT query_id, term, impact, count(*) AS times FROM ordered WHERE rank_queries.budget IS NULL OR taken <= rank_queries.budget GROUP BY query_id, term, impact),
  hits AS (SELECT {hint} c.query_id, b.impact * c.times AS gain, explode(b.docids) AS docid FROM index_bodies b JOIN chosen c ON b.term = c.term AND b.impact = c.impact),
  scores AS (SELECT query_id, docid, sum(gain) AS rsv FROM hits GROUP BY query_id, docid)
  SELECT query_id, docid, rsv, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rsv DESC, docid DESC) AS rank FROM scores) WHERE rank <= rank_queries.k
"""


def register_views(spark: SparkSession, index: Index, qterms: DataFrame) -> None:
    """Views query_terms(query_id, term_pos, term), index_segments(term, impact, freq), index_bodies(term, impact, block, docids) and index_documents(docid, docno), and the function rank_queries over them."""
    qterms.createOrReplaceTempView("query_terms")
    index.heads.createOrReplaceTempView("index_segments")
    index.arrays().select("term", "impact", "block", "docids").createOrReplaceTempView("index_bodies")
    index.docs.createOrReplaceTempView("index_documents")
    # the most segments that a budget can choose: if few, they go to the bodies, which then needn't be shuffled to meet them
    few = qterms.join(index.heads, "term").count() <= SENT_SEGMENTS
    spark.sql(_FUNCTION.format(hint="/*+ BROADCAST(c) */" if few else ""))
