from impactrank.operators.index import Index
from impactrank.operators.rank import rank
from impactrank.sources.views import register_views


def test_ranking_in_sql_equals_the_operator(spark, sf_dir):
    """With a budget, without one, and for terms that come twice or not at all."""
    index = Index.over(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    terms = spark.createDataFrame([(1, 0, "the"), (1, 1, "of"), (1, 2, "the"), (2, 0, "zzzq"), (3, 0, "de"), (3, 1, "zzzq")], "query_id long, term_pos int, term string")
    register_views(spark, index, terms)
    for budget, k in ((None, 5), (300, 3), (0, 3)):
        got = spark.sql(f"SELECT query_id, docid, rsv, rank FROM rank_queries({k}, {'NULL' if budget is None else budget})").collect()
        want = rank(terms, index, k, budget, "exhaustive" if budget is None else "anytime").select("query_id", "docid", "rsv", "rank").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
