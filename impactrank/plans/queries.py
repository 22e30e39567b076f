"""The registered queries of the ranked-retrieval engine, each with its DuckDB equivalent.

Queries that rank read a stored index: it is written to the shared folder once for a session and a corpus, and each batch reads
what its terms need of it. Queries that show how an index is made compute it from the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactrank.functions import codecs, mathx
from impactrank.functions import text as T
from impactrank.operators import gaps as G
from impactrank.operators import index as I
from impactrank.operators import rank as R
from impactrank.operators import stats as S
from impactrank.shared import fresh_path
from impactrank.sources import growth, indexio, runs, topics, views
from impactrank.sources.topics import query_lines

#: Query lines besides those from the benchmark: repeated terms, unknown terms alone, and known and unknown ones.
LINES = {100001: "to be or not to be that i the question", 100002: "zzzq qqqz", 100003: "the zzzq of"}
SMALL, MEDIUM, HUGE = 200, 2000, 2_000_000_000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_TOK = "regexp_extract_all(lower(text), '[a-z]+|[0-9]+')"
_LINES_SQL = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS query_id, string_split('{line}', ' ') AS terms" for i, line in LINES.items())
_STEM = "CASE WHEN {t} LIKE '%ies' THEN left({t}, length({t}) - 3) || 'y' WHEN {t} LIKE '%es' THEN left({t}, length({t}) - 2) WHEN {t} LIKE '%s' THEN left({t}, length({t}) - 1) ELSE {t} END"
_BASE = f"""
tok AS (SELECT doc_id AS docid, unnest({_TOK}) AS term FROM documents),
post AS (SELECT term, docid, CAST(least(count(*), 255) AS INTEGER) AS impact FROM tok GROUP BY term, docid),
seg AS (SELECT term, impact, count(*) AS freq FROM post GROUP BY term, impact),
vocab AS (SELECT term, CAST(sum(freq) AS BIGINT) AS df, CAST(sum(freq * impact) AS BIGINT) AS cf, count(*) AS n_segments, max(impact) AS max_impact FROM seg GROUP BY term),
lines AS (SELECT item_id AS query_id, {_TOK} AS terms FROM benchmark UNION ALL {_LINES_SQL}),
q AS (SELECT query_id, CAST(generate_subscripts(terms, 1) - 1 AS INTEGER) AS term_pos, unnest(terms) AS term FROM lines),
plan AS (SELECT q.query_id, q.term_pos, q.term, seg.impact, seg.freq,
  row_number() OVER w AS seq, CAST(sum(seg.freq) OVER (PARTITION BY q.query_id ORDER BY seg.impact DESC, seg.freq, q.term_pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_freq
  FROM q JOIN seg ON q.term = seg.term WINDOW w AS (PARTITION BY q.query_id ORDER BY seg.impact DESC, seg.freq, q.term_pos))"""


def _scores(where: str = "") -> str:
    return f"(SELECT p.query_id, post.docid, CAST(sum(p.impact) AS BIGINT) AS rsv FROM plan p JOIN post ON p.term = post.term AND p.impact = post.impact {where} GROUP BY p.query_id, post.docid)"


def _ranked(where: str = "") -> str:
    return f"(SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rsv DESC, docid DESC) AS INTEGER) AS rank FROM {_scores(where)})"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name; ``sql`` follows the shared WITH list."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {_BASE} {sql}"
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, terms) of all queries."""
    own = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.tokens(F.col("text")).alias("terms"))
    more = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("query_id"), F.split(F.lit(line), " ").alias("terms")) for i, line in LINES.items()))).alias("q")).select("q.*")
    return own.unionByName(more)


def qterms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_lines(spark, sf_dir).select("query_id", F.posexplode("terms").alias("term_pos", "term"))


def one_query(spark: SparkSession, query_id: int) -> DataFrame:
    """The terms of one of ``LINES``."""
    return topics.query_terms(spark.range(1).select(F.lit(f"{query_id} {LINES[query_id]}").alias("value")))


#: Where the indexes of this process stand: by application, corpus and kind.
_STORED: dict[tuple[str, str, str], str] = {}


def index_path(spark: SparkSession, sf_dir: str, kind: str = "frequency") -> str:
    """The stored index of a corpus, written at the first call."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _STORED:
        docs = documents(spark, sf_dir)
        path = fresh_path(spark, f"index-{kind}")
        indexio.write_index(I.Index.whole(docs) if kind == "frequency" else I.Index.weighted(docs, kind == "bm25-quantiles"), path)
        _STORED[key] = path
    return _STORED[key]


def stored(spark: SparkSession, sf_dir: str, terms: DataFrame | None = None, kind: str = "frequency") -> I.Index:
    return indexio.read_index(spark, index_path(spark, sf_dir, kind), terms)


def prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, I.Index]:
    """The queries and the part of the stored index that they need."""
    terms = qterms(spark, sf_dir)
    return terms, stored(spark, sf_dir, terms)


@query("SELECT doc_id AS docid, 'doc-' || doc_id AS docno FROM documents")
def doc_list(spark, sf_dir):
    return I.doc_list(documents(spark, sf_dir))


@query("SELECT * FROM post")
def postings(spark, sf_dir):
    return I.postings(documents(spark, sf_dir))


@query("SELECT * FROM seg")
def segments(spark, sf_dir):
    return I.segments(I.postings(documents(spark, sf_dir)))


@query("SELECT term, impact, docid FROM post")
def segment_docids(spark, sf_dir):
    return I.segment_postings(I.postings(documents(spark, sf_dir))).select("term", "impact", F.explode("docids").alias("docid"))


@query("SELECT * FROM vocab")
def vocab_stats(spark, sf_dir):
    return I.vocabulary(segments(spark, sf_dir))


@query("SELECT (SELECT count(*) FROM vocab) AS terms, (SELECT CAST(sum(freq) AS BIGINT) FROM seg) AS postings, (SELECT count(*) FROM seg) AS segments, (SELECT max(impact) FROM seg) AS max_impact, count(*) AS docs, max(doc_id) AS max_docid FROM documents")
def index_totals(spark, sf_dir):
    return I.totals(segments(spark, sf_dir), I.doc_list(documents(spark, sf_dir)))


@query("SELECT * FROM vocab WHERE term IN (SELECT term FROM q)")
def vocab_restricted(spark, sf_dir):
    _, index = prepared(spark, sf_dir)
    return I.vocabulary(index.heads)


@query("SELECT * FROM vocab WHERE term < '~'")
def vocab_metadata_cut(spark, sf_dir):
    return I.vocabulary(I.without_metadata(segments(spark, sf_dir)))


@query(r", utok AS (SELECT doc_id AS docid, unnest(regexp_extract_all(lower(text), '\p{L}+|[0-9]+')) AS term FROM documents) SELECT term, count(DISTINCT docid) AS df, count(*) AS cf FROM utok GROUP BY term")
def vocab_unicode(spark, sf_dir):
    tf = I.term_frequencies(documents(spark, sf_dir), pattern=T.UNICODE_TOKEN)
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f", stems AS (SELECT docid, {_STEM.format(t='term')} AS stem FROM tok) SELECT stem AS term, count(DISTINCT docid) AS df, count(*) AS cf FROM stems WHERE stem <> '' GROUP BY stem")
def vocab_stemmed(spark, sf_dir):
    tf = I.term_frequencies(documents(spark, sf_dir), stemmer="s")
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query()
def vocab_suffixes(spark, sf_dir):
    """Terms stemmed by a machine of suffix rules, which SQL has no words for."""
    return I.stem_vocabulary(documents(spark, sf_dir), "p")


@query("SELECT * FROM q")
def query_terms(spark, sf_dir):
    return qterms(spark, sf_dir)


@query(f", t AS (SELECT item_id, unnest({_TOK}) AS raw FROM benchmark), s AS (SELECT item_id, {_STEM.format(t='raw')} AS stem FROM t) SELECT item_id AS query_id, stem AS term, count(*) AS n FROM s WHERE stem <> '' GROUP BY item_id, stem")
def stemmed_tokens(spark, sf_dir):
    own = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.stemmed(T.tokens(F.col("text")))).alias("term"))
    return own.groupBy("query_id", "term").agg(F.count("*").alias("n"))


@query("SELECT query_id || ' ' || array_to_string(terms, ' ') AS value FROM lines")
def query_file(spark, sf_dir):
    return query_lines(all_lines(spark, sf_dir))


@query("SELECT q.query_id, q.term_pos, q.term, df, n_segments, max_impact FROM q JOIN vocab USING (term)")
def term_lookup(spark, sf_dir):
    terms, index = prepared(spark, sf_dir)
    return R.term_lookup(terms, I.vocabulary(index.heads))


@query("SELECT query_id, term_pos, term FROM q WHERE term NOT IN (SELECT term FROM vocab)")
def oov_terms(spark, sf_dir):
    terms, index = prepared(spark, sf_dir)
    return R.unknown_terms(terms, I.vocabulary(index.heads))


@query("SELECT query_id, term_pos, term, impact, freq, CAST(seq AS INTEGER) AS seq, cum_freq FROM plan")
def segment_plan(spark, sf_dir):
    terms, index = prepared(spark, sf_dir)
    return R.segment_plan(terms, index.heads)


_BOUNDS = """, b AS (SELECT *, coalesce(lead(impact) OVER t, 0) AS next_impact, CASE WHEN row_number() OVER t = 1 THEN impact ELSE 0 END AS top
  FROM plan WINDOW t AS (PARTITION BY query_id, term_pos ORDER BY impact DESC)),
bounds AS (SELECT query_id, term_pos, term, impact, freq, CAST(seq AS INTEGER) AS seq, cum_freq, next_impact,
  CAST(sum(top) OVER (PARTITION BY query_id) + sum(next_impact - impact) OVER (PARTITION BY query_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS remaining FROM b)"""


@query(f"{_BOUNDS} SELECT * FROM bounds")
def segment_plan_bounds(spark, sf_dir):
    terms, index = prepared(spark, sf_dir)
    return R.with_bounds(R.segment_plan(terms, index.heads))


def _selection(budget: int) -> Query:
    def run(spark, sf_dir):
        terms, index = prepared(spark, sf_dir)
        return S.query_stats(R.within_budget(R.segment_plan(terms, index.heads), budget))

    return run


def _anytime(budget: int) -> Query:
    def run(spark, sf_dir):
        terms, index = prepared(spark, sf_dir)
        return R.rank(terms, index, 10, budget, "anytime")

    return run


for _name, _budget in (("small", SMALL), ("medium", MEDIUM), ("huge", HUGE)):
    for _kind, _make, _sql in (
        ("budget_selection", _selection, f"SELECT query_id, count(*) AS segments_processed, CAST(sum(freq) AS BIGINT) AS postings_processed FROM plan WHERE cum_freq <= {_budget} GROUP BY query_id"),
        ("rank_anytime", _anytime, f"SELECT * FROM {_ranked(f'WHERE p.cum_freq <= {_budget}')} WHERE rank <= 10"),
    ):
        _f = _make(_budget)
        _f.__name__ = f"{_kind}_{_name}"
        query(_sql)(_f)


@query(f"SELECT * FROM {_ranked()} WHERE rank <= 10")
def rank_exhaustive(spark, sf_dir):
    terms, index = prepared(spark, sf_dir)
    return R.rank(terms, index, 10)


@query(f"SELECT query_id, docid, 'doc-' || docid AS docno, rank, rsv FROM {_ranked()} WHERE rank <= 10")
def rank_named(spark, sf_dir):
    terms, index = prepared(spark, sf_dir)
    return R.named(R.rank(terms, index, 10), index.docs)


@query(f"SELECT * FROM {_ranked('WHERE p.query_id = 100001')} WHERE rank <= 25")
def rank_duplicate_terms(spark, sf_dir):
    terms = one_query(spark, 100001)
    return R.rank(terms, stored(spark, sf_dir, terms), 25)


@query(f"SELECT * FROM {_ranked()} WHERE rank <= 1000000")
def rank_k_exceeds_hits(spark, sf_dir):
    terms, index = prepared(spark, sf_dir)
    return R.rank(terms, index, 1_000_000)


@query(f"SELECT docid, rsv FROM {_ranked('WHERE p.query_id = 100003')} WHERE rank <= 10")
def rank_single_query(spark, sf_dir):
    """One query needs no window by query: its best rows are a sorted limit."""
    terms = one_query(spark, 100003)
    index = stored(spark, sf_dir, terms)
    return R.accumulate(R.segment_plan(terms, index.heads), index, 10).select("docid", "rsv").orderBy(F.desc("rsv"), F.desc("docid")).limit(10)


def _early_sql(gap: str) -> str:
    return f"""{_BOUNDS},
hits AS (SELECT b.query_id, b.seq, post.docid, b.impact FROM bounds b JOIN post ON b.term = post.term AND b.impact = post.impact),
seen AS (SELECT query_id, docid, min(seq) AS since FROM hits GROUP BY query_id, docid),
upto AS (SELECT s.query_id, s.seq, s.remaining, s.cum_freq, d.docid, sum(coalesce(h.impact, 0)) OVER (PARTITION BY s.query_id, d.docid ORDER BY s.seq ROWS UNBOUNDED PRECEDING) AS rsv
  FROM seen d JOIN bounds s ON s.query_id = d.query_id AND s.seq >= d.since LEFT JOIN hits h ON h.query_id = s.query_id AND h.seq = s.seq AND h.docid = d.docid),
best AS (SELECT *, lead(rsv) OVER (PARTITION BY query_id, seq ORDER BY rank) AS follow FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id, seq ORDER BY rsv DESC, docid DESC) AS rank FROM upto QUALIFY rank <= 6)),
tests AS (SELECT query_id, seq, max(rank) AS n, min(CASE WHEN rank <= 5 THEN rsv - follow END) AS least, max(remaining) AS remaining FROM best GROUP BY query_id, seq),
ends AS (SELECT query_id, max(seq) AS last, min(CASE WHEN n = 6 AND least {gap} remaining THEN seq END) AS stop FROM tests GROUP BY query_id),
checks AS (SELECT t.query_id, count(*) FILTER (WHERE t.n = 6 AND t.seq <= coalesce(e.stop, e.last)) AS checks FROM tests t JOIN ends e ON t.query_id = e.query_id GROUP BY t.query_id)
SELECT b.query_id, b.docid, CAST(b.rsv AS BIGINT) AS rsv, CAST(b.rank AS INTEGER) AS rank, CAST(b.seq AS INTEGER) AS segments, b.cum_freq AS postings,
  CAST(c.checks AS INTEGER) AS checks, CAST(e.stop IS NOT NULL AS INTEGER) AS stopped
FROM best b JOIN ends e ON b.query_id = e.query_id AND b.seq = coalesce(e.stop, e.last) JOIN checks c ON c.query_id = b.query_id WHERE b.rank <= 5"""


def _early(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    terms, index = prepared(spark, sf_dir)
    return R.early(terms, index, 5, strict).drop("read")


@query(_early_sql(">"))
def rank_early_strict(spark, sf_dir):
    return _early(spark, sf_dir, True)


@query(_early_sql(">="))
def rank_early_compat(spark, sf_dir):
    return _early(spark, sf_dir, False)


@query(f"SELECT *, rsv - lead(rsv) OVER (PARTITION BY query_id ORDER BY rank) AS gap FROM (SELECT * FROM {_ranked()} WHERE rank <= 11)")
def score_gaps(spark, sf_dir):
    terms, index = prepared(spark, sf_dir)
    return R.score_gaps(R.rank(terms, index, 11))


@query(f"SELECT e.query_id, count(*) AS n_reference, count(a.docid) AS n_shared FROM (SELECT * FROM {_ranked()} WHERE rank <= 10) e LEFT JOIN (SELECT * FROM {_ranked(f'WHERE p.cum_freq <= {MEDIUM}')} WHERE rank <= 10) a ON e.query_id = a.query_id AND e.docid = a.docid GROUP BY e.query_id")
def anytime_vs_exhaustive_overlap(spark, sf_dir):
    terms, index = prepared(spark, sf_dir)
    return R.overlap(R.rank(terms, index, 10, MEDIUM, "anytime"), R.rank(terms, index, 10))


_GAPS = "CAST(docid - lag(docid, {n}, CAST(0 AS BIGINT)) OVER (PARTITION BY term, impact ORDER BY docid) AS BIGINT) AS gap"


@query(f"SELECT term, impact, docid, {_GAPS.format(n=1)} FROM post")
def gaps_d1(spark, sf_dir):
    return _gaps(spark, sf_dir, 1)


@query(f"SELECT term, impact, docid, {_GAPS.format(n=4)} FROM post")
def gaps_d4(spark, sf_dir):
    return _gaps(spark, sf_dir, 4)


def _coded(spark: SparkSession, sf_dir: str, stride: int) -> DataFrame:
    return G.block_gaps(indexio.read_bodies(spark, index_path(spark, sf_dir)), stride)


def _gaps(spark: SparkSession, sf_dir: str, stride: int) -> DataFrame:
    return G.gap_rows(_coded(spark, sf_dir, stride)).select("term", "impact", "docid", "gap")


@query("SELECT term, impact, docid FROM post")
def gaps_d1_roundtrip(spark, sf_dir):
    return G.from_block_gaps(_coded(spark, sf_dir, 1).drop("docids"))


@query("SELECT term, impact, docid FROM post")
def gaps_d4_roundtrip(spark, sf_dir):
    return G.from_block_gaps(_coded(spark, sf_dir, 4).drop("docids"), 4)


_WIDTH = "CASE WHEN gap = 1 THEN 0 " + " ".join(f"WHEN gap < {1 << b} THEN {b}" for b in codecs.BLOCK_BITS[1:]) + " ELSE 64 END"


@query(f"SELECT {_WIDTH} AS width, count(*) AS n FROM (SELECT {_GAPS.format(n=1)} FROM post) GROUP BY 1")
def bit_widths(spark, sf_dir):
    return gaps_d1(spark, sf_dir).groupBy(codecs.width_class(F.col("gap")).alias("width")).agg(F.count("*").alias("n"))


@query(f"SELECT term, CAST(sum(CASE WHEN gap < 128 THEN 1 WHEN gap < 16384 THEN 2 WHEN gap < 2097152 THEN 3 WHEN gap < 268435456 THEN 4 ELSE 5 END) AS BIGINT) AS vbyte_bytes FROM (SELECT term, {_GAPS.format(n=1)} FROM post) GROUP BY term")
def vbyte_sizes(spark, sf_dir):
    return gaps_d1(spark, sf_dir).groupBy("term").agg(F.sum(codecs.vbyte_length(F.col("gap"))).alias("vbyte_bytes"))


def _roundtrip(codec: str) -> Query:
    def run(spark, sf_dir):
        bodies = indexio.read_bodies(spark, index_path(spark, sf_dir))
        return codecs.decoded(codecs.encoded(bodies, codec)).select("term", "impact", F.explode("docids").alias("docid"))

    return run


for _name in codecs.CODECS:
    _f = _roundtrip(_name)
    _f.__name__ = f"codec_roundtrip_{_name}"
    query("SELECT term, impact, docid FROM post")(_f)


@query()
def codec_sizes(spark, sf_dir):
    """Payload bytes of the whole index by codec."""
    bodies = indexio.read_bodies(spark, index_path(spark, sf_dir))
    every = None
    for name in codecs.CODECS:
        part = codecs.encoded(bodies, name)
        every = part if every is None else every.unionByName(part)
    return every.groupBy("codec").agg(F.count("*").alias("n_segments"), F.sum(F.octet_length("payload")).alias("payload_bytes"))


@query("""SELECT p_partkey AS x, CAST(floor(p_retailprice + 0.5) AS BIGINT) AS rounded, CAST(sign(p_size - 25) AS DOUBLE) AS sgn,
  CAST(bit_count((p_partkey & -p_partkey) - 1) AS INTEGER) AS low_bit, CAST(CASE WHEN p_partkey < 2 THEN 0 ELSE length(bin(p_partkey)) - 1 END AS INTEGER) AS log2_floor,
  CAST(CASE WHEN p_partkey = 0 THEN 0 ELSE length(bin(p_partkey)) END AS INTEGER) AS bits, CAST(1 AS BIGINT) << CAST(p_size AS BIGINT) AS pow2,
  CASE WHEN p_size = 0 THEN 0 ELSE CAST(1 AS BIGINT) << CAST(p_size AS BIGINT) END AS pow2_zero, greatest(p_size, p_partkey, 7) AS most, least(p_size, p_partkey, 7) AS least FROM part""")
def math_integers(spark, sf_dir):
    x, size = F.col("p_partkey"), F.col("p_size")
    return read(spark, sf_dir, "part").select(
        x.alias("x"),
        mathx.round_half_up(F.col("p_retailprice")).alias("rounded"),
        mathx.sign(size - 25).alias("sgn"),
        mathx.lowest_bit(x).alias("low_bit"),
        mathx.floor_log2(x).alias("log2_floor"),
        mathx.bits_to_hold(x).alias("bits"),
        mathx.power_of_two(size).alias("pow2"),
        mathx.power_of_two_or_zero(size).alias("pow2_zero"),
        mathx.largest(size, x, F.lit(7)).alias("most"),
        mathx.smallest(size, x, F.lit(7)).alias("least"),
    )


@query("""SELECT p_partkey AS x, round(log10(p_retailprice), 9) AS log10, round(log2(p_retailprice), 9) AS log2, round(ln(p_retailprice + p_retailprice + 1), 9) AS log_sum,
  round(sqrt(p_retailprice), 9) AS root, round(sqrt(p_retailprice), 6) AS bisected, round(sqrt(p_retailprice), 6) AS regula, round(sqrt(p_retailprice), 6) AS secant, round(p_retailprice, 6) AS lowest FROM part""")
def math_reals(spark, sf_dir):
    x = F.col("p_retailprice")
    square = lambda r: r * r - x
    # hundreds of steps a row, and a file of few bytes is one task: rows are dealt to all cores
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice").repartition(4 * spark.sparkContext.defaultParallelism)
    return rows.select(
        F.col("p_partkey").alias("x"),
        F.round(mathx.log_base(10.0, x), 9).alias("log10"),
        F.round(mathx.log_base(2.0, x), 9).alias("log2"),
        F.round(mathx.log_add(F.log(x), F.log(x + 1)), 9).alias("log_sum"),
        F.round(F.sqrt(x), 9).alias("root"),
        F.round(mathx.bisect_root(square, F.lit(0.0), x + 1), 6).alias("bisected"),
        F.round(mathx.regula_falsi_root(square, F.lit(0.0), x + 1), 6).alias("regula"),
        F.round(mathx.secant_root(square, x / 2, x), 6).alias("secant"),
        F.round(mathx.descend(lambda r: 2 * (r - x), F.lit(0.0), 0.3, 200), 6).alias("lowest"),
    )


def _shifted(x: str) -> str:
    """The next number of the shift generator in wide integers below 2**64."""
    whole = "CAST(18446744073709551615 AS HUGEINT)"
    one = f"xor({x}, ({x} << 13) & {whole})"
    two = f"xor({one}, {one} >> 7)"
    return f"xor({two}, ({two} << 17) & {whole})"


_SIGNED = "CAST(CASE WHEN {x} > 9223372036854775807 THEN {x} - 18446744073709551616 ELSE {x} END AS BIGINT)"


@query(f", r AS (SELECT p_partkey, {_shifted('CAST(p_partkey + 1 AS HUGEINT)')} AS a FROM part), r2 AS (SELECT p_partkey, a, {_shifted('a')} AS b FROM r) SELECT p_partkey AS x, {_SIGNED.format(x='a')} AS first, {_SIGNED.format(x='b')} AS second FROM r2")
def random_numbers(spark, sf_dir):
    """Two steps of the shift generator from each key."""
    first = F.col("p_partkey") + 1
    second = mathx.xorshift(first)
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("x"), second.alias("first"), mathx.xorshift(second).alias("second"))


@query(f"SELECT query_id, rank, query_id || ' Q0 doc-' || docid || ' ' || rank || ' ' || rsv || ' COMPILED (ID:' || docid || ')' AS line FROM {_ranked()} WHERE rank <= 10")
def run_lines(spark, sf_dir):
    return runs.run_lines(rank_named(spark, sf_dir))


@query(f"SELECT query_id, count(*) AS segments_processed, CAST(sum(freq) AS BIGINT) AS postings_processed FROM plan GROUP BY query_id")
def query_stats(spark, sf_dir):
    terms, index = prepared(spark, sf_dir)
    return S.query_stats(R.segment_plan(terms, index.heads))


@query(f", s AS (SELECT query_id, count(*) AS n, CAST(sum(freq) AS BIGINT) AS p FROM plan WHERE cum_freq <= {MEDIUM} GROUP BY query_id) SELECT count(*) AS topics, CAST(sum(n) AS BIGINT) AS total_segments, CAST(sum(p) AS BIGINT) AS total_postings, CAST(sum(n) // count(*) AS BIGINT) AS mean_segments, CAST(sum(p) // count(*) AS BIGINT) AS mean_postings FROM s")
def stats_summary(spark, sf_dir):
    terms, index = prepared(spark, sf_dir)
    return S.summary(S.query_stats(R.within_budget(R.segment_plan(terms, index.heads), MEDIUM)))


@query("SELECT query_id, 'query id,postings processed,ns:' || query_id || ',' || CAST(sum(freq) AS BIGINT) AS counted, true AS timed FROM plan GROUP BY query_id")
def stats_lines(spark, sf_dir):
    """The lines of a batch that has been ranked and written, cut before the time, and whether there is one."""
    terms, index = prepared(spark, sf_dir)
    took = runs.observed_run(terms, index, fresh_path(spark, "run"))["nanoseconds"]
    lines = runs.stats_lines(S.query_stats(R.segment_plan(terms, index.heads)), took)
    return lines.select("query_id", F.substring_index("line", ",", 4).alias("counted"), (F.substring_index("line", ",", -1).cast("long") > 0).alias("timed"))


_OF_RUN = "CAST(count(*) AS BIGINT) AS topics, CAST(sum({s}) AS BIGINT) AS segments, CAST(sum({p}) AS BIGINT) AS postings, CAST(sum({c}) AS BIGINT) AS checks, CAST(sum({t}) AS BIGINT) AS stops, true AS timed"
_OF_PLAN = "SELECT query_id, count(*) AS s, sum(freq) AS p FROM plan {where} GROUP BY query_id"


@query(f"""{_early_sql(">").replace("SELECT b.query_id, b.docid", ", run AS (SELECT b.query_id, b.docid")})
SELECT 'early' AS mode, {_OF_RUN.format(s="segments", p="postings", c="checks", t="stopped")} FROM run WHERE rank = 1
UNION ALL SELECT 'exhaustive', {_OF_RUN.format(s="s", p="p", c="0", t="0")} FROM ({_OF_PLAN.format(where="")})
UNION ALL SELECT 'anytime', {_OF_RUN.format(s="s", p="p", c="0", t="0")} FROM ({_OF_PLAN.format(where=f"WHERE cum_freq <= {MEDIUM}")})""")
def run_statistics(spark, sf_dir):
    """What runs of each kind took, observed as they were made."""
    terms, index = prepared(spark, sf_dir)
    rows = []
    for mode in ("early", "exhaustive", "anytime"):
        seen = runs.observed_run(terms, index, fresh_path(spark, f"run-{mode}"), 5, MEDIUM, mode)
        rows.append((mode, *(seen[c] for c in ("topics", "segments", "postings", "checks", "stops")), seen["nanoseconds"] > 0))
    return spark.createDataFrame(rows, "mode string, topics long, segments long, postings long, checks long, stops long, timed boolean")


@query(f"SELECT * FROM {_ranked()} WHERE rank <= 10")
def rank_grown(spark, sf_dir):
    """An index that has come to the whole table by steps: long documents were drafts, cut short, and short ones had copies, since taken out."""
    docs = documents(spark, sf_dir)
    long_ = F.length("text") > 500
    drafts = docs.withColumn("text", F.when(long_, F.substring("text", 1, 500)).otherwise(F.col("text")))
    copies = docs.where(~long_).withColumn("doc_id", -1 - F.col("doc_id"))
    path = fresh_path(spark, "grown")
    growth.change(spark, path, drafts.unionByName(copies))
    growth.change(spark, path, docs.where(long_), copies.select(F.col("doc_id").alias("docid")))
    terms = qterms(spark, sf_dir)
    return R.rank(terms, growth.read_grown(spark, path, terms), 10)


@query(f"SELECT 'doc-' || docid AS docno, query_id, rank, rsv FROM {_ranked(f'WHERE p.cum_freq <= {MEDIUM}')} WHERE rank <= 10")
def rank_in_sql(spark, sf_dir):
    """Anytime ranking written in SQL alone, over the index's views."""
    terms, index = prepared(spark, sf_dir)
    views.register_views(spark, index, terms)
    return spark.sql(f"SELECT d.docno, r.query_id, r.rank, r.rsv FROM rank_queries(10, {MEDIUM}) r JOIN index_documents d ON d.docid = r.docid")


_BM25 = """, tf AS (SELECT term, docid, count(*) AS tf FROM tok GROUP BY term, docid),
dl AS (SELECT docid, sum(tf) AS dl FROM tf GROUP BY docid), whole AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT tf.term, tf.docid, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (1 - 0.4 + 0.4 * dl / avgdl)), 9) AS weight FROM tf JOIN dl USING (docid) JOIN df USING (term), whole),
span AS (SELECT min(weight) AS low, max(weight) AS high FROM w),
bpost AS (SELECT term, docid, greatest(1, CAST(ceil(round((weight - low) / greatest(high - low, 1e-12) * 255, 6)) AS INTEGER)) AS impact FROM w, span),
bscore AS (SELECT q.query_id, bpost.docid, CAST(sum(impact) AS BIGINT) AS rsv FROM q JOIN bpost ON q.term = bpost.term GROUP BY q.query_id, bpost.docid)"""


@query(f"{_BM25} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rsv DESC, docid DESC) AS INTEGER) AS rank FROM bscore) WHERE rank <= 10")
def rank_bm25(spark, sf_dir):
    """Exhaustive ranking over BM25 impacts, quantised over the whole collection."""
    terms = qterms(spark, sf_dir)
    return R.rank(terms, stored(spark, sf_dir, terms, "bm25"), 10)


@query()
def rank_bm25_quantiles(spark, sf_dir):
    """Exhaustive ranking over BM25 impacts that hold equal numbers of postings; the cuts come from a sketch, so SQL can't say them."""
    terms = qterms(spark, sf_dir)
    return R.rank(terms, stored(spark, sf_dir, terms, "bm25-quantiles"), 10)


def _topic_file(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """The benchmark as a topic file: each item a topic, its text the title or the query."""
    path = fresh_path(spark, f"topics-{kind}")
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), "[<>&\\s]+", " ")
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("n"), clean.alias("t"))
    if kind == "sgml":
        lines = items.select(F.concat(F.lit("<top>\n<num> Number: "), "n", F.lit("\n<title> "), "t", F.lit("\n<desc> Description:\nabout "), "n", F.lit("\n<narr> Narrative:\nnone\n</top>")))
        lines.write.text(path)
    else:  # an XML file has one root, so topics go in files of some hundreds
        topic = F.concat(F.lit('<topic number="'), "n", F.lit('" type="single">\n<query>'), "t", F.lit("</query>\n<description>about "), "n", F.lit("</description>\n</topic>"))
        n_files = 1 + items.count() // 500
        files = items.groupBy(F.pmod(F.xxhash64("n"), F.lit(n_files)).alias("file")).agg(F.array_join(F.collect_list(topic), "\n").alias("inner"))
        files.select("file", F.concat(F.lit("<topics>\n"), "inner", F.lit("\n</topics>")).alias("value")).write.partitionBy("file").text(path)
    return path


_TOPIC_SQL = f", t AS (SELECT item_id, unnest(regexp_extract_all(lower(regexp_replace(text, '[<>&\\s]+', ' ', 'g')), '[a-z]+|[0-9]+')) AS raw FROM benchmark), s AS (SELECT item_id, {_STEM.format(t='raw')} AS stem FROM t) SELECT item_id AS query_id, stem AS term, count(*) AS n FROM s WHERE stem <> '' GROUP BY item_id, stem"


@query(_TOPIC_SQL)
def topics_sgml(spark, sf_dir):
    """Title terms of an SGML topic file that is written and read back."""
    found = topics.topic_queries(topics.read_sgml_topics(spark, _topic_file(spark, sf_dir, "sgml")), "t")
    return found.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("n"))


@query(_TOPIC_SQL)
def topics_xml(spark, sf_dir):
    """Query terms of an XML topic file that is written and read back."""
    found = topics.topic_queries(topics.read_xml_topics(spark, _topic_file(spark, sf_dir, "xml")), "q")
    return found.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT term FROM q")
def topic_term_list(spark, sf_dir):
    """Distinct terms of a query file that is written and read back."""
    path = fresh_path(spark, "queries")
    topics.write_queries(all_lines(spark, sf_dir), path)
    return topics.read_term_list(spark, path)


@query("SELECT * FROM vocab")
def stored_vocabulary(spark, sf_dir):
    return indexio.read_vocabulary(spark, index_path(spark, sf_dir))
