"""Queries of this subpackage: name -> f(spark, sf_dir), and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pu import quality_scores

    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(read(spark, sf_dir, "documents")).drop("spans")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import quality_rules

    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import language_model_scores

    return language_model_scores(read(spark, sf_dir, "documents"))


def op7_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_rows

    return shard_rows(read(spark, sf_dir, "documents"))


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toolcalls import link_tool_calls, reply_schema, turns_as_calls

    turns = read(spark, sf_dir, "conversations")
    return link_tool_calls(*turns_as_calls(turns), reply_schema(turns))


OP8_SQL = """
WITH said AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
calls AS (
  SELECT conv_id, turn, conv_id || ':' || turn AS call_id, min('{"text":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || turn || '}') AS arguments
  FROM said WHERE role = 'user' GROUP BY conv_id, turn),
results AS (
  SELECT conv_id, turn, conv_id || ':' || (turn - 1) AS call_id, min(text) AS content
  FROM said WHERE role = 'assistant' GROUP BY conv_id, turn),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM calls)
SELECT coalesce(p.conv_id, r.conv_id) AS conv_id, coalesce(p.call_id, r.call_id) AS call_id, CAST(p.position AS BIGINT) AS position, p.turn AS turn,
  CASE WHEN p.turn IS NOT NULL THEN 'reply' END AS tool,
  CASE WHEN p.turn IS NULL THEN 'orphan' WHEN r.turn IS NULL THEN 'unanswered' ELSE 'ok' END AS status,
  CAST(NULL AS VARCHAR) AS errors, r.turn AS result_turn,
  CASE WHEN p.turn IS NOT NULL THEN '{"arguments":' || p.arguments || ',"call_id":"' || p.call_id || '","conv_id":' || p.conv_id || ',"position":' || p.position
    || ',"result":' || coalesce(CAST(to_json(r.content) AS VARCHAR), 'null') || ',"tool":"reply"}' END AS record
FROM placed p FULL OUTER JOIN results r ON p.conv_id = r.conv_id AND p.call_id = r.call_id
"""


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .extract import extract_text

    return extract_text(read(spark, sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import source_divergence

    return source_divergence(read(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
tok AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM tok GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
grp AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM tok GROUP BY lang, source, term),
g AS (SELECT grp.lang, grp.source, kept.term, coalesce(c.n, 0) AS n FROM grp JOIN kept ON grp.lang = kept.lang LEFT JOIN c ON c.lang = grp.lang AND c.source = grp.source AND c.term = kept.term),
p AS (SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (sum(n) OVER w + 5 * count(*) OVER w) AS p FROM g WINDOW w AS (PARTITION BY lang, source)),
l AS (SELECT lang, term, sum(n) AS n FROM g GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (sum(n) OVER w + 5 * count(*) OVER w) AS q FROM l WINDOW w AS (PARTITION BY lang)),
apart AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source),
pair AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(apart.value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source),
more AS (SELECT p.lang, p.source, p.term AS item, CAST(p.p - q.q AS BIGINT) AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pair
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM more) WHERE rank <= 50
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codebooks import compress

    return compress(read(spark, sf_dir, "embeddings"))


def _op12_sql(rounds: int = 6) -> str:
    """The rounds one after the other; a part of a row is a list, and so is an entry."""
    apart = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for i in range(rounds + 1):
        near = f"SELECT rid, part, entry, d FROM (SELECT v.rid, v.part, c.entry, {apart} AS d FROM parts v JOIN book{i} c ON v.part = c.part) QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY d, entry) = 1"
        steps.append(f"near{i} AS MATERIALIZED ({near})")
        if i < rounds:
            means = f"SELECT part, entry, list(mean ORDER BY pos) AS x FROM (SELECT n.part, n.entry, e.pos, CAST(floor(sum(e.x) / count(*)) AS BIGINT) AS mean FROM near{i} n JOIN each e ON n.rid = e.rid AND n.part = e.part GROUP BY n.part, n.entry, e.pos) GROUP BY part, entry"
            steps.append(f"book{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{i} b LEFT JOIN ({means}) m ON b.part = m.part AND b.entry = m.entry)")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT rid, part, x[part * len(x) // 8 + 1:(part + 1) * len(x) // 8] AS x FROM kept, range(8) AS p(part)),
each AS MATERIALIZED (SELECT rid, part, generate_subscripts(x, 1) AS pos, unnest(x) AS x FROM parts),
book0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x FROM parts WHERE rid <= 16),
{", ".join(steps)},
sha AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS sha FROM book{rounds}),
coded AS (SELECT rid, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM coded JOIN kept USING (rid), sha
"""


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest_neighbours

    return nearest_neighbours(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pu_quality,
        op2_license_scan,
        op3_quality_rules,
        op4_simhash_dedup,
        op5_pack_sequences,
        op6_lm_scores,
        op7_ring_shards,
        op8_tool_calls,
        op9_main_text,
        op10_decontaminate,
        op11_source_divergence,
        op12_vector_codes,
        op13_nearest_neighbours,
    )
}
ORACLES: dict[str, str] = {"op8_tool_calls": OP8_SQL, "op11_source_divergence": OP11_SQL, "op12_vector_codes": _op12_sql()}
