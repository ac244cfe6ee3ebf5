"""The pN_ queries over the project's tables, and their SQL where SQL can express them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorequarry.llm import conversations, groups, history, mixing, neighbours, pii, splitting, tokens, validity
from lorequarry.session import load

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(spark, load(spark, d, "turns"), load(spark, d, "people"))


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(spark, load(spark, d, "turns"), load(spark, d, "people"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.broken_sessions(spark, load(spark, d, "turns"), load(spark, d, "sessions"))


def p2_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(spark, load(spark, d, "turns"), load(spark, d, "sessions"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return validity.check_sources(load(spark, d, "source_files"), causes=False).where("invalid").select("path").distinct()


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return validity.rates(load(spark, d, "files"), load(spark, d, "source_files"), load(spark, d, "projects"))


def p3_flags(spark: SparkSession, d: str) -> DataFrame:
    return validity.file_flags(load(spark, d, "files"), load(spark, d, "source_files"), load(spark, d, "projects"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return history.repeated_turns(spark, load(spark, d, "turns"), load(spark, d, "sessions"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.group_concepts(spark, load(spark, d, "concept_links"), load(spark, d, "concepts_global"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(spark, load(spark, d, "concepts_global"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(load(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    return tokens.decode(tokens.encode(load(spark, d, "documents")))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(spark, load(spark, d, "documents"), load(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(spark, load(spark, d, "documents"), load(spark, d, "mix_targets"))


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_documents(load(spark, d, "documents"), load(spark, d, "chunk_limits"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found, "p1_redacted": p1_redacted,
        "p2_found": p2_found, "p2_conversations": p2_conversations,
        "p3_found": p3_found, "p3_rates": p3_rates, "p3_flags": p3_flags,
        "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p7_ids": p7_ids, "p7_decoded": p7_decoded,
        "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_pieces": p9_pieces,
    }


# Connected components by a recursive query over the same links.
P5 = """
WITH RECURSIVE c AS (SELECT DISTINCT id FROM concepts_global WHERE id IS NOT NULL),
e AS (SELECT a, b FROM concept_links WHERE replace(lower(trim(kind)), '-', '_') = 'same_as' AND a <> b AND a IN (SELECT id FROM c) AND b IN (SELECT id FROM c)),
s AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
r(x, y) AS (SELECT u, u FROM s UNION SELECT r.x, s.v FROM r JOIN s ON s.u = r.y)
SELECT min(y) AS group_id, x AS concept_id FROM r GROUP BY x
"""
P2 = r"""
WITH t AS (SELECT DISTINCT * FROM turns WHERE session_id IS NOT NULL),
s AS (SELECT DISTINCT id FROM sessions WHERE id IS NOT NULL),
k AS (SELECT session_id, count(*) AS n, count(idx) AS ni, count(DISTINCT idx) AS di, min(idx) AS lo, max(idx) AS hi,
  count(ts) AS nt, count(DISTINCT ts) AS dt,
  count(*) FILTER (coalesce(lower(trim(role)), '') NOT IN ('user', 'assistant', 'tool', 'system')) AS bad
  FROM t GROUP BY session_id),
m AS (SELECT t.session_id, lower(trim(role)) AS who, CASE WHEN k.ni > 0 THEN idx ELSE ts END AS pos
  FROM t JOIN k ON k.session_id = t.session_id
  WHERE lower(trim(role)) IN ('user', 'assistant') AND regexp_matches(coalesce(text, ''), '\S')),
q AS (SELECT *, lead(who) OVER (PARTITION BY session_id ORDER BY pos) AS nxt FROM m),
g AS (SELECT session_id, count(*) FILTER (who = 'user') AS us, count(*) FILTER (who = 'assistant') AS asst,
  count(*) FILTER (who = 'user' AND coalesce(nxt, '') <> 'assistant') AS open FROM q GROUP BY session_id)
SELECT s.id AS session_id FROM s LEFT JOIN k ON k.session_id = s.id LEFT JOIN g ON g.session_id = s.id
WHERE k.n IS NULL OR (k.ni > 0 AND k.ni < k.n) OR (k.ni = k.n AND (k.di <> k.n OR k.lo <> 0 OR k.hi <> k.n - 1))
  OR (k.ni = 0 AND (k.nt < k.n OR k.dt < k.n)) OR k.bad > 0 OR coalesce(g.us, 0) = 0 OR coalesce(g.asst, 0) = 0 OR g.open > 0
"""
# Every pair of turns that share a shingle, by brute force.
P4 = r"""
WITH s AS (SELECT id, min(ingested_at) AS batch FROM sessions WHERE id IS NOT NULL AND ingested_at IS NOT NULL GROUP BY id),
t AS (SELECT DISTINCT t.id, s.batch, regexp_extract_all(lower(t.text), '[\p{L}\p{N}]+') AS w FROM turns t JOIN s ON s.id = t.session_id
  WHERE regexp_replace(lower(t.role), '^\s+|\s+$', '', 'g') IN ('user', 'assistant') AND t.text IS NOT NULL),
g AS (SELECT DISTINCT id, batch, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x FROM t WHERE len(w) >= 30),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
p AS (SELECT a.id AS q, b.id AS h, count(*) AS same FROM g a JOIN g b ON a.x = b.x AND b.batch < a.batch GROUP BY 1, 2)
SELECT DISTINCT p.q AS turn_id FROM p JOIN n a ON a.id = p.q JOIN n b ON b.id = p.h WHERE 10 * p.same >= 7 * (a.n + b.n - p.same)
"""
P6 = """
WITH n AS (SELECT id, embedding FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS r FROM concepts_global WHERE id IS NOT NULL) WHERE r = 1),
v AS (SELECT id, CAST(embedding AS DOUBLE[]) AS e FROM n WHERE len(embedding) = 64 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
p AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.id <> b.id),
k AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM p WHERE c >= 0.86)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM k WHERE r <= 5
"""
P7_DECODED = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2, "p4_found": P4, "p5_found": P5, "p6_found": P6, "p7_decoded": P7_DECODED}
