"""How queries are registered, and the SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.functions.text import ACCENTED, PLAIN

Query = Callable[[SparkSession, str], DataFrame]

CONCEPTS = """concepts AS (
  SELECT d.doc_id, printf('doc-%08d', d.doc_id) AS id, '/' || source || '/' || lang || '/' || printf('doc-%08d', d.doc_id) || '.md' AS path,
    '/' || source || '/' AS namespace, kind AS type, substr(split_part(text, '.', 1), 1, 80) AS title,
    CASE WHEN toxic = 1 THEN 'tombstone' WHEN quality = 0 THEN 'deprecated' ELSE 'active' END AS status,
    list_sort([lang, kind, source]) AS tags, text AS body, sha256(text) AS content_hash, 1704067200 + d.doc_id * 3600 AS updated_s,
    CASE WHEN d.doc_id % 50 = 7 THEN [printf('doc-%08d', d.doc_id - 1)] ELSE [] END AS supersedes
  FROM (SELECT *, ['concept', 'instance', 'person', 'project', 'service', 'system'][doc_id % 6 + 1] AS kind FROM documents) d
  LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)"""
VECTORS = """vectors AS (SELECT vec_id, printf('doc-%08d', vec_id) AS id, embedding::DOUBLE[] AS v, label,
  CASE WHEN vec_id % 10 = 0 THEN 'stale' WHEN vec_id % 10 = 1 THEN 'missing' WHEN vec_id % 10 = 2 THEN 'error' ELSE 'ready' END AS status FROM embeddings)"""
GRAPH = """nodes AS (SELECT 's' || s_suppkey AS id, '/suppliers/s' || s_suppkey || '.md' AS path, '/suppliers/' AS namespace FROM supplier
    UNION ALL SELECT 'p' || p_partkey, space || 'p' || p_partkey || '.md', space FROM (SELECT p_partkey, CASE WHEN p_size > 40 THEN '/archive/' ELSE '/parts/' END AS space FROM part)
    UNION ALL SELECT 'n' || n_nationkey, '/nations/n' || n_nationkey || '.md', '/nations/' FROM nation),
raw AS (SELECT 's' || l_suppkey AS source_id, '/parts/p' || l_partkey || '.md' AS target_path FROM lineitem
    UNION ALL SELECT 'p' || l_partkey, '/suppliers/s' || min(l_suppkey) || '.md' FROM lineitem GROUP BY l_partkey
    UNION ALL SELECT 'p' || p_partkey, '/parts/p' || min(p_partkey) OVER (PARTITION BY p_brand) || '.md' FROM part),
links AS (SELECT source_id, target_path, id AS target_id FROM raw LEFT JOIN nodes ON path = target_path)"""
EVENTS = """ev AS (SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS moment, user_id, event_type, value, (props->>'$.k')::BIGINT AS k FROM events)"""
PROPOSALS = EVENTS + """, proposals AS (SELECT event_id AS proposal_id, user_id AS author, moment,
  CASE event_type WHEN 'signup' THEN 'submitted' WHEN 'click' THEN 'approved' WHEN 'view' THEN 'draft' WHEN 'purchase' THEN 'applied' ELSE 'rejected' END AS status,
  '/k' || k || '.md' AS path, value FROM ev)"""


def tokens_sql(x: str) -> str:
    return rf"regexp_extract_all(translate(lower(coalesce({x}, '')), '{ACCENTED}', '{PLAIN}'), '[\p{{L}}\p{{N}}]+')"


def registry() -> tuple[dict[str, Query], dict[str, str], Callable]:
    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}

    def query(*parts: str):
        """Registers a query under its function's name; parts: common tables, and at the end the SELECT. None: SQL can't state it."""

        def put(f: Query) -> Query:
            queries[f.__name__] = f
            if parts:
                oracles[f.__name__] = (f"WITH RECURSIVE {', '.join(parts[:-1])} " if parts[:-1] else "") + parts[-1]
            return f

        return put

    return queries, oracles, query
