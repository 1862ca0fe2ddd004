"""Plain SQL with the meaning of those queries in `queries_models` that SQL can express, for DuckDB."""

from __future__ import annotations

from itertools import combinations_with_replacement

from cellsight.plans.oracle_tables import (
    _BREAKDOWN, _LIMITS, _RECOMMENDED, _SEVERITIES, _SHORT, _case, _signals, CAUSES, EXPLANATION, FLAGS, INCIDENT, KPIS, POINTS, RCA, TIME,
    query, r, rca_query,
)

_QUERIES = """queries AS (SELECT label AS query_id, list(mean ORDER BY place) AS vector FROM (
SELECT label, place, round(avg(CAST(v AS DOUBLE)), 6) AS mean FROM (
SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS place FROM embeddings) GROUP BY ALL) GROUP BY label)"""
_MATCHES = """matches AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (
SELECT query_id, vec_id AS item_id, round(list_dot_product(vector, CAST(embedding AS DOUBLE[])), 6) AS score FROM queries, {items}))"""
_ITEMS = _MATCHES.format(items="embeddings")
_WITH_TEXT = "(SELECT embeddings.* FROM embeddings JOIN documents ON vec_id = doc_id WHERE text IS NOT NULL)"
_INDEXED = _MATCHES.format(items=_WITH_TEXT)
_FOUND = """found AS (SELECT query_id, CAST(rank AS INT) AS rank, score, source || '.v' || CAST(doc_id AS VARCHAR) || '.pdf' AS source_pdf,
 source || '.v' || CAST(doc_id AS VARCHAR) AS document_id, CAST(n_chars + 1 AS INT) AS page_number, text
FROM matches JOIN documents ON item_id = doc_id WHERE rank <= 3)"""
_CONTEXTS = r"""contexts AS (SELECT query_id, md5(string_agg('Source: ' || source_pdf || chr(10) || 'Page: ' || CAST(page_number AS VARCHAR) || chr(10) || chr(10) || text,
 chr(10) || chr(10) || '--------------------------------' || chr(10) || chr(10) ORDER BY rank)) AS body FROM found GROUP BY 1)"""


def _with(sql: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} {sql}"


def _lloyd(rounds: int) -> list[str]:
    """Steps of the coarse quantiser from the vectors with the smallest hashes; owned_<i> holds the cell of each vector in step i."""
    steps = [
        "vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)",
        "cells_0 AS (SELECT row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), CAST(vec_id AS VARCHAR)) - 1 AS cell, list_transform(x, lambda v: round(v, 6)) AS c "
        "FROM vectors QUALIFY cell < ceil(sqrt((SELECT count(*) FROM vectors))))",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"owned_{i} AS (SELECT vec_id, any_value(x) AS x, arg_min(cell, list_dot_product(c, c) - 2 * list_dot_product(x, c)) AS cell FROM vectors, cells_{i} GROUP BY vec_id)"
        )
        steps.append(
            f"cells_{i + 1} AS (SELECT cell, coalesce(m, c) AS c FROM cells_{i} LEFT JOIN (SELECT cell, list(mean ORDER BY place) AS m FROM ("
            f"SELECT cell, place, round(avg(v), 6) AS mean FROM (SELECT cell, unnest(x) AS v, generate_subscripts(x, 1) AS place FROM owned_{i}) GROUP BY ALL) GROUP BY cell) USING (cell))"
        )
    return steps


# Live analysis: global limits, the flag forced to 0, only lines that are complete objects.
_LIVE_LIMITS = _LIMITS.replace("GROUP BY {key}", "").format(key="1")
_LIVE_FLAGS = FLAGS.replace("FROM kpi JOIN percentiles ON slice_type = k", "FROM (SELECT * REPLACE (0 AS sla_compliant) FROM kpi WHERE handover_count < 5 AND latency_ms IS NOT NULL AND rsrq_db IS NOT NULL) kpi, percentiles")
_BULLETS = "'- ' || replace(" + _case(_SHORT, _RECOMMENDED) + ", ' | ', chr(10) || '- ')"
_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r(f'corr({a}, {b})')} AS corr, {r(f'covar_samp({a}, {b})')} AS cov FROM kpi"
    for a, b in combinations_with_replacement(KPIS, 2)
)

ORACLE = {
    "chunk_fixed": "SELECT doc_id, CAST(i AS INT) AS chunk_no, substr(text, CAST(i * 400 + 1 AS INT), 500) AS chunk_text FROM documents, "
    "LATERAL (SELECT unnest(range(greatest(length(text) - 101, 0) // 400 + 1)) AS i) WHERE length(text) > 0",
    "normalize_vectors": f"SELECT vec_id, CAST(place - 1 AS INT) AS place, {r('v / norm')} AS value FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, "
    "generate_subscripts(embedding, 1) AS place, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM embeddings)",
    "similarity_join_topk": _with("SELECT query_id, item_id, score, CAST(rank AS INT) AS rank FROM matches WHERE rank <= 3", _QUERIES, _ITEMS),
    "retrieve_topk": _with(
        "SELECT query_id, item_id AS chunk_id, score, CAST(length(text) AS INT) AS length FROM matches JOIN documents ON item_id = doc_id WHERE rank <= 5", _QUERIES, _INDEXED
    ),
    "retrieval_rank": _with("SELECT query_id, CAST(rank AS INT) AS rank, item_id FROM matches WHERE rank <= 10", _QUERIES, _ITEMS),
    "retrieve_shape": _with(
        "SELECT query_id, rank, score AS retrieval_score, source_pdf, document_id, page_number, text FROM found", _QUERIES, _INDEXED, _FOUND
    ),
    "index_table": "SELECT doc_id, CAST(greatest(length(text) - 101, 0) // 400 + 1 AS BIGINT) AS chunks, CAST(256 AS INT) AS places FROM documents WHERE length(text) > 0",
    "index_cells": _with(
        f"SELECT vec_id AS item_id, CAST(cell AS INT) AS cell, {r('list_distance(x, c)')} AS away FROM owned_3 JOIN cells_3 USING (cell)", *_lloyd(3)
    ),
    "retrieve_cells": "SELECT query_id, item_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM ("
    "SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score "
    "FROM embeddings a, embeddings b)) WHERE rank <= 3",
    "incident_context_text": query(
        f"SELECT record_id, md5({_BULLETS}) AS actions, coalesce(body, 'No relevant supporting documentation was retrieved.') AS context "
        "FROM result LEFT JOIN contexts ON query_id = handover_count WHERE root_cause <> 'Normal'",
        *RCA, _QUERIES, _INDEXED, _FOUND, _CONTEXTS,
    ),
    "stream_kpi_source": query(
        "SELECT CASE WHEN handover_count IN (5, 7) THEN 'not_an_object' WHEN handover_count = 6 THEN 'bad_json' WHEN latency_ms IS NULL OR rsrq_db IS NULL THEN 'missing_fields' "
        "ELSE 'ok' END AS outcome, count(*) AS n FROM kpi GROUP BY 1"
    ),
    "stream_rca": query(
        f"SELECT cell_id, throughput_mbps, root_cause, {_case('root_cause', _SEVERITIES)} AS severity, "
        f"all_affected AS affected, {_signals(' | ')} AS signals, {_BREAKDOWN} AS score_breakdown FROM causes",
        _LIVE_LIMITS, _LIVE_FLAGS, POINTS, CAUSES,
    ),
    "stream_sink": query(
        "SELECT CASE WHEN handover_count < 5 AND latency_ms IS NOT NULL AND rsrq_db IS NOT NULL THEN 'results' ELSE 'rejected' END AS part, count(*) AS n FROM kpi GROUP BY 1"
    ),
    "rca_job": rca_query(
        f"{INCIDENT} AS incident_id, {TIME} AS timestamp, cell_id AS \"cell_id/site_id\", cell_type, slice_type AS network_slice, sla_compliant, root_cause, severity, confidence_score, "
        f"affected AS affected_kpis, signals AS matched_signals, score_breakdown, {EXPLANATION} AS explanation, actions AS recommended_actions"
    ),
    "profile_job": query(_PAIRS),
}
