"""Registration of queries with the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


#: Common table expressions of the SQL.
NODES = """nodes1 AS (SELECT node_id, paper_id, t, year, is_ghost, CASE WHEN len(base_pos) = 3 AND isfinite(base_pos[1]) AND isfinite(base_pos[2]) AND isfinite(base_pos[3]) THEN base_pos END AS base_pos
    FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ingested_at DESC, paper_id DESC, t DESC NULLS LAST, year DESC NULLS LAST) AS rn FROM nodes) WHERE rn = 1)"""
POSITIONS = NODES + ", pos AS (SELECT node_id, base_pos[1] AS x, base_pos[2] AS y, base_pos[3] AS z FROM nodes1 WHERE base_pos IS NOT NULL)"
ASSIGN = """assign AS (SELECT level_uid, node_id, node_cluster FROM (
    SELECT *, row_number() OVER (PARTITION BY level_uid, node_id ORDER BY assigned_at DESC, arrived_at DESC, node_cluster DESC) AS rn FROM cluster_nodes WHERE node_cluster IS NOT NULL) WHERE rn = 1)"""
LEVELS = ASSIGN + ", leveled AS (SELECT a.*, l.level_no FROM assign a JOIN level_info l USING (level_uid))"
EDGES = "edges AS (SELECT DISTINCT citing_id, cited_id FROM citations WHERE citing_id IS NOT NULL AND cited_id IS NOT NULL AND citing_id <> cited_id)"
NODE_EDGES = NODES + ", " + EDGES + ", ne AS (SELECT a.node_id AS src, b.node_id AS dst FROM edges e JOIN nodes1 a ON a.paper_id = e.citing_id JOIN nodes1 b ON b.paper_id = e.cited_id)"
