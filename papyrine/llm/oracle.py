"""SQL for those queries of this subpackage that SQL can state."""

_ASSIGNED = """
    SELECT level_uid, node_id, node_cluster FROM (
        SELECT *, row_number() OVER (PARTITION BY level_uid, node_id ORDER BY assigned_at DESC, arrived_at DESC, node_cluster DESC) AS rn
        FROM cluster_nodes WHERE node_cluster IS NOT NULL) WHERE rn = 1"""

_POSITIONS = """
    SELECT node_id, base_pos[1] AS x, base_pos[2] AS y, base_pos[3] AS z FROM (
        SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ingested_at DESC) AS rn FROM nodes)
    WHERE rn = 1 AND len(base_pos) = 3 AND isfinite(base_pos[1]) AND isfinite(base_pos[2]) AND isfinite(base_pos[3])"""

_CANON = r"regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+', '', 'g')"

_KEYED = f"""
    SELECT row_id, least(t, d) AS k1, greatest(t, d) AS k2 FROM (
        SELECT row_id, {_CANON.format("title")} AS t, coalesce({_CANON.format("doi")}, '') AS d FROM cart WHERE title IS NOT NULL)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"""
            WITH a AS ({_ASSIGNED}), g AS (SELECT node_id, max(in_deg) AS in_deg FROM cart WHERE node_id IS NOT NULL AND in_deg IS NOT NULL GROUP BY node_id)
            SELECT level_uid, node_cluster, node_id FROM (
                SELECT a.*, row_number() OVER (PARTITION BY level_uid, node_cluster ORDER BY in_deg DESC, a.node_id) AS rn
                FROM a JOIN g ON a.node_id = g.node_id WHERE node_cluster <> -1)
            WHERE rn <= 5""",
        "p4_found": f"""
            WITH k AS ({_KEYED}), m AS (SELECT *, min(row_id) OVER (PARTITION BY k1, k2) AS row_a FROM k)
            SELECT row_a, row_id AS row_b FROM m WHERE row_id > row_a""",
        "p4_records": f"WITH k AS ({_KEYED}) SELECT min(row_id) AS record_id, count(*) AS copies FROM k GROUP BY k1, k2",
        "p5_found": f"""
            WITH p AS ({_POSITIONS}), r AS (
                SELECT a.node_id AS a, b.node_id AS b, row_number() OVER (PARTITION BY a.node_id ORDER BY
                    (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), b.node_id) AS rn
                FROM p a, p b WHERE a.node_id <> b.node_id)
            SELECT DISTINCT least(a, b) AS node_a, greatest(a, b) AS node_b FROM r WHERE rn <= 5""",
    }
