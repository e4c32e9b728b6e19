"""DuckDB SQL of the queries in ``queries``."""

from __future__ import annotations

TRADE = """WITH RECURSIVE nodes AS (
  SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS file, c_mktsegment AS lang FROM customer UNION ALL
  SELECT 's' || s_suppkey, 'n' || s_nationkey, NULL FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'n' || n_nationkey, NULL FROM nation
  UNION ALL SELECT 'r' || r_regionkey, NULL, NULL FROM region),
calls AS (SELECT DISTINCT 'c' || o_custkey AS source, 's' || l_suppkey AS target FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
walk AS (SELECT 'c' || c_custkey AS id, 0 AS depth FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION SELECT target, depth + 1 FROM walk JOIN calls ON source = id),
reached AS (SELECT id, MIN(depth) AS depth FROM walk GROUP BY id),
top AS (SELECT greatest(1, MAX(depth)) AS m FROM reached),
depths AS (SELECT id, coalesce(depth, m + 1)::INTEGER AS depth FROM nodes LEFT JOIN reached USING (id), top),
indeg AS (SELECT n.id, COUNT(target) AS in_degree FROM nodes n LEFT JOIN calls ON target = n.id GROUP BY n.id)
"""

CHANGES = """WITH r AS (SELECT o_orderkey AS id, o_custkey AS f, datediff('day', DATE '1995-01-01', o_orderdate::DATE) AS s,
  LEAD(datediff('day', DATE '1995-01-01', o_orderdate::DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS e FROM orders),
h AS (SELECT o_custkey AS f, datediff('day', DATE '1995-01-01', l_shipdate::DATE) AS hs, datediff('day', DATE '1995-01-01', l_shipdate::DATE) + l_quantity::INTEGER - 1 AS he, l_returnflag = 'R' AS nw, l_linestatus = 'F' AS st
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""

ORACLE_SQL = {
    "graph_degrees": TRADE + "SELECT n.id, COUNT(e.id) AS degree FROM nodes n LEFT JOIN (SELECT source AS id FROM calls UNION ALL SELECT target FROM calls) e ON e.id = n.id GROUP BY n.id",
    "graph_in_degrees": TRADE + "SELECT * FROM indeg",
    "graph_depth": TRADE + "SELECT * FROM depths",
    "graph_importance": TRADE + """SELECT id, round(0.4::DOUBLE * (1 - least(depth, m + 1) / (m + 1)::DOUBLE) + 0.6::DOUBLE * (in_degree / greatest(1, MAX(in_degree) OVER ())::DOUBLE), 9) AS score
FROM depths JOIN indeg USING (id), top""",
    "graph_quotient": TRADE + """, shown AS (SELECT id, CASE WHEN file = 'n3' THEN id ELSE coalesce(file, id) END AS r FROM nodes)
SELECT a.r AS source, b.r AS target, COUNT(*) AS calls FROM calls JOIN shown a ON a.id = source JOIN shown b ON b.id = target WHERE a.r <> b.r GROUP BY a.r, b.r""",
    "graph_languages": TRADE + """, counts AS (SELECT coalesce(file, id) AS cluster_id, coalesce(lang, 'unknown') AS lang, COUNT(*) AS n FROM nodes GROUP BY 1, 2),
shares AS (SELECT cluster_id, lang, n, SUM(n) OVER (PARTITION BY cluster_id) AS total FROM counts)
SELECT cluster_id, lang, n, round(n / total::DOUBLE, 9) AS fraction FROM shares WHERE total > 1""",
    "folder_counts": r"""WITH f AS (SELECT DISTINCT regexp_extract(url, '^[^?#]*') AS file FROM pages),
p AS (SELECT file, list_filter(regexp_split_to_array(file, '[/\\]+'), lambda s: s <> '') AS p FROM f),
d AS (SELECT file, p, UNNEST(range(1, len(p))) AS depth FROM p)
SELECT array_to_string(p[1:depth], '/') AS folder, depth::INTEGER AS depth, COUNT(*) AS n_files FROM d GROUP BY 1, 2""",
    "change_status": CHANGES + """SELECT id, CASE WHEN COUNT(hs) = 0 THEN NULL WHEN bool_or(nw AND hs <= s AND he >= s) THEN 'added' ELSE 'modified' END AS status
FROM r LEFT JOIN h ON r.f = h.f AND hs <= coalesce(e, 2147483647) AND he >= s GROUP BY id""",
    "part_timeline": """SELECT p_partkey AS id, ROW_NUMBER() OVER (ORDER BY ts ASC NULLS LAST, p_partkey) - 1 AS idx FROM part LEFT JOIN
  (SELECT l_partkey, MIN(o_orderdate) AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey) ON l_partkey = p_partkey""",
}
