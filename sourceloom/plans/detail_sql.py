"""DuckDB SQL of the queries in ``detail_queries``."""

from __future__ import annotations

from sourceloom.plans.queries_sql import CHANGES, TRADE

_SALES = """WITH RECURSIVE e AS (SELECT DISTINCT o_orderpriority AS repo, 'c' || o_custkey AS a, 's' || l_suppkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
known AS (SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS file, c_acctbal AS score FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_acctbal FROM supplier),
nodes AS (SELECT * FROM (SELECT repo, a AS id FROM e UNION SELECT repo, b FROM e) JOIN known USING (id)),
both_ways AS (SELECT repo, a, b FROM e UNION ALL SELECT repo, b, a FROM e),
cc(repo, id, comp) USING KEY (repo, id) AS (SELECT repo, id, id FROM nodes
  UNION (SELECT u.repo, u.id, MIN(v.comp) FROM recurring.cc u JOIN both_ways w ON w.repo = u.repo AND w.a = u.id JOIN cc v ON v.repo = w.repo AND v.id = w.b WHERE v.comp < u.comp GROUP BY 1, 2)),
sizes AS (SELECT repo, COUNT(*) AS n, COUNT(DISTINCT comp) AS comps FROM cc GROUP BY repo)
"""
_WEB = r"""WITH web AS (SELECT 'p' || page_id AS id, page_id, regexp_extract(url, '^[^?#]*') AS file, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS lang,
  CASE WHEN page_id % 3 > 0 THEN 'C' || (page_id % 5) END AS class_name FROM pages),
parts AS (SELECT *, list_filter(regexp_split_to_array(file, '[/\\]+'), lambda s: s <> '')[:-2] AS p FROM web)
"""
_LIBS = """, own AS (SELECT * FROM nodes WHERE id NOT LIKE 'r%'), all_calls AS (SELECT source, target FROM calls UNION ALL SELECT '::MAIN::0', 'c' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
"""
_TREE = _WEB[:-1] + """, common AS (SELECT p[1:(SELECT coalesce(MAX(k), 0) FROM range(1, 100) r(k) WHERE k <= least(len(a), len(b)) AND a[1:k] = b[1:k])] AS c, p FROM parts, (SELECT MIN(p) AS a, MAX(p) AS b FROM parts)),
up AS (SELECT p, len(c) AS c, UNNEST(range(len(c) + CASE WHEN len(p) > len(c) THEN 1 ELSE 0 END, len(p) + 1)) AS k FROM (SELECT DISTINCT file, p FROM parts) JOIN (SELECT DISTINCT c FROM common) ON true),
tree AS (SELECT array_to_string(p[1:k], '/') AS folder, (k - c)::INTEGER AS depth, CASE WHEN k > c THEN array_to_string(p[1:k - 1], '/') END AS up, SUM((k = len(p))::BIGINT)::BIGINT AS n_direct FROM up GROUP BY ALL),
folders AS (SELECT folder, depth, CASE WHEN up IN (SELECT folder FROM tree) THEN up END AS parent, n_direct FROM tree)
"""
_SEEN = """WITH first AS (SELECT l_partkey, MIN(o_orderdate) AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey),
placed AS (SELECT 'p' || p_partkey AS id, p_brand AS brand, ROW_NUMBER() OVER (ORDER BY ts ASC NULLS LAST, p_partkey) - 1 AS idx FROM part LEFT JOIN first ON l_partkey = p_partkey),
calls AS (SELECT * FROM (SELECT 'p' || l_partkey AS source, 'p' || LEAD(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS target FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) WHERE target IS NOT NULL),
libs AS (SELECT brand AS id, MIN(idx) + 1 AS appear_at FROM placed GROUP BY brand)
"""
_CIRCLES = """WITH f AS (SELECT concat_ws('/', 'ws', p_brand, CASE WHEN p_size > 25 THEN p_type END, 'f.py') AS file, p_size::DOUBLE AS x, p_retailprice AS y FROM part),
m AS (SELECT file, AVG(x) AS cx, AVG(y) AS cy FROM f GROUP BY file),
c AS (SELECT file, cx, cy, greatest(MAX(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))) + 28, 30) AS r FROM f JOIN m USING (file) GROUP BY file, cx, cy)
"""

ORACLE_SQL = {
    "forest_sizes": _SALES + "SELECT repo, n - comps AS n FROM sizes",
    "detail_clusters": _SALES + "SELECT repo, n - least(floor(((0.999::DOUBLE - 0.4) / (0.999::DOUBLE - 0.001)) * (n - 1))::BIGINT, n - comps) AS n_clusters FROM sizes",
    "graph_components": """WITH RECURSIVE first AS (SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders GROUP BY o_custkey),
e AS (SELECT 'c' || o_custkey AS a, 'p' || l_partkey AS b FROM first JOIN lineitem ON l_orderkey = k WHERE l_linenumber = 1), w AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
nodes AS (SELECT 'c' || c_custkey AS id FROM customer UNION ALL SELECT 'p' || p_partkey FROM part),
cc(id, comp) USING KEY (id) AS (SELECT id, id FROM nodes UNION (SELECT u.id, MIN(v.comp) FROM recurring.cc u JOIN w ON w.a = u.id JOIN cc v ON v.id = w.b WHERE v.comp < u.comp GROUP BY u.id))
SELECT id, comp AS cluster_id FROM cc""",
    "chain_depth": "SELECT 'o' || o_orderkey AS id, (ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1)::INTEGER AS depth FROM orders",
    "page_languages": _WEB + "SELECT DISTINCT lang AS language FROM web WHERE lang IS NOT NULL",
    "structural_clusters": _WEB + """, g AS (SELECT 'file' AS mode, file AS g FROM web UNION ALL SELECT 'class', CASE WHEN class_name IS NULL THEN id ELSE file || '::' || class_name END FROM web),
n AS (SELECT mode, COUNT(DISTINCT g) AS n, COUNT(*) AS members FROM g GROUP BY mode)
SELECT 'web' AS repo, mode, n - floor(((0.999::DOUBLE - 0.4) / (0.999::DOUBLE - 0.001)) * (n - 1))::BIGINT AS n, members FROM n""",
    "class_groups": _WEB + "SELECT id, CASE WHEN class_name IS NULL THEN id ELSE file || '::' || class_name END AS cluster_id FROM web",
    "project_names": _WEB + r""", q AS (SELECT regexp_extract(file, '^https?://([^/]*)', 1) AS repo, list_filter(regexp_split_to_array(file, '[/\\]'), lambda s: s <> '') AS s FROM web UNION ALL SELECT 'web', list_filter(regexp_split_to_array(file, '[/\\]'), lambda s: s <> '') FROM web),
x AS (SELECT repo, MIN(s) AS a, MAX(s) AS b FROM q GROUP BY repo), k AS (SELECT repo, a, (SELECT coalesce(MAX(i), 0) FROM range(1, 100) r(i) WHERE i <= least(len(a), len(b)) AND a[1:i] = b[1:i]) AS k FROM x)
SELECT repo, CASE WHEN k > 0 THEN a[k] ELSE 'Project' END AS name FROM k""",
    "project_degrees": TRADE + _LIBS + "SELECT n.id, COUNT(e.id) AS degree FROM own n LEFT JOIN (SELECT source AS id FROM calls WHERE target NOT LIKE 'r%' UNION ALL SELECT target FROM calls WHERE target NOT LIKE 'r%') e ON e.id = n.id GROUP BY n.id",
    "orphans": TRADE + """, few AS (SELECT source, target FROM calls WHERE regexp_matches(source, '^c[0-9]*7$') OR source LIKE 'n%' UNION ALL
  SELECT NULL, NULL WHERE false) SELECT id FROM nodes WHERE id NOT IN (SELECT source FROM few UNION SELECT target FROM few)""",
    "auto_levels": """WITH n AS (SELECT o_orderpriority AS repo, COUNT(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'nations', COUNT(*) FROM nation)
SELECT repo, n, CASE WHEN n >= 500 THEN round(greatest(0.1::DOUBLE, least(0.9::DOUBLE, 500.0::DOUBLE / n)), 9) END AS level FROM n""",
    "ego_links": TRADE + _LIBS + "SELECT DISTINCT source, target FROM all_calls WHERE source IN ('s1', 's2', 'n3') OR target IN ('s1', 's2', 'n3')",
    "visible_links": TRADE + _LIBS + "SELECT source, target FROM calls WHERE source NOT LIKE '%3' AND target NOT LIKE '%3'",
    "view_filters": _WEB + r""", v AS (SELECT *, id LIKE '%9' AS lib, id NOT LIKE '%4' AS there, regexp_extract(file, '^https?://[^/]*') AS host, regexp_replace(file, '[/\\][^/\\]*$', '') AS dir FROM web), h AS (SELECT MIN(host) AS h FROM v)
SELECT 'search' AS filter, id FROM v WHERE 'page ' || page_id LIKE '%page 1%' UNION ALL SELECT 'no_libraries', id FROM v WHERE NOT lib UNION ALL SELECT 'existing', id FROM v WHERE lib OR there
UNION ALL SELECT 'no_orphans', id FROM v WHERE lib OR class_name IS NOT NULL UNION ALL SELECT 'only', id FROM v, h WHERE lib OR dir = h OR starts_with(dir, h || '/') UNION ALL SELECT 'hidden', id FROM v, h WHERE lib OR NOT (dir = h OR starts_with(dir, h || '/'))
UNION ALL SELECT 'time', id FROM v WHERE id NOT LIKE '%1'""",
    "file_rollup": """WITH n AS (SELECT 'p' || p_partkey AS id, p_brand || '.js' AS file, CASE WHEN p_size > 25 THEN p_type END AS lang FROM part WHERE p_size <> 50),
f AS (SELECT file, COUNT(*) AS n, arg_min(lang, id) FILTER (WHERE lang IS NOT NULL) AS lang FROM n GROUP BY file)
SELECT file, n, coalesce(lang, 'javascript') AS language FROM f UNION ALL SELECT 's' || s_suppkey || '.py', 0, 'python' FROM supplier WHERE s_nationkey > 5""",
    "class_rollup": """SELECT p_brand || '::' || p_type AS class_key, arg_min(p_name, 'p' || p_partkey) AS class_extends, string_agg('p' || p_partkey, ',' ORDER BY 'p' || p_partkey) AS members FROM part WHERE p_size > 10 GROUP BY p_brand, p_type""",
    "folder_tree": _TREE + "SELECT * FROM folders",
    "folder_pages": _WEB + ", a AS (SELECT p, UNNEST(range(1, len(p) + 1)) AS k FROM parts) SELECT array_to_string(p[1:k], '/') AS folder, COUNT(*) AS n FROM a GROUP BY 1",
    "folder_siblings": _TREE + "SELECT x.folder AS a, y.folder AS b FROM folders x JOIN folders y ON x.parent = y.parent AND x.folder < y.folder",
    "parsed_status": """WITH c AS (SELECT 'n' || c_nationkey AS repo, '/ws/src/c' || c_custkey AS file, ['M ', ' M', 'A ', ' D', '??', 'RM', 'D ', 'AM'][c_custkey % 8 + 1] AS s FROM customer),
d AS (SELECT repo, file, CASE WHEN s = '??' THEN 'added' WHEN s[2] = 'M' THEN 'modified' WHEN s[2] = 'D' THEN 'deleted' WHEN s = 'A ' THEN 'added' END AS unstaged,
  CASE WHEN s[1] = 'A' THEN 'added' WHEN s[1] = 'D' THEN 'deleted' WHEN s[1] NOT IN (' ', '?') THEN 'modified' END AS staged FROM c) SELECT *, coalesce(unstaged, staged) AS effective FROM d""",
    "parsed_diff": """WITH h AS (SELECT 'o' || l_orderkey AS repo, '/ws/f' || CASE WHEN l_linenumber = 2 THEN ' ' ELSE '' END || l_linenumber AS file, l_linenumber::INTEGER AS start, CASE WHEN l_quantity = 1 THEN 1 ELSE floor(l_quantity / 10)::INTEGER END AS d, l_returnflag = 'R' AS is_new FROM lineitem)
SELECT repo, file, start, CASE WHEN d > 0 THEN start + d - 1 ELSE start END::INTEGER AS "end", is_new, COUNT(*) AS n FROM h GROUP BY ALL""",
    "parsed_blame": """SELECT 'c' || o_custkey AS file, (ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INTEGER AS line, sha1(strftime(o_orderdate, '%Y-%m')) AS sha, epoch(date_trunc('month', o_orderdate))::BIGINT AS author_time FROM orders""",
    "introduced": """WITH b AS (SELECT o_custkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, epoch(date_trunc('month', o_orderdate))::BIGINT AS ts FROM orders)
SELECT 'n' || o_custkey AS id, ts FROM b WHERE k = o_custkey % 12""",
    "attributed_changes": CHANGES + """, found AS (SELECT id, r.f, CASE WHEN COUNT(hs) FILTER (WHERE NOT st) = 0 THEN NULL WHEN bool_or(nw AND hs <= s AND he >= s) FILTER (WHERE NOT st) THEN 'added' ELSE 'modified' END AS hu,
  CASE WHEN COUNT(hs) FILTER (WHERE st) = 0 THEN NULL WHEN bool_or(nw AND hs <= s AND he >= s) FILTER (WHERE st) THEN 'added' ELSE 'modified' END AS ht
  FROM r LEFT JOIN h ON r.f = h.f AND hs <= coalesce(e, 2147483647) AND he >= s GROUP BY id, r.f),
st AS (SELECT c_custkey AS f, CASE c_mktsegment WHEN 'BUILDING' THEN 'added' WHEN 'MACHINERY' THEN 'deleted' WHEN 'HOUSEHOLD' THEN 'modified' END AS fu, CASE WHEN c_acctbal > 0 THEN 'modified' END AS fs FROM customer WHERE c_mktsegment <> 'AUTOMOBILE')
SELECT id, CASE WHEN st.f IS NULL THEN NULL WHEN fu IN ('added', 'deleted') THEN fu ELSE hu END AS unstaged, CASE WHEN st.f IS NULL THEN NULL WHEN fu IN ('added', 'deleted') THEN fs ELSE ht END AS staged FROM found LEFT JOIN st ON st.f = found.f""",
    "library_first_seen": _SEEN + "SELECT * FROM libs",
    "snapshot_counts": _SEEN + """, n AS (SELECT id FROM placed WHERE idx < 150 UNION ALL SELECT id FROM libs WHERE appear_at <= 150), e AS (SELECT source, target FROM calls UNION ALL SELECT id, brand FROM placed)
SELECT id, 'node' AS kind FROM n UNION ALL SELECT source || '>' || target, 'edge' FROM e WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)""",
    "edge_growth": _SEEN + """, b AS (SELECT greatest(x.idx, y.idx) + 1 AS k, COUNT(*) AS n FROM calls JOIN placed x ON x.id = source JOIN placed y ON y.id = target GROUP BY 1)
SELECT k, SUM(n) OVER (ORDER BY k)::BIGINT AS n_edges FROM b""",
    "brand_centroids": "SELECT p_brand AS cluster_id, round(AVG(p_size::DOUBLE), 6) AS x, round(AVG(p_retailprice), 6) AS y FROM part WHERE p_size > 2 GROUP BY p_brand",
    "file_circles": _CIRCLES + "SELECT file, round(cx, 6) AS cx, round(cy, 6) AS cy, round(r, 6) AS r FROM c",
    "folder_boxes": _CIRCLES + """, u AS (SELECT cx, cy, 0.92 * r AS h, string_split(file, '/')[:-2] AS p, UNNEST(range(1, len(string_split(file, '/')))) AS k FROM c)
SELECT array_to_string(p[1:k], '/') AS folder, round(MIN(cx - h - 40 * (len(p) - k + 1)), 5) AS min_x, round(MIN(cy - h - 40 * (len(p) - k + 1)), 5) AS min_y, round(MAX(cx + h + 40 * (len(p) - k + 1)), 5) AS max_x, round(MAX(cy + h + 40 * (len(p) - k + 1)), 5) AS max_y FROM u GROUP BY 1""",
    "feed_debounce": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - LAG(ts) OVER w > INTERVAL 6 HOURS THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g) SELECT user_id, strftime(MAX(ts) + INTERVAL 6 HOURS, '%Y-%m-%d %H:%M:%S.%f') AS fire_at, COUNT(*) AS n FROM r GROUP BY user_id, run""",
    "feed_status": "SELECT 'u' || user_id AS id, arg_max(event_type, ts) AS status, strftime(MAX(ts), '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events GROUP BY user_id",
    "feed_first_seen": "SELECT 'u' || user_id AS id, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events GROUP BY user_id",
    "feed_edges": "SELECT 'u' || user_id AS source, event_type AS target, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events GROUP BY ALL",
    "feed_routes": """SELECT event_type || ['.py', '.md', '.tsx', ''][event_id % 4 + 1] AS file, CASE WHEN event_id % 2 = 0 THEN 'analysis' ELSE 'status' END AS route, COUNT(*) AS n FROM events GROUP BY 1, 2""",
    "feed_replaced": """WITH f AS (SELECT DISTINCT 'u' || user_id AS file, event_type AS name FROM events), c AS (SELECT DISTINCT 'u' || user_id AS file FROM events WHERE ts < TIMESTAMP '2024-01-02')
SELECT file, name FROM f WHERE file NOT IN (FROM c) OR name = 'purchase'""",
}
ORACLE_SQL["cluster_view"] = _SALES + """, deg AS (SELECT repo, a AS id, COUNT(*) AS d FROM both_ways GROUP BY 1, 2),
m AS (SELECT n.*, d, CASE WHEN id LIKE 's%' THEN id ELSE file END AS cl, ROW_NUMBER() OVER (PARTITION BY repo, CASE WHEN id LIKE 's%' THEN id ELSE file END ORDER BY score DESC, id) AS place FROM nodes n JOIN deg USING (repo, id)),
g AS (SELECT repo, cl, COUNT(*) AS n, MAX(CASE WHEN place = 1 THEN id END) AS top, MAX(d) AS d, MAX(file) AS file FROM m GROUP BY 1, 2)
SELECT repo, cl AS id, top || CASE WHEN n > 1 THEN ' +' || (n - 1) ELSE '' END AS label, n, round(CASE WHEN n = 1 THEN greatest(6, 6 + sqrt(d) * 2.5) ELSE 36 * greatest(1, log2(n + 1)) END, 6) AS size, n > 1 AS is_cluster, CASE WHEN n = 1 THEN file END AS file FROM g"""
ORACLE_SQL["cluster_labels"] = _SALES + """, m AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY repo, file ORDER BY score DESC, id) AS place FROM nodes), g AS (SELECT repo, file, COUNT(*) AS n, MAX(CASE WHEN place = 1 THEN id END) AS top FROM m GROUP BY 1, 2)
SELECT repo, file AS cluster_id, top || CASE WHEN n > 1 THEN ' +' || (n - 1) ELSE '' END AS label, n FROM g"""
ORACLE_SQL["detail_view"] = TRADE + _LIBS + """, deg AS (SELECT n.id, COUNT(e.id) AS d FROM own n LEFT JOIN (SELECT source AS id FROM calls WHERE target NOT LIKE 'r%' UNION ALL SELECT target FROM calls WHERE target NOT LIKE 'r%') e ON e.id = n.id GROUP BY n.id)
SELECT id, id AS label, round(greatest(6, 6 + sqrt(d) * 2.5), 6) AS size, id IN (SELECT target FROM all_calls WHERE source = '::MAIN::0') AS is_entry, false AS is_library FROM deg
UNION ALL SELECT id, id, 6, NULL, true FROM nodes WHERE id LIKE 'r%' UNION ALL SELECT source, target, NULL, NULL, target LIKE 'r%' FROM calls"""
_LEDGERS = """WITH o AS (SELECT c_mktsegment AS repo, o_custkey AS c, 'o' || o_orderkey AS id, o_orderpriority AS f, o_totalprice::DOUBLE AS s, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i
  FROM orders JOIN customer ON c_custkey = o_custkey),
chain AS (SELECT a.repo, a.c, b.i, a.id AS source, b.id AS target, (a.s + b.s) - CASE WHEN a.f = b.f THEN 0.05 ELSE 0.0 END::DOUBLE AS w, true AS chained FROM o a JOIN o b ON a.c = b.c AND b.i = a.i + 1),
hub AS (SELECT repo, c, i, 'c' || c AS source, id AS target, (c::DOUBLE + 1e7::DOUBLE) + s AS w, false AS chained FROM o QUALIFY ROW_NUMBER() OVER (PARTITION BY c ORDER BY (c::DOUBLE + 1e7::DOUBLE) + s, id) = 1),
placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY repo ORDER BY w, source, target) - 1 AS place FROM (FROM chain UNION ALL FROM hub)),
sizes AS (SELECT repo, COUNT(*) + COUNT(DISTINCT c) AS n FROM o GROUP BY repo),
asked AS (SELECT repo, level, floor(((0.999::DOUBLE - level) / (0.999::DOUBLE - 0.001::DOUBLE)) * (n - 1)) AS k FROM sizes, (SELECT UNNEST([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS level)),
runs AS (SELECT o.repo, level, o.c, o.id, o.i, SUM(CASE WHEN p.place < k THEN 0 ELSE 1 END) OVER (PARTITION BY level, o.c ORDER BY o.i) AS run FROM o JOIN asked USING (repo) LEFT JOIN placed p ON p.c = o.c AND p.i = o.i AND p.chained),
members AS (SELECT repo, level, c, id, run FROM runs UNION ALL
  SELECT r.repo, r.level, r.c, p.source, CASE WHEN p.place < k THEN run ELSE 0 END FROM placed p JOIN runs r ON r.c = p.c AND r.i = p.i JOIN asked a ON a.repo = r.repo AND a.level = r.level WHERE NOT p.chained),
cut AS (SELECT repo, level, c, id, MIN(id) OVER (PARTITION BY level, c, run) AS cluster_id FROM members)
"""
ORACLE_SQL["detail_levels"] = _LEDGERS + "SELECT repo, level, id, cluster_id FROM cut"
ORACLE_SQL["detail_expanded"] = _LEDGERS + """, known AS (SELECT id, s AS score, i, c FROM o UNION ALL SELECT DISTINCT 'c' || c, c::DOUBLE + 1e7::DOUBLE, NULL, c FROM o),
edges AS (SELECT repo, source, target FROM chain UNION ALL SELECT repo, 'c' || c, id FROM o),
deg AS (SELECT id, COUNT(*) AS d FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id),
a AS (SELECT repo, id, cluster_id, COUNT(*) OVER g AS n, score, d, ROW_NUMBER() OVER (PARTITION BY cluster_id ORDER BY score DESC, id) AS place, cluster_id LIKE '%7' AND COUNT(*) OVER g > 1 AS open
  FROM cut JOIN known USING (id) JOIN deg USING (id) WHERE level = 0.4::DOUBLE WINDOW g AS (PARTITION BY cluster_id)),
r AS (SELECT repo, id, CASE WHEN open THEN id ELSE cluster_id END AS rendered FROM a),
used AS (SELECT c_mktsegment AS repo, 'o' || o_orderkey AS source, o_orderpriority AS lib, o_orderstatus AS fn FROM orders JOIN customer ON o_custkey = c_custkey),
libs AS (SELECT repo, lib, COUNT(DISTINCT fn) AS n FROM used GROUP BY repo, lib),
shelf AS (SELECT DISTINCT repo, lib, fn, CASE WHEN lib LIKE '1%' THEN 'library::' || lib || '::' || fn ELSE 'libcluster::' || lib END AS id FROM used)
SELECT repo, CASE WHEN open THEN id ELSE cluster_id END AS id, CASE WHEN n > 1 AND NOT open THEN upper(id) || ' +' || (n - 1) ELSE upper(id) END AS label,
  round(CASE WHEN n = 1 OR open THEN greatest(6, 6 + sqrt(d) * 2.5) ELSE 36 * greatest(1, log2(n + 1)) END, 6) AS size, CASE WHEN open THEN 1 ELSE n END AS n, false AS is_library FROM a WHERE open OR place = 1
UNION ALL SELECT DISTINCT repo, s.id, CASE WHEN lib LIKE '1%' THEN fn ELSE lib || ' (' || n || ')' END, CASE WHEN lib LIKE '1%' THEN 6 ELSE 8 END, CASE WHEN lib LIKE '1%' THEN 1 ELSE n END, true FROM shelf s JOIN libs USING (repo, lib)
UNION ALL SELECT DISTINCT e.repo, x.rendered, y.rendered, NULL, 0, false FROM edges e JOIN r x ON x.id = e.source JOIN r y ON y.id = e.target WHERE x.rendered <> y.rendered
UNION ALL SELECT DISTINCT u.repo, rendered, s.id, NULL, 0, true FROM used u JOIN r ON r.id = u.source JOIN shelf s ON s.repo = u.repo AND s.lib = u.lib AND s.fn = u.fn"""
ORACLE_SQL["trade_components"] = """WITH RECURSIVE e AS (SELECT 'o' || l_orderkey AS a, 'p' || l_partkey AS b FROM lineitem UNION SELECT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem UNION SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders),
w AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
nodes AS (SELECT 'o' || o_orderkey AS id FROM orders UNION ALL SELECT 'p' || p_partkey FROM part UNION ALL SELECT 's' || s_suppkey FROM supplier UNION ALL SELECT 'c' || c_custkey FROM customer UNION ALL SELECT 'r' || r_regionkey FROM region),
cc(id, comp) USING KEY (id) AS (SELECT id, id FROM nodes UNION (SELECT u.id, MIN(v.comp) FROM recurring.cc u JOIN w ON w.a = u.id JOIN cc v ON v.id = w.b WHERE v.comp < u.comp GROUP BY u.id))
SELECT id, comp AS cluster_id FROM cc"""
ORACLE_SQL["folders_hidden"] = _WEB + r""", v AS (SELECT id, file, page_id, regexp_extract(file, '^https?://[^/]*') AS host, regexp_replace(file, '[/\\][^/\\]*$', '') AS dir FROM web),
gone AS (SELECT DISTINCT dir FROM v WHERE page_id % 7 = 0), hosts AS (SELECT DISTINCT host FROM v WHERE id NOT LIKE '%5')
SELECT id, file FROM v WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE v.dir = g.dir OR starts_with(v.dir, g.dir || '/')) AND EXISTS (SELECT 1 FROM hosts h WHERE v.dir = h.host OR starts_with(v.dir, h.host || '/'))"""
ORACLE_SQL["structural_assignment"] = _WEB + r""", g AS (SELECT file AS g, MIN(id) AS ord, regexp_split_to_array(file, '[/\\]') AS s FROM web GROUP BY file),
total AS (SELECT COUNT(*) AS n, floor(((0.999::DOUBLE - 0.4) / (0.999::DOUBLE - 0.001)) * (COUNT(*) - 1)) AS budget, MAX(len(s)) AS most FROM g),
keyed AS (SELECT k, g, ord, s, CASE WHEN len(s) >= k THEN 'p' || array_to_string(s[1:k], '/') ELSE 'g' || g END AS child, CASE WHEN k = 0 THEN 'p' WHEN len(s) >= k - 1 THEN 'p' || array_to_string(s[1:k - 1], '/') ELSE 'g' || g END AS parent FROM g, total, LATERAL (SELECT UNNEST(range(0, most + 2)) AS k)),
fits AS (SELECT k, n - COUNT(DISTINCT child) AS merges FROM keyed, total GROUP BY k, n, budget HAVING n - COUNT(DISTINCT child) <= budget),
plan AS (SELECT k, budget - merges AS rest FROM fits, total WHERE k = (SELECT MIN(k) FROM fits)),
own AS (SELECT keyed.*, rest FROM keyed JOIN plan USING (k)),
children AS (SELECT parent, child, rest, MIN((ord, g)) AS first FROM own GROUP BY ALL),
heads AS (SELECT *, MIN((first, child)) OVER (PARTITION BY parent) AS head FROM children),
moved AS (SELECT child, head[2] AS target, rest, ROW_NUMBER() OVER (ORDER BY head[1], first) - 1 AS place FROM heads WHERE child <> head[2]),
placed AS (SELECT own.g, own.ord, own.s, coalesce(m.target, own.child) AS part FROM own LEFT JOIN (SELECT * FROM moved WHERE place < rest) m USING (child)),
named AS (SELECT part, MIN((ord, g)) AS first, COUNT(*) AS n, MIN(s) AS low, MAX(s) AS high FROM placed GROUP BY part),
labelled AS (SELECT part, first[2] AS cluster_id, n, low, first, (SELECT coalesce(MAX(i), 0) FROM range(1, 100) r(i) WHERE i <= least(len(low), len(high)) AND low[1:i] = high[1:i]) AS k FROM named)
SELECT web.id, cluster_id, CASE WHEN n > 1 AND array_to_string(low[1:k], '') <> '' THEN low[k] ELSE regexp_extract(cluster_id, '[^/\\]*$') END AS label
FROM web JOIN placed ON placed.g = web.file JOIN labelled USING (part)"""
