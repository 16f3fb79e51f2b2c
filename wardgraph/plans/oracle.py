"""SQL that states the queries' results, for an engine with recursive common table expressions."""

from __future__ import annotations

from ..functions import registry


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


#: The identity graph, tier 0 and the edges that routes may use.
GRAPH = f"""
WITH RECURSIVE nodes AS (
  SELECT 'C' || CAST(c_custkey AS VARCHAR) AS object_id, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'SVC_' || c_name ELSE c_name END AS name,
         'User' AS node_type, c_acctbal >= 0 AS enabled, c_custkey % 10 = 0 AS admin_count FROM customer
  UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR), s_name, 'Computer', true, false FROM supplier
  UNION ALL SELECT CASE WHEN n_nationkey = 0 THEN 'S-1-5-21-0-512' ELSE 'N' || CAST(n_nationkey AS VARCHAR) END, n_name, 'Group', true, false FROM nation
  UNION ALL SELECT 'R' || CAST(r_regionkey AS VARCHAR), r_name, 'OU', true, false FROM region
), nat AS (
  SELECT n_nationkey AS k, n_regionkey AS r, CASE WHEN n_nationkey = 0 THEN 'S-1-5-21-0-512' ELSE 'N' || CAST(n_nationkey AS VARCHAR) END AS id FROM nation
), edges AS (
  SELECT 'C' || CAST(c_custkey AS VARCHAR) AS src, nat.id AS dst, 'MemberOf' AS edge_type FROM customer JOIN nat ON c_nationkey = nat.k
  UNION SELECT a.id, b.id, 'MemberOf' FROM nat a JOIN nat b ON b.k = (7 * a.k + 3) % 25 WHERE a.k % 4 = 1 AND b.k <> 0
  UNION SELECT 'R' || CAST(r AS VARCHAR), id, 'Contains' FROM nat
  UNION SELECT nat.id, 'S' || CAST(s_suppkey AS VARCHAR), 'AdminTo' FROM supplier JOIN nat ON s_nationkey = nat.k
  UNION SELECT 'S' || CAST(l_suppkey AS VARCHAR), 'C' || CAST(o_custkey AS VARCHAR), 'HasSession' FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE l_returnflag = 'R' AND l_quantity >= 49 AND l_linenumber = 1
  UNION SELECT 'C' || CAST(o_custkey AS VARCHAR), 'C' || CAST(o_orderkey % n AS VARCHAR),
               CASE o_orderstatus WHEN 'F' THEN 'ForceChangePassword' WHEN 'O' THEN 'GenericWrite' ELSE 'WriteDacl' END
        FROM orders, (SELECT count(*) AS n FROM customer) c WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 420000 AND o_custkey <> o_orderkey % n
), members AS (SELECT src, dst FROM edges WHERE edge_type = 'MemberOf'),
top(id) AS (
  SELECT object_id FROM nodes WHERE object_id LIKE '%-512'
  UNION SELECT m.src FROM top JOIN members m ON m.dst = top.id
), hops AS (
  SELECT src, dst, edge_type, edge_type NOT IN ({_list(registry.PLAIN_STRUCTURE)}) AS attack FROM edges WHERE src NOT IN (SELECT id FROM top)
), tiered AS (
  SELECT n.*, CASE WHEN object_id IN (SELECT id FROM top) THEN 0
                   WHEN object_id IN (SELECT src FROM edges WHERE edge_type = 'AdminTo' AND dst IN (SELECT id FROM top)) THEN 1 ELSE 2 END AS tier FROM nodes n
)"""

#: Kinds of edges that the graph has, with what is known of each.
DIM = (
    ", dim(edge_type, weight, effort, noise, conf, cut) AS (SELECT * FROM (VALUES "
    + ", ".join(
        f"('{n}', {10 / x if x else 100.0}, {0 if n in registry.FREE or not x else 11 - x}, {0 if n in registry.FREE or not x else {'low': 3, 'medium': 2, 'high': 1}[d]}, {1 if n == 'HasSession' else registry.CONFIDENCES.index(c) + 1}, {'false' if n in registry.UNCUTTABLE else 'true'})"
        for n, _, _, x, _, d, _, c, _ in registry.EDGES
        if n in ("MemberOf", "Contains", "AdminTo", "HasSession", "ForceChangePassword", "GenericWrite", "WriteDacl")
    )
    + ") v(edge_type, weight, effort, noise, conf, cut))"
)

#: States of the backward search with their distance.
STATES = GRAPH + """, walk(id, attacked, d) AS (
  SELECT id, false, 0 FROM top
  UNION SELECT h.src, w.attacked OR h.attack, w.d + 1 FROM walk w JOIN hops h ON h.dst = w.id WHERE w.d < 24
), states AS (SELECT id, attacked, min(d) AS depth FROM walk GROUP BY id, attacked)"""

#: The shortest 10,000 simple paths of at most 20 steps, a level a round; ``before`` counts those found up to a level, after which it stops.
PATHS = GRAPH + DIM + """, h AS (SELECT hops.*, weight, effort, noise, conf, cut FROM hops JOIN dim USING (edge_type)
), grown(source, target, length, weight, attacked, nl, el, before) AS (
  SELECT id, id, 0, 0.0::DOUBLE, false, [id], []::VARCHAR[], 0::BIGINT FROM top
  UNION ALL
  SELECT h.src, p.target, p.length + 1, p.weight + h.weight, p.attacked OR h.attack, list_prepend(h.src, p.nl), list_prepend(h.edge_type, p.el),
         CAST(p.before + sum(CASE WHEN p.attacked OR h.attack THEN 1 ELSE 0 END) OVER () AS BIGINT)
  FROM grown p JOIN h ON h.dst = p.source WHERE p.length < 20 AND p.before < 10000 AND NOT list_contains(p.nl, h.src)
), paths AS MATERIALIZED (
  SELECT *, ns || '|' || es AS path_id FROM (
    SELECT source, target, length, weight, nl, el, array_to_string(nl, '>') AS ns, array_to_string(el, '>') AS es FROM grown WHERE attacked ORDER BY length, target, nl, el LIMIT 10000) u
), steps AS (
  SELECT path_id, CAST(i AS INTEGER) AS step, nl[i] AS src, nl[i + 1] AS dst, el[i] AS edge_type FROM (SELECT path_id, nl, el, unnest(range(1, length + 1)) AS i FROM paths) u
), visited AS (
  SELECT path_id, unnest(nl) AS object_id FROM paths
), cuts AS (
  SELECT DISTINCT s.path_id, s.src, s.dst, s.edge_type,
         CASE WHEN n.name LIKE 'SVC_%' THEN 2 ELSE 0 END - CASE WHEN NOT n.enabled THEN 1 ELSE 0 END + CASE WHEN n.admin_count THEN 1 ELSE 0 END AS safety
  FROM steps s JOIN dim USING (edge_type) JOIN nodes n ON n.object_id = s.src WHERE dim.cut
)"""


def greedy(rounds: int) -> str:
    """Rounds of the greedy cover, unrolled."""
    sql = PATHS + ", left0 AS (SELECT * FROM cuts)"
    for k in range(1, rounds + 1):
        sql += f""", best{k} AS (SELECT src, dst, edge_type, safety, count(*) AS n FROM left{k - 1} GROUP BY src, dst, edge_type, safety ORDER BY n DESC, safety, src, dst, edge_type LIMIT 1
), left{k} AS (SELECT l.* FROM left{k - 1} l WHERE l.path_id NOT IN (SELECT x.path_id FROM left{k - 1} x JOIN best{k} b ON x.src = b.src AND x.dst = b.dst AND x.edge_type = b.edge_type))"""
    rows = " UNION ALL ".join(f"SELECT {k} AS rank, src, dst, edge_type, n FROM best{k}" for k in range(1, rounds + 1))
    return sql + f", fixes AS (SELECT rank, src, dst, edge_type, n AS eliminated, CAST(sum(n) OVER (ORDER BY rank) AS BIGINT) AS cumulative FROM ({rows}) r)"


ORACLES: dict[str, str] = {}

ORACLES["exposure_hops"] = STATES + " SELECT id, depth AS hops FROM states WHERE attacked AND id NOT IN (SELECT id FROM top)"
ORACLES["exposure_routes"] = STATES + """
, nxt AS (SELECT h.src AS id, s.attacked OR h.attack AS attacked, s.depth + 1 AS depth, h.edge_type, h.dst AS next_id, s.attacked AS next_attacked FROM hops h JOIN states s ON s.id = h.dst
), ranked AS (SELECT n.*, row_number() OVER (PARTITION BY n.id, n.attacked ORDER BY n.edge_type, n.next_id, n.next_attacked) AS r FROM nxt n JOIN states s ON s.id = n.id AND s.attacked = n.attacked AND s.depth = n.depth)
SELECT id, attacked, depth, next_id, next_attacked, edge_type FROM ranked WHERE r = 1"""
ORACLES["tier_classification"] = GRAPH + " SELECT object_id, node_type, CAST(tier AS INTEGER) AS tier FROM tiered"
ORACLES["summary_counts"] = GRAPH + """ SELECT 'node' AS kind, node_type AS label, count(*) AS n FROM tiered GROUP BY node_type
UNION ALL SELECT 'tier', CAST(tier AS VARCHAR), count(*) FROM tiered GROUP BY tier UNION ALL SELECT 'edge', edge_type, count(*) FROM edges GROUP BY edge_type"""
ORACLES["group_members"] = GRAPH + """, c(origin, id, d) AS (SELECT object_id, object_id, 0 FROM nodes WHERE node_type = 'Group' UNION SELECT c.origin, m.src, c.d + 1 FROM c JOIN members m ON m.dst = c.id WHERE c.d < 30)
SELECT origin AS group_id, id AS member_id, CAST(min(d) AS INTEGER) AS depth FROM c WHERE NOT (origin = id) GROUP BY origin, id"""
ORACLES["group_ancestors"] = GRAPH + """, c(origin, id, d) AS (SELECT object_id, object_id, 0 FROM nodes WHERE node_type = 'User' UNION SELECT c.origin, m.dst, c.d + 1 FROM c JOIN members m ON m.src = c.id WHERE c.d < 30)
SELECT origin AS principal_id, id AS group_id, CAST(min(d) AS INTEGER) AS depth FROM c WHERE NOT (origin = id) GROUP BY origin, id"""
ORACLES["effective_permissions"] = GRAPH + """, c(origin, id, d) AS (SELECT object_id, object_id, 0 FROM nodes WHERE node_type = 'User' UNION SELECT c.origin, m.dst, c.d + 1 FROM c JOIN members m ON m.src = c.id WHERE c.d < 30),
own AS (SELECT origin, id, min(d) AS d FROM c GROUP BY origin, id)
SELECT origin AS principal_id, dst AS target_id, edge_type, CASE WHEN d > 0 THEN id END AS via FROM own JOIN edges ON edges.src = own.id WHERE edge_type <> 'MemberOf'"""
_FORWARD = lambda depth: f""", f(origin, id, d) AS (SELECT object_id, object_id, 0 FROM nodes WHERE node_type IN ('Group', 'OU') UNION SELECT f.origin, e.dst, f.d + 1 FROM f JOIN edges e ON e.src = f.id WHERE f.d < {depth}
), reach AS (SELECT origin, id, min(d) AS depth FROM f GROUP BY origin, id HAVING min(d) > 0)"""
ORACLES["blast_radius"] = GRAPH + _FORWARD(6) + " SELECT origin, count(*) AS n, CAST(max(depth) AS INTEGER) AS farthest FROM reach GROUP BY origin"
ORACLES["reachable_tier0"] = GRAPH + _FORWARD(20) + " SELECT origin, count(*) AS n FROM reach WHERE id IN (SELECT id FROM top) GROUP BY origin"
ORACLES["reverse_reach"] = GRAPH + """, b(id, d) AS (SELECT id, 0 FROM top UNION SELECT e.src, b.d + 1 FROM b JOIN edges e ON e.dst = b.id WHERE b.d < 24)
SELECT id, CAST(min(d) AS INTEGER) AS depth FROM b GROUP BY id HAVING min(d) > 0"""
ORACLES["weighted_routes"] = GRAPH + DIM + """, x AS (SELECT src, dst, min(weight) AS weight FROM edges JOIN dim USING (edge_type) GROUP BY src, dst
), w0 AS (SELECT 'S-1-5-21-0-512' AS id, 0.0 AS cost), """ + ", ".join(
    f"w{k} AS (SELECT id, min(cost) AS cost FROM (SELECT id, cost FROM w{k - 1} UNION ALL SELECT x.dst, w.cost + x.weight FROM w{k - 1} w JOIN x ON x.src = w.id) u GROUP BY id)" for k in range(1, 41)
) + " SELECT id, CAST(round(cost, 4) AS DOUBLE) AS cost FROM w40"
ORACLES["attack_paths"] = PATHS + " SELECT source, target, CAST(length AS INTEGER) AS length, CAST(round(weight, 4) AS DOUBLE) AS weight, ns AS nodes, es AS edge_types FROM paths"
ORACLES["path_stats"] = PATHS + " SELECT count(*) AS n_paths, CAST(min(length) AS INTEGER) AS min_length, CAST(max(length) AS INTEGER) AS max_length, round(avg(length), 4) AS avg_length, count(DISTINCT source) AS n_sources FROM paths"
ORACLES["posture_score"] = PATHS + """, p AS (SELECT count(*) AS n, avg(length) AS a FROM paths), t AS (SELECT sum(CASE WHEN tier <> 0 THEN 1 ELSE 0 END) AS below, sum(CASE WHEN tier = 2 THEN 1 ELSE 0 END) AS t2,
sum(CASE WHEN tier = 2 AND object_id IN (SELECT source FROM paths) THEN 1 ELSE 0 END) AS ex FROM tiered),
raw AS (SELECT p.*, t.*, ex * 40.0 / t2 + least(n * 1.0 / below / 10, 1.0) * 25 + greatest(0.0, 1 - (a - 1) / 10) * 20 + least(log2(n + 1) / 15, 1.0) * 15 AS x FROM p, t),
s AS (SELECT *, CAST(least(round_even(x, 0), 100) AS INTEGER) AS score FROM raw)
SELECT score, CASE WHEN score <= 20 THEN 'A' WHEN score <= 40 THEN 'B' WHEN score <= 60 THEN 'C' WHEN score <= 80 THEN 'D' ELSE 'F' END AS grade, n AS n_paths, CAST(ex AS BIGINT) AS tier2_exposed, CAST(t2 AS BIGINT) AS tier2_total, round(n * 1.0 / below, 2) AS density FROM s"""
ORACLES["node_risk"] = PATHS + """, cnt AS (SELECT object_id, count(*) AS c FROM visited JOIN tiered USING (object_id) WHERE tier <> 0 GROUP BY object_id
), firsts AS (SELECT object_id FROM (SELECT object_id, row_number() OVER (ORDER BY c DESC, object_id) AS r FROM cnt) q WHERE r <= 100
), f(origin, id, d) AS (SELECT object_id, object_id, 0 FROM firsts UNION SELECT f.origin, e.dst, f.d + 1 FROM f JOIN edges e ON e.src = f.id WHERE f.d < 6
), reach AS (SELECT DISTINCT origin, id FROM f WHERE id <> origin
), ex AS (SELECT origin AS object_id, count(*) AS b, sum(CASE WHEN id IN (SELECT id FROM top) THEN 1 ELSE 0 END) AS t FROM reach GROUP BY origin
), j AS (SELECT cnt.object_id, c, CASE WHEN fi.object_id IS NULL THEN least(c, 50) ELSE coalesce(ex.b, 0) END AS blast, CASE WHEN fi.object_id IS NULL THEN 1 ELSE coalesce(ex.t, 0) END AS t0
  FROM cnt LEFT JOIN firsts fi ON fi.object_id = cnt.object_id LEFT JOIN ex ON ex.object_id = cnt.object_id)
SELECT object_id, c AS path_count, CAST(blast AS BIGINT) AS blast, CAST(t0 AS BIGINT) AS tier0_reach,
round(least(least(log2(c + 1) / 10, 1.0) * 40 + c * 1.0 / (SELECT count(*) FROM paths) * 30 + least(blast / 50.0, 1.0) * 15 + least(t0 / 3.0, 1.0) * 15, 100.0), 1) AS risk FROM j"""
ORACLES["choke_points"] = greedy(5) + " SELECT CAST(rank AS INTEGER) AS rank, src, dst, edge_type, eliminated, cumulative, round(cumulative * 100.0 / (SELECT count(*) FROM paths), 1) AS pct FROM fixes"
ORACLES["node_chokepoints"] = PATHS + """, inn AS (SELECT DISTINCT path_id, unnest(nl[2:length]) AS object_id FROM paths
), c AS (SELECT object_id, count(DISTINCT path_id) AS n FROM inn GROUP BY object_id ORDER BY n DESC, object_id LIMIT 20)
SELECT object_id, n, round(n * 100.0 / (SELECT count(*) FROM paths), 1) AS pct FROM c"""
ORACLES["path_costs"] = PATHS + """ SELECT path_id, CAST(sum(effort) AS BIGINT) AS effort, CAST(sum(noise) AS BIGINT) AS noise, sum(CASE WHEN effort > 0 THEN 1 ELSE 0 END)::BIGINT AS steps FROM steps JOIN dim USING (edge_type) GROUP BY path_id"""
ORACLES["cheapest_routes"] = PATHS + """, c AS (SELECT path_id, sum(effort) AS effort, sum(noise) AS noise FROM steps JOIN dim USING (edge_type) GROUP BY path_id
), r AS (SELECT p.target, p.path_id, row_number() OVER (PARTITION BY p.target ORDER BY effort, noise, length, p.path_id) AS a, row_number() OVER (PARTITION BY p.target ORDER BY noise, effort, length, p.path_id) AS b FROM paths p JOIN c ON c.path_id = p.path_id)
SELECT target, max(CASE WHEN a = 1 THEN path_id END) AS cheapest, max(CASE WHEN b = 1 THEN path_id END) AS stealthiest FROM r GROUP BY target"""
ORACLES["path_confidence"] = PATHS + f""", r AS (SELECT path_id, edge_type, conf, row_number() OVER (PARTITION BY path_id ORDER BY conf, step) AS k FROM steps JOIN dim USING (edge_type) WHERE edge_type NOT IN ({_list(registry.PLAIN_STRUCTURE)}))
SELECT path_id, CASE conf WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS level, edge_type AS weakest FROM r WHERE k = 1"""
_COVER = """, cov AS (SELECT path_id, step, edge_type, CASE edge_type WHEN 'AdminTo' THEN 1 WHEN 'ForceChangePassword' THEN 2 WHEN 'HasSession' THEN 0 ELSE 0 END AS status
  FROM steps WHERE edge_type NOT IN ('MemberOf', 'Contains', 'AZContains', 'AZRunsAs')
), pc AS (SELECT path_id, max(status) AS s, min(CASE WHEN status = 2 THEN step END) AS hit FROM cov GROUP BY path_id
), st AS (SELECT pc.path_id, CASE s WHEN 0 THEN 'blind' WHEN 1 THEN 'visible' ELSE 'detected' END AS status, CASE WHEN hit IS NOT NULL THEN (SELECT count(*) FROM cov WHERE cov.path_id = pc.path_id AND cov.step <= pc.hit) END AS first_detected FROM pc)"""
ORACLES["coverage_status"] = PATHS + _COVER + " SELECT path_id, status, first_detected FROM st"
ORACLES["coverage_by_edge"] = PATHS + _COVER + " SELECT edge_type, CAST(status AS INTEGER) AS status, count(*) AS n FROM cov GROUP BY edge_type, status"
ORACLES["enable_telemetry"] = PATHS + _COVER + """, gain(edge_type, telemetry, quality) AS (SELECT * FROM (VALUES ('HasSession', 'edr', 3), ('HasSession', 'sysmon', 2), ('AdminTo', 'edr', 2), ('GenericWrite', 'ds-changes', 2), ('GenericWrite', 'ds-access', 1), ('GenericWrite', 'mdi', 2), ('WriteDacl', 'ds-changes', 2), ('WriteDacl', 'ds-access', 1), ('WriteDacl', 'mdi', 2)) v(edge_type, telemetry, quality)
), b AS (SELECT c.path_id, telemetry, max(quality) AS q FROM cov c JOIN pc ON pc.path_id = c.path_id JOIN gain USING (edge_type) WHERE pc.s = 0 GROUP BY c.path_id, telemetry)
SELECT telemetry, count(*) AS paths, CAST(sum(q) AS BIGINT) AS quality FROM b GROUP BY telemetry"""
ORACLES["blind_spots"] = greedy(3) + _COVER + """, hit AS (SELECT DISTINCT s.path_id FROM steps s JOIN fixes f ON s.src = f.src AND s.dst = f.dst AND s.edge_type = f.edge_type)
SELECT source, target, es AS chain, count(*) AS n FROM paths JOIN st ON st.path_id = paths.path_id WHERE status = 'blind' AND paths.path_id NOT IN (SELECT path_id FROM hit) GROUP BY source, target, es ORDER BY n DESC, source, target, chain LIMIT 10"""
ORACLES["attack_chains"] = PATHS + """, x AS (SELECT path_id, 'acl_chain' AS chain FROM paths WHERE es LIKE '%WriteDacl%' AND (es LIKE '%GenericWrite%' OR es LIKE '%ForceChangePassword%')
UNION SELECT v.path_id, 'disabled_account' FROM visited v JOIN nodes n ON n.object_id = v.object_id WHERE NOT n.enabled) SELECT chain, count(*) AS n FROM x GROUP BY chain"""
ORACLES["both_rights"] = GRAPH + """, h(id, r) AS (SELECT src, 1 FROM edges WHERE edge_type = 'AdminTo' UNION SELECT src, 2 FROM edges WHERE edge_type IN ('GenericWrite', 'WriteDacl', 'ForceChangePassword')
), held(id, r) AS (SELECT id, r FROM h UNION SELECT m.src, held.r FROM held JOIN members m ON m.dst = held.id
), both_ AS (SELECT id FROM held GROUP BY id HAVING count(DISTINCT r) = 2) SELECT id FROM both_ WHERE id NOT IN (SELECT m.src FROM members m WHERE m.dst IN (SELECT id FROM both_))"""
ORACLES["deny_exposure"] = GRAPH + """, denies(deny_id, principal, edge_type, target) AS (SELECT 1, 'N1', 'AdminTo', s.object_id FROM nodes s WHERE s.node_type = 'Computer' AND CAST(substr(s.object_id, 2) AS INTEGER) % 3 = 0
), bound(actor) AS (SELECT 'N1' UNION SELECT m.src FROM bound JOIN members m ON m.dst = bound.actor
), guarded AS (SELECT DISTINCT d.target, d.edge_type FROM denies d JOIN hops h ON h.dst = d.target AND h.edge_type = d.edge_type
), u(sig) AS (SELECT 0 UNION SELECT 1 WHERE EXISTS (SELECT 1 FROM guarded)
), w(id, attacked, sig, d) AS (SELECT top.id, false, u.sig, 0 FROM top, u
  UNION SELECT h.src, w.attacked OR h.attack, CASE WHEN h.edge_type = 'MemberOf' THEN w.sig ELSE u.sig END, w.d + 1 FROM w JOIN hops h ON h.dst = w.id JOIN u ON (h.edge_type <> 'MemberOf' OR u.sig = w.sig)
  WHERE w.d < 24 AND (h.edge_type = 'MemberOf' OR (w.sig = CASE WHEN w.id IN (SELECT actor FROM bound) AND EXISTS (SELECT 1 FROM guarded) THEN 1 ELSE 0 END
     AND NOT (u.sig = 1 AND h.edge_type = 'AdminTo' AND h.dst IN (SELECT target FROM guarded)))))
SELECT id, CAST(min(d) AS INTEGER) AS hops FROM w WHERE attacked AND id NOT IN (SELECT id FROM top) AND sig = CASE WHEN id IN (SELECT actor FROM bound) AND EXISTS (SELECT 1 FROM guarded) THEN 1 ELSE 0 END GROUP BY id"""
ORACLES["gpo_scope"] = GRAPH + """, links(gpo, id, enforced) AS (SELECT 'G' || object_id, object_id, object_id IN ('R0', 'R2') FROM nodes WHERE node_type = 'OU'
), tree AS (SELECT src, dst FROM edges WHERE edge_type IN ('Contains', 'AdminTo')
), s(gpo, id, enforced) AS (SELECT gpo, id, enforced FROM links UNION SELECT s.gpo, t.dst, s.enforced FROM s JOIN tree t ON t.src = s.id WHERE s.enforced OR t.dst NOT IN ('N3', 'N6', 'N9', 'N12')) SELECT DISTINCT gpo, id FROM s"""
ORACLES["protected_hosts"] = GRAPH + """, a(host, id) AS (SELECT dst, src FROM edges WHERE edge_type = 'AdminTo' UNION SELECT a.host, m.src FROM a JOIN members m ON m.dst = a.id
), p AS (SELECT host, id FROM a WHERE id NOT IN (SELECT dst FROM members)) SELECT host AS id, count(DISTINCT id) AS admins FROM p GROUP BY host
HAVING bool_and(id IN (SELECT 'C' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey < 12))"""
ORACLES["session_merge"] = "SELECT 'U' || CAST(user_id AS VARCHAR) AS src, event_type AS dst, 'HasSession' AS edge_type, count(DISTINCT CAST(ts AS DATE)) AS seen FROM events GROUP BY user_id, event_type"
_AFTER = """, gone AS (SELECT * FROM edges WHERE NOT (edge_type = 'AdminTo' AND dst LIKE 'S%' AND TRY_CAST(substr(dst, 2) AS INTEGER) % 5 = 0)
), after_ AS (SELECT src, dst, edge_type FROM gone UNION SELECT 'R1', 'S-1-5-21-0-512', 'GenericAll' UNION SELECT 'R2', 'C1', 'GenericAll'
), hops_a AS (SELECT src, dst, edge_type NOT IN ('MemberOf', 'Contains', 'AZContains') AS attack FROM after_ WHERE src NOT IN (SELECT id FROM top)
), walk_a(id, attacked, d) AS (SELECT id, false, 0 FROM top UNION SELECT h.src, w.attacked OR h.attack, w.d + 1 FROM walk_a w JOIN hops_a h ON h.dst = w.id WHERE w.d < 24)"""
ORACLES["whatif_impact"] = STATES + _AFTER + """, b AS (SELECT id, depth AS hb FROM states WHERE attacked AND id NOT IN (SELECT id FROM top)), a AS (SELECT id, min(d) AS ha FROM walk_a WHERE attacked AND id NOT IN (SELECT id FROM top) GROUP BY id
), j AS (SELECT coalesce(a.id, b.id) AS id, hb, ha FROM b FULL JOIN a ON a.id = b.id)
SELECT id, CAST(hb AS INTEGER) AS hops_before, CAST(ha AS INTEGER) AS hops_after, CASE WHEN hb IS NULL THEN 'new_exposure' WHEN ha IS NULL THEN 'secured' WHEN ha < hb THEN 'shortened' ELSE 'lengthened' END AS effect FROM j WHERE hb IS NULL OR ha IS NULL OR hb <> ha"""
ORACLES["leaf_clusters"] = GRAPH + """, o AS (SELECT src, count(*) AS k, min(dst) AS dst, min(edge_type) AS edge_type FROM edges GROUP BY src HAVING count(*) = 1)
SELECT o.dst, o.edge_type, t.node_type, count(*) AS n FROM tiered t JOIN o ON o.src = t.object_id WHERE t.tier <> 0 AND t.node_type IN ('User', 'Computer') AND t.object_id NOT IN (SELECT dst FROM edges) GROUP BY o.dst, o.edge_type, t.node_type HAVING count(*) >= 6"""
ORACLES["degree_top"] = GRAPH + " SELECT id AS object_id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) x GROUP BY id ORDER BY degree DESC, object_id LIMIT 25"
ORACLES["membership_chain"] = GRAPH + """, c(origin, id, d) AS (SELECT object_id, object_id, 0 FROM nodes WHERE node_type = 'User' UNION SELECT c.origin, m.dst, c.d + 1 FROM c JOIN members m ON m.src = c.id WHERE c.d < 30)
SELECT origin AS principal_id, id AS group_id, CAST(min(d) AS INTEGER) AS depth FROM c WHERE id = 'S-1-5-21-0-512' AND d > 0 GROUP BY origin, id"""
ORACLES["breach_routes"] = GRAPH + """, back(id) AS (SELECT id FROM top UNION SELECT h.src FROM back JOIN hops h ON h.dst = back.id
), f(source, target, length, attacked, nl, el, before) AS (
  SELECT object_id, object_id, 0, false, [object_id], []::VARCHAR[], 0::BIGINT FROM nodes WHERE object_id IN ('C1', 'C2', 'C3', 'S1', 'S2', 'N1', 'N2', 'N5') AND object_id NOT IN (SELECT id FROM top)
  UNION ALL
  SELECT p.source, h.dst, p.length + 1, p.attacked OR h.attack, list_append(p.nl, h.dst), list_append(p.el, h.edge_type),
         CAST(p.before + sum(CASE WHEN (p.attacked OR h.attack) AND h.dst IN (SELECT id FROM top) THEN 1 ELSE 0 END) OVER () AS BIGINT)
  FROM f p JOIN hops h ON h.src = p.target WHERE p.length < 12 AND p.before < 4000 AND NOT list_contains(p.nl, h.dst) AND h.dst IN (SELECT id FROM back)
) SELECT source, target, length, array_to_string(nl, '>') AS nodes, array_to_string(el, '>') AS edge_types FROM f WHERE attacked AND target IN (SELECT id FROM top) ORDER BY length, source, target, nl, el LIMIT 4000"""
ORACLES["crown_jewels"] = GRAPH + """, jw AS (SELECT object_id AS id, CAST(substr(object_id, 2) AS INTEGER) % 7 AS value FROM nodes WHERE node_type = 'Computer' AND CAST(substr(object_id, 2) AS INTEGER) % 5 = 0
), r(origin, id, d) AS (SELECT id, id, 0 FROM jw UNION SELECT r.origin, e.src, r.d + 1 FROM r JOIN edges e ON e.dst = r.id WHERE r.d < 20
), q AS (SELECT r.origin, r.id, min(d) AS d FROM r JOIN nodes n ON n.object_id = r.id WHERE r.id <> r.origin AND n.node_type IN ('User', 'Computer') GROUP BY r.origin, r.id)
SELECT jw.id AS jewel, CAST(jw.value AS INTEGER) AS value, count(q.id) AS reachers, CAST(min(q.d) AS INTEGER) AS nearest FROM jw LEFT JOIN q ON q.origin = jw.id GROUP BY jw.id, jw.value"""
ORACLES["fix_safety"] = greedy(5) + """ SELECT f.src, f.dst, f.edge_type, CASE WHEN n.name LIKE 'SVC_%' AND n.enabled THEN 'caution' WHEN t.node_type = 'Computer' AND t.tier = 0 THEN 'caution' ELSE 'safe' END AS safety FROM fixes f JOIN nodes n ON n.object_id = f.src JOIN tiered t ON t.object_id = f.dst"""
_PROPS = """, props AS (SELECT t.*, c.c_mktsegment = 'BUILDING' AS hasspn, CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE c.c_custkey % 7 = 0 END AS dontreqpreauth, c.c_custkey % 13 = 0 AS passwordnotreqd, c.c_custkey % 3 = 0 AS pwdneverexpires,
  CAST(1700000000 - (c.c_custkey % 200) * 86400 AS DOUBLE) AS lastlogontimestamp FROM tiered t JOIN customer c ON t.object_id = 'C' || CAST(c.c_custkey AS VARCHAR)),
live AS (SELECT *, tier = 0 OR admin_count AS priv FROM props WHERE enabled),
found AS (SELECT 'kerberoast-privileged' AS finding, 'critical' AS severity, object_id, name FROM live WHERE hasspn AND priv
 UNION ALL SELECT 'kerberoast', 'medium', object_id, name FROM live WHERE hasspn AND NOT priv
 UNION ALL SELECT 'asrep-privileged', 'critical', object_id, name FROM live WHERE coalesce(dontreqpreauth, false) AND priv
 UNION ALL SELECT 'asrep', 'high', object_id, name FROM live WHERE coalesce(dontreqpreauth, false) AND NOT priv
 UNION ALL SELECT 'passwd-notreqd', 'high', object_id, name FROM live WHERE passwordnotreqd
 UNION ALL SELECT 'priv-pwd-never-expires', 'medium', object_id, name FROM live WHERE pwdneverexpires AND priv
 UNION ALL SELECT 'stale-privileged', 'medium', object_id, name FROM live WHERE priv AND floor((1700000000 - lastlogontimestamp) / 86400) > 90
 UNION ALL SELECT 'admincount-orphan', 'low', object_id, name FROM live WHERE admin_count AND tier <> 0
 UNION ALL SELECT 'svc-privileged', 'high', object_id, name FROM live WHERE tier = 0 AND name LIKE 'SVC_%'
 UNION ALL SELECT 'guest-enabled', 'medium', object_id, name FROM live WHERE object_id LIKE '%-501')"""
ORACLES["audit_findings"] = GRAPH + _PROPS + """, r AS (SELECT finding, severity, name, row_number() OVER (PARTITION BY finding ORDER BY name) AS k FROM (SELECT DISTINCT finding, severity, name FROM found) d)
SELECT finding, severity, (SELECT count(DISTINCT name) FROM found f WHERE f.finding = r.finding) AS total, string_agg(name, ',' ORDER BY name) AS names FROM r WHERE k <= 25 GROUP BY finding, severity"""
ORACLES["audit_rows"] = GRAPH + _PROPS + " SELECT finding, severity, object_id FROM found"
ORACLES["tier0_sessions"] = GRAPH + " SELECT DISTINCT t.object_id FROM tiered t JOIN edges e ON e.src = t.object_id AND e.edge_type = 'HasSession' JOIN tiered u ON u.object_id = e.dst WHERE t.tier <> 0 AND t.node_type = 'Computer' AND u.tier = 0 AND u.node_type = 'User'"
ORACLES["doctor"] = GRAPH + """ SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, CAST(0 AS BIGINT) AS unknown_kinds, (SELECT count(*) FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges) x WHERE id NOT IN (SELECT object_id FROM nodes)) AS unknown_ends,
round((SELECT count(DISTINCT src) FROM edges WHERE edge_type = 'HasSession') * 100.0 / (SELECT count(*) FROM supplier), 1) AS session_pct, round((SELECT count(DISTINCT dst) FROM edges WHERE edge_type = 'AdminTo') * 100.0 / (SELECT count(*) FROM supplier), 1) AS admin_pct"""
ORACLES["trend_delta"] = "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS value, count(*) - lag(count(*)) OVER (ORDER BY CAST(ts AS DATE)) AS change FROM events GROUP BY CAST(ts AS DATE)"
ORACLES["session_windows"] = """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a)
SELECT user_id AS user, count(*) AS n, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS seconds FROM b GROUP BY user_id, g"""
ORACLES["property_ingest"] = "SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2"
ORACLES["description_secrets"] = "SELECT c_custkey FROM customer WHERE c_custkey % 9 IN (0, 1)"
ORACLES["ou_breakdown"] = GRAPH + """, o AS (SELECT e.src AS ou, t.object_id, t.tier, row_number() OVER (PARTITION BY e.src ORDER BY t.tier, t.object_id) AS k FROM edges e JOIN tiered t ON t.object_id = e.dst WHERE e.edge_type = 'Contains')
SELECT ou, object_id, CAST(tier AS INTEGER) AS tier FROM o WHERE k <= 3"""
ORACLES["pseudonyms"] = "SELECT c_custkey, 'user-' || upper(substr(sha256('salt' || upper(c_name)), 1, 12)) AS alias FROM customer"
ORACLES["common_segment"] = "SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY n DESC, value LIMIT 1"
ORACLES["defend_guidance"] = PATHS + " SELECT edge_type, count(*) AS n FROM steps JOIN dim USING (edge_type) WHERE weight < 100 GROUP BY edge_type"
ORACLES["due_dates"] = "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN CAST(o_orderdate AS DATE) WHEN '2-HIGH' THEN CAST(CAST(o_orderdate AS DATE) + INTERVAL 7 DAY AS DATE) WHEN '3-MEDIUM' THEN CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE) WHEN '4-NOT SPECIFIED' THEN CAST(CAST(o_orderdate AS DATE) + INTERVAL 90 DAY AS DATE) END AS due FROM orders"
