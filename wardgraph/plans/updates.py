"""Queries over changes, names and units: kept exposure, combined effects, versions, weighted routes, selectors and breakdowns, each with its SQL.

Importing the module registers them beside the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import detections
from ..functions import registry
from ..operators import maintained, names, paths, policy, scoring, units, whatif
from ..storage import materialise, shuffled
from .facts import EDGE, _hosts, _key, _number
from .oracle import DIM, GRAPH, ORACLES, PATHS, STATES
from .queries import RULES, TELEMETRY, Graph, query

# exposure kept up to date


def _nation(key: F.Column) -> F.Column:
    return F.when(key == 0, "S-1-5-21-0-512").otherwise(F.concat(F.lit("N"), key.cast("string")))


def _updated(g: Graph, removed: DataFrame, added: DataFrame) -> DataFrame:
    d = whatif.Deltas(removed.select(*EDGE), added.select(*EDGE).join(shuffled(g.edges), EDGE, "left_anti"))
    after = maintained.update(g.kept, whatif.applied(g.edges, d), g.top, d.removed, d.added)
    return maintained.changes_of(g.kept, after, g.top, g.top)


def _compared(after: str) -> str:
    """SQL of the objects whose hops differ once the edges are those of the expression ``after`` named after_."""
    return STATES + after + """, hops_a AS (SELECT src, dst, edge_type NOT IN ('MemberOf', 'Contains', 'AZContains') AS attack FROM after_ WHERE src NOT IN (SELECT id FROM top)
), walk_a(id, attacked, d) AS (SELECT id, false, 0 FROM top UNION SELECT h.src, w.attacked OR h.attack, w.d + 1 FROM walk_a w JOIN hops_a h ON h.dst = w.id WHERE w.d < 30
), b AS (SELECT id, depth AS hb FROM states WHERE attacked AND id NOT IN (SELECT id FROM top)), a AS (SELECT id, min(d) AS ha FROM walk_a WHERE attacked AND id NOT IN (SELECT id FROM top) GROUP BY id
), j AS (SELECT coalesce(a.id, b.id) AS id, hb, ha FROM b FULL JOIN a ON a.id = b.id)
SELECT id, CAST(hb AS INTEGER) AS hops_before, CAST(ha AS INTEGER) AS hops_after FROM j WHERE hb IS DISTINCT FROM ha"""


@query
def exposure_after_adds(g: Graph) -> DataFrame:
    """Customers with the highest balances gain a right over a group, one of which is the administrators'."""
    k = F.col("c_custkey")
    rich = g.table("customer").where("c_acctbal > 8000").select(_key("C", "c_custkey").alias("src"), _nation((7 * k + 3) % 25).alias("dst"), F.lit("GenericAll").alias("edge_type"))
    return _updated(g, rich.limit(0), rich)


ORACLES["exposure_after_adds"] = _compared(""", after_ AS (SELECT src, dst, edge_type FROM edges UNION SELECT 'C' || CAST(c_custkey AS VARCHAR), CASE WHEN (7 * c_custkey + 3) % 25 = 0 THEN 'S-1-5-21-0-512' ELSE 'N' || CAST((7 * c_custkey + 3) % 25 AS VARCHAR) END, 'GenericAll' FROM customer WHERE c_acctbal > 8000)""")


@query
def exposure_after_removals(g: Graph) -> DataFrame:
    """Hosts of low balance lose their administrators and sessions, and customers their rights over one another where the first owes money."""
    poor = g.table("supplier").where("s_acctbal < 5000").select(_key("S", "s_suppkey").alias("host"))
    owing = g.table("customer").where("c_acctbal < 0").select(_key("C", "c_custkey").alias("src"))
    gone = g.edges.where("edge_type = 'AdminTo'").join(shuffled(poor), F.col("dst") == F.col("host"), "left_semi").union(g.edges.where("edge_type = 'HasSession'").join(shuffled(poor), F.col("src") == F.col("host"), "left_semi"))
    gone = gone.union(g.edges.where("edge_type in ('ForceChangePassword', 'GenericWrite', 'WriteDacl')").join(shuffled(owing), "src", "left_semi").select(*gone.columns))
    return _updated(g, materialise(gone, "gone"), gone.limit(0))


ORACLES["exposure_after_removals"] = _compared(""", poor AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS id FROM supplier WHERE s_acctbal < 5000), owing AS (SELECT 'C' || CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_acctbal < 0
), after_ AS (SELECT * FROM edges WHERE NOT (edge_type = 'AdminTo' AND dst IN (SELECT id FROM poor)) AND NOT (edge_type = 'HasSession' AND src IN (SELECT id FROM poor)) AND NOT (edge_type IN ('ForceChangePassword', 'GenericWrite', 'WriteDacl') AND src IN (SELECT id FROM owing)))""")


@query
def combined_exposures(g: Graph) -> DataFrame:
    """Parts are in a group by size. Four changes: the groups join a hub (1), the hub gains a right over a host's account (2), the account one over the administrators
    (3), and one of the groups gains it directly (4)."""
    parts = g.table("part").select(_key("P", "p_partkey").alias("src"), _key("M", "p_size").alias("dst"), F.lit("MemberOf").alias("edge_type"))
    edges = materialise(g.edges.select(*EDGE).union(parts), "with-parts")
    groups = parts.select(F.col("dst").alias("src")).distinct()
    added = groups.select(F.lit(1).alias("idx"), "src", F.lit("HUB").alias("dst"), F.lit("MemberOf").alias("edge_type"))
    lines = [(2, "HUB", "ACCOUNT", "GenericAll"), (3, "ACCOUNT", "S-1-5-21-0-512", "GenericAll"), (4, "M1", "S-1-5-21-0-512", "GenericAll")]
    added = added.union(g.spark.createDataFrame(lines, "idx int, src string, dst string, edge_type string"))
    # parts reach nothing before, so their states are none of the graph's
    found = whatif.combined_effects(edges, g.top, g.kept, added)
    return found.select("id", F.array_join(F.transform("needs", lambda x: F.array_join(x, "+")), "|").alias("needs"), "unknown")


ORACLES["combined_exposures"] = """WITH m AS (SELECT DISTINCT p_size AS k FROM part), x AS (SELECT 'M' || CAST(k AS VARCHAR) AS id, k FROM m UNION ALL SELECT 'P' || CAST(p_partkey AS VARCHAR), p_size FROM part)
SELECT id, CASE WHEN k = 1 THEN '4|1+2+3' ELSE '1+2+3' END AS needs, false AS unknown FROM x UNION ALL SELECT 'HUB', '2+3', false UNION ALL SELECT 'ACCOUNT', '3', false UNION ALL SELECT 'M1', '4', false WHERE NOT EXISTS (SELECT 1 FROM m WHERE k = 1)"""


@query
def edges_by_version(g: Graph) -> DataFrame:
    """Three versions of the edges: every fifth host's administrators go, units gain a right, and the first change is undone. By version and kind."""
    gone = g.edges.where("edge_type = 'AdminTo'").where(_number("dst") % 5 == 0).select(*EDGE)
    first = whatif.Deltas(materialise(gone, "gone"), gone.limit(0))
    more = g.of("OU").select(F.col("id").alias("src"), F.lit("S-1-5-21-0-512").alias("dst"), F.lit("GenericAll").alias("edge_type"))
    log = whatif.logged(1, first).union(whatif.logged(2, whatif.Deltas(more.limit(0), more))).union(whatif.logged(3, whatif.Deltas(first.added, first.removed)))
    out = None
    for version in range(4):
        rows = whatif.edges_at(g.edges, log, version).groupBy(F.lit(version).alias("version"), "edge_type").agg(F.count("*").alias("n"))
        out = rows if out is None else out.union(rows)
    return out


ORACLES["edges_by_version"] = GRAPH + """, e AS (SELECT *, edge_type = 'AdminTo' AND TRY_CAST(substr(dst, 2) AS INTEGER) % 5 = 0 AS gone FROM edges), v(version) AS (SELECT unnest(range(0, 4)))
SELECT CAST(version AS INTEGER) AS version, edge_type, count(*) AS n FROM v, e WHERE NOT (coalesce(gone, false) AND version IN (1, 2)) GROUP BY version, edge_type
UNION ALL SELECT CAST(version AS INTEGER), 'GenericAll', (SELECT count(*) FROM region) FROM v WHERE version >= 2"""


# routes


@query
def weighted_targets(g: Graph) -> DataFrame:
    """A route of least weight from each unit and group to each tier-0 object that it reaches."""
    found = paths.cheapest_routes_to_targets(g.of("Group", "OU"), g.top, g.edges)
    return found.select("origin", "target", F.round("cost", 4).alias("cost"), F.array_join("nodes", ">").alias("nodes"), F.array_join("edge_types", ">").alias("edge_types"))


def _relaxed(hops: str, starts: str, rounds: int) -> str:
    """SQL of the least costs (c: origin, id, cost) along ``hops`` (src, dst, w, edge_type) and of each object's last step (p: origin, id, prev, edge_type)."""
    sql = f", x AS MATERIALIZED ({hops}), c0 AS (SELECT id AS origin, id, CAST(0 AS BIGINT) AS cost FROM ({starts}) s)"
    for k in range(1, rounds + 1):
        sql += f", c{k} AS MATERIALIZED (SELECT origin, id, min(cost) AS cost FROM (SELECT * FROM c{k - 1} UNION ALL SELECT c.origin, x.dst, c.cost + x.w FROM c{k - 1} c JOIN x ON x.src = c.id) u GROUP BY origin, id)"
    return sql + f""", c AS MATERIALIZED (SELECT * FROM c{rounds}), p AS MATERIALIZED (SELECT origin, id, prev, edge_type FROM (SELECT c.origin, c.id, x.src AS prev, x.edge_type, row_number() OVER (PARTITION BY c.origin, c.id ORDER BY x.src, x.edge_type) AS k
  FROM c JOIN x ON x.dst = c.id JOIN c b ON b.origin = c.origin AND b.id = x.src AND b.cost + x.w = c.cost WHERE c.id <> c.origin) q WHERE k = 1)"""


ORACLES["weighted_targets"] = GRAPH + DIM + _relaxed(
    "SELECT src, dst, w, edge_type FROM (SELECT src, dst, CAST(round(weight * 1000000000) AS BIGINT) AS w, edge_type, row_number() OVER (PARTITION BY src, dst ORDER BY weight, edge_type) AS k FROM edges JOIN dim USING (edge_type)) q WHERE k = 1",
    "SELECT object_id AS id FROM nodes WHERE node_type IN ('Group', 'OU')",
    30,
) + """, r(origin, target, cur, ns, es) AS (SELECT origin, id, id, id, '' FROM c WHERE id IN (SELECT id FROM top)
  UNION ALL SELECT r.origin, r.target, p.prev, p.prev || '>' || r.ns, CASE WHEN r.es = '' THEN p.edge_type ELSE p.edge_type || '>' || r.es END FROM r JOIN p ON p.origin = r.origin AND p.id = r.cur WHERE r.cur <> r.origin)
SELECT r.origin, target, CAST(round(cost / 1000000000.0, 4) AS DOUBLE) AS cost, ns AS nodes, es AS edge_types FROM r JOIN c ON c.origin = r.origin AND c.id = r.target WHERE cur = r.origin"""


def _jewels(g: Graph) -> DataFrame:
    key = _number("id")
    return g.of("Computer").where(key % 5 == 0).withColumn("value", key % 7)


@query
def jewel_routes(g: Graph) -> DataFrame:
    """The cheapest route onto each declared host."""
    found = units.jewel_routes(_jewels(g), g.tiered, g.edges)
    return found.withColumns({"nodes": F.array_join("nodes", ">"), "edge_types": F.array_join("edge_types", ">")})


ORACLES["jewel_routes"] = GRAPH + DIM + """, jw AS (SELECT object_id AS id, CAST(substr(object_id, 2) AS INTEGER) % 7 AS value FROM nodes WHERE node_type = 'Computer' AND CAST(substr(object_id, 2) AS INTEGER) % 5 = 0)""" + _relaxed(
    "SELECT src, dst, w, edge_type FROM (SELECT dst AS src, src AS dst, w, edge_type, row_number() OVER (PARTITION BY src, dst ORDER BY w, edge_type) AS k FROM (SELECT *, CAST(effort AS BIGINT) * 1099511627776 + noise * 1048576 + 1 AS w FROM edges JOIN dim USING (edge_type)) e) q WHERE k = 1",
    "SELECT id FROM jw",
    24,
) + """, b AS (SELECT origin, id, cost FROM (SELECT c.*, row_number() OVER (PARTITION BY origin ORDER BY cost, id) AS k FROM c JOIN tiered t ON t.object_id = c.id WHERE c.id <> origin AND t.node_type IN ('User', 'Computer') AND t.tier <> 0) q WHERE k = 1
), r(origin, source, cur, ns, es) AS (SELECT origin, id, id, id, '' FROM b
  UNION ALL SELECT r.origin, r.source, p.prev, r.ns || '>' || p.prev, CASE WHEN r.es = '' THEN p.edge_type ELSE r.es || '>' || p.edge_type END FROM r JOIN p ON p.origin = r.origin AND p.id = r.cur WHERE r.cur <> r.origin)
SELECT jw.id AS jewel, CAST(value AS INTEGER) AS value, source, CAST(cost // 1099511627776 AS INTEGER) AS effort, CAST(cost // 1048576 % 1048576 AS INTEGER) AS noise, CAST(cost % 1048576 AS INTEGER) AS steps, ns AS nodes, es AS edge_types
FROM jw LEFT JOIN b ON b.origin = jw.id LEFT JOIN r ON r.origin = jw.id AND r.cur = jw.id"""


# names


@query
def name_suggestions(g: Graph) -> DataFrame:
    """What nations', units' and some hosts' names, each with one letter wrong or left out, are taken for."""
    wrong = g.table("nation").select(F.concat(F.lit("nashion_"), "n_nationkey").alias("query"))
    wrong = wrong.union(g.table("region").select(F.concat(F.substring("r_name", 1, 2), F.substring("r_name", 4, 40)))).union(g.table("supplier").where("s_acctbal > 9000").select(F.replace("s_name", F.lit("pp"), F.lit("b"))))
    return names.suggestions(wrong, g.nodes)


@query
def selected_changes(g: Graph) -> DataFrame:
    """Selectors in a change file: direct members, members without nested groups, controllers, the domain."""
    nodes, edges = _hosts(g)
    more = g.spark.createDataFrame([("D", "CORP.LOCAL", "Domain", True, False), ("C-516", "DOMAIN CONTROLLERS", "Group", True, False)], nodes.schema)
    nodes, edges = nodes.unionByName(more), edges.union(edges.where("dst = 'D-516'").withColumn("dst", F.lit("C-516")))
    lines = ["grant @members(NATION_10) WriteDacl <domain>", "local-admin @members*(NATION_13) @dcs", "revoke @members(NATION_10) WriteDacl nation_2", 'grant "CN=NATION_2,OU=Groups,DC=x" WriteDacl <domain>', "grant N2 WriteDacl D", "delete @members*(NATION_13)"]
    changes = g.spark.createDataFrame(whatif.parse_changes("\n".join(lines)), whatif.CHANGES)
    return names.expand_changes(changes, nodes, edges).select("idx", "op", "src", "edge_type", "dst")


ORACLES["selected_changes"] = GRAPH + """, direct AS (SELECT src AS id FROM members WHERE dst = 'N10'), deep(id) AS (SELECT src FROM members WHERE dst = 'N13' UNION SELECT m.src FROM deep JOIN members m ON m.dst = deep.id
), users AS (SELECT id FROM deep WHERE id NOT IN (SELECT object_id FROM nodes WHERE node_type = 'Group')), dcs AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS id FROM supplier WHERE s_suppkey % 10 = 0)
SELECT 0 AS idx, 'add' AS op, id AS src, 'WriteDacl' AS edge_type, 'D' AS dst FROM direct UNION ALL SELECT 1, 'add', users.id, 'AdminTo', dcs.id FROM users, dcs UNION ALL SELECT 2, 'remove', id, 'WriteDacl', 'N2' FROM direct WHERE id <> 'N2'
UNION ALL SELECT 3, 'add', 'N2', 'WriteDacl', 'D' WHERE 'N2' NOT IN (SELECT id FROM direct) UNION ALL SELECT 5, 'delete', id, '*', NULL FROM users"""


# units


def _named(g: Graph) -> DataFrame:
    """object_id, dn: customers below their segment, nation and region."""
    places = g.table("customer").join(g.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(g.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return places.select(_key("C", "c_custkey").alias("object_id"), F.format_string("CN=%s,OU=%s,OU=%s,OU=%s,DC=corp,DC=local", "c_name", "c_mktsegment", "n_name", "r_name").alias("dn"), F.col("c_acctbal").cast("long").alias("measure"))


_PLACES = "SELECT 'C' || CAST(c_custkey AS VARCHAR) AS object_id, c_mktsegment AS s, n_name AS n, r_name AS r, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query
def unit_values(g: Graph) -> DataFrame:
    """Values declared for units, one inside another, and for objects by name: the highest counts."""
    regions = g.table("region").select((F.col("r_regionkey") % 3).cast("int").alias("value"), F.lit(None).cast("string").alias("match"), F.concat(F.lit("ou="), "r_name", F.lit(",DC=corp,DC=local")).alias("ou"))
    inner = g.table("nation").join(g.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey >= 20").select(F.lit(2), F.lit(None), F.format_string(",OU=BUILDING,OU=%s,OU=%s,DC=corp,DC=local", "n_name", "r_name"))
    people = g.table("customer").where("c_acctbal > 9900").select(F.lit(3), _key("c", "c_custkey"), F.lit(None))
    return units.declared_values(regions.union(inner).union(people), g.nodes, _named(g))


ORACLES["unit_values"] = f"""WITH p AS ({_PLACES}), v AS (SELECT object_id AS id, r_regionkey % 3 AS value FROM p JOIN region ON r_name = r UNION ALL SELECT object_id, 2 FROM p JOIN nation ON n_name = n WHERE n_nationkey >= 20 AND s = 'BUILDING' UNION ALL SELECT object_id, 3 FROM p WHERE c_acctbal > 9900)
SELECT id, CAST(max(value) AS INTEGER) AS value FROM v GROUP BY id"""


@query
def unit_totals(g: Graph) -> DataFrame:
    """Balances of each unit with all units below it."""
    rows = _named(g)
    return units.totals(rows.select("object_id", "dn"), rows.select("object_id", "measure"))


ORACLES["unit_totals"] = f"""WITH p AS (SELECT *, CAST(trunc(c_acctbal) AS BIGINT) AS m FROM ({_PLACES}) q), u AS (SELECT 'OU=' || r || ',DC=CORP,DC=LOCAL' AS unit, m FROM p UNION ALL SELECT 'OU=' || n || ',OU=' || r || ',DC=CORP,DC=LOCAL', m FROM p
UNION ALL SELECT 'OU=' || s || ',OU=' || n || ',OU=' || r || ',DC=CORP,DC=LOCAL', m FROM p) SELECT unit, count(*) AS objects, CAST(sum(m) AS BIGINT) AS total, max(m) AS most FROM u GROUP BY unit"""


@query
def unit_breakdown(g: Graph) -> DataFrame:
    """The riskiest customers of the units with most customers that reach tier 0."""
    risk = scoring.node_risk(g.paths, g.tiered, g.edges, exact=100)
    return units.breakdown(_named(g).select("object_id", "dn"), risk.select("object_id", "tier0_reach", "risk"))


ORACLES["unit_breakdown"] = f"""WITH risk AS ({ORACLES["node_risk"]}), rows_ AS (SELECT r || '/' || n || '/' || s AS unit, p.object_id, k.tier0_reach, k.risk FROM ({_PLACES}) p JOIN risk k ON k.object_id = p.object_id
), c AS (SELECT unit, count(*) AS objects, count(*) FILTER (tier0_reach > 0) AS reaching FROM rows_ GROUP BY unit), f AS (SELECT *, row_number() OVER (ORDER BY reaching DESC, objects DESC, unit) AS place FROM c
), k AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY tier0_reach DESC, risk DESC, object_id) AS rank FROM rows_)
SELECT CAST(place AS INTEGER) AS place, f.unit, objects, reaching, CAST(rank AS INTEGER) AS rank, object_id, tier0_reach, risk FROM f JOIN k ON k.unit = f.unit WHERE place <= 20 AND rank <= 8"""


# policy and detection


@query
def softened_findings(g: Graph) -> DataFrame:
    """A finding for each customer, of two changes of nations, under controls and waivers of regions, one of which has run out."""
    k, n, r = F.col("c_custkey"), F.col("n_nationkey").cast("int"), F.col("r_regionkey").cast("int")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("NEW_EXPOSURE", "COMBINED_EFFECT", "PATH_SHORTENED", "RISK_REDUCTION")]), (k % 4 + 1).cast("int"))
    findings = g.table("customer").select(k.alias("finding_id"), kind.alias("kind"), (k % 5 + 1).cast("int").alias("severity"), F.array((k % 25).cast("int"), ((7 * k + 3) % 25).cast("int")).alias("changes"), (k % 11 == 0).alias("superseded"))
    places = g.table("nation").join(g.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    changes = places.select(n.alias("idx"), F.col("n_name").alias("source"), F.when(n % 2 == 0, "MemberOf").otherwise("AdminTo").alias("edge"), F.col("r_name").alias("target"), F.when(n % 3 != 0, n * 10).alias("ttl_minutes"))
    regions = g.table("region")
    expires = F.when(r == 1, F.to_date(F.lit("2020-01-01")))
    controls = regions.where("r_regionkey < 4").select(F.concat(F.lit("c"), r).alias("rule_id"), r.alias("place"), F.lit("nation*").alias("source"), F.when(r == 2, "Admin*").otherwise("*").alias("edge"), F.lower("r_name").alias("target"), F.array(F.when(r == 3, "COMBINED_EFFECT").otherwise("*")).alias("kinds"), expires.alias("expires"), (r % 2 + 1).alias("steps"))
    waivers = regions.where("r_regionkey < 3").select(F.concat(F.lit("w"), r).alias("rule_id"), r.alias("place"), F.lit("*").alias("source"), F.lit("member??").alias("edge"), F.col("r_name").alias("target"), F.array(F.lit("*")).alias("kinds"), expires.alias("expires"))
    today = F.to_date(F.lit("2024-06-01"))
    done = policy.decided(policy.waived(policy.softened(findings, changes, controls, today, 120), changes, waivers, today))
    return done.select("finding_id", "severity", "temporary", "control", "control_status", "waiver", "waiver_status", "decision")


ORACLES["softened_findings"] = """WITH f AS (SELECT c_custkey AS id, ['NEW_EXPOSURE', 'COMBINED_EFFECT', 'PATH_SHORTENED', 'RISK_REDUCTION'][c_custkey % 4 + 1] AS kind, c_custkey % 5 + 1 AS sev, [c_custkey % 25, (7 * c_custkey + 3) % 25] AS ch, c_custkey % 11 = 0 AS sup FROM customer
), c AS (SELECT n_nationkey AS idx, n_nationkey % 2 = 1 AS adm, n_regionkey AS r, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey * 10 END AS ttl FROM nation
), e AS (SELECT id, kind, at_, ch[at_] AS idx FROM f, (SELECT unnest([1, 2]) AS at_) a
), m AS (SELECT e.id, e.kind, at_, coalesce(ttl, 0) AS ttl,
  CASE WHEN r = 0 THEN 'c0' WHEN r = 1 THEN 'c1' WHEN r = 2 AND adm THEN 'c2' WHEN r = 3 AND kind = 'COMBINED_EFFECT' THEN 'c3' END AS ctl, r = 1 AS old, r % 2 + 1 AS steps, CASE WHEN r < 3 AND NOT adm THEN 'w' || CAST(r AS VARCHAR) END AS wv FROM e JOIN c USING (idx)
), g AS (SELECT id, min(ttl) > 0 AS jit, max(ttl) AS longest, bool_and(ctl IS NOT NULL AND NOT old) AS on_, min(steps) AS steps, min(ctl) FILTER (at_ = 1) AS c1, min_by(ctl, at_) FILTER (old AND ctl IS NOT NULL AND at_ = 1) AS o1, min(ctl) FILTER (at_ = 2 AND old) AS o2, bool_and(ctl IS NOT NULL AND NOT old) FILTER (at_ = 1) AS live1,
  bool_and(wv IS NOT NULL AND wv <> 'w1') AS won, min(wv) FILTER (at_ = 1) AS w1, bool_and(wv IS NOT NULL AND wv <> 'w1') FILTER (at_ = 1) AS wlive1, min(wv) FILTER (at_ = 2) AS w2 FROM m GROUP BY id
), s AS (SELECT f.id, kind, sup, sev, NOT sup AND kind <> 'RISK_REDUCTION' AS ok, CASE WHEN kind = 'COMBINED_EFFECT' THEN 3 ELSE 2 END AS fl, g.* EXCLUDE (id) FROM f JOIN g USING (id)
), t AS (SELECT *, CASE WHEN ok AND jit AND longest <= 120 THEN least(sev, greatest(sev - 1, fl)) ELSE sev END AS s1 FROM s
), u AS (SELECT *, CASE WHEN ok AND on_ THEN least(s1, greatest(s1 - steps, fl)) ELSE s1 END AS s2, CASE WHEN NOT ok THEN NULL WHEN on_ THEN c1 WHEN NOT live1 THEN o1 ELSE o2 END AS ctl, CASE WHEN won THEN w1 WHEN NOT wlive1 THEN w1 ELSE w2 END AS wv FROM t
), v AS (SELECT *, CASE WHEN ctl IS NOT NULL THEN CASE WHEN on_ THEN 'applied' ELSE 'expired' END END AS cs, CASE WHEN wv IS NOT NULL THEN CASE WHEN won THEN 'applied' ELSE 'expired' END END AS ws, kind IN ('NEW_EXPOSURE', 'COMBINED_EFFECT') AND s2 >= 4 AS gated FROM u)
SELECT id AS finding_id, CAST(s2 AS INTEGER) AS severity, CASE WHEN ok AND jit THEN CAST(longest AS INTEGER) END AS temporary, ctl AS control, cs AS control_status, wv AS waiver, ws AS waiver_status,
CASE WHEN sup OR kind = 'RISK_REDUCTION' OR (NOT gated AND s2 < 3) THEN 'ok' WHEN coalesce(ws = 'applied', false) THEN 'waived' WHEN gated THEN 'block' ELSE 'review' END AS decision FROM v"""


@query
def telemetry_plan(g: Graph) -> DataFrame:
    """What to switch on, in order, where nothing is on yet."""
    return policy.telemetry_plan(g.paths, [])


_ROUNDS = 12
_OPTIONS = ", ".join(f"('{e}', {needs.split('+')}, {registry.CONFIDENCES.index(q) + 1})" for e, needs, q in registry.OBSERVABLE if e in ("AdminTo", "HasSession", "ForceChangePassword", "GenericWrite", "WriteDacl"))
ORACLES["telemetry_plan"] = PATHS + f", opt(edge_type, needs, q) AS (SELECT * FROM (VALUES {_OPTIONS}) v), po AS (SELECT DISTINCT path_id, needs, q FROM steps JOIN opt USING (edge_type)), on0 AS (SELECT []::VARCHAR[] AS o)" + "".join(
    f""", blind{k} AS (SELECT path_id FROM po, on{k - 1} GROUP BY path_id HAVING bool_and(len(list_filter(needs, lambda x: NOT list_contains(o, x))) > 0)
), miss{k} AS (SELECT path_id, q, list_filter(needs, lambda x: NOT list_contains(o, x)) AS z FROM po JOIN blind{k} USING (path_id), on{k - 1}
), best{k} AS MATERIALIZED (SELECT m, count(*) AS n FROM (SELECT path_id, z[1] AS m, max(q) AS q FROM miss{k} WHERE len(z) = 1 GROUP BY path_id, z[1]) y GROUP BY m ORDER BY n DESC, sum(q) DESC, m DESC LIMIT 1
), on{k} AS MATERIALIZED (SELECT list_append(o, m) AS o FROM on{k - 1}, best{k})"""
    for k in range(1, _ROUNDS + 1)
) + " " + " UNION ALL ".join(f"SELECT {k} AS rank, m AS telemetry, n AS paths FROM best{k}" for k in range(1, _ROUNDS + 1))


@query
def rules_to_write(g: Graph) -> DataFrame:
    return policy.rules_to_write(paths.coverage(g.paths, TELEMETRY, RULES))


ORACLES["rules_to_write"] = ORACLES["coverage_by_edge"].rpartition(" SELECT edge_type")[0] + " SELECT edge_type, count(*) AS steps FROM cov WHERE status = 1 GROUP BY edge_type"


@query
def detection_rules(g: Graph) -> DataFrame:
    """Rules on what the paths pass, and on new members of tier-0 groups and of groups that reach tier 0."""
    found = detections.rules(g.paths, g.nodes, g.top, g.kept.exposed(g.top))
    return found.select("rule", "part", "rule_id", "severity", F.size("objects").alias("n"), F.get("objects", 0).alias("first"), "covered")


_KINDS = ", ".join(f"('{rule}', '{kind}', '{only}', '[{events.replace(' ', ',')}]', '{field}', '{compared}', '{severity}')" for rule, kinds, only, events, field, compared, severity in detections.KINDS for kind in kinds.split())
ORACLES["detection_rules"] = PATHS + f""", wlk(id, attacked, d) AS (SELECT id, false, 0 FROM top UNION SELECT hops.src, w.attacked OR hops.attack, w.d + 1 FROM wlk w JOIN hops ON hops.dst = w.id WHERE w.d < 24
), kinds(rule, edge_type, only_, events, field, compared, severity) AS (SELECT * FROM (VALUES {_KINDS}) v
), shown AS (SELECT object_id AS id, node_type, CASE WHEN node_type = 'Computer' THEN split_part(split_part(name, '@', 1), '.', 1) || '$' ELSE split_part(name, '@', 1) END AS object FROM nodes
), pts AS (SELECT edge_type, dst AS id, count(DISTINCT path_id) AS covered FROM steps GROUP BY edge_type, dst
), rws AS (SELECT rule, severity, events, field, compared, object, covered FROM pts JOIN shown USING (id) JOIN kinds USING (edge_type) WHERE only_ = '' OR only_ = node_type
  UNION ALL SELECT 'T0_GROUP_MEMBERSHIP', 'critical', '[4728,4732,4756]', 'TargetUserName', 'eq', object, 0 FROM shown WHERE node_type = 'Group' AND id IN (SELECT id FROM top)
  UNION ALL SELECT 'EXPOSED_GROUP_MEMBERSHIP', 'high', '[4728,4732,4756]', 'TargetUserName', 'eq', object, 0 FROM shown WHERE node_type = 'Group' AND id NOT IN (SELECT id FROM top) AND id IN (SELECT id FROM wlk WHERE attacked)
), own AS (SELECT rule, severity, events, field, compared, lower(object) AS k, min(object) AS object, sum(covered) AS covered FROM rws GROUP BY rule, severity, events, field, compared, lower(object)
), dealt AS (SELECT *, (row_number() OVER (PARTITION BY rule ORDER BY k) - 1) // 200 + 1 AS part FROM own
), prt AS (SELECT rule, part, severity, events, field, compared, count(*) AS n, min_by(object, k) AS first, sum(covered) AS covered, string_agg('"' || object || '"', ',' ORDER BY k) AS os FROM dealt GROUP BY rule, part, severity, events, field, compared
), named AS (SELECT *, sha1(unhex('{detections.NAMESPACE.hex}') || encode('["' || rule || '",' || CAST(part AS VARCHAR) || ',' || events || ',"' || field || '","' || compared || '",[' || os || ']]')) AS h FROM prt)
SELECT rule, CAST(part AS INTEGER) AS part, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(strpos('0123456789abcdef', substr(h, 17, 1)) - 1 AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS rule_id,
severity, CAST(n AS INTEGER) AS n, first, CAST(covered AS BIGINT) AS covered FROM named"""
