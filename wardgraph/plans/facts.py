"""Queries over facts that the order tables don't hold as they are: rights, properties, names and changes made from keys, each with its SQL.

Importing the module registers them beside the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import audit, derive, paths, scoring, sidecars, tiering, whatif
from ..reports import watch_lists
from .oracle import GRAPH, ORACLES, PATHS
from .queries import CONTEXT_CLOCK, Graph, _context, plain, query

EDGE = ["src", "dst", "edge_type"]


def _key(prefix: str, column: str) -> F.Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _number(column: str) -> F.Column:
    return F.substring(column, 2, 20).try_cast("int")


# derivations


@query
def dcsync_holders(g: Graph) -> DataFrame:
    """Every third nation holds one replication right on each region, every fourth the other, and every seventh customer the second too."""
    nation, customer, regions = g.table("nation"), g.table("customer"), g.table("region").select(_key("R", "r_regionkey").alias("dst"))
    held = lambda rows, right: rows.join(regions).select("src", "dst", F.lit(right).alias("edge_type"))
    own = lambda k: nation.where(f"n_nationkey % {k} = 1").select(_key("N", "n_nationkey").alias("src"))
    rights = held(own(3), "GetChanges").union(held(own(4), "GetChangesAll")).union(held(customer.where("c_custkey % 7 = 0").select(_key("C", "c_custkey").alias("src")), "GetChangesAll"))
    return derive.dcsync(g.edges.select(*EDGE).union(rights), g.top)


ORACLES["dcsync_holders"] = GRAPH + """, rights AS (SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS id, 1 AS r FROM nation WHERE n_nationkey % 3 = 1 UNION ALL SELECT 'N' || CAST(n_nationkey AS VARCHAR), 2 FROM nation WHERE n_nationkey % 4 = 1
  UNION ALL SELECT 'C' || CAST(c_custkey AS VARCHAR), 2 FROM customer WHERE c_custkey % 7 = 0
), held(id, r) AS (SELECT id, r FROM rights UNION SELECT m.src, held.r FROM held JOIN members m ON m.dst = held.id
), two AS (SELECT id FROM held GROUP BY id HAVING count(DISTINCT r) = 2
), highest AS (SELECT id FROM two WHERE id NOT IN (SELECT src FROM members WHERE dst IN (SELECT id FROM two)) AND id NOT IN (SELECT id FROM top))
SELECT h.id AS src, 'R' || CAST(r_regionkey AS VARCHAR) AS dst, 'DCSync' AS edge_type FROM highest h, region"""


@plain
def implicit_memberships(table) -> DataFrame:
    ids = table("supplier").select(F.concat(F.lit("S-1-5-21-"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 3 == 0, "-513").when(F.col("s_suppkey") % 3 == 1, "-515").otherwise("-512")).alias("object_id"))
    return derive.implicit_memberships(ids)


ORACLES["implicit_memberships"] = """WITH d AS (SELECT 'S-1-5-21-' || CAST(s_suppkey AS VARCHAR) AS d, CASE s_suppkey % 3 WHEN 0 THEN '-513' ELSE '-515' END AS e FROM supplier WHERE s_suppkey % 3 < 2)
SELECT d || e AS src, d || '-S-1-1-0' AS dst, 'MemberOf' AS edge_type FROM d UNION SELECT d || e, d || '-S-1-5-11', 'MemberOf' FROM d UNION SELECT d || '-S-1-5-11', d || '-S-1-1-0', 'MemberOf' FROM d"""


@query
def uncollected_names(g: Graph) -> DataFrame:
    """Customers are in groups that weren't collected: some of well-known ids, with and without a domain, some of unknown ones."""
    k = F.col("c_custkey")
    group = F.when(k % 4 == 0, F.concat(F.lit("CORP"), (k % 50).cast("string"), F.lit("-S-1-5-32-544"))).when(k % 4 == 1, F.concat(F.lit("S-1-5-21-"), (k % 60).cast("string"), F.lit("-519"))).when(k % 4 == 2, F.lit("S-1-1-0"))
    extra = g.table("customer").select(_key("C", "c_custkey").alias("src"), F.coalesce(group, F.concat(F.lit("S-1-5-21-7-"), k.cast("string"))).alias("dst"), F.lit("MemberOf").alias("edge_type"))
    return derive.name_uncollected(g.nodes, g.edges.select(*EDGE).union(extra)).select("object_id", "name", "node_type")


ORACLES["uncollected_names"] = """SELECT DISTINCT 'CORP' || CAST(c_custkey % 50 AS VARCHAR) || '-S-1-5-32-544' AS object_id, 'ADMINISTRATORS@CORP' || CAST(c_custkey % 50 AS VARCHAR) AS name, 'Group' AS node_type FROM customer WHERE c_custkey % 4 = 0
UNION SELECT DISTINCT 'S-1-5-21-' || CAST(c_custkey % 60 AS VARCHAR) || '-519', 'ENTERPRISE ADMINS', 'Group' FROM customer WHERE c_custkey % 4 = 1 UNION SELECT 'S-1-1-0', 'EVERYONE', 'Group'
UNION SELECT DISTINCT 'S-1-5-21-7-' || CAST(c_custkey AS VARCHAR), CASE c_custkey WHEN 515 THEN 'DOMAIN COMPUTERS' WHEN 519 THEN 'ENTERPRISE ADMINS' WHEN 527 THEN 'ENTERPRISE KEY ADMINS' END, 'Group' FROM customer WHERE c_custkey IN (515, 519, 527)"""


def _hosts(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with a group of domain controllers, which every tenth host is in."""
    nodes = g.nodes.unionByName(g.nodes.limit(1).select(F.lit("D-516").alias("object_id"), F.lit("hosts").alias("name"), F.lit("Group").alias("node_type"), F.lit(True).alias("enabled"), F.lit(False).alias("admin_count")))
    inside = g.table("supplier").where("s_suppkey % 10 = 0").select(_key("S", "s_suppkey").alias("src"), F.lit("D-516").alias("dst"), F.lit("MemberOf").alias("edge_type"))
    return nodes, g.edges.select(*EDGE).union(inside)


@query
def domain_controllers(g: Graph) -> DataFrame:
    return derive.domain_controllers(*_hosts(g))


ORACLES["domain_controllers"] = "SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS id FROM supplier WHERE s_suppkey % 10 = 0"


@query
def unconstrained_delegation(g: Graph) -> DataFrame:
    """Every seventh host is trusted for delegation, to every controller but itself."""
    nodes, edges = _hosts(g)
    trusted = g.table("supplier").where("s_suppkey % 7 = 0").select(_key("S", "s_suppkey").alias("id"))
    return derive.unconstrained_delegation(trusted, derive.domain_controllers(nodes, edges), edges)


ORACLES["unconstrained_delegation"] = "SELECT 'S' || CAST(a.s_suppkey AS VARCHAR) AS src, 'S' || CAST(b.s_suppkey AS VARCHAR) AS dst, 'AllowedToDelegate' AS edge_type FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey WHERE a.s_suppkey % 7 = 0 AND b.s_suppkey % 10 = 0"


@query
def gpo_user_rights(g: Graph) -> DataFrame:
    """Each unit's policy gives a customer of the unit's number a right on the hosts that it applies to."""
    links = g.of("OU").select(F.concat(F.lit("G"), "id").alias("gpo"), F.col("id").alias("container"), F.lit(False).alias("enforced"))
    scope = derive.gpo_scope(links, g.edges.where("edge_type in ('Contains', 'AdminTo')"), g.of("Group").where("id = 'N3'"))
    grants = g.of("OU").select(F.concat(F.lit("G"), "id").alias("gpo"), F.concat(F.lit("C"), F.substring("id", 2, 9)).alias("principal"))
    return derive.gpo_rights(grants, scope, g.nodes)


ORACLES["gpo_user_rights"] = GRAPH + """, t AS (SELECT src, dst FROM edges WHERE edge_type IN ('Contains', 'AdminTo')), s(gpo, id) AS (SELECT object_id, object_id FROM nodes WHERE node_type = 'OU' UNION SELECT s.gpo, t.dst FROM s JOIN t ON t.src = s.id WHERE t.dst <> 'N3')
SELECT DISTINCT 'C' || substr(gpo, 2) AS src, id AS dst, 'GPOUserRight' AS edge_type FROM s JOIN nodes n ON n.object_id = s.id WHERE n.node_type = 'Computer'"""


@query
def protected_delegation(g: Graph) -> DataFrame:
    """Delegation that is left once hosts with protected administrators alone are taken out; every third source is trusted without bounds."""
    given = g.table("customer").where("c_custkey % 5 = 0").select(_key("C", "c_custkey").alias("src"), F.concat(F.lit("S"), (F.col("c_custkey") % 10 + 1).cast("string")).alias("dst"), F.lit("AllowedToDelegate").alias("edge_type"))
    protected = g.table("customer").where("c_nationkey < 20").select(_key("C", "c_custkey").alias("id"))
    free = g.table("customer").where("c_custkey % 3 = 0").select(_key("C", "c_custkey").alias("id"))
    return derive.without_protected_delegation(g.edges.select(*EDGE).union(given), protected, free).where("edge_type = 'AllowedToDelegate'")


ORACLES["protected_delegation"] = GRAPH + """, a(host, id) AS (SELECT dst, src FROM edges WHERE edge_type = 'AdminTo' UNION SELECT a.host, m.src FROM a JOIN members m ON m.dst = a.id
), safe AS (SELECT host FROM a WHERE id NOT IN (SELECT dst FROM members) GROUP BY host HAVING bool_and(id IN (SELECT 'C' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey < 20)))
SELECT 'C' || CAST(c_custkey AS VARCHAR) AS src, 'S' || CAST(c_custkey % 10 + 1 AS VARCHAR) AS dst, 'AllowedToDelegate' AS edge_type FROM customer WHERE c_custkey % 5 = 0 AND (c_custkey % 3 = 0 OR 'S' || CAST(c_custkey % 10 + 1 AS VARCHAR) NOT IN (SELECT host FROM safe))"""


#: Names of customers by their number, and what they tell.
_OPERATORS = [
    ("Customer ", None), ("veeam operators ", "backup"), ("MSOL_", "identity-sync"), ("MECM site admins ", "deployment"), ("old-vcenter crew ", "hypervisor"), ("hyper-v ", "hypervisor"), ("Hyperv ", "hypervisor"), ("cortex xdr ", "endpoint-detection"),
    ("Passwordvault keepers ", "privileged-access"), ("entra connect ", "identity-sync"), ("x MSOL_", None), ("wsus ", "updates"), ("backup administrators ", "backup"), ("resccm ", None), ("CORP\\AAD_", "identity-sync"), ("edr admin ", "endpoint-detection"), ("esx", None),
]


@query
def shadow_tier0(g: Graph) -> DataFrame:
    """A domain that every eleventh customer may rewrite; names of most customers tell what they operate, or seem to."""
    k = _number("object_id")
    renamed = g.nodes.withColumn("name", F.when(F.col("node_type") == "User", F.element_at(F.array(*[F.concat(F.lit(x), k.cast("string")) for x, _ in _OPERATORS]), k % len(_OPERATORS) + 1)).when(F.col("node_type") == "Computer", "sccm01").otherwise(F.col("name")))
    nodes = renamed.union(g.nodes.limit(1).select(F.lit("DOM"), F.lit("corp"), F.lit("Domain"), F.lit(True), F.lit(False)))
    rights = g.table("customer").where("c_custkey % 11 = 0").select(_key("C", "c_custkey").alias("src"), F.lit("DOM").alias("dst"), F.lit("WriteDacl").alias("edge_type"))
    return derive.shadow_tier0(nodes, g.edges.select(*EDGE).union(rights), g.of("Computer").where("id = 'S1'"))


_TOLD = " ".join(f"WHEN {i} THEN '{what}'" for i, (_, what) in enumerate(_OPERATORS) if what)
ORACLES["shadow_tier0"] = f"""WITH x AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN 'derived' ELSE CASE c_custkey % {len(_OPERATORS)} {_TOLD} END END AS reason FROM customer) SELECT 'C' || CAST(k AS VARCHAR) AS id, reason FROM x WHERE reason IS NOT NULL"""


@query
def name_resolution(g: Graph) -> DataFrame:
    """Ids, names in other letters, and parts of names, some of which fit many objects and some none."""
    asked = g.table("nation").select(F.lower("n_name").alias("query")).union(g.table("customer").where("c_custkey % 10 = 0").select(F.lower(_key("C", "c_custkey")))).union(g.table("supplier").where("s_suppkey % 5 = 0").select(F.substring("s_name", 12, 40))).union(g.table("region").select(F.concat("r_name", F.lit("?"))))
    return tiering.resolve(asked, g.nodes)


ORACLES["name_resolution"] = GRAPH + """, q AS (SELECT lower(n_name) AS query FROM nation UNION SELECT 'c' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 10 = 0 UNION SELECT substr(s_name, 12, 40) FROM supplier WHERE s_suppkey % 5 = 0 UNION SELECT r_name || '?' FROM region
), hit AS (SELECT query, object_id, CASE WHEN upper(object_id) = upper(query) THEN 1 WHEN upper(name) = upper(query) OR upper(split_part(name, '@', 1)) = upper(query) THEN 2 ELSE 3 END AS stage FROM q JOIN nodes ON upper(object_id) = upper(query) OR contains(upper(name), upper(query)))
SELECT query, object_id, CAST(stage AS INTEGER) AS stage FROM hit h WHERE stage = (SELECT min(stage) FROM hit x WHERE x.query = h.query)"""


# changes


@query
def scenario_exposure(g: Graph) -> DataFrame:
    """A scenario for each region: its number's nations lose their hosts, and the unit gains a right over an administrator group."""
    regions = g.table("region").select(F.col("r_regionkey").alias("scenario"))
    top = regions.crossJoin(g.top.select("id"))  # five scenarios
    host = g.table("supplier").select(F.col("s_nationkey"), _key("S", "s_suppkey").alias("dst")).join(g.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    removed = host.where("n_nationkey > 0").select(F.col("n_regionkey").alias("scenario"), _key("N", "n_nationkey").alias("src"), "dst", F.lit("AdminTo").alias("edge_type"))
    added = regions.select("scenario", _key("R", "scenario").alias("src"), F.lit("S-1-5-21-0-512").alias("dst"), F.lit("GenericAll").alias("edge_type"))
    return whatif.scenario_exposure(g.edges, top, removed, added).groupBy("scenario").agg(F.count("*").alias("exposed"), F.sum("hops").alias("hops"), F.max("hops").alias("farthest"))


ORACLES["scenario_exposure"] = GRAPH + """, reg(e, r) AS (SELECT id, r FROM nat), sc AS (
  SELECT r_regionkey AS s, h.src, h.dst, h.attack FROM region, hops h LEFT JOIN reg ON reg.e = h.src WHERE NOT (h.edge_type = 'AdminTo' AND h.src <> 'S-1-5-21-0-512' AND reg.r IS NOT NULL AND reg.r = r_regionkey)
  UNION ALL SELECT r_regionkey, 'R' || CAST(r_regionkey AS VARCHAR), 'S-1-5-21-0-512', true FROM region
), w(s, id, attacked, d) AS (SELECT r_regionkey, id, false, 0 FROM region, top UNION SELECT sc.s, sc.src, w.attacked OR sc.attack, w.d + 1 FROM w JOIN sc ON sc.s = w.s AND sc.dst = w.id WHERE w.d < 24
), f AS (SELECT s, id, min(d) AS h FROM w WHERE attacked AND id NOT IN (SELECT id FROM top) GROUP BY s, id)
SELECT s AS scenario, count(*) AS exposed, CAST(sum(h) AS BIGINT) AS hops, CAST(max(h) AS INTEGER) AS farthest FROM f GROUP BY s"""


def _after(g: Graph) -> DataFrame:
    gone = g.edges.where("edge_type = 'AdminTo'").where(_number("dst") % 5 == 0).select(F.lit(0).alias("idx"), F.lit("remove").alias("op"), *[F.col(c) for c in EDGE], F.lit(None).cast("int").alias("ttl_minutes"))
    more = g.of("OU").select(F.lit(1), F.lit("add"), F.col("id"), F.lit("S-1-5-21-0-512"), F.lit("GenericAll"), F.lit(None).cast("int")).toDF(*gone.columns)
    return whatif.apply_changes(g.edges, gone.union(more))


@query
def applied_changes(g: Graph) -> DataFrame:
    """Edges by kind after removals, additions, a deletion and a move."""
    rows = g.of("OU").where("id in ('R1', 'R2')")
    none = F.lit(None).cast("string")
    other = rows.where("id = 'R1'").select(F.lit(2).alias("idx"), F.lit("delete").alias("op"), F.lit("N5").alias("src"), F.lit("N6").alias("dst"), F.lit("*").alias("edge_type"), F.lit(None).cast("int").alias("ttl_minutes"))
    other = other.union(rows.where("id = 'R2'").select(F.lit(3), F.lit("move"), F.lit("N7"), F.col("id"), none, F.lit(None).cast("int")))
    return whatif.apply_changes(_after(g), other).groupBy("edge_type").agg(F.count("*").alias("n"))


ORACLES["applied_changes"] = GRAPH + """, a AS (SELECT src, dst, edge_type FROM edges WHERE NOT (edge_type = 'AdminTo' AND TRY_CAST(substr(dst, 2) AS INTEGER) % 5 = 0) UNION SELECT object_id, 'S-1-5-21-0-512', 'GenericAll' FROM nodes WHERE node_type = 'OU'
), b AS (SELECT * FROM a WHERE src <> 'N5' AND dst <> 'N5' AND NOT (dst = 'N7' AND edge_type = 'Contains') UNION SELECT 'R2', 'N7', 'Contains') SELECT edge_type, count(*) AS n FROM b GROUP BY edge_type"""


@query
def changed_edges(g: Graph) -> DataFrame:
    return whatif.path_edge_diff(g.edges, _after(g)).groupBy("edge_type", "change").agg(F.count("*").alias("n"))


ORACLES["changed_edges"] = GRAPH + """ SELECT 'AdminTo' AS edge_type, 'removed' AS change, count(*) AS n FROM edges WHERE edge_type = 'AdminTo' AND TRY_CAST(substr(dst, 2) AS INTEGER) % 5 = 0
UNION ALL SELECT 'GenericAll', 'added', count(*) FROM nodes WHERE node_type = 'OU'"""


@query
def policy_verdicts(g: Graph) -> DataFrame:
    """Of proposed exposure by number of hops, what a policy says; customers of a segment have a waiver for what gets worse."""
    hops = _number("object_id") % 6 + 1
    rows = g.of("User").withColumnRenamed("id", "object_id").select(F.col("object_id").alias("id"), F.lit(None).cast("int").alias("hops_before"), hops.alias("hops_after"), F.element_at(F.array(*[F.lit(x) for x in ("new_exposure", "shortened", "lengthened")]), _number("object_id") % 3 + 1).alias("effect"))
    rows = rows.where((F.col("effect") != "shortened") | F.col("id").isin("C1", "C4", "C7"))
    waivers = g.nodes.limit(1).select(F.lit("shortened").alias("effect"), F.lit("*customer#*").alias("pattern"), F.lit(None).cast("date").alias("expires"))
    return whatif.judged(rows, g.nodes, waivers)


ORACLES["policy_verdicts"] = GRAPH + """, r AS (SELECT object_id, name, enabled, CAST(substr(object_id, 2) AS INTEGER) % 3 AS e, CAST(substr(object_id, 2) AS INTEGER) % 6 + 1 AS h FROM nodes WHERE node_type = 'User'
), k AS (SELECT CASE e WHEN 0 THEN 'new_exposure' WHEN 1 THEN 'shortened' ELSE 'lengthened' END AS effect, * FROM r WHERE e <> 1 OR object_id IN ('C1', 'C4', 'C7')
), s AS (SELECT effect, count(*) AS actors, min(h) AS h, bool_and(NOT enabled) AS off, bool_and(e = 1 AND regexp_matches(name, '(?i)^.*customer#.*$')) AS waived FROM k GROUP BY effect
), l AS (SELECT *, CASE WHEN effect = 'lengthened' THEN 1 ELSE greatest(CASE WHEN h <= 2 OR actors >= 100 THEN 5 WHEN h <= 4 OR actors >= 10 THEN 4 ELSE 3 END - CASE WHEN off THEN 1 ELSE 0 END, 3) END AS lv FROM s)
SELECT effect, CASE lv WHEN 1 THEN 'info' WHEN 3 THEN 'medium' WHEN 4 THEN 'high' WHEN 5 THEN 'critical' END AS severity, actors, waived, CASE WHEN effect = 'lengthened' OR waived THEN 'pass' WHEN lv >= 5 THEN 'block' WHEN lv >= 3 THEN 'review' ELSE 'pass' END AS verdict FROM l"""


# audit


@query
def audit_all(g: Graph) -> DataFrame:
    """Every rule over one column: users and hosts with all flags made from their keys; objects by finding."""
    k = _number("object_id")
    own = g.tiered.where("node_type in ('User', 'Computer')")
    flags = own.withColumns(
        {
            "hasspn": k % 4 == 0, "dontreqpreauth": k % 7 == 0, "passwordnotreqd": k % 13 == 0, "pwdneverexpires": k % 3 == 0, "sensitive": k % 2 == 0,
            "unconstraineddelegation": k % 6 == 0, "isdc": k % 10 == 0, "trustedtoauth": k % 9 == 0, "haslaps": F.when(k % 5 != 0, k % 4 == 1), "smbsigning": F.when(k % 3 != 0, k % 2 == 0), "ldapsigning": k % 8 != 0, "webclientrunning": k % 15 == 0,
            "description": F.when(k % 12 == 0, F.concat(F.lit("Password: "), k.cast("string"))).otherwise("the password was changed"), "sidhistory": F.when(k % 14 == 0, F.array(F.lit("S-1-5-21-9-512"))), "operatingsystem": F.when(k % 3 == 0, "Windows Server 2012 R2").otherwise("Windows Server 2022"),
            "lastlogontimestamp": (CONTEXT_CLOCK - (k % 200) * 86400).cast("double"), "whencreated": (CONTEXT_CLOCK - (k % 90) * 86400).cast("double"), "password_attributes": (k % 21 == 0).cast("int"), "supportedencryptiontypes": F.element_at(F.array(*[F.lit(x) for x in (0, 4, 24, 8)]), k % 4 + 1),
        }
    )
    found = audit.found(audit.Context(flags, g.edges, CONTEXT_CLOCK), AUDITED_ALL)
    return found.groupBy("finding", "severity").agg(F.count("*").alias("n"), F.min("object_id").alias("least"))


#: Finding, severity, and the condition in SQL on n (the object's row) and k (its number).
_U, _H, _PRIV = "u AND enabled", "NOT u AND enabled", "(tier = 0 OR admin_count)"
_ALL = [
    ("kerberoast-privileged", "critical", f"{_U} AND k % 4 = 0 AND {_PRIV}"),
    ("kerberoast", "medium", f"{_U} AND k % 4 = 0 AND NOT {_PRIV}"),
    ("asrep-privileged", "critical", f"{_U} AND k % 7 = 0 AND {_PRIV}"),
    ("asrep", "high", f"{_U} AND k % 7 = 0 AND NOT {_PRIV}"),
    ("passwd-notreqd", "high", f"{_U} AND k % 13 = 0"),
    ("priv-pwd-never-expires", "medium", f"{_U} AND k % 3 = 0 AND {_PRIV}"),
    ("pwd-in-description", "critical", "enabled AND k % 12 = 0"),
    ("sid-history", "medium", "enabled AND k % 14 = 0"),
    ("unconstrained-delegation", "high", "enabled AND k % 6 = 0 AND k % 10 <> 0"),
    ("protocol-transition", "medium", "enabled AND k % 9 = 0"),
    ("old-os", "high", f"{_H} AND k % 3 = 0"),
    ("no-laps", "medium", f"{_H} AND k % 5 <> 0 AND k % 4 <> 1 AND k % 10 <> 0"),
    ("smb-signing-dc", "critical", f"{_H} AND k % 3 <> 0 AND k % 2 <> 0 AND k % 10 = 0"),
    ("smb-signing", "medium", f"{_H} AND k % 3 <> 0 AND k % 2 <> 0 AND k % 10 <> 0"),
    ("ldap-signing", "high", f"{_H} AND k % 8 = 0"),
    ("webclient", "medium", f"{_H} AND k % 15 = 0"),
    ("stale-privileged", "medium", f"{_U} AND {_PRIV} AND k % 200 > 90"),
    ("stale-computers", "low", f"{_H} AND k % 200 > 90"),
    ("recent-privileged-object", "medium", f"enabled AND {_PRIV} AND k % 90 <= 30"),
    ("priv-not-protected", "medium", f"{_U} AND tier = 0 AND k % 2 <> 0"),
    ("admincount-orphan", "low", f"{_U} AND admin_count AND tier <> 0"),
    ("svc-privileged", "high", f"{_U} AND tier = 0 AND name LIKE 'SVC_%'"),
    ("pwd-attributes", "critical", "u AND k % 21 = 0"),
    ("weak-kerberos-enc-privileged", "high", f"enabled AND k % 4 = 1 AND {_PRIV}"),
    ("weak-kerberos-enc", "low", f"enabled AND k % 4 = 1 AND NOT {_PRIV}"),
    ("tier0-exposed-on-lower-tier", "critical", "NOT u AND tier <> 0 AND object_id IN (SELECT e.src FROM edges e JOIN tiered t ON t.object_id = e.dst WHERE e.edge_type = 'HasSession' AND t.tier = 0 AND t.node_type = 'User')"),
]
AUDITED_ALL = [x[0] for x in _ALL]
ORACLES["audit_all"] = GRAPH + ", n AS (SELECT *, node_type = 'User' AS u, CAST(substr(object_id, 2) AS INTEGER) AS k FROM tiered WHERE node_type IN ('User', 'Computer')), f AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS finding, '{severity}' AS severity, object_id FROM n WHERE {where}" for name, severity, where in _ALL
) + ") SELECT finding, severity, count(*) AS n, min(object_id) AS least FROM f GROUP BY finding, severity"


_CONTROLS = ", controls(framework, control, finding) AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{c}', '{x}')" for f, c, xs in audit.CONTROLS for x in xs.split()) + ") v(framework, control, finding))"
ORACLES["compliance_rollup"] = ORACLES["audit_rows"].rpartition(" SELECT finding")[0] + _CONTROLS + " SELECT framework, control, count(DISTINCT f.finding) AS n_findings FROM found f JOIN controls USING (finding) GROUP BY framework, control"


@query
def accepted_findings(g: Graph) -> DataFrame:
    """Findings of which some are accepted by a glob on the name, one acceptance having run out."""
    found = audit.found(_context(g), ["kerberoast", "asrep", "passwd-notreqd"])
    given = g.table("region").where("r_regionkey < 3").select(
        F.element_at(F.array(F.lit("kerberoast"), F.lit("asrep"), F.lit("asrep")), F.col("r_regionkey").cast("int") + 1).alias("finding"),
        F.element_at(F.array(F.lit("*7"), F.lit("customer#*1?"), F.lit("*")), F.col("r_regionkey").cast("int") + 1).alias("pattern"),
        F.when(F.col("r_regionkey") == 2, F.to_date(F.lit("2020-01-01"))).alias("expires"),
    )
    return audit.accept(found, given, "2024-01-01").select("finding", "object_id", "accepted")


ORACLES["accepted_findings"] = ORACLES["audit_rows"].rpartition(" SELECT finding")[0] + """ SELECT finding, object_id, (finding = 'kerberoast' AND name LIKE '%7') OR (finding = 'asrep' AND regexp_matches(name, '(?i)^customer#.*1.$')) AS accepted FROM found WHERE finding IN ('kerberoast', 'asrep', 'passwd-notreqd')"""


@query
def severity_counts(g: Graph) -> DataFrame:
    return audit.posture_counts(audit.found(_context(g), ["kerberoast", "asrep", "passwd-notreqd", "stale-privileged", "admincount-orphan"]))


ORACLES["severity_counts"] = ORACLES["audit_rows"].rpartition(" SELECT finding")[0] + " SELECT severity, count(DISTINCT finding) AS n FROM found WHERE finding IN ('kerberoast', 'asrep', 'passwd-notreqd', 'stale-privileged', 'admincount-orphan') GROUP BY severity"


# paths and detection


@query
def path_attractiveness(g: Graph) -> DataFrame:
    return paths.attractiveness(paths.path_costs(g.paths), 2.0, 0.5).select("path_id", "fragile", "attractiveness")


ORACLES["path_attractiveness"] = PATHS + " SELECT path_id, CAST(0 AS BIGINT) AS fragile, CAST(2.0 * sum(effort) + 0.5 * sum(noise) AS DOUBLE) AS attractiveness FROM steps JOIN dim USING (edge_type) GROUP BY path_id"


@query
def finding_confidence(g: Graph) -> DataFrame:
    return paths.finding_confidence(g.paths, paths.path_confidence(g.paths, g.edges))


ORACLES["finding_confidence"] = PATHS + """, r AS (SELECT path_id, min(CASE WHEN edge_type IN ('MemberOf', 'Contains', 'AZContains') THEN 3 ELSE conf END) AS c FROM steps JOIN dim USING (edge_type) GROUP BY path_id)
SELECT p.source, CASE max(r.c) WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS level FROM paths p JOIN r ON r.path_id = p.path_id GROUP BY p.source"""


@query
def watched_objects(g: Graph) -> DataFrame:
    """Detection watch lists by kind of step: how many objects they name in all."""
    return watch_lists(g.paths).withColumn("n", F.size("objects")).groupBy("edge_type").agg(F.sum("n").alias("n"))


ORACLES["watched_objects"] = PATHS + " SELECT edge_type, count(DISTINCT dst) AS n FROM steps WHERE edge_type NOT IN ('MemberOf', 'Contains', 'AZContains', 'AZRunsAs') GROUP BY edge_type"


@query
def fixes_for_half(g: Graph) -> DataFrame:
    """The first fixes that cut half of all paths, of five."""
    return scoring.fixes_for(scoring.choke_points(g.paths, g.nodes, 5), 50.0).select("rank", "src", "dst", "edge_type")


ORACLES["fixes_for_half"] = ORACLES["choke_points"].rpartition(" SELECT CAST(rank")[0] + ", p AS (SELECT *, cumulative * 100.0 / (SELECT count(*) FROM paths) AS pct FROM fixes) SELECT CAST(rank AS INTEGER) AS rank, src, dst, edge_type FROM p WHERE rank <= coalesce((SELECT min(rank) FROM p WHERE pct >= 50.0), 5)"


# scalars


@plain
def lifetimes(table) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.concat((k % 30).cast("string"), F.lit("d"), (k % 23).cast("string"), F.lit("H"))).when(k % 4 == 1, F.concat((k % 9).cast("string"), F.lit(".02:"), (k % 59).cast("string"), F.lit(":00"))).when(k % 4 == 2, F.concat((k % 90).cast("string"), F.lit("m"))).otherwise(F.lit("soon"))
    return table("orders").select("o_orderkey", scalars.ttl_minutes(text).alias("minutes"))


ORACLES["lifetimes"] = "SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 30) * 1440 + (o_orderkey % 23) * 60 WHEN 1 THEN (o_orderkey % 9) * 1440 + 120 + o_orderkey % 59 WHEN 2 THEN o_orderkey % 90 END AS INTEGER) AS minutes FROM orders"


@plain
def name_parts(table) -> DataFrame:
    """Domain, unit path and display name of distinguished names."""
    n = table("nation").join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    dn = F.concat(F.lit("CN=x,OU="), "n_name", F.lit(",ou="), "r_name", F.lit(",DC=corp"), F.col("r_regionkey").cast("string"), F.lit(",dc=local"))
    return n.select("n_nationkey", scalars.domain_of(dn).alias("domain"), scalars.ou_path(dn).alias("units"), scalars.display_name(F.concat("n_name", F.lit("@CORP@X"))).alias("shown"))


ORACLES["name_parts"] = "SELECT n_nationkey, 'CORP' || CAST(r_regionkey AS VARCHAR) || '.LOCAL' AS domain, r_name || '/' || n_name AS units, n_name AS shown FROM nation JOIN region ON n_regionkey = r_regionkey"


@plain
def service_accounts(table) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 6 == 0, F.concat(F.lit("svc_"), "c_name")).when(k % 6 == 1, F.concat("c_name", F.lit("$"))).when(k % 6 == 2, F.concat(F.lit("HealthMailbox"), k.cast("string"))).otherwise(F.col("c_name"))
    return table("customer").where(scalars.is_service_account(name)).select("c_custkey")


ORACLES["service_accounts"] = "SELECT c_custkey FROM customer WHERE c_custkey % 6 < 3"


@plain
def account_ages(table) -> DataFrame:
    stamp = F.when(F.col("o_orderkey") % 5 != 0, F.unix_timestamp(F.to_timestamp("o_orderdate")).cast("double")).otherwise(F.lit(0.0))
    return table("orders").select("o_orderkey", scalars.age_days(stamp, F.lit(CONTEXT_CLOCK)).cast("long").alias("days"))


ORACLES["account_ages"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(floor((1700000000 - epoch(CAST(o_orderdate AS TIMESTAMP))) / 86400) AS BIGINT) END AS days FROM orders"


@query
def signature_tier0(g: Graph) -> DataFrame:
    """Objects that are tier 0 by name, id or type alone, of suppliers given such."""
    k = F.col("s_suppkey")
    rows = g.table("supplier").select("s_suppkey", F.concat(F.lit("S-1-5-21-1-"), F.when(k % 5 == 0, F.lit("519")).otherwise(F.lit("1100"))).alias("i"), F.when(k % 7 == 0, F.lit("dnsadmins@corp")).otherwise(F.col("s_name")).alias("n"), F.when(k % 11 == 0, F.lit("EnterpriseCA")).otherwise(F.lit("Computer")).alias("t"))
    return rows.where(scalars.is_tier0(F.col("i"), F.col("n"), F.col("t"))).select("s_suppkey")


ORACLES["signature_tier0"] = "SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 OR s_suppkey % 11 = 0"


# facts beside a collection


@query
def relayed_logons(g: Graph) -> DataFrame:
    """A domain for each nation, most with Authenticated Users; hosts differ in signing and web client, every tenth is a controller."""
    k, n = F.col("s_suppkey"), F.col("n_nationkey")
    sid = F.concat(F.lit("S-1-5-21-"), n.cast("string"))
    none = F.lit(None).cast("boolean")
    row = lambda df, i, kind, domain, smb=none, web=none, ldap=none: df.select(i.alias("object_id"), F.lit(kind).alias("node_type"), domain.alias("domainsid"), smb.alias("smbsigning"), web.alias("webclientrunning"), ldap.alias("ldapsigning"))
    nation = g.table("nation")
    hosts = row(g.table("supplier").withColumn("n_nationkey", F.col("s_nationkey")), _key("S", "s_suppkey"), "Computer", sid, k % 3 != 0, k % 2 == 0, n % 2 == 0)
    users = F.concat(F.when(n % 2 == 0, sid).otherwise(_key("D", "n_nationkey")), F.lit("-S-1-5-11"))
    nodes = hosts.union(row(nation, _key("D", "n_nationkey"), "Domain", sid)).union(row(nation.where(n % 4 != 3), users, "Group", F.lit(None).cast("string")))
    return sidecars.relay_edges(nodes, g.edges.select(*EDGE), hosts.where(_number("object_id") % 10 == 0).select(F.col("object_id").alias("id")))


ORACLES["relayed_logons"] = """WITH h AS (SELECT s_suppkey AS k, s_nationkey AS n, CASE WHEN s_nationkey % 2 = 0 THEN 'S-1-5-21-' ELSE 'D' END || CAST(s_nationkey AS VARCHAR) || '-S-1-5-11' AS src FROM supplier)
SELECT src, 'S' || CAST(k AS VARCHAR) AS dst, 'CoerceAndRelayNTLMToSMB' AS edge_type FROM h WHERE n % 4 <> 3 AND k % 10 <> 0 AND k % 3 = 0
UNION ALL SELECT src, 'S' || CAST(k AS VARCHAR), 'CoerceAndRelayNTLMToLDAP' FROM h WHERE n % 4 <> 3 AND k % 10 <> 0 AND k % 2 = 0 AND n % 2 = 1 AND n IN (SELECT n FROM h WHERE k % 10 = 0)"""


@query
def repository_links(g: Graph) -> DataFrame:
    """Credentials of nations trust a repository of their region, at two services and one that isn't known; customers push to it."""
    n, c = F.col("n_nationkey"), F.col("c_custkey")
    nation = g.table("nation").join(g.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    issuer = F.when(n % 3 == 0, "https://token.actions.githubusercontent.com/x").when(n % 3 == 1, "https://gitlab.com").otherwise("https://example.org")
    subject = F.when(n % 3 == 0, F.concat(F.lit("repo:org/"), "r_name", F.lit(":ref:refs/heads/main"))).otherwise(F.concat(F.lit("project_path:org/"), "r_name", F.lit(":ref_type:branch")))
    credentials = nation.where(n > 0).select(_key("F", "n_nationkey").alias("credential"), issuer.alias("issuer"), subject.alias("subject"))
    to = nation.where(n > 0).select(_key("F", "n_nationkey"), _key("N", "n_nationkey"), F.lit("AZAuthenticatesTo"))
    pushers = g.table("customer").where(c % 5 == 0).join(nation, F.col("c_nationkey") == n).select(F.lit("github").alias("provider"), F.concat(F.lit("Org/"), "r_name").alias("repo"), F.concat(F.when(c % 2 == 0, "X").otherwise("C"), c.cast("string")).alias("principal"))
    return sidecars.repository_edges(pushers, credentials, g.nodes, g.edges.select(*EDGE).union(to))


ORACLES["repository_links"] = """WITH n AS (SELECT n_nationkey AS k, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey), t AS (SELECT k, r FROM n WHERE k > 0 AND k % 3 < 2
), p AS (SELECT c_custkey AS c, r FROM customer JOIN n ON c_nationkey = k WHERE c_custkey % 5 = 0)
SELECT DISTINCT 'CICD:GITHUB:ORG/' || t.r AS src, 'N' || CAST(k AS VARCHAR) AS dst, 'AZAuthenticatesTo' AS edge_type FROM t JOIN p ON p.r = t.r
UNION ALL SELECT 'C' || CAST(c AS VARCHAR), 'CICD:GITHUB:ORG/' || r, 'MemberOf' FROM p WHERE c % 2 = 1 AND r IN (SELECT r FROM t)"""


@query
def edges_inside(g: Graph) -> DataFrame:
    """Edges among users and hosts, by kind."""
    return tiering.induced(g.edges, g.of("User", "Computer")).groupBy("edge_type").agg(F.count("*").alias("n"))


ORACLES["edges_inside"] = GRAPH + ", i AS (SELECT object_id FROM nodes WHERE node_type IN ('User', 'Computer')) SELECT edge_type, count(*) AS n FROM edges WHERE src IN (SELECT object_id FROM i) AND dst IN (SELECT object_id FROM i) GROUP BY edge_type"


@query
def paths_through_busiest(g: Graph) -> DataFrame:
    """Paths through the object that most paths pass."""
    busiest = scoring.node_chokepoints(g.paths, 1).first()
    return paths.through_node(g.paths, busiest["object_id"] if busiest else "").select("path_id", "length")


ORACLES["paths_through_busiest"] = ORACLES["node_chokepoints"].rpartition("SELECT object_id, n, round")[0] + "SELECT path_id, length FROM paths WHERE list_contains(nl, (SELECT object_id FROM c ORDER BY n DESC, object_id LIMIT 1))"


@query
def paths_onto_named(g: Graph) -> DataFrame:
    return paths.onto_named(g.paths, g.nodes, "customer", 10).select("path_id", "length")


ORACLES["paths_onto_named"] = PATHS + " SELECT path_id, length FROM paths WHERE target IN (SELECT object_id FROM nodes WHERE upper(name) LIKE '%CUSTOMER%') ORDER BY length, path_id LIMIT 10"


@query
def residual_points(g: Graph) -> DataFrame:
    """Where to watch once the first three fixes are made."""
    return scoring.residual_points(g.nodes, g.edges, g.paths, 3, 5)


@query
def chains_of_properties(g: Graph) -> DataFrame:
    """Patterns by properties: every third customer has a service name, every fourth needs no pre-authentication, every other host delegates."""
    k, kind = F.substring("object_id", 2, 20).try_cast("int"), F.col("node_type")
    nodes = g.nodes.withColumns({"hasspn": (kind == "User") & (k % 3 == 0), "dontreqpreauth": k % 4 == 0, "unconstraineddelegation": k % 2 == 0})
    named = F.col("chain").isin("kerberoast", "asrep_roasting", "unconstrained_delegation")
    return paths.chains(g.paths, nodes, g.edges).where(named).groupBy("chain").agg(F.count("*").alias("n"))


ORACLES["chains_of_properties"] = PATHS + """, v AS (SELECT path_id, i, nl[i] AS id, TRY_CAST(substr(nl[i], 2) AS INTEGER) AS k, CASE WHEN i > 1 THEN el[i - 1] END AS by_ FROM (SELECT path_id, nl, el, unnest(range(1, length + 2)) AS i FROM paths) u
), x AS (SELECT path_id, 'kerberoast' AS chain FROM v WHERE id LIKE 'C%' AND k % 3 = 0 AND by_ = 'GenericWrite' UNION SELECT path_id, 'asrep_roasting' FROM v WHERE id LIKE 'C%' AND k % 4 = 0 AND i = 1
  UNION SELECT path_id, 'unconstrained_delegation' FROM v WHERE id LIKE 'S%' AND k % 2 = 0) SELECT chain, count(*) AS n FROM x GROUP BY chain"""
