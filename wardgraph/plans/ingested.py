"""Queries over collection files that are written from the order tables and parsed again, each with its SQL.

Files hold at most some hundred objects each, as collectors write them. Importing the module registers the queries beside the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import adcs
from ..sources import collections, pki
from ..storage import materialise
from .facts import _key
from .oracle import GRAPH, ORACLES
from .queries import Graph, query

ENTRY = "array<struct<PrincipalSID: string, RightName: string>>"


def _files(kind: str, rows: DataFrame, by: Column, *fields: Column) -> DataFrame:
    """(file, text): JSON files of objects of a kind, one for each value of ``by``."""
    texts = rows.select(by.alias("file"), F.struct(*fields).alias("x")).groupBy("file").agg(F.collect_list("x").alias("data"))
    return texts.select(F.concat(F.lit(f"{kind}-"), "file").alias("file"), F.to_json(F.struct(F.struct(F.lit(kind).alias("type"), F.size("data").alias("count")).alias("meta"), "data")).alias("text"))


def _entries(g: Graph) -> DataFrame:
    """(object_id, Aces): rights of customers over one another."""
    rights = g.edges.where("edge_type in ('ForceChangePassword', 'GenericWrite', 'WriteDacl')")
    return rights.groupBy(F.col("dst").alias("object_id")).agg(F.collect_list(F.struct(F.col("src").alias("PrincipalSID"), F.col("edge_type").alias("RightName"))).alias("Aces"))


def collected(g: Graph) -> DataFrame:
    """(file, text): the identity graph as a collection."""
    number = F.substring("object_id", 2, 20).cast("int")
    own = F.col("object_id").alias("ObjectIdentifier")
    properties = F.struct("name", "enabled", F.col("admin_count").alias("admincount")).alias("Properties")
    of = lambda kind: g.nodes.where(F.col("node_type") == kind)
    some = lambda kind, key, value: g.edges.where(F.col("edge_type") == kind).select(F.col(key).alias("object_id"), F.col(value).alias("x"))
    listed = lambda rows, name: rows.groupBy("object_id").agg(F.collect_list(F.struct(F.col("x").alias("ObjectIdentifier"))).alias(name))
    primary = some("MemberOf", "src", "dst").withColumnRenamed("x", "PrimaryGroupSID")
    users = of("User").join(primary, "object_id", "left").join(_entries(g), "object_id", "left")
    admins = listed(some("AdminTo", "dst", "src"), "Results").select("object_id", F.array(F.struct(F.concat("object_id", F.lit("-544")).alias("ObjectIdentifier"), "Results")).alias("LocalGroups"))
    sessions = some("HasSession", "src", "dst").groupBy("object_id").agg(F.struct(F.collect_list(F.struct(F.col("x").alias("UserSID"), F.col("object_id").alias("ComputerSID"))).alias("Results")).alias("Sessions"))
    hosts = of("Computer").join(admins, "object_id", "left").join(sessions, "object_id", "left")
    nested = some("MemberOf", "dst", "src").join(of("Group").select(F.col("object_id").alias("x")), "x", "left_semi").select("object_id", "x")
    groups = of("Group").join(listed(nested, "Members"), "object_id", "left")
    ous = of("OU").join(listed(some("Contains", "src", "dst"), "ChildObjects"), "object_id", "left")
    part = F.floor(number / 300).cast("string")
    files = [
        _files("users", users, part, own, properties, F.col("PrimaryGroupSID"), F.col("Aces")),
        _files("computers", hosts, part, own, properties, F.col("LocalGroups"), F.col("Sessions")),
        _files("groups", groups, F.lit("0"), own, properties, F.col("Members")),
        _files("ous", ous, F.lit("0"), own, properties, F.col("ChildObjects")),
    ]
    return materialise(reduce(DataFrame.union, files), "collection")


@query
def collection_edges(g: Graph) -> DataFrame:
    """The edges of the graph, written as a collection and read again."""
    return collections.edges(collections.parse(collected(g))[0])


ORACLES["collection_edges"] = GRAPH + " SELECT src, dst, edge_type FROM edges"


@query
def collection_nodes(g: Graph) -> DataFrame:
    return collections.nodes(collections.parse(collected(g))[0]).select("object_id", "name", "node_type", "enabled", "admin_count")


ORACLES["collection_nodes"] = GRAPH + " SELECT object_id, name, node_type, enabled, admin_count FROM nodes"


@query
def certificate_abuse(g: Graph) -> DataFrame:
    """Parts as templates, with flags made from their sizes, which five authorities publish; one of these isn't trusted for logon. Nations may enrol in
    templates, and every second one at the authorities; some customers control templates, hosts run authorities."""
    size, key = F.col("p_size").cast("int"), F.col("p_partkey").cast("int")
    nation = lambda k: F.when(k == 0, "S-1-5-21-0-512").otherwise(F.concat(F.lit("N"), k.cast("string")))
    entry = lambda who, right: F.struct(who.alias("PrincipalSID"), F.lit(right).alias("RightName"))
    controls = F.when(key % 10 == 0, F.array(entry(nation(key % 25), "Enroll"), entry(F.concat(F.lit("N"), (key % 24 + 1).cast("string")), "WriteDacl"))).otherwise(F.array(entry(nation(key % 25), "Enroll")))
    flags = F.struct(
        F.concat(F.lit("TEMPLATE"), key).alias("name"), (size % 2 == 0).alias("enrolleesuppliessubject"), (size % 3 != 0).alias("authenticationenabled"), (size % 5 == 0).alias("requiresmanagerapproval"),
        F.when(size % 4 == 0, 1).otherwise(2).alias("schemaversion"), F.when(size % 7 == 0, 1).otherwise(0).alias("authorizedsignatures"),
    )
    templates = _files("certtemplates", g.table("part"), F.floor(key / 300).cast("string"), _key("T", "p_partkey").alias("ObjectIdentifier"), flags.alias("Properties"), controls.alias("Aces"))
    r = F.col("r_regionkey").cast("int")
    may = g.table("nation").where("n_nationkey % 2 = 0").agg(F.collect_list(entry(nation(F.col("n_nationkey")), "Enroll")).alias("Aces"))  # one row of thirteen entries
    # what an authority publishes comes in several files, as a collection of several runs would have it
    offered = g.table("part").groupBy((key % 5).alias("r"), F.floor(key / 1500).alias("f")).agg(F.collect_list(F.struct(_key("T", "p_partkey").alias("ObjectIdentifier"))).alias("EnabledCertTemplates"))
    ca = g.table("region").join(offered, r == F.col("r")).crossJoin(may)
    named = F.struct(F.concat(F.lit("CA"), r, F.lit("@CORP")).alias("name"), F.lit("CORP").alias("domain"), F.concat(F.lit("aa0"), r).alias("certthumbprint"))
    authorities = _files("enterprisecas", ca, F.concat_ws("-", r, "f"), F.concat(F.lit("CA"), r).alias("ObjectIdentifier"), named.alias("Properties"), F.concat(F.lit("S"), r * 10 + 1).alias("HostingComputer"), F.col("EnabledCertTemplates"), F.col("Aces"))
    store = g.table("region").where("r_regionkey < 4").agg(F.collect_list(F.concat(F.lit("AA0"), r)).alias("t"))
    stores = _files("ntauthstores", store, F.lit("0"), F.lit("NT").alias("ObjectIdentifier"), F.struct(F.lit("CORP").alias("domain"), F.col("t").alias("certthumbprints")).alias("Properties"), F.array(entry(F.lit("C1"), "WriteDacl")).alias("Aces"))
    domain = _files("domains", g.spark.range(1), F.lit("0"), F.lit("D").alias("ObjectIdentifier"), F.struct(F.lit("CORP").alias("name")).alias("Properties"))
    objects = materialise(collections.parse(materialise(reduce(DataFrame.union, [templates, authorities, stores, domain]), "collection"))[0], "objects")
    nodes = g.nodes.select("object_id", "name", "node_type").union(collections.nodes(objects).select("object_id", "name", "node_type"))
    edges = materialise(g.edges.select("src", "dst", "edge_type").union(collections.edges(objects)), "edges")
    found = pki.authorities(objects).dropDuplicates(["ca"])
    relay = pki.relay_facts(objects, found)
    return adcs.derive(nodes, edges, g.top, pki.templates(objects), found, pki.published(objects), pki.stores(objects), pki.issuance_policies(objects), pki.controllers(objects), relay)


ORACLES["certificate_abuse"] = GRAPH + """, t AS (SELECT p_partkey AS p, p_size AS s, p_partkey % 5 AS r, CASE WHEN p_partkey % 25 = 0 THEN 'S-1-5-21-0-512' ELSE 'N' || CAST(p_partkey % 25 AS VARCHAR) END AS n, CASE WHEN p_partkey % 10 = 0 THEN 'N' || CAST(p_partkey % 24 + 1 AS VARCHAR) END AS w FROM part WHERE p_partkey % 5 < 4
), may(id) AS (SELECT id FROM nat WHERE k % 2 = 0 UNION SELECT m.src FROM may JOIN members m ON m.dst = may.id
), held(p, need, id) AS (SELECT p, 1, n FROM t UNION SELECT p, 2, w FROM t WHERE w IS NOT NULL UNION SELECT h.p, h.need, m.src FROM held h JOIN members m ON m.dst = h.id
), full_ AS (SELECT DISTINCT p, need, id FROM held WHERE id IN (SELECT id FROM may)
), high AS (SELECT f.* FROM full_ f WHERE NOT EXISTS (SELECT 1 FROM members m JOIN full_ u ON u.p = f.p AND u.need = f.need AND u.id = m.dst WHERE m.src = f.id)
), x AS (SELECT high.need, high.id, t.* FROM high JOIN t USING (p)), a AS (
  SELECT id AS src, 'ADCSESC1' AS edge_type FROM x WHERE need = 1 AND s % 3 <> 0 AND s % 5 <> 0 AND s % 7 <> 0 AND s % 2 = 0
  UNION SELECT id, 'ADCSESC15' FROM x WHERE need = 1 AND s % 4 = 0 AND s % 2 = 0 AND s % 5 <> 0 AND s % 7 <> 0
  UNION SELECT id, 'ADCSESC4' FROM x WHERE need = 2
  UNION SELECT 'C1', 'ADCSESC5' WHERE EXISTS (SELECT 1 FROM nodes WHERE object_id = 'C1')
  UNION SELECT object_id, 'GoldenCert' FROM nodes WHERE object_id IN (SELECT 'S' || CAST(10 * r + 1 AS VARCHAR) FROM t))
SELECT src, 'D' AS dst, edge_type FROM a WHERE src NOT IN (SELECT id FROM top)"""
