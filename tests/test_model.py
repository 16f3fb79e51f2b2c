"""Ingest, derivation, tiers, audit, what-if, streams: small tables with answers worked out by hand."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from wardgraph.functions import registry, scalars
from wardgraph.operators import audit, derive, scoring, tiering, whatif
from wardgraph.operators import paths as P
from wardgraph.sources import collections
from wardgraph.storage import materialise
from wardgraph.streaming import sessions

EDGES = "src string, dst string, edge_type string"
NODES = "object_id string, name string, node_type string, enabled boolean, admin_count boolean"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def corp(spark):
    nodes = spark.createDataFrame(
        [
            ("D", "CORP.LOCAL", "Domain", None, None),
            ("D-512", "DOMAIN ADMINS@CORP.LOCAL", "Group", None, True),
            ("G1", "HELP DESK@CORP.LOCAL", "Group", None, None),
            ("U1", "ALICE@CORP.LOCAL", "User", True, None),
            ("U2", "BOB@CORP.LOCAL", "User", True, False),
            ("U3", "SVC_SQL@CORP.LOCAL", "User", True, True),
            ("U4", "EVE@CORP.LOCAL", "User", False, None),
            ("C1", "WS1.CORP.LOCAL", "Computer", True, None),
        ],
        NODES,
    )
    edges = spark.createDataFrame(
        [("U1", "G1", "MemberOf"), ("G1", "U3", "GenericAll"), ("U3", "D-512", "MemberOf"), ("U2", "C1", "CanRDP"), ("C1", "U3", "HasSession"), ("U4", "U1", "ForceChangePassword"), ("U1", "C1", "AdminTo"), ("G1", "D", "GetChanges"), ("U1", "D", "GetChangesAll")],
        EDGES,
    )
    return nodes, edges


def test_tiers(corp):
    nodes, edges = corp
    tiers = dict(rows(tiering.classify(nodes, edges), "object_id", "tier"))
    assert {k for k, v in tiers.items() if v == 0} == {"D", "D-512", "U3"}
    assert {k for k, v in tiers.items() if v == 1} == set()
    assert tiering.summary(tiering.classify(nodes, edges), edges).where("kind = 'tier' and label = '0'").first()["n"] == 3


def test_paths_and_fixes(corp):
    nodes, edges = corp
    top = tiering.tier0(nodes, edges)
    found = P.with_ids(P.enumerate_paths(nodes, edges, top, 5, None)).cache()
    by = {r["path_id"] for r in found.collect()}
    assert "U1>G1>U3|MemberOf>GenericAll" in by and "U2>C1>U3|CanRDP>HasSession" in by and "U4>U1>G1>U3|ForceChangePassword>MemberOf>GenericAll" in by
    assert not any(x.split("|")[0].split(">")[-1] != "U3" for x in by)
    fixes = scoring.choke_points(found, nodes, 3).collect()
    assert sum(f["eliminated"] for f in fixes) == fixes[-1]["cumulative"] <= found.count()
    assert all(f["edge_type"] != "MemberOf" for f in fixes)
    assert rows(scoring.fixes_for(scoring.choke_points(found, nodes, 3), 1.0), "rank") == [(1,)]
    few = P.enumerate_paths(nodes, edges, top, 5, 2)
    assert few.count() == 2 and few.agg(F.max("length")).first()[0] <= 2


def test_both_rights_gives_the_highest_holders(corp):
    nodes, edges = corp
    top = tiering.tier0(nodes, edges)
    assert rows(derive.dcsync(edges, top), "src", "dst", "edge_type") == [("U1", "D", "DCSync")]


def test_a_large_group_is_many_tasks_work(spark, monkeypatch):
    monkeypatch.setattr(tiering, "_PART", 8, raising=False)
    users = [f"U{i}" for i in range(40)]
    member = [(u, "G", "MemberOf") for u in users] + [("G", "H", "MemberOf")]
    rights = [("G", f"C{i}", kind) for i in range(30) for kind in ("AdminTo", "CanRDP")] + [("H", "C0", "AdminTo"), ("U1", "C1", "AdminTo"), ("X", "C1", "AdminTo")]
    edges = materialise(spark.createDataFrame(member + rights, EDGES).coalesce(1), "edges")
    found = tiering.effective_permissions(spark.createDataFrame([(u,) for u in users], "id string"), edges).withColumn("task", F.spark_partition_id()).collect()
    expected = [(u, c, kind, "G") for u in users for g, c, kind in rights if g == "G"] + [(u, "C0", "AdminTo", "H") for u in users] + [("U1", "C1", "AdminTo", None)]
    assert sorted(map(str, (tuple(r)[:4] for r in found))) == sorted(map(str, expected))
    mine = [r["task"] for r in found if r["principal_id"] == "U1"]  # not even one member's rows are one task's
    assert max(mine.count(t) for t in mine) < 0.6 * len(mine)


def test_policies_reach_and_are_blocked(spark):
    contains = spark.createDataFrame([("OU1", "OU2"), ("OU2", "H1"), ("OU1", "H2")], "src string, dst string")
    links = spark.createDataFrame([("P", "OU1", False), ("Q", "OU1", True)], "gpo string, container string, enforced boolean")
    blocked = spark.createDataFrame([("OU2",)], "id string")
    assert rows(derive.gpo_scope(links, contains, blocked), "gpo", "id") == [("P", "H2"), ("P", "OU1"), ("Q", "H1"), ("Q", "H2"), ("Q", "OU1"), ("Q", "OU2")]


def test_protected_hosts_need_every_administrator(spark):
    edges = spark.createDataFrame([("G", "H1", "AdminTo"), ("a", "G", "MemberOf"), ("b", "G", "MemberOf"), ("a", "H2", "AdminTo"), ("x", "H1", "AllowedToDelegate"), ("x", "H2", "AllowedToDelegate"), ("y", "H2", "AllowedToDelegate")], EDGES)
    protected = spark.createDataFrame([("a",)], "id string")
    assert rows(derive.fully_protected_hosts(edges, protected), "id", "admins") == [("H2", 1)]
    left = derive.without_protected_delegation(edges, protected, spark.createDataFrame([("y",)], "id string"))
    assert rows(left.where("edge_type = 'AllowedToDelegate'"), "src", "dst") == [("x", "H1"), ("y", "H2")]


def test_protected_hosts_find_members_once_for_each_administrator(spark, monkeypatch):
    """Many hosts share a large group: no row for a host and a member. Nested and empty groups, cycles, nulls and shared members count as they did by host."""
    made, closure = [], derive.closure

    def counted(*args):
        found = closure(*args)
        made.append(found.count())
        return found

    monkeypatch.setattr(derive, "closure", counted)
    edges = [(f"u{i}", "G", "MemberOf") for i in range(50)] + [("G", f"H{i}", "AdminTo") for i in range(100)]
    edges += [("u1", "H1", "AdminTo"), ("v", "H1", "AdminTo"), ("x", "H2", "AdminTo"), (None, "H3", "AdminTo"), ("u2", "K", "MemberOf"), ("v", "K", "MemberOf"), ("K", "H4", "AdminTo"), ("K", "H5", "AdminTo"), ("G", "K2", "MemberOf"), ("K2", "H4", "AdminTo")]
    edges += [("A", "B", "MemberOf"), ("B", "A", "MemberOf"), ("A", "H6", "AdminTo"), ("A", "H7", "AdminTo"), ("A", "I", "AdminTo"), ("v", "I2", "AdminTo"), ("A", "I2", "AdminTo"), ("v", "I2", "AdminTo"), ("v", None, "AdminTo")]
    protected = spark.createDataFrame([(f"u{i}",) for i in range(50)] + [("v",), ("v",), (None,)], "id string")
    found = {r["id"]: r["admins"] for r in derive.fully_protected_hosts(spark.createDataFrame(edges, EDGES), protected).collect()}
    want = {f"H{i}": 50 for i in range(100)} | {"H1": 51, "H4": 51, "H5": 51, "I2": 1, None: 1}
    assert found == {h: n for h, n in want.items() if h not in ("H2", "H3")}
    assert sum(made) < 200


def test_names_of_shadow_tier0_are_matched_once_and_in_many_tasks(spark, monkeypatch):
    """One small file holds many names; what tells them is costly."""
    written = []
    materialise = derive.materialise
    monkeypatch.setattr(derive, "materialise", lambda df, label: written.append(df.rdd.getNumPartitions()) or materialise(df, label))
    nodes = spark.createDataFrame([(f"u{i}", "veeam operators" if i % 2 else "nobody", "User", True, False) for i in range(100)], NODES).coalesce(1)
    found = derive.shadow_tier0(nodes, spark.createDataFrame([], EDGES), spark.createDataFrame([], "id string"))
    assert found.where("reason = 'backup'").count() == found.count() == 50
    assert written and min(written) > 1


@pytest.fixture(scope="module")
def collected(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("collection")
    users = {
        "meta": {"type": "users", "count": 1, "version": 5},
        "data": [
            {
                "ObjectIdentifier": "U1",
                "Properties": {"name": "ALICE@CORP.LOCAL", "enabled": True, "admincount": False, "hasspn": True, "description": "none", "lastlogontimestamp": 1700000000},
                "Aces": [{"PrincipalSID": "G1", "RightName": "GenericAll"}, {"PrincipalSID": "U1", "RightName": "Owns"}, {"PrincipalSID": "G2", "RightName": "AddSelf"}],
                "PrimaryGroupSID": "D-513",
                "SPNTargets": [],
            }
        ],
    }
    domains = {"meta": {"type": "domains"}, "data": [{"ObjectIdentifier": "D", "Properties": {"name": "CORP.LOCAL"}, "Aces": [{"PrincipalSID": "U1", "RightName": "AllExtendedRights"}], "Trusts": [{"TargetDomainSid": "E", "TrustDirection": "Bidirectional", "SidFilteringEnabled": False}]}]}
    computers = {"meta": {"type": "computers"}, "data": [{"ObjectIdentifier": "C1", "Properties": {"name": "WS1"}, "Sessions": {"Results": [{"UserSID": "U1", "ComputerSID": "C1"}], "Collected": True}, "LocalAdmins": {"Results": [{"ObjectIdentifier": "G1"}]}}]}
    (at / "1_users.json").write_text("﻿" + json.dumps(users), encoding="utf-8")
    (at / "2_broken.json").write_text("{not json")
    with zipfile.ZipFile(at / "rest.zip", "w") as z:
        z.writestr("domains.json", json.dumps(domains))
        z.writestr("computers.json", json.dumps(computers))
        z.writestr("notes.txt", "left out")
        z.writestr("denies.json", json.dumps({"data": [{"PrincipalSID": "G1", "RightName": "GenericAll", "ObjectIdentifier": "U1"}], "meta": {"type": "denies"}}))
    return collections.parse(collections.scan(spark, str(at)))


def test_ingest(collected):
    objects, bad = collected
    assert [r["file"].rpartition("/")[2] for r in bad.collect()] == ["2_broken.json"]
    nodes = {r["object_id"]: r for r in collections.nodes(objects).collect()}
    assert {k: r["node_type"] for k, r in nodes.items()} == {"U1": "User", "D": "Domain", "C1": "Computer"}
    assert nodes["U1"]["hasspn"] is True and nodes["U1"]["pwdneverexpires"] is None and nodes["U1"]["enabled"] is True
    assert set(rows(collections.edges(objects), "src", "dst", "edge_type")) >= {("G1", "U1", "GenericAll"), ("G2", "U1", "AddMember"), ("U1", "D-513", "MemberOf"), ("U1", "D", "GenericAll"), ("U1", "D", "DCSync"), ("C1", "U1", "HasSession"), ("G1", "C1", "AdminTo")}
    assert not any(s == d for s, d, _ in rows(collections.edges(objects), "src", "dst", "edge_type"))
    assert rows(collections.denies(objects), "principal", "edge_type", "target") == [("G1", "GenericAll", "U1")]
    assert rows(collections.trusts(objects), "src", "dst", "edge_type") == [("D", "E", "TrustedBy"), ("E", "D", "TrustedBy")]


def test_snapshot_round_trip(spark, corp, tmp_path):
    nodes, edges = corp
    denies = spark.createDataFrame([], "deny_id long, principal string, edge_type string, target string")
    collections.write_snapshot(str(tmp_path / "s"), nodes, edges, denies)
    n, e, d = collections.read_snapshot(spark, str(tmp_path / "s"))
    assert rows(e, "*") == rows(edges, "*") and n.count() == nodes.count() and d.count() == 0


def test_merge_counts_collections(spark):
    edges = spark.createDataFrame([("a", "b", "HasSession", "1"), ("a", "b", "HasSession", "1"), ("a", "b", "HasSession", "2"), ("a", "c", "AdminTo", "2")], EDGES + ", collection_id string")
    assert rows(derive.merge_collections(edges), "src", "dst", "seen") == [("a", "b", 2), ("a", "c", 1)]
    nodes = spark.createDataFrame([("a", "Unknown", None, "1"), ("a", "User", "x", "0"), ("b", "Unknown", None, "1")], "object_id string, node_type string, name string, collection_id string")
    assert set(rows(derive.merge_nodes(nodes).where("object_id = 'a'"), "object_id", "node_type", "name")) == {("a", "User", "x")}


def test_audit_rules_leave_missing_flags_alone(spark):
    tiered = spark.createDataFrame([("1", "a", "User", True, None, 0, True, None), ("2", "b", "User", None, None, 2, True, False), ("3", "c", "User", False, None, 0, True, True), ("4", "D", "Computer", True, None, 2, None, None)], NODES + ", tier int, hasspn boolean, smbsigning boolean")
    context = audit.Context(tiered, spark.createDataFrame([], EDGES))
    found = audit.found(context)
    assert rows(found.where("finding like 'kerberoast%'"), "finding", "object_id") == [("kerberoast", "2"), ("kerberoast-privileged", "1")]
    assert found.where("finding like 'smb%' or finding like 'stale%'").count() == 0
    accepted = audit.accept(found, spark.createDataFrame([("kerberoast", "B", None)], "finding string, pattern string, expires date"), "2026-01-01")
    assert rows(accepted.where("accepted"), "object_id") == [("2",)]


def test_changes_are_parsed_and_applied(spark, corp):
    nodes, edges = corp
    changes = whatif.parse_changes('add-member alice "DOMAIN ADMINS" ttl=2h # for a while\nremove U4 ForceChangePassword U1\ndelete bob\n')
    assert [c[1] for c in changes] == ["add", "remove", "delete"] and changes[0][5] == 120
    with pytest.raises(whatif.ChangeError, match="line 1: unknown verb.*\nline 2"):
        whatif.parse_changes("nonsense a b\ngrant a b\n")
    resolved = whatif.resolve_changes(spark.createDataFrame(changes, whatif.CHANGES), nodes)
    after = whatif.apply_changes(edges, resolved)
    assert ("U1", "D-512", "MemberOf") in rows(after, *after.columns)
    assert not {r for r in rows(after, *after.columns) if "U2" in r[:2] or r == ("U4", "U1", "ForceChangePassword")}
    effect = whatif.impact(nodes, edges, after)
    assert rows(effect.tiers, "id", "effect") == [("U1", "promoted")]
    with pytest.raises(whatif.ChangeError, match="nobody"):
        whatif.resolve_changes(spark.createDataFrame(whatif.parse_changes("add-member nobody G1"), whatif.CHANGES), nodes)


def test_policy(spark, corp):
    nodes, _ = corp
    found = spark.createDataFrame([("U1", None, 2, "new_exposure"), ("U2", 3, None, "secured")], "id string, hops_before int, hops_after int, effect string")
    none = spark.createDataFrame([], "effect string, pattern string, expires date")
    assert rows(whatif.judged(found, nodes, none), "effect", "severity", "verdict") == [("new_exposure", "critical", "block"), ("secured", "info", "pass")]
    waiver = spark.createDataFrame([("new_exposure", "alice*")], "effect string, pattern string").selectExpr("*", "cast(null as date) expires")
    assert rows(whatif.judged(found, nodes, waiver).where("effect = 'new_exposure'"), "verdict") == [("pass",)]


def test_scalars(spark):
    one = spark.range(1).select(
        scalars.ttl_minutes(F.lit("2h30m")).alias("a"), scalars.ttl_minutes(F.lit("1.02:00:00")).alias("b"), scalars.ttl_minutes(F.lit("soon")).alias("c"),
        scalars.domain_of(F.lit("CN=x,DC=corp,DC=local")).alias("d"), scalars.ou_path(F.lit("CN=x,OU=b,OU=a,DC=c")).alias("e"), F.lit("SRV-A").rlike("x").alias("f"),
    ).first()
    assert tuple(one)[:5] == (150, 1560, None, "CORP.LOCAL", "a/b")
    dim = registry.edge_dim(spark)
    assert dim.count() == dim.select("edge_type").distinct().count() == len(registry.EDGES)
    assert dim.where("weight <= 0 or effort < 0").count() == 0 and set(registry.NON_TRAVERSABLE).isdisjoint(registry.ATTACK)


def test_streamed_sessions_equal_batch(spark, tmp_path):
    batch = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-01 00:00:00"), (9, "2024-01-03 00:00:00")], "user_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = sessions.session_windows(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = [r for r in rows(sessions.session_windows(batch), "user", "n") if r[0] != 9]  # the last session is still open
    assert rows(spark.read.parquet(str(tmp_path / "out")), "user", "n") == want == [(1, 1), (1, 2), (2, 1)]
