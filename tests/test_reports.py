"""Directory snapshots, scenarios and sinks."""

import base64
import json
import struct
import uuid

from wardgraph import reports
from wardgraph.operators import exposure, tiering, whatif
from wardgraph.operators import paths as P
from wardgraph.sources import directory

EDGES = "src string, dst string, edge_type string"
NODES = "object_id string, name string, node_type string, enabled boolean, admin_count boolean"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def sid(*parts):
    return struct.pack("<BB6s", 1, len(parts), (5).to_bytes(6, "big")) + b"".join(struct.pack("<I", p) for p in parts)


def entry(mask, who, kind=None, flags=0):
    body = struct.pack("<I", mask) + (struct.pack("<I", 1) + uuid.UUID(kind).bytes_le if kind else b"") + who
    return struct.pack("<BBH", 5 if kind else 0, flags, 4 + len(body)) + body


def described(owner, *entries):
    acl = b"".join(entries)
    acl = struct.pack("<BBHHH", 4, 0, 8 + len(acl), len(entries), 0) + acl
    return struct.pack("<BBHIIII", 1, 0, 0x8004, 20, 0, 0, 20 + len(owner)) + owner + acl


BOB, GROUP = sid(21, 1, 2, 3, 1105), sid(21, 1, 2, 3, 1106)


def test_descriptors():
    data = described(BOB, entry(0x10000000, GROUP, flags=0x10), entry(0x100, GROUP, "00299570-246d-11d0-a768-00aa006e0529"), entry(0x20, GROUP, directory.MEMBER), entry(0x40000, BOB), entry(0, BOB))
    name = "S-1-5-21-1-2-3-1106"
    assert directory.descriptor(data) == [("S-1-5-21-1-2-3-1105", "Owns", False), (name, "GenericAll", True), (name, "ForceChangePassword", False), (name, "AddMember", False), ("S-1-5-21-1-2-3-1105", "WriteDacl", False)]
    for cut in range(len(data)):  # cut short anywhere, it gives no more than the whole
        assert set(directory.descriptor(data[:cut])) <= set(directory.descriptor(data))


def test_directory_snapshot(spark, tmp_path):
    root = "DC=corp,DC=local"
    lines = [
        {"distinguishedName": root, "objectClass": ["top", "domainDNS"], "objectSid": "S-1-5-21-1-2-3", "nTSecurityDescriptor": base64.b64encode(described(GROUP, entry(0x100, BOB))).decode()},
        {"distinguishedName": [f"OU=Staff,{root}"], "objectClass": ["organizationalUnit"], "objectGUID": "aa-1", "name": "Staff"},
        {"distinguishedName": f"CN=Bob\\, B,OU=Staff,{root}", "objectClass": ["user"], "objectSid": ["S-1-5-21-1-2-3-1105"], "sAMAccountName": "bob", "userAccountControl": 0x400202, "primaryGroupID": 513},
        {"distinguishedName": f"CN=Help,OU=Staff,{root}", "objectClass": ["group"], "objectSid": "S-1-5-21-1-2-3-1106", "sAMAccountName": "help", "member": [f"CN=bob\\, b,ou=staff,{root}", "CN=gone"]},
        {"distinguishedName": f"CN=x,CN=Configuration,{root}", "objectClass": ["container"], "objectGUID": "bb-1"},
    ]
    (tmp_path / "a.ndjson").write_text("\n".join([json.dumps(x) for x in lines] + ["{broken", ""]))
    found = directory.objects(directory.scan(spark, str(tmp_path)))
    assert rows(found, "object_id", "node_type", "name", "enabled", "dontreqpreauth") == [
        ("AA-1", "OU", "STAFF", True, False),
        ("S-1-5-21-1-2-3", "Domain", "CORP.LOCAL", True, False),
        ("S-1-5-21-1-2-3-1105", "User", "BOB@CORP.LOCAL", False, True),
        ("S-1-5-21-1-2-3-1106", "Group", "HELP@CORP.LOCAL", True, False),
    ]
    d, b, g = "S-1-5-21-1-2-3", "S-1-5-21-1-2-3-1105", "S-1-5-21-1-2-3-1106"
    assert set(rows(directory.edges(found), "src", "dst", "edge_type")) == {(g, d, "Owns"), (b, d, "GenericAll"), (b, d, "DCSync"), (b, g, "MemberOf"), (b, f"{d}-513", "MemberOf"), (d, "AA-1", "Contains"), ("AA-1", b, "Contains"), ("AA-1", g, "Contains")}


def test_scenarios(spark):
    edges = spark.createDataFrame([("a", "b", "MemberOf"), ("b", "top", "GenericAll"), ("c", "a", "GenericAll"), ("d", "x", "GenericAll")], EDGES)
    top = spark.createDataFrame([("top",)], "id string")
    changes = spark.createDataFrame([(0, "remove", "b", "GenericAll", "top", None), (1, "add", "x", "MemberOf", "a", None), (2, "remove", "c", "GenericAll", "a", None)], whatif.CHANGES)
    assert rows(whatif.marginal(edges, top, changes), "idx", "new_exposure", "secured") == [(0, 0, 3), (1, 2, 0), (2, 0, 1)]
    tops = spark.createDataFrame([(0, "top"), (1, "top")], "scenario int, id string")
    none = spark.createDataFrame([], "scenario int, " + EDGES)
    found = whatif.scenario_exposure(edges, tops, none, none)
    want = rows(exposure.exposed(edges, top), "id", "hops")
    assert rows(found.where("scenario = 0"), "id", "hops") == rows(found.where("scenario = 1"), "id", "hops") == want


def test_sinks(spark, tmp_path):
    found = spark.createDataFrame([("b-rule", "low", 1, "X"), ("a-rule", "critical", 2, "A|1,B<2>"), ("c-rule", "info", 0, "")], "finding string, severity string, total long, names string")
    told = json.loads(reports.sarif(found))
    assert [r["ruleId"] for r in told["runs"][0]["results"]] == ["a-rule", "b-rule", "c-rule"] and told["runs"][0]["results"][0]["level"] == "error"
    assert "| critical | a-rule | 2 | A\\|1,B\\<2\\> |" in reports.markdown(found)
    reports.write_json_lines(found, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    for score in (5, 7):
        reports.append_history(spark.sql(f"SELECT {score} score, DATE'2026-01-01' collected"), str(tmp_path / "h"))
    reports.append_history(spark.sql("SELECT 9 score, DATE'2026-01-02' collected"), str(tmp_path / "h"))
    assert [s for s, _ in rows(reports.read_history(spark, str(tmp_path / "h")), "score", "collected")] == [7, 9]


def test_pseudonymous_copies_keep_exposure(spark):
    nodes = spark.createDataFrame([("S-1-5-21-1-2-3-512", "DOMAIN ADMINS@C", "Group", None, None), ("S-1-5-21-1-2-3-1200", "ALICE@C", "User", True, None), ("S-1-5-21-1-2-3-1201", "BOB@C", "User", True, None), ("S-1-5-21-1-2-3-1202", "SVC_X@C", "User", True, None)], NODES)
    edges = spark.createDataFrame([("S-1-5-21-1-2-3-1202", "S-1-5-21-1-2-3-512", "MemberOf"), ("S-1-5-21-1-2-3-1200", "S-1-5-21-1-2-3-1202", "GenericAll"), ("S-1-5-21-1-2-3-1201", "S-1-5-21-1-2-3-1200", "AddMember")], EDGES)
    copy, ends = reports.pseudonymous(nodes, edges, "salt")
    text = str(copy.collect()) + str(ends.collect())
    assert "ALICE" not in text and "1200" not in text and "SVC_" in text
    before = exposure.exposed(edges, tiering.tier0(nodes, edges))
    after = exposure.exposed(ends, tiering.tier0(copy, ends))
    assert sorted(r["hops"] for r in before.collect()) == sorted(r["hops"] for r in after.collect()) == [1, 2]


def test_watch_lists(spark):
    paths = spark.createDataFrame([("p", ["a", "b", "c"], ["GenericAll", "MemberOf"]), ("q", ["d", "b", "c"], ["GenericAll", "GenericAll"])], "path_id string, nodes array<string>, edge_types array<string>")
    assert P.steps(paths).count() == 4
    assert [(r["edge_type"], r["objects"]) for r in reports.watch_lists(paths).collect()] == [("GenericAll", ["b", "c"])]
