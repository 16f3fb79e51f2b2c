"""Certificate services of a snapshot: the same certificate edges as those of a collection that says the same."""

import base64
import hashlib
import json
import struct
import uuid

from pyspark.sql import functions as F

from wardgraph.operators import adcs
from wardgraph.sources import collections, pki, snapshot_pki
from wardgraph.storage import materialise

from .test_cloud_and_pki import parsed, rows

G = {k: uuid.UUID(int=1000 + i) for i, k in enumerate(["t1", "t2", "t3", "ca", "nt", "root", "aia", "oid"])}
CERTS = {k: f"certificate {k}".encode() for k in ("ca", "other")}
b64 = lambda x: base64.b64encode(x).decode()
thumb = lambda k: hashlib.sha1(CERTS[k]).hexdigest().upper()
ENROLL = "0e10c968-78fb-11d2-90d4-00c04f79dc55"


def sid(text):
    parts = text.split("-")
    return bytes([1, len(parts) - 3]) + int(parts[2]).to_bytes(6, "big") + b"".join(struct.pack("<I", int(x)) for x in parts[3:])


def descriptor(owner, *entries):
    """A security descriptor: (trustee, mask, extended right or None) entries."""
    aces = b""
    for who, mask, right in entries:
        body = struct.pack("<I", mask) + (struct.pack("<I", 1) + uuid.UUID(right).bytes_le if right else b"") + sid(who)
        aces += struct.pack("<BBH", 5 if right else 0, 0, 4 + len(body)) + body
    acl = struct.pack("<BBHHH", 4, 0, 8 + len(aces), len(entries), 0) + aces
    head = 20
    return b64(struct.pack("<BBHIIII", 1, 0, 0x8004, head + len(acl), 0, 0, head) + acl + sid(owner))


STAFF, ADMIN, BOSS = "S-1-5-21-1-1103", "S-1-5-21-1-1104", "S-1-5-21-1-1105"
OPEN = descriptor(BOSS, (STAFF, 0x100, ENROLL))


def directory():
    """A snapshot's objects of the configuration partition, with ids as text and as bytes, lists of one and plain values."""
    base = ",CN=Public Key Services,CN=Services,CN=Configuration,DC=corp,DC=local"
    own = lambda k, cn, kind, where, **more: {"objectClass": ["top", kind], "cn": [cn], "objectGUID": [b64(G[k].bytes_le)], "distinguishedName": [f"CN={cn},CN={where}{base}"], "nTSecurityDescriptor": [OPEN], **more}
    year = b64(struct.pack("<q", -365 * 86400 * 10_000_000))
    return [
        own("t1", "Web", "pKICertificateTemplate", "Certificate Templates", **{"msPKI-Certificate-Name-Flag": ["1"], "msPKI-Enrollment-Flag": 0, "pKIExtendedKeyUsage": ["1.3.6.1.5.5.7.3.2"], "msPKI-Template-Schema-Version": ["2"], "pKIExpirationPeriod": [year], "pKIOverlapPeriod": "AAAA"}),
        own("t2", "Held", "pKICertificateTemplate", "Certificate Templates", **{"msPKI-Certificate-Name-Flag": 0x80000001, "msPKI-Enrollment-Flag": [2], "pKIExtendedKeyUsage": "2.5.29.37.0"}),
        own("t3", "Smart", "pKICertificateTemplate", "Certificate Templates", objectGUID=str(G["t3"]), **{"msPKI-Enrollment-Flag": ["524288"], "msPKI-Certificate-Policy": ["1.2.3"], "pKIExtendedKeyUsage": ["1.3.6.1.4.1.311.20.2.2"], "msPKI-RA-Signature": [0]}),
        own("ca", "CORP-CA", "pKIEnrollmentService", "Enrollment Services", dNSHostName=["ca01.corp.local"], cACertificate=[b64(CERTS["ca"])], certificateTemplates=["web", "Held", "SMART", "Missing"]),
        own("nt", "NTAuthCertificates", "certificationAuthority", "X", distinguishedName=[f"CN=NTAuthCertificates{base}"], cACertificate=[b64(CERTS["ca"]), b64(CERTS["other"]), "not base64!"], nTSecurityDescriptor=[descriptor(BOSS, (ADMIN, 0x40000, None))]),
        own("root", "CORP-CA", "certificationAuthority", "Certification Authorities", cACertificate=b64(CERTS["other"])),
        own("aia", "CORP-CA", "certificationAuthority", "AIA"),
        own("oid", "400.1", "msPKI-Enterprise-Oid", "OID", **{"msDS-OIDToGroupLink": ["CN=Linked,DC=corp,DC=local"], "msPKI-Cert-Template-OID": ["1.2.3"]}),
        {"objectClass": ["pKICertificateTemplate"], "cn": ["no id"]},
        {"objectClass": ["pKICertificateTemplate"], "objectGUID": ["AAAA"], "cn": ["short id"]},
        {"objectClass": ["msPKI-Enterprise-Oid"], "cn": ["x"], "objectGUID": [str(G["oid"])]},
    ]


def collection():
    """The same, as a collection has it."""
    name = lambda k: str(G[k]).upper()
    enrol = [{"PrincipalSID": BOSS, "RightName": "Owns"}, {"PrincipalSID": STAFF, "RightName": "Enroll"}]
    template = lambda k, cn, **p: {"ObjectIdentifier": name(k), "Properties": {"name": f"{cn}@CORP.LOCAL", "authenticationenabled": True, **p}, "Aces": enrol}
    return [
        {"meta": {"type": "certtemplates"}, "data": [template("t1", "WEB", enrolleesuppliessubject=True, schemaversion=2), template("t2", "HELD", enrolleesuppliessubject=True, requiresmanagerapproval=True), template("t3", "SMART", nosecurityextension=True, issuancepolicies=["1.2.3"])]},
        {"meta": {"type": "enterprisecas"}, "data": [{"ObjectIdentifier": name("ca"), "Properties": {"name": "CORP-CA@CORP.LOCAL", "domain": "CORP.LOCAL", "caname": "CORP-CA", "dnshostname": "ca01.corp.local", "certthumbprint": thumb("ca")}, "HostingComputer": "H", "EnabledCertTemplates": [{"ObjectIdentifier": name(t)} for t in ("t1", "t2", "t3")], "Aces": enrol}]},
        {"meta": {"type": "ntauthstores"}, "data": [{"ObjectIdentifier": name("nt"), "Properties": {"domain": "CORP.LOCAL", "certthumbprints": [thumb("ca"), thumb("other")]}, "Aces": [{"PrincipalSID": BOSS, "RightName": "Owns"}, {"PrincipalSID": ADMIN, "RightName": "WriteDacl"}]}]},
        {"meta": {"type": "issuancepolicies"}, "data": [{"ObjectIdentifier": name("oid"), "Properties": {"oid": "1.2.3"}, "GroupLink": {"ObjectIdentifier": "L"}, "Aces": enrol}]},
    ]


PEOPLE = [
    {"meta": {"type": "domains"}, "data": [{"ObjectIdentifier": "D", "Properties": {"name": "CORP.LOCAL"}}]},
    {"meta": {"type": "groups"}, "data": [{"ObjectIdentifier": STAFF, "Properties": {"name": "STAFF"}}, {"ObjectIdentifier": "L", "Properties": {"name": "LINKED"}}]},
    {"meta": {"type": "users"}, "data": [{"ObjectIdentifier": x, "Properties": {"name": x}} for x in (ADMIN, BOSS)]},
    {"meta": {"type": "computers"}, "data": [{"ObjectIdentifier": "H", "Properties": {"name": "CA01.CORP.LOCAL"}}]},
]


def snapshot(spark):
    lines = spark.createDataFrame([(json.dumps(o),) for o in directory()], "value string").select(F.parse_json("value").alias("o"))
    names = spark.createDataFrame([("H", "CN=CA01,DC=CORP,DC=LOCAL", "CA01.CORP.LOCAL"), ("L", "CN=LINKED,DC=CORP,DC=LOCAL", None)], "object_id string, dn string, host string")
    return snapshot_pki.objects(lines, "CORP.LOCAL", names)


def abuse(spark, objects):
    ca = pki.authorities(objects)
    top = spark.createDataFrame([("none",)], "id string")
    return set(rows(adcs.derive(collections.nodes(objects), collections.edges(objects), top, pki.templates(objects), ca, pki.published(objects), pki.stores(objects), pki.issuance_policies(objects), pki.controllers(objects), pki.relay_facts(objects, ca)), "src", "dst", "edge_type"))


def test_snapshot_gives_the_edges_of_the_collection(spark):
    people = parsed(spark, *PEOPLE)
    found = materialise(snapshot(spark), "snapshot")
    got = abuse(spark, people.select("kind", "o").union(found.select("kind", "o")))
    want = abuse(spark, parsed(spark, *PEOPLE, *collection()))
    assert got - {x for x in got if x[2] == "ADCSESC5"} == want - {x for x in want if x[2] == "ADCSESC5"}
    assert {"ADCSESC1", "ADCSESC13", "GoldenCert", "ADCSESC5"} <= {k for _, _, k in got}
    assert {x for x in want if x[2] == "ADCSESC5"} <= got


def test_binary_attributes(spark):
    found = snapshot(spark)
    assert sorted(r["kind"] for r in found.collect()) == ["aiacas", "certtemplates", "certtemplates", "certtemplates", "enterprisecas", "issuancepolicies", "ntauthstores", "rootcas"]
    seconds = found.where("kind = 'certtemplates'").select(F.try_variant_get("o", "$.Properties.name", "string"), F.try_variant_get("o", "$.Properties.validityseconds", "bigint"), F.try_variant_get("o", "$.Properties.renewalseconds", "bigint")).collect()
    assert {tuple(r) for r in seconds} == {("WEB@CORP.LOCAL", 365 * 86400, None), ("HELD@CORP.LOCAL", None, None), ("SMART@CORP.LOCAL", None, None)}
    texts = [(str(G["ca"]), str(G["ca"]).upper()), (b64(G["ca"].bytes_le), str(G["ca"]).upper()), ("AAAA", None), ("not base64!", None), (None, None), ("", None)]
    got = spark.createDataFrame([(t,) for t, _ in texts], "t string").select(snapshot_pki.guid(F.col("t")).alias("g")).collect()
    assert [r["g"] for r in got] == [g for _, g in texts]
    numbers = [0, 1, -1, 2**63 - 1, -(2**63), -365 * 86400 * 10**7]
    back = spark.createDataFrame([(b64(struct.pack("<q", n)), n) for n in numbers] + [("AAAA", None)], "t string, n long").select(snapshot_pki.little_endian(snapshot_pki.binary(F.col("t"))).alias("x"), "n").collect()
    assert all(r["x"] == r["n"] for r in back)
    empty = snapshot_pki.objects(spark.createDataFrame([("{}",)], "v string").select(F.parse_json("v").alias("o")).limit(0), "D", spark.createDataFrame([], "object_id string, dn string, host string"))
    assert empty.count() == 0
