"""Directory snapshots: text files of one JSON object a line, with binary security descriptors in base64.

Lines that aren't JSON are left out. Attributes come as values or lists of one. Names lead to ids by a join on the distinguished name; descriptors
are decoded in tasks, a row for each right they allow.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Object classes in order of precedence.
CLASSES = [
    ("computer", "Computer"), ("groupManagedServiceAccount", "User"), ("msDS-GroupManagedServiceAccount", "User"), ("user", "User"), ("inetOrgPerson", "User"), ("group", "Group"), ("domainDNS", "Domain"),
    ("organizationalUnit", "OU"), ("groupPolicyContainer", "GPO"), ("foreignSecurityPrincipal", "User"), ("container", "Container"), ("builtinDomain", "Container"), ("lostAndFound", "Container"),
]
#: Bits of an access mask.
ALL, WRITE, OWNER, DACL, FULL = 0x10000000, 0x40000000, 0x80000, 0x40000, 0x000F01FF
CONTROL, WRITE_PROPERTY, READ_PROPERTY, SELF = 0x100, 0x20, 0x10, 0x8
#: Extended rights, written properties and read properties by their id.
EXTENDED = {
    "00299570-246d-11d0-a768-00aa006e0529": "ForceChangePassword",
    "0e10c968-78fb-11d2-90d4-00c04f79dc55": "Enroll",
    "1131f6aa-9c07-11d1-f79f-00c04fc2dcd2": "GetChanges",
    "1131f6ad-9c07-11d1-f79f-00c04fc2dcd2": "GetChangesAll",
    "89e95b76-444d-4c62-991a-0facbeda640c": "GetChangesInFilteredSet",
    "a05b8cc2-17bc-4802-a710-e7c15ab866a2": "AutoEnroll",
}
WRITTEN = {
    "3f78c3e5-f79a-46bd-a0b8-9d18116ddc79": "AddAllowedToAct",
    "5b47d60f-6090-40b2-9f37-2a4de88f3063": "WriteKeyCredentialLink",
    "bf9679c0-0de6-11d0-a285-00aa003049e2": "AddMember",
    "d15ef7d8-f226-46db-ae79-b34e560bd12c": "WritePKIEnrollmentFlag",
    "ea1dddc4-60ff-416e-8cc0-17cee534bce7": "WritePKINameFlag",
    "f3a64788-5306-11d1-a9c5-0000f80367c1": "WriteSPN",
}
READ = {"e362ed86-b728-0842-b27d-2dea7a9df218": "ReadGMSAPassword"}
MEMBER = "bf9679c0-0de6-11d0-a285-00aa003049e2"
NO_TYPE = "00000000-0000-0000-0000-000000000000"
#: Trustees that are no principals.
SKIPPED = ["S-1-0-0", "S-1-3-0", "S-1-5-5", "S-1-5-7", "S-1-5-9", "S-1-5-10", "S-1-5-18"]


def sid_text(data: bytes, at: int) -> str:
    parts = [int.from_bytes(data[k : k + 4], "little") for k in range(at + 8, at + 8 + 4 * data[at + 1], 4)]
    return "-".join(["S", str(data[at]), str(int.from_bytes(data[at + 2 : at + 8], "big")), *map(str, parts)])


def rights_of(mask: int, kind: str | None, read: dict[str, str] = READ) -> list[str]:
    """Names of the rights that an access mask allows on an object, or on the property or right ``kind``."""
    if kind is None or kind == NO_TYPE:
        if mask & ALL or mask & FULL == FULL:
            return ["GenericAll"]
        return [name for bits, name in ((OWNER, "WriteOwner"), (DACL, "WriteDacl"), (WRITE | WRITE_PROPERTY, "GenericWrite"), (CONTROL, "AllExtendedRights")) if mask & bits]
    extended = EXTENDED.get(kind) or ("GenericAll" if mask & ALL else None)
    chosen = [extended if mask & CONTROL else None, WRITTEN.get(kind) if mask & WRITE_PROPERTY else None, read.get(kind) if mask & READ_PROPERTY else None, "AddMember" if mask & SELF and kind == MEMBER else None]
    return [x for x in chosen if x]


def descriptor(data: bytes, read: dict[str, str] = READ) -> list[tuple[str, str, bool]]:
    """(trustee, right, inherited) of a self-relative security descriptor; the owner has ``Owns``. What is cut short ends the list."""
    if len(data) < 20:
        return []
    owner, acl = int.from_bytes(data[4:8], "little"), int.from_bytes(data[16:20], "little")
    out = [(sid_text(data, owner), "Owns", False)] if owner and owner + 8 <= len(data) and owner + 8 + 4 * data[owner + 1] <= len(data) else []
    at = acl + 8
    for _ in range(int.from_bytes(data[acl + 4 : acl + 6], "little") if acl and at <= len(data) else 0):
        kind, flags, size = data[at : at + 1], data[at + 1 : at + 2], int.from_bytes(data[at + 2 : at + 4], "little")
        entry = data[at : at + size]
        if size < 8 or len(entry) < size:
            break
        place, of = 8, None
        if kind == b"\x05":
            there, place = entry[8], 12
            if there & 1:
                of, place = str(uuid.UUID(bytes_le=entry[12:28])) if len(entry) >= 28 else None, 28
            place += 16 * (there >> 1 & 1)
        if kind in (b"\x00", b"\x05") and len(entry) > place + 1 and len(entry) >= place + 8 + 4 * entry[place + 1]:
            out += [(sid_text(entry, place), right, bool(flags[0] & 0x10)) for right in rights_of(int.from_bytes(entry[4:8], "little"), of, read)]
        at += size
    return out


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(o): the objects of all ``.ndjson`` files below a path, as VARIANT."""
    lines = spark.read.option("pathGlobFilter", "*.ndjson").option("recursiveFileLookup", "true").text(path)
    return lines.select(F.try_parse_json("value").alias("o")).where("o is not null")


def _one(name: str, kind: str = "string") -> Column:
    """An attribute's value, or the first of its list."""
    at = f"$['{name}']"
    return F.coalesce(F.try_variant_get("o", f"{at}[0]", kind), F.try_variant_get("o", at, kind))


def objects(rows: DataFrame) -> DataFrame:
    """object_id, dn, node_type, name, enabled, admin_count and property columns of the domain's objects, with o."""
    classes = F.coalesce(F.try_variant_get("o", "$.objectClass", "array<string>"), F.array().cast("array<string>"))
    kind = reduce(lambda other, c: F.when(F.array_contains(classes, c[0]), c[1]).otherwise(other), reversed(CLASSES), F.lit(None).cast("string"))
    domain = rows.where(F.array_contains(classes, "domainDNS")).agg(F.min(F.upper(_one("distinguishedName"))).alias("root"), F.min_by(_one("objectSid"), F.upper(_one("distinguishedName"))).alias("domain_sid"))  # one row
    found = rows.select("o", F.upper(_one("distinguishedName")).alias("dn"), kind.alias("node_type")).where("dn is not null and node_type is not null").crossJoin(F.broadcast(domain))
    found = found.where(F.col("dn").endswith(F.coalesce("root", F.lit(""))) & ~F.concat(F.lit(","), F.col("dn")).rlike(",CN=(?:SCHEMA|CONFIGURATION),"))
    principal = F.col("node_type").isin("User", "Group", "Computer", "Domain")
    domain_name = F.array_join(F.regexp_extract_all(F.col("root"), F.lit("DC=([^,]+)"), 1), ".")
    name = F.upper(F.coalesce(_one("sAMAccountName"), _one("name"), _one("cn"), F.col("dn")))
    uac = F.coalesce(_one("userAccountControl", "int"), F.lit(0))
    bit = lambda mask: uac.bitwiseAND(mask) != 0
    return found.select(
        F.when(principal, F.coalesce(_one("objectSid"), F.upper(_one("objectGUID")))).otherwise(F.upper(_one("objectGUID"))).alias("object_id"),
        "dn",
        "node_type",
        F.when(F.col("node_type") == "Domain", domain_name).when(F.col("node_type").isin("User", "Group", "Computer") & ~name.contains("@"), F.concat_ws("@", name, F.nullif(domain_name, F.lit("")))).otherwise(name).alias("name"),
        (~bit(0x2)).alias("enabled"),
        (F.coalesce(_one("adminCount", "int"), F.lit(0)) != 0).alias("admin_count"),
        bit(0x80000).alias("unconstraineddelegation"),
        bit(0x400000).alias("dontreqpreauth"),
        (F.col("dn").contains("CN=DOMAIN CONTROLLERS") | bit(0x2000)).alias("isdc"),
        _one("servicePrincipalName").isNotNull().alias("hasspn"),
        _one("pwdLastSet", "double").alias("pwdlastset"),
        _one("lastLogonTimestamp", "double").alias("lastlogontimestamp"),
        _one("description").alias("description"),
        "domain_sid",
        "o",
    ).where("object_id is not null and object_id <> ''")


def _descriptors(rows: DataFrame) -> DataFrame:
    """(id, trustee, right, inherited) of (id, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, *x) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in descriptor(_decoded(text))]
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.bool_()), strict=True)], ["id", "trustee", "right", "inherited"])

    return rows.mapInArrow(run, "id string, trustee string, right string, inherited boolean")


def _decoded(text: str) -> bytes:
    try:
        return base64.b64decode(text)
    except ValueError:
        return b""


def edges(found: DataFrame) -> DataFrame:
    """(src, dst, edge_type): allowed rights, owners, managed passwords, members, primary groups and containment."""
    held = _descriptors(found.select(F.col("object_id").alias("id"), _one("nTSecurityDescriptor").alias("data")).where("data is not null"))
    managed = _descriptors(found.select(F.col("object_id").alias("id"), F.coalesce(_one("msDS-GroupMSAMembership"), _one("msds-groupmsamembership")).alias("data")).where("data is not null"))
    rights = held.select("trustee", "id", F.when(F.col("right") == "AllExtendedRights", "GenericAll").otherwise(F.col("right")).alias("edge_type"))
    rights = rights.union(managed.where("right <> 'Owns'").select("trustee", "id", F.lit("ReadGMSAPassword"))).where(~F.col("trustee").isin(SKIPPED) & ~F.col("trustee").startswith("S-1-5-5-"))
    rights = rights.union(held.join(found.where("node_type = 'Domain'").select(F.col("object_id").alias("id")), "id", "left_semi").where("right = 'AllExtendedRights'").select("trustee", "id", F.lit("DCSync")))
    names = found.select("dn", F.col("object_id").alias("there"))
    members = found.where("node_type = 'Group'").select("object_id", F.explode(F.coalesce(F.try_variant_get("o", "$.member", "array<string>"), F.array(F.try_variant_get("o", "$.member", "string")))).alias("m"))
    members = members.withColumn("dn", F.upper("m")).join(names, "dn").select("there", "object_id", F.lit("MemberOf"))
    primary = found.where("node_type in ('User', 'Computer')").select("object_id", F.concat_ws("-", "domain_sid", _one("primaryGroupID", "int")).alias("g"), _one("primaryGroupID", "int").alias("n")).where("n is not null and domain_sid is not null").select("object_id", "g", F.lit("MemberOf"))
    inside = found.select("object_id", F.regexp_extract("dn", r"^(?:\\.|[^,\\])*,(.*)$", 1).alias("dn")).join(names, "dn").select("there", "object_id", F.lit("Contains"))
    out = reduce(DataFrame.union, [rights, members, primary, inside]).toDF("src", "dst", "edge_type")
    return out.where("src <> dst").distinct()
