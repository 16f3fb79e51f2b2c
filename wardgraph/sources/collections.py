"""Collected JSON into nodes, edges and denies.

A collection is a folder of JSON files, or zip files of them: each file an object with ``data`` (a list of objects) and ``meta`` (type), or a bare list.
Files that can't be read as JSON are set aside with their path. Objects are read as VARIANT, so any fields may come; what rules use is
promoted to typed columns, and a missing flag stays null.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise

#: What rights are called as edges.
RIGHT_EDGES = {
    "GenericAll": "GenericAll",
    "GenericWrite": "GenericWrite",
    "WriteDacl": "WriteDacl",
    "WriteOwner": "WriteOwner",
    "Owns": "Owns",
    "Owner": "Owns",
    "AddMember": "AddMember",
    "AddSelf": "AddMember",
    "ForceChangePassword": "ForceChangePassword",
    "AllExtendedRights": "GenericAll",
    "AddAllowedToAct": "AddAllowedToAct",
    "AddKeyCredentialLink": "WriteKeyCredentialLink",
    "WriteSPN": "WriteSPN",
    "ReadLAPSPassword": "ReadLAPSPassword",
    "ReadGMSAPassword": "ReadGMSAPassword",
    "GetChanges": "GetChanges",
    "GetChangesAll": "GetChangesAll",
    "GetChangesInFilteredSet": "GetChangesInFilteredSet",
    "DCSync": "DCSync",
    "SQLAdmin": "SQLAdmin",
    "Enroll": "Enroll",
    "ManageCA": "ManageCA",
    "ManageCertificates": "ManageCertificates",
}
#: Lists of an object and the edges their members give. Field, kind, whether the member is the edge's source.
LISTS = [
    ("Members", "MemberOf", True),
    ("LocalAdmins", "AdminTo", True),
    ("RemoteDesktopUsers", "CanRDP", True),
    ("PSRemoteUsers", "CanPSRemote", True),
    ("DcomUsers", "ExecuteDCOM", True),
    ("AllowedToDelegate", "AllowedToDelegate", False),
    ("AllowedToAct", "AllowedToAct", True),
    ("ChildObjects", "Contains", False),
    ("HasSIDHistory", "HasSIDHistory", False),
    ("DumpSMSAPassword", "ReadGMSAPassword", False),
    ("Sessions", "HasSession", False),
    ("PrivilegedSessions", "HasSession", False),
    ("RegistrySessions", "HasSession", False),
]
#: Local groups by the ending of their id, and lists of rights that a policy hands to the computers it affects.
LOCAL_GROUPS = {"544": "AdminTo", "555": "CanRDP", "562": "ExecuteDCOM", "580": "CanPSRemote"}
POLICY_LISTS = {"LocalAdmins": "AdminTo", "RemoteDesktopUsers": "CanRDP", "DcomUsers": "ExecuteDCOM", "PSRemoteUsers": "CanPSRemote"}
FLAGS = ["hasspn", "dontreqpreauth", "passwordnotreqd", "pwdneverexpires", "sensitive", "unconstraineddelegation", "trustedtoauth", "haslaps", "isdc", "smbsigning", "ldapsigning", "webclientrunning"]
STAMPS = ["lastlogontimestamp", "lastlogon", "pwdlastset", "whencreated", "machineaccountquota"]
TEXTS = ["description", "operatingsystem", "functionallevel", "distinguishedname", "samaccountname", "domainsid", "dnshostname"]
#: The object type that a file's meta type stands for.
TYPES = {"users": "User", "computers": "Computer", "groups": "Group", "domains": "Domain", "gpos": "GPO", "ous": "OU", "containers": "Container", "certtemplates": "CertTemplate", "enterprisecas": "EnterpriseCA", "rootcas": "RootCA", "aiacas": "AIACA", "ntauthstores": "NTAuthStore", "issuancepolicies": "IssuancePolicy"}


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): JSON texts below a path; each entry of a zip file is a file."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if name.endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        entries = [(f"{name}!{x}", z.read(x)) for x in sorted(z.namelist()) if x.endswith(".json")]
                else:
                    entries = [(name, data)]
                for file, raw in entries:  # a file at a time
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([raw.decode("utf-8-sig", "replace")])], ["file", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{json,zip}").load(path).select("path", "content")
    return files.mapInArrow(unpack, "file string, text string")


def parse(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects, bad): objects are (file, kind, o) with o a VARIANT; bad are files (file) that aren't JSON."""
    read = files.withColumn("j", F.try_parse_json("text"))
    bad = read.where(F.col("j").isNull()).select("file")
    good = read.where(F.col("j").isNotNull()).select(
        "file",
        F.lower(F.coalesce(F.try_variant_get("j", "$.meta.type", "string"), F.regexp_extract(F.lower("file"), r"(users|computers|groups|domains|gpos|ous|containers|certtemplates|enterprisecas|sessions|denies)", 1))).alias("kind"),
        F.coalesce(F.try_variant_get("j", "$.data", "array<variant>"), F.try_variant_get("j", "$", "array<variant>")).alias("items"),
    )
    return good.select("file", "kind", F.explode("items").alias("o")), bad


def _text(*paths: str):
    return F.coalesce(*[F.try_variant_get("o", p, "string") for p in paths])


def nodes(objects: DataFrame) -> DataFrame:
    """object_id, name, node_type, enabled, admin_count, FLAGS, STAMPS and TEXTS of directory objects."""
    kinds = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    p = lambda name, kind: F.try_variant_get("o", f"$.Properties.{name}", kind)
    rows = objects.where(F.col("kind").isin(list(TYPES))).select(
        _text("$.ObjectIdentifier", "$.objectid", "$.id").alias("object_id"),
        F.coalesce(p("name", "string"), _text("$.Name", "$.name")).alias("name"),
        F.element_at(kinds, F.col("kind")).alias("node_type"),
        p("enabled", "boolean").alias("enabled"),
        p("admincount", "boolean").alias("admin_count"),
        *[p(f, "boolean").alias(f) for f in FLAGS],
        *[p(f, "double").alias(f) for f in STAMPS],
        *[p(f, "string").alias(f) for f in TEXTS],
    )
    return rows.where("object_id is not null")


def edges(objects: DataFrame) -> DataFrame:
    """(src, dst, edge_type) of access entries, member lists, primary groups and session files; entries onto the object itself are dropped.

    Objects are written once, parsed, so that each kind of entry scans a table and no file is read or parsed again."""
    objects = materialise(objects.select("kind", "o"), "objects")
    rights = F.create_map(*[F.lit(x) for pair in RIGHT_EDGES.items() for x in pair])
    own = _text("$.ObjectIdentifier", "$.objectid", "$.id").alias("id")
    rows = objects.where(F.col("kind").isin(list(TYPES)))
    entry = lambda path: F.explode(F.try_variant_get("o", path, "array<variant>")).alias("m")
    aces = rows.select(own, "kind", entry("$.Aces")).select("id", "kind", F.try_variant_get("m", "$.PrincipalSID", "string").alias("who"), F.try_variant_get("m", "$.RightName", "string").alias("right"))
    out = aces.where("who <> id").select(F.col("who").alias("src"), F.col("id").alias("dst"), F.coalesce(F.element_at(rights, F.col("right")), F.col("right")).alias("edge_type"))
    # all extended rights on a domain include replication
    out = out.union(aces.where("who <> id and kind = 'domains' and right = 'AllExtendedRights'").select("who", "id", F.lit("DCSync")))
    for field, kind, inward in LISTS:
        found = rows.select(own, F.explode(F.coalesce(F.try_variant_get("o", f"$.{field}", "array<variant>"), F.try_variant_get("o", f"$.{field}.Results", "array<variant>"))).alias("m"))
        found = found.select("id", F.coalesce(F.try_variant_get("m", "$.ObjectIdentifier", "string"), F.try_variant_get("m", "$.UserSID", "string"), F.try_variant_get("m", "$", "string")).alias("x")).where("x is not null and x <> id")
        out = out.union(found.select(F.col("x" if inward else "id"), F.col("id" if inward else "x"), F.lit(kind)))
    primary = rows.select(own, _text("$.PrimaryGroupSID").alias("x")).where("x is not null")
    out = out.union(primary.select("id", "x", F.lit("MemberOf")))
    member = F.coalesce(*[F.try_variant_get("m", p, "string") for p in ("$.ObjectIdentifier", "$.MemberId", "$.UserSID", "$.UserId", "$")])
    inside = rows.select(own, _text("$.ContainedBy.ObjectIdentifier").alias("x")).where("x is not null and x <> id")
    out = out.union(inside.select("x", "id", F.lit("Contains")))
    served = rows.select(own, F.explode(F.coalesce(F.try_variant_get("o", "$.SPNTargets", "array<variant>"), F.try_variant_get("o", "$.SpnTargets", "array<variant>"))).alias("m"))
    served = served.where(F.lower(F.try_variant_get("m", "$.Service", "string")) == "sqladmin")
    out = out.union(served.select("id", F.try_variant_get("m", "$.ComputerSID", "string"), F.lit("SQLAdmin")))
    local = rows.select(own, entry("$.LocalGroups")).select("id", F.element_at(F.split(F.try_variant_get("m", "$.ObjectIdentifier", "string"), "-"), -1).alias("rid"), F.explode(F.try_variant_get("m", "$.Results", "array<variant>")).alias("m"))
    local = local.select(member.alias("src"), F.col("id").alias("dst"), F.element_at(F.create_map(*[F.lit(x) for pair in LOCAL_GROUPS.items() for x in pair]), F.col("rid")).alias("edge_type"))
    out = out.union(local)
    pushed = rows.select(F.try_variant_get("o", "$.GPOChanges", "variant").alias("g")).where("g is not null")
    for field, kind in POLICY_LISTS.items():
        some = pushed.select("g", F.explode(F.try_variant_get("g", f"$.{field}", "array<variant>")).alias("m")).select("g", member.alias("who"))
        some = some.select("who", F.explode(F.try_variant_get("g", "$.AffectedComputers", "array<variant>")).alias("m")).select("who", member.alias("at"), F.lit(kind))
        out = out.union(some)
    first = lambda *keys: F.coalesce(*[F.try_variant_get("o", f"$.{k}", "string") for k in keys])
    out = out.union(objects.select(first("SourceSID", "source", "ID_start"), first("TargetSID", "target", "ID_end"), first("Kind", "kind", "label")))
    sessions = objects.where("kind = 'sessions'").select(_text("$.ComputerSID"), _text("$.UserSID"), F.lit("HasSession"))
    return out.union(sessions).where("src is not null and dst is not null and edge_type is not null").distinct()


def denies(objects: DataFrame) -> DataFrame:
    """(deny_id, principal, edge_type, target) of deny sidecars; rights are named as edges."""
    rights = F.create_map(*[F.lit(x) for pair in RIGHT_EDGES.items() for x in pair])
    rows = objects.where("kind = 'denies'").select(_text("$.PrincipalSID", "$.PrincipalSid").alias("principal"), _text("$.RightName").alias("right"), _text("$.ObjectSID", "$.ObjectIdentifier").alias("target"))
    rows = rows.select("principal", F.coalesce(F.element_at(rights, F.col("right")), F.col("right")).alias("edge_type"), "target").where("principal is not null and target is not null").distinct()
    return rows.withColumn("deny_id", F.xxhash64("principal", "edge_type", "target")).select("deny_id", "principal", "edge_type", "target")


def trusts(objects: DataFrame) -> DataFrame:
    """(src, dst, edge_type, sid_filtering): an outbound trust leads from the trusted domain's side, an inbound one to it, both ways for bidirectional ones."""
    rows = objects.where("kind = 'domains'").select(_text("$.ObjectIdentifier").alias("id"), F.explode(F.try_variant_get("o", "$.Trusts", "array<variant>")).alias("m"))
    rows = rows.select("id", F.try_variant_get("m", "$.TargetDomainSid", "string").alias("t"), F.lower(F.coalesce(F.try_variant_get("m", "$.TrustDirection", "string"), F.lit("outbound"))).alias("way"), F.try_variant_get("m", "$.SidFilteringEnabled", "boolean").alias("sid_filtering"))
    there = rows.where("way in ('outbound', 'bidirectional', '')").select(F.col("id").alias("src"), F.col("t").alias("dst"), F.lit("TrustedBy").alias("edge_type"), "sid_filtering")
    back = rows.where("way in ('inbound', 'bidirectional')").select("t", "id", F.lit("TrustedBy"), "sid_filtering")
    return there.union(back).where("src is not null and dst is not null")


def write_snapshot(path: str, nodes: DataFrame, edges: DataFrame, denies: DataFrame) -> None:
    """A snapshot is a folder with a Parquet table of each."""
    for name, df in (("nodes", nodes), ("edges", edges), ("denies", denies)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "denies"))
