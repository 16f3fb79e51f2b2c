"""What is known of each kind of edge, as small dimension tables.

Unknown kinds are traversable, carry no attack step and weigh 100.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values. Name, category, walk (attack: an abuse step; structure: nesting; input: a fact that is never walked), exploitability,
#: technique, how hard the step is to detect, whether a fix is reversible, confidence, and its source.
EDGES = [
    ("GenericAll", "acl", "attack", 9, "T1222.001", "medium", True, "high", "collector:directory"),
    ("GenericWrite", "acl", "attack", 8, "T1222.001", "medium", True, "high", "collector:directory"),
    ("WriteOwner", "acl", "attack", 8, "T1222.001", "high", True, "high", "collector:directory"),
    ("WriteDacl", "acl", "attack", 8, "T1222.001", "medium", True, "high", "collector:directory"),
    ("ForceChangePassword", "acl", "attack", 7, "T1098", "low", True, "high", "collector:directory"),
    ("AddMember", "acl", "attack", 8, "T1098", "low", True, "high", "collector:directory"),
    ("Owns", "acl", "attack", 7, "T1222.001", "high", True, "high", "collector:directory"),
    ("WriteSPN", "acl", "attack", 7, "T1558.003", "medium", True, "high", "collector:directory"),
    ("AddAllowedToAct", "acl", "attack", 7, "T1134.001", "medium", True, "high", "collector:directory"),
    ("WriteKeyCredentialLink", "acl", "attack", 7, "T1556", "medium", True, "high", "collector:directory"),
    ("AllowedToDelegate", "delegation", "attack", 10, "T1558", "low", True, "high", "collector:directory"),
    ("AllowedToAct", "delegation", "attack", 7, "T1134.001", "medium", True, "high", "collector:directory"),
    ("MemberOf", "group", "structure", 0, "", "low", True, "high", "collector:directory"),
    ("AdminTo", "session", "attack", 8, "T1078", "low", True, "high", "collector:directory"),
    ("HasSession", "session", "attack", 6, "T1003", "low", True, "low", "collector:sessions"),
    ("CanRDP", "session", "attack", 5, "T1021.001", "low", True, "high", "collector:directory"),
    ("CanPSRemote", "session", "attack", 5, "T1021.006", "low", True, "high", "collector:directory"),
    ("ExecuteDCOM", "session", "attack", 5, "T1021.003", "medium", True, "high", "collector:directory"),
    ("SQLAdmin", "session", "attack", 7, "T1505", "medium", True, "high", "collector:directory"),
    ("DCSync", "domain", "attack", 10, "T1003.006", "low", True, "medium", "derived:replication-rights"),
    ("GPOControlsObject", "domain", "attack", 7, "T1484.001", "medium", True, "medium", "collector:gplink"),
    ("Contains", "domain", "structure", 0, "", "low", False, "high", "collector:directory"),
    ("ReadLAPSPassword", "domain", "attack", 7, "T1003", "low", True, "high", "collector:directory"),
    ("ReadGMSAPassword", "domain", "attack", 7, "T1003", "medium", True, "high", "collector:directory"),
    ("Enroll", "acl", "input", 7, "T1649", "medium", True, "high", "collector:directory"),
    ("AutoEnroll", "acl", "input", 6, "T1649", "high", True, "high", "collector:directory"),
    ("ManageCA", "acl", "input", 9, "T1649", "medium", True, "high", "collector:directory"),
    ("ManageCertificates", "acl", "input", 8, "T1649", "medium", True, "high", "collector:directory"),
    ("WritePKIEnrollmentFlag", "acl", "input", 8, "T1649", "medium", True, "high", "collector:directory"),
    ("WritePKINameFlag", "acl", "input", 8, "T1649", "medium", True, "high", "collector:directory"),
    ("TrustedBy", "domain", "attack", 5, "T1134.005", "medium", False, "high", "collector:directory"),
    ("HasSIDHistory", "special", "attack", 9, "T1134.005", "medium", False, "high", "collector:directory"),
    ("CoerceToTGT", "delegation", "attack", 8, "T1558", "medium", True, "low", "assumption:coercion"),
    ("WriteOwnerLimitedRights", "acl", "attack", 7, "T1222.001", "high", True, "high", "collector:directory"),
    ("OwnsLimitedRights", "acl", "attack", 7, "T1222.001", "high", True, "high", "collector:directory"),
    ("SpoofSIDHistory", "domain", "attack", 8, "T1134.005", "medium", False, "medium", "derived:trust"),
    ("AbuseTGTDelegation", "domain", "attack", 7, "T1558", "medium", True, "medium", "derived:trust"),
    ("CrossForestTrust", "domain", "input", 0, "", "medium", False, "high", "collector:directory"),
    ("WriteGPLink", "acl", "attack", 7, "T1484.001", "medium", True, "high", "collector:directory"),
    ("ADCSAbuse", "special", "attack", 9, "T1649", "medium", True, "high", "collector:directory"),
    ("ADCSESC1", "special", "attack", 9, "T1649", "medium", True, "medium", "derived:adcs"),
    ("ADCSESC4", "special", "attack", 9, "T1649", "medium", True, "medium", "derived:adcs"),
    ("ADCSESC6", "special", "attack", 9, "T1649", "medium", True, "medium", "derived:adcs"),
    ("ADCSESC7", "special", "attack", 9, "T1649", "medium", True, "medium", "derived:adcs"),
    ("ADCSESC3", "special", "attack", 9, "T1649", "medium", True, "medium", "derived:adcs"),
    ("ADCSESC5", "special", "attack", 9, "T1649", "medium", True, "medium", "derived:adcs"),
    ("GoldenCert", "special", "attack", 9, "T1649", "medium", True, "medium", "derived:adcs"),
    ("ADCSESC9", "special", "attack", 9, "T1649", "medium", True, "medium", "derived:adcs"),
    ("ADCSESC8", "special", "attack", 8, "T1649", "medium", True, "medium", "sidecar:adcsrelay"),
    ("ADCSESC11", "special", "attack", 8, "T1649", "medium", True, "medium", "sidecar:adcsrelay"),
    ("ADCSESC16", "special", "attack", 8, "T1649", "medium", True, "medium", "sidecar:adcsrelay"),
    ("CoerceAndRelayNTLMToSMB", "special", "attack", 7, "T1557.001", "medium", True, "low", "assumption:coercion"),
    ("CoerceAndRelayNTLMToLDAP", "special", "attack", 8, "T1557.001", "medium", True, "low", "assumption:coercion"),
    ("GPOUserRight", "special", "attack", 8, "T1078.003", "medium", True, "medium", "sidecar:gporights"),
    ("AZAuthenticatesTo", "special", "attack", 7, "T1550.001", "high", True, "medium", "derived:federation"),
    ("AZGetSecrets", "special", "input", 4, "T1555", "medium", True, "medium", "collector:keyvault"),
    ("AZGetKeys", "special", "input", 4, "T1555", "medium", True, "medium", "collector:keyvault"),
    ("AZGetCertificates", "special", "input", 4, "T1555", "medium", True, "medium", "collector:keyvault"),
    ("AZOwns", "special", "attack", 8, "T1098.001", "medium", True, "high", "collector:directory"),
    ("AZRunsAs", "special", "attack", 7, "T1078.004", "medium", True, "high", "collector:application"),
    ("AZEligibleRole", "special", "attack", 6, "T1078.004", "medium", True, "low", "assumption:pim-policy"),
    ("AZResetPassword", "special", "attack", 8, "T1098", "medium", True, "medium", "derived:entra-role"),
    ("AZAddSecret", "special", "attack", 8, "T1098.001", "medium", True, "medium", "derived:entra-role"),
    ("SyncedTo", "special", "attack", 8, "T1098", "medium", True, "medium", "derived:entra-sync"),
    ("ADCSESC15", "special", "attack", 8, "T1649", "medium", True, "low", "assumption:unpatched-ca"),
    ("AZOwner", "special", "attack", 9, "T1078.004", "medium", True, "high", "collector:directory"),
    ("AZContributor", "special", "attack", 8, "T1078.004", "medium", True, "high", "collector:directory"),
    ("AZUserAccessAdmin", "special", "attack", 9, "T1098", "medium", True, "high", "collector:directory"),
    ("AZVMAdminLogin", "special", "attack", 7, "T1021", "medium", True, "high", "collector:directory"),
    ("AZContains", "domain", "structure", 0, "", "medium", True, "high", "collector:directory"),
    ("AZManagedIdentity", "special", "attack", 8, "T1552.005", "medium", True, "high", "collector:directory"),
    ("AZMGGrantRole", "special", "attack", 10, "T1098.003", "medium", True, "high", "collector:graph-permission"),
    ("AZMGAddSecret", "special", "attack", 9, "T1098.001", "medium", True, "high", "collector:graph-permission"),
    ("OIDGroupLink", "group", "input", 0, "T1649", "medium", True, "high", "collector:directory"),
    ("ADCSESC13", "special", "attack", 8, "T1649", "medium", True, "medium", "derived:adcs"),
    ("GetChanges", "acl", "input", 0, "T1003.006", "medium", True, "high", "collector:directory"),
    ("GetChangesAll", "acl", "input", 0, "T1003.006", "medium", True, "high", "collector:directory"),
    ("GetChangesInFilteredSet", "acl", "input", 0, "T1003.006", "medium", True, "high", "collector:directory"),
    ("ADCSESC10", "special", "attack", 8, "T1649", "medium", True, "medium", "derived:adcs"),
    ("AZMGAddMember", "special", "attack", 8, "T1098", "medium", True, "high", "collector:graph-permission"),
    ("AZMGResetPassword", "special", "attack", 8, "T1098", "medium", True, "high", "collector:graph-permission"),
]

#: What names, id endings and ids make an object tier 0.
TIER0_GROUPS = [
    "DOMAIN ADMINS", "ENTERPRISE ADMINS", "ADMINISTRATORS", "DOMAIN CONTROLLERS", "SCHEMA ADMINS", "ACCOUNT OPERATORS", "BACKUP OPERATORS",
    "SERVER OPERATORS", "PRINT OPERATORS", "CERT PUBLISHERS", "KEY ADMINS", "ENTERPRISE KEY ADMINS", "ADMINSDHOLDER",
    "ENTERPRISE DOMAIN CONTROLLERS", "READ-ONLY DOMAIN CONTROLLERS", "ENTERPRISE READ-ONLY DOMAIN CONTROLLERS", "DNSADMINS",
    "CRYPTOGRAPHIC OPERATORS", "DISTRIBUTED COM USERS", "PERFORMANCE LOG USERS", "INCOMING FOREST TRUST BUILDERS",
]
TIER0_RIDS = ["500", "502", "512", "516", "518", "519", "521", "498", "517", "526", "527"]
TIER0_BUILTIN = ["S-1-5-32-544", "S-1-5-32-548", "S-1-5-32-549", "S-1-5-32-550", "S-1-5-32-551", "S-1-5-32-557", "S-1-5-32-559", "S-1-5-32-562", "S-1-5-32-569", "S-1-5-9"]
TIER0_TYPES = ["EnterpriseCA", "RootCA", "AIACA", "NTAuthStore", "Domain"]
TIER0_CLOUD_ROLES = ["62E90394-69F5-4237-9190-012177145E10", "E8611AB8-C189-46E8-94E1-60213AB1F814", "7BE44C8A-ADAF-4E2A-84D6-AB2649E08A13", "E00E864A-17C5-4A4B-9C06-F5B95A8D5BD8"]

#: Names of well-known ids, and of accounts by the ending of their id.
WELL_KNOWN_SIDS = {
    "S-1-1-0": "EVERYONE",
    "S-1-3-0": "CREATOR OWNER",
    "S-1-5-7": "ANONYMOUS LOGON",
    "S-1-5-9": "ENTERPRISE DOMAIN CONTROLLERS",
    "S-1-5-10": "SELF",
    "S-1-5-11": "AUTHENTICATED USERS",
    "S-1-5-18": "LOCAL SYSTEM",
    "S-1-5-32-544": "ADMINISTRATORS",
    "S-1-5-32-545": "USERS",
    "S-1-5-32-548": "ACCOUNT OPERATORS",
    "S-1-5-32-549": "SERVER OPERATORS",
    "S-1-5-32-550": "PRINT OPERATORS",
    "S-1-5-32-551": "BACKUP OPERATORS",
    "S-1-5-32-554": "PRE-WINDOWS 2000 COMPATIBLE ACCESS",
    "S-1-5-32-555": "REMOTE DESKTOP USERS",
    "S-1-5-32-560": "WINDOWS AUTHORIZATION ACCESS GROUP",
    "S-1-5-32-562": "DISTRIBUTED COM USERS",
    "S-1-5-32-580": "REMOTE MANAGEMENT USERS",
}
WELL_KNOWN_RIDS = {
    "498": "ENTERPRISE READ-ONLY DOMAIN CONTROLLERS",
    "500": "ADMINISTRATOR",
    "501": "GUEST",
    "502": "KRBTGT",
    "512": "DOMAIN ADMINS",
    "513": "DOMAIN USERS",
    "514": "DOMAIN GUESTS",
    "515": "DOMAIN COMPUTERS",
    "516": "DOMAIN CONTROLLERS",
    "517": "CERT PUBLISHERS",
    "518": "SCHEMA ADMINS",
    "519": "ENTERPRISE ADMINS",
    "520": "GROUP POLICY CREATOR OWNERS",
    "521": "READ-ONLY DOMAIN CONTROLLERS",
    "525": "PROTECTED USERS",
    "526": "KEY ADMINS",
    "527": "ENTERPRISE KEY ADMINS",
}

ATTACK = sorted(e[0] for e in EDGES if e[2] == "attack")
NON_TRAVERSABLE = sorted(e[0] for e in EDGES if e[2] == "input")
#: Nesting that can't be cut and shows nothing to observe; the second also costs an attacker nothing.
UNCUTTABLE = ["MemberOf", "Contains", "AZContains", "AZRunsAs"]
FREE = [*UNCUTTABLE, "OIDGroupLink"]
PLAIN_STRUCTURE = ["MemberOf", "Contains", "AZContains"]
ACTORS = ["User", "Computer", "AZUser", "AZServicePrincipal"]

#: Service accounts by the start of their name.
SERVICE_PREFIXES = ["SVC_", "SA_", "SVCACCOUNT", "SERVICE", "MSOL_", "AZUREADSSOACC", "ADCONNECT", "EXCHANGE", "EXCH_", "HEALTHMAILBOX", "SCCM", "CM_", "SMSWRITER", "KRBTGT"]
COVER_PREFIXES = ["SVC_", "SA_", "MSOL_", "EXCHANGE", "SCCM", "KRBTGT"]

#: Telemetry that shows a step. Edge, telemetry that is needed together, quality.
_ACL_CHANGE = [("ds-changes", "medium"), ("ds-access", "low"), ("mdi", "medium")]
OBSERVABLE = [
    *[(e, t, q) for e in ("GenericAll", "GenericWrite", "WriteDacl", "WriteOwner", "Owns") for t, q in _ACL_CHANGE],
    ("AddMember", "group-mgmt", "high"),
    ("AddMember", "mdi", "medium"),
    ("ForceChangePassword", "user-mgmt", "high"),
    ("WriteSPN", "ds-changes", "medium"),
    ("WriteSPN", "kerberos-service", "low"),
    ("AddAllowedToAct", "ds-changes", "medium"),
    ("WriteKeyCredentialLink", "ds-changes", "medium"),
    ("WriteKeyCredentialLink", "kerberos-service", "low"),
    ("AllowedToAct", "kerberos-service", "medium"),
    ("AllowedToDelegate", "kerberos-service", "medium"),
    ("DCSync", "ds-access", "high"),
    ("DCSync", "mdi", "high"),
    ("HasSession", "edr", "high"),
    ("HasSession", "sysmon", "medium"),
    ("AdminTo", "logon+special-logon", "medium"),
    ("AdminTo", "edr", "medium"),
    ("CanRDP", "logon", "medium"),
    ("CanPSRemote", "logon", "medium"),
    ("CanPSRemote", "process-creation", "medium"),
    ("ExecuteDCOM", "logon", "medium"),
    ("ExecuteDCOM", "process-creation", "medium"),
    ("SQLAdmin", "logon", "low"),
    ("GPOControlsObject", "ds-changes", "high"),
    ("GPOUserRight", "special-logon", "low"),
    ("ReadLAPSPassword", "ds-access", "low"),
    ("ReadGMSAPassword", "ds-access", "low"),
    ("HasSIDHistory", "user-mgmt", "medium"),
    ("GoldenCert", "edr", "low"),
    ("GoldenCert", "certification", "low"),
    ("SyncedTo", "entra-audit", "medium"),
    ("TrustedBy", "kerberos-service", "low"),
    *[(e, "entra-audit", "high") for e in ("AZAddSecret", "AZMGAddSecret", "AZResetPassword", "AZMGResetPassword", "AZMGGrantRole", "AZMGAddMember", "AZEligibleRole")],
    ("AZOwns", "entra-audit", "medium"),
    *[(e, "azure-activity", "high") for e in ("AZOwner", "AZContributor", "AZUserAccessAdmin")],
    ("AZVMAdminLogin", "azure-activity", "medium"),
    ("AZVMAdminLogin", "logon", "medium"),
    ("AZManagedIdentity", "entra-workload-signin", "medium"),
    ("AZAuthenticatesTo", "entra-workload-signin", "high"),
    *[(e, "keyvault-audit", "high") for e in ("AZGetSecrets", "AZGetKeys", "AZGetCertificates")],
    *[(e[0], "certification", "high") for e in EDGES if e[0].startswith("ADCSESC") or e[0] in ("Enroll", "ManageCA", "ManageCertificates")],
]
FALLBACK_TELEMETRY = ("ds-changes", "low")

SEVERITIES = ["info", "low", "medium", "high", "critical"]
CONFIDENCES = ["low", "medium", "high"]
COVERAGES = ["blind", "visible", "detected"]
#: Days to fix a finding, by severity; info has no date.
SLA_DAYS = {"critical": 0, "high": 7, "medium": 30, "low": 90}

EDGE_SCHEMA = "edge_type string, category string, walk string, exploitability int, technique string, detectability string, reversible boolean, confidence string, basis string"


def edge_dim(spark: SparkSession) -> DataFrame:
    """A row for each kind of edge, with its weight, an attacker's effort and noise, and the plane it lies on."""
    e = F.col("exploitability")
    kind = F.col("edge_type")
    free = kind.isin(FREE) | (e == 0)
    plane = (
        F.when(kind.isin("SyncedTo", "AZAuthenticatesTo"), "bridge")
        .when(kind.isin("AZOwner", "AZContributor", "AZUserAccessAdmin", "AZVMAdminLogin", "AZManagedIdentity"), "azure")
        .when(kind.startswith("AZMG"), "msgraph")
        .when(kind.startswith("AZ"), "entra")
        .otherwise("ad")
    )
    noise = F.when(F.col("detectability") == "low", 3).when(F.col("detectability") == "medium", 2).otherwise(1)
    return spark.createDataFrame(EDGES, EDGE_SCHEMA).select(
        "*",
        edge_weight(e).alias("weight"),
        F.when(free, 0).otherwise(11 - e).alias("effort"),
        F.when(free, 0).otherwise(noise).alias("noise"),
        F.col("basis").startswith("assumption:").alias("fragile"),
        plane.alias("plane"),
    )


def observable_dim(spark: SparkSession) -> DataFrame:
    """edge_type, needs (telemetry that must all be there) and quality (3 high, 2 medium, 1 low)."""
    rows = spark.createDataFrame(OBSERVABLE, "edge_type string, needs string, quality string")
    return rows.select("edge_type", F.split("needs", r"\+").alias("needs"), rank("quality", CONFIDENCES).alias("quality"))


def edge_weight(exploitability: Column) -> Column:
    return F.when(exploitability > 0, F.lit(10.0) / exploitability).otherwise(F.lit(100.0))


def rank(label: str, order: list[str]) -> Column:
    """Place of a label in its order, from 1."""
    return F.array_position(F.array(*[F.lit(x) for x in order]), F.col(label)).cast("int")


def label(place: Column, order: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in order]), place)
