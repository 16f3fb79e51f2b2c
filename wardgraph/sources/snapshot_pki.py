"""Certificate services in a directory snapshot, as objects of the form that ``sources.pki`` and ``sources.collections`` read.

Binary attributes are base64: ids are GUIDs whose first three fields are little-endian, periods are negative counts of 100 nanoseconds, certificates are named
by the SHA-1 of their bytes, and flags are bits of numbers. What a directory doesn't hold is left out, never made up: an authority's registry settings,
agents' restrictions, bindings of controllers. Objects without an id or a name are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .directory import SKIPPED, _descriptors, _one

#: Bits of the flags, and uses of certificates that let one log on (none at all does, too).
SUBJECT_BY_ENROLLEE, PENDING, NO_EXTENSION = 0x1, 0x2, 0x80000
LOGON_USES = ["1.3.6.1.5.5.7.3.2", "1.3.6.1.5.2.3.4", "1.3.6.1.4.1.311.20.2.2", "2.5.29.37.0"]


def binary(text: Column) -> Column:
    """The bytes of base64 text, null if it isn't any."""
    return F.try_to_binary(text, F.lit("base64"))


def guid(value: Column) -> Column:
    """An id as text in upper case: of its text form, or of base64 of its sixteen bytes."""
    data = binary(value)
    h = F.hex(data)
    turned = lambda *at: F.concat(*[F.substring(h, k, 2) for k in at])
    decoded = F.concat_ws("-", turned(7, 5, 3, 1), turned(11, 9), turned(15, 13), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return F.when(value.rlike("^[0-9a-fA-F-]{36}$"), F.upper(value)).when(F.octet_length(data) == 16, decoded)


def little_endian(data: Column) -> Column:
    """The signed 64-bit number of eight bytes, least first."""
    byte = lambda k: F.conv(F.hex(F.substring(data, k, 1)), 16, 10).cast("long")
    return F.when(F.octet_length(data) == 8, reduce(Column.bitwiseOR, [F.shiftleft(byte(k), 8 * (k - 1)) for k in range(1, 9)]))


def period_seconds(text: Column) -> Column:
    """Seconds of a period: a negative count of 100 nanoseconds as eight bytes in base64."""
    return F.floor(-little_endian(binary(text)) / 10_000_000)


def thumbprint(text: Column) -> Column:
    """The SHA-1 of a certificate in base64, in upper case."""
    return F.upper(F.sha1(binary(text)))


def _values(name: str) -> Column:
    at = f"$['{name}']"
    one = F.try_variant_get("o", at, "string")
    return F.coalesce(F.try_variant_get("o", at, "array<string>"), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))


def _number(name: str, other: int) -> Column:
    return F.coalesce(_one(name, "bigint"), F.lit(other))


def objects(rows: DataFrame, domain: str, names: DataFrame) -> DataFrame:
    """(file, kind, o) of the certificate objects among ``rows`` (o: a snapshot's objects): templates, authorities, stores, roots and issuance policies. domain:
    the domain's name; names: object_id, dn (upper case) and host (DNS name in upper case, or null) of the domain's objects."""
    classes = F.coalesce(F.try_variant_get("o", "$.objectClass", "array<string>"), F.array().cast("array<string>"))
    has = lambda c: F.array_contains(classes, c)
    dn = F.upper(F.coalesce(_one("distinguishedName"), F.lit("")))
    store = F.when(dn.contains("CN=NTAUTHCERTIFICATES"), "ntauthstores").when(dn.contains(",CN=AIA,"), "aiacas").otherwise("rootcas")
    kind = (
        F.when(has("pKICertificateTemplate"), "certtemplates")
        .when(has("pKIEnrollmentService"), "enterprisecas")
        .when(has("certificationAuthority"), store)
        .when(has("msPKI-Enterprise-Oid") & _one("msDS-OIDToGroupLink").isNotNull(), "issuancepolicies")
    )
    cn = F.trim(F.coalesce(_one("cn"), _one("name"), F.lit("")))
    found = rows.select("o", kind.alias("kind"), guid(_one("objectGUID")).alias("id"), cn.alias("cn")).where("kind is not null and id is not null and cn <> ''")
    held = _descriptors(found.select("id", _one("nTSecurityDescriptor").alias("data")).where("data is not null")).where(~F.col("trustee").isin(SKIPPED) & ~F.col("trustee").startswith("S-1-5-5-"))
    aces = held.groupBy("id").agg(F.collect_list(F.struct(F.col("trustee").alias("PrincipalSID"), F.col("right").alias("RightName"), F.col("inherited").alias("IsInherited"))).alias("aces"))
    found = found.join(aces, "id", "left").withColumn("aces", F.coalesce("aces", F.expr("cast(array() as array<struct<PrincipalSID: string, RightName: string, IsInherited: boolean>>)")))
    shared = [F.upper(F.concat(F.col("cn"), F.lit(f"@{domain}"))).alias("name"), F.lit(domain).alias("domain")]

    def shaped(some: DataFrame, properties: list[Column], *more: Column) -> DataFrame:
        whole = F.struct(F.col("id").alias("ObjectIdentifier"), F.struct(*shared, *properties).alias("Properties"), F.col("aces").alias("Aces"), *more)
        return some.select(F.lit("snapshot").alias("file"), "kind", F.to_variant_object(whole).alias("o"))

    uses = _values("pKIExtendedKeyUsage")
    bit = lambda name, mask: _number(name, 0).bitwiseAND(F.lit(mask).cast("long")) != 0
    templates = shaped(
        found.where("kind = 'certtemplates'"),
        [
            bit("msPKI-Certificate-Name-Flag", SUBJECT_BY_ENROLLEE).alias("enrolleesuppliessubject"),
            bit("msPKI-Enrollment-Flag", PENDING).alias("requiresmanagerapproval"),
            bit("msPKI-Enrollment-Flag", NO_EXTENSION).alias("nosecurityextension"),
            _number("msPKI-Template-Schema-Version", 1).alias("schemaversion"),
            _number("msPKI-RA-Signature", 0).alias("authorizedsignatures"),
            ((F.size(uses) == 0) | F.arrays_overlap(uses, F.array(*[F.lit(u) for u in LOGON_USES]))).alias("authenticationenabled"),
            uses.alias("ekus"),
            uses.alias("effectiveekus"),
            _values("msPKI-Certificate-Application-Policy").alias("applicationpolicies"),
            _values("msPKI-Certificate-Policy").alias("issuancepolicies"),
            period_seconds(_one("pKIExpirationPeriod")).alias("validityseconds"),
            period_seconds(_one("pKIOverlapPeriod")).alias("renewalseconds"),
        ],
    )
    # templates are published by name; a name has one id
    ids = found.where("kind = 'certtemplates'").groupBy(F.lower("cn").alias("t")).agg(F.max("id").alias("template"))
    authorities = found.where("kind = 'enterprisecas'")
    offered = authorities.select("id", F.explode(_values("certificateTemplates")).alias("t")).withColumn("t", F.lower("t")).join(ids, "t").groupBy("id").agg(F.collect_list(F.struct(F.col("template").alias("ObjectIdentifier"))).alias("offered"))
    host = F.coalesce(_one("dNSHostName"), _one("dnsHostName"))
    machines = names.where("host is not null").groupBy("host").agg(F.max("object_id").alias("machine"))
    authorities = authorities.withColumn("host", F.upper(host)).join(machines, "host", "left").join(offered, "id", "left")
    authorities = shaped(
        authorities,
        [F.col("cn").alias("caname"), host.alias("dnshostname"), thumbprint(_one("cACertificate")).alias("certthumbprint")],
        F.coalesce("offered", F.expr("cast(array() as array<struct<ObjectIdentifier: string>>)")).alias("EnabledCertTemplates"),
        F.col("machine").alias("HostingComputer"),
    )
    stores = shaped(found.where("kind in ('ntauthstores', 'aiacas', 'rootcas')"), [F.filter(F.transform(_values("cACertificate"), thumbprint), lambda t: t.isNotNull()).alias("certthumbprints")])
    groups = names.select(F.col("dn").alias("linked"), F.col("object_id").alias("group_id"))
    policies = found.where("kind = 'issuancepolicies'").withColumn("linked", F.upper(_one("msDS-OIDToGroupLink"))).join(groups, "linked", "left")
    policies = shaped(policies, [_one("msPKI-Cert-Template-OID").alias("oid")], F.struct(F.col("group_id").alias("ObjectIdentifier")).alias("GroupLink"))
    return templates.union(authorities).union(stores).union(policies)
