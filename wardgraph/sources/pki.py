"""Certificate services in a collection: templates, authorities, what they publish, issuance policies, trusted thumbprints, relay facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OWN = ("$.ObjectIdentifier", "$.objectid", "$.id")


def _get(path: str, kind: str = "string"):
    return F.try_variant_get("o", path, kind)


def _own():
    return F.coalesce(*[_get(p) for p in _OWN])


def _yes(path: str):
    return F.coalesce(_get(path, "boolean"), F.lit(False))


def _texts(*paths: str):
    return F.coalesce(*[_get(p, "array<string>") for p in paths], F.array().cast("array<string>"))


def templates(objects: DataFrame) -> DataFrame:
    """template, names_subject, for_logon, approval, no_extension, schema, signatures, uses, policies, issuance; a missing flag is false."""
    p = "$.Properties"
    return objects.where("kind = 'certtemplates'").select(
        _own().alias("template"),
        _yes(f"{p}.enrolleesuppliessubject").alias("names_subject"),
        _yes(f"{p}.authenticationenabled").alias("for_logon"),
        _yes(f"{p}.requiresmanagerapproval").alias("approval"),
        _yes(f"{p}.nosecurityextension").alias("no_extension"),
        F.coalesce(_get(f"{p}.schemaversion", "int"), F.lit(1)).alias("schema"),
        F.coalesce(_get(f"{p}.authorizedsignatures", "int"), F.lit(0)).alias("signatures"),
        _texts(f"{p}.effectiveekus", f"{p}.ekus").alias("uses"),
        _texts(f"{p}.applicationpolicies").alias("policies"),
        _texts(f"{p}.issuancepolicies").alias("issuance"),
    )


def authorities(objects: DataFrame) -> DataFrame:
    """ca, domain_name, thumbprint, host, names (what relay facts may call it), san_open, agents_open; settings that weren't collected are closed."""
    registry = "$.CARegistryData"
    short = F.split_part(F.coalesce(_get("$.Properties.name"), F.lit("")), F.lit("@"), F.lit(1))
    return objects.where("kind = 'enterprisecas'").select(
        _own().alias("ca"),
        F.upper(_get("$.Properties.domain")).alias("domain_name"),
        F.upper(_get("$.Properties.certthumbprint")).alias("thumbprint"),
        _get("$.HostingComputer").alias("host"),
        F.transform(F.array_compact(F.array(_get("$.Properties.caname"), _get("$.Properties.dnshostname"), F.nullif(short, F.lit("")))), F.lower).alias("names"),
        (_yes(f"{registry}.IsUserSpecifiesSanEnabled.Value") & _yes(f"{registry}.IsUserSpecifiesSanEnabled.Collected")).alias("san_open"),
        (_yes(f"{registry}.EnrollmentAgentRestrictions.Collected") & (F.coalesce(F.size(_get(f"{registry}.EnrollmentAgentRestrictions.Restrictions", "array<variant>")), F.lit(0)) <= 0)).alias("agents_open"),
    )


def published(objects: DataFrame) -> DataFrame:
    """(ca, template)."""
    rows = objects.where("kind = 'enterprisecas'").select(_own().alias("ca"), F.explode(_get("$.EnabledCertTemplates", "array<variant>")).alias("m"))
    return rows.select("ca", F.try_variant_get("m", "$.ObjectIdentifier", "string").alias("template")).where("template is not null").distinct()


def stores(objects: DataFrame) -> DataFrame:
    """(store, domain_name, thumbprint): a row for each thumbprint that logon trusts, one with null for a store without any."""
    rows = objects.where("kind = 'ntauthstores'").select(_own().alias("store"), F.upper(_get("$.Properties.domain")).alias("domain_name"), F.explode_outer(_get("$.Properties.certthumbprints", "array<string>")).alias("thumbprint"))
    return rows.withColumn("thumbprint", F.upper("thumbprint"))


def issuance_policies(objects: DataFrame) -> DataFrame:
    """(policy, oid, group_id)."""
    rows = objects.where("kind = 'issuancepolicies'").select(_own().alias("policy"), _get("$.Properties.oid").alias("oid"), _get("$.GroupLink.ObjectIdentifier").alias("group_id"))
    return rows.where("group_id is not null")


def controllers(objects: DataFrame) -> DataFrame:
    """(id, binding, mapping): registry settings of computers, null where they weren't collected."""
    value = lambda name: F.when(_yes(f"$.DCRegistryData.{name}.Collected"), _get(f"$.DCRegistryData.{name}.Value", "int"))
    rows = objects.where("kind = 'computers'").select(_own().alias("id"), value("StrongCertificateBindingEnforcement").alias("binding"), value("CertificateMappingMethods").alias("mapping"))
    return rows.where("binding is not null or mapping is not null")


def relay_facts(objects: DataFrame, authorities: DataFrame) -> DataFrame:
    """(ca, relay_web, relay_rpc, no_extension) of relay sidecars, matched by the authority's name or host; false where not collected."""
    web = "$.WebEnrollment"
    http, https, guard = _yes(f"{web}.Http"), _yes(f"{web}.Https"), F.coalesce(_get(f"{web}.ExtendedProtection"), F.lit("Unknown"))
    there = _get(web, "variant").isNotNull() & F.coalesce(_get(f"{web}.Collected", "boolean"), F.lit(True))
    facts = objects.where("kind = 'adcsrelay'").select(
        F.explode(F.array_distinct(F.array_compact(F.array(F.lower(_get("$.CA")), F.lower(_get("$.Host")))))).alias("name"),
        (there & (http | (https & guard.isin("Off", "Allowed")))).alias("web"),
        F.coalesce(~_get("$.RpcEncryptionEnforced", "boolean"), F.lit(False)).alias("rpc"),
        F.coalesce(_get("$.SecurityExtensionDisabled", "boolean"), F.lit(False)).alias("bare"),
    )
    named = authorities.select("ca", F.explode("names").alias("name"))
    return named.join(facts, "name").groupBy("ca").agg(F.bool_or("web").alias("relay_web"), F.bool_or("rpc").alias("relay_rpc"), F.bool_or("bare").alias("no_extension"))
