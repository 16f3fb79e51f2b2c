"""Scalar expressions over names, dates and text."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import registry


def display_name(name: Column) -> Column:
    return F.split_part(name, F.lit("@"), F.lit(1))


def domain_of(dn: Column) -> Column:
    """``DC=corp,DC=local`` parts of a distinguished name as CORP.LOCAL."""
    return F.upper(F.array_join(F.regexp_extract_all(dn, F.lit(r"(?i)DC=([^,]+)"), 1), "."))


def ou_path(dn: Column) -> Column:
    """OU parts from the root down, joined by a slash; empty if there are none."""
    return F.array_join(F.reverse(F.regexp_extract_all(dn, F.lit(r"(?i)OU=([^,]+)"), 1)), "/")


def ttl_minutes(text: Column) -> Column:
    """Minutes of ``2h30m``, ``1d`` or ``1.02:00:00``; null for anything else."""
    t = F.lower(F.trim(text))
    part = lambda unit, n: F.coalesce(F.regexp_extract(t, rf"(\d+){unit}", 1).try_cast("int"), F.lit(0)) * n
    span = r"^(?:(\d+)\.)?(\d+):(\d+):(\d+)$"
    group = lambda k, n: F.coalesce(F.regexp_extract(t, span, k).try_cast("int"), F.lit(0)) * n
    return F.when(t.rlike(span), group(1, 1440) + group(2, 60) + group(3, 1)).when(t.rlike(r"^(?:\d+d)?(?:\d+h)?(?:\d+m)?$") & (t != ""), part("d", 1440) + part("h", 60) + part("m", 1))


def due_date(severity: Column, found: Column) -> Column:
    """Date by which a finding is to be fixed; null for info."""
    days = F.lit(None).cast("int")
    for name, n in registry.SLA_DAYS.items():
        days = F.when(severity == name, n).otherwise(days)
    return F.date_add(found, days)


def age_days(stamp: Column, clock: Column) -> Column:
    """Whole days from an epoch stamp to the collection's clock; null where the stamp is missing or not positive."""
    return F.when(stamp > 0, F.floor((clock - stamp) / 86400))


def is_service_account(name: Column, prefixes: list[str] | None = None) -> Column:
    upper = F.upper(display_name(name))
    found = F.lit(False)
    for p in registry.SERVICE_PREFIXES if prefixes is None else prefixes:
        found = found | upper.startswith(p)
    return found if prefixes else found | name.contains("$")


def glob_to_regex(pattern: Column) -> Column:
    """A case-insensitive glob (* and ?) as an anchored regular expression."""
    quoted = F.regexp_replace(pattern, r"([.\\+^$()\[\]{}|])", r"\\$1")
    return F.concat(F.lit("(?i)^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def pseudonym(value: Column, salt: str, kind: str) -> Column:
    """A stable name that can't be traced without the salt."""
    return F.concat(F.lit(f"{kind}-"), F.upper(F.substring(F.sha2(F.concat(F.lit(salt), F.upper(value)), 256), 1, 12)))


def is_tier0(object_id: Column, name: Column, node_type: Column) -> Column:
    """By name, id or type alone; membership and graph rules come on top."""
    endings = "|".join([*registry.TIER0_RIDS, *registry.TIER0_BUILTIN])
    return F.coalesce(
        F.upper(display_name(name)).isin(registry.TIER0_GROUPS)
        | object_id.isin(registry.TIER0_BUILTIN)
        | object_id.rlike(f"-(?:{endings})$")
        | F.lower(node_type).isin([t.lower() for t in registry.TIER0_TYPES])
        | ((node_type == "AZRole") & F.upper(object_id).isin(registry.TIER0_CLOUD_ROLES)),
        F.lit(False),
    )


def exposure_severity(actors: Column, hops: Column, all_disabled: Column) -> Column:
    """Severity (a rank) of newly exposed actors; if all are disabled it is one less, but not below medium."""
    base = F.when(actors == 0, 3).when((hops <= 2) | (actors >= 100), 5).when((hops <= 4) | (actors >= 10), 4).otherwise(3)
    return F.when(all_disabled, F.greatest(base - 1, F.lit(3))).otherwise(base)


#: Hosts that issue tokens of build services.
ISSUERS = {"token.actions.githubusercontent.com": "github", "vstoken.dev.azure.com": "azuredevops", "vstoken.visualstudio.com": "azuredevops", "gitlab.com": "gitlab"}


def federation_subject(issuer: Column, subject: Column) -> Column:
    """Struct of provider, repo and broad: whether a trust isn't pinned to a branch or an environment, so that many can meet it."""
    host = F.lower(F.regexp_replace(F.coalesce(issuer, F.lit("")), "^.*?//([^/]*).*$", "$1"))
    provider = F.when(host.contains("login.microsoftonline.com") | (host == ""), "entra").otherwise("other")
    for name, kind in ISSUERS.items():
        provider = F.when(host.contains(name), kind).otherwise(provider)
    text = F.coalesce(subject, F.lit(""))
    part = lambda pattern, group: F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
    repo = F.when(provider == "github", part(r"(?i)^repo:([^:]+/[^:]+)(?::.*)?$", 1)).when(provider == "gitlab", part("(?i)project_path:([^:]+)", 1))
    rest = F.lower(F.trim(F.coalesce(part(r"(?i)^repo:[^:]+/[^:]+:(.*)$", 1), F.lit(""))))
    pinned = rest.startswith("environment:") | rest.startswith("ref:")
    github = repo.isNotNull() & ~pinned & ((rest == "") | rest.startswith("pull_request") | rest.contains("*"))
    gitlab = text.contains("*") | ~F.lower(text).contains("ref_type:branch")
    broad = F.when(provider == "github", github).when(provider == "gitlab", gitlab).when(provider == "azuredevops", text.contains("*")).otherwise(True)
    return F.struct(provider.alias("provider"), repo.alias("repo"), broad.alias("broad"))


def uuid5(namespace: uuid.UUID, text: Column) -> Column:
    """The version 5 UUID of a text in a namespace: SHA-1 of both, with the bits of version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(text, "UTF-8")))
    part = lambda at, n: F.substring(h, at, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))
