"""Files that lie beside a collection: sessions read on hosts, rights that policies assign, and who can push to repositories.

Each reader takes ``collections.scan``'s (file, text); files that aren't JSON or have other shapes give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .collections import POLICY_LISTS

#: Privileges that let their holder become the system on a host.
DANGEROUS_RIGHTS = ["SeBackupPrivilege", "SeRestorePrivilege", "SeTakeOwnershipPrivilege", "SeDebugPrivilege", "SeLoadDriverPrivilege", "SeTcbPrivilege", "SeCreateTokenPrivilege", "SeSyncAgentPrivilege"]


def _records(files: DataFrame, name: str) -> DataFrame:
    """(j, o): of files with ``name`` in theirs, the file and each record of its data, as VARIANT."""
    read = files.where(F.lower(F.element_at(F.split("file", "/"), -1)).contains(name)).select(F.try_parse_json("text").alias("j"))
    return read.select("j", F.explode(F.try_variant_get("j", "$.data", "array<variant>")).alias("o"))


def _at(column: str, path: str, kind: str = "string") -> F.Column:
    return F.try_variant_get(column, path, kind)


def host_facts(files: DataFrame) -> DataFrame:
    """(fqdn, computer, other, edge_type): local groups' members and sessions of hosts, one row each."""
    lists = POLICY_LISTS | {"Sessions": "HasSession"}
    each = [F.struct(F.lit(kind).alias("edge_type"), _at("o", f"$.{field}", "array<string>").alias("others")) for field, kind in lists.items()]
    rows = _records(files, "localsessions").select(_at("o", "$.FQDN").alias("fqdn"), _at("o", "$.Computer").alias("computer"), F.inline(F.array(*each)))
    return rows.select("fqdn", "computer", F.explode("others").alias("other"), "edge_type").where("other is not null and other <> ''")


def policy_grants(files: DataFrame) -> DataFrame:
    """(gpo, right, principal): dangerous privileges, ids in upper case, policies without braces."""
    rights = F.explode(_at("o", "$.Rights", "map<string, array<string>>")).alias("right", "who")
    rows = _records(files, "gporights").select(F.upper(F.translate(_at("o", "$.GPO"), "{}", "")).alias("gpo"), rights)
    rows = rows.where(F.col("right").isin(DANGEROUS_RIGHTS) & (F.col("gpo") != ""))
    return rows.select("gpo", "right", F.explode("who").alias("principal")).select("gpo", "right", F.upper("principal").alias("principal"))


def pushers(files: DataFrame) -> DataFrame:
    """(provider, repo, principal): who may push to a repository; principal is null for one without any."""
    rows = _records(files, "cicd").select(F.lower(F.coalesce(_at("j", "$.meta.provider"), F.lit("github"))).alias("provider"), F.trim(_at("o", "$.repo")).alias("repo"), F.explode_outer(_at("o", "$.principals", "array<variant>")).alias("p"))
    return rows.where("repo <> ''").select("provider", "repo", F.upper(_at("p", "$.id")).alias("principal"))
