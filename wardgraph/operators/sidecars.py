"""Edges from facts that lie beside a collection: hosts' sessions, repositories that act as applications, relayed logons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars

EDGE = ["src", "dst", "edge_type"]


def host_edges(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """EDGE of facts (fqdn, computer, other, edge_type) on hosts and objects that are known. A host is found by its DNS name, else by the part of
    its name before @; the name in fqdn counts before that in computer, and of equal names the smallest id. Sessions lead from the host."""
    dns = F.upper("dnshostname") if "dnshostname" in nodes.columns else F.lit(None).cast("string")
    short = F.upper(F.regexp_replace(scalars.display_name(F.col("name")), r"\$+$", ""))
    named = nodes.where("node_type = 'Computer'").select("object_id", F.posexplode(F.array(dns, short)).alias("stage", "key")).where("key <> ''")
    hosts = named.groupBy("key").agg(F.min(F.struct("stage", "object_id"))["object_id"].alias("host"))
    first, second = hosts.toDF("k1", "h1"), hosts.toDF("k2", "h2")
    rows = facts.join(nodes.select(F.col("object_id").alias("other")), "other", "left_semi")
    rows = rows.join(first, F.upper("fqdn") == F.col("k1"), "left").join(second, F.upper("computer") == F.col("k2"), "left").withColumn("host", F.coalesce("h1", "h2")).where("host is not null")
    out = F.col("edge_type") == "HasSession"
    return rows.select(F.when(out, F.col("host")).otherwise(F.col("other")).alias("src"), F.when(out, F.col("other")).otherwise(F.col("host")).alias("dst"), "edge_type").distinct()


def repository_edges(pushers: DataFrame, credentials: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """EDGE of repositories (pushers: provider, repo, principal) that a federated credential (credential, issuer, subject) trusts: each acts as
    the applications of its credentials, and those who push and are known are in it."""
    apps = edges.where("edge_type = 'AZAuthenticatesTo'").select(F.col("src").alias("credential"), F.col("dst").alias("app")).join(nodes.select(F.col("object_id").alias("app")), "app", "left_semi")
    trusted = credentials.select("credential", F.lower(scalars.federation_subject(F.col("issuer"), F.col("subject"))["repo"]).alias("key")).where("key is not null").join(apps, "credential").select("key", "app").distinct()
    rows = pushers.select(F.upper(F.concat_ws(":", F.lit("CICD"), "provider", "repo")).alias("source"), F.lower("repo").alias("key"), "principal")
    acts = rows.select("source", "key").distinct().join(trusted, "key").select(F.col("source").alias("src"), F.col("app").alias("dst"), F.lit("AZAuthenticatesTo").alias("edge_type"))
    inside = rows.join(trusted, "key", "left_semi").join(nodes.select(F.col("object_id").alias("principal")), "principal", "left_semi")
    return acts.union(inside.select("principal", "source", F.lit("MemberOf"))).distinct().join(edges, EDGE, "left_anti")


def relay_edges(nodes: DataFrame, edges: DataFrame, controllers: DataFrame) -> DataFrame:
    """EDGE from a domain's Authenticated Users to its hosts, but controllers (id), whose logons can be relayed: to SMB where signing is off, to LDAP
    where the web client runs and a controller of the domain doesn't sign. An assumption on what an attacker coerces, so no default derivation."""
    domain = F.upper(F.coalesce("domainsid", F.regexp_replace("object_id", "-[^-]*$", "")))
    users = nodes.select(F.col("object_id").alias("src"), F.regexp_extract(F.upper("object_id"), "^(.+)-S-1-5-11$", 1).alias("key")).where("key <> ''")
    domains = nodes.where("node_type = 'Domain' and domainsid <> ''").select(F.upper("domainsid").alias("domain"), F.posexplode(F.array(F.upper("object_id"), F.upper("domainsid"))).alias("stage", "key"))
    of_domain = domains.join(users, "key").groupBy("domain").agg(F.min(F.struct("stage", "src"))["src"].alias("src"))
    hosts = nodes.where("node_type = 'Computer'").select(F.col("object_id").alias("id"), domain.alias("domain"), "smbsigning", "webclientrunning", "ldapsigning")
    unsigned = hosts.join(controllers, "id", "left_semi").where("not ldapsigning").select("domain", F.lit(True).alias("unsigned")).distinct()
    rows = hosts.join(controllers, "id", "left_anti").join(of_domain, "domain").join(unsigned, "domain", "left")
    kinds = F.array_compact(F.array(F.when(~F.col("smbsigning"), "CoerceAndRelayNTLMToSMB"), F.when(F.col("webclientrunning") & F.col("unsigned"), "CoerceAndRelayNTLMToLDAP")))
    return rows.select("src", F.col("id").alias("dst"), F.explode(kinds).alias("edge_type")).join(edges, EDGE, "left_anti")
