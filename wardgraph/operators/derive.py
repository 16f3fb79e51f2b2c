"""Edges and facts that exist only as combinations of collected facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import registry
from ..storage import materialise, shuffled
from .fixpoint import closure, semi_naive


def both_rights(first: DataFrame, second: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): the highest principals that hold two rights (each: id), directly or through groups above them; members of one found are left out."""
    members = edges.where("edge_type = 'MemberOf'").select("src", "dst")
    holders = first.select("id", F.lit(1).alias("r")).union(second.select("id", F.lit(2).alias("r"))).distinct()
    # downwards from holders: whoever is below a holder of a right has it
    held = semi_naive(holders, lambda new: new.join(members, new["id"] == members["dst"]).select(F.col("src").alias("id"), "r"), ["id", "r"])
    both = held.groupBy("id").agg(F.count_distinct("r").alias("n")).where("n = 2").select("id")
    above = members.join(both, F.col("dst") == F.col("id"), "left_semi").select(F.col("src").alias("id"))
    return both.join(above, "id", "left_anti")


def name_uncollected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(object_id, name, node_type): groups that edges name but that weren't collected, by well-known ids and endings of ids."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("object_id")).where("object_id is not null").distinct().join(nodes.select("object_id"), "object_id", "left_anti")
    known = lambda pairs: F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    prefix, sid = F.upper(F.regexp_extract("object_id", r"^(.*)-S-1-\d", 1)), F.regexp_extract("object_id", r"(S-1-\d+(?:-\d+)*)$", 1)
    rid = F.when(sid.startswith("S-1-5-21-"), F.element_at(F.split(sid, "-"), -1))
    name = F.coalesce(F.element_at(known(registry.WELL_KNOWN_SIDS), sid), F.element_at(known(registry.WELL_KNOWN_RIDS), rid))
    rows = ends.select("object_id", name.alias("name"), prefix.alias("domain")).where("name is not null")
    return rows.select("object_id", F.when(F.col("domain") != "", F.concat_ws("@", "name", "domain")).otherwise(F.col("name")).alias("name"), F.lit("Group").alias("node_type"))


def dcsync(edges: DataFrame, top: DataFrame) -> DataFrame:
    """(src, dst, edge_type): DCSync of highest holders of both replication rights on a domain, but tier 0 and those who have it."""
    rights = edges.where(F.col("edge_type").isin("GetChanges", "GetChangesAll")).select("src", "dst", "edge_type").distinct()
    members = edges.where("edge_type = 'MemberOf'").select("src", F.col("dst").alias("up"))
    start = rights.select(F.col("src").alias("id"), F.col("dst").alias("domain"), F.col("edge_type").alias("r"))
    held = semi_naive(start, lambda new: new.join(members, new["id"] == members["up"]).select(F.col("src").alias("id"), "domain", "r"), ["id", "domain", "r"])
    both = held.groupBy("id", "domain").agg(F.count_distinct("r").alias("n")).where("n = 2").select("id", "domain")
    above = members.join(both, F.col("up") == F.col("id")).select(F.col("src").alias("id"), "domain")
    highest = both.join(above, ["id", "domain"], "left_anti").join(top, "id", "left_anti")
    out = highest.select(F.col("id").alias("src"), F.col("domain").alias("dst"), F.lit("DCSync").alias("edge_type"))
    return out.join(edges, ["src", "dst", "edge_type"], "left_anti")


def implicit_memberships(nodes: DataFrame) -> DataFrame:
    """(src, dst, edge_type): a domain's users and computers (-513, -515) are in its Everyone and Authenticated Users, and those in Everyone."""
    prefix = F.regexp_extract("object_id", r"^(S-1-5-21-[\d-]*\d)-51[35]$", 1)
    base = nodes.select("object_id", prefix.alias("d")).where("d <> ''")
    everyone, users = F.concat("d", F.lit("-S-1-1-0")), F.concat("d", F.lit("-S-1-5-11"))
    both = base.select(F.col("object_id").alias("src"), F.explode(F.array(everyone, users)).alias("dst"))
    return both.union(base.select(users, everyone)).distinct().withColumn("edge_type", F.lit("MemberOf"))


def domain_controllers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): computers that are directly in a domain-controllers group (by the end of its id or by name)."""
    groups = nodes.where(F.col("object_id").endswith("-516") | (F.upper(F.split_part("name", F.lit("@"), F.lit(1))) == "DOMAIN CONTROLLERS")).select(F.col("object_id").alias("dst"))
    inside = edges.where("edge_type = 'MemberOf'").join(groups, "dst", "left_semi").select(F.col("src").alias("id"))
    return inside.join(nodes.where("node_type = 'Computer'").select(F.col("object_id").alias("id")), "id", "left_semi").distinct()


def unconstrained_delegation(hosts: DataFrame, controllers: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, edge_type): AllowedToDelegate of each host (id) trusted for it to each domain controller (id); neither to itself nor again."""
    pairs = hosts.select(F.col("id").alias("src")).join(controllers.select(F.col("id").alias("dst")), F.expr("src <> dst"))
    return pairs.withColumn("edge_type", F.lit("AllowedToDelegate")).join(edges, ["src", "dst", "edge_type"], "left_anti")


def gpo_scope(links: DataFrame, contains: DataFrame, blocked: DataFrame) -> DataFrame:
    """(gpo, id): objects a policy applies to. links: gpo, container, enforced; contains: src, dst; blocked: id of containers that block
    inheritance, which stops a policy from above unless its link is enforced."""
    rows = contains.join(blocked.select(F.col("id").alias("dst"), F.lit(True).alias("stop")), "dst", "left").select("src", "dst", F.coalesce("stop", F.lit(False)).alias("stop"))
    start = links.select("gpo", F.col("container").alias("id"), "enforced")
    found = semi_naive(start, lambda new: new.join(rows, new["id"] == rows["src"]).where(F.col("enforced") | ~F.col("stop")).select("gpo", F.col("dst").alias("id"), "enforced"), ["gpo", "id", "enforced"])
    return found.select("gpo", "id").distinct()


def gpo_rights(grants: DataFrame, scope: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, edge_type): GPOUserRight of principals (grants: gpo, principal) on the computers their policy applies to."""
    hosts = nodes.where("node_type = 'Computer'").select(F.col("object_id").alias("id"))
    return grants.join(scope, "gpo").join(hosts, "id", "left_semi").select(F.col("principal").alias("src"), F.col("id").alias("dst"), F.lit("GPOUserRight").alias("edge_type")).where("src <> dst").distinct()


def _protected(edges: DataFrame, protected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((host, all, class) of hosts of which every administrator, with all recursive members, is protected (id); (admin, id) of those administrators' members).

    Members are found once for each administrator, not for each of its hosts. all: the host's administrators; class: their digest, equal for many hosts.
    """
    members = edges.where("edge_type = 'MemberOf'")
    admins = materialise(edges.where("edge_type = 'AdminTo'").select(F.col("dst").alias("host"), F.col("src").alias("admin")).distinct(), "admins")
    everyone = closure(admins.select(F.col("admin").alias("origin"), F.col("admin").alias("id")).distinct(), members, "dst", "src")
    principals = everyone.join(members.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")  # groups stand for their members
    flagged = principals.join(protected.select("id").distinct().withColumn("p", F.lit(True)), "id", "left").select(F.col("origin").alias("admin"), "id", F.coalesce("p", F.lit(False)).alias("p"))
    flagged = materialise(flagged, "flagged")
    whole = flagged.groupBy(F.col("admin").alias("a")).agg(F.min("p").alias("ok"))
    # an administrator without members of any kind says nothing of a host
    rated = admins.join(whole, F.col("admin").eqNullSafe(F.col("a"))).drop("a")
    hosts = rated.groupBy("host").agg(F.min("ok").alias("ok"), F.array_sort(F.collect_set("admin")).alias("all")).where("ok")
    hosts = materialise(hosts.select("host", "all", F.sha2(F.to_json("all"), 256).alias("class")), "protected-hosts")
    return hosts, flagged.select("admin", "id")


def fully_protected_hosts(edges: DataFrame, protected: DataFrame) -> DataFrame:
    """(id, admins): hosts of which every administrator, with all recursive members, is protected (id).

    Principals that are below the same administrators are counted as one group, and hosts with the same administrators as one class: classes meet groups, so
    no row is made for a host and a member of its administrators.
    """
    hosts, members = _protected(edges, protected)
    classes = hosts.groupBy("class").agg(F.first("all").alias("all")).select("class", F.explode("all").alias("admin"))
    wanted = members.join(classes.select("admin").distinct(), "admin", "left_semi")
    groups = wanted.groupBy("id").agg(F.array_sort(F.collect_set("admin")).alias("above")).groupBy("above").agg(F.count("*").alias("n"))
    groups = groups.select(F.explode("above").alias("admin"), F.sha2(F.to_json("above"), 256).alias("group"), "n")
    counted = classes.join(groups, "admin").groupBy("class", "group").agg(F.first("n").alias("n")).groupBy("class").agg(F.sum("n").alias("admins"))
    return hosts.join(counted, "class").select(F.col("host").alias("id"), "admins")


def without_protected_delegation(edges: DataFrame, protected: DataFrame, unconstrained: DataFrame) -> DataFrame:
    """``edges`` without delegation onto hosts whose administrators are all protected, unless the source (id) is unconstrained."""
    hosts = _protected(edges, protected)[0].select(F.col("host").alias("dst"), F.lit(True).alias("safe"))
    free = unconstrained.select(F.col("id").alias("src"), F.lit(True).alias("free"))
    rows = edges.join(hosts, "dst", "left").join(free, "src", "left")
    gone = F.col("edge_type").isin("AllowedToDelegate", "AllowedToAct") & F.col("safe").isNotNull() & F.col("free").isNull()
    return rows.where(~gone).select("src", "dst", "edge_type")


#: Products whose operators can reach any machine or credential, by family, and prefixes of directory-sync accounts.
SHADOW_PRODUCTS = {
    "deployment": "SCCM|MECM|CONFIGMGR|CONFIGURATION MANAGER|ENDPOINT MANAGER|ALTIRIS|BIGFIX|TANIUM|PDQ DEPLOY|LANDESK|IVANTI|MANAGEENGINE|DESKTOP CENTRAL|NINJAONE|ACTION1|KASEYA|CONNECTWISE",
    "backup": "VEEAM|COMMVAULT|NETBACKUP|RUBRIK|COHESITY|BACULA|BACKUP EXEC|ACRONIS|AZURE BACKUP|DPM|AVAMAR|NETWORKER|BACKUP ADMIN",
    "hypervisor": "VMWARE|VSPHERE|VCENTER|ESX|HYPER-?V|PROXMOX|NUTANIX|CITRIX HYPERVISOR|XENSERVER|RHEV|OVIRT",
    "endpoint-detection": "CROWDSTRIKE|SENTINELONE|CARBON BLACK|CYLANCE|DEFENDER FOR ENDPOINT|MDE|EDR ADMIN|CORTEX XDR|SOPHOS CENTRAL",
    "privileged-access": "CYBERARK|THYCOTIC|DELINEA|BEYONDTRUST|HASHICORP VAULT|SECRET SERVER|PASSWORD ?VAULT|PAM ADMIN|PRIVILEGED ACCESS",
    "identity-sync": "AAD ?CONNECT|AZURE AD CONNECT|ENTRA CONNECT|DIRSYNC|ADSYNC",
    "updates": "WSUS|UPDATE SERVICES",
}
SYNC_ACCOUNTS = "MSOL_|AAD_|SYNC_|ADSYNC|AZUREADSSOACC"
#: Rights on a domain object that are as good as the domain.
TAKEOVER = ["DCSync", "GenericAll", "WriteDacl", "Owns", "GenericWrite", "AllExtendedRights"]


def shadow_patterns() -> list[tuple[str, str]]:
    """(family, pattern) on display names; the first that fits counts. A product may be followed by more letters where its people are named by it (BACKUP ADMINS)."""
    return [(family, rf"(?i)\b(?:{words})" + ("" if family == "backup" else r"\b")) for family, words in SHADOW_PRODUCTS.items()]


def shadow_tier0(nodes: DataFrame, edges: DataFrame, controllers: DataFrame, names: list[tuple[str, str]] | None = None) -> DataFrame:
    """(id, reason): groups, users and computers (but domain controllers) that control a domain object, and groups and users whose name tells what they
    operate. names: (reason, pattern), an empty list for rights alone; directory-sync accounts are told by prefix unless names are given."""
    domains = nodes.where("node_type = 'Domain'").select(F.col("object_id").alias("dst"))
    kinds = nodes.where(F.col("node_type").isin("Group", "User", "Computer"))
    held = edges.where(F.col("edge_type").isin(TAKEOVER)).join(domains, "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    derived = held.join(shuffled(kinds.select(F.col("object_id").alias("id"))), "id", "left_semi").join(controllers, "id", "left_anti").select("id", F.lit("derived").alias("reason"))
    shown = F.col("shown")
    family = F.lit(None).cast("string")
    for name, pattern in reversed(shadow_patterns() if names is None else names):
        family = F.when(shown.rlike(pattern), name).otherwise(family)
    if names is None:
        account = F.element_at(F.split(shown, r"\\"), -1)
        family = F.when((F.col("node_type") == "User") & account.rlike(f"(?i)^(?:{SYNC_ACCOUNTS})"), "identity-sync").otherwise(family)
    # names are matched once each, in many tasks even where a small file holds all of them
    people = kinds.where("node_type <> 'Computer'").select("object_id", "node_type", F.split_part("name", F.lit("@"), F.lit(1)).alias("shown"))
    people = people.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "object_id")
    named = materialise(people.select(F.col("object_id").alias("id"), family.alias("reason")), "named").where("reason is not null")
    return derived.union(named.join(shuffled(derived.select("id")), "id", "left_anti"))


def merge_collections(edges: DataFrame) -> DataFrame:
    """(src, dst, edge_type, seen): the union of collections (collection_id), each edge once; seen counts the collections that hold it."""
    return edges.groupBy("src", "dst", "edge_type").agg(F.count_distinct("collection_id").alias("seen"))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each object_id: of its collections' rows the last known type, and the last value that isn't null of each other column."""
    rest = [c for c in nodes.columns if c not in ("object_id", "collection_id", "node_type")]
    typed = F.when(F.col("node_type") != "Unknown", F.col("node_type"))
    last = lambda value: F.max_by(value, F.when(value.isNotNull(), F.col("collection_id")))
    return nodes.groupBy("object_id").agg(F.coalesce(last(typed), F.lit("Unknown")).alias("node_type"), *[last(F.col(c)).alias(c) for c in rest])
