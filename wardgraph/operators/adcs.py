"""Abuse of certificate services: edges that stand for a combination of a template, an authority that publishes it, and rights on both.

Each kind is a filter over (authority, template) pairs, joined with the highest principals that hold the rights it needs. Sources in tier 0 are left out.
Templates and authorities with equal rights on them have equal holders, so pairs are told apart by these sets of rights (``_classes``), not by their ids; and
members of groups who hold no right of their own are followed once for each set of groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise, shuffled
from .fixpoint import semi_naive

#: Rights that enrol, that control an object, and that manage an authority; uses of certificates.
ENROL = ["Enroll", "GenericAll"]
CONTROL = ["GenericAll", "GenericWrite", "WriteDacl", "WriteOwner", "Owns"]
CONTROL_TEMPLATE = [*CONTROL, "WritePKINameFlag", "WritePKIEnrollmentFlag"]
MANAGE = ["ManageCA", "ManageCertificates"]
AGENT_USE, ANY_USE = "1.3.6.1.4.1.311.20.2.1", "2.5.29.37.0"


def _alike(edges: DataFrame, rights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memberships (src, up) with one of all leaves alike, (leaf, id) for the others: whom each is alike). Leaves are members without members and
    without rights (id) of their own; those in the same groups hold the same."""
    members = edges.where("edge_type = 'MemberOf'").select("src", F.col("dst").alias("up")).distinct()
    inner = members.select(F.col("up").alias("src")).union(rights.select(F.col("id").alias("src"))).distinct()
    leaves = members.join(shuffled(inner), "src", "left_anti").groupBy("src").agg(F.array_sort(F.collect_set("up")).alias("groups"))
    leaves = materialise(leaves, "leaves")
    first = leaves.groupBy("groups").agg(F.min("src").alias("id"))
    others = materialise(leaves.join(first, "groups").where("src <> id").select(F.col("src").alias("leaf"), "id"), "alike")
    return materialise(members.join(shuffled(others.select(F.col("leaf").alias("src"))), "src", "left_anti"), "members"), others


def highest_holders(rights: DataFrame, edges: DataFrame, keys: list[str], needs: int = 2, alike: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(keys, id): for each key the highest principals that hold all ``needs`` rights (rights: keys, need, id), themselves or through groups above them.

    ``need`` numbers the rights, from 1; a principal below one that is found is left out. Groups that are members of each other, with no holder
    above, are all kept. ``alike``: of ``_alike`` for these rights and any others.
    """
    rights = materialise(rights.select(*keys, "need", "id").distinct(), "rights")
    members, others = alike or _alike(edges, rights)
    held = semi_naive(rights, lambda new: new.join(members, new["id"] == members["up"]).select(*keys, "need", F.col("src").alias("id")), [*keys, "need", "id"])
    full = materialise(held.groupBy(*keys, "id").agg(F.count_distinct("need").alias("n")).where(F.col("n") == needs).select(*keys, "id"), "holders")
    under = full.join(members, full["id"] == members["up"]).select(*keys, F.col("src").alias("id"))
    high = materialise(full.join(under, [*keys, "id"], "left_anti"), "highest")
    reached = semi_naive(high, lambda new: new.join(members, new["id"] == members["up"]).select(*keys, F.col("src").alias("id")), [*keys, "id"])
    found = materialise(high.union(full.join(reached.select(*keys, "id"), [*keys, "id"], "left_anti")), "highest-holders")
    return found.union(found.join(others, "id").select(*keys, F.col("leaf").alias("id")))


def _classes(edges: DataFrame, kinds: list[str], of: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """((id, ``name``): the class of each object (id) that has rights of these kinds on it, one for all with the same holders; (``name``, holder)).
    A class is named by one of its objects."""
    held = edges.where(F.col("edge_type").isin(kinds)).select(F.col("dst").alias("id"), "src").join(shuffled(of.select("id").distinct()), "id", "left_semi")
    sets = materialise(held.groupBy("id").agg(F.array_sort(F.collect_set("src")).alias("holders")), "holders-of")
    named = materialise(sets.groupBy("holders").agg(F.min("id").alias(name)), "classes")
    return materialise(sets.join(named, "holders").select("id", name), "class-of"), named.select(name, F.explode("holders").alias("id"))


def trusted(authorities: DataFrame, stores: DataFrame) -> DataFrame:
    """``authorities`` that logon trusts: those in a store, those of unknown thumbprint, and all where no store was collected."""
    known = stores.where("thumbprint is not null").select("thumbprint").distinct().withColumn("listed", F.lit(True))
    any_store = stores.agg((F.count("*") > 0).alias("have"))  # one row
    rows = authorities.join(known, "thumbprint", "left").crossJoin(any_store)
    return rows.where(~F.col("have") | F.coalesce("thumbprint", F.lit("")).isin("") | F.col("listed")).select(*authorities.columns)


def derive(nodes: DataFrame, edges: DataFrame, top: DataFrame, templates: DataFrame, authorities: DataFrame, published: DataFrame, stores: DataFrame, policies: DataFrame, controllers: DataFrame, relay: DataFrame) -> DataFrame:
    """(src, dst, edge_type) of all kinds. nodes: object_id, name, node_type; controllers: (id, binding, mapping) of domain controllers; relay: as
    ``relay_facts``; the others as in ``sources.pki``."""
    domains = nodes.where("node_type = 'Domain'").select(F.upper("name").alias("domain_name"), F.col("object_id").alias("domain"))
    ca = trusted(authorities, stores).join(domains, "domain_name").join(relay, "ca", "left").na.fill(False, ["relay_web", "relay_rpc"]).withColumnRenamed("no_extension", "bare").na.fill(False, ["bare"])
    logon = F.col("for_logon") & ~F.col("approval") & (F.col("signatures") == 0)
    agent = F.arrays_overlap("uses", F.array(F.lit(AGENT_USE), F.lit(ANY_USE))) & ~F.col("approval") & (F.col("signatures") == 0)
    takes = F.col("for_logon") & ~F.col("approval") & ~F.col("names_subject") & ((F.col("schema") == 1) | ((F.col("signatures") == 1) & F.array_contains("policies", AGENT_USE)))

    def classed(rows: DataFrame, of: str, kinds: list[str], name: str) -> tuple[DataFrame, DataFrame]:
        """``rows`` with the class of the column ``of``, null where nobody has such a right on it, and the holders of classes."""
        known, holders = _classes(edges, kinds, rows.select(F.col(of).alias("id")), name)
        return rows.join(known.withColumnRenamed("id", of), of, "left"), holders

    templates, enrol_template = classed(templates, "template", ENROL, "te")
    templates, control_template = classed(templates, "template", CONTROL_TEMPLATE, "tc")
    ca, enrol_ca = classed(ca, "ca", ENROL, "ce")
    # of pairs alike, one with the least and the greatest template
    flags = {
        "logon": logon, "one": logon & F.col("names_subject"), "fifteen": (F.col("schema") == 1) & F.col("names_subject") & ~F.col("approval") & (F.col("signatures") == 0),
        "six": logon & F.col("san_open"), "agent": F.col("agents_open") & agent, "takes": F.col("agents_open") & takes, "no_extension": F.col("no_extension"), "bare": F.col("bare"),
    }
    flags = [F.coalesce(c, F.lit(False)).alias(name) for name, c in flags.items()]
    pairs = ca.drop("names").join(published, "ca").join(templates, "template").select("ca", "domain", "ce", "te", "tc", "template", F.when(logon, F.col("issuance")).alias("issuance"), *flags)
    shared = [c for c in pairs.columns if c != "template"]
    pairs = materialise(pairs.groupBy(*shared).agg(F.min("template").alias("least"), F.max("template").alias("most")), "pairs")

    def holders(by: DataFrame, classes: DataFrame, of: str, need: int, keys: list[str]) -> DataFrame:
        """Rights (keys, need, id) of the class ``of`` of ``by``."""
        return by.join(classes.withColumnRenamed(classes.columns[0], of), of).select(*keys, F.lit(need).alias("need"), "id")

    alike = _alike(edges, enrol_template.select("id").union(control_template.select("id")).union(enrol_ca.select("id")))
    key, ruled = ["ce", "te"], ["ce", "tc"]
    both, control = pairs.select(*key).distinct(), pairs.select(*ruled).distinct()
    enrols = materialise(highest_holders(holders(both, enrol_template, "te", 1, key).union(holders(both, enrol_ca, "ce", 2, key)), edges, key, alike=alike), "enrols")
    controls = highest_holders(holders(control, control_template, "tc", 1, ruled).union(holders(control, enrol_ca, "ce", 2, ruled)), edges, ruled, alike=alike)

    def from_pairs(condition: str, kind: str, who: DataFrame = enrols, by: list[str] = key) -> DataFrame:
        return pairs.where(condition).select(*by, "domain").distinct().join(who, by).select(F.col("id").alias("src"), F.col("domain").alias("dst"), F.lit(kind).alias("edge_type"))

    found = [from_pairs("one", "ADCSESC1"), from_pairs("fifteen", "ADCSESC15"), from_pairs("six", "ADCSESC6"), from_pairs("true", "ADCSESC4", controls, ruled)]
    # a policy that stands for a group
    groups = policies.join(nodes.select(F.col("object_id").alias("group_id")), "group_id", "left_semi").select("oid", "group_id")
    issued = pairs.where("logon").select(*key, F.explode("issuance").alias("oid")).distinct().join(groups, "oid").select(*key, "group_id").distinct()
    found.append(issued.join(enrols, key).select(F.col("id").alias("src"), F.col("group_id").alias("dst"), F.lit("ADCSESC13").alias("edge_type")))
    # an enrolment agent's template beside another one that takes an agent's signature
    ends = [F.min("least").alias("least"), F.max("most").alias("most")]
    first = pairs.where("agent").groupBy("ca", "domain", "ce", F.col("te").alias("agent")).agg(*ends)
    second = pairs.where("takes").groupBy("ca", F.col("te").alias("target")).agg(*[F.min("least").alias("least2"), F.max("most").alias("most2")])
    chains = first.join(second, "ca").where("not (least = most and least2 = most2 and least = least2)").select("domain", "ce", "agent", "target").distinct()
    chains = materialise(chains, "agents")
    three = ["ce", "agent", "target"]
    asked = chains.select(*three).distinct()
    rights = holders(asked, enrol_template, "agent", 1, three).union(holders(asked, enrol_template, "target", 2, three)).union(holders(asked, enrol_ca, "ce", 3, three))
    found.append(chains.join(highest_holders(rights, edges, three, 3, alike), three).select(F.col("id").alias("src"), F.col("domain").alias("dst"), F.lit("ADCSESC3").alias("edge_type")))
    # managers of an authority that publishes anything
    managed = edges.where(F.col("edge_type").isin(MANAGE)).select("src", F.col("dst").alias("ca"))
    found.append(pairs.select("ca", "domain").distinct().join(managed, "ca").select("src", F.col("domain").alias("dst"), F.lit("ADCSESC7").alias("edge_type")))
    # whoever holds an authority's machine holds its key
    known = nodes.select(F.col("object_id").alias("host"))
    found.append(ca.join(known, "host", "left_semi").select(F.col("host").alias("src"), F.col("domain").alias("dst"), F.lit("GoldenCert").alias("edge_type")))
    # control of the objects that trust hangs from
    anchors = stores.select(F.col("store").alias("anchor"), "domain_name").union(authorities.select("ca", "domain_name")).distinct().join(domains, "domain_name")
    held = edges.where(F.col("edge_type").isin(CONTROL)).select("src", F.col("dst").alias("anchor"))
    found.append(anchors.join(held, "anchor").select("src", F.col("domain").alias("dst"), F.lit("ADCSESC5").alias("edge_type")))
    # a controller can be made to authenticate to the authority, if a controller may enrol for logon there
    may = below(edges, controllers.select("id"), enrols.join(pairs.where("logon").select(*key), key, "left_semi")).select(*key).distinct()
    may = may.join(pairs.where("logon").select("ca", *key).distinct(), key).select("ca").distinct()
    coerced = ca.where("relay_web or relay_rpc").join(may, "ca", "left_semi").select("domain", F.explode(F.array_compact(F.array(F.when(F.col("relay_web"), "ADCSESC8"), F.when(F.col("relay_rpc"), "ADCSESC11")))).alias("edge_type"))
    everyone = coerced.select(F.explode(F.array(F.concat("domain", F.lit("-513")), F.concat("domain", F.lit("-515")))).alias("src"), F.col("domain").alias("dst"), "edge_type")
    found.append(everyone.join(nodes.select(F.col("object_id").alias("src")), "src", "left_semi"))
    # weak binding: who can write to a user that may enrol
    weak = controllers.agg(F.coalesce(F.bool_or(F.col("binding") != 2), F.lit(False)).alias("unbound"), F.coalesce(F.bool_or((F.col("binding") == 0) | (F.col("mapping").bitwiseAND(4) != 0)), F.lit(False)).alias("mapped"))  # one row
    open_ = pairs.where("logon").crossJoin(F.broadcast(weak)).select("te", "domain", F.explode(F.array_compact(F.array(F.when(F.col("unbound") & F.col("no_extension"), "ADCSESC9"), F.when(F.col("unbound") & F.col("bare"), "ADCSESC16"), F.when(F.col("mapped"), "ADCSESC10")))).alias("edge_type")).distinct()
    users = nodes.where("node_type = 'User'").select(F.col("object_id").alias("dst"))
    writes = edges.where(F.col("edge_type").isin("GenericWrite", "GenericAll")).join(users, "dst", "left_semi").select("src", F.col("dst").alias("id")).distinct()
    open_ = materialise(open_, "open")
    may_enrol = enrol_template.join(open_.select("te").distinct(), "te", "left_semi").select("te", "id")
    victims = below(edges, writes.select("id").distinct(), may_enrol)
    found.append(writes.join(victims, "id").join(open_, "te").select("src", F.col("domain").alias("dst"), "edge_type"))
    return reduce(DataFrame.union, found).distinct().join(top.select(F.col("id").alias("src")), "src", "left_anti").select("src", "dst", "edge_type")


def below(edges: DataFrame, who: DataFrame, holders: DataFrame) -> DataFrame:
    """``holders`` (id and other columns) that ``who`` (id) are or are members of, with id the member's."""
    members = edges.where("edge_type = 'MemberOf'").select("src", F.col("dst").alias("above"))
    start = who.select(F.col("id").alias("origin"), "id")
    up = semi_naive(start, lambda new: new.join(members, new["id"] == members["src"]).select("origin", F.col("above").alias("id")), ["origin", "id"])
    rest = [c for c in holders.columns if c != "id"]
    return up.join(holders, "id").select(F.col("origin").alias("id"), *rest).distinct()
