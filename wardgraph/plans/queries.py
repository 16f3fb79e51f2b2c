"""The engine's queries over the driver's tables, by name. Each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import registry, scalars
from ..operators import audit, derive, exposure, fixpoint, maintained, paths, scoring, tiering, whatif
from ..sources import tpch_graph
from ..storage import materialise
from ..streaming import sessions

CONTEXT_CLOCK = 1700000000.0  # of a collection, in epoch seconds
TELEMETRY, RULES = ["logon", "special-logon", "user-mgmt"], ["ForceChangePassword"]


class Graph:
    """The identity graph of the order tables. A session builds a folder's graph once; its parts are written tables."""

    _built: dict[tuple[str, str], Graph] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.nodes = tpch_graph.nodes(spark, sf_dir)
        self.edges = materialise(tpch_graph.edges(spark, sf_dir), "edges")
        self.top = materialise(tiering.tier0(self.nodes, self.edges), "top")
        self.tiered = materialise(tiering.classify(self.nodes, self.edges, self.top), "tiered")

    @classmethod
    def of_folder(cls, spark: SparkSession, sf_dir: str) -> Graph:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._built:
            cls._built[key] = cls(spark, sf_dir)
        return cls._built[key]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def of(self, *types: str) -> DataFrame:
        return self.nodes.where(F.col("node_type").isin(list(types))).select(F.col("object_id").alias("id"))

    @cached_property
    def kept(self) -> maintained.Kept:
        """The states of exposure and their next steps, which later changes start from."""
        return maintained.keep(self.edges, self.top)

    @cached_property
    def paths(self) -> DataFrame:
        return materialise(paths.with_ids(paths.enumerate_paths(self.nodes, self.edges, self.top)), "all-paths")


QUERIES = {}


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Graph.of_folder(spark, sf_dir))
    return f


def plain(f):
    """A query over tables alone."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    return f


@query
def exposure_hops(g: Graph) -> DataFrame:
    return exposure.exposed(g.edges, g.top)


@query
def exposure_routes(g: Graph) -> DataFrame:
    return g.kept.base.where("depth > 0").select("id", "attacked", "depth", "next_id", "next_attacked", "edge_type")


@query
def exposure_exact(g: Graph) -> DataFrame:
    return exposure.exact(g.edges, g.top)


@query
def tier_classification(g: Graph) -> DataFrame:
    return g.tiered.select("object_id", "node_type", "tier")


@query
def summary_counts(g: Graph) -> DataFrame:
    return tiering.summary(g.tiered, g.edges)


@query
def group_members(g: Graph) -> DataFrame:
    return tiering.group_members(g.of("Group"), g.edges).where("group_id <> member_id")


@query
def group_ancestors(g: Graph) -> DataFrame:
    return tiering.group_ancestors(g.of("User"), g.edges).where("principal_id <> group_id")


@query
def effective_permissions(g: Graph) -> DataFrame:
    return tiering.effective_permissions(g.of("User"), g.edges)


@query
def blast_radius(g: Graph) -> DataFrame:
    return paths.blast_radius(g.of("Group", "OU"), g.edges).groupBy("origin").agg(F.count("*").alias("n"), F.max("depth").alias("farthest"))


@query
def reachable_tier0(g: Graph) -> DataFrame:
    return paths.blast_radius(g.of("Group", "OU"), g.edges, 20).join(g.top, "id", "left_semi").groupBy("origin").agg(F.count("*").alias("n"))


@query
def reverse_reach(g: Graph) -> DataFrame:
    return paths.reverse_reach(g.top, g.edges)


@query
def weighted_routes(g: Graph) -> DataFrame:
    starts = g.nodes.where("object_id = 'S-1-5-21-0-512'").select(F.col("object_id").alias("id"))
    return paths.cheapest_weights(starts, g.edges).select("id", F.round("cost", 4).alias("cost"))


def _joined(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"nodes": F.array_join("nodes", ">"), "edge_types": F.array_join("edge_types", ">")})


@query
def attack_paths(g: Graph) -> DataFrame:
    return _joined(g.paths).select("source", "target", "length", F.round("weight", 4).alias("weight"), "nodes", "edge_types")


@query
def path_stats(g: Graph) -> DataFrame:
    return paths.path_stats(g.paths)


@query
def posture_score(g: Graph) -> DataFrame:
    return scoring.posture(g.paths, g.tiered)


@query
def node_risk(g: Graph) -> DataFrame:
    return scoring.node_risk(g.paths, g.tiered, g.edges, exact=100)


@query
def choke_points(g: Graph) -> DataFrame:
    return scoring.choke_points(g.paths, g.nodes, 5)


@query
def node_chokepoints(g: Graph) -> DataFrame:
    return scoring.node_chokepoints(g.paths)


@query
def path_costs(g: Graph) -> DataFrame:
    return paths.path_costs(g.paths).select("path_id", "effort", "noise", "steps")


@query
def cheapest_routes(g: Graph) -> DataFrame:
    found = g.paths
    return paths.best_per_target(found, paths.path_costs(found))


@query
def path_confidence(g: Graph) -> DataFrame:
    return paths.path_confidence(g.paths, g.edges)


@query
def coverage_status(g: Graph) -> DataFrame:
    found = g.paths
    return paths.path_coverage(found, paths.coverage(found, TELEMETRY, RULES))


@query
def coverage_by_edge(g: Graph) -> DataFrame:
    return paths.coverage(g.paths, TELEMETRY, RULES).groupBy("edge_type", "status").agg(F.count("*").alias("n"))


@query
def enable_telemetry(g: Graph) -> DataFrame:
    found = g.paths
    return paths.enable_next(found, TELEMETRY, paths.coverage(found, TELEMETRY, RULES))


@query
def blind_spots(g: Graph) -> DataFrame:
    found = g.paths
    return scoring.blind_spots(found, paths.path_coverage(found, paths.coverage(found, TELEMETRY, RULES)), scoring.choke_points(found, g.nodes, 3))


@query
def attack_chains(g: Graph) -> DataFrame:
    return paths.chains(g.paths, g.nodes, g.edges).groupBy("chain").agg(F.count("*").alias("n"))


@query
def both_rights(g: Graph) -> DataFrame:
    first = g.edges.where("edge_type = 'AdminTo'").select(F.col("src").alias("id"))
    second = g.edges.where("edge_type in ('GenericWrite', 'WriteDacl', 'ForceChangePassword')").select(F.col("src").alias("id"))
    return derive.both_rights(first, second, g.edges)


@query
def deny_exposure(g: Graph) -> DataFrame:
    """One group is denied to administer every third host."""
    hosts = g.nodes.where("node_type = 'Computer'").where(F.substring("object_id", 2, 20).cast("int") % 3 == 0)
    denies = hosts.select(F.lit(1).alias("deny_id"), F.lit("N1").alias("principal"), F.lit("AdminTo").alias("edge_type"), F.col("object_id").alias("target"))
    return exposure.exposed_with_denies(g.edges, g.top, denies)


@query
def gpo_scope(g: Graph) -> DataFrame:
    links = g.of("OU").select(F.concat(F.lit("G"), "id").alias("gpo"), F.col("id").alias("container"), F.col("id").isin("R0", "R2").alias("enforced"))
    blocked = g.of("Group").where(F.col("id").isin("N3", "N6", "N9", "N12"))
    return derive.gpo_scope(links, g.edges.where("edge_type in ('Contains', 'AdminTo')"), blocked)


@query
def protected_hosts(g: Graph) -> DataFrame:
    protected = g.table("customer").where("c_nationkey < 12").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"))
    return derive.fully_protected_hosts(g.edges, protected)


@plain
def session_merge(table) -> DataFrame:
    rows = table("events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("src"), F.col("event_type").alias("dst"), F.lit("HasSession").alias("edge_type"), F.to_date("ts").alias("collection_id"))
    return derive.merge_collections(rows)


@query
def whatif_impact(g: Graph) -> DataFrame:
    """Every fifth host loses its administrators, and two units gain a right over an administrator group and over a user."""
    gone = g.edges.where("edge_type = 'AdminTo'").where(F.substring("dst", 2, 20).try_cast("int") % 5 == 0)
    removed = gone.select(F.lit(0).alias("idx"), F.lit("remove").alias("op"), "src", "edge_type", "dst", F.lit(None).cast("int").alias("ttl_minutes"))
    added = whatif.parse_changes("grant R1 GenericAll S-1-5-21-0-512\ngrant R2 GenericAll C1")
    added = whatif.resolve_changes(g.spark.createDataFrame(added, whatif.CHANGES), g.nodes).select(*removed.columns)
    return whatif.forecast(g.nodes, g.edges, g.kept, g.top, materialise(removed.union(added), "changes")).impact.exposure


@query
def leaf_clusters(g: Graph) -> DataFrame:
    return scoring.leaf_clusters(g.tiered, g.edges)


@query
def degree_top(g: Graph) -> DataFrame:
    ends = g.edges.select(F.explode(F.array("src", "dst")).alias("object_id"))
    return ends.groupBy("object_id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "object_id").limit(25)


@query
def membership_chain(g: Graph) -> DataFrame:
    groups = g.nodes.where("object_id like '%-512'").select(F.col("object_id").alias("id"))
    return paths.membership_chain(g.of("User"), g.edges, groups)


@query
def breach_routes(g: Graph) -> DataFrame:
    starts = g.nodes.where(F.col("object_id").isin("C1", "C2", "C3", "S1", "S2", "N1", "N2", "N5")).select(F.col("object_id").alias("id"))
    return _joined(paths.breach_routes(starts, g.nodes, g.edges, g.top)).select("source", "target", "length", "nodes", "edge_types")


@query
def crown_jewels(g: Graph) -> DataFrame:
    key = F.substring("id", 2, 20).cast("int")
    return scoring.crown_jewels(g.of("Computer").where(key % 5 == 0).withColumn("value", key % 7), g.tiered, g.edges, 20)


@query
def fix_safety(g: Graph) -> DataFrame:
    return scoring.fix_safety(scoring.choke_points(g.paths, g.nodes, 5), g.tiered).select("src", "dst", "edge_type", "safety")


def _context(g: Graph) -> audit.Context:
    """Customers with properties made from their keys."""
    c = F.col("c_custkey")
    flags = g.table("customer").select(
        F.concat(F.lit("C"), c.cast("string")).alias("object_id"),
        (F.col("c_mktsegment") == "BUILDING").alias("hasspn"),
        F.when(c % 11 != 0, c % 7 == 0).alias("dontreqpreauth"),
        (c % 13 == 0).alias("passwordnotreqd"),
        (c % 3 == 0).alias("pwdneverexpires"),
        (F.lit(CONTEXT_CLOCK) - (c % 200) * 86400).alias("lastlogontimestamp"),
    )
    return audit.Context(g.tiered.join(flags, "object_id"), g.edges, CONTEXT_CLOCK)


AUDITED = ["kerberoast-privileged", "kerberoast", "asrep-privileged", "asrep", "passwd-notreqd", "priv-pwd-never-expires", "stale-privileged", "admincount-orphan", "svc-privileged", "guest-enabled"]


@query
def audit_findings(g: Graph) -> DataFrame:
    return audit.findings(audit.found(_context(g), AUDITED))


@query
def audit_rows(g: Graph) -> DataFrame:
    return audit.found(_context(g), AUDITED).select("finding", "severity", "object_id")


@query
def compliance_rollup(g: Graph) -> DataFrame:
    return audit.compliance(audit.found(_context(g), AUDITED))


@query
def tier0_sessions(g: Graph) -> DataFrame:
    return audit.found(audit.Context(g.tiered, g.edges), ["tier0-exposed-on-lower-tier"]).select("object_id")


@query
def doctor(g: Graph) -> DataFrame:
    return audit.doctor(g.nodes, g.edges)


@plain
def trend_delta(table) -> DataFrame:
    days = table("events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("value"))
    return sessions.history_delta(days, "day")


@plain
def session_windows(table) -> DataFrame:
    found = sessions.session_windows(table("events"))
    return found.select("user", "n", (F.unix_seconds(F.col("end").cast("timestamp")) - F.unix_seconds(F.col("start").cast("timestamp")) - 1800).alias("seconds"))


@plain
def property_ingest(table) -> DataFrame:
    read = table("events").withColumn("p", F.try_parse_json("props"))
    return read.groupBy("event_type", F.try_variant_get("p", "$.k", "bigint").alias("k")).agg(F.count("*").alias("n"))


@plain
def description_secrets(table) -> DataFrame:
    """Customers whose descriptions, made from their keys, hold a password; some only speak of one."""
    k = F.col("c_custkey")
    text = F.when(k % 9 == 0, F.concat(F.lit("Kennwort = "), "c_name")).when(k % 9 == 1, F.concat(F.lit("old pwd:"), "c_name")).when(k % 9 == 2, F.lit("passwordless: yes")).otherwise(F.lit("change the password soon"))
    return table("customer").where(text.rlike(r"(?i)\b(pass(word|wd)?|pwd|kennwort)\b\s*[:=]")).select("c_custkey")


@query
def ou_breakdown(g: Graph) -> DataFrame:
    rows = g.edges.where("edge_type = 'Contains'").join(g.tiered, F.col("dst") == F.col("object_id"))
    first = Window.partitionBy("src").orderBy("tier", "object_id")
    return rows.withColumn("k", F.row_number().over(first)).where("k <= 3").select(F.col("src").alias("ou"), "object_id", "tier")


@plain
def pseudonyms(table) -> DataFrame:
    return table("customer").select("c_custkey", scalars.pseudonym(F.col("c_name"), "salt", "user").alias("alias"))


@plain
def common_segment(table) -> DataFrame:
    return table("customer").groupBy(F.col("c_mktsegment").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(1)


@query
def defend_guidance(g: Graph) -> DataFrame:
    dim = F.broadcast(registry.edge_dim(g.spark).where("exploitability > 0").select("edge_type"))
    return paths.steps(g.paths).join(dim, "edge_type", "left_semi").groupBy("edge_type").agg(F.count("*").alias("n"))


@plain
def due_dates(table) -> DataFrame:
    severity = F.element_at(F.create_map(*[F.lit(x) for x in ("1-URGENT", "critical", "2-HIGH", "high", "3-MEDIUM", "medium", "4-NOT SPECIFIED", "low", "5-LOW", "info")]), F.col("o_orderpriority"))
    return table("orders").select("o_orderkey", scalars.due_date(severity, F.to_date("o_orderdate")).alias("due"))
