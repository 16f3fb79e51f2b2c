"""Tier classification, memberships and effective permissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import registry, scalars
from ..storage import materialise, shuffled
from .fixpoint import closure, semi_naive


def memberships(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("edge_type") == "MemberOf").select("src", "dst")


def tier0(nodes: DataFrame, edges: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(id): seeds by name, id and type, ``extra`` (id), and the recursive members of tier-0 groups and roles."""
    seeds = nodes.where(scalars.is_tier0(F.col("object_id"), F.col("name"), F.col("node_type"))).select(F.col("object_id").alias("id"), "node_type")
    if extra is not None:
        seeds = seeds.union(extra.select("id").join(nodes.select(F.col("object_id").alias("id"), "node_type"), "id", "left").select("id", "node_type"))
    holders = seeds.where(F.col("node_type").isin("Group", "AZGroup", "AZRole")).select("id")
    members = memberships(edges)
    inside = semi_naive(holders, lambda new: new.join(members, new["id"] == members["dst"]).select(F.col("src").alias("id")), ["id"], dealt=True)
    return seeds.select("id").union(inside.select("id")).distinct()


def classify(nodes: DataFrame, edges: DataFrame, top: DataFrame | None = None) -> DataFrame:
    """``nodes`` with tier: 0, 1 (logon or admin rights directly on a tier-0 object), else 2."""
    top = tier0(nodes, edges) if top is None else top
    direct = edges.where(F.col("edge_type").isin("AdminTo", "CanRDP", "CanPSRemote")).join(shuffled(top), F.col("dst") == F.col("id"), "left_semi").select(F.col("src").alias("one")).distinct()
    zero, direct = shuffled(top.select(F.col("id").alias("zero"))), shuffled(direct)
    joined = nodes.join(zero, F.col("object_id") == F.col("zero"), "left").join(direct, F.col("object_id") == F.col("one"), "left")
    return joined.withColumn("tier", F.when(F.col("zero").isNotNull(), 0).when(F.col("one").isNotNull(), 1).otherwise(2)).drop("zero", "one")


def group_members(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """(group_id, member_id, depth): recursive members of groups (id), the group itself left out unless it is in a cycle with itself."""
    found = closure(groups.select(F.col("id").alias("origin"), "id"), memberships(edges), "dst", "src")
    return found.where("depth > 0").toDF("group_id", "member_id", "depth")


def group_ancestors(principals: DataFrame, edges: DataFrame) -> DataFrame:
    """(principal_id, group_id, depth): groups that principals (id) are in, directly or by nesting."""
    found = closure(principals.select(F.col("id").alias("origin"), "id"), memberships(edges))
    return found.where("depth > 0").toDF("principal_id", "group_id", "depth")


#: So many members and so many rights of a group are joined at once; a task makes about so many rows.
_PART, _ROWS = 4096, 1 << 24


def effective_permissions(principals: DataFrame, edges: DataFrame) -> DataFrame:
    """(principal_id, target_id, edge_type, via): own edges but memberships (via is null), and those of groups above (via is the group).

    A group gives each member each of its rights, so a few groups hold most of the rows. Members and rights of a group are dealt into parts of about
    ``_PART``, and each pair of parts is joined by itself; the rights of a part are one array, so that rows are made in the tasks and never shuffled.
    """
    own = closure(principals.select(F.col("id").alias("origin"), "id"), memberships(edges))
    rights = edges.where(F.col("edge_type") != "MemberOf").select(F.col("src").alias("id"), F.struct("dst", "edge_type").alias("right"))
    sizes = materialise(own.groupBy("id").agg(F.count("*").alias("m")).join(shuffled(rights.groupBy("id").agg(F.count("*").alias("n"))), "id"), "sizes")
    tasks = max(sizes.sparkSession.sparkContext.defaultParallelism, (sizes.agg(F.sum(F.col("m") * F.col("n"))).first()[0] or 0) // _ROWS)
    large = sizes.where((F.col("m") > _PART) | (F.col("n") > _PART))  # at most one for each ``_PART`` rows joined
    large = F.broadcast(large.select("id", F.ceil(F.col("m") / _PART).alias("ms"), F.ceil(F.col("n") / _PART).alias("ns")))
    of = lambda count, *key: F.pmod(F.xxhash64(*key), F.coalesce(F.col(count), F.lit(1)))
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(count), F.lit(1)) - 1))
    members = own.join(large, "id", "left").select("id", "origin", "depth", of("ms", "origin").alias("m"), each("ns").alias("n"))
    packed = rights.join(large, "id", "left").groupBy("id", "ms", of("ns", "right").alias("n")).agg(F.collect_list("right").alias("rights"))
    packed = packed.select("id", each("ms").alias("m"), "n", "rights")
    found = members.repartition(tasks, "id", "m", "n").join(shuffled(packed.repartition(tasks, "id", "m", "n")), ["id", "m", "n"])
    found = found.select(F.col("origin").alias("principal_id"), F.when(F.col("depth") > 0, F.col("id")).alias("via"), F.inline("rights").alias("target_id", "edge_type"))
    return found.select("principal_id", "target_id", "edge_type", "via")


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, label, n): nodes by type and by tier, edges by kind."""
    return (
        nodes.groupBy(F.lit("node").alias("kind"), F.col("node_type").alias("label")).agg(F.count("*").alias("n"))
        .union(nodes.groupBy(F.lit("tier"), F.col("tier").cast("string")).agg(F.count("*")))
        .union(edges.groupBy(F.lit("edge"), "edge_type").agg(F.count("*")))
    )


#: Into so many parts the names that share a piece are dealt.
_SALTS = 16


def resolve(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query, object_id, stage): matches of a name (query) at its best stage: 1 id, 2 full or display name, 3 part of the name."""
    q = queries.select("query", F.upper("query").alias("q")).distinct()
    full, shown = F.upper("name"), F.upper(scalars.display_name(F.col("name")))
    keys = nodes.select("object_id", F.explode(F.array_distinct(F.array(F.struct(F.lit(1).alias("stage"), F.upper("object_id").alias("q")), F.struct(F.lit(2).alias("stage"), full.alias("q")), F.struct(F.lit(2).alias("stage"), shown.alias("q"))))).alias("k")).select("object_id", "k.*")
    exact = materialise(q.join(shuffled(keys), "q").select("query", "object_id", "stage"), "exact")
    rest = materialise(q.join(shuffled(exact.select("query").distinct()), "query", "left_anti"), "rest")
    # equal names are searched once, at all their pieces of a length that is asked for; salted, as many names share a piece
    lengths = F.array(*[F.lit(r["n"]) for r in rest.select(F.length("q").alias("n")).distinct().orderBy("n").collect()]).cast("array<int>")  # no more than the longest query is long
    salt = F.pmod(F.hash("full"), F.lit(_SALTS)).alias("salt")
    pieces = F.flatten(F.transform(F.filter(lengths, lambda n: n <= F.length("full")), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("full") - n, F.lit(0)) + 1), lambda i: F.substring(F.col("full"), i, n))))
    texts = nodes.select(full.alias("full")).where("full is not null").distinct()
    indexed = texts.select("full", salt, F.explode(F.array_distinct(pieces)).alias("q"))
    asked = rest.select("query", "q", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    fits = shuffled(indexed).join(asked, ["q", "salt"]).select("query", "full")
    part = fits.join(shuffled(nodes.select("object_id", full.alias("full"))), "full").select("query", "object_id", F.lit(3).alias("stage"))
    best = exact.groupBy("query").agg(F.min("stage").alias("stage"))
    return exact.join(shuffled(best), ["query", "stage"]).select("query", "object_id", "stage").union(part).distinct()


def induced(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """``edges`` of which both ends are in a set (id)."""
    ids = inside.select("id").distinct()
    return edges.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")
