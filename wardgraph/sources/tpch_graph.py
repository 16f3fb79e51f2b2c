"""The order tables seen as an identity graph.

Customers are users, suppliers computers, nations groups (nation 0 is the domain admins, by the end of its id) and regions units.
A customer belongs to its nation, and every fourth nation to another one; regions contain nations; a nation administers its suppliers;
returned line items leave sessions on the supplier; large urgent orders give the customer a right over another one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shuffled

NODE_COLUMNS = ["object_id", "name", "node_type", "enabled", "admin_count"]


def _id(prefix: str, key) -> F.Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def _nation(key) -> F.Column:
    return F.when(F.col(key) == 0, "S-1-5-21-0-512").otherwise(_id("N", key))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NODE_COLUMNS: object_id, name, node_type, enabled, admin_count."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    no, yes = F.lit(False), F.lit(True)
    service = F.col("c_mktsegment") == "MACHINERY"
    users = read("customer").select(_id("C", "c_custkey"), F.when(service, F.concat(F.lit("SVC_"), "c_name")).otherwise(F.col("c_name")), F.lit("User"), F.col("c_acctbal") >= 0, F.col("c_custkey") % 10 == 0)
    hosts = read("supplier").select(_id("S", "s_suppkey"), "s_name", F.lit("Computer"), yes, no)
    groups = read("nation").select(_nation("n_nationkey"), "n_name", F.lit("Group"), yes, no)
    units = read("region").select(_id("R", "r_regionkey"), "r_name", F.lit("OU"), yes, no)
    return users.union(hosts).union(groups).union(units).toDF(*NODE_COLUMNS)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, edge_type; each kind of edge between two objects once."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nation, orders = read("nation"), read("orders")
    inner = nation.where("n_nationkey % 4 = 1 and (7 * n_nationkey + 3) % 25 <> 0").withColumn("up", (7 * F.col("n_nationkey") + 3) % 25)
    parts = [
        read("customer").select(_id("C", "c_custkey"), _nation("c_nationkey"), F.lit("MemberOf")),
        inner.select(_nation("n_nationkey"), _nation("up"), F.lit("MemberOf")),
        nation.select(_id("R", "n_regionkey"), _nation("n_nationkey"), F.lit("Contains")),
        read("supplier").select(_nation("s_nationkey"), _id("S", "s_suppkey"), F.lit("AdminTo")),
        read("lineitem").where("l_returnflag = 'R' and l_quantity >= 49 and l_linenumber = 1").join(shuffled(orders), F.col("l_orderkey") == F.col("o_orderkey")).select(_id("S", "l_suppkey"), _id("C", "o_custkey"), F.lit("HasSession")),
    ]
    customers = read("customer").agg(F.count("*").alias("n"))  # one row
    right = F.when(F.col("o_orderstatus") == "F", "ForceChangePassword").when(F.col("o_orderstatus") == "O", "GenericWrite").otherwise("WriteDacl")
    granted = orders.where("o_orderpriority = '1-URGENT' and o_totalprice > 420000").crossJoin(F.broadcast(customers)).withColumn("over", F.col("o_orderkey") % F.col("n"))
    parts.append(granted.where("o_custkey <> over").select(_id("C", "o_custkey"), _id("C", "over"), right))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.toDF("src", "dst", "edge_type").distinct()
