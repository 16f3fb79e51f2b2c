"""Detection rules for what attack paths pass through, in parts of a bounded number of objects, with ids that depend on their content alone."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import registry, scalars
from .operators.paths import steps

#: Rule, kinds of steps that it covers, kind of object (empty: any), events of the security log, field that names the object, how it is compared, severity.
KINDS = [
    ("ADD_MEMBER_ABUSE", "AddMember GenericAll GenericWrite WriteDacl WriteOwner Owns", "Group", "4728 4732 4756", "TargetUserName", "eq", "high"),
    ("ACL_CHANGE", "WriteDacl WriteOwner Owns GenericAll", "", "5136", "ObjectDN", "contains", "high"),
    ("SENSITIVE_ATTRIBUTE_WRITE", "GenericWrite GenericAll WriteSPN AddAllowedToAct AllowedToAct WriteKeyCredentialLink", "", "5136", "ObjectDN", "contains", "high"),
    ("PASSWORD_RESET", "ForceChangePassword GenericAll", "User", "4724", "TargetUserName", "eq", "high"),
    ("MANAGED_PASSWORD_READ", "ReadGMSAPassword ReadLAPSPassword", "", "4662", "ObjectName", "contains", "high"),
    ("ADMIN_LOGON", "AdminTo SQLAdmin ExecuteDCOM", "", "4624 4672", "Computer", "startswith", "high"),
    ("RDP_LOGON", "CanRDP", "", "4624", "Computer", "startswith", "medium"),
    ("PSREMOTE_LOGON", "CanPSRemote", "", "4624", "Computer", "startswith", "medium"),
    ("DELEGATION_USE", "AllowedToDelegate", "", "4769", "ServiceName", "startswith", "high"),
    ("GPO_CHANGE", "GPOControlsObject", "", "5136", "ObjectDN", "contains", "high"),
    ("ADCS_ISSUANCE", "Enroll AutoEnroll ManageCA ManageCertificates WritePKIEnrollmentFlag WritePKINameFlag", "", "4886 4887", "CertificateTemplate", "contains", "high"),
]
#: Rules on the members of groups, whatever the paths: tier-0 groups, and groups that reach tier 0.
GROUPS = [("T0_GROUP_MEMBERSHIP", "critical"), ("EXPOSED_GROUP_MEMBERSHIP", "high")]
GROUP_EVENTS = "4728 4732 4756"
#: Names rules by content; a rule of the same content has the same id anywhere.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "wardgraph:detection-rules")
RULE = "rule string, part int, rule_id string, severity string, events array<int>, field string, compared string, objects array<string>, covered long"


def shown_name(name: F.Column, node_type: F.Column) -> F.Column:
    """As event logs write it: hosts by their short name and a dollar sign."""
    display = scalars.display_name(name)
    return F.when(node_type == "Computer", F.concat(F.split_part(display, F.lit("."), F.lit(1)), F.lit("$"))).otherwise(display)


def canonical(rule: F.Column, part: F.Column, events: F.Column, field: F.Column, compared: F.Column, objects: F.Column) -> F.Column:
    """The JSON text that names a rule: an array of its rule, part, events, field, comparison and objects."""
    text = lambda x: F.to_json(F.array(x))
    inner = lambda x: F.substr(text(x), F.lit(2), F.length(text(x)) - 2)
    return F.concat(F.lit("["), inner(rule), F.lit(","), part.cast("string"), F.lit(","), F.to_json(events), F.lit(","), inner(field), F.lit(","), inner(compared), F.lit(","), F.to_json(objects), F.lit("]"))


def _parts(rows: DataFrame, size: int) -> DataFrame:
    """RULE of (rule, severity, events, field, compared, object, covered): objects in the order of their names, ``size`` to a part.

    A name's place is that of its task's range and its place there, so no task holds all objects of a rule."""
    keys = ["rule", "severity", "events", "field", "compared"]
    own = rows.groupBy(*keys, F.lower("object").alias("k")).agg(F.min("object").alias("object"), F.sum("covered").alias("covered"))
    # names go to ranges by their first letters; a range's objects are numbered after those of the ranges before it
    own = own.withColumn("range", F.substring("k", 1, 12))
    sizes = own.groupBy("rule", "range").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("rule").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("rule", "range").orderBy("k")) + F.col("before")
    dealt = own.join(before, ["rule", "range"]).withColumn("place", place).withColumn("part", (F.floor((F.col("place") - 1) / size) + 1).cast("int"))
    found = dealt.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("place", "object"))).alias("x"), F.sum("covered").alias("covered"))
    found = found.withColumn("objects", F.transform("x", lambda o: o["object"]))
    name = canonical(*[F.col(c) for c in ("rule", "part", "events", "field", "compared", "objects")])
    return found.select("rule", "part", scalars.uuid5(NAMESPACE, name).alias("rule_id"), "severity", "events", "field", "compared", "objects", "covered")


def rules(paths: DataFrame, nodes: DataFrame, top: DataFrame | None = None, exposed: DataFrame | None = None, size: int = 200) -> DataFrame:
    """RULE: for the steps of paths (path_id, nodes, edge_types) the rules that watch the objects they end at, with how many paths' steps each covers; also, of the
    groups among ``top`` and ``exposed`` (id), rules on new members. An object that ``nodes`` lacks is named by its id."""
    spark = paths.sparkSession
    dim = spark.createDataFrame(KINDS, "rule string, kinds string, only string, events string, field string, compared string, severity string")
    dim = dim.select("rule", F.explode(F.split("kinds", " ")).alias("edge_type"), "only", F.split("events", " ").cast("array<int>").alias("events"), "field", "compared", "severity")
    named = nodes.select(F.col("object_id").alias("id"), "name", "node_type")
    known = lambda rows: rows.join(named, "id", "left").withColumn("object", F.coalesce(shown_name(F.col("name"), F.col("node_type")), "id"))
    points = steps(paths).groupBy("edge_type", F.col("dst").alias("id")).agg(F.count_distinct("path_id").alias("covered"))
    watched = known(points).join(F.broadcast(dim), "edge_type").where((F.col("only") == "") | (F.col("only") == F.col("node_type")))
    found = watched.select("rule", "severity", "events", "field", "compared", "object", "covered")
    for (rule, severity), ids in zip(GROUPS, (top, exposed), strict=True):
        if ids is not None:
            groups = known(ids.select("id").distinct()).where("node_type = 'Group'")
            events = F.split(F.lit(GROUP_EVENTS), " ").cast("array<int>")
            found = found.union(groups.select(F.lit(rule), F.lit(severity), events, F.lit("TargetUserName"), F.lit("eq"), "object", F.lit(0).cast("long")))
    return _parts(found, size)


def compensating(findings: DataFrame, nodes: DataFrame, size: int = 200) -> DataFrame:
    """RULE: rules for the paths that a change set's findings show (findings: kind, superseded, paths as an array of (nodes, edge_types)), but for structure. Only
    findings that open or shorten routes count."""
    risky = ["TIER0_PROMOTION", "NEW_EXPOSURE", "COMBINED_EFFECT", "PATH_SHORTENED"]
    each = findings.where(F.col("kind").isin(risky) & ~F.coalesce("superseded", F.lit(False))).select("finding_id", F.posexplode("paths").alias("i", "p"))
    paths = each.select(F.concat_ws("/", "finding_id", "i").alias("path_id"), "p.nodes", "p.edge_types")
    live = nodes.select(F.col("object_id").alias("id"))
    # a step counts if both its ends are still there
    points = steps(paths).where(~F.col("edge_type").isin(registry.PLAIN_STRUCTURE)).join(live, F.col("src") == F.col("id"), "left_semi").join(live, F.col("dst") == F.col("id"), "left_semi")
    single = points.select(F.concat_ws("/", "path_id", "step").alias("path_id"), F.array("src", "dst").alias("nodes"), F.array("edge_type").alias("edge_types"))
    return rules(single, nodes, size=size)
