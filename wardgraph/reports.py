"""Sinks: findings as JSON lines, SARIF and Markdown, watch lists for detection, pseudonymous copies, and the history of scores."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import registry, scalars
from .operators.paths import steps

#: How a severity is called in SARIF 2.1.0.
SARIF_LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "none"}


def write_json_lines(rows: DataFrame, path: str) -> None:
    """One JSON object for each row, nulls included, in as many files as ``rows`` has partitions."""
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def _sorted(findings: DataFrame) -> list:
    """Findings are rules, so a few hundred rows at most."""
    order = {s: -i for i, s in enumerate(registry.SEVERITIES)}
    return sorted(findings.select("finding", "severity", "total", "names").collect(), key=lambda r: (order[r["severity"]], r["finding"]))


def sarif(findings: DataFrame, tool: str = "wardgraph") -> str:
    """``audit.findings`` as a SARIF 2.1.0 document."""
    rows = _sorted(findings)
    rules = [{"id": r["finding"], "defaultConfiguration": {"level": SARIF_LEVELS[r["severity"]]}} for r in rows]
    results = [
        {
            "ruleId": r["finding"],
            "level": SARIF_LEVELS[r["severity"]],
            "message": {"text": f"{r['total']} objects: {r['names']}"},
            "locations": [{"logicalLocations": [{"name": name} for name in r["names"].split(",")]}],
        }
        for r in rows
    ]
    run = {"tool": {"driver": {"name": tool, "rules": rules}}, "results": results}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, indent=2)


def markdown(findings: DataFrame) -> str:
    """``audit.findings`` as a Markdown table; what would end a cell or begin markup is escaped."""
    clean = lambda text: "".join("\\" + c if c in "\\|`*_<>[]" else " " if c in "\r\n" else c for c in text)
    lines = ["| Severity | Finding | Objects | Names |", "|---|---|---|---|"]
    return "\n".join([*lines, *(f"| {r['severity']} | {clean(r['finding'])} | {r['total']} | {clean(r['names'])} |" for r in _sorted(findings))]) + "\n"


def watch_lists(paths: DataFrame, size: int = 200) -> DataFrame:
    """(edge_type, part, objects): objects that steps of paths end at, by kind of step, in parts of about ``size``.

    Parts go by a hash of the id, so no task ranks all objects of a kind.
    """
    seen = steps(paths).where(~F.col("edge_type").isin(registry.UNCUTTABLE)).select("edge_type", F.col("dst").alias("object_id")).distinct()
    sizes = seen.groupBy("edge_type").agg(F.ceil(F.count("*") / size).alias("parts"))  # a row for each kind
    dealt = seen.join(F.broadcast(sizes), "edge_type").withColumn("part", F.pmod(F.xxhash64("object_id"), F.col("parts")).cast("int"))
    return dealt.groupBy("edge_type", "part").agg(F.array_sort(F.collect_list("object_id")).alias("objects"))


def pseudonymous(nodes: DataFrame, edges: DataFrame, salt: str) -> tuple[DataFrame, DataFrame]:
    """Copies with ids and names that can't be traced without the salt. What makes an object tier 0 by itself stays: well-known ids and endings of
    ids, and names of tier-0 groups and service accounts; so tiers and exposure of the copy are those of the original."""
    rid = F.regexp_extract("id", r"-(\d{3})$", 1)

    def hidden(column: str):
        kept = F.when(rid.isin(list(registry.WELL_KNOWN_RIDS)), F.concat(F.lit("-"), rid)).otherwise("")
        plain = F.coalesce(F.col("id").rlike(r"S-1-(?:\d|5-(?:\d{1,2}|32-\d+))$"), F.lit(False)) | F.col("id").isin(registry.TIER0_CLOUD_ROLES)
        made = F.concat(F.lit("ID-"), F.upper(F.substring(F.sha2(F.concat(F.lit(salt), F.col("id")), 256), 1, 24)), kept)
        return F.when(plain, F.col("id")).otherwise(made).alias(column)

    def swapped(df: DataFrame, column: str) -> DataFrame:
        rest = [c for c in df.columns if c != column]
        return df.withColumnRenamed(column, "id").select(*rest, hidden(column))

    shown = F.upper(scalars.display_name(F.col("name")))
    prefix = F.regexp_extract(shown, f"^({'|'.join(registry.SERVICE_PREFIXES)})", 1)
    known = shown.isin(registry.TIER0_GROUPS)
    names = F.when(known, shown).otherwise(F.concat(prefix, scalars.pseudonym(F.col("name"), salt, "n")))
    copy = swapped(nodes.select("object_id", names.alias("name"), "node_type", "enabled", "admin_count"), "object_id")
    ends = swapped(swapped(edges.select("src", "dst", "edge_type"), "src"), "dst")
    return copy.select("object_id", "name", "node_type", "enabled", "admin_count"), ends.select("src", "dst", "edge_type")


def append_history(row: DataFrame, path: str, by: str = "collected") -> None:
    """Adds a run to a history partitioned by date; a run of the same date takes the earlier one's place."""
    row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_history(spark: SparkSession, path: str, by: str = "collected") -> DataFrame:
    return spark.read.parquet(path).withColumn(by, F.col(by).cast("date"))
