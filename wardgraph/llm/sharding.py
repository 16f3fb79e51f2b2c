"""A store of immutable shards with size-tiered compaction and versioned manifests.

Layout below ``root``: ``data/<job>/...`` are Parquet shards, never changed; ``manifests/v<n>`` is version n's list of shards
(path, rows, bytes), a Parquet table; ``commits/v<n>`` is a small JSON file (schema, parent), and its appearance is the commit.
The commit file is written under another name and renamed without overwriting, so of two writers of a version one fails, and a
job that dies leaves the last version as it was.

``append`` writes arrivals as small shards without a shuffle. ``compact`` puts shards below the target size into tiers (a tier's
shards are at most ``growth`` times apart), and a tier of at least ``fan_in`` shards is dealt into runs of about the target size. Runs are
numbered, and each has a task of its own, which reads the run's shards one after another and writes one file; nothing is shuffled, and no task holds more than a batch of rows. Passes repeat until no tier has enough
shards. Rows are kept whole, in no particular order; repeated rows stay repeated.
An empty append commits a version without new shards; nulls and any column names are stored as they are.
"""

from __future__ import annotations

import json
import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRIES = "path string, rows long, bytes long"
#: Where this is on, a union of single partitions is a single one, and one task would merge all runs.
UNION = "spark.sql.unionOutputPartitioning"


def file_path() -> Column:
    """A row's file as Hadoop names it; the metadata column gives it percent-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def literal(path: str) -> str:
    """A path whose characters stand for themselves where Spark would read a pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


class CommitConflict(RuntimeError):
    """Another writer has committed the version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, x: str):
        return self._hadoop.fs.Path(x)

    def versions(self) -> list[int]:
        at = self._path(f"{self.root}/commits")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[1:]) for n in names if n[0] == "v")

    def _commit(self, entries: DataFrame, schema: T.StructType, parent: int) -> int:
        version = parent + 1
        manifest = f"{self.root}/manifests/v{version:08d}-{uuid.uuid4().hex}"
        entries.write.parquet(manifest)
        draft = f"{self.root}/commits/.draft-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(draft), False)
        out.write(bytearray(json.dumps({"parent": parent, "manifest": manifest, "schema": schema.json()}).encode()))
        out.close()
        files = self._hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        kept = self.spark.sparkContext._gateway.new_array(self._hadoop.fs.Options.Rename, 0)
        try:
            files.rename(self._path(draft), self._path(f"{self.root}/commits/v{version:08d}"), kept)
        except Exception as e:
            self._fs.delete(self._path(draft), False)
            raise CommitConflict(f"version {version} exists") from e
        return version

    def _head(self, version: int) -> dict:
        text = self.spark.read.option("wholetext", True).text(literal(f"{self.root}/commits/v{version:08d}")).first()[0]
        return json.loads(text)

    def manifest(self, version: int | None = None) -> DataFrame:
        """Shards of a version, the last unless given."""
        version = self.versions()[-1] if version is None else version
        return self.spark.read.schema(ENTRIES).parquet(literal(self._head(version)["manifest"]))

    def _written(self, *folders: str) -> DataFrame:
        """Entries of the shards of some jobs, from their footers."""
        try:
            found = self.spark.read.parquet(*map(literal, folders))
        except AnalysisException:  # no rows, so no shards
            return self.spark.createDataFrame([], ENTRIES)
        return found.groupBy(file_path().alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows")).where("rows > 0").select("path", "rows", "bytes")

    def append(self, df: DataFrame) -> int:
        """Commits the rows of ``df`` as new shards, one or more for each task."""
        versions = self.versions()
        parent = versions[-1] if versions else 0
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        entries = self._written(folder)
        return self._commit(self.manifest(parent).union(entries) if parent else entries, df.schema, parent)

    def plan(self, entries: DataFrame, target_bytes: int, fan_in: int, growth: float, stripe: int = 50_000) -> DataFrame:
        """(path, run, bytes): shards to be merged, by run, numbered from 0. A tier's list is cut into stripes of about ``stripe`` shards."""
        small = entries.where(F.col("bytes") < target_bytes).withColumn("tier", F.floor(F.log(F.greatest("bytes", F.lit(1))) / F.log(F.lit(float(growth)))))
        sizes = small.groupBy("tier").agg(F.count("*").alias("n")).where(F.col("n") >= fan_in)
        dealt = small.join(sizes, "tier").withColumn("stripe", F.pmod(F.xxhash64("path"), F.ceil(F.col("n") / stripe)))
        before = Window.partitionBy("tier", "stripe").orderBy("bytes", "path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # a run closes with the shard that would pass the target, so it holds at most the target and that shard
        runs = dealt.withColumn("k", F.floor((F.sum("bytes").over(before) - 1) / target_bytes)).select("path", "bytes", F.concat_ws("-", "tier", "stripe", "k").alias("run"))
        # a row for each file to be written
        several = runs.groupBy("run").agg(F.count("*").alias("n")).where("n > 1").select("run", (F.row_number().over(Window.orderBy("run")) - 1).alias("number"))
        return runs.join(several, "run").select("path", F.col("number").alias("run"), "bytes")

    def _merged(self, runs: list[list[str]], schema: T.StructType) -> str:
        """Writes a file for each run (its shards' paths): a task reads the run's shards one after another, so nothing is shuffled."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        reader = self.spark.read.schema(schema)
        reduce(DataFrame.union, [reader.parquet(*paths).coalesce(1) for paths in runs]).write.option("compression", "zstd").parquet(folder)
        return folder

    def compact(self, target_bytes: int = 64 << 20, fan_in: int = 4, growth: float = 4.0, max_passes: int = 8, together: int = 64, at_once: int = 4) -> int:
        """Merges until no tier of shards below the target has ``fan_in`` members; commits each pass. Returns the version. A job merges ``together`` runs, and
        ``at_once`` jobs run side by side."""
        version = self.versions()[-1]
        for _ in range(max_passes):
            head = self._head(version)
            schema = T.StructType.fromJson(json.loads(head["schema"]))
            entries = self.manifest(version)
            plan = self.plan(entries, target_bytes, fan_in, growth).persist()
            try:
                runs: dict[int, list[str]] = {}
                for r in plan.select("run", "path").collect():  # names of files, of which the scan keeps a list anyway
                    runs.setdefault(r["run"], []).append(literal(r["path"]))
                if not runs:
                    return version
                jobs = [list(runs.values())[k : k + together] for k in range(0, len(runs), together)]
                before = self.spark.conf.get(UNION)
                self.spark.conf.set(UNION, "false")
                try:
                    with ThreadPoolExecutor(at_once) as pool:
                        folders = list(pool.map(lambda some: self._merged(some, schema), jobs))
                finally:
                    self.spark.conf.set(UNION, before)
                kept = entries.join(plan.select("path"), "path", "left_anti").select("path", "rows", "bytes")
                version = self._commit(kept.union(self._written(*folders)), schema, version)
            finally:
                plan.unpersist()
        return version

    def vacuum(self) -> int:
        """Deletes shards that the last version doesn't list but an earlier one did. Returns how many. Readers of earlier versions fail then."""
        *earlier, last = self.versions()
        gone = None
        for v in earlier:
            gone = self.manifest(v) if gone is None else gone.union(self.manifest(v))
        if gone is None:
            return 0
        found = gone.select("path").distinct().join(self.manifest(last), "path", "left_anti").collect()
        return sum(self._fs.delete(self._path(r["path"]), False) for r in found)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; ``_metadata.file_path`` names a row's shard."""
        version = self.versions()[-1] if version is None else version
        schema = T.StructType.fromJson(json.loads(self._head(version)["schema"]))
        paths = [r["path"] for r in self.manifest(version).select("path").collect()]
        return self.spark.read.schema(schema).parquet(*map(literal, paths)) if paths else self.spark.createDataFrame([], schema)
