"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local session (tests, a single machine) gets a folder; elsewhere that's an error, as
    executors would write where nobody reads."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def session_folder(spark: SparkSession) -> str:
    """Where a session's tables lie, below the shared folder."""
    return f"{shared_root(spark)}/tables-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the session's folder."""
    return f"{session_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and returns a reader of it: lineage ends here, and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, dealt out by key where it is joined next. Spark estimates a table by the bytes of its files, and ids fill many times as many in memory; a table
    that grows with the graph would thus pass through the driver for each join until its files are large."""
    return df.hint("merge")


def clear_session(spark: SparkSession) -> None:
    """Deletes the session's tables; DataFrames that read them can't be used afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
