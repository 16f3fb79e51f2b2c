"""What the operators share: small batches, computed columns, the documents reader."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise, scratch

__all__ = ["computed", "documents", "materialise", "scratch", "small_batches", "texts", "unused"]

#: Rows in one Arrow batch handed to Python. Texts can be long, so batches stay far below Spark's default of 10,000 rows.
BATCH_ROWS = 256


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the memory of Python workers by handing them ``rows`` rows at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, so that any other columns of ``docs``, whatever their names, stay out of the way."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def computed(function: Callable[..., pa.Array], kind: str, *inputs: Column) -> Column:
    """A column of the kind ``kind`` that ``function`` computes from Arrow arrays of the inputs, a batch at a time. Other columns of a
    row stay in the JVM. (Called non-deterministic so that a filter on the column doesn't compute it again.)"""
    return F.arrow_udf(lambda *arrays: function(*arrays), kind).asNondeterministic()(*inputs)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as it takes to differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
