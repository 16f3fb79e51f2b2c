"""From raw documents to packed sequences: language ID, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgraph.llm import cotrain, langid, packing, simhash
from wardgraph.llm.common import documents, materialise, unused
from wardgraph.llm.queries import BYTE_BPE


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows, drops documents without a language (null texts and texts without a letter), and puts the predicted
    language of the others into ``lang``, where the next stage reads it."""
    model = langid.train_model(docs)
    found = unused(docs, "found")
    rows = docs.withColumn(found, langid.predicted(docs, model, F.col("text")))
    rows = rows.where(F.col(found)["lang_pred"] != "und").withColumn("lang", F.col(found)["lang_pred"])
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that the co-trained classifier rejects, each by its own content and metadata."""
    scored = cotrain.score_documents(docs, documents(spark, sf_dir, "labels"), keep=docs.columns)
    return scored.where("kept").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component, that with the smallest id."""
    return simhash.drop_near_duplicates(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence and its place there."""
    return packing.pack_documents(docs, BYTE_BPE)


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't express the trained stages, fingerprints or tokens; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
