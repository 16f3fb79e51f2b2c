"""Quality classifier by co-training.

Two views of a document: its content (rates of character classes, word and line repetition) and its page metadata (source,
language, length, each hashed or bucketed). Each view has a logistic regression of its own (Spark ML). They start from the
labelled rows; in each round a view labels the pool's unlabelled rows it is confident of, and the other view learns from them.
In the end each view is calibrated (Platt) on labelled rows kept out of training, and the calibrated log odds are added, less
the prior counted twice. All documents are scored; ``kept`` is score >= threshold.

Bounds, as parameters: about ``max_labelled`` labelled (1,000 at least of each class, where there are as many) and ``max_pool`` unlabelled
rows are used to fit, chosen by a hash of the id.

A null or empty text has zeros for content; null metadata has a bucket of its own. Several labels of one id are averaged
(half counts as good); null labels don't count. Of several rows with one id, the one with the least features teaches. With labels of fewer
than two classes among the documents every document has that class as its score, 1 without labels. Where too few rows are labelled to
keep some of both classes out of training, all of them teach and calibrate. A row with a null id is scored like any other.
"""

from __future__ import annotations

import zlib
from math import log, log1p

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import computed, materialise, small_batches

SOURCES, LANGS, SIZES = 64, 16, 20
_CLASSES = [bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b" \t", b"\n\r", b".", b",", b"!", b"|", b"?", b"#*$%&", b"<>", b"'\"()[]{}:;", b"/\\@=_+-~^`"]
_GROUP = np.full(256, len(_CLASSES), np.int64)
for _i, _c in enumerate(_CLASSES):
    _GROUP[list(_c)] = _i
CONTENT = len(_CLASSES) + 8


def content_features(text: bytes | None) -> list[float]:
    """Of a UTF-8 text: logarithm of its length, rates of byte classes, and of words and lines that don't repeat."""
    text = text or b""
    if not text:
        return [0.0] * CONTENT
    groups = np.bincount(_GROUP[np.frombuffer(text, np.uint8)], minlength=len(_CLASSES) + 1) / len(text)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n = max(1, len(words))
    pairs = len({*zip(words, words[1:])}) / max(1, len(words) - 1)
    return [log1p(len(text)), *groups.tolist(), len({*words}) / n, pairs, log1p(sum(map(len, words)) / n), len({*lines}) / max(1, len(lines)), log1p(len(lines)), log1p(n)]


def metadata_features(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    """Buckets of the source, the language and the length; bucket 0 is for null."""
    bucket = lambda x, n: 0 if x is None else 1 + zlib.crc32(x.encode()) % (n - 1)
    return [bucket(source, SOURCES), SOURCES + bucket(lang, LANGS), SOURCES + LANGS + (0 if n_chars is None else min(SIZES - 1, 1 + max(0, int(n_chars)).bit_length()))]


def features(docs: DataFrame, keep: list[str] = (), id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, str, str] = ("source", "lang", "n_chars")) -> DataFrame:
    """doc_id, content (array of float), meta (array of the three buckets that are set), and row, a struct of the columns ``keep`` of ``docs``."""

    def content(texts: pa.Array) -> pa.Array:
        return pa.array([content_features(x) for x in texts.cast(pa.binary()).to_pylist()], pa.list_(pa.float32()))

    def meta(*columns: pa.Array) -> pa.Array:
        return pa.array([metadata_features(*x) for x in zip(*(c.to_pylist() for c in columns), strict=True)], pa.list_(pa.int32()))

    small_batches(docs.sparkSession)
    s, lang, n = meta_cols
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        computed(content, "array<float>", F.col(text_col).cast("string")).alias("content"),
        computed(meta, "array<int>", F.col(s).cast("string"), F.col(lang).cast("string"), F.col(n).cast("long")).alias("meta"),
        *([F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []),
    )


def _wide(meta: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(SOURCES + LANGS + SIZES - 1)), lambda i: F.when(F.array_contains(meta, i), 1.0).otherwise(0.0))


def _fit(rows: DataFrame, view: str, target: Column, reg: float = 1e-3) -> tuple[list[float], float]:
    """Weights and intercept of a logistic regression of ``target`` (null: not used) on the view's features."""
    used = rows.where(target.isNotNull()).select(array_to_vector(F.col(view).cast("array<double>")).alias("features"), target.cast("double").alias("label"))
    model = LogisticRegression(maxIter=40, regParam=reg, standardization=True).fit(used)
    return model.coefficients.toArray().tolist(), float(model.intercept)


def _log_odds(view: str, model: tuple[list[float], float]) -> Column:
    weights = F.array(*[F.lit(w) for w in model[0]])
    return F.aggregate(F.zip_with(F.col(view).cast("array<double>"), weights, lambda x, w: x * w), F.lit(model[1]), lambda a, x: a + x)


def _platt(rows: DataFrame, odds: Column) -> tuple[float, float]:
    used = rows.select(array_to_vector(F.array(odds)).alias("features"), F.col("label").cast("double").alias("label"))
    model = LogisticRegression(maxIter=40, regParam=1e-3, standardization=True).fit(used)
    return float(model.coefficients[0]), float(model.intercept)


def training_rows(table: DataFrame, named: DataFrame, count: dict[int, int], max_labelled: int, max_pool: int, least: int = 1000) -> tuple[DataFrame, dict[int, float]]:
    """(content, meta, label or null, aside) of a bounded sample of ``table``, a row for each id, and the share of each label that was taken.

    Ids are chosen by a hash. Labels are bounded by their count before they are broadcast, and rows of one id are reduced to one in
    every task before they are shuffled, so an id that many rows share is as good as any other.
    """
    h = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
    n = sum(count.values())
    share = {label: min(1.0, max(max_labelled / n, least / k)) for label, k in count.items()}
    taken = named.where(h < F.when(F.col("label") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
    one = lambda rows: rows.groupBy("doc_id", "label").agg(F.min(F.struct("content", "meta")).alias("x"))
    labelled = one(table.select("doc_id", "content", "meta").join(F.broadcast(taken), "doc_id"))  # about max_labelled + least rows
    few = h < min(1.0, max_pool / max(1, table.count()))
    pool = one(table.where(F.col("doc_id").isNotNull() & few).select("doc_id", "content", "meta", F.lit(None).cast("int").alias("label")))
    pool = pool.join(named.where(few).select("doc_id"), "doc_id", "left_anti")
    rows = labelled.select("doc_id", "label", "x").union(pool.select("doc_id", "label", "x"))
    aside = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(5)) == 0
    return rows.select("x.content", _wide(F.col("x.meta")).alias("meta"), "label", aside.alias("aside")), share


def score_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: list[str] = (), rounds: int = 2, confident: float = 0.98, threshold: float = 0.5, max_labelled: int = 40_000, max_pool: int = 40_000
) -> DataFrame:
    """doc_id, p_content, p_meta (calibrated), score and kept for each row of ``docs``, and row, a struct of its columns ``keep``."""
    table = materialise(features(docs, keep, id_col, text_col), "features")
    own_columns = ["row"] if keep else []
    named = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("q")).where("doc_id is not null and q is not null")
    named = materialise(named.groupBy("doc_id").agg((F.avg("q") >= 0.5).cast("int").alias("label")), "labels")
    count = {r["label"]: r["count"] for r in named.groupBy("label").count().collect()}  # two rows at most

    def same(score: float) -> DataFrame:
        return table.select("doc_id", *[F.lit(score).alias(c) for c in ("p_content", "p_meta", "score")], F.lit(score >= threshold).alias("kept"), *own_columns)

    if len(count) < 2:
        return same(float(next(iter(count), 1)))
    rows, share = training_rows(table, named, count, max_labelled, max_pool)
    rows = materialise(rows, "training").persist()
    own_count = {(r["label"], r["aside"]): r["count"] for r in rows.where("label is not null").groupBy("label", "aside").count().collect()}  # four rows at most
    seen = {label: sum(k for (x, _), k in own_count.items() if x == label) for label in (0, 1)}
    if not all(seen.values()):  # labels of one class only belong to documents
        rows.unpersist()
        return same(float(seen[1] > 0) if any(seen.values()) else 1.0)
    apart = all(own_count.get((label, part), 0) for label in (0, 1) for part in (False, True))
    own = F.when(F.col("label").isNotNull() & ~(F.lit(apart) & F.col("aside")), F.col("label"))  # too few rows: all of them teach and calibrate
    pool = F.col("label").isNull()

    def sure(view: str, model: tuple[list[float], float]) -> Column:
        edge = log(confident / (1 - confident))
        odds = _log_odds(view, model)
        return F.when(pool & (odds >= edge), 1).when(pool & (odds <= -edge), 0)

    content, meta = _fit(rows, "content", own), _fit(rows, "meta", own)
    for _ in range(rounds):
        content, meta = _fit(rows, "content", F.coalesce(own, sure("meta", meta))), _fit(rows, "meta", F.coalesce(own, sure("content", content)))

    aside = rows.where("label is not null and aside" if apart else "label is not null")
    by_content, by_meta = _platt(aside, _log_odds("content", content)), _platt(aside, _log_odds("meta", meta))
    rows.unpersist()

    # each view's odds hold the sample's prior once; the sum shall hold that of all labels once
    prior = log(seen[1] / seen[0]) - log(share[0] / share[1])
    scored = table.withColumn("meta", _wide(F.col("meta"))).select(
        "doc_id", (_log_odds("content", content) * by_content[0] + by_content[1]).alias("a"), (_log_odds("meta", meta) * by_meta[0] + by_meta[1]).alias("b"), *own_columns
    )
    p = lambda x: 1 / (1 + F.exp(-x))
    scored = scored.select("doc_id", p(F.col("a")).alias("p_content"), p(F.col("b")).alias("p_meta"), p(F.col("a") + F.col("b") - prior).alias("score"), *own_columns)
    return scored.select("doc_id", "p_content", "p_meta", "score", (F.col("score") >= threshold).alias("kept"), *own_columns)
