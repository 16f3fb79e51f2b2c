"""The subpackage's queries, by the names under which they are registered."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, collocations, cotrain, flatids, langid, licenses, media, merkle, packing, pieces, rules, simhash
from .common import documents, scratch
from .sharding import ShardStore

#: The tokenizers' files; the place is a parameter of every operator that uses one.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table arrives in eight appends, each half as large as the one before, and is compacted; what the store then holds, by
    document: n_bytes and text_sha256 of the text read back, and the other columns."""
    docs = documents(spark, sf_dir)
    arrival = F.least(F.length(F.regexp_extract(F.bin(F.xxhash64("doc_id")), "(0*)$", 1)), F.lit(7))
    store = ShardStore(spark, scratch(spark, "shards"))
    for k in range(8):
        store.append(docs.where(arrival == k))
    version = store.compact()
    store.vacuum()
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return store.read(version).select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"), "lang", "source", "n_chars")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_round_trip(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(documents(spark, sf_dir), PIECE_BPE)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train_model(docs, ~langid.held_out())
    return langid.identify(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op8_flat_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatids.flat_round_trip(spark, documents(spark, sf_dir), BYTE_BPE)


def op9_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.score_documents(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), BYTE_BPE)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.with_followers(documents(spark, sf_dir))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(documents(spark, sf_dir), BYTE_BPE, PIECE_BPE)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top_phrases(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (op1_size_tiered_shards, op2_media, op3_quality_rules, op4_sentencepiece, op5_simhash, op6_language_id, op7_licenses, op8_flat_ids, op9_cotraining, op10_packing, op11_merkle, op12_alignment, op13_collocations)
}
#: SQL where it can express a query's whole result.
ORACLES: dict[str, str] = {
    "op1_size_tiered_shards": "SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256, lang, source, n_chars FROM documents",
    "op13_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\x0c\r]')) AS piece
            FROM documents),
        words AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
        f AS (
            SELECT lang, w[i : i + k - 1] AS g, k, count(*) AS a
            FROM words, unnest(range(1, len(w) + 1)) AS x(i), unnest([1, 2, 3, 4]) AS y(k)
            WHERE i + k - 1 <= len(w) GROUP BY ALL),
        totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        candidates AS (SELECT * FROM f WHERE k > 1 AND a >= 30),
        cuts AS (
            SELECT c.lang, c.g, c.k, c.a, c.cut, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a + r.a)::HUGEINT AS score
            FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
            JOIN f l ON l.lang = c.lang AND l.g = c.g[1 : c.cut] JOIN f r ON r.lang = c.lang AND r.g = c.g[c.cut + 1 : c.k]),
        lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
        inside AS (
            SELECT lang, g[i : i + m - 1] AS g, max(a) AS above
            FROM candidates, unnest(range(1, k)) AS x(i), unnest(range(2, k)) AS y(m)
            WHERE i + m - 1 <= k GROUP BY ALL),
        kept AS (SELECT t.*, array_to_string(t.g, ' ') AS phrase FROM lowest t LEFT JOIN inside s ON s.lang = t.lang AND s.g = t.g WHERE above IS NULL OR 100::HUGEINT * above < 80::HUGEINT * t.a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
        FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000""",
}
