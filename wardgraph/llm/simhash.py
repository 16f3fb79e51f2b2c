"""SimHash near-duplicates by pigeonhole blocks.

A text's words are the runs of characters other than space and \\x09-\\x0D after lower-casing A-Z. Each shingle of
``shingle`` words (repeats included; a shorter text is one shingle) is hashed with XXH64, seed 42, and a fingerprint bit is
set where more than half of the hashes have it. A null, empty or blank text has fingerprint zero and links like any other.
Fingerprints link at ``max_bits`` or fewer differing bits; a component is what links reach.

Search: the 64 bits are split into ``blocks`` blocks. Two fingerprints that differ in at most ``max_bits`` bits agree on at
least ``blocks - max_bits`` whole blocks, so they meet under one of the keys made of that many blocks. More blocks give more keys for each
fingerprint and fewer chance meetings under a key; ``fewest_comparisons`` weighs them by the number of fingerprints (6 blocks up to some
millions, then 7, and 8 from about 200 million). Any number finds the same links. Only distinct
fingerprints are searched, so copies cost nothing. A bucket is dealt out in pieces of about ``piece`` fingerprints, one task
row for each two pieces, and each emits no more than a spanning forest of its links: no link between components is lost and no
group's pairs are written out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import computed, materialise, small_batches, texts, unused
from .components import connected_components


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text. ``bytes.split`` cuts at exactly \\x20 and \\x09-\\x0D."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hashed(joined, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    view = memoryview(joined)
    values = np.array([hashed(view[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(values), 1 << 14):
        ones += np.unpackbits(values[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(values), bitorder="little").tobytes(), "little")


def _fp(text: Column, shingle: int) -> Column:
    """The fingerprint of a text column as a signed long."""
    return computed(lambda texts: pa.array(np.array([fingerprint(x, shingle) for x in texts.cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)), "long", text.cast("string"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    return texts(docs, id_col, text_col).select("doc_id", _fp(F.col("text"), shingle).alias("fp"))


def fewest_comparisons(n: int, max_bits: int, most: int = 12) -> int:
    """The number of blocks of least work for n random fingerprints: a key costs as much as 64 comparisons."""
    work = lambda blocks: comb(blocks, max_bits) * (64 + n / 2 ** (64 * (blocks - max_bits) // blocks))
    return min(range(max_bits + 2, max(max_bits + 3, most + 1)), key=work)


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """Masks of all choices of ``blocks - max_bits`` of the blocks, as signed longs."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [m - (1 << 64) if (m := reduce(int.__or__, c)) >> 63 else m for c in combinations(each, blocks - max_bits)]


def spanning_links(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints at ``max_bits`` or fewer differing bits."""
    links, left = [], fps.view(np.uint64)  # bitwise_count takes a signed number's absolute value
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= max_bits
            found, left = left[near], left[~near]
            links += [(int(at.view(np.int64)), int(x)) for x in found.view(np.int64)]
            queue.extend(found)
    return links


def links(fps: DataFrame, max_bits: int = 4, blocks: int | None = None, piece: int = 512) -> DataFrame:
    """(a, b): links between distinct fingerprints of ``fps`` (fp) that connect the same components as all links do."""
    blocks = blocks or fewest_comparisons(fps.count(), max_bits)
    masks = F.array(*[F.lit(m) for m in block_masks(blocks, max_bits)])
    keyed = fps.select("fp", F.posexplode(masks).alias("k", "mask")).select(F.col("k").cast("short").alias("k"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    sizes = materialise(keyed.groupBy("k", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "buckets")
    pairs = sizes.where(F.col("n") == 2).select("a", "b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)

    dealt = (
        keyed.join(sizes.where("n > 2").select("k", "key", F.ceil(F.col("n") / piece).cast("int").alias("g")), ["k", "key"])
        .withColumn("c", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
        .select("k", "key", "fp", "c", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("d"))
        .groupBy("k", "key", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"))
        .agg(F.collect_list("fp").alias("fps"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x for fp in b.column(0) for x in spanning_links(np.unique(fp.values.to_numpy()), max_bits)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    return pairs.union(dealt.select("fps").mapInArrow(run, "a long, b long"))


def _rooted(distinct: DataFrame, max_bits: int, blocks: int | None) -> DataFrame:
    """``distinct`` (a row for each fp) and the fingerprint that stands for its component, ``root``."""
    roots = materialise(connected_components(links(distinct.select("fp"), max_bits, blocks)), "roots")
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4, blocks: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 lowercase hex digits), component_id (smallest id reachable).

    An empty table gives an empty result; equal ids give equal rows as often as they occur. Null ids are reached like others but are
    no component's id, unless it has no other.
    """
    found = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    rooted = _rooted(materialise(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct"), max_bits, blocks)
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return found.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4, blocks: int | None = None) -> DataFrame:
    """Exactly one row of each component, with all its columns: the one with the smallest id (null last), of several such the one with the
    least hash of its text, of copies any one."""
    small_batches(docs.sparkSession)
    fp, row = unused(docs, "fp"), unused(docs, "row")
    table = materialise(docs.select("*", _fp(F.col(text_col), shingle).alias(fp), F.monotonically_increasing_id().alias(row)), "fingerprints")
    narrow = table.select(F.col(id_col).cast("long").alias("doc_id"), F.col(fp).alias("fp"), F.xxhash64(text_col).alias("h"), F.col(row).alias("row"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "row"))
    distinct = materialise(narrow.groupBy("fp").agg(first.alias("x")), "distinct")
    best = _rooted(distinct, max_bits, blocks).groupBy("root").agg(F.min("x").alias("x"))
    kept = materialise(best.select(F.col("x.row").alias("kept_row")), "kept")
    # rows are shuffled once, at any size of the table: what is kept grows with it, so it is no side to broadcast
    return table.join(kept.hint("merge"), table[row] == kept["kept_row"], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
