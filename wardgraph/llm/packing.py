"""Best-fit packing of token sequences by hierarchical residual packing.

Every text is encoded (a null text is empty) and gets the end id. A text of over ``capacity`` tokens is cut into pieces of
``capacity``, of which the first may be shorter. Pieces are packed whole into sequences of at most ``capacity`` tokens:

* round 0: each task packs its rows, ``block`` at a time, largest first, each into the fullest bin that holds it;
* bins with at most ``slack`` tokens free are final; the others become items of the next round, which merges what several
  tasks left over into fewer tasks and packs again;
* rounds end when one task has packed all that was left, or when a round no longer joins ``least_gain`` of its items.

No task gets more than about ``block`` items at a time, and pieces themselves move only once: later rounds move (bin, length) alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, texts
from .wordcache import WordCachedEncoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a text of n tokens; only the first may be shorter than the capacity."""
    first = n - capacity * (math.ceil(n / capacity) - 1)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and each bin's length: best fit, largest first."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    filled: list[int] = []
    free: dict[int, list[int]] = {}  # bins by free tokens
    mask = 0  # bit r is set if a bin has r tokens free
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        if fits := mask >> size:
            room = size + (fits & -fits).bit_length() - 1
            at = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, at = capacity, len(filled)
            filled.append(0)
        where[i], offset[i] = at, filled[at]
        filled[at] += size
        if left := room - size:
            free.setdefault(left, []).append(at)
            mask |= 1 << left
    return where, offset, np.array(filled, np.int64)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordCachedEncoder.of(tokenizer_path)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encoder.encode(text or "") + end
                rows += [(doc, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInArrow(run, PIECES)


def _packed(items: DataFrame, turn: int, capacity: int, block: int, keep: list[str]) -> DataFrame:
    """``items`` (with a length) in bins: the columns ``keep``, then bin, offset and filled, the bin's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (turn << 56) | (TaskContext.get().partitionId() << 34)
        held: list[pa.RecordBatch] = []

        def pack() -> pa.RecordBatch:
            nonlocal base
            t = pa.Table.from_batches(held).combine_chunks()
            where, offset, filled = best_fit(t["length"].to_numpy(), capacity)
            out = [*(t[c].combine_chunks() for c in keep), pa.array(where + base), pa.array(offset), pa.array(filled[where])]
            base += len(filled)
            held.clear()
            return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in out], [*keep, "bin", "offset", "filled"])

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= block:
                yield pack()
        if held:
            yield pack()

    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    return items.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "bin long, offset long, filled long"]))


def pack(pieces: DataFrame, capacity: int = 2048, block: int = 1 << 16, slack: int = 16, least_gain: float = 0.01) -> DataFrame:
    """``pieces`` (columns of PIECES) with sequence_id and offset."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    first = materialise(_packed(pieces, 0, capacity, block, columns), "bins")
    underfull = F.col("filled") < capacity - slack
    left = first.where(underfull).groupBy("bin").agg(F.first("filled").alias("length"))
    moved = None  # (bin of round 0, its sequence so far, its offset there)
    turn = 0
    left = materialise(left.select("bin", "length"), "left")
    while (n := left.count()) > 1 and turn < 100:
        turn += 1
        tasks = math.ceil(n / block)
        now = materialise(_packed(left.repartition(tasks, "bin").withColumnRenamed("bin", "old"), turn, capacity, 2 * block, ["old"]).withColumnRenamed("offset", "at"), "bins")
        step = now.select("old", F.col("bin").alias("new"), "at")
        if moved is None:
            moved = step.select(F.col("old").alias("origin"), "new", "at")
        else:
            moved = moved.join(step.select(F.col("old").alias("new"), F.col("new").alias("newer"), F.col("at").alias("more")), "new", "left").select(
                "origin", F.coalesce("newer", "new").alias("new"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("at")
            )
        moved = materialise(moved, "moved")
        left = materialise(now.where(underfull).groupBy("bin").agg(F.first("filled").alias("length")).select("bin", "length"), "left")
        bins = now.agg(F.count_distinct("bin")).first()[0]
        if tasks == 1 or bins > (1 - least_gain) * n:
            break
    done = first.where(~underfull).select(*columns, F.col("bin").alias("sequence_id"), "offset")
    rest = first.where(underfull)
    if moved is None:
        return done.union(rest.select(*columns, F.col("bin").alias("sequence_id"), "offset"))
    rest = rest.join(moved.withColumnRenamed("origin", "bin"), "bin", "left").select(*columns, F.coalesce("new", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("at", F.lit(0))).alias("offset"))
    return done.union(rest)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", block: int = 1 << 16, slack: int = 16) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of each row of ``docs``.

    An empty table gives an empty result; a null text is empty (one end id); equal ids are packed as often as they occur.
    """
    pieces = materialise(token_pieces(docs, tokenizer_path, capacity, 0, id_col, text_col), "pieces")
    return pack(pieces, capacity, block, slack)
