"""Token ids in flat binary files.

A store is a folder of parts. A part has three files: ``.ids`` (unsigned 16-bit or 32-bit little-endian ids, by the size of
the vocabulary), ``.off`` (64-bit offsets of the documents in it, one more than there are documents) and ``.doc`` (64-bit
document ids, and last how many of the first ones are null). Documents ascend by id within a part and from part to part. A part's base, the number of ids in all parts
before it, is the prefix sum of the parts' lengths. Readers map a part's ids into memory where the store is local, and elsewhere
read them by ranges of documents.

Rows with a null id come first and are read back with a null id; a null text is empty, so it has the end id only; rows with
equal ids are all kept, in no particular order, over as many parts as they need.
Executors open the folder with pyarrow (file, hdfs, s3 or s3a, gs, abfs).
A task writes under a name of its own and renames when complete, so a task that runs twice leaves one part in the manifest.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, scratch, small_batches, texts
from .wordcache import WordCachedEncoder

NULL_ID = -(1 << 63)  # stands for null in a part's first rows, as many as its file of ids ends with
MANIFEST = "first_id long, last_id long, name string, width int, docs long, tokens long"


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))


def write_flat(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes ``docs`` into parts below ``folder`` and returns their manifest: MANIFEST and base."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordCachedEncoder.of(tokenizer_path)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()
        ids, ends, stream, name, nulls = array("q"), array("q", [0]), None, "", 0
        where, root = opened(folder)
        for b in batches:
            if b.num_rows and stream is None:
                name = uuid.uuid4().hex
                where.create_dir(root, recursive=True)
                stream = where.open_output_stream(f"{root}/_{name}.ids")
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = encoder.encode(text or "") + end
                stream.write(own if width == 4 else np.frombuffer(own, "<u4").astype("<u2").tobytes())
                ids.append(NULL_ID if doc is None else doc)
                nulls += doc is None  # they come first
                ends.append(ends[-1] + len(own) // 4)
        if stream is None:
            return
        stream.close()
        for kind, values in (("off", np.array(ends, "<i8")), ("doc", np.array([*ids, nulls], "<i8"))):
            with where.open_output_stream(f"{root}/_{name}.{kind}") as out:
                out.write(values.tobytes())
        for kind in ("off", "doc", "ids"):
            where.move(f"{root}/_{name}.{kind}", f"{root}/{name}.{kind}")
        kinds = pa.schema([("first_id", pa.int64()), ("last_id", pa.int64()), ("name", pa.string()), ("width", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64())])
        yield pa.RecordBatch.from_pylist([{"first_id": ids[0], "last_id": ids[-1], "name": name, "width": width, "docs": len(ids), "tokens": ends[-1]}], kinds)

    small_batches(docs.sparkSession)
    # of one id, rows are dealt out by what is else known of them, copies by their place in the input
    rows = texts(docs, id_col, text_col).withColumns({"h": F.xxhash64("text"), "at": F.monotonically_increasing_id()})
    ranged = rows.repartitionByRange("doc_id", "h", "at").sortWithinPartitions("doc_id").select("doc_id", "text")
    parts = materialise(ranged.mapInArrow(run, MANIFEST), "manifest")
    before = Window.orderBy("first_id", "last_id", "name").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part, not for each document
    return parts.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def ranges(where: fs.FileSystem, path: str, kind: str) -> Callable[[int, int], np.ndarray]:
    """A function that gives a file's integers from one place to another: of a map into memory if the file system is local, else read at its place."""
    if isinstance(where, fs.LocalFileSystem):
        whole = np.memmap(path, dtype=kind, mode="r")
        return lambda start, end: whole[start:end]
    file, size = where.open_input_file(path), np.dtype(kind).itemsize
    return lambda start, end: np.frombuffer(file.read_at((end - start) * size, start * size), kind)


def read_flat(manifest: DataFrame, folder: str, batch: int = 1024) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as unsigned 32-bit integers) of each document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = opened(folder)
        for part in (x for b in batches for x in b.to_pylist()):
            at = f"{root}/{part['name']}"
            offsets, docs, ids = ranges(where, f"{at}.off", "<i8"), ranges(where, f"{at}.doc", "<i8"), ranges(where, f"{at}.ids", f"<u{part['width']}")
            nulls = int(docs(part["docs"], part["docs"] + 1)[0])
            for k in range(0, part["docs"], batch):
                end = min(k + batch, part["docs"])
                edges, own = np.asarray(offsets(k, end + 1)), np.asarray(docs(k, end))
                sums = [zlib.crc32(ids(s, e).astype("<u4").tobytes()) for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64(), mask=np.arange(k, end) < nulls), pa.array(edges[:-1] + part["base"]), pa.array(np.diff(edges)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def flat_round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes a store in the shared folder and reads every document back from it. An empty table gives an empty result."""
    folder = scratch(spark, "flat")
    parts = materialise(write_flat(docs, tokenizer_path, folder, 0, id_col, text_col), "parts")
    return read_flat(parts.repartition(max(1, parts.count())), folder)
