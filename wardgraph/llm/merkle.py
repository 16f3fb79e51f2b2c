"""Document fingerprints: a Merkle tree over sections, paragraphs and runs of words.

A text's UTF-8 bytes are cut without loss into leaves. A paragraph is a line with its line feed. A section ends before a line that follows a blank
line, or before a heading (a line that begins with #). Within a paragraph a leaf ends where a hash of the eight bytes before it is a multiple
of ``MEAN``, so the cuts depend on what stands there alone and fall into step again after an edit. A leaf's hash is BLAKE2b of its bytes, an inner
node's that of its level and its children's hashes; the root's, in hex, is the fingerprint. Equal texts have equal roots, and different ones differ.

Two trees are compared from the root down: equal hashes end the descent with the whole branch shared, and differing branches are
followed to the leaves, which locate the edit. Branches are matched as often as both hold them, wherever they stand, so a moved paragraph is shared.
Likeness is the share of characters in shared branches: 2 * shared / (characters of both), and 1 for two empty texts.

A null text is empty: its tree is a root alone. Rows are kept as often as they occur. Only the id and the text columns are read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches, texts

MEAN, WINDOW = 24, 8
SECTION, PARAGRAPH, LEAF = 1, 2, 3
_ODD = np.uint64(0x9E3779B97F4A7C15)
TREE = "array<struct<level: tinyint, chars: long, hash: binary>>"


class Node(NamedTuple):
    hash: bytes
    chars: int
    children: list


def _hash(data: bytes, size: int = 16) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def _joined(level: int, children: list[Node], size: int = 16) -> Node:
    return Node(_hash(bytes([level]) + b"".join([c.hash for c in children]), size), sum([c.chars for c in children]), children)


def _cuts(b: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where leaves, paragraphs and sections start, and the end of the text after each."""
    n = len(b)
    lines = np.concatenate(([0], np.flatnonzero(b[:-1] == 10) + 1))
    inner = np.zeros(0, np.int64)
    if n > WINDOW:
        windows = np.ndarray((n - WINDOW,), "<u8", data, 0, (1,))
        inner = np.flatnonzero(((windows * _ODD) >> np.uint64(40)) % np.uint64(MEAN) == 0) + WINDOW
        inner = inner[(b[inner] & 0xC0) != 0x80]  # characters stay whole
        inner = inner[inner - lines[np.searchsorted(lines, inner, "right") - 1] >= WINDOW]
    after_blank = (lines >= 2) & (b[np.maximum(lines - 2, 0)] == 10) & (b[lines] != 10)
    sections = lines[(lines == 0) | after_blank | (b[lines] == 35)]
    return np.append(np.union1d(inner, lines), n), np.append(lines, n), np.append(sections, n)


def tree(text: str | None) -> Node:
    """The root of a text's tree; its hash has 32 bytes, those below have 16."""
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return _joined(0, [], 32)
    b = np.frombuffer(data, np.uint8)
    leaves, lines, sections = _cuts(b, data)
    chars = np.add.reduceat((b & 0xC0) != 0x80, leaves[:-1], dtype=np.int64).tolist()
    at = leaves.tolist()
    nodes = [Node(_hash(data[s:e]), c, []) for s, e, c in zip(at[:-1], at[1:], chars, strict=True)]
    for level, starts in ((PARAGRAPH, lines), (SECTION, sections)):
        edges = np.searchsorted(leaves, starts).tolist()
        nodes, leaves = [_joined(level, nodes[s:e]) for s, e in zip(edges[:-1], edges[1:], strict=True)], starts
    return _joined(0, nodes, 32)


def _apart(a: list[Node], b: list[Node]) -> tuple[list[bool], list[bool], int]:
    """Which nodes of each list find no partner in the other, and the characters of those that do."""
    other, own = Counter([x.hash for x in b]), Counter([x.hash for x in a])
    common = other & own
    shared, out = 0, []
    for nodes in (a, b):
        left = dict(common)
        alone = []
        for x in nodes:
            k = left.get(x.hash, 0)
            left[x.hash] = k - 1
            alone.append(k <= 0)
        out.append(alone)
    shared = sum(x.chars for x, alone in zip(a, out[0], strict=True) if not alone)
    return out[0], out[1], shared


def _shared(a: Node, b: Node) -> int:
    """Characters in branches that both trees hold."""
    total, left, right = 0, a.children, b.children
    for _ in range(LEAF):
        x, y, shared = _apart(left, right)
        total += shared
        left = [c for n, alone in zip(left, x, strict=True) if alone for c in n.children]
        right = [c for n, alone in zip(right, y, strict=True) if alone for c in n.children]
    return total


def likeness(a: Node, b: Node) -> float:
    if a.hash == b.hash:
        return 1.0
    both = a.chars + b.chars
    return 2 * _shared(a, b) / both if both else 1.0


def _spans(nodes: list[tuple[int, Node]]) -> list[tuple[int, int]]:
    """(start, end) in characters of runs of neighbouring nodes; ``nodes``: their places and themselves, ascending."""
    found: list[list[int]] = []
    for at, x in nodes:
        if found and found[-1][1] == at:
            found[-1][1] = at + x.chars
        else:
            found.append([at, at + x.chars])
    return [(s, e) for s, e in found]


def _placed(children: list[Node], at: int) -> list[tuple[int, Node]]:
    out = []
    for c in children:
        out.append((at, c))
        at += c.chars
    return out


def edits(a: Node, b: Node) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans of characters of ``a`` that ``b`` lacks, and of ``b`` that ``a`` lacks: the leaves at the ends of differing branches."""
    if a.hash == b.hash:
        return [], []
    left, right = _placed(a.children, 0), _placed(b.children, 0)
    for level in (SECTION, PARAGRAPH, LEAF):
        x, y, _ = _apart([n for _, n in left], [n for _, n in right])
        left = [n for n, alone in zip(left, x, strict=True) if alone]
        right = [n for n, alone in zip(right, y, strict=True) if alone]
        if level < LEAF:
            left, right = ([p for at, n in side for p in _placed(n.children, at)] for side in (left, right))
    return _spans(left), _spans(right)


def flattened(root: Node) -> list[dict]:
    """The nodes below the root, each before its children, as TREE holds them."""
    out = []
    for s in root.children:
        out.append({"level": SECTION, "chars": s.chars, "hash": s.hash})
        for p in s.children:
            out.append({"level": PARAGRAPH, "chars": p.chars, "hash": p.hash})
            out += [{"level": LEAF, "chars": x.chars, "hash": x.hash} for x in p.children]
    return out


def rebuilt(nodes: list[dict]) -> Node:
    sections: list[Node] = []
    for n in nodes:
        where = sections if n["level"] == SECTION else sections[-1].children if n["level"] == PARAGRAPH else sections[-1].children[-1].children
        where.append(Node(n["hash"], n["chars"], []))
    return _joined(0, sections, 32)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint and tree (TREE) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("level", pa.int8()), ("chars", pa.int64()), ("hash", pa.binary())]))
        for b in batches:
            roots = [tree(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.chars for r in roots], pa.int64()), pa.array([r.hash.hex() for r in roots], pa.string()), pa.array([flattened(r) for r in roots], kind)], ["doc_id", "n_chars", "fingerprint", "tree"])

    small_batches(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInArrow(run, f"doc_id long, n_chars long, fingerprint string, tree {TREE}")


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, likeness, removed and added (spans of characters of the old and the new text) for each pair of rows of two results of
    ``fingerprints`` with one id. Trees whose roots agree aren't read further; null ids have no partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            ids, rows = batch.column(0), []
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if a is None:
                    rows.append((1.0, [], []))
                    continue
                x, y = rebuilt(a), rebuilt(b)
                rows.append((likeness(x, y), *([{"start": s, "end": e} for s, e in side] for side in edits(x, y))))
            yield pa.RecordBatch.from_arrays([ids, pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], spans), pa.array([r[2] for r in rows], spans)], ["doc_id", "likeness", "removed", "added"])

    same = F.col("a.fingerprint") == F.col("b.fingerprint")
    pairs = old.alias("a").join(new.alias("b"), "doc_id").select("doc_id", F.when(~same, F.col("a.tree")).alias("x"), F.when(~same, F.col("b.tree")).alias("y"))
    span = "array<struct<start: long, end: long>>"
    return pairs.mapInArrow(run, f"doc_id long, likeness double, removed {span}, added {span}")


Edit = Callable[[str, str], str]


def half_replaced(text: str, following: str) -> str:
    """The last half of a text's characters, rounded down, replaced by the first as many (or all) of the following text."""
    n = len(text)
    return text[: n - n // 2] + following[: n // 2]


REPORT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, first_edit long"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]


def _report(doc: int | None, text: str, own: Node, following: str, next_root: Node, edit: Edit) -> tuple:
    edited = edit(text, following)
    other = tree(edited)
    removed = edits(own, other)[0]
    digest = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
    return doc, len(text), digest, own.hash.hex(), other.hash.hex(), likeness(own, other), likeness(own, next_root), removed[0][0] if removed else None


def with_followers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Edit = half_replaced) -> DataFrame:
    """REPORT: each document, its text after ``edit(text, following text)``, and the likeness of its tree to the edited text's and to the following
    document's. Documents follow one another by ascending id (null first; of equal ids by a hash of the text, then by their place in the table),
    and the first follows the last. ``first_edit`` is the first character in a differing branch, null if nothing of the document is missing.

    Texts are shuffled once, by ranges of ids; a task compares neighbours as they pass. A part's last row meets the next part's
    first in a join of one row for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), None
        names = [*[x.split()[0] for x in REPORT.split(", ")], "part", "first_text", "last_text"]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [*_KINDS, pa.int32(), pa.string(), pa.string()], strict=True)], names)

        nothing = (None,) * len(_KINDS)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = text or ""
                own = tree(text)
                if before is None:
                    rows.append((*nothing, part, text, None))
                else:
                    rows.append((*_report(*before, text, own, edit), None, None, None))
                before = doc, text, own
            if rows:
                yield packed(rows)
        if before is not None:
            yield packed([(before[0], *nothing[1:], part, None, before[1])])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_report(doc, text, tree(text), following, tree(following), edit) for doc, text, following in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], [x.split()[0] for x in REPORT.split(", ")])

    small_batches(docs.sparkSession)
    rows = texts(docs, id_col, text_col).withColumns({"h": F.xxhash64("text"), "at": F.monotonically_increasing_id()})
    ranged = rows.repartitionByRange("doc_id", "h", "at").sortWithinPartitions("doc_id", "h", "at").select("doc_id", "text")
    found = materialise(ranged.mapInArrow(run, f"{REPORT}, part int, first_text string, last_text string"), "neighbours")
    names: list[Column] = [F.col(x.split()[0]) for x in REPORT.split(", ")]
    firsts, lasts = found.where("first_text is not null").select("part", "first_text"), found.where("last_text is not null").select("doc_id", "part", "last_text")
    order = Window.orderBy("part")  # a number for each part
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = firsts.select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(whole)).alias("next_part"))
    pairs = lasts.join(following, "part").join(firsts.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "last_text", "first_text")
    return found.where("part is null").select(*names).union(pairs.mapInArrow(ends, REPORT))
