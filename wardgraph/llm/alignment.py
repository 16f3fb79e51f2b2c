"""Alignment of two tokenizers' tokens over the same bytes.

Tokenizer A is a byte-level BPE of the tokenizers library, B a SentencePiece model. A text is read as a space and the text; B puts the space there
itself. B's tokens tile the bytes, so their ends are a static interval index: two bisections give the B tokens that an A token overlaps. An offset
where an A token ends and that no B token spans is a boundary, and boundaries cut both lists into groups. A link is an A and a B token occurrence that
end at the same offset. Texts that are null, empty, or whose tokens' bytes don't join to the space and the text have no tokens.

Neither tokenizer joins tokens over a single space or newline between words (where the model of B allows that cut), and an offset there is a boundary,
so a word's groups don't depend on its neighbours: a worker aligns a word once and remembers it, within a bound. Other texts are aligned whole.

Counts of id pairs over the corpus meet the documents without a row for each link: a chunk of documents (``links`` links at most, or one document)
keeps its links as arrays and its distinct pairs with their counts. Pairs are summed over chunks, each pair learns its count and whether that is its B
id's highest, and a chunk gets back the answers for its own pairs. Nothing that grows with the corpus is broadcast or held by one task.

An empty table gives an empty result; rows with equal ids are kept apart; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, texts
from .wordcache import _OTHER, WordCachedEncoder, uneven

MARK = "▁"


def byte_alphabet() -> dict[str, int]:
    """The character by which byte-level BPE writes each byte: printable ones stand for themselves, the others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Overlaps:
    """The static index over B tokens: token k covers the bytes from ``starts[k]`` to ``ends[k]``."""

    def __init__(self, lengths: np.ndarray):
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths

    def stab(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each interval the first B token that overlaps it, and the one after the last."""
        return np.searchsorted(self.ends, starts, "right"), np.searchsorted(self.starts, ends, "left")


class Aligner:
    """``max_words`` bounds what is remembered; words of over ``max_chars`` characters never are."""

    def __init__(self, path_a: str, path_b: str, max_words: int = 400_000, max_chars: int = 48):
        import sentencepiece
        from tokenizers import Tokenizer

        self.by_word = WordCachedEncoder(path_a)
        self.a: Tokenizer = self.by_word.tokenizer
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        self.bytes_a: list[bytes] = [b""] * self.a.get_vocab_size()
        for piece, k in self.a.get_vocab(with_added_tokens=True).items():
            self.bytes_a[k] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()
        spelled = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(spelled)]
        self.lengths_a, self.lengths_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.mark = spelled.index(MARK) if MARK in spelled else None
        normal = [p for k, p in enumerate(spelled) if not (self.b.is_byte(k) or self.b.is_control(k) or self.b.is_unknown(k))]
        mixed = any(MARK in p.lstrip(MARK) or ("\n" in p and p.strip("\n")) for p in normal)
        self.cuts = not mixed and self.mark is not None and self._splits()
        self.max_words, self.max_chars = max_words, max_chars
        self.words: dict[str, tuple | None] = {}

    def _splits(self) -> bool:
        """Whether A is of the kind whose pre-tokens end before a single space, so that words can be encoded by themselves."""
        kind = json.loads(self.a.to_str()).get("pre_tokenizer") or {}
        return kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and self.a.normalizer is None

    def tokens(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a space and the text by A, and by B, which adds the space."""
        return self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)

    def _groups(self, ids_a: np.ndarray, ids_b: np.ndarray, data: bytes) -> tuple | None:
        """(ends of groups in bytes, in A tokens and in B tokens, groups as text, links as A id << 32 | B id), None if the tokens aren't ``data``."""
        if b"".join(map(self.bytes_a.__getitem__, ids_a.tolist())) != data or b"".join(map(self.bytes_b.__getitem__, ids_b.tolist())) != data:
            return None
        lengths = self.lengths_a[ids_a]
        ends = np.cumsum(lengths)
        index = Overlaps(self.lengths_b[ids_b])
        _, after = index.stab(ends - lengths, ends)
        # an A token's end is a boundary if the last B token that it overlaps ends there, too
        shut = np.flatnonzero(index.ends[after - 1] == ends)
        cuts_a, cuts_b = shut + 1, after[shut]
        a, b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        i, k, text = 0, 0, []
        for j, m in zip(cuts_a.tolist(), cuts_b.tolist(), strict=True):
            text.append(f"{a[i]}|{b[k]}" if j - i == 1 and m - k == 1 else f"{','.join(a[i:j])}|{','.join(b[k:m])}")
            i, k = j, m
        # tokens that end together: the last ones of each group
        return ends[shut], cuts_a, cuts_b, text, (ids_a[shut] << 32) | ids_b[cuts_b - 1]

    def aligned(self, ids_a: list[int], ids_b: list[int], data: bytes) -> tuple | None:
        """(A tokens, B tokens, groups, their text, links in bytes), None if the tokens aren't ``data``."""
        found = self._groups(np.array(ids_a, np.int64), np.array(ids_b, np.int64), data)
        return found and (len(ids_a), len(ids_b), len(found[3]), ";".join(found[3]), found[4].tobytes())

    def _new(self, words: list[str]) -> dict[str, tuple | None]:
        """``aligned`` of words, each after a space, or after the newline that it begins with: encoded and aligned in one run."""
        ids_a = self.by_word._new(words)
        ids_b = self.b.encode(words, num_threads=1)
        for i, w in enumerate(words):
            if w[0] == "\n":
                if ids_b[i][0] != self.mark:  # a piece of a space and a newline: not a place to cut
                    raise ValueError("the model joins spaces and newlines")
                del ids_b[i][0]
        spelled = [(w if w[0] == "\n" else " " + w).encode() for w in words]
        flat_a = np.frombuffer(b"".join([ids_a[w] for w in words]), "<u4").astype(np.int64)
        found = self._groups(flat_a, np.array([k for ids in ids_b for k in ids], np.int64), b"".join(spelled))
        if found is None:
            if len(words) == 1:
                return {words[0]: None}
            half = len(words) // 2
            return self._new(words[:half]) | self._new(words[half:])
        ends, cuts_a, cuts_b, text, links = found
        at = np.searchsorted(ends, np.cumsum([len(x) for x in spelled])).tolist()
        data, out, first, before_a, before_b = links.tobytes(), {}, 0, 0, 0
        for w, last, a, b in zip(words, at, cuts_a[at].tolist(), cuts_b[at].tolist(), strict=True):
            out[w] = (a - before_a, b - before_b, last + 1 - first, ";".join(text[first : last + 1]), data[8 * first : 8 * last + 8])
            first, before_a, before_b = last + 1, a, b
        return out

    def align(self, texts: list[str | None]) -> list[tuple | None]:
        """As ``aligned``, for each of some texts; None for those without tokens."""
        known, split, out = self.words, {}, []
        for i, text in enumerate(texts):
            if text and self.cuts and not uneven(text) and not _OTHER.search(text):
                split[i] = text.replace("\n", " \n").split(" ")
        new: dict[str, tuple | None] = {}
        missing = list({w for parts in split.values() for w in parts if w not in known})
        for k in range(0, len(missing), 20_000):
            new.update(self._new(missing[k : k + 20_000]))
        for w, found in new.items():
            if len(known) >= self.max_words:  # frequent words come early
                break
            if len(w) <= self.max_chars:
                known[w] = found
        for i, text in enumerate(texts):
            if not text:
                out.append(None)
            elif i not in split:
                out.append(self.aligned(*self.tokens(text), (" " + text).encode()))
            else:
                parts = [known[w] if w in known else new[w] for w in split[i]]
                if None in parts:
                    out.append(None)
                    continue
                n_a, n_b, n, spelled, links = zip(*parts, strict=True)
                out.append((sum(n_a), sum(n_b), sum(n), ";".join(spelled), b"".join(links)))
        return out


_ALIGNERS: dict[tuple, Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner for a Python worker, kept over its tasks."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def groups(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the groups of each text, as text (``a1,a2|b1;a3|b2,b3``), null without tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for b in batches:
            found = own.align(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x and x[3] for x in found], pa.string())], ["doc_id", "groups"])

    small_batches(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, groups string")


#: A row for each chunk: its documents' digests, their numbers of links, all links (places in ``pairs``), and the distinct pairs, ascending, with their counts.
CHUNK = "chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, n_links array<long>, links binary, pairs array<long>, counts array<long>"


def chunks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", links: int = 500_000) -> DataFrame:
    """CHUNK of the documents of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = aligner(path_a, path_b), TaskContext.get().partitionId()
        rows: list[tuple] = []
        held = number = 0

        def packed() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            pairs, places, counts = np.unique(np.frombuffer(b"".join(columns[6]), np.int64), return_inverse=True, return_counts=True)
            data = places.astype("<u2" if len(pairs) <= 1 << 16 else "<u4").tobytes()
            kinds = [pa.list_(pa.int64())] * 4 + [pa.list_(pa.string()), pa.list_(pa.int64())]
            arrays = [pa.array([list(c)], k) for c, k in zip(columns[:6], kinds, strict=True)]
            ends = [pa.array([data], pa.binary()), pa.array([pairs], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number], pa.int64()), *arrays, *ends], [x.split()[0] for x in CHUNK.split(", ")])

        for b in batches:
            for doc, found in zip(b.column(0).to_pylist(), own.align(b.column(1).to_pylist()), strict=True):
                if found is None:
                    rows.append((doc, 0, 0, 0, "", 0, b""))
                else:
                    n_a, n_b, n, spelled, data = found
                    rows.append((doc, n_a, n_b, n, hashlib.sha256(spelled.encode()).hexdigest(), len(data) // 8, data))
                    held += len(data) // 8
                if held >= links:
                    yield packed()
                    rows, held, number = [], 0, number + 1
        if rows:
            yield packed()

    small_batches(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInArrow(run, CHUNK)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): links of each id pair (A id << 32 | B id) in all chunks, and whether no pair of its B id has more."""
    summed = found.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n"))
    totals = materialise(summed.withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))), "pairs")
    highest = totals.groupBy("b").agg(F.max("n").alias("most"))
    return totals.join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", links: int = 500_000) -> DataFrame:
    """ALIGNED, a row for each document: tokens, groups and links; links whose pair is its B id's most frequent in the corpus (ties
    included); the sum of the links' pair counts; SHA-256 of the groups, '' without tokens."""
    found = materialise(chunks(docs, path_a, path_b, id_col, text_col, links), "chunks")
    totals = materialise(pair_counts(found), "counts")
    asked = found.select("chunk", F.explode("pairs").alias("pair"))
    # sides of these joins grow with the corpus, so they are shuffled at every size
    answers = asked.join(totals.hint("merge"), "pair").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("pair", "n", "best"))).alias("x"))
    # a chunk's answers, in the order of its pairs; none where it has no links
    given = found.drop("pairs", "counts").join(answers.select("chunk", F.col("x.n").alias("n"), F.col("x.best").alias("best")).hint("merge"), "chunk", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(k, 1) for k in range(batch.num_rows)):
                column = lambda name: b.column(b.schema.get_field_index(name))[0].values  # noqa: E731, B023
                sizes = column("n_links").to_numpy()
                edges = np.concatenate(([0], np.cumsum(sizes)))
                n_best = total = np.zeros(len(sizes), np.int64)
                if edges[-1]:
                    counts, best = column("n").to_numpy(), column("best").to_numpy(zero_copy_only=False)
                    at = np.frombuffer(b.column(b.schema.get_field_index("links"))[0].as_py(), "<u2" if len(counts) <= 1 << 16 else "<u4")
                    n_best, total = (np.diff(np.concatenate(([0], np.cumsum(x[at], dtype=np.int64)))[edges]) for x in (best, counts))
                yield pa.RecordBatch.from_arrays(
                    [column("doc_id"), column("n_a"), column("n_b"), column("n_groups"), column("n_links"), pa.array(n_best), pa.array(total), column("groups_sha256")],
                    [x.split()[0] for x in ALIGNED.split(", ")],
                )

    small_batches(docs.sparkSession, 4)
    return given.mapInArrow(run, ALIGNED)
