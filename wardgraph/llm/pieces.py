"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model file is compiled into three parts that are composed with an input lazily:

* the normaliser maps characters to characters: a space to U+2581, with one put before the text, and, where the model asks
  for it, runs of spaces to one;
* the lexicon maps a piece's characters to its id, or the UTF-8 bytes of a character without a piece to byte pieces (or the unknown id);
* for a BPE model, the pair acceptor gives weight 0 to two neighbouring pieces if merging their joined text yields just these
  two, else infinity. A segmentation is the one that merging yields exactly if each piece yields itself and all neighbours are accepted.
  For a unigram model there is no pair acceptor, and a piece weighs its negated score.

The encoding is the shortest path from start to end in the tropical semiring (weights add along a path, the least wins).
Pieces that mix other characters before U+2581 are rare; if a model has none, paths can be cut there, and words remembered.

A null text is empty, and an empty text has no pieces. Decoding gives the text back unless it contains U+2581, which reads as a space
(as does SentencePiece). Models with a compiled character map or user-defined or unused pieces are refused.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, texts
from .wordcache import uneven

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK = "▁"
_NO_PIECE: tuple[int, dict] = (-1, {})


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protocol-buffer message."""

    def number(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            byte = data[at]
            out |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return out, at

    at = 0
    while at < len(data):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            size, at = {1: (8, at), 5: (4, at)}[key & 7] if key & 7 in (1, 5) else number(at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Transducer:
    """``pairs`` and ``words`` bound what is remembered."""

    def __init__(self, model: bytes, pairs: int = 400_000, words: int = 800_000):
        fields = list(wire(model))
        trainer = dict(wire(next((v for k, v in fields if k == 2), b"")))
        normaliser = dict(wire(next((v for k, v in fields if k == 3), b"")))
        if normaliser.get(2):
            raise ValueError("models with a compiled character map are not supported")
        self.kind = trainer.get(3, UNIGRAM)
        self.prefix, self.squeeze = bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1))
        if self.kind not in (UNIGRAM, BPE) or not normaliser.get(5, 1):
            raise ValueError("only BPE and unigram models that escape spaces are supported")
        self.text, self.ids, self.scores, self.bytes, self.unknown = [], {}, [], {}, 0
        self.out: list[bytes] = []  # what an id decodes to
        for i, piece in enumerate(dict(wire(v)) for k, v in fields if k == 1):
            text, kind = piece[1].decode(), piece.get(3, NORMAL)
            self.text.append(text)
            self.scores.append(float(np.frombuffer(piece[2], "<f4")[0]) if 2 in piece else 0.0)
            self.out.append(b"" if kind == CONTROL else text.replace(MARK, " ").encode())
            if kind == NORMAL:
                self.ids[text] = i
            elif kind == BYTE:
                self.bytes[int(text[3:5], 16)] = i
                self.out[i] = bytes([int(text[3:5], 16)])
            elif kind == UNKNOWN:
                self.unknown = i
                self.out[i] = " ⁇ ".encode()
            elif kind != CONTROL:
                raise ValueError("user-defined and unused pieces are not supported")
        self.lexicon: dict[str, tuple] = {}  # by character: the id of the piece so far, or -1, and how pieces go on
        for t, i in sorted(self.ids.items()):  # prefixes first
            kids = self.lexicon
            for c in t[:-1]:
                kids = kids.setdefault(c, (-1, {}))[1]
            kids[t[-1]] = (i, {})
        self.penalty = 10 - min((self.scores[i] for i in self.ids.values()), default=0.0)
        mixed = [t for t in self.ids if re.search(f"[^{MARK}]{MARK}", t)]
        spelled = lambda c: bool(self.bytes) or c in self.ids  # noqa: E731  else it may be one unknown with its neighbours
        breaks = "" if any("\n" in t and t.strip("\n") for t in self.ids) or not spelled("\n") else "\n"
        self.cut = None if mixed or not spelled(MARK) else re.compile(f"{MARK}*[^{MARK}{breaks}]+|{MARK}+" + f"|{breaks}+" * bool(breaks))
        self.simple = self.cut is not None and bool(breaks)
        self.width = "<u2" if len(self.text) <= 1 << 16 else "<u4"
        self.most_pairs, self.most_words = pairs, words
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}

    # normaliser

    def normalised(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return (MARK * (self.prefix and bool(text))) + text.replace(" ", MARK)

    # pair acceptor

    def merged(self, text: str) -> list[str]:
        """The pieces that merging yields: of all neighbours whose joined text is a piece, the best scored, leftmost first."""
        parts = list(text)
        while True:
            best = None
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best[0]):
                    best = (self.scores[i], k)
            if best is None:
                return parts
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def accepts(self, a: str, b: str) -> bool:
        """Whether ``b`` may follow ``a``; an empty ``a`` is the start."""
        return self.merged(a + b) == ([a, b] if a else [b])

    # composition and shortest path

    def path(self, s: str) -> list[int]:
        """Ids of the least path over a normalised string."""
        n, size = len(s), len(self.text)
        # of the least path to a place its last arc: where it starts; its id, or size + code point of a character without a piece
        start, last = self._arcs(s)
        out: list[int] = []
        j = n
        while j:
            k = last[j]
            if k < size:
                out.append(k)
            elif self.bytes:
                out += [self.bytes[x] for x in reversed(chr(k - size).encode())]
            elif not (out and out[-1] == self.unknown):  # neighbours without a piece are one unknown
                out.append(self.unknown)
            j = start[j]
        return out[::-1]

    def _arcs(self, s: str) -> tuple[list[int], list[int]]:
        """The last arc of the least path to each place, by relaxing arcs from left to right. For a BPE model weights are nothing or infinite, so a path of
        weight 0 can't be bettered: arcs to places that have one, and those after the end has one, aren't weighed."""
        n, size, root, pairs, scores = len(s), len(self.text), self.lexicon, self.pairs, self.scores
        bpe, penalty, infinite = self.kind == BPE, self.penalty, math.inf
        least = [0.0] + [infinite] * n
        start, last = [0] * (n + 1), [-1] * (n + 1)
        for i in range(n):
            so_far = least[i]
            if so_far == infinite:
                continue
            if bpe and least[n] == 0:
                break
            before, kids, j = (last[i] + 1) << 24, root, i
            while j < n:
                c = s[j]
                j += 1
                k, kids = kids.get(c, _NO_PIECE)
                fallback = k < 0 and j == i + 1
                if fallback:
                    k = size + ord(c)
                if k >= 0:
                    if not bpe:
                        weight = so_far + (penalty if fallback else -scores[k])
                    elif least[j] == 0:
                        weight = infinite
                    else:
                        follows = pairs.get(before | k)
                        if follows is None:
                            follows = self._follows(last[i], k)
                        weight = so_far if follows else infinite
                    if weight < least[j]:
                        least[j], start[j], last[j] = weight, i, k
                if not kids:  # no piece goes on like this
                    break
        return start, last

    def _follows(self, a: int, b: int) -> bool:
        spelled = ["" if k < 0 else self.text[k] if k < len(self.text) else chr(k - len(self.text)) for k in (a, b)]
        if len(self.pairs) >= self.most_pairs:
            self.pairs.clear()
        known = self.pairs[((a + 1) << 24) | b] = self.accepts(*spelled)
        return known

    def _spell(self, parts: list[str]) -> bytes:
        return array("H" if self.width == "<u2" else "I", [k for p in parts for k in self.path(p)]).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian integers of ``width``."""
        if not text:
            return b""
        if not self.simple or not self.prefix or MARK in text or uneven(text):
            s = self.normalised(text)
            return self._spell(self.cut.findall(s) if self.cut else [s])
        words, out = self.words, []
        for w in text.replace("\n", " \n").split(" "):
            ids = words.get(w)
            if ids is None:
                ids = self._spell(["\n", w[1:]] if w[0] == "\n" else [MARK + w])
                if len(w) <= 48 and len(words) < self.most_words:  # frequent words come early
                    words[w] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.out.__getitem__, ids)).decode(errors="replace")
        return text[1:] if self.prefix and text[:1] == " " else text


_COMPILED: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    """One transducer for a Python worker, kept over its tasks."""
    if path not in _COMPILED:
        with open(path, "rb") as f:
            _COMPILED[path] = Transducer(f.read())
    return _COMPILED[path]


DIGESTS = "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean"


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids of each text (array of int)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.frombuffer(t.encode(x or ""), t.width).astype(np.int32) for x in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    small_batches(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of each array of ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else t.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    small_batches(encoded.sparkSession)
    return encoded.selectExpr(f"`{id_col}` doc_id", f"`{ids_col}` ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """DIGESTS of each text's ids (as unsigned 32-bit integers) and of what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(model_path)
        is_byte = np.zeros(len(t.text), bool)
        is_byte[list(t.bytes.values())] = True
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                ids = np.frombuffer(t.encode(text or ""), t.width)
                back = t.decode(ids.tolist())
                rows.append((len(ids), int(is_byte[ids].sum()), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(back.encode()), back == (text or "")))
            if rows:
                kinds = [pa.int64()] * 4 + [pa.bool_()]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], [x.split()[0] for x in DIGESTS.split(", ")])

    small_batches(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInArrow(run, DIGESTS)
