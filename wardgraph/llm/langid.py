"""Language identification by cross-parsing entropy.

For each language a bounded sample of labelled text is joined and normalised, and its suffix automaton built. A text is
parsed against each automaton into phrases: from a phrase's start the longest match with the labelled text, then the next
phrase. A language costs phrases * log2(length of its labelled text); the language with the least cost wins, ties by name.

Normalising: lower case, every run of characters other than letters is one space, and the rest is spelled in UTF-8. Automata run over bytes, so
letters of all scripts keep apart; bytes that no sample holds share one code. Long texts are parsed in blocks of ``block`` bytes, each
starting a phrase of its own, so that many blocks are parsed side by side.

A null text, or one without a letter, is ``und`` with score 0. The score is the least cost's margin to the next:
1 - least / next, or 1 where only one language is known. Rows with a null language teach nothing; if no row teaches, all are ``und``.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import computed, materialise, small_batches

SPACE, OTHER = 0, 1
_GAP = ord(" ")


class Model(NamedTuple):
    """langs: name and normalised text of each; a worker builds the automata."""

    langs: list[tuple[str, bytes]]


_LETTERS: np.ndarray | None = None


def normalised(text: str) -> bytes:
    """Letters in lower case as UTF-8, a space for each run of anything else between them."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    letter = _LETTERS[c]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of other characters, those after a letter stay, as a space
    return np.where(letter, c, _GAP)[keep].astype("<u4").tobytes().decode("utf-32-le").encode().strip(b" ")


def symbols(model: Model) -> np.ndarray:
    """The code of each byte: SPACE, OTHER, or one of its own if a sample holds it."""
    seen = np.zeros(256, bool)
    for _, text in model.langs:
        seen[np.frombuffer(text, np.uint8)] = True
    seen[_GAP] = False
    table = np.full(256, OTHER, np.uint8)
    table[_GAP] = SPACE
    table[seen] = np.arange(2, 2 + seen.sum(), dtype=np.uint8)  # UTF-8 has fewer than 254 bytes
    return table


def suffix_automaton(s: list[int], alphabet: int) -> np.ndarray:
    """Rows of transitions, -1 where there is none; row 0 is the start. It accepts exactly the substrings of s."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in s:
        cur = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(moves)
                moves.append(moves[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.full((len(moves), alphabet), -1, np.int32)
    for i, m in enumerate(moves):
        table[i, list(m.keys())] = list(m.values())
    return table


def width_of(codes: int) -> int:
    """A power of two that holds the codes."""
    return 1 << max(1, (codes - 1).bit_length())


def parse_table(automaton: np.ndarray) -> np.ndarray:
    """For state * width + code: the next state * width, plus 1 if a phrase starts with this byte. The width is that of the codes."""
    states, codes = automaton.shape
    width = width_of(codes)
    out = np.zeros((states, width), np.int32)
    start = np.where(automaton[0] >= 0, automaton[0], 0)  # a byte never seen is a phrase by itself
    out[:, :codes] = np.where(automaton >= 0, automaton * width, start * width + 1)
    out[:, codes:] = 1
    out[0] |= 1  # nothing matched so far: the next byte starts a phrase
    return out.reshape(-1)


def count_phrases(blocks: list[np.ndarray], tables: list[np.ndarray], width: int) -> np.ndarray:
    """Phrases of each block (rows) in each language (columns)."""
    lengths = np.array([len(b) for b in blocks], np.int64)
    order = np.argsort(-lengths, kind="stable")
    grid = np.zeros((len(blocks), int(lengths.max(initial=0))), np.uint8)
    for row, i in enumerate(order):
        grid[row, : lengths[i]] = blocks[i]
    grid = np.ascontiguousarray(grid.T)
    active = np.searchsorted(-lengths[order], -np.arange(len(grid)), side="left")  # blocks longer than t
    out = np.zeros((len(blocks), len(tables)), np.int64)
    for j, table in enumerate(tables):
        state, phrases = np.zeros(len(blocks), np.int32), np.zeros(len(blocks), np.int32)
        for row, n in zip(grid, active.tolist(), strict=True):
            s = state[:n]
            np.bitwise_and(s, -width, out=s)
            s += row[:n]
            np.take(table, s, out=s, mode="clip")
            phrases[:n] += s & 1
        out[order, j] = phrases
    return out


def _sampled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train: Column, rows: int, window: int) -> DataFrame:
    """(lang, h, text): of at most ``rows`` different labelled rows of each language a window of at most ``window`` characters, both chosen by a hash.
    Rows whose text is null or has no letter aren't counted."""
    lang = F.col(lang_col).cast("string").alias("lang")
    text = F.col(text_col).cast("string")
    # only rows that can teach count, and equal rows of an id once: a repeated row neither fills a sample nor thins it
    named = docs.where(train & F.col(lang_col).isNotNull() & text.rlike(r"\p{L}")).select(lang, F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), text.alias("text"))
    # of the 10,000 largest languages few rows pass a first filter; those, hot ids among them, are ranked in every task before the shuffle
    sizes = named.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).where(F.col("n") > 4 * rows).orderBy(F.desc("n"), "lang").limit(10_000)
    few = F.pmod("h", F.lit(1 << 30)) <= (4.0 * rows * (1 << 30)) / F.coalesce("n", F.lit(1))
    k = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.ceil(F.length("text") / window), F.lit(1))).cast("int")
    found = named.join(F.broadcast(sizes), "lang", "left").where(few).select("lang", "h", F.substring("text", k * window + 1, F.lit(window)).alias("text"))
    once = found.groupBy("lang", "h").agg(F.min("text").alias("text"))
    return once.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= rows).drop("r")


def train_model(docs: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = 200, window: int = 500, size: int = 30_000, total: int = 1_000_000) -> Model:
    """The sample is bounded: of ``rows`` rows of a language a window of ``window`` characters each, ``size`` bytes of a language after
    normalising, and ``total`` bytes of all (each language gets its share). So the model has at most ``total`` bytes in the driver and in
    the broadcast; a worker's automata take 512 times as much for one alphabet, at most 2,048 times for many scripts."""
    train = F.lit(True) if train is None else train
    sample = materialise(_sampled(docs, id_col, text_col, lang_col, train, rows, window), "sample")
    size = min(size, max(1, total // max(1, sample.select("lang").distinct().count())))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [normalised(x) for x in pdf.sort_values(["h", "text"])["text"]]
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "sample": [b" ".join([x for x in parts if x])[:size]]})

    built = materialise(sample.groupBy("lang").applyInPandas(build, "lang string, sample binary"), "samples").where("octet_length(sample) > 0").orderBy("lang").collect()
    return Model([(r["lang"], bytes(r["sample"])) for r in built])


_READY: dict[str, tuple[np.ndarray, list[np.ndarray], int]] = {}


def predictor(model: Model, key: str, block: int = 512):
    """A function from texts to (language, score) pairs; its automata are built once for each ``key`` in a worker."""
    if key not in _READY:
        _READY.clear()
        code = symbols(model)
        codes = int(code.max()) + 1
        tables = [parse_table(suffix_automaton(code[np.frombuffer(text, np.uint8)].tolist(), codes)) for _, text in model.langs]
        _READY[key] = code, tables, width_of(codes)
    code, tables, width = _READY[key]
    weights = np.array([np.log2(max(len(text), 2)) for _, text in model.langs])

    def predict(texts: list[str | None]) -> list[tuple[str, float]]:
        blocks, owner = [], []
        for i, t in enumerate(texts):
            c = code[np.frombuffer(normalised(t or ""), np.uint8)]
            blocks += [c[k : k + block] for k in range(0, len(c), block)]
            owner += [i] * (len(blocks) - len(owner))
        if not blocks or not tables:
            return [("und", 0.0)] * len(texts)
        cost = np.zeros((len(texts), len(tables)))
        np.add.at(cost, owner, count_phrases(blocks, tables, width) * weights)
        out = []
        for row in cost:
            best = int(row.argmin())
            rest = np.delete(row, best)
            out.append((model.langs[best][0], 1 - row[best] / rest.min() if len(rest) else 1.0) if row[best] else ("und", 0.0))
        return out

    return predict


def predicted(docs: DataFrame, model: Model, text: Column) -> Column:
    """A struct of lang_pred and score, predicted from ``text`` alone, for a row of ``docs``."""
    spark = docs.sparkSession
    sent, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex  # bounded: train_model's ``total``

    def run(texts: pa.Array) -> pa.Array:
        found = predictor(sent.value, key)(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([float(x[1]) for x in found], pa.float64())], ["lang_pred", "score"])

    small_batches(spark)
    return computed(run, "lang_pred string, score double", text.cast("string"))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id of each row with lang_pred and score. Only the text is read for a prediction."""
    return docs.select(F.col(id_col), predicted(docs, model, F.col(text_col)).alias("p")).select(id_col, "p.lang_pred", "p.score")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that teach nothing: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
