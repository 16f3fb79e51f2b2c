"""Phrase collocations by a minimal perfect hash over Apriori-safe candidates.

Words are the runs of characters other than space and tab within pieces, and pieces are what ``.,;:!?`` and the control characters \\x0A-\\x0D leave; A-Z
are lower-cased. Everything is counted within a language (null: ``und``). A phrase is 2 to ``longest`` words of one piece; candidates are
phrases found ``least`` times or more, overlaps included. So both phrases that a candidate is without its last and its first word are found as often, and
a candidate of n words is spelled by the numbers of those two: an exact 64-bit key. Words are spelled by a hash and compared as text.

1. Words are counted, and frequent ones dealt by hash into blocks of bounded size. Each block's task builds a minimal perfect hash with the keys stored by slot.
2. Mappers turn texts into arrays of word numbers, chunk by chunk, 0 where a piece ends or a word is rare.
3. For each length, neighbouring numbers that are both frequent are the next candidates' keys. A chunk sends its distinct keys to their blocks, with counts
   that stop at ``least``, so a block knows which keys can be candidates. It builds their perfect hash.
4. Mappers look each place's key up, block by block, compare it with the stored one, bincount the slots, and keep the slot as the place's new number. The
   counts of chunks are summed as a tree, sixteen arrays at a time.
5. A phrase's parts are read by their numbers, so each cut's counts are those of its parts.

A block is written in the shared folder; workers hold a bounded number of blocks. A chunk has at most about ``chunk`` words more than one text. Numbers of
phrases of one length are 32-bit: more than four thousand million frequent phrases of a length raise an error. Null and empty texts have no words; an empty
table has no phrases; repeated rows count as often as they occur; other columns aren't read.
"""

from __future__ import annotations

import pickle
from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, scratch, small_batches
from .flatids import opened
from .perfecthash import PerfectHash, mixed

_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes(10 if c in _ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
PART = b"\n"


def tokens(texts: list[bytes | None]) -> list[bytes]:
    """Words of the texts, PART between pieces and texts, and empty strings, which mean nothing."""
    return PART.join([(t or b"").translate(_FOLD) for t in texts]).replace(PART, b" \n ").split(b" ")


def _batches(b: pa.RecordBatch) -> Iterator[tuple[str, list[bytes | None]]]:
    """The texts of each language of a batch of (lang, text)."""
    by_lang: dict[str, list[bytes | None]] = {}
    for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
        by_lang.setdefault(lang, []).append(text)
    yield from by_lang.items()


def word_counts(rows: DataFrame, distinct: int = 500_000) -> DataFrame:
    """(lang, word, n) of all words. A task's counts are passed on when it holds ``distinct`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def packed() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                counts.pop(b"", None)
                counts.pop(PART, None)
                words = list(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])
            held.clear()

        for b in batches:
            for lang, texts in _batches(b):
                held.setdefault(lang, Counter()).update(tokens(texts))
            if sum(map(len, held.values())) > distinct:
                yield from packed()
        yield from packed()

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Block:
    """A perfect hash with its keys by slot and, for words, their texts (language, NUL, word)."""

    def __init__(self, keys: np.ndarray, texts: list[bytes] | None = None):
        """``keys`` are distinct but where texts tell them apart."""
        first = np.sort(np.unique(keys, return_index=True)[1]) if texts else np.arange(len(keys))
        self.hash = PerfectHash(keys[first])
        slots = self.hash.slots(keys[first])
        order = np.empty(len(first), np.int64)
        order[slots] = first
        more = np.setdiff1d(np.arange(len(keys)), first)  # words whose hash another word has, too
        self.order = np.concatenate((order, more))
        self.keys = keys[order]
        self.texts = [texts[k] for k in order] if texts else None
        self.more = {texts[k]: len(order) + i for i, k in enumerate(more)} if texts else {}

    def numbers(self, keys: np.ndarray, texts: list[bytes] | None = None) -> np.ndarray:
        """The slot of each key that the block holds, else -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        slots = self.hash.slots(keys)
        slots[self.keys[slots] != keys] = -1
        if texts is not None:
            for i, k in enumerate(slots.tolist()):
                if k >= 0 and self.texts[k] != texts[i]:
                    slots[i] = self.more.get(texts[i], -1)
        return slots


class Blocks:
    """Blocks of one level in a folder; ``bases[k]`` is the number of entries before block k, None if there is no such block."""

    def __init__(self, folder: str, blocks: int, bases: dict[int, int], held: int = 16):
        self.folder, self.blocks, self.bases, self.held = folder, blocks, bases, held

    def of(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys, 1 << 20) % np.uint64(self.blocks)).astype(np.int64)

    def block(self, k: int) -> Block:
        cache = _HELD
        if (self.folder, k) not in cache:
            while len(cache) >= self.held:
                cache.popitem(last=False)
            where, root = opened(self.folder)
            with where.open_input_file(f"{root}/{k}") as file:
                cache[self.folder, k] = pickle.loads(file.read())
        cache.move_to_end((self.folder, k))
        return cache[self.folder, k]

    def write(self, k: int, block: Block) -> None:
        where, root = opened(self.folder)
        where.create_dir(root, recursive=True)
        task = TaskContext.get().taskAttemptId()
        with where.open_output_stream(f"{root}/_{k}-{task}") as out:
            out.write(pickle.dumps(block, protocol=5))
        where.move(f"{root}/_{k}-{task}", f"{root}/{k}")  # written again by another attempt, it is the same

    def parted(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each block that exists and the places of its keys."""
        own = self.of(keys)
        order = np.argsort(own, kind="stable")
        edges = np.searchsorted(own[order], np.arange(self.blocks + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            if k in self.bases:
                yield k, order[edges[k] : edges[k + 1]]


_HELD: OrderedDict[tuple[str, int], Block] = OrderedDict()


def _numbered(found: DataFrame, blocks: int, folder: str) -> tuple[DataFrame, Blocks]:
    """``found`` (block, slot, ...) with id (from 1), and the blocks with their bases. A base for each block goes to the driver."""
    bases: dict[int, int] = {}
    total = 0
    for block, n in sorted(map(tuple, found.groupBy("block").count().collect())):
        bases[block] = total
        total += n
    if total >= (1 << 32) - 1:
        raise ValueError("more frequent phrases of one length than 32-bit numbers")
    spark = found.sparkSession
    based = spark.createDataFrame(sorted(bases.items()), "block int, base long")
    return found.join(F.broadcast(based), "block").withColumn("id", F.col("base") + F.col("slot") + 1).drop("base"), Blocks(folder, blocks, bases)


def word_blocks(words: DataFrame, blocks: int, folder: str) -> DataFrame:
    """(block, slot, lang, word, a): the frequent words (lang, word, n), as dealt to blocks that are written to ``folder``."""
    where = Blocks(folder, blocks, {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = where.of(b.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *b.columns], ["block", *b.schema.names])

    def build(table: pa.Table) -> pa.Table:
        k = table.column("block")[0].as_py()
        names = [f"{x}\0{y}".encode() for x, y in zip(table.column("lang").to_pylist(), table.column("word").to_pylist(), strict=True)]
        order = sorted(range(len(names)), key=names.__getitem__)  # the same in every attempt
        keys = table.column("key").to_numpy().view(np.uint64)[order]
        block = Block(keys, [names[i] for i in order])
        where.write(k, block)
        rows = table.take(pa.array(np.array(order)[block.order]))
        return pa.table({"block": rows.column("block"), "slot": pa.array(np.arange(len(order))), "lang": rows.column("lang"), "word": rows.column("word"), "a": rows.column("n")})

    dealt = words.select(F.xxhash64("lang", "word").alias("key"), "lang", "word", "n").mapInArrow(run, "block int, key long, lang string, word string, n long")
    return dealt.groupBy("block").applyInArrow(build, "block int, slot long, lang string, word string, a long")


def _word_numbers(known: Blocks, lang: str, words: list[bytes]) -> np.ndarray:
    """The number of each word (0: rare)."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)  # Spark's xxhash64 of two columns
    keys = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
    out = np.zeros(len(words), np.int64)
    for k, at in known.parted(keys):
        slots = known.block(k).numbers(keys[at], [lang.encode() + b"\0" + words[i] for i in at.tolist()])
        out[at] = np.where(slots >= 0, known.bases[k] + slots + 1, 0)
    return out


#: What a pass over the chunks gives: a chunk's numbers (kind 0: x), counts by slot of one block (1: x slots, y counts), the next keys of one block (2: x keys, y counts).
PASS = "kind int, chunk long, block int, x binary, y binary"


def _next_keys(ids: np.ndarray) -> np.ndarray:
    """The key of each place whose number and next number are frequent, 0 elsewhere."""
    wide = ids.astype(np.uint64)
    keys = np.zeros(len(ids), np.uint64)
    if len(ids) > 1:
        keys[:-1] = np.where((wide[:-1] > 0) & (wide[1:] > 0), (wide[:-1] << np.uint64(32)) | wide[1:], 0)
    return keys


def _width(least: int) -> str:
    """The kind of counts that stop at ``least``."""
    return "<u1" if least < 256 else "<u4"


def _offered(ids: np.ndarray, chunk: int, blocks: int, least: int) -> Iterator[tuple]:
    """Rows of kind 2 of a chunk."""
    keys = _next_keys(ids)
    keys, counts = np.unique(keys[keys > 0], return_counts=True)
    counts = np.minimum(counts, least).astype(_width(least))
    own = Blocks("", blocks, dict.fromkeys(range(blocks), 0))
    for k, at in own.parted(keys):
        yield 2, chunk, k, keys[at].tobytes(), counts[at].tobytes()


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PASS.split(", ")])


def first_pass(rows: DataFrame, words: Blocks, blocks: int, least: int, chunk: int) -> DataFrame:
    """PASS over (lang, text): word numbers of the chunks, and keys of two words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        known: dict[str, dict[bytes, int]] = {}
        parts: list[np.ndarray] = []

        def closed() -> Iterator[pa.RecordBatch]:
            ids, name = np.concatenate(parts), (part << 32) + number
            for row in [(0, name, None, ids.tobytes(), None), *_offered(ids, name, blocks, least)]:
                yield _packed([row])

        for b in batches:
            for lang, texts in _batches(b):
                own = known.setdefault(lang, {b"": -1, PART: 0})
                found = tokens(texts)
                new = [w for w in set(found) if w not in own]
                own.update(zip(new, _word_numbers(words, lang, new).tolist(), strict=True))
                ids = np.fromiter(map(own.__getitem__, found), np.int64, len(found))
                parts += [ids[ids >= 0].astype("<u4"), np.zeros(1, "<u4")]
                for w in new:
                    if len(w) > 64:
                        del own[w]
            if sum(map(len, known.values())) > 600_000:
                known.clear()
            if sum(map(len, parts)) >= chunk:
                yield from closed()
                parts, number = [], number + 1
        if parts:
            yield from closed()

    small_batches(rows.sparkSession)
    return materialise(rows.mapInArrow(run, PASS), "numbers")


def next_pass(before: DataFrame, known: Blocks, blocks: int, least: int, last: bool) -> DataFrame:
    """PASS over the chunks of the pass before: numbers and counts of the phrases in ``known``, and the next keys, unless it is the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys = _next_keys(np.frombuffer(data, "<u4"))
                places = np.flatnonzero(keys)
                ids = np.zeros(len(keys), "<u4")
                for k, at in known.parted(keys[places]):
                    slots = known.block(k).numbers(keys[places[at]])
                    hit = slots >= 0
                    ids[places[at[hit]]] = known.bases[k] + slots[hit] + 1
                    counts = np.bincount(slots[hit])
                    used = np.flatnonzero(counts)
                    if len(used):
                        yield _packed([(1, chunk, k, used.astype("<u4").tobytes(), counts[used].astype("<i8").tobytes())])
                if not last:
                    for row in [(0, chunk, None, ids.tobytes(), None), *_offered(ids, chunk, blocks, least)]:
                        yield _packed([row])

    small_batches(before.sparkSession, 4)
    return materialise(before.where("kind = 0").select("chunk", "x").mapInArrow(run, PASS), "numbers")


def phrase_blocks(found: DataFrame, blocks: int, least: int, folder: str) -> DataFrame:
    """(block, slot, p, s): candidates among the keys that chunks offer; p and s are the numbers of the candidate without its last and first word."""
    where = Blocks(folder, blocks, {})

    def build(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x, "<u8") for x in table.column("x").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, _width(least)) for x in table.column("y").to_pylist()])
        keys, at = np.unique(keys, return_inverse=True)
        keys = keys[np.bincount(at, weights=counts) >= least]  # sums of counts, exact in a double below 2^53
        k = table.column("block")[0].as_py()
        block = Block(keys)
        where.write(k, block)
        keys = block.keys
        return pa.table({"block": pa.array(np.full(len(keys), k, np.int32)), "slot": pa.array(np.arange(len(keys))), "p": pa.array((keys >> np.uint64(32)).astype(np.int64)), "s": pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64))})

    return found.where("kind = 2").select("block", "x", "y").groupBy("block").applyInArrow(build, "block int, slot long, p long, s long")


def tree_summed(found: DataFrame, fan_in: int = 16) -> DataFrame:
    """(block, slot, a): counts of all chunks by slot. Arrays of ``fan_in`` chunks are added, then of as many sums, until each block has one."""

    def add(table: pa.Table) -> pa.Table:
        slots = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("x").to_pylist()]).astype(np.int64)
        counts = np.concatenate([np.frombuffer(x, "<i8") for x in table.column("y").to_pylist()])
        sums = np.zeros(int(slots.max()) + 1, np.int64)
        np.add.at(sums, slots, counts)
        used = np.flatnonzero(sums)
        return pa.table({"block": table.column("block")[:1], "g": table.column("g")[:1], "x": pa.array([used.astype("<u4").tobytes()], pa.binary()), "y": pa.array([sums[used].tobytes()], pa.binary())})

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                slots = np.frombuffer(x, "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slots), k, np.int32)), pa.array(slots), pa.array(np.frombuffer(y, "<i8"))], ["block", "slot", "a"])

    arrays = found.where("kind = 1")
    groups, chunks = 1, arrays.select("chunk").distinct().count()
    while groups * fan_in < chunks:
        groups *= fan_in
    sums = arrays.select("block", F.pmod(F.xxhash64("chunk"), F.lit(groups)).alias("g"), "x", "y")
    while True:
        sums = sums.groupBy("block", "g").applyInArrow(add, "block int, g long, x binary, y binary")
        if groups == 1:
            return sums.select("block", "x", "y").mapInArrow(spread, "block int, slot long, a long")
        groups //= fan_in
        sums = sums.withColumn("g", F.col("g") % groups)


def _scores(ls: Column, rs: Column, a: Column) -> Column:
    """The lowest-scoring cut: struct of score, k, l, r. Scores are exact: products and sums are decimals."""
    wide = lambda x: x.cast("decimal(20,0)")
    whole = F.transform(ls, lambda l, i: F.struct(F.lit(0).cast("long").alias("score"), (i + 1).alias("k"), l.alias("l"), F.get(rs, i).alias("r")))
    return F.array_min(F.transform(whole, lambda x: F.struct(F.call_function("div", wide(a) * F.lit(2_000_000).cast("decimal(7,0)"), wide(x["l"]) + wide(x["r"])).alias("score"), x["k"].alias("k"), x["l"].alias("l"), x["r"].alias("r"))))


def _longer(shorter: DataFrame, keyed: DataFrame) -> DataFrame:
    """Phrases one word longer, from their parts: lang, phrase, its last word, a, and the counts of the left and right side of each cut."""
    kept = ("id", "lang", "phrase", "last", "a", "ls", "rs")
    left = shorter.select(*[F.col(c).alias(f"p_{c}") for c in kept])
    right = shorter.select(*[F.col(c).alias(f"s_{c}") for c in kept])
    both = keyed.join(left, F.col("p") == F.col("p_id")).join(right, F.col("s") == F.col("s_id"))
    return both.select(
        "id", "p", "s", F.col("p_lang").alias("lang"), F.concat("p_phrase", F.lit(" "), "s_last").alias("phrase"), F.col("s_last").alias("last"), "a",
        F.concat("p_ls", F.array("p_a")).alias("ls"), F.concat(F.array("s_a"), "s_rs").alias("rs"),
    )


PHRASES = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"


def top_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = 4, top: int = 2000, covered: int = 80, chunk: int = 2_000_000, block_words: int = 4_000_000) -> DataFrame:
    """PHRASES: of each language the ``top`` phrases by score (of the cut with the lowest: 2,000,000 * a / (l + r), rounded down), then a, then phrase
    in byte order. Candidates inside a longer one that has at least ``covered`` per cent of their count are dropped."""
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    words = materialise(word_counts(rows), "words")
    totals = materialise(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    blocks = max(8, -(-(totals.agg(F.sum("n")).first()[0] or 0) // block_words))
    folder = scratch(spark, "words")
    frequent, known = _numbered(materialise(word_blocks(words.where(F.col("n") >= least), blocks, folder), "slots"), blocks, folder)
    none = F.array().cast("array<long>")
    level = frequent.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", none.alias("ls"), none.alias("rs"))
    levels: list[DataFrame] = []
    found = first_pass(rows, known, blocks, least, chunk) if known.bases else None
    for size in range(2, longest + 1):
        if not known.bases:
            break
        folder = scratch(spark, "phrases")
        slots, known = _numbered(materialise(phrase_blocks(found, blocks, least, folder), "slots"), blocks, folder)
        if not known.bases:
            break
        found = next_pass(found, known, blocks, least, size == longest)
        counted = slots.join(tree_summed(found), ["block", "slot"]).select("id", "p", "s", "a")
        level = materialise(_longer(level, counted), "phrases")
        levels.append(level)
    result = spark.createDataFrame([], "lang string, phrase string, a long, x struct<score: long, k: int, l: long, r: long>")
    for i, level in enumerate(levels):
        kept = level
        if i + 1 < len(levels):
            # a phrase two words longer has no more than the one between, so the next length tells all
            above = levels[i + 1].select("a", F.explode(F.array_distinct(F.array("p", "s"))).alias("id")).groupBy("id").agg(F.max("a").alias("above"))
            wide = lambda c: F.col(c).cast("decimal(20,0)")
            kept = level.join(above, "id", "left").where(F.col("above").isNull() | (wide("above") * 100 < wide("a") * covered))
        result = result.union(kept.select("lang", "phrase", "a", _scores(F.col("ls"), F.col("rs"), F.col("a")).alias("x")))
    order = Window.partitionBy("lang").orderBy(F.desc("x.score"), F.desc("a"), "phrase")
    ranked = result.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), "n", F.col("x.score").alias("score"))
