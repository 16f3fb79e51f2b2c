"""Fingerprint trees, token alignment and collocations against plain versions, and on awkward rows."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wardgraph.llm import alignment, collocations, merkle, perfecthash, queries
from wardgraph.llm.queries import BYTE_BPE, PIECE_BPE

from .test_operators import LONG, docs, empty, odd, rows  # noqa: F401

# fingerprints


def plain_leaves(text):
    """(section, paragraph, leaf) of each leaf, by walking over the bytes."""
    data, out, section, paragraph, start, line = text.encode(), [], 0, 0, 0, 0
    for at in range(1, len(data) + 1):
        end = at == len(data)
        new_line = not end and data[at - 1] == 10
        cut = not end and at - line >= 8 and data[at] & 0xC0 != 0x80 and ((int.from_bytes(data[at - 8 : at], "little") * 0x9E3779B97F4A7C15) % 2**64 >> 40) % merkle.MEAN == 0
        if end or new_line or cut:
            out.append((section, paragraph, data[start:at]))
            start = at
        if new_line:
            line, paragraph = at, paragraph + 1
            if data[at] == 35 or (at >= 2 and data[at - 2] == 10 and data[at] != 10):
                section += 1
    return out


def plain_root(text):
    h = lambda level, parts, size=16: hashlib.blake2b(bytes([level]) + b"".join(parts), digest_size=size).digest()
    sections = {}
    for s, p, leaf in plain_leaves(text):
        sections.setdefault(s, {}).setdefault(p, []).append(hashlib.blake2b(leaf, digest_size=16).digest())
    return h(0, [h(1, [h(2, leaves) for leaves in ps.values()]) for ps in sections.values()], 32).hex()


TEXTS = ["", "a", "\n", "\n\n", "# a\nb\n# c", "a\n\n\nb\n\nc", "é" * 40, "日本語のテキスト" * 9, "x" * 500, "one two three\n\nfour five " * 7]


def test_trees_are_plain(rows):  # noqa: F811
    for text in [*TEXTS, *list(rows.values())[:60]]:
        text = text or ""
        root = merkle.tree(text)
        assert root.hash.hex() == plain_root(text) and root.chars == len(text)
        assert merkle.rebuilt(merkle.flattened(root)) == root


def plain_likeness(a, b):
    """Leaves in common, where whole sections, then whole paragraphs, then leaves are matched as often as both have them."""
    x, y = plain_leaves(a), plain_leaves(b)
    if a == b:
        return 1.0
    shared = 0
    for depth in (1, 2, 3):
        def units(leaves, depth=depth):
            out = {}
            for i, leaf in enumerate(leaves):
                out.setdefault(leaf[:depth] if depth < 3 else i, []).append(i)
            return [(tuple((leaves[i][1] - leaves[k[0]][1], leaves[i][2]) for i in k), k) for k in out.values()]

        left, right = units(x), units(y)
        both = Counter(u for u, _ in left) & Counter(u for u, _ in right)
        for side, own in ((left, x), (right, y)):
            budget = Counter(both)
            gone = set()
            for u, k in side:
                if budget[u] > 0:
                    budget[u] -= 1
                    gone |= set(k)
            if own is x:
                shared += sum(len(x[i][2].decode()) for i in gone)
                x = [leaf for i, leaf in enumerate(x) if i not in gone]
            else:
                y = [leaf for i, leaf in enumerate(y) if i not in gone]
    return 2 * shared / (len(a) + len(b))


def test_fingerprint_query_is_the_plain_one(spark, sf, rows):  # noqa: F811
    got = {r["doc_id"]: r for r in queries.op11_merkle(spark, sf).collect()}
    ids = sorted(rows)
    assert sorted(got) == ids
    for i, doc in enumerate(ids):
        text, following = rows[doc] or "", rows[ids[(i + 1) % len(ids)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (plain_root(text), plain_root(edited))
        assert r["near_edited"] == pytest.approx(plain_likeness(text, edited)) and r["near_next"] == pytest.approx(plain_likeness(text, following))
        if r["first_edit"] is not None:  # up to there nothing was changed
            assert edited[: r["first_edit"]] == text[: r["first_edit"]] and r["first_edit"] <= len(text) - half


def test_edits_are_located(spark):
    paragraphs = [" ".join(random.Random(k).choices(LONG.split()[:900], k=60)) for k in range(30)]
    old = "\n".join(paragraphs)
    new = "\n".join([*paragraphs[:7], paragraphs[7].replace(" ", " NEW ", 1), *paragraphs[8:20], *paragraphs[21:]])
    a = merkle.fingerprints(spark.createDataFrame([(1, old), (2, "same"), (None, "x"), (4, None)], "doc_id long, text string"))
    b = merkle.fingerprints(spark.createDataFrame([(1, new), (2, "same"), (None, "x"), (4, "")], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in merkle.compare(a, b).collect()}
    assert set(got) == {1, 2, 4} and (got[2]["likeness"], got[2]["removed"], got[4]["likeness"]) == (1.0, [], 1.0)
    removed = [old[s["start"] : s["end"]] for s in got[1]["removed"]]
    added = [new[s["start"] : s["end"]] for s in got[1]["added"]]
    assert any(" NEW " in x for x in added) and sum(map(len, added)) < 400
    assert paragraphs[20] + "\n" in removed and len(removed) == 2 and got[1]["likeness"] > 0.95


def test_fingerprints_on_awkward_rows(spark, odd, empty):  # noqa: F811
    assert merkle.with_followers(empty).count() == 0 and merkle.fingerprints(empty).count() == 0
    got = merkle.with_followers(odd).collect()
    assert len(got) == 9
    order = sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert [r["doc_id"] for r in order] == [None, 1, 2, 3, 3, 4, 5, 6, 7]
    threes = [r for r in got if r["doc_id"] == 3]
    assert sorted(r["near_next"] == 1.0 for r in threes) == [False, True]  # the first is followed by its copy
    assert {r["fingerprint"] for r in got if r["doc_id"] in (1, 2)} == {merkle.tree("").hash.hex()}
    one = merkle.with_followers(odd.where("doc_id = 4")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0  # it follows itself


def test_a_hot_id_is_followed_over_parts(spark):
    table = spark.range(4000).select(F.lit(5).alias("doc_id"), F.concat(F.lit("text "), F.pmod("id", F.lit(50))).alias("text"), "id")
    got = merkle.with_followers(table)
    assert got.count() == 4000 and got.where("near_next < 1").count() == 50  # copies stand side by side
    assert got.select("fingerprint").distinct().count() == 50


# alignment


def plain_alignment(text):
    """Tokens, groups, their text and linked id pairs, by the libraries and sets of ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not plain_alignment.__dict__:
        plain_alignment.a = Tokenizer.from_file(BYTE_BPE)
        plain_alignment.a.encode_special_tokens = True
        plain_alignment.b = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
        plain_alignment.names = {k: p for p, k in plain_alignment.a.get_vocab().items()}
    a, b = plain_alignment.a, plain_alignment.b
    if not text:
        return None
    letters = alignment.byte_alphabet()
    ids_a, ids_b, data = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
    bytes_a = [bytes(letters[c] for c in plain_alignment.names[k]) for k in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(k)[1:-1], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
    if b"".join(bytes_a) != data or b"".join(bytes_b) != data:
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    at = dict(zip(ends_b, ids_b, strict=True))
    links = [(k, at[e]) for k, e in zip(ids_a, ends_a, strict=True) if e in at]
    groups, start = [], 0
    for e in sorted(set(ends_a) & set(ends_b)):
        side = [",".join(str(k) for k, x in zip(ids, ends, strict=True) if start < x <= e) for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))]
        groups.append("|".join(side))
        start = e
    return len(ids_a), len(ids_b), len(groups), ";".join(groups), links


ODD_TEXTS = [" ", "  ", "a ", "a  b", "\n", "\nx", "x\n", "a\nb c\nd", "<|endoftext|>", "a <|endoftext|> b", "<s> </s> <unk> <0x41>", "▁", "a▁b", "日本語 テキスト", "😀 x", "tab\there", "x\x00y", "don't it's", "a　b", "y" * 700, "\x1c a\x1cb", "a\u0085b", "a\r\nb", "１２３ 45", "﻿x a​b"]


def test_alignment_is_the_libraries(rows):  # noqa: F811
    own, chance = alignment.Aligner(BYTE_BPE, PIECE_BPE), random.Random(5)
    texts = [*ODD_TEXTS, *["".join(chance.choices("ab é日\n \t'.1<|>s", k=chance.randint(1, 30))) for _ in range(400)], *[t for t in rows.values() if t and len(t) < 5000][:60]]
    assert own.cuts
    for text, got in [*zip(texts, own.align(texts), strict=True), *((t, own.align([t])[0]) for t in texts[:60])]:
        expected = plain_alignment(text)
        assert (expected is None) == (got is None), text
        if expected:
            links = np.frombuffer(got[4], np.int64).tolist()
            assert got[:4] == expected[:4] and [(k >> 32, k & 0xFFFFFFFF) for k in links] == expected[4], text


def plain_rows(texts):
    found = {doc: plain_alignment(t) for doc, t in texts}
    count = Counter(x for f in found.values() if f for x in f[4])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return {
        doc: (0, 0, 0, 0, 0, 0, "") if f is None else (*f[:3], len(f[4]), sum(count[x] == most[x[1]] for x in f[4]), sum(count[x] for x in f[4]), hashlib.sha256(f[3].encode()).hexdigest())
        for doc, f in found.items()
    }


@pytest.mark.parametrize("links", [300, 500_000])
def test_aligned_documents_are_the_plain_ones(spark, docs, rows, links):  # noqa: F811
    few = docs.where("length(text) < 4000 or text is null")
    expected = plain_rows([(k, t) for k, t in rows.items() if t is None or len(t) < 4000])
    got = {r[0]: tuple(r)[1:] for r in alignment.align_documents(few, BYTE_BPE, PIECE_BPE, links=links).collect()}
    assert got == expected and max(r[3] for r in got.values()) > 300


def test_alignment_on_awkward_rows(spark, odd, empty):  # noqa: F811
    assert alignment.align_documents(empty, BYTE_BPE, PIECE_BPE).count() == 0
    got = alignment.align_documents(odd, BYTE_BPE, PIECE_BPE)
    assert got.columns == [x.split()[0] for x in alignment.ALIGNED.split(", ")] and got.count() == 9
    by_id = {r["doc_id"]: r for r in got.collect()}
    for doc in (1, 2, 7):  # null, empty, and a text with U+2581
        assert tuple(by_id[doc])[1:] == (0, 0, 0, 0, 0, 0, "")
    assert by_id[3]["count_sum"] >= 2 * by_id[3]["n_links"] > 0 and by_id[None]["n_links"] > 0
    assert {r["doc_id"]: r["groups"] for r in alignment.groups(odd.where("doc_id in (1, 4)"), BYTE_BPE, PIECE_BPE).collect()} == {1: None, 4: plain_alignment("One two three four five six seven eight nine ten")[3]}


# collocations


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64))
    for some in (keys, keys[:1], keys[:0], np.arange(5000, dtype=np.uint64) << np.uint64(32)):
        h = perfecthash.PerfectHash(some)
        assert sorted(h.slots(some).tolist()) == list(range(len(some)))
    block = collocations.Block(keys)
    assert (block.keys[block.numbers(keys)] == keys).all() and (block.numbers(keys ^ np.uint64(1 << 63)) == -1).all()
    left = perfecthash.PerfectHash(keys, depth=2)  # keys that no level sets apart
    assert len(left.left) and sorted(left.slots(keys).tolist()) == list(range(len(keys)))


def test_words_of_one_hash_are_told_apart():
    texts = [b"en\0a", b"en\0b", b"de\0a", b"en\0c"]
    block = collocations.Block(np.array([5, 5, 7, 5], np.uint64), texts)
    found = block.numbers(np.array([5, 5, 7, 5, 5, 7], np.uint64), [*texts, b"en\0d", b"en\0a"]).tolist()
    assert sorted(found[:4]) == [0, 1, 2, 3] and found[4:] == [-1, -1]
    assert [texts[block.order[k]] for k in found[:4]] == texts


def plain_phrases(rows, least, top=2000, longest=4):  # noqa: F811
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    key = lang, tuple(words[i : i + k])
                    f[key] = f.get(key, 0) + 1
    candidates = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    above = Counter()
    for (lang, w), a in candidates.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w):
                    above[lang, w[i:j]] = max(above[lang, w[i:j]], a)
    out = {}
    for (lang, w), a in candidates.items():
        if 100 * above[lang, w] >= 80 * a:
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


@pytest.mark.parametrize(("least", "chunk", "block_words"), [(2, 500, 3000), (5, 2_000_000, 8_000_000), (30, 2_000_000, 8_000_000)])
def test_phrases_are_the_plain_ones(spark, docs, least, chunk, block_words):  # noqa: F811
    few = docs.where("doc_id < 120").select("lang", "text")
    expected = plain_phrases([tuple(r) for r in few.collect()], least, top=300)
    got = sorted(map(tuple, collocations.top_phrases(few, least=least, chunk=chunk, block_words=block_words, top=300).collect()))
    assert got == expected and (least > 2 or len({len(x[2].split()) for x in got}) == 3)


def test_phrases_on_awkward_rows(spark, odd, empty):  # noqa: F811
    assert collocations.top_phrases(empty).count() == 0 and collocations.top_phrases(odd.where("text is null")).count() == 0
    made = [(None, "A b\tc. a b; c A b"), ("und", "a b c d e f g"), ("x", "ß ß ß ß é\x1cé é\x1cé"), ("x", None), ("x", ""), ("x", "q" * 5000 + " r"), ("x", "q" * 5000 + " r"), ("y\0z", "m n"), ("y\0z", "m n"), ("x", "a\x0bb a\x0cb a\rb")] * 2
    table = spark.createDataFrame(made, "lang string, text string")
    for least in (1, 2, 4):
        assert sorted(map(tuple, collocations.top_phrases(table, least=least).collect())) == plain_phrases(made, least)
    assert sorted(map(tuple, collocations.top_phrases(odd, least=2).collect())) == plain_phrases([(r["lang"], r["text"]) for r in odd.collect()], 2)


def test_scores_are_exact(spark):
    big = 3 * 10**18
    df = spark.createDataFrame([([big, 2], [big - 1, 2 * big], big)], "ls array<long>, rs array<long>, a long")
    got = df.select(collocations._scores(F.col("ls"), F.col("rs"), F.col("a")).alias("x")).first()["x"]
    assert (got["score"], got["k"]) == min((2_000_000 * big // (l + r), k) for l, r, k in ((big, big - 1, 1), (2, 2 * big, 2)))


def test_phrase_query_matches_sql(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op13_collocations(spark, folder)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    expected = con.sql(queries.ORACLES["op13_collocations"])
    assert sorted(got.columns) == sorted(expected.columns)
    names = sorted(got.columns)
    rows_of = sorted(tuple(r[c] for c in names) for r in got.collect())
    assert rows_of == sorted(expected.select(*[duckdb.ColumnExpression(c) for c in names]).fetchall()) and len(rows_of) > 100
