"""Whole queries against plain versions of them, and the cases that are hard at scale: hot ids, dense buckets, few labels, wrapped notices."""

import hashlib
import heapq
import io
import random
import textwrap
import unicodedata
import zlib
from collections import Counter
from itertools import pairwise
from math import exp, log, log2

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wardgraph.llm import components, cotrain, flatids, langid, licenses, media, pieces, queries, rules, sharding, simhash
from wardgraph.llm.common import documents, scratch

from .test_operators import LONG, ROWS, SCHEMA, check_packing, docs, empty, odd, plain_components, plain_counts, plain_fingerprint, plain_phrases, rows  # noqa: F401

# 1


def test_shard_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    got = queries.op1_size_tiered_shards(spark, sf)
    want = con.execute(queries.ORACLES["op1_size_tiered_shards"]).fetch_df()
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.itertuples(index=False, name=None), key=str)


def test_each_run_is_one_file(spark):
    """Many runs: as many files as runs, none much above the target."""
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    store = sharding.ShardStore(spark, scratch(spark, "store"))
    store.append(rows.repartition(60))
    size = store.manifest().agg(F.avg("bytes")).first()[0]
    target = int(6.5 * size)
    plan = store.plan(store.manifest(), target, 4, 4.0)
    runs = plan.select("run").distinct().count()
    assert runs >= 8 and sorted(r["run"] for r in plan.select("run").distinct().collect()) == list(range(runs))
    store.compact(target, 4, 4.0, max_passes=1)
    files = [r["bytes"] for r in store.manifest().collect()]
    assert len(files) == runs + 60 - plan.count() and max(files) <= 1.3 * target
    assert store.read().select(F.sum("doc_id"), F.count("*")).first() == (sum(range(40_000)), 40_000)


# 2


def plain_resize(image, height, width):
    h, w = image.shape[:2]
    part = lambda n, k: np.array([[max(0.0, min(i + 1, (y + 1) * n / k) - max(i, y * n / k)) for i in range(n)] for y in range(k)])
    return np.einsum("yi,xj,ijc->yxc", part(h, height), part(w, width), image.astype(float)) / (h / height * w / width)


def test_media_query_has_plain_features(spark, sf, rows):  # noqa: F811
    got = {r["doc_id"]: r for r in queries.op2_media(spark, sf).collect()}
    assert set(got) == set(rows)
    for i, text in rows.items():
        data = (text or "").encode()
        padded = data + b" " * (-len(data) % 192 or (0 if data else 192))
        image = np.frombuffer(padded, np.uint8).reshape(-1, 64, 3)
        r = got[i]
        assert (r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        grey = plain_resize((image.astype(np.int64) @ np.array([299, 587, 114]))[:, :, None], 8, 9)[:, :, 0]
        steps = grey[:, 1:] - grey[:, :-1]
        bits = np.unpackbits(np.frombuffer(bytes.fromhex(r["feature"]), np.uint8)).reshape(8, 8).astype(bool)
        assert (bits == (steps > 1e-3))[np.abs(steps - 1e-3) > 1e-2].all()
        # the tile: only a mean that lies on a half may be rounded either way
        mean = plain_resize(image, 16, 16)
        if (np.abs(mean % 1 - 0.5) > 1e-6).all():
            out = io.BytesIO()
            np.lib.format.write_array(out, np.rint(mean).astype(np.uint8), version=(1, 0))
            assert r["tile_sha256"] == hashlib.sha256(out.getvalue()).hexdigest()


# 3


def plain_statistics(text):
    n, chars, symbols, dup, repeat = plain_counts(text)
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    upper = sum(unicodedata.category(c) == "Lu" for c in text or "")
    return {
        "n_words": float(n),
        "word_length": chars / max(n, 1),
        "symbol_share": symbols / max(chars, 1),
        "upper_share": upper / max(chars, 1),
        "bang_share": (text or "").count("!") / max(chars, 1),
        "distinct_share": len(set(words)) / max(n, 1),
        "repeat_share": repeat / max(n, 1),
        "dup_line_share": dup / max(len(lines), 1),
    }


def plain_list(known, at, max_rules=8, max_conditions=4, precision=0.95):
    """Sequential covering over rows of (statistics, good, prune), each condition tried on each row."""
    holds = lambda rule, s: all((s[name] >= t) == above for name, above, t in rule)
    total, left, found = sum(not g for _, g, _ in known), known, []
    while len(found) < max_rules:
        rule, grow = [], [x for x in left if not x[2]]
        while len(rule) < max_conditions:
            inside = [x for x in grow if holds(rule, x[0])]
            p0, n0 = sum(not x[1] for x in inside), sum(x[1] for x in inside)
            if not p0 or not n0:
                break
            tried = []
            for name, edges in at.items():
                for t, gap in edges:
                    for above in (False, True):
                        p, n = (sum(x[1] == g and (x[0][name] >= t) == above for x in inside) for g in (False, True))
                        if p and (gain := p * (log2(p / (p + n)) - log2(p0 / (p0 + n0)))) > 1e-9:
                            tried.append((round(gain, 8), gap, name, above, t))
            if not tried:
                break
            top = max((x[0], x[1]) for x in tried)
            rule.append(next((name, above, t) for gain, gap, name, above, t in tried if (gain, gap) == top))
        if not rule:
            break
        check = [x for x in left if x[2]]
        hits = [Counter(x[1] for x in check if holds(rule[: k + 1], x[0])) for k in range(len(rule))]
        k = max(range(len(rule)), key=lambda k: ((hits[k][False] - hits[k][True]) / max(1, hits[k].total()), -k))
        if hits[k][False] < precision * hits[k].total() or hits[k][False] < max(2, 0.001 * total / 3):
            break
        found.append(rule[: k + 1])
        left = [x for x in left if not holds(found[-1], x[0])]
    return found


def test_rule_query_is_the_plain_list(spark):
    sf = "/root/testdata/sf0.01"
    table = {r["doc_id"]: r["text"] for r in documents(spark, sf).select("doc_id", "text").collect()}
    failed = {i: n < 20 or 100 * repeat > 30 * n for i, (n, _, _, _, repeat) in ((i, plain_counts(t)) for i, t in table.items())}
    labels = {}
    for r in documents(spark, sf, "labels").where("quality is not null").collect():
        labels.setdefault(r["doc_id"], []).append(r["quality"])
    stats = {i: plain_statistics(t) for i, t in table.items()}
    split = {r["id"]: r["p"] for r in spark.createDataFrame([(i,) for i in table], "id long").select("id", (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(3)) == 0).alias("p")).collect()}
    known = [(stats[i], 2 * sum(q) >= len(q), split[i]) for i, q in labels.items() if i in table and not failed[i]]
    # few rows: percentile_approx gives exact ranks
    quantile = lambda xs: {xs[max(0, -(-k * len(xs) // 16) - 1)] for k in range(17)}
    at = {}
    for name in rules.STATISTICS:
        both = sorted(quantile(sorted(s[name] for s, g, _ in known if g)) | quantile(sorted(s[name] for s, g, _ in known if not g)))
        at[name] = [((a + b) / 2, (b - a) / (both[-1] - both[0])) for a, b in pairwise(both)]
    plan = plain_list(known, at)
    got = {r["doc_id"]: r for r in queries.op3_quality_rules(spark, sf).collect()}
    assert plan and set(got) == set(table)
    for i, s in stats.items():
        rule = 0 if failed[i] else next((k for k, conditions in enumerate(plan, 1) if all((s[n] >= t) == above for n, above, t in conditions)), 0)
        assert (got[i]["base_failed"], got[i]["rule"], got[i]["kept"]) == (failed[i], rule, not failed[i] and not rule), i


def test_rules_on_awkward_rows(spark, odd):  # noqa: F811
    """Labels that are null, in conflict, repeated or of unknown ids; null ids and texts; clashing names."""
    labels = spark.createDataFrame([(3, 1), (3, 0), (3, None), (4, 0), (4, 0), (6, 1), (None, 0), (2, 0), (99, 1)], "doc_id long, quality int")
    more = odd.union(odd.where("doc_id = 4").withColumn("text", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit("w"), i)))))
    got = rules.apply_rules(more, labels).collect()
    # all are too short or repeat themselves, but the one that was added
    assert Counter((r["doc_id"], r["kept"]) for r in got) == Counter([*((i, False) for i, *_ in ROWS), (4, True)])
    assert all(r["base_failed"] != r["kept"] and r["rule"] == 0 for r in got)


# 4


def plain_least(model, s):
    """The least cost of a normalised string, each place tried from each place before it."""
    best = [0.0] + [float("inf")] * len(s)
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - 40), j):
            k = model.ids.get(s[i:j])
            cost = -model.scores[k] if k is not None else model.penalty if j == i + 1 else None
            if cost is not None:
                best[j] = min(best[j], best[i] + cost)
    return best[-1]


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_paths_are_least(rows, tmp_path, fallback):  # noqa: F811
    """A unigram model that is trained here: our costs are a brute-force search's, and ids those of the library, bytes included."""
    import sentencepiece

    out = io.BytesIO()
    corpus = [x[:2000] for x in rows.values() if x][:150]
    sentencepiece.SentencePieceTrainer.train(
        sentence_iterator=iter(line for x in corpus for line in x.split("\n") if line.strip()), model_writer=out, vocab_size=900 + 256 * fallback, model_type="unigram", byte_fallback=fallback, normalization_rule_name="identity", minloglevel=2, hard_vocab_limit=False
    )
    library, own = sentencepiece.SentencePieceProcessor(model_proto=out.getvalue()), pieces.Transducer(out.getvalue())
    rng = random.Random(4)
    texts = corpus[:40] + ["", " ", "  a  b ", "日本 😀 x", "a" * 60] + ["".join(rng.choice("ab the in er  é日😀.,") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    byte_ids = {*own.bytes.values()}
    cost = lambda ids: sum(-own.scores[i] for i in ids if i not in byte_ids and i != own.unknown)
    same = 0
    for x in texts:
        ids, want = np.frombuffer(own.encode(x), own.width).tolist(), library.encode(x)
        same += ids == want
        assert abs(cost(ids) - cost(want)) < 1e-3 * max(1.0, abs(cost(want)))  # ties and the library's single precision
        s = own.normalised(x)
        without = sum(c not in own.ids for c in s)
        if own.bytes:  # a character without a piece weighs the penalty, and is spelled in bytes
            assert abs(cost(ids) + without * own.penalty - plain_least(own, s)) < 1e-6 * max(1.0, plain_least(own, s))
        assert own.decode(ids) == library.decode(want)
    assert same >= 0.98 * len(texts)


# 5


def union_of(pairs, members):
    root = {x: x for x in members}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return {x: find(x) for x in members}


@pytest.mark.parametrize("size", [3, 500, 5000])
def test_links_at_the_edge(size):
    """Buckets of pairs at exactly 4 bits (linked) and 5 bits (not linked), bit 63 among them."""
    rng = random.Random(size)
    fps, near = set(), []
    while len(fps) < size:
        a = rng.getrandbits(64)
        bits = rng.sample(range(63), 4)
        four, five = sum(1 << b for b in bits[:3]) | 1 << 63, sum(1 << b for b in bits) | 1 << 63
        fps |= {a, a ^ four} if len(fps) % 4 < 2 else {a, a ^ five}
    distinct = np.array(sorted(fps), np.uint64)
    for k in range(len(distinct)):
        for m in np.flatnonzero(np.bitwise_count(distinct[k + 1 :] ^ distinct[k]) <= 4):
            near.append((int(distinct[k]), int(distinct[k + 1 + m])))
    found = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.spanning_links(distinct.view(np.int64), 4)]
    assert near or size == 3
    assert {frozenset(x) for x in found} <= {frozenset(x) for x in near}
    members = [int(x) for x in distinct]
    got, want = union_of(found, members), union_of(near, members)
    assert Counter(Counter(got.values()).values()) == Counter(Counter(want.values()).values()) and len({(got[x], want[x]) for x in members}) == len(set(want.values()))


@pytest.mark.parametrize("blocks", [6, 7, 8])
def test_recall_is_whole(spark, blocks):
    """10,000 fingerprints, a third of them near others: the components of all pairs, whatever the number of blocks."""
    rng = random.Random(blocks)
    fps = {rng.getrandbits(64) for _ in range(6000)}
    for a in rng.sample(sorted(fps), 1000):
        for _ in range(4):
            fps.add(a ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    distinct = np.array(sorted(fps), np.uint64)
    near = [(int(distinct[k]), int(distinct[k + 1 + m])) for k in range(len(distinct)) for m in np.flatnonzero(np.bitwise_count(distinct[k + 1 :] ^ distinct[k]) <= 4)]
    df = spark.createDataFrame([(int(x),) for x in distinct.view(np.int64)], "fp long")
    found = {r["node"] % (1 << 64): r["root"] for r in components.connected_components(simhash.links(df, 4, blocks)).collect()}
    want = union_of(near, [int(x) for x in distinct])
    linked = {x for pair in near for x in pair}
    assert set(found) == linked and len({(found[x], want[x]) for x in linked}) == len({want[x] for x in linked}) == len({*found.values()})


def test_blocks_grow_with_the_table():
    chosen = [simhash.fewest_comparisons(n, 4) for n in (0, 10**4, 10**6, 10**8, 10**10)]
    assert chosen == sorted(chosen) and chosen[0] == 6 and chosen[-1] >= 8


# 6


def test_language_query_is_the_plain_parse(spark, sf, rows):  # noqa: F811
    table = documents(spark, sf)
    model = langid.train_model(table, ~langid.held_out())
    got = {r["doc_id"]: r for r in queries.op6_language_id(spark, sf).collect()}
    assert {i: r["held_out"] for i, r in got.items()} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in rows}
    for i, text in [*rows.items()][:60]:
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        s = " ".join(words).encode()
        cost = [(plain_phrases(sample, s, 512) * log2(len(sample)), name) for name, sample in model.langs]
        (least, name), rest = min(cost), heapq.nsmallest(2, [x for x, _ in cost])[1]
        assert (got[i]["lang_pred"], round(got[i]["score"], 9)) == ((name, round(1 - least / rest, 9)) if words else ("und", 0.0))


def test_language_ties_scripts_and_many_languages(spark):
    tied = spark.createDataFrame([(i, "abc abd abe", lang) for i, lang in enumerate(["zz", "aa", "mm"])], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(tied, langid.train_model(tied)).collect()} == {("aa", 0.0)}
    rng = random.Random(6)
    scripts = {"zh": (0x4E00, 0x6000), "th": (0xE01, 0xE2E), "ru": (0x430, 0x44F), "ko": (0xAC00, 0xB000), "ja": (0x3042, 0x3093), "en": (97, 122)}
    words = {lang: ["".join(chr(rng.randint(*ends)) for _ in range(4)) for _ in range(80)] for lang, ends in scripts.items()}
    made = [(i, " ".join(rng.choices(words[lang], k=30)), lang) for i, lang in enumerate(list(scripts) * 20)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, langid.train_model(df, F.col("doc_id") < 60)).collect()}
    assert all(got[i] == lang for i, _, lang in made)
    many = spark.createDataFrame([(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k)}" for k in range(20)), f"l{i:03}") for i in range(130)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(many, langid.train_model(many)).collect()}
    assert got == {i: f"l{i:03}" for i in range(130)}


def test_a_hot_id_teaches_no_more_than_others(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("word "), "id").alias("text"), F.lit("en").alias("lang"))
    sample = langid._sampled(df, "doc_id", "text", "lang", F.lit(True), 50, 500)
    assert sample.count() == 50 and sample.select("text").distinct().count() == 50


# 7


def plain_notices(text):
    """Each span of words against each template by the least differences; of those that overlap, the one that saves most."""
    scanner = licenses.Scanner(licenses.TEMPLATES)
    at = [m.span() for m in licenses._WORD.finditer(text)]
    own = [text[s:e].lower() for s, e in at]
    found = []
    for name, template in scanner.templates.items():
        for cost, s, e in licenses.closest(template, own):
            if cost <= scanner.changes[name]:
                found.append((-scanner._saving(text[at[s][0] : at[e - 1][1]], name)[0], cost, name, at[s][0], at[e - 1][1]))
    taken = []
    for _, _, name, s, e in sorted(found):
        if all(e <= x or y <= s for _, x, y in taken):
            taken.append((name, s, e))
    return Counter(name for name, _, _ in taken)


def test_notices_are_those_of_all_places(rows):  # noqa: F811
    """With words changed, dropped and added, wrapped at any width, behind comment marks, beside one another and within prose."""
    rng, scanner = random.Random(7), licenses.Scanner(licenses.TEMPLATES)
    prose = [w for x in [*rows.values()][:20] for w in (x or "").split()[:40]]
    for _ in range(60):
        out = []
        for name in rng.sample([*licenses.TEMPLATES], rng.randint(1, 2)):
            own = licenses.TEMPLATES[name].split()
            for _ in range(rng.randint(0, max(1, len(own) // 15))):
                at = rng.randrange(len(own))
                own[at : at + rng.randint(0, 1)] = [rng.choice(prose)] * rng.randint(0, 1)
            mark = rng.choice(["", "# ", " * ", "// "])
            out += [*textwrap.wrap(" ".join(rng.choices(prose, k=rng.randint(0, 60))), 70), *(mark + x for x in textwrap.wrap(" ".join(own), rng.randint(40, 100)))]
        text = "\n".join(out)
        assert Counter(r[2] for r in scanner.rows(text) if r[2]) == plain_notices(text), text


@pytest.mark.parametrize("width", [40, 60, 72, 79, 100])
def test_every_template_at_every_width(width):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        words = text.split()
        changed = " ".join(["changed" if k == len(words) // 2 else w for k, w in enumerate(words)])
        for own, kept in ((text, True), (changed, scanner.changes[name] > 1)):  # a changed word is one missing and one added
            lines = "\n".join("# " + x for x in textwrap.wrap(own, width - 2))
            got = [r[2] for r in scanner.rows(f"import x\n{lines}\nx = 1") if r[2]]
            assert got == [name] if kept else name not in got


def test_license_rows_on_awkward_documents(spark):
    mit = "Released under the MIT License."
    made = [(1, mit, "x"), (1, mit, "x"), (None, mit, "y"), (2, None, "x"), (3, "", "x"), (4, LONG + "\n" + mit, "x"), (5, f"{mit} {mit}", "x"), (6, "a licence", "x")]
    df = spark.createDataFrame(made, "doc_id long, text string, license string").withColumn("start", F.lit("s")).withColumn("best", F.lit(1))
    got = Counter((r["doc_id"], r["license"]) for r in licenses.scan_licenses(df).collect())
    assert got == Counter({(1, "MIT"): 2, (None, "MIT"): 1, (4, "MIT"): 1, (5, "MIT"): 2, (6, None): 1})
    with pytest.raises(ValueError):
        licenses.Scanner({"none": "words that no notice uses at all"})


# 8


def test_a_hot_id_spreads_over_parts(spark):
    """A third of the rows share an id, another third have none; parts stay of even size and in order."""
    ids = F.when(F.col("id") % 3 == 0, 500).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id"))
    for text in (F.concat(F.lit("text "), F.col("id") % 50), F.lit("the same text")):
        df = spark.range(0, 3000, numPartitions=6).select(ids.cast("long").alias("doc_id"), text.alias("text"))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one part
        parts = flatids.write_flat(df, queries.BYTE_BPE, folder := scratch(spark, "flat")).collect()
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert max(p["docs"] for p in parts) < 1500
        ordered = sorted(parts, key=lambda p: p["base"])
        assert all(a["last_id"] <= b["first_id"] for a, b in pairwise(ordered)) and [p["base"] for p in ordered] == [sum(q["tokens"] for q in ordered[:k]) for k in range(len(ordered))]
        kinds = "first_id long, last_id long, name string, width int, docs long, tokens long, base long"
        back = flatids.read_flat(spark.createDataFrame(parts, kinds), folder).orderBy("start").collect()
        assert [r["doc_id"] for r in back] == sorted((r["doc_id"] for r in df.collect()), key=lambda i: (i is not None, i or 0))


# 9


def plain_regression(x, y, reg=1e-3):
    """Least mean log loss with a penalty on standardised weights, by Newton's steps."""
    scale = x.std(axis=0, ddof=1)
    scale[scale == 0] = np.inf
    z = np.hstack([x / scale, np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], reg)
    penalty[-1] = 0
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        slope = z.T @ (p - y) / len(y) + penalty * w
        curve = (z * (p * (1 - p))[:, None]).T @ z / len(y) + np.diag(penalty + 1e-12)
        w -= np.linalg.solve(curve, slope)
    return lambda rows: (rows / scale) @ w[:-1] + w[-1]


def test_cotraining_query_is_the_plain_loop(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = documents(spark, sf), documents(spark, sf, "labels")  # noqa: F811
    table = docs.collect()
    label = {r["doc_id"]: int(r["quality"]) for r in labels.where("quality is not null").collect()}
    content = np.array([cotrain.content_features((r["text"] or "").encode()) for r in table], np.float32).astype(float)
    meta = np.zeros((len(table), cotrain.SOURCES + cotrain.LANGS + cotrain.SIZES))
    for k, r in enumerate(table):
        meta[k, cotrain.metadata_features(r["source"], r["lang"], r["n_chars"])] = 1
    ids = [r["doc_id"] for r in table]
    aside = {r["id"]: r["a"] for r in spark.createDataFrame([(i,) for i in ids], "id long").select("id", (F.pmod(F.xxhash64("id", F.lit(10)), F.lit(5)) == 0).alias("a")).collect()}
    y = np.array([label.get(i, -1) for i in ids])
    held = np.array([aside[i] for i in ids]) & (y >= 0)
    own, edge = np.where(held, -1, y), log(0.98 / 0.02)
    views = [content, meta]

    def fitted(view, target):
        return plain_regression(views[view][target >= 0], target[target >= 0])

    def sure(view, model):
        odds = model(views[view])
        return np.where(y >= 0, own, np.where(odds >= edge, 1, np.where(odds <= -edge, 0, -1)))

    models = [fitted(0, own), fitted(1, own)]
    for _ in range(2):
        models = [fitted(0, sure(1, models[1])), fitted(1, sure(0, models[0]))]
    odds = []
    for view in (0, 1):
        raw = models[view](views[view])[:, None]
        odds.append(plain_regression(raw[held], y[held])(raw))
    total = odds[0] + odds[1] - log((y == 1).sum() / (y == 0).sum())
    got = {r["doc_id"]: r for r in queries.op9_cotraining(spark, sf).collect()}
    assert set(got) == set(ids)
    for i, x in zip(ids, total, strict=True):
        assert abs(got[i]["score"] - 1 / (1 + exp(-x))) < 0.05 and (got[i]["kept"] == (x >= 0) or abs(x) < 0.3)


@pytest.mark.parametrize("labels", [[(3, 1), (2, 0)], [(3, 1), (99, 0)], [(98, 1), (99, 0)], [(3, 1), (3, 0)], []])
def test_cotraining_with_few_labels(spark, odd, labels):  # noqa: F811
    got = cotrain.score_documents(odd, spark.createDataFrame(labels, "doc_id long, quality int"), keep=odd.columns).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert Counter((r["row"]["doc_id"], r["row"]["text"]) for r in got) == Counter((r[0], r[1]) for r in ROWS)


# the pipeline


def test_pipeline_stages_on_awkward_rows(spark, odd, empty, tmp_path):  # noqa: F811
    """Nulls, repeats, one id on different texts, clashing names, an empty table: rows are judged by themselves."""
    import corpus_pipeline

    spark.createDataFrame([(3, 1), (6, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    more = odd.withColumns({c: F.lit(c) for c in ("found", "row", "rejected_id", "dropped_id", "kept", "component_id")})
    more = more.union(more.where("doc_id = 4").withColumns({"doc_id": F.lit(3).cast("long"), "text": F.lit("quite another text under the same id, with letters")}))
    language, quality, near, packing = (stage for _, stage in corpus_pipeline.STAGES)
    first = language(spark, more, str(tmp_path))
    assert first.columns == more.columns
    key = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    assert key(first) == Counter({k: n for k, n in key(more).items() if k[1] and k[1].strip()})
    assert first.where("lang is null").isEmpty()
    second = quality(spark, first, str(tmp_path))
    assert second.columns == more.columns and not key(second) - key(first)
    third = near(spark, more, str(tmp_path))
    assert third.columns == more.columns
    fps = Counter(plain_fingerprint(r["text"]) for r in third.collect())
    assert set(fps) == {plain_fingerprint(t) for _, t in key(more)} and set(fps.values()) == {1}
    kept = {plain_fingerprint(r["text"]): r["doc_id"] for r in third.collect()}
    assert kept[plain_fingerprint(ROWS[2][1])] == 3 and kept[0] == 1
    check_packing(third, packing(spark, third, str(tmp_path)).collect(), 2048)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, more.limit(0), str(tmp_path)).count() == 0


def test_pipeline_is_the_plain_one(spark, sf):
    """Stage by stage from the same input: predicted languages, verdicts of the classifier's own scores, one row for each component."""
    import corpus_pipeline

    table = documents(spark, sf)
    languages = {r["doc_id"]: r["lang_pred"] for r in langid.identify(table, langid.train_model(table)).collect()}
    first = corpus_pipeline.identify_language(spark, table, sf)
    assert {(r["doc_id"], r["lang"]) for r in first.collect()} == {x for x in languages.items() if x[1] != "und"}
    kept = {r["doc_id"] for r in cotrain.score_documents(table, documents(spark, sf, "labels")).where("kept").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.classify_quality(spark, table, sf).collect()} == kept
    fps = [(r["doc_id"], plain_fingerprint(r["text"])) for r in table.collect()]
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, table, sf).collect()) == sorted({*plain_components(fps).values()})


# rows, texts and paths that an earlier form got wrong


@pytest.mark.parametrize("every", [80, 200, 400])
def test_notices_in_long_prose(rows, every):  # noqa: F811
    """A whole template in prose of any length, with a word that notices use here and there."""
    scanner = licenses.Scanner(licenses.TEMPLATES)
    prose = [w for x in [*rows.values()][:60] for w in (x or "").split() if not licenses._HINT.search(w)]
    for size in (1000, 3000, 6000, 20_000):
        base = [prose[i % len(prose)] if i % every else "software" for i in range(size)]
        for name, template in licenses.TEMPLATES.items():
            text = " ".join([*base[: size // 2], template, *base[size // 2 :]])
            found = Counter(r[2] for r in scanner.rows(text) if r[2])
            assert found[name] == 1, (name, size)
            if size == 1000:
                assert found == plain_notices(text), (name, size)


def test_rows_without_text_teach_and_count_nothing(spark):
    german = spark.createDataFrame([(k, f"der hund läuft schnell über die straße nummer {'abcdefghij'[k % 10] * 3} und die katze schläft {k}", "de") for k in range(300)], "doc_id long, text string, lang string")
    nothing = spark.range(1000, 401_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "12 ?!").alias("text"), F.lit("de").alias("lang"))
    alone, among = langid.train_model(german), langid.train_model(german.union(nothing))
    assert alone.langs == among.langs and len(alone.langs[0][1]) > 10_000


def test_a_repeated_row_keeps_its_language(spark):
    same = spark.range(50_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("le chien court vite dans la rue").alias("text"), F.lit("fr").alias("lang"))
    other = spark.range(50_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the dog runs fast in the street "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    mixed = same.union(same.limit(0)).union(other).union(spark.range(5000).select(F.col("id"), F.concat(F.lit("der hund läuft "), F.col("id")), F.lit("fr")))
    model = langid.train_model(same.union(other))
    assert [x[0] for x in model.langs] == ["en", "fr"] and dict(model.langs)["fr"] == b"le chien court vite dans la rue"
    assert len(dict(langid.train_model(mixed).langs)["fr"]) > 1000  # the repeated row doesn't fill the sample


def test_unbroken_texts_take_linear_time(rows):  # noqa: F811
    import time

    own = pieces.compiled(queries.PIECE_BPE)
    letters = "".join(x or "" for x in rows.values()).replace(" ", "").replace("\n", "")[:1_000_000]
    letters = (letters * (1_000_000 // len(letters) + 1))[:1_000_000]
    own.encode(letters[:50_000])
    took = []
    for n in (100_000, 800_000):
        began = time.perf_counter()
        ids = np.frombuffer(own.encode(letters[:n]), own.width)
        took.append(time.perf_counter() - began)
        assert own.decode(ids.tolist()) == letters[:n]
    assert took[1] < 24 * took[0]  # 64 times as long if each step copied the rest


def test_shards_where_paths_need_escaping(spark, tmp_path):
    root = f"file://{tmp_path}/a b+c%20d[1]{{x}}"
    store = sharding.ShardStore(spark, root)
    for k in range(5):
        store.append(spark.range(10 * k, 10 * k + 10, numPartitions=1))
    assert store.read().count() == 50
    version = store.compact()
    store.vacuum()
    assert sorted(r[0] for r in store.read(version).collect()) == list(range(50)) and store.manifest(version).count() == 1


def test_the_least_id_isnt_null(spark):
    least = -(1 << 63)
    table = spark.createDataFrame([(least, "a"), (None, "b"), (None, "c"), (least + 1, "d"), (0, "e")], "doc_id long, text string")
    got = flatids.flat_round_trip(spark, table, queries.BYTE_BPE).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got) == [(False, 0), (False, 0), (True, least), (True, least + 1), (True, 0)]
    assert [r["start"] for r in sorted(got, key=lambda r: r["start"])] == [0, 2, 4, 6, 8]
