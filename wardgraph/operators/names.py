"""Names that people write: lookup, suggestions for names that fit nothing, and selectors that stand for many objects.

Everything is an equi-join on keys exploded from the names (ids, full and display names, hosts, characters), so no name is compared with all others.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..storage import materialise, shuffled
from .derive import domain_controllers
from .fixpoint import closure
from .tiering import memberships
from .whatif import ChangeError


def normalised(ref: Column) -> Column:
    """``CN=Help Desk,OU=..`` as Help Desk, ``DC=corp,DC=local`` as corp.local, ``CORP\\alice`` as alice; in lower case."""
    v = F.trim(ref)
    upper = F.upper(v)
    parts = F.array_join(F.transform(F.filter(F.split(v, ","), lambda p: F.upper(F.trim(p)).startswith("DC=")), lambda p: F.trim(F.substring_index(F.trim(p), "=", -1))), ".")
    first = F.trim(F.regexp_extract(v, "^[^=]*=([^,]*)", 1))
    local = F.regexp_replace(v, r"^[^\\]*\\", "")
    return F.lower(F.when(upper.startswith("DC="), parts).when(upper.startswith("CN=") | upper.startswith("OU="), first).when(v.contains("\\") & ~v.contains("@"), local).otherwise(v))


def _host(name: Column) -> Column:
    return F.split_part(name, F.lit("."), F.lit(1))


def lookup(queries: DataFrame, nodes: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(query, object_id, stage): objects that a name (query) fits at its best stage: 1 id, 2 full name, 3 display name, 4 host. With
    ``types`` only those objects count. Null queries fit nothing."""
    q = queries.where("query is not null").select("query").distinct().withColumn("r", normalised(F.col("query")))
    host = F.when(~F.col("r").contains("@"), _host(F.rtrim(F.col("r"), F.lit("$"))))
    asked = q.select("query", F.explode(F.array(*[F.struct(F.lit(k).alias("stage"), key.alias("key")) for k, key in ((1, F.col("r")), (2, F.col("r")), (3, F.col("r")), (4, host))])).alias("x")).select("query", "x.*")
    known = nodes if types is None else nodes.where(F.col("node_type").isin(types))
    shown = F.lower(scalars.display_name(F.col("name")))
    keys = F.array(*[F.struct(F.lit(k).alias("stage"), key.alias("key")) for k, key in ((1, F.lower("object_id")), (2, F.lower("name")), (3, shown), (4, F.when(F.col("node_type") == "Computer", _host(shown))))])
    fits = asked.join(known.select("object_id", F.explode(keys).alias("x")).select("object_id", "x.*"), ["stage", "key"]).select("query", "object_id", "stage")
    best = fits.groupBy("query").agg(F.min("stage").alias("stage"))
    return fits.join(best, ["query", "stage"]).select("query", "object_id", "stage").distinct()


#: So many names with the same letters, texts with the same letters, and sets of letters of either are matched at once.
_NAMES, _TEXTS, _SETS = 4096, 64, (1024, 256)


def _sorted(text: pa.Array) -> pa.Array:
    """The letters of a text in order: equal for texts that have the same as often."""
    return pa.array([None if x is None else "".join(sorted(x)) for x in text.to_pylist()], pa.string())


def _counts(texts: list[str], places: dict[str, int]) -> np.ndarray:
    out = np.zeros((len(texts), len(places)), np.int32)
    for row, text in zip(out, texts, strict=True):
        for c in text:
            if (at := places.get(c)) is not None:
                row[at] += 1
    return out


def _bounded(best: int | None) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """Of letters asked (letters, least) and letters of names: the pairs whose bound is at least ``least``, or only the ``best`` of each asked."""

    def found(asked: pa.Array, known: pa.Array) -> pa.Array:
        out = []
        for asks, names in zip(asked.to_pylist(), known.to_pylist(), strict=True):
            texts = [x["letters"] for x in asks]
            places = {c: i for i, c in enumerate(sorted({*"".join(texts)}))}
            left, right = _counts(texts, places), _counts(names, places)
            common = sum(np.minimum(left[:, None, i], right[None, :, i]) for i in range(len(places)))
            bound = 2.0 * common / (np.array([*map(len, texts)])[:, None] + np.array([*map(len, names)])[None, :])
            rows = []
            for ask, row in zip(asks, bound, strict=True):
                at = np.flatnonzero(row >= ask["least"])
                if best is not None:
                    at = at[np.argsort(-row[at], kind="stable")][:best]
                rows += [{"asked": ask["letters"], "letters": names[i], "bound": row[i]} for i in at]
            out.append(rows)
        return pa.array(out, pa.list_(pa.struct({"asked": pa.string(), "letters": pa.string(), "bound": pa.float64()})))

    return found


def _subsequences(texts: list[str], names: list[str]) -> np.ndarray:
    """The length of the longest common subsequence of each text and each name, all of one length; for texts of over 64 characters what it is at most.
    A number holds a row of the usual table as bits."""
    m = len(names[0])
    symbols, at = np.unique(np.array(names, f"U{m}").view(np.uint32).reshape(-1, m), return_inverse=True)
    at, places = at.reshape(-1, m), {chr(c): i for i, c in enumerate(symbols)}
    there = np.zeros((len(texts), len(symbols)), np.uint64)
    for row, text in zip(there, texts, strict=True):
        for i, c in enumerate(text[:64]):
            if c in places:
                row[places[c]] |= np.uint64(1 << i)
    state = np.full((len(texts), len(names)), ~np.uint64(0))
    for i in range(m):
        both = state & there[:, at[:, i]]
        state = (state + both) | (state - both)
    own = np.array([(1 << min(len(x), 64)) - 1 for x in texts], np.uint64)
    found = np.bitwise_count(~state & own[:, None]).astype(np.int64)
    long = np.array([len(x) > 64 for x in texts])
    found[long] = np.minimum([len(x) for x in texts], m)[long, None]
    return found


def _nearest(most: int) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """Of texts asked (r, least) and names with the same letters: the ``most`` names of each text with the highest ratios of matching characters, if these are at
    least ``least``; ties: the last in the alphabet. Common subsequences bound the ratios, and the exact ones are taken from the highest bound down."""

    def found(asked: pa.Array, known: pa.Array) -> pa.Array:
        matcher, out = difflib.SequenceMatcher(), []
        for asks, names in zip(asked.to_pylist(), known.to_pylist(), strict=True):
            names, rows = sorted(names, reverse=True), []
            texts = [x["r"] for x in asks]
            bounds = 2.0 * _subsequences(texts, names) / (np.array([*map(len, texts)])[:, None] + len(names[0]))
            for ask, bound in zip(asks, bounds, strict=True):
                at, top = np.flatnonzero(bound >= ask["least"]), []
                if at.size:
                    matcher.set_seq2(ask["r"])
                for i in at[np.argsort(-bound[at], kind="stable")]:
                    if len(top) == most and (bound[i], names[i]) <= top[-1]:
                        break
                    matcher.set_seq1(names[i])
                    if (ratio := matcher.ratio()) >= ask["least"]:
                        top = sorted([*top, (ratio, names[i])], reverse=True)[:most]
                rows += [{"r": ask["r"], "key": key, "ratio": ratio} for ratio, key in top]
            out.append(rows)
        return pa.array(out, pa.list_(pa.struct({"r": pa.string(), "key": pa.string(), "ratio": pa.float64()})))

    return found


def _packed(rows: DataFrame, by: str, value: str, most: int, name: str) -> DataFrame:
    """(by, part, ``name``): the values of each key in arrays of about ``most``."""
    counted = rows.groupBy(by).agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64(value), F.ceil(F.col("n") / most))
    return rows.join(shuffled(counted), by).groupBy(by, part.alias(f"{name}_part")).agg(F.collect_list(value).alias(name))


def suggestions(queries: DataFrame, nodes: DataFrame, most: int = 3, cutoff: float = 0.6) -> DataFrame:
    """(query, place, suggestion): the ``most`` names most like a query, of a ratio of ``cutoff`` or more (ties: the last in the alphabet first). Names are
    display names, and hosts' names without their domain.

    Characters that two names share, counted as often as both have them, bound the ratio from above. Far fewer sets of letters than names exist, so the
    bound is taken of these, in blocks. Names of the likeliest sets give each query ``most`` ratios; then only names whose bounds reach the least of these are
    matched, so that none which could take its place is left out.
    """
    spark = nodes.sparkSession
    shown = scalars.display_name(F.col("name"))
    letters = F.arrow_udf(_sorted, "string")
    full = nodes.groupBy(F.lower(shown).alias("key")).agg(F.min(shown).alias("suggestion"))
    hosts = nodes.where("node_type = 'Computer'").groupBy(_host(F.lower(shown)).alias("key")).agg(F.min(shown).alias("suggestion"))
    pool = full.union(hosts.join(full.select("key"), "key", "left_anti")).where("key <> ''")
    pool = materialise(pool.withColumn("letters", letters("key")), "pool")
    asked = queries.where("query is not null").select("query").distinct().withColumn("r", F.rtrim(normalised(F.col("query")), F.lit("$"))).where("r <> ''")
    asked = materialise(asked, "asked")
    texts = materialise(asked.select("r").distinct().select("r", letters("r").alias("letters")), "texts")
    known = materialise(pool.select("letters").distinct(), "known")
    names = materialise(_packed(pool.select("letters", "key"), "letters", "key", _NAMES, "names"), "names")
    blocks = -(-known.count() // _SETS[0]) or 1
    parts = -(-texts.select("letters").distinct().count() // _SETS[1]) or 1
    tasks = spark.sparkContext.defaultParallelism * 4
    sets = known.groupBy(F.pmod(F.xxhash64("letters"), F.lit(blocks)).alias("block")).agg(F.collect_list("letters").alias("known"))
    sets = materialise(sets, "sets")

    def matched(wanted: DataFrame, best: int | None) -> DataFrame:
        """(r, key, ratio) of the highest ratios of texts (r, letters, least), ``most`` at least of each, from names of all letters that reach ``least`` or of the ``best``."""
        lowest = wanted.groupBy("letters").agg(F.min("least").alias("least")).withColumn("x", F.struct("letters", "least"))
        lists = lowest.groupBy(F.pmod(F.xxhash64("letters"), F.lit(parts)).alias("part")).agg(F.collect_list("x").alias("asked"))
        both = lists.select("part", "asked", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")).join(shuffled(sets), "block")
        both = both.repartition(min(tasks, parts * blocks), "part", "block").select(F.explode(F.arrow_udf(_bounded(best), "array<struct<asked: string, letters: string, bound: double>>")("asked", "known")).alias("x")).select("x.*")
        if best is not None:
            both = both.withColumn("k", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("bound"), "letters"))).where(F.col("k") <= best)
        asks = _packed(wanted.select("letters", F.struct("r", "least").alias("x")), "letters", "x", _TEXTS, "asks").withColumnRenamed("letters", "asked")
        rows = materialise(both.select("asked", "letters"), "pairs").join(shuffled(asks), "asked").join(shuffled(names), "letters").repartition(tasks, "asked", "asks_part", "letters", "names_part")
        found = rows.select(F.explode(F.arrow_udf(_nearest(most), "array<struct<r: string, key: string, ratio: double>>")("asks", "names")).alias("x"))
        return found.select("x.*")

    first = matched(texts.withColumn("least", F.lit(cutoff)), most).groupBy("r").agg(F.sort_array(F.collect_list("ratio"), False).alias("ratios"))
    least = F.coalesce(F.get("ratios", most - 1), F.lit(cutoff)).alias("least")
    wanted = materialise(texts.join(shuffled(first), "r", "left").select("r", "letters", least), "wanted")
    rated = matched(wanted, None).join(shuffled(asked), "r")
    order = Window.partitionBy("query").orderBy(F.desc("ratio"), F.desc("key"))
    best = rated.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).join(shuffled(pool.select("key", "suggestion")), "key")
    once = best.groupBy("query", "suggestion").agg(F.min("place").alias("place"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("place"))).select("query", "place", "suggestion")


_MEMBERS = r"^@members(\*?)\((.+)\)$"


def _selected(refs: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((query, id) of all that refs (query) stand for, (query, problem))."""
    trimmed = F.trim("query")
    group = F.regexp_extract(trimmed, _MEMBERS, 2)
    refs = refs.select("query", group.alias("group"), (F.regexp_extract(trimmed, _MEMBERS, 1) == "*").alias("deep"), F.lower(trimmed).alias("word"))
    named = refs.where("group = '' and word not in ('@dcs', '<domain>')")
    own = lookup(named, nodes)
    groups = lookup(refs.where("group <> ''").select(F.col("group").alias("query")), nodes, ["Group"])

    def one(found: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Objects of names that fit one, and what is wrong with the others."""
        counted = asked.join(found.groupBy("query").agg(F.count("*").alias("n"), F.min("object_id").alias("id")), "query", "left")
        wrong = counted.where("n is null or n > 1").select("query", F.when(F.col("n").isNull(), "not found").otherwise("fits several objects").alias("problem"))
        return counted.where("n = 1").select("query", "id"), wrong

    ids, wrong = one(own, named.select("query"))
    chosen, wrong_groups = one(groups, refs.where("group <> ''").select(F.col("group").alias("query")).distinct())
    wanted = refs.where("group <> ''").join(chosen.select(F.col("query").alias("group"), F.col("id").alias("origin")), "group")
    kinds = nodes.select(F.col("object_id").alias("id"), "node_type")
    below = closure(wanted.select("origin").distinct().withColumn("id", F.col("origin")), memberships(edges), "dst", "src").where("depth > 0").join(kinds, "id")
    deep = wanted.where("deep").join(below.where("node_type <> 'Group'"), "origin").select("query", "id")
    direct = wanted.where("not deep").join(below.where("depth = 1"), "origin").select("query", "id")
    controllers = refs.where("word = '@dcs'").select("query").crossJoin(domain_controllers(nodes, edges))  # one selector
    domains = nodes.where("node_type = 'Domain'").select(F.col("object_id").alias("id"))
    root = domains.agg(F.count("*").alias("n"), F.min("id").alias("id"))  # one row
    domain = refs.where("word = '<domain>'").select("query").crossJoin(root)
    found = ids.union(direct).union(deep).union(controllers).union(domain.where("n = 1").select("query", "id"))
    problems = (
        wrong.union(refs.join(wrong_groups.withColumnRenamed("query", "group"), "group").select("query", F.concat(F.lit("group "), F.col("problem"))))
        .union(refs.where("word = '@dcs'").select("query").join(controllers.select("query"), "query", "left_anti").select("query", F.lit("no domain controllers")))
        .union(domain.where("n <> 1").select("query", F.concat(F.lit("name the domain: there are "), F.col("n"))))
    )
    return found.distinct(), problems


#: So many objects on either side of a change are paired at once, which Spark holds as rows until they are read; a task makes about so many pairs.
_SOURCES, _TARGETS, _ROWS = 32, 1024, 1 << 21


def expand_changes(changes: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``changes`` with names and selectors turned into ids, a row for each pair that they stand for: ``@members(G)`` direct members,
    ``@members*(G)`` all members that are no groups, ``@dcs`` domain controllers, ``<domain>`` the only domain. A pair of one object with itself is none, and of changes that
    come to the same the first stays. All names that fit nothing or several are told in one error, with suggestions."""
    refs = changes.select(F.explode(F.array("src", "dst")).alias("query")).where("query is not null").distinct()
    found, problems = _selected(refs, nodes, edges)
    found = materialise(found, "selected")
    wrong = problems.orderBy("query").collect()  # as many as names in the change file
    if wrong:
        unknown = nodes.sparkSession.createDataFrame([(r["query"],) for r in wrong if r["problem"] == "not found"], "query string")
        hints: dict[str, list[str]] = {}
        for r in suggestions(unknown, nodes).orderBy("query", "place").collect():
            hints.setdefault(r["query"], []).append(r["suggestion"])
        raise ChangeError("\n".join(f"{r['query']}: {r['problem']}" + (f"; did you mean {', '.join(hints[r['query']])}?" if r["query"] in hints else "") for r in wrong))
    # objects that the same names stand for are alike in all changes, so which change of a pair is the first is settled for classes of them
    sets = materialise(found.groupBy("id").agg(F.array_sort(F.collect_set("query")).alias("names")), "sets")
    classes = materialise(sets.groupBy("names").agg(F.min("id").alias("class"), F.count("*").alias("n")), "classes")
    named = classes.select("class", "n", F.explode("names").alias("query"))
    one, two = named.toDF("a", "m", "src"), named.toDF("b", "n", "dst")
    lines = changes.join(one, "src").join(two, "dst", "left").where("dst is null or b is not null")
    lines = materialise(lines.groupBy("op", "edge_type", "a", "m", "b", "n").agg(F.min(F.struct("idx", "ttl_minutes")).alias("x")).select("x.*", "op", "edge_type", "a", "m", "b", "n"), "lines")
    members = sets.join(classes, "names").select("class", "n", "id")

    def packed(most: int, key: str, name: str) -> DataFrame:
        """The members of classes in arrays of about ``most``."""
        part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / most))
        return members.groupBy(F.col("class").alias(key), part.alias(f"{key}_part")).agg(F.collect_list("id").alias(name))

    # rows are made from these arrays in many tasks and never shuffled
    total = lines.agg(F.sum(F.col("m") * F.coalesce("n", F.lit(1)))).first()[0] or 0
    tasks = max(nodes.sparkSession.sparkContext.defaultParallelism, total // _ROWS)
    blocks = lines.join(shuffled(packed(_SOURCES, "a", "sources")), "a").join(shuffled(packed(_TARGETS, "b", "targets")), "b", "left").repartition(tasks, "idx", "a", "a_part", "b", "b_part")
    rows = blocks.select("idx", "op", F.explode("sources").alias("src"), "edge_type", "targets", "ttl_minutes")
    return rows.select("idx", "op", "src", "edge_type", F.explode_outer("targets").alias("dst"), "ttl_minutes").where("dst is null or src <> dst")
