"""Exposure kept under changes against a new search, on random graphs and sequences of changes."""

import random

import pytest
from pyspark.sql import functions as F

from wardgraph.operators import exposure, maintained

from .test_exposure import EDGES, KINDS, graph


def changed(seed, names, top, edges, step):
    """(edges, top) after a random change of one graph."""
    rng = random.Random(1000 * seed + step)
    left = [e for e in edges if rng.random() > (0.25 if rng.random() < 0.7 else 0)]
    new = {(a, b, rng.choice(KINDS)) for a in names for b in names if a != b and rng.random() < 0.06 * rng.randint(0, 2)}
    top = set(top)
    if rng.random() < 0.3:
        top ^= {rng.choice(names)}
    return sorted({*left, *new}), sorted(top or names[:1])


def rows(df):
    return sorted((r["id"], r["attacked"], r["depth"]) for r in df.select("id", "attacked", "depth").collect())


def test_updates_equal_a_new_search(spark):
    """80 graphs in one table, three changes one after the other: edges go and come, objects enter and leave tier 0."""
    parts = [graph(5000 + s) for s in range(80)]
    names = [p[0] for p in parts]
    edges, tops = [p[2] for p in parts], [p[1] for p in parts]
    table = lambda es: spark.createDataFrame([e for x in es for e in x], EDGES)
    ids = lambda xs: spark.createDataFrame([(t,) for t in xs], "id string")
    kept = maintained.keep(table(edges), ids([t for ts in tops for t in ts]))
    first = kept
    for step in range(3):
        after = [changed(s, names[s], tops[s], edges[s], step) for s in range(len(parts))]
        new_edges, new_tops = [a[0] for a in after], [a[1] for a in after]
        gone = [[e for e in x if e not in set(y)] for x, y in zip(edges, new_edges, strict=True)]
        came = [[e for e in y if e not in set(x)] for x, y in zip(edges, new_edges, strict=True)]
        up = [t for x, y in zip(tops, new_tops, strict=True) for t in set(y) - set(x)]
        down = [t for x, y in zip(tops, new_tops, strict=True) for t in set(x) - set(y)]
        top_before, top_after = ids([t for ts in tops for t in ts]), ids([t for ts in new_tops for t in ts])
        before, kept = kept, maintained.update(kept, table(new_edges), top_after, table(gone), table(came), ids(up), ids(down))
        want = exposure.states(table(new_edges), top_after)
        assert rows(kept.table()) == rows(want)
        # the next steps lead there
        depth = {(i, a): d for i, a, d in rows(want)}
        walk = {(a, b, k) for x, ts in zip(new_edges, new_tops, strict=True) for a, b, k in x if a not in set(ts)}
        for r in kept.table().where("depth > 0").collect():
            assert (r["id"], r["next_id"], r["edge_type"]) in walk and depth[r["next_id"], r["next_attacked"]] == r["depth"] - 1
        got = {r["id"]: (r["hops_before"], r["hops_after"]) for r in maintained.changes_of(before, kept, top_before, top_after).collect()}
        b = {r["id"]: r["hops"] for r in exposure.exposed(table(edges), top_before).collect()}
        a = {r["id"]: r["hops"] for r in exposure.exposed(table(new_edges), top_after).collect()}
        assert got == {i: (b.get(i), a.get(i)) for i in {*a, *b} if a.get(i) != b.get(i)}
        edges, tops = new_edges, new_tops
    assert kept.base is first.base  # the first table is never written again


def test_an_update_touches_what_changes(spark):
    """Two branches below tier 0: a change of one leaves no row of the other in the overlay."""
    chain = lambda p: [(f"{p}{i + 1}", f"{p}{i}", "GenericAll") for i in range(12)] + [(f"{p}0", "top", "MemberOf")]
    edges = spark.createDataFrame(chain("a") + chain("b"), EDGES)
    top = spark.createDataFrame([("top",)], "id string")
    kept = maintained.keep(edges, top)
    gone = edges.where("src = 'a5'")
    after = maintained.update(kept, edges.exceptAll(gone), top, gone, spark.createDataFrame([("a7", "b0", "GenericWrite")], EDGES))
    got = {r["id"]: r["depth"] for r in after.overlay.collect()}
    assert {*got} == {f"a{i}" for i in range(5, 13)} and got["a5"] is None and got["a7"] == 2 and got["a12"] == 7
    nothing = spark.createDataFrame([], EDGES)
    same = maintained.update(after, edges, top, nothing, nothing)
    assert rows(same.table()) == rows(after.table())


@pytest.mark.parametrize("kind", ["Enroll", "MemberOf"])
def test_edges_that_are_never_walked(spark, kind):
    edges = spark.createDataFrame([("a", "top", "GenericAll")], EDGES)
    top = spark.createDataFrame([("top",)], "id string")
    kept = maintained.keep(edges, top)
    new = spark.createDataFrame([("top", "a", "MemberOf"), ("b", "top", kind), (None, "top", "GenericAll"), ("c", None, "GenericAll")], EDGES)
    after = maintained.update(kept, edges.union(new), top, spark.createDataFrame([], EDGES), new)
    got = {(r["id"], r["attacked"]) for r in after.table().where(F.col("id").isNotNull()).collect()}
    assert got == {("top", False), ("a", True)} | ({("b", False)} if kind == "MemberOf" else set())
