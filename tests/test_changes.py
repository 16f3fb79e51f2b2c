"""Changes as deltas that can be undone, forecasts from kept states, combined effects, and weighted routes, against plain versions."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from wardgraph.functions import registry
from wardgraph.operators import maintained, paths, whatif

from .test_exposure import ATTACK, EDGES, INPUT, KINDS, graph

NODES = "object_id string, name string, node_type string, enabled boolean, admin_count boolean"


def changes(spark, rows):
    return spark.createDataFrame(rows, whatif.CHANGES)


def test_undo_gives_the_edges_back(spark):
    """Random change files over random graphs, one version after another; every version can be read again."""
    for seed in range(3):
        rng = random.Random(seed)
        names, _, edges = graph(9000 + seed)
        base = spark.createDataFrame(edges + edges[:2], EDGES)
        state, log, want, tables = set(edges), None, [set(edges)], base
        for version in range(1, 4):
            rows = []
            for i in range(rng.randint(0, 7)):
                op = rng.choice(["add", "add", "remove", "remove", "remove*", "delete", "move"])
                a, b = rng.sample(names, 2)
                kind = rng.choice(sorted(state))[2] if state else "MemberOf"
                a, b = rng.choice(sorted(state))[:2] if state and op.startswith("remove") and rng.random() < 0.8 else (a, b)
                rows.append((i, op.rstrip("*"), a, "*" if op in ("remove*", "delete") else "Contains" if op == "move" else kind, None if op == "delete" else b, None))
            gone = {e for e in state for _, op, s, k, d, _ in rows if (op == "remove" and e[:2] == (s, d) and (e[2] == k or (k == "*" and e[2] not in registry.PLAIN_STRUCTURE))) or (op == "delete" and s in e[:2]) or (op == "move" and e[1] == s and e[2] == "Contains")}
            new = {(s, d, k) for _, op, s, k, d, _ in rows if op == "add"} | {(d, s, "Contains") for _, op, s, k, d, _ in rows if op == "move"}
            delta = whatif.deltas(tables, changes(spark, rows))
            after = (state - gone) | new
            assert {tuple(r) for r in delta.removed.collect()} == state - after and {tuple(r) for r in delta.added.collect()} == after - state
            done = whatif.applied(tables, delta)
            assert sorted(map(tuple, done.collect())) == sorted(after)
            assert sorted(map(tuple, whatif.undone(done, delta).collect())) == sorted(state)
            log = whatif.logged(version, delta) if log is None else log.union(whatif.logged(version, delta))
            state = after
            want.append(after)
            tables = spark.createDataFrame(sorted(after), EDGES)
        for version, edges_then in enumerate(want):
            assert sorted(map(tuple, whatif.edges_at(base, log, version).collect())) == sorted(edges_then)


def test_forecast_is_the_impact(spark):
    """With memberships in tier-0 groups among the changes, so that objects are promoted and demoted."""
    names = [f"S-1-5-21-{i}" for i in range(9)] + ["S-1-5-21-1-512"]
    kinds = ["Group" if i % 3 == 0 else "User" for i in range(9)] + ["Group"]
    nodes = spark.createDataFrame([(n, n, k, True, False) for n, k in zip(names, kinds, strict=True)], NODES)
    for seed in range(3):
        rng = random.Random(seed)
        pick = lambda n: [(a, b, rng.choice(KINDS)) for a, b in (rng.sample(names, 2) for _ in range(n))]  # noqa: E731, B023
        edges = sorted(set(pick(18) + [("S-1-5-21-0", names[-1], "MemberOf")]))
        rows = [(i, "remove", a, k, b, None) for i, (a, b, k) in enumerate(rng.sample(edges, 5))] + [(10 + i, "add", a, k, b, None) for i, (a, b, k) in enumerate(pick(3) + [(rng.choice(names[:9]), "S-1-5-21-0", "MemberOf")])]
        table = spark.createDataFrame(edges, EDGES)
        change = changes(spark, rows)
        top = whatif.tier0(nodes, table)
        got = whatif.forecast(nodes, table, maintained.keep(table, top), top, change)
        want = whatif.impact(nodes, table, whatif.apply_changes(table, change))
        for x, y in zip(got.impact, want, strict=True):
            assert sorted(map(tuple, x.collect()), key=str) == sorted(map(tuple, y.collect()), key=str)


def needs_of(names, top, edges, added):
    """For each object that isn't exposed now, the least sets of additions that expose it."""

    def exposed(es):
        onward = {}
        for a, b, k in es:
            if k not in INPUT and a not in top:
                onward.setdefault(b, []).append((a, k))
        seen, todo = {(t, False) for t in top}, [(t, False) for t in top]
        while todo:
            at, hit = todo.pop()
            for a, k in onward.get(at, ()):
                s = a, hit or k in ATTACK
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return {a for a, hit in seen if hit and a not in top}

    now, out = exposed(edges), {}
    for n in range(1, len(added) + 1):
        for some in combinations(sorted(added), n):
            for x in exposed(edges + [added[i] for i in some]) - now:
                if not any(set(y) < set(some) for y in out.get(x, [])):
                    out.setdefault(x, []).append(list(some))
    return out


def test_least_sets_of_changes(spark):
    """All graphs in one table, each with four additions of its own."""
    want, edges, tops, added = {}, [], [], []
    for seed in range(60):
        names, top, es = graph(12_000 + seed)
        rng = random.Random(seed)
        es = [e for e in es if rng.random() < 0.6]
        own = {10 * seed + i: (*rng.sample(names, 2), rng.choice(KINDS)) for i in range(4)}
        want |= needs_of(names, top, es, own)
        edges, tops, added = edges + es, tops + [(t,) for t in top], added + [(i, *e) for i, e in own.items()]
    table, top = spark.createDataFrame(edges, EDGES), spark.createDataFrame(tops, "id string")
    new = spark.createDataFrame(added, "idx int, " + EDGES)
    kept = maintained.keep(table, top)
    got = whatif.combined_effects(table, top, kept, new).collect()
    assert {r["id"]: sorted(r["needs"]) for r in got} == {k: sorted(v) for k, v in want.items()} and not any(r["unknown"] for r in got)
    assert any(min(map(len, v)) == 2 for v in want.values()) and any(len(v) > 1 for v in want.values())
    few = whatif.combined_effects(table, top, kept, new, sets=1).collect()
    assert {r["id"] for r in few} == {*want} and any(r["unknown"] for r in few)


def test_three_changes_that_need_one_another(spark):
    edges = spark.createDataFrame([("u", "g", "MemberOf"), ("x", "u", "GenericAll")], EDGES)
    top = spark.createDataFrame([("top",)], "id string")
    added = spark.createDataFrame([(1, "g", "h", "MemberOf"), (2, "h", "k", "MemberOf"), (3, "k", "top", "GenericAll"), (4, "y", "z", "GenericAll")], "idx int, " + EDGES)
    got = {r["id"]: (r["needs"], r["unknown"]) for r in whatif.combined_effects(edges, top, maintained.keep(edges, top), added).collect()}
    assert got == {"u": ([[1, 2, 3]], False), "g": ([[1, 2, 3]], False), "x": ([[1, 2, 3]], False), "h": ([[2, 3]], False), "k": ([[3]], False)}
    short = {r["id"]: r["unknown"] for r in whatif.combined_effects(edges, top, maintained.keep(edges, top), added, most=2).collect()}
    assert short["u"] and not short["h"]


def test_weighted_routes_are_least(spark):
    dim = {e["edge_type"]: e["weight"] for e in registry.edge_dim(spark).collect()}
    edges, starts, targets, want = [], [], [], {}
    for seed in range(40):
        rng = random.Random(seed)
        names, _, es = graph(20_000 + seed)
        es = es + [(a, b, "MemberOf") for a, b in zip(names, names[1:], strict=False)]
        weight = {}
        for a, b, k in es:
            weight[a, b] = min(weight.get((a, b), (1e9, "")), (dim.get(k, 100.0), k))
        own, goals = names[:2], rng.sample(names, 3)
        for s in own:
            cost = {s: 0.0}
            for _ in names:
                for (a, b), (w, _) in weight.items():
                    if a in cost and cost[a] + w < cost.get(b, 1e9) - 1e-7:
                        cost[b] = cost[a] + w
            want |= {(s, t): cost[t] for t in goals if t in cost}
        edges, starts, targets = edges + es, starts + own, targets + goals
    table = spark.createDataFrame(edges, EDGES)
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id string")
    got = paths.cheapest_routes_to_targets(ids(starts), ids(targets), table).collect()
    assert {(r["origin"], r["target"]): round(r["cost"], 6) for r in got} == {k: round(v, 6) for k, v in want.items()} and len(got) == len(want)
    known = set(edges)
    for r in got:
        hops = list(zip(r["nodes"], r["nodes"][1:], r["edge_types"], strict=False))
        assert (r["nodes"][0], r["nodes"][-1], len(r["nodes"])) == (r["origin"], r["target"], len(r["edge_types"]) + 1)
        assert all(h in known for h in hops) and abs(sum(dim.get(k, 100.0) for _, _, k in hops) - r["cost"]) < 1e-6
        assert all(dim.get(k, 100.0) == min(dim.get(x, 100.0) for a, b, x in known if (a, b) == h) for *h, k in [(x, y, k) for x, y, k in hops] for h in [tuple(h)])
    assert any(len(r["edge_types"]) > 4 for r in got)
    assert paths.cheapest_routes_to_targets(ids(["nowhere"]), ids(["nowhere", "else"]), table).select(F.col("nodes")).collect()[0]["nodes"] == ["nowhere"]
