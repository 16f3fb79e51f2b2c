"""Exposure against plain search on many small random graphs, all of which are parts of one table."""

import random
from collections import deque

import pytest

from wardgraph.operators import exposure, fixpoint, paths

KINDS = ["MemberOf", "MemberOf", "Contains", "GenericAll", "GenericWrite", "Enroll", "Strange"]
ATTACK, INPUT = {"GenericAll", "GenericWrite"}, {"Enroll"}
EDGES = "src string, dst string, edge_type string"


def graph(seed: int):
    rng = random.Random(seed)
    n, dense = rng.randint(5, 9), rng.uniform(0.12, 0.4)
    names = [f"g{seed}n{i}" for i in range(n)]
    edges = [(a, b, rng.choice(KINDS)) for a in names for b in names if a != b and rng.random() < dense]
    return names, names[:2], sorted(set(edges))


def shortest_simple(names, top, edges, blocked=lambda identity, kind, to: False):
    """Fewest hops of a route that passes no object twice, by object. The identity that acts is kept over memberships."""
    onward = {}
    for a, b, k in edges:
        onward.setdefault(a, []).append((b, k))
    out = {}
    for start in names:
        if start in top:
            continue
        queue = deque([(start, start, False, (start,))])
        while queue:
            at, identity, attacked, passed = queue.popleft()
            for to, kind in onward.get(at, ()):
                if kind in INPUT or to in passed or blocked(identity, kind, to):
                    continue
                if to in top:
                    if attacked or kind in ATTACK:
                        out[start] = len(passed)
                        queue.clear()
                        break
                else:
                    queue.append((to, identity if kind == "MemberOf" else to, attacked or kind in ATTACK, (*passed, to)))
    return out


@pytest.fixture(scope="module")
def many(spark):
    parts = [graph(s) for s in range(150)]
    edges = spark.createDataFrame([e for _, _, es in parts for e in es], EDGES)
    top = spark.createDataFrame([(t,) for _, ts, _ in parts for t in ts], "id string")
    return parts, edges, top


def test_exact_exposure_matches_search(many):
    parts, edges, top = many
    want = {k: v for names, ts, es in parts for k, v in shortest_simple(names, ts, es).items()}
    found = exposure.exact(edges, top).collect()
    assert all(r["verified"] for r in found)
    assert {r["id"]: r["hops"] for r in found} == want


def test_walk_that_only_helps_by_looping_is_no_route(spark):
    edges = spark.createDataFrame([("u", "v", "MemberOf"), ("v", "u", "GenericAll"), ("v", "top", "Contains")], EDGES)
    top = spark.createDataFrame([("top",)], "id string")
    assert {r["id"] for r in exposure.exposed(edges, top).collect()} == {"u", "v"}
    assert exposure.exact(edges, top).collect() == []


def test_routes_beyond_a_bound_are_unverified(spark):
    """The only route of u and v that passes nothing twice has 17 and 18 steps; the walks that loop have 4 and 3."""
    chain = ["u", *[f"a{i:02}" for i in range(16)], "top"]
    edges = [("u", "v", "MemberOf"), ("v", "u", "GenericAll"), ("v", "top", "Contains")]
    edges = spark.createDataFrame(edges + [(a, b, "GenericWrite" if a == "a03" else "MemberOf") for a, b in zip(chain, chain[1:], strict=False)], EDGES)
    top = spark.createDataFrame([("top",)], "id string")
    got = {r["id"]: (r["hops"], r["verified"]) for r in exposure.exact(edges, top).collect()}
    assert got["u"] == (4, False) and got["v"] == (3, False) and got["a03"] == (13, True)
    both = spark.createDataFrame([("u",), ("v",)], "id string")
    rows = lambda **bounds: {r["id"]: (r["hops"], r["verified"]) for r in exposure.simple_routes(edges, top, both, **bounds).collect()}
    assert rows(max_depth=17) == {"u": (17, True), "v": (None, False)} and rows(max_depth=18) == {"u": (17, True), "v": (18, True)}
    assert rows(max_depth=18, budget=3) == {"u": (None, False), "v": (None, False)}


def test_denies_match_search_on_acyclic_graphs(spark):
    """Without cycles every walk is a route, so the search above is exact."""
    rows, denies, want, tops = [], [], {}, []
    for seed in range(80):
        names, _, edges = graph(1000 + seed)
        top = names[-2:]
        edges = [(a, b, k) for a, b, k in edges if names.index(a) < names.index(b)]
        rng = random.Random(seed)
        own = [(rng.choice(names), k, b) for _, b, k in rng.sample(edges, min(3, len(edges))) if k not in INPUT and k != "MemberOf"]
        members = {p: {p} for p in names}
        for _ in names:
            for a, b, k in edges:
                if k == "MemberOf":
                    members[b] |= members[a]
        bars = [(members[p], k, t) for p, k, t in own]
        want |= shortest_simple(names, top, edges, lambda who, kind, to, bars=bars: any(who in m and kind == k and to == t for m, k, t in bars))
        denies += [(len(denies) + i, p, k, t) for i, (p, k, t) in enumerate(own)]
        rows += edges
        tops += [(t,) for t in top]
    found = exposure.exposed_with_denies(spark.createDataFrame(rows, EDGES), spark.createDataFrame(tops, "id string"), spark.createDataFrame(denies, "deny_id int, principal string, edge_type string, target string"))
    assert {r["id"]: r["hops"] for r in found.collect()} == want


def test_overlapping_denies_read_no_more_than_the_guarded_steps(spark):
    """Nine denies on overlapping groups bind 512 users in 511 ways; only the guarded host's steps meet them."""
    users = [f"u{i:03}" for i in range(512)]
    member = [(u, f"g{b}", "MemberOf") for i, u in enumerate(users) for b in range(9) if i >> b & 1]
    rights = [(u, h, "AdminTo") for u in users for h in ("h0", "h1")]
    edges = spark.createDataFrame([*member, *rights, ("h0", "top", "HasSession"), ("h1", "top", "HasSession")], EDGES)
    denies = spark.createDataFrame([(b, f"g{b}", "AdminTo", "h0") for b in range(9)], "deny_id int, principal string, edge_type string, target string")
    top = spark.createDataFrame([("top",)], "id string")
    got = {r["id"]: r["hops"] for r in exposure.exposed_with_denies(edges, top, denies).collect()}
    assert got == dict.fromkeys(users, 2) | {"h0": 1, "h1": 1} | {f"g{b}": got.get(f"g{b}") for b in range(9) if f"g{b}" in got}
    both = spark.createDataFrame([(b, f"g{b % 9}", "AdminTo", "h0" if b < 9 else "h1") for b in range(18)], "deny_id int, principal string, edge_type string, target string")
    assert {r["id"] for r in exposure.exposed_with_denies(edges, top, both).collect()} == {"u000", "h0", "h1"}


def test_next_steps_lead_to_the_top(many):
    _, edges, top = many
    found = exposure.states(edges, top)
    rows = {(r["id"], r["attacked"]): r for r in exposure.next_steps(edges, top, found).collect()}
    depth = {(r["id"], r["attacked"]): r["depth"] for r in found.collect()}
    assert {*rows} == {k for k, d in depth.items() if d}
    assert all(depth[(r["next_id"], r["next_attacked"])] == r["depth"] - 1 for r in rows.values())


def test_fixpoints_at_the_edges(spark):
    hops = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), (None, "a"), ("a", "b")], "src string, dst string")
    start = spark.createDataFrame([("x", "a"), ("x", "a"), ("y", "q")], "origin string, id string")
    rows = lambda df: sorted((r["origin"], r["id"], r["depth"]) for r in df.collect())
    assert rows(fixpoint.closure(start, hops)) == [("x", "a", 0), ("x", "b", 1), ("x", "c", 2), ("y", "q", 0)]
    assert rows(fixpoint.closure(start, hops, max_depth=1)) == [("x", "a", 0), ("x", "b", 1), ("y", "q", 0)]
    assert rows(fixpoint.closure(start, hops.limit(0))) == [("x", "a", 0), ("y", "q", 0)]
    assert rows(fixpoint.closure(start.limit(0), hops)) == []


def test_relax_finds_least_costs(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", float(rng.randint(1, 9))) for _ in range(40)]
    best = {"n0": 0.0}
    for _ in range(12):
        for a, b, w in edges:
            if a in best and best[a] + w < best.get(b, 1e9):
                best[b] = best[a] + w
    start = spark.createDataFrame([("n0", "n0", 0.0)], "origin string, id string, cost double")
    found = fixpoint.relax(start, spark.createDataFrame(edges, "id string, next string, weight double"), ["origin", "id"])
    assert {r["id"]: r["cost"] for r in found.collect()} == best


def simple_paths(names, top, edges, most):
    """(length, source, target, nodes, edge types) of all simple routes with an attack step of at most ``most`` steps."""
    out, queue = [], deque((s, (s,), (), False) for s in names if s not in top)
    while queue:
        at, passed, kinds, attacked = queue.popleft()
        for a, b, k in edges:
            if a != at or k in INPUT or b in passed or len(kinds) == most:
                continue
            route = (b, (*passed, b), (*kinds, k), attacked or k in ATTACK)
            if b not in top:
                queue.append(route)
            elif route[3]:
                out.append((len(kinds) + 1, passed[0], b, route[1], route[2]))
    return out


def test_paths_and_routes_match_search(spark):
    """All paths, the first of them where there are more, and the routes from some starts; a start in tier 0 or unknown has none."""
    parts = [graph(2000 + s) for s in range(12)]
    edges = spark.createDataFrame([e for _, _, es in parts for e in es], EDGES)
    top = spark.createDataFrame([(t,) for _, ts, _ in parts for t in ts], "id string")
    nodes = spark.createDataFrame([(n,) for names, _, _ in parts for n in names], "object_id string")
    want = [p for names, ts, es in parts for p in simple_paths(names, ts, es, 4)]
    rows = lambda df: [(r["length"], r["source"], r["target"], tuple(r["nodes"]), tuple(r["edge_types"])) for r in df.collect()]
    assert sorted(rows(paths.enumerate_paths(nodes, edges, top, 4, None))) == sorted(want)
    short = [p for p in want if p[0] < 4]
    for most in (len(short) + 5, len(want) + 1):
        first = sorted(want, key=lambda p: (p[0], p[2], *p[3:]))[:most]
        assert sorted(rows(paths.enumerate_paths(nodes, edges, top, 4, most))) == sorted(first)
    starts = [n for names, _, _ in parts for n in (names[0], names[-1], names[-2])]
    begun = sorted(p for p in want if p[1] in starts)
    asked = spark.createDataFrame([(s,) for s in [*starts, starts[1], "nobody", None]], "id string")
    for most in (None, len(begun) - 3):
        assert sorted(rows(paths.breach_routes(asked, nodes, edges, top, 4, most))) == begun[:most]
    assert rows(paths.breach_routes(asked.limit(0), nodes, edges, top)) == [] == rows(paths.enumerate_paths(nodes, edges, top.limit(0)))


def test_growing_tables_are_dealt_by_key_not_sent_through_the_driver(spark):
    """Small tables are dealt out too: Spark's estimate of a table of ids is far below what it fills in memory."""
    from wardgraph.operators import exposure, maintained, whatif

    edges = spark.createDataFrame([("a", "T", "AdminTo"), ("b", "a", "MemberOf"), ("c", "b", "GenericAll")], "src string, dst string, edge_type string")
    top = spark.createDataFrame([("T",)], "id string")
    kept = maintained.keep(edges, top)
    gone = edges.where("src = 'b'")
    after = whatif.applied(edges, whatif.Deltas(gone, gone.limit(0)))
    later = maintained.update(kept, after, top, gone, gone.limit(0))
    changes = maintained.changes_of(kept, later, top, top)
    found = exposure.states(edges, top)
    for df in (exposure.walkable(edges, top), exposure.exposed(edges, top), exposure.next_steps(edges, top, found), after, later.table(), changes):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in changes.collect()) == [("b", 2, None), ("c", 3, None)]
