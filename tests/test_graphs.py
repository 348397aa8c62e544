"""Traces of many roots, components and evidence on random graphs, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from callweft.operators import components, forest, lookup

LINK = "caller string, callee string, seq long, via string, approximate boolean, args_rendered string"


def random_edges(seed, nodes, n):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(nodes):02d}", f"n{rng.randrange(nodes):02d}") for _ in range(n)]


def brute_trace(pairs, root, max_depth, max_nodes, initial_depth, expanded):
    """Level by level, as a plain loop: rows (depth, ord, node, parent, n_sites, state, pending)."""
    out = {}
    for i, (a, b) in enumerate(pairs):
        out.setdefault(a, []).append((i, b))
    pending = lambda n: len({b for _, b in out.get(n, [])})
    rows, level, known = [(0, 1, root, None, 0, "expanded", 0)], [(1, root, [root])], {root}
    for depth in range(1, max_depth + 1):
        groups = []
        for order, node, path in level:
            first, count = {}, {}
            for i, b in out.get(node, []):
                first.setdefault(b, i)
                count[b] = count.get(b, 0) + 1
            groups += [(order, first[b], b, node, path, count[b]) for b in first]
        groups.sort(key=lambda g: g[:3])
        level, met, now = [], set(), set()
        for _, _, node, parent, path, n in groups[: max(max_nodes - len(rows), 0)]:
            cyclic = node in path
            seen = node in known or node in met
            if not cyclic:
                met.add(node)
            state = "cyclic" if cyclic else "seen" if seen else "truncated" if depth >= max_depth else "leaf" if not pending(node) else "expanded" if depth < initial_depth or node in expanded else "frontier"
            rows.append((depth, len(rows) + 1, node, parent, n, state, pending(node)))
            if state in ("expanded", "frontier", "leaf"):
                now.add(node)
            if state == "expanded":
                level.append((rows[-1][1], node, [*path, node]))
        known |= now
        if not level:
            break
    return rows


def plain(nodes):
    out = {}
    for r in nodes.collect():
        out.setdefault(r.root, []).append((r.depth, r.ord, r.node, r.parent, r.n_sites, r.state, r.pending))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize(("seed", "nodes", "n", "limits"), [(1, 14, 40, (6, 60, 64)), (2, 25, 60, (8, 25, 2)), (3, 9, 50, (5, 12, 1))])
def test_traces_of_all_roots_and_their_expansion(spark, seed, nodes, n, limits):
    pairs = random_edges(seed, nodes, n)
    links = spark.createDataFrame([(a, b, i, "typed", False, "") for i, (a, b) in enumerate(pairs)], LINK)
    names = sorted({a for a, _ in pairs})[:6]
    roots = spark.createDataFrame([(x,) for x in names], "root string")
    depth, most, initial = limits
    trace = forest.trace_forest(links, roots, depth, most, initial)
    assert plain(trace.nodes) == {r: brute_trace(pairs, r, depth, most, initial, ()) for r in names}
    if initial < 64:
        opened = tuple(sorted({b for _, b in pairs})[::3])
        trace = trace.expand(*opened)
        assert plain(trace.nodes) == {r: brute_trace(pairs, r, depth, most, initial, opened) for r in names}
        more = tuple(sorted({b for _, b in pairs})[1::3])
        assert plain(trace.expand(*more).nodes) == {r: brute_trace(pairs, r, depth, most, initial, opened + more) for r in names}


def reached(pairs, start):
    out, todo = set(), [start]
    while todo:
        for a, b in pairs:
            if a == todo[-1] and b not in out:
                out.add(b)
                todo.insert(0, b)
        todo.pop()
    return out


@pytest.mark.parametrize(("seed", "nodes", "n"), [(1, 30, 35), (2, 30, 60), (3, 6, 40)])
def test_components_and_reach_counts(spark, seed, nodes, n):
    pairs = random_edges(seed, nodes, n)
    every = sorted({x for p in pairs for x in p})
    far = {x: reached(pairs, x) for x in every}
    label = {x: max([x] + [y for y in far[x] if x in far[y]]) for x in every}
    edges = spark.createDataFrame(pairs, "caller string, callee string")
    got = {r.node: r for r in components.reach_counts(edges).collect()}
    assert {x: r.component for x, r in got.items()} == label
    for x in every:
        assert got[x].size == sum(label[y] == label[x] for y in every)
        assert got[x].reached_by == sum(x in far[y] for y in every)


def test_a_layered_graph_of_millions_of_ways(spark):
    width, layers = 7, 12
    pairs = [(f"l{k:02d}c{i}", f"l{k + 1:02d}c{j}") for k in range(layers - 1) for i in range(width) for j in range(width)]
    got = components.reach_counts(spark.createDataFrame(pairs, "caller string, callee string"))
    assert {r.node: r.reached_by for r in got.collect()} == {f"l{k:02d}c{i}": k * width for k in range(layers) for i in range(width)}


def test_evidence_of_a_hot_key_meets_rows_once(spark):
    rows = spark.range(3000).select(F.lit("k").alias("key"), F.col("id").alias("at"))
    proof = spark.range(3000).select(F.lit("k").alias("key"), F.col("id").alias("at"), (F.col("id") % 3).alias("what"))
    got = lookup.evidence_before(rows.unionByName(rows), proof, "key", "at", "what")
    assert got.count() == 3 * 3000 - (1 + 2 + 3)
    assert "Aggregate" in got._jdf.queryExecution().optimizedPlan().toString()
