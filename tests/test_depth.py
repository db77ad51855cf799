"""Depth, cycles and chains against plain Python, on long and cyclic graphs."""

import random

import pytest

from graphloom.operators import graph as G
from graphloom.plans.registry import QUERIES


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def brute_chain(pairs, most=6):
    out: dict[int, list[int]] = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)

    def go(path):
        if len(path) > most:
            return most
        return max((len(path) if x in path or len(path) == most else go([*path, x]) for x in out.get(path[-1], [])), default=len(path) - 1)

    return {a: go([a]) for a in out}


def brute_components(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {n: {n} for n in nodes}
    while True:
        new = {n: r | {b for a, b in pairs if a in r} for n, r in reach.items()}
        if new == reach:
            return {n: frozenset(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
        reach = new


def brute_depth(pairs):
    c = brute_components(pairs)
    out: dict = {}
    for a, b in pairs:
        if c[a] != c[b]:
            out.setdefault(c[a], set()).add(c[b])
    depth = lambda x: max((1 + depth(y) for y in out.get(x, ())), default=0)
    return {n: depth(c[n]) for n in c}


def test_depth_of_a_chain_of_70_edges(spark):
    got = {r.uid: r.depth for r in G.longest_depth(edges(spark, [(k, k + 1) for k in range(70)])).collect()}
    assert got == {k: 70 - k for k in range(71)}


@pytest.mark.parametrize("one_task", [0, G.ONE_TASK])
def test_random_graphs_equal_brute_force(spark, monkeypatch, one_task):
    monkeypatch.setattr(G, "ONE_TASK", one_task)
    r = random.Random(4)
    for n, m in ((30, 34), (24, 40), (40, 46)):
        pairs = sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)})
        e, c = edges(spark, pairs), brute_components(pairs)
        plain = [p for p in pairs if p[0] != p[1]]
        want = brute_depth(plain)
        assert {x.uid: x.depth for x in G.longest_depth(e).collect()} == want
        assert {x.uid for x in G.in_cycle(e).collect()} == {k for k in c if len(c[k]) > 1 or (k, k) in pairs}
        strong = {x.uid: x.scc for x in G.strong_components(e).collect()}
        assert strong == {k: max(c[k]) for k in c if len(c[k]) > 1}
        if one_task:
            assert {x.uid: x.chain for x in G.longest_chain(e).collect()} == brute_chain(pairs)


def test_empty_graphs(spark):
    e = edges(spark, [(1, 1)])
    assert G.strong_components(e).count() == 0 and G.longest_depth(e).count() == 0
    assert [x.uid for x in G.in_cycle(e).collect()] == [1]


def brute_inheritance(pairs):
    up: dict[int, set] = {}
    for a, b in pairs:
        up.setdefault(a, set()).add(b)

    def go(x, seen):
        return 0 if x in seen or x not in up else max(1 + go(y, seen | {x}) for y in up[x])

    return {x: go(x, frozenset()) for p in pairs for x in p}


def test_inheritance_depth(spark):
    assert brute_inheritance([(1, 2), (2, 1)]) == {1: 2, 2: 2}
    r = random.Random(5)
    for n, m in ((12, 14), (8, 16)):
        pairs = sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)})
        assert {x.uid: x.depth for x in G.inheritance_depth(edges(spark, pairs)).collect()} == brute_inheritance(pairs)
    assert G.inheritance_depth(edges(spark, [(1, 2)]).limit(0)).count() == 0


def test_call_graph_queries_use_the_call_graph(spark):
    from graphloom.plans.workload import Tables

    d = "/root/testdata/sf0.001"
    pairs = [tuple(r) for r in Tables(spark, d).edges().collect()]
    c = brute_components(pairs)
    assert {x.uid: x.depth for x in QUERIES["call_depth"](spark, d).collect()} == brute_depth(pairs)
    assert {x.uid for x in QUERIES["nodes_in_cycles"](spark, d).collect()} == {k for k in c if len(c[k]) > 1}
    assert {x.uid: x.deep for x in QUERIES["dependency_chain"](spark, d).collect()} == {k: int(v > 5) for k, v in brute_chain(pairs).items()}
