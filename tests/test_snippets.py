"""Snippet clusters and strong components against brute force."""

import random
from collections import Counter, defaultdict

from weftgraph.operators import snippets as S
from weftgraph.operators.graph import strong_components


def closure(nodes, edges):
    out = defaultdict(set)
    for u, v in edges:
        out[u].add(v)
    reach = {}
    for x in nodes:
        seen, todo = set(), [x]
        while todo:
            for y in out[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        reach[x] = seen
    return reach


def test_strong_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(55)] + [(100, 101), (101, 102), (102, 100), (102, 103), (7, 7)]
    nodes = {x for e in edges for x in e}
    reach = closure(nodes, edges)
    want = {}
    for x in nodes:
        part = {y for y in reach[x] if x in reach[y]} | {x}
        if len(part) > 1:
            want[x] = min(part)
    assert {x.node: x.component for x in strong_components(spark.createDataFrame(edges, "u long, v long")).collect()} == want and len(want) > 5
    assert strong_components(spark.createDataFrame([(1, 2)], "u long, v long")).count() == 0


def brute(journeys, subgraphs, fraction, least):
    found = []
    for g, inside in subgraphs.items():
        for o, visits in journeys.items():
            run = []
            for i, s in enumerate([*visits, None]):
                if s in inside:
                    run.append((i, s))
                elif run:
                    found.append((g, o, run[0][0], tuple(x for _, x in run)))
                    run = []
    sets = sorted({(g, frozenset(x)) for g, _, _, x in found}, key=str)
    holds = [(a, b) for a in sets for b in sets if a != b and a[0] == b[0] and len(b[1] - a[1]) <= int(fraction * len(b[1]) + 0.5)]
    reach = closure(sets, holds)
    part = {x: frozenset({y for y in reach[x] if x in reach[y]} | {x}) for x in sets}
    heads = {p for p in part.values() if not any(part[a] != p and part[b] == p for a, b in holds)}
    under = {x: [h for h in heads if x in h or any(x in reach[y] for y in h)] for x in sets}
    out = []
    for g, o, i, x in found:
        above = under[g, frozenset(x)]
        if len(above) == 1:
            out.append((g, tuple(min(sorted(y) for _, y in above[0] if len(y) == max(len(z) for _, z in above[0]))), o, i, x))
    n = Counter(x[:2] for x in out)
    return Counter(x for x in out if n[x[:2]] >= least)


def test_clusters_equal_brute_force(spark):
    r = random.Random(3)
    journeys = {}
    for o in range(70):
        start, kind = r.randrange(6), r.randrange(3)
        x = []
        for i in range(start, start + r.randint(2, 26)):
            if r.random() > 0.06:
                x.append(i * 3 + kind if i % 7 == 3 else i * 3)
        journeys[o] = x
    subgraphs = {1: set(range(0, 45)), 2: set(range(30, 110)), 3: {500}}
    rows = [(o, i, s) for o, x in journeys.items() for i, s in enumerate(x)]
    df = spark.createDataFrame(rows, "owner long, idx long, segment long")
    sub = spark.createDataFrame([(g, s) for g, x in subgraphs.items() for s in x], "subgraph long, segment long")
    parts = S.journey_snippets(df, sub)
    for fraction, least in ((0.05, 3), (0.2, 2)):
        want = brute(journeys, subgraphs, fraction, least)
        got = S.snippet_clusters(parts, fraction=fraction, least_snippets=least)
        assert Counter((x.subgraph, tuple(x.top), x.owner, x.first, tuple(x.segments)) for x in got.collect()) == want and len({x[:2] for x in want}) > 1
        counts = Counter((g, top, s) for (g, top, _, _, x), n in want.items() for s in x)
        seen = {(x.subgraph, tuple(x.top), x.segment): x.coverage for x in S.cluster_segments(got, 3).collect()}
        assert seen == {k: n for k, n in counts.items() if n >= 3}
