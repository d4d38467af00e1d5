"""Superbubbles against brute force on random graphs."""

import random
from collections import Counter, defaultdict

from weftgraph.operators import superbubbles as S


def every_way(edges, start, stop, avoid=None):
    out = defaultdict(list)
    for e, s, t in edges:
        out[s].append((e, t))
    found = []

    def go(x, path, seen):
        if x == stop:
            found.append(path)
            return
        for e, t in sorted(out[x]):
            if t not in seen and t != avoid:
                go(t, [*path, e], seen | {t})

    go(start, [], {start})
    return found


def dag(r, n, m):
    edges = set()
    while len(edges) < m:
        a, b = sorted(r.sample(range(n), 2))
        edges.add((a, b))
    return sorted(edges)


def test_choke_points_and_chunks():
    """On a DAG, a choke point is a node on all ways, and a chunk's edges are those on a way between two neighbouring ones."""
    r = random.Random(2)
    seen = 0
    for _ in range(300):
        n = r.randint(3, 9)
        pairs = dag(r, n, min(r.randint(2, 14), n * (n - 1) // 2))
        edges = [(i, *p) for i, p in enumerate(pairs)]
        ways = every_way(edges, 0, n - 1)
        path, chunk = S.choke_points(pairs, 0, n - 1)
        if not ways:
            assert path == [] and chunk == {}
            continue
        nodes = [[0, *(pairs[e][1] for e in w)] for w in ways]
        want = [x for x in nodes[0] if all(x in y for y in nodes)]
        assert path == want
        used = {pairs[e] for w in ways for e in w}
        assert set(chunk) == used
        for s, t in used:
            assert chunk[s, t] == max(i for i, x in enumerate(want) if x <= s)
        seen += len(want) > 2
    assert seen > 30


def expected(edges, start, stop, most=20):
    """The same edit by enumeration: edges left, then (kind, path) of new ones."""
    ways = every_way([x[:3] for x in edges], start, stop)
    info = {x[0]: x for x in edges}
    nodes = [[start, *(info[e][2] for e in w)] for w in ways]
    chokes = [x for x in nodes[0] if all(x in y for y in nodes)]
    used = {e for w in ways for e in w}
    left, new = set(used), []
    for here, there in zip(chokes, chokes[1:]):
        inside = [info[e] for e in used if here <= info[e][1] and info[e][2] <= there]
        if all(x[2] == there for x in inside if x[1] == here) or len(inside) > most:
            continue
        between = every_way([x[:3] for x in inside], here, there)
        if len(between) > most:
            continue
        between.sort(key=lambda w: -sum(info[e][3] * info[e][4] for e in w) / sum(info[e][4] for e in w))
        left -= {x[0] for x in inside}
        a, b = between[:2]
        heads, tails = [], []
        while a[0] == b[0]:
            heads.append(a[0])
            a, b = a[1:], b[1:]
        while a[-1] == b[-1]:
            tails.append(a[-1])
            a, b = a[:-1], b[:-1]
        new += [("single", tuple(x)) for x in (heads, tails[::-1]) if x] + [("branch", tuple(a)), ("branch", tuple(b))]
    return left, Counter(new)


def test_random_superbubbles_equal_enumeration(spark):
    r = random.Random(6)
    rows, want_kept, want_new, eid, ready = [], set(), Counter(), 0, 0
    for g in range(60):
        n, base = r.randint(4, 9), g * 100
        pairs = {(i, i + 1) for i in range(n - 1) if r.random() < 0.9} | {tuple(sorted(r.sample(range(n), 2))) for _ in range(r.randint(0, 8))} | {(0, 1)}
        edges = []
        for a, b in sorted(pairs):
            for _ in range(r.choice([1, 1, 2])):
                edges.append((eid, base + a, base + b, r.randint(1, 30), r.randint(1, 5), True))
                eid += 1
        outer = [(eid, base - 50, base, 5, 1, False), (eid + 1, base + n - 1, base + n + 30, 5, 1, False)]
        eid += 2
        rows += edges + outer
        want_kept |= {x[0] for x in outer}
        inside = [x[:5] for x in edges]
        reach = {base}
        for _ in range(n):
            reach |= {b for _, a, b, *_ in inside if a in reach} | {a for _, a, b, *_ in inside if b in reach}
        main = [x for x in inside if x[1] in reach]
        want_kept |= {x[0] for x in inside if x[1] not in reach}
        degree = [Counter(x[k] for x in main) for k in (1, 2)]
        if base + n - 1 not in reach or max(degree[0].values()) == 1 == max(degree[1].values()) or not every_way([x[:3] for x in main], base, base + n - 1):
            want_kept |= {x[0] for x in main}
            continue
        left, new = expected(main, base, base + n - 1)
        want_kept |= left
        want_new += new
        ready += 1
    df = spark.createDataFrame(rows, "eid long, src long, dst long, coverage long, length long, inner boolean")
    got = S.resolve_superbubbles(df).collect()
    assert {x.path[0] for x in got if x.kind == "kept"} == want_kept
    assert Counter((x.kind, tuple(x.path)) for x in got if x.kind != "kept") == want_new and ready > 30
    ends = {x[0]: x[1:3] for x in rows}
    assert all((x.src, x.dst) == (ends[x.path[0]][0], ends[x.path[-1]][1]) for x in got)


def test_what_is_left_alone(spark):
    edges = [(1, 9, 0, 1, 1, False), (2, 0, 1, 1, 1, True), (3, 0, 2, 1, 1, True), (4, 1, 2, 1, 1, True), (5, 2, 8, 1, 1, False)]
    many = [(100 + i, 1, 2, 1, 1, True) for i in range(40)]
    frame = lambda x: spark.createDataFrame(x, "eid long, src long, dst long, coverage long, length long, inner boolean")
    kinds = lambda x, **k: Counter(y.kind for y in S.resolve_superbubbles(frame(x), **k).collect())
    assert kinds(edges) == {"kept": 2, "branch": 2}
    assert kinds(edges + many) == {"kept": 45}
    assert kinds(edges, most_nodes=2) == {"kept": 5}
    assert kinds([*edges, (6, 7, 1, 1, 1, False)]) == {"kept": 6}
    assert S.superbubbles(frame([*edges, (6, 7, 1, 1, 1, False)])).collect()[0].verdict == "several ways in or out"
    assert S.superbubbles(frame(edges), most_nodes=2).collect()[0].verdict == "too many nodes"
    assert S.resolve_superbubbles(frame(edges).limit(0)).count() == 0
