"""Walks that look back at a reference segment, against plain loops."""

import random
from collections import Counter, defaultdict

import pytest

from weftgraph.operators import journeys as J
from weftgraph.operators import walks as W

OPTIONS = W.WalkOptions(2, 2, 0.4, -20)


def frames(spark, journeys, separations, pairs):
    visits = [(o, i, s) for o, x in journeys.items() for i, s in enumerate(x)]
    steps = [(o, a, b) for o, x in journeys.items() for a, b in zip(x, x[1:])]
    links = [(a, b, separations.get((a, b), 0)) for a, b in sorted({x[1:] for x in steps})]
    return (
        spark.createDataFrame(visits, "owner long, idx long, segment long"), spark.createDataFrame(steps, "owner long, s0 long, s1 long"),
        spark.createDataFrame(links, "s0 long, s1 long, separation long"), spark.createDataFrame([(a, b, *x) for (a, b), x in pairs.items()], "a long, b long, common long, raw_jaccard double"),
    )


class Loop:
    """The same rules, one walk at a time."""

    def __init__(self, journeys, separations, pairs, forward):
        on, across = defaultdict(Counter), defaultdict(Counter)
        for o, x in journeys.items():
            for s in x:
                on[s][o] += 1
            for a, b in zip(x, x[1:]):
                across[a, b][o] += 1
        self.on = {s: {o for o, n in c.items() if n == 1} for s, c in on.items()}
        self.met = {s: len(c) for s, c in on.items()}
        self.across = {e: {o for o, n in c.items() if n == 1} for e, c in across.items() if separations.get(e, 0) >= -20}
        self.pairs, self.forward = pairs, forward

    def step(self, ref, at):
        best = []
        for a, b in self.across:
            near, far = (a, b) if self.forward else (b, a)
            n = len(self.on[ref] & self.across[a, b])
            if near == at and n >= 2:
                best.append((-n, far))
        return min(best)[1] if best else None

    def alike(self, a, b):
        common, raw = (self.met[a], 1.0) if a == b else self.pairs.get((min(a, b), max(a, b)), (0, 0.0))
        return common >= 2 and raw >= 0.4

    def walk(self, start):
        at, path = start, []
        while True:
            at = self.step(start, at)
            if at is None or at in path:
                return None
            if self.alike(start, at):
                return (start, at, path) if self.forward else (at, start, path[::-1])
            path.append(at)

    def path(self, start):
        ref = at = start
        out, waiting, seen = [(start, True, None, None)], [], set()
        while True:
            at = self.step(ref, at)
            if at is None or (ref, at) in seen:
                return [(start, i, *x) for i, x in enumerate(out)]
            seen.add((ref, at))
            waiting.append(at)
            if self.alike(ref, at):
                out += [(s, False, *((ref, at) if self.forward else (at, ref))) if s != at else (s, True, None, None) for s in waiting]
                waiting, ref = [], at


@pytest.mark.parametrize("forward", [True, False])
def test_walks_and_paths_equal_a_loop(spark, forward):
    r = random.Random(8)
    journeys = {}
    for o in range(60):
        x, at = [], r.randrange(4)
        for _ in range(r.randint(2, 12)):
            x.append(at)
            at = (at + r.choice([1, 1, 1, 2, 2, -3])) % 25
        journeys[o] = x
    pairs = {(a, b): (r.randint(0, 5), r.choice([0.1, 0.3, 0.5])) for a in range(25) for b in range(a + 1, 25) if b - a < 6}
    separations = {(a, (a + 2) % 25): -30 for a in range(0, 25, 7)}
    loop = Loop(journeys, separations, pairs, forward)
    want = sorted(x for s in range(25) if s in loop.on and (x := loop.walk(s)))
    tables = frames(spark, journeys, separations, pairs)
    got = W.jaccard_walks(*tables, forward=forward, options=OPTIONS)
    assert sorted((x.s0, x.s1, x.segments) for x in got.collect()) == want and len(want) > 5 and any(x[2] for x in want)
    starts = [0, 3, 7, 11, 24]
    rows = W.assembly_paths(spark.createDataFrame([(s,) for s in starts], "segment long"), *tables, forward=forward, options=OPTIONS)
    wanted = [x for s in starts for x in loop.path(s)]
    assert sorted(map(tuple, rows.collect()), key=lambda x: x[:2]) == sorted(wanted, key=lambda x: x[:2]) and len(wanted) > 8


def test_the_start_decides_and_not_the_segment_before(spark):
    """Segment 2 has most in common with 3, the start with 4: the walk from 1 goes on to 4."""
    journeys = {o: [2, 3] for o in range(10)} | {o: [1, 2, 4] for o in range(20, 25)} | {o: [1, 2, 3] for o in range(30, 33)}
    pairs = {(1, 2): (8, 0.2), (2, 3): (10, 0.3), (1, 4): (5, 0.9), (1, 3): (3, 0.1), (2, 4): (5, 0.3)}
    tables = frames(spark, journeys, {}, pairs)
    assert [(x.s0, x.s1, x.segments) for x in W.jaccard_walks(*tables).where("s0 = 1").collect()] == [(1, 4, [2])]
    strong = W.jaccard_graph(*tables).collect()
    assert (1, 4, True) in {(x.s0, x.s1, x.forward) for x in strong}
    assert J.strong_only(W.jaccard_graph(*tables)).count() <= len(strong)


def test_a_long_walk_ends(spark):
    n = 12
    journeys = {o: list(range(n)) for o in range(3)} | {9: [100, 101, 102, 100]}
    tables = frames(spark, journeys, {}, {(0, n - 1): (3, 0.9)})
    got = W.jaccard_walks(*tables).where("s0 = 0").collect()
    assert [(x.s1, x.segments) for x in got] == [(n - 1, list(range(1, n - 1)))]
