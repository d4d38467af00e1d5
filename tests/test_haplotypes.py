"""Bubble chains against plain loops: what is transferred, regions, and the three outputs."""

import os.path
import random
from collections import defaultdict
from itertools import product

from weftgraph.operators import haplotypes as H
from weftgraph.operators import sinks

SCHEMA = "chain long, position long, branch int, sequence string, coverage long, component long, phase int"


def chains(r, n):
    rows = []
    for c in range(n):
        for p in range(r.randint(1, 7)):
            k = r.choice([1, 1, 2, 2, 3])
            head, tail = ("".join(r.choice("AC") for _ in range(r.randint(0, 4))) for _ in range(2))
            comp = r.choice([None, 5, 5, 6]) if k == 2 else None
            for b in range(k):
                rows.append((c, p * 10, b, head + "".join(r.choice("ACGT") for _ in range(r.randint(0, 3))) + tail, r.randint(1, 9), comp, None if comp is None else r.randint(0, 1)))
        rows = [(*x[:6], next(y[6] for y in rows if y[:2] == x[:2])) for x in rows]
    return rows


def by_edge(rows):
    out = defaultdict(lambda: defaultdict(list))
    for c, p, b, s, *rest in sorted(rows, key=lambda x: x[:3]):
        out[c][p].append((s or "", *rest))
    return {c: list(x.values()) for c, x in out.items()}


def test_transfer_keeps_every_way(spark):
    r = random.Random(5)
    rows = chains(r, 60)
    new = [tuple(x) for x in H.transfer(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted((x[:3] + x[4:] for x in new), key=str) == sorted((x[:3] + x[4:] for x in rows), key=str)
    old, now = by_edge(rows), by_edge(new)
    moved = 0
    for c, edges in old.items():
        spell = lambda e: sorted("".join(w) for w in product(*[[x[0] for x in y] for y in e]))
        assert spell(edges) == spell(now[c])
        want = [[x[0] for x in e] for e in edges]
        give = []
        for i in range(1, len(edges) - 1):
            if len(edges[i]) > 1 and len(edges[i - 1]) == len(edges[i + 1]) == 1:
                s = want[i]
                b, f = len(os.path.commonprefix(s)), len(os.path.commonprefix([x[::-1] for x in s]))
                while b + f > min(map(len, s)):
                    b -= 1
                    if b + f > min(map(len, s)):
                        f -= 1
                give.append((i, s[0][:b], s[0][len(s[0]) - f :], b, f))
        for i, pre, suf, b, f in give:
            want[i] = [x[b : len(x) - f] for x in want[i]]
            want[i - 1] = [want[i - 1][0] + pre]
            want[i + 1] = [suf + want[i + 1][0]]
            moved += b + f
        assert [[x[0] for x in e] for e in now[c]] == want
    assert moved > 40


def test_regions_and_outputs(spark):
    rows = chains(random.Random(11), 40)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {c: {} for c in {x[0] for x in rows}}
    for x in H.phased(df).collect():
        got[x.chain][x.name] = x.sequence
    haploid = {x.chain: x.sequence for x in H.haploid(df).collect()}
    kinds = set()
    for c, edges in by_edge(rows).items():
        comp = [e[0][2] for e in edges]
        best = [max(enumerate(e), key=lambda x: (x[1][1], -x[0]))[1][0] for e in edges]
        assert haploid[c] == "".join(best)
        marks = [i for i, x in enumerate(comp) if x is not None]
        inside = [None] * len(edges)
        for a, b in zip(marks, marks[1:]):
            if comp[a] == comp[b]:
                inside[a : b + 1] = [comp[a]] * (b + 1 - a)
        for i in marks:
            inside[i] = comp[i]
        regions = []
        for i, x in enumerate(inside):
            if not regions or regions[-1][0] != x:
                regions.append((x, []))
            regions[-1][1].append(i)
        want = {}
        for k, (x, places) in enumerate(regions):
            for h in (0, 1) if x is not None else (0,):
                told = "".join(edges[i][h ^ edges[i][0][3]][0] if comp[i] is not None else best[i] for i in places)
                want[f"UR.{c}.{k}" if x is None else f"PR.{c}.{k}.{x}.{h}"] = told
            kinds.add((x is None, len(places) > 1))
        assert got[c] == want
    assert len(kinds) == 4
    for form in (H.detailed, H.haploid, H.phased):
        pieces = form(df)
        names = {x.name for x in pieces.collect()}
        links = H.joined(pieces).collect()
        assert all({x.from_id, x.to_id} <= names for x in links) and len(links) == len({(x.from_id, x.to_id) for x in links})
        gfa = sinks.gfa_lines(pieces.selectExpr("name as id", "sequence", "0 as reads"), H.joined(pieces)).count()
        assert gfa == 1 + len(names) + len(links)
    assert H.phased(df.limit(0)).count() == 0 and H.transfer(df.limit(0)).count() == 0


def test_no_frame_shrinks_along_a_chain(spark):
    rows = [(1, i, 0, "A", 1, (i // 9) if i % 2 else None, 0) for i in range(50)]
    spans = H.phasing_spans(spark.createDataFrame(rows, SCHEMA))
    assert "UNBOUNDED FOLLOWING" not in spans._jdf.queryExecution().optimizedPlan().toString().upper().replace("UNBOUNDEDFOLLOWING$()", "UNBOUNDED FOLLOWING")
    got = {x.position: x.component for x in spans.collect()}
    for i in range(50):
        behind = [c for _, p, _, _, _, c, _ in rows if p >= i and c is not None][:1]
        before = [c for _, p, _, _, _, c, _ in rows if p <= i and c is not None][-1:]
        assert got[i] == (before[0] if before and before == behind else None)
