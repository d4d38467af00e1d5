"""A planted sequence comes back from its segments and the noisy reads across their links."""

import random

from weftgraph.operators import path_assembly as P

K = 6


def planted(r):
    """A sequence, segments that leave gaps, and reads across the gaps, a minority of which has errors."""
    genome = "".join(r.choice("ACGT") for _ in range(420))
    spans = [(0, 100), (130, 200), (226, 300), (294, 360), (372, 420)]
    segments, crossings, members = [], [], []
    offsets = []
    for i, (a, b) in enumerate(spans):
        starts = list(range(0, b - a - K + 1, 4))
        offsets.append(starts)
        segments.append((i, genome[a:b], starts))
    for i in range(4):
        if i == 2:
            continue
        for o in range(11):
            p0, p1 = len(offsets[i]) - 1 - r.randint(0, 3), r.randint(0, 3)
            first, last = spans[i][0] + offsets[i][p0], spans[i + 1][0] + offsets[i + 1][p1] + K
            bases = list(genome[first:last])
            if o >= 7:  # errors of its own, in the gap
                at = r.randrange(K, len(bases) - K)
                bases[at] = {"A": "C", "C": "G", "G": "T", "T": "A"}[bases[at]] if o % 2 else ""
            crossings.append((100 * i + o, i, i + 1, p0, p1, "".join(bases)))
            members += [(i, 100 * i + o), (i + 1, 100 * i + o)]
        for o in range(20):  # reads that no primary segment knows don't count
            crossings.append((5000 + o, i, i + 1, len(offsets[i]) - 1, 0, "TTTTTTTTTTTT"))
    return genome, segments, crossings, members


def test_a_planted_sequence_is_recovered(spark):
    r = random.Random(3)
    genome, segments, crossings, members = planted(r)
    paths = [("p", i, i, i in (0, 2, 3, 4)) for i in range(5)] + [("q", 0, 1, True)]
    frames = (
        spark.createDataFrame(paths, "start string, idx long, segment long, is_primary boolean"), spark.createDataFrame(segments, "segment long, sequence string, offsets array<int>"),
        spark.createDataFrame(crossings, "owner long, s0 long, s1 long, p0 int, p1 int, sequence string"), spark.createDataFrame(members, "segment long, owner long"),
    )
    # segments 2 and 3 share a marker
    got = {x.start: x.sequence for x in P.assemble_paths(*frames, K, spark.createDataFrame([(2, 3)], "s0 long, s1 long")).collect()}
    assert got == {"p": genome, "q": genome[130:200]}
    calls = {x.idx: x for x in P.link_consensus(P.path_links(frames[0]).where("s0 != 2"), *frames[1:], K).collect()}
    assert {i: x.coverage for i, x in calls.items()} == {0: 11, 1: 11, 3: 11}
    assert P.assemble_paths(frames[0].limit(0), *frames[1:], K).count() == 0


def test_consensus_counts_and_ties():
    assert P.weighted_consensus({"ACGT": 3, "ACT": 2, "AGGT": 2}) == "ACGT"
    assert P.weighted_consensus({"ACGT": 2, "ACT": 3}) == "ACT"
    assert P.weighted_consensus({"AC": 1, "AG": 1}) == "AC"
    assert P.weighted_consensus({}) == ""
