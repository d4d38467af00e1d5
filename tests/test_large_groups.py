"""Steps whose rows grew with the square of a group, or with a whole file, against plain loops."""

import random

import pytest

from weftgraph.operators import assembly_graph as B
from weftgraph.operators import consensus as N
from weftgraph.operators import journeys as J
from weftgraph.operators import lowhash as L
from weftgraph.operators import marker_graph as G
from weftgraph.operators import read_graph as R
from weftgraph.operators import snippets as S
from weftgraph.operators import superbubbles as D
from weftgraph.operators import walks as W
from weftgraph.sources.sequences import load_reads
from weftgraph.storage import materialize


def rows_of_joins(df):
    """The most rows that a join of a plan that has run put out."""
    found = []

    def visit(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return visit(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return visit(node.plan())
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            found.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            visit(node.children().apply(i))

    df.collect()
    visit(df._jdf.queryExecution().executedPlan())
    return max(found)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def test_clusters_compare_distinct_texts(spark):
    draw = random.Random(5)
    words = ["large ring", "large rings", "large king", "hot bolt", "hot bolts", "cold plate", "ab", "ac", "", None]
    rows = [(f"g{draw.randrange(2)}", i, draw.choice(words)) for i in range(300)]
    parent = {i: i for _, i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for g, i, x in rows:
        for h, j, y in rows:
            if g == h and i < j and x is not None and y is not None and distance(x, y) < 0.25 * min(len(x), len(y)):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    members = spark.createDataFrame(rows, "g string, k long, t string")
    got = G.cluster_by_distance(members, ["g"], "k", "t", 0.25)
    assert sorted((r.g, r.k, r.cluster) for r in got.collect()) == sorted((g, i, root(i)) for g, i, _ in rows)
    assert rows_of_joins(got) <= len(rows)


def test_subsets_are_looked_up_by_a_rare_member(spark):
    draw = random.Random(6)
    sets = {i: set(draw.sample(range(30), draw.randrange(1, 5))) | {99} for i in range(300)}
    sets[300] = {99}
    rows = [(i, m) for i, s in sets.items() for m in s] * 2 + [(301, 1), (301, None), (302, 1), (None, 99)]
    full = {**sets, 301: {1, None}, 302: {1}}
    want = sorted((a, b) for a in full for b in full if a != b and None not in full[b] and full[b] < full[a])
    got = B.subset_graph(spark.createDataFrame(rows, "o long, m long"), "o", "m")
    assert sorted(map(tuple, got.collect())) == want
    assert rows_of_joins(got) < 300 * 299 // 2  # all sets share a member


RECORDS = [("r1", "ACGT", "IIII"), ("r2 x=1", "AC", "@I"), ("@r3", "GATTACA", "@@@@@@@"), ("r4", "A", "@"), ("r5", "", ""), ("r6", "acgtac", "@+@+@+"), ("r7", "ACG", "+II")]


@pytest.mark.parametrize("block", ["7b", "40b", "128m"])
@pytest.mark.parametrize("end", ["", "\n"])
def test_fastq_is_scanned_in_pieces(spark, tmp_path, block, end):
    (tmp_path / "all").mkdir()
    text = "\n".join(f"@{n}\n{b}\n+{n if i % 2 else ''}\n{q}" for i, (n, b, q) in enumerate(RECORDS))
    for name in ("a", "b"):
        (tmp_path / "all" / f"{name}.fastq").write_text(text + end)
    (tmp_path / "all" / "empty.fastq").write_text(end)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        got = load_reads(spark, f"file://{tmp_path}/all/*.fastq")
        want = sorted([(n.split()[0], b.upper(), len(b)) for n, b, _ in RECORDS] * 2)
        assert sorted((r["name"], r.bases, r.length) for r in got.collect()) == want
        assert got.rdd.getNumPartitions() > 4 or block != "7b"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("text", ["@a\nACGT\n+\nIII\n", "@a\nACGT\n+\n@III@\n", "@a\nACGT\n+\n", "a\nACGT\n+\nIIII\n", "@a\nACGT\nIIII\n@b\nA\n+\nI\n", "@a\n@CGT\n+\nIIII\n", "@a\nACGT\n-\nIIII", "@a\n\n+\n"])
def test_fastq_errors(spark, tmp_path, text):
    (tmp_path / "x.fastq").write_text(text)
    with pytest.raises(Exception, match="FASTQ"):
        load_reads(spark, f"file://{tmp_path}/x.fastq").collect()


def test_segment_pairs_join_no_pair_with_all_owners(spark):
    draw = random.Random(8)
    members = sorted({(s, o) for o in range(300) for s in draw.sample(range(12), 2)})
    members = [(s, o, 1, draw.randrange(400) if draw.random() < 0.97 else None) for s, o in members]
    spans = [(o, *sorted((draw.randrange(-50, 450), draw.randrange(-50, 450)))) for o in range(290)]
    lengths = [(s, draw.randrange(1, 200)) for s in range(11)]
    want, at, span, long = {}, {(s, o): x for s, o, _, x in members}, {o: x for o, *x in spans}, dict(lengths)
    got = J.segment_pairs(spark.createDataFrame(members, "segment long, owner long, n long, offset long"), spark.createDataFrame(spans, "owner long, first long, last long"), spark.createDataFrame(lengths, "segment long, length long"))
    rows = {(r.a, r.b): r for r in got.collect()}
    offsets = {(r.a, r.b): r.offset for r in J.pair_offsets(spark.createDataFrame(members, "segment long, owner long, n long, offset long"), "owner", "segment").collect()}
    for (a, b), off in offsets.items():
        want[a, b] = []
        for here, there, sign in ((a, b, 1), (b, a, -1)):
            n = [0, 0]
            for (s, o), x in at.items():
                if s == here and (there, o) not in at and x is not None and o in span and there in long and off is not None:
                    begin = x + sign * off
                    n[not (begin < span[o][1] and begin + long[there] > span[o][0])] += 1
            want[a, b] += n
    assert {k: [r.unexplained_a, r.short_a, r.unexplained_b, r.short_b] for k, r in rows.items()} == want
    assert rows_of_joins(got) <= 2 * len(members)


def test_a_step_meets_each_owner_with_its_own_links(spark):
    steps = [(o, 0, 1 + o % 40) for o in range(400)]
    visits = [(o, i, s) for o, a, b in steps for i, s in enumerate((a, b))]
    links = [(0, 1 + i, 0) for i in range(40)]
    ground = W._Ground(
        spark.createDataFrame(visits, "owner long, idx long, segment long"), spark.createDataFrame(steps, "owner long, s0 long, s1 long"), spark.createDataFrame(links, "s0 long, s1 long, separation long"),
        spark.createDataFrame([], "a long, b long, common long, raw_jaccard double"), "owner", "segment", True, W.WalkOptions(),
    )
    moved = ground.step(spark.createDataFrame([(x, 0, 0) for x in range(5)], "start long, ref long, at long"))
    assert sorted((r.start, r.next) for r in moved.collect()) == [(x, 1) for x in range(5)]
    assert rows_of_joins(moved) <= 400


@pytest.mark.parametrize("universe", [14, 90])
def test_containment_shuffles_no_pair_that_fails(spark, universe):
    draw = random.Random(9)
    sets = list({tuple(sorted(draw.sample(range(universe), draw.randrange(1, 14)))) for _ in range(250)})
    sets = [(i, i % 2, list(x)) for i, x in enumerate(sets)]
    got = S.containment(spark.createDataFrame(sets, "id long, subgraph int, members array<long>"), 0.1)
    want = {(i, j) for i, g, x in sets for j, h, y in sets if g == h and i != j and len(set(y) - set(x)) <= int(0.1 * len(y) + 0.5)}
    rows = [(r.larger, r.smaller) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    try:
        joined = rows_of_joins(got)
    except ValueError:  # no join is left once nothing is to be compared
        joined = 0
    assert joined <= (3 * len(want) if universe > 64 else 0)


def test_common_members_are_counted_without_a_join(spark):
    draw = random.Random(10)
    rows = [(draw.choice([None, *range(30)]), draw.choice([None, *range(50)])) for _ in range(900)]
    got = L.common_members(spark.createDataFrame(rows, "o long, m long"), "o", "m")
    held = {o: {m for x, m in rows if x == o and m is not None} for o, _ in rows if o is not None}
    want = {(a, b, len(held[a] & held[b])) for a in held for b in held if a < b and held[a] & held[b]}
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_superbubbles_label_components_once(spark, monkeypatch):
    rows = []
    for b in range(20):
        x = b * 10
        rows += [(x, x - 5000, x, 1, 1, False), (x + 1, x, x + 1, 5 + b % 2, 1, True), (x + 2, x, x + 2, 3, 1, True), (x + 3, x + 1, x + 3, 5, 1, True), (x + 4, x + 2, x + 3, 4, 1, True), (x + 5, x, x + 3, 1, 1, True), (x + 6, x + 3, x + 5000, 1, 1, False)]
    calls, real = [], D.connected_components
    monkeypatch.setattr(D, "connected_components", lambda *args: calls.append(args) or real(*args))
    got = D.resolve_superbubbles(spark.createDataFrame(rows, "eid long, src long, dst long, coverage long, length long, inner boolean"))
    want = []
    for b in range(20):
        x = b * 10
        want += [(x - 5000, x, "kept", [x]), (x + 3, x + 5000, "kept", [x + 6]), (x, x + 3, "branch", [x + 1, x + 3]), (x, x + 3, "branch", [x + 2, x + 4])]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert len(calls) == 1


def test_forest_rounds_work_on_what_is_left(spark, monkeypatch):
    from weftgraph.operators import graph

    draw = random.Random(11)
    rows = sorted({(*sorted(draw.sample(range(60), 2)), draw.randrange(40)) for _ in range(160)})
    rows = list({x[:2]: x for x in rows}.values())
    sizes, real = [], graph.connected_components
    monkeypatch.setattr(graph, "connected_components", lambda edges, *names: sizes.append(edges.count()) or real(edges, *names))
    got = graph.spanning_forest(spark.createDataFrame(rows, "a long, b long, s long"), "s")
    parent = {x: x for x in range(60)}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    want = []
    for a, b, s in sorted(rows, key=lambda x: (-x[2], x[0], x[1])):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            want.append((a, b, s))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert len(sizes) > 1 and sum(sizes) == len(want)


def test_marker_connectivity_looks_outwards_only(spark, monkeypatch):
    draw = random.Random(12)
    rows = sorted({(a, draw.randrange(4), a + draw.randrange(1, 6), draw.randrange(4)) for a in range(0, 200, 3) for _ in range(2)})
    monkeypatch.setattr(G, "connected_components", None)
    got = G.marker_connectivity(spark.createDataFrame(rows, "r0 long, o0 int, r1 long, o1 int"), rows[0][0], rows[0][1])
    near = {rows[0][:2]}
    while len(near) != len(near := near | {x for r in rows for x in (r[:2], r[2:]) if r[:2] in near or r[2:] in near}):
        pass
    assert sorted(tuple(r) for r in got.collect()) == sorted(r for r in rows if r[:2] in near)


def test_rounds_of_candidates_grow(spark, monkeypatch):
    texts = [" ".join(f"d{i}w{j}" for j in range(3)) + f" p{i // 2}a p{i // 2}b p{i // 2}c p{i // 2}d" for i in range(24)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    written, real = [], L.materialize
    monkeypatch.setattr(L, "materialize", lambda df, label: written.append(label) or real(df, label))
    got = L.candidates_until(L.word_features(docs, 4), 24, L.LowHashOptions(hash_fraction=0.02)).collect()
    assert sorted((r.r0, r.r1) for r in got) == [(2 * i, 2 * i + 1) for i in range(12)] and min(r.hits for r in got) >= 2
    assert written.count("hits") <= 2 * 10


def test_inconsistent_fits_a_neighbourhood_once(spark, monkeypatch):
    rng = random.Random(5)
    offset = {(u, v): float(rng.randrange(-300, 300)) for c in (0, 10) for u in range(c, c + 6) for v in range(u + 1, c + 6)}
    offset |= {(6, 7): 500.0}  # in no triangle
    written = {}

    def spy(df, label="stage"):
        written[label] = kept = materialize(df, label)
        return kept

    monkeypatch.setattr(R, "materialize", spy)
    found = R.inconsistent(spark.createDataFrame([(u, v, w) for (u, v), w in offset.items()], "u long, v long, offset double"), most=20.0)
    want = set()
    for c in (0, 10):
        rows = sorted((u, v, w) for (u, v), w in offset.items() if c <= u < c + 6 and v < c + 6)
        while rows:
            residual = abs(R.least_squares_positions(rows)[1])
            if residual.max() < 20:
                break
            want.add(rows.pop(int(residual.argmax()))[:2])
    assert {tuple(x) for x in found.collect()} == want
    assert written["graphs"].count() == 2  # of up to 40 bad triangles


def test_edge_consensus_counts_equal_intervals(spark):
    edges = {
        1: ([(2, ""), (3, ""), (3, ""), (2, ""), (0, "AC")], (2, "")), 2: ([(0, "ACGT"), (0, "AGT"), (0, "ACGT"), (4, "")], (0, "ACGT")),
        3: ([(0, "A" * 30), (0, "C" * 12), (0, "A" * 12), (5, None)], (0, "A" * 12)), 4: ([(0, ""), (0, ""), (0, "G")], (0, "")),
        5: ([(None, "T"), (0, None), (0, "C"), (0, "C")], (0, "C")), 6: ([(1, ""), (0, "")], (0, "")),
    }
    rows = [(k, o, s) for k, (told, _) in edges.items() for o, s in told] + [(7, 0, "ACG")] * 500
    found = N.edge_consensus(spark.createDataFrame(rows, "eid long, overlap int, sequence string"), "eid", longest=20)
    assert {r.eid: (r.overlap, r.sequence) for r in found.collect()} == {k: want for k, (_, want) in edges.items()} | {7: (0, "ACG")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan  # groups of an edge's intervals don't pass through pandas
