"""Small cases with known results, and brute force, for the engine's own operators."""

import random
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import alignment as A
from weftgraph.operators import assembly_graph as B
from weftgraph.operators import consensus as N
from weftgraph.operators import kmers as K
from weftgraph.operators import marker_graph as G
from weftgraph.operators import phasing as D
from weftgraph.operators import read_graph as R
from weftgraph.operators import sequences as S
from weftgraph.operators.graph import connected_components
from weftgraph.sources.models import parse_bases
from weftgraph.sources.sequences import load_reads, overlapping_intervals


def test_run_lengths(spark):
    raw = "TAATCATTTTGATGTAAGTCTAAAAATTTCACCTTAATACTTATTTTTCC"
    df = spark.createDataFrame([(1, raw), (2, "A" * 255), (3, "A" * 256), (4, "")], "read_id long, bases string")
    rows = {r.read_id: r for r in S.run_length_encode(df).withColumn("back", S.run_length_decode(F.col("rle"), F.col("counts"))).collect()}
    assert rows[1].rle == "TATCATGATGTAGTCTATCACTATACTATC" and "".join(map(str, rows[1].counts)) == "121114111112111153112221112152"
    assert rows[1].back == raw and set(rows) == {1, 2, 4}


def test_metadata(spark):
    df = spark.createDataFrame([("ch=12 read=7 ch=13",), ("ch= read=7",)], "m string")
    got = df.select(S.metadata_value(F.col("m"), "ch").alias("a"), S.metadata_value(F.col("m"), "x").alias("b")).collect()
    assert [tuple(r) for r in got] == [("12", None), (None, None)]


def test_n50_and_cutoff(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([10, 8, 6, 4, 2])], "id long, length long")
    assert S.read_n50(df).first()[0] == 8 and S.assembly_n50(df, "id", "length").first()["n50"] == 8
    assert S.coverage_cutoff(df, 20).first()[0] == 6 and S.coverage_cutoff(df, 100).first()[0] == 0


def test_fasta_drops_and_fastq_rejects_bad_bases(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">a one two\nACGT\nAC GT\n>b\nACNT\n>c\n\n")
    got = {r["name"]: (r["meta"], r["bases"]) for r in load_reads(spark, f"file://{tmp_path}/x.fasta", 1).collect()}
    assert got == {"a": ("one two", "ACGTACGT")}
    (tmp_path / "y.fastq").write_text("@a\nACGT\n+\nIIII\n@b\nACNT\n+\nIIII\n")
    with pytest.raises(Exception, match="bad FASTQ read"):
        load_reads(spark, f"file://{tmp_path}/y.fastq").collect()
    with pytest.raises(ValueError):
        load_reads(spark, "z.txt.gz")


def test_kmers_are_strand_symmetric(spark):
    df = spark.createDataFrame([(0, "ACGTTGCAACGGT"), (1, "AC")], "read_id long, bases string")
    freq = {r.kmer: r.frequency for r in K.kmer_frequency(df, 3).collect()}
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    want = {}
    for s in ("ACGTTGCAACGGT", rc("ACGTTGCAACGGT")):
        for i in range(len(s) - 2):
            want[s[i : i + 3]] = want.get(s[i : i + 3], 0) + 1
    assert freq == want
    marks = K.find_markers(df, spark.createDataFrame([("ACG",), ("CGT",)], "kmer string"), 3)
    got = sorted((r.oriented_id, r.ordinal, r.kmer, r.position) for r in marks.collect())
    lengths = df.select("read_id", F.length("bases").alias("length"))
    assert sorted((r.oriented_id, r.ordinal, r.kmer, r.position) for r in K.reverse_complement_markers(marks, lengths, 3).collect()) == got


def test_streaks_and_alignment_methods(spark):
    pairs = [(300, 200), (301, 201), (302, 202), (305, 206), (306, 207), (320, 250), (321, 251), (322, 252), (323, 253)]
    df = spark.createDataFrame([(0, 1, a, b, 400, 400) for a, b in pairs], "r0 long, r1 long, o0 int, o1 int, n0 long, n1 long")
    found = A.streaks(df)
    assert [(r.skip0, r.skip1, r.n) for r in found.orderBy("idx").collect()] == [(300, 200, 3), (3, 4, 2), (14, 43, 4)]  # the worked example of the format
    assert sorted((r.o0, r.o1) for r in A.from_streaks(found).collect()) == pairs
    rng = random.Random(3)
    a = [rng.randrange(1000) for _ in range(120)]
    b = [x for x in a[20:] if rng.random() > 0.1]
    for method in (A.align_shortest_path, A.align_global):
        got = method(a, b, A.AlignOptions())
        assert len(got) > 80 and all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
    assert len(A.align_cells(a, b, A.AlignOptions(min_entries=2, cell_x=60))) > 80
    assert len(A.align_downsampled(a, b, A.AlignOptions(downsampling=0.3))) > 80
    assert A.align_global([1, 2, 3], [7, 8]) == []


def _full_matrix(a, b, options, band):
    """The score of the best alignment within a band, from the whole matrix."""
    none, (lo, hi) = -(10**9), band
    score = [[none] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if lo <= i - j <= hi:
                ways = [0] if i == 0 or j == 0 else []
                if i and j:
                    ways += [score[i - 1][j - 1] + (options.match if a[i - 1] == b[j - 1] else options.mismatch), score[i - 1][j] + options.gap, score[i][j - 1] + options.gap]
                score[i][j] = max(ways)
    return max([r[-1] for r in score] + score[-1])


def test_banded_alignment_equals_the_whole_matrix():
    rng = random.Random(5)
    options = A.AlignOptions()
    for _ in range(150):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 30))]
        b = [x for x in a if rng.random() > 0.2] + [rng.randrange(6) for _ in range(rng.randrange(1, 12))]
        lo = rng.randrange(-20, 20)
        band = (lo, lo + rng.randrange(0, 25))
        want = _full_matrix(a, b, options, band)
        got = A.align_global(a, b, options, band)
        if want <= 0:
            assert got == []
            continue
        assert all(a[i] == b[j] and lo <= i - j <= band[1] for i, j in got)
        total, last = 0, None
        for i, j in got:
            if last:
                d0, d1 = i - last[0] - 1, j - last[1] - 1
                total += min(d0, d1) * options.mismatch + abs(d0 - d1) * options.gap
            total += options.match
            last = (i, j)
        assert total >= want  # what lies before the first match costs no less than nothing


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(5, 5)]
    parent = {}
    for u, v in edges:
        parent[R._find(parent, u)] = R._find(parent, v)
    groups = {}
    for x in list(parent):
        groups.setdefault(R._find(parent, x), []).append(x)
    want = {x: min(g) for g in groups.values() for x in g}
    for parts in (1, 5):
        df = spark.createDataFrame(edges, "a long, b long").repartition(parts)
        assert {r.node: r.component for r in connected_components(df).collect()} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_top_k_keeps_what_either_end_keeps(spark):
    df = spark.createDataFrame([(1, 10, 20, 10), (2, 20, 30, 9), (3, 10, 20, 1)], "aid long, u long, v long, markers long")
    assert {r.aid for r in R.top_k_edges(df, 1).collect()} == {1, 2}


def test_chimera_and_triangles(spark):
    path = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5)], "u long, v long")
    assert 3 in {r.node for r in R.chimeric(path).collect()}
    circle = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (5, 1)], "u long, v long")
    assert R.chimeric(circle).count() == 0
    assert [tuple(r) for r in R.triangles(spark.createDataFrame([(1, 2), (3, 2), (1, 3), (3, 4)], "u long, v long")).collect()] == [(1, 2, 3)]


def test_strand_separation(spark):
    edges = [(0, 0, 0, 2, 10), (1, 0, 1, 3, 10), (2, 1, 2, 4, 9), (3, 1, 3, 5, 9), (4, 2, 0, 5, 3), (5, 2, 1, 4, 3)]
    df = spark.createDataFrame(edges, "eid long, aid long, u long, v long, markers long")
    assert {r.eid for r in R.separate_strands(df).where("crosses").collect()} == {4, 5}


def test_strand_separation_equals_a_loop(spark):
    """One edge pair after the other, in order, over random graphs with parallel and self-joining pairs and equal scores."""
    draw = random.Random(7)
    edges = []
    for aid in range(90):
        u, v = draw.randrange(60), draw.randrange(60)
        score = draw.randrange(1, 6)
        edges += [(2 * aid, aid, u, v, score), (2 * aid + 1, aid, u ^ 1, v ^ 1, score)]
    parent, want = {}, set()
    for _, aid, u, v, _ in sorted(edges[::2], key=lambda x: (-x[4], x[1])):
        if R._find(parent, u) == R._find(parent, v ^ 1):
            want |= {2 * aid, 2 * aid + 1}
        else:
            parent[R._find(parent, u)] = R._find(parent, v)
            parent[R._find(parent, u ^ 1)] = R._find(parent, v ^ 1)
    df = spark.createDataFrame(edges, "eid long, aid long, u long, v long, markers long")
    assert {r.eid for r in R.separate_strands(df).where("crosses").collect()} == want and 5 < len(want) < 90
    assert R.separate_strands(df).count() == len(edges)


def test_shortest_path(spark):
    line = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(0, 20), (20, 2), (50, 51)], "u long, v long")
    assert R.shortest_path(line, 0, 12) == [0, 1, 2, *range(3, 13)]
    assert R.shortest_path(line, 3, 3) == [3] and R.shortest_path(line, 0, 50) == [] and R.shortest_path(line, 0, 12, 5) == []


def test_transitive_reduction_and_pruning(spark):
    df = spark.createDataFrame([(1, 1, 2, 5), (2, 2, 3, 5), (3, 1, 3, 2)], "eid long, src long, dst long, coverage long")
    assert {r.eid for r in G.transitive_reduction(df).collect()} == {1, 2}
    two = spark.createDataFrame([(1, 1, 2, 3), (2, 1, 2, 3)], "eid long, src long, dst long, coverage long")
    assert G.transitive_reduction(two).count() == 1
    far = spark.createDataFrame([(1, 1, 2, 1, 101), (2, 2, 3, 1, 100), (3, 3, 4, 2, 500)], "eid long, src long, dst long, coverage long, skip long")
    assert {r.eid for r in G.transitive_reduction(far, skip="skip").collect()} == {2, 3} and G.transitive_reduction(far).count() == 3
    path = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    assert [tuple(r) for r in G.prune_leaves(path, 1).collect()] == [(2, 3)] and G.prune_leaves(path, 2).count() == 0


def test_linear_chains_with_circle(spark):
    edges = [(10, 1, 2), (11, 2, 3), (12, 3, 4), (13, 3, 5), (20, 7, 8), (21, 8, 9), (22, 9, 7)]
    got = {r.eid: (r.chain, r.position) for r in B.linear_chains(spark.createDataFrame(edges, "eid long, src long, dst long")).collect()}
    assert got == {10: (10, 0), 11: (10, 1), 12: (12, 0), 13: (13, 0), 20: (20, 0), 21: (20, 1), 22: (20, 2)}


def test_tangles(spark):
    cells = [(9, 1, 3, 5), (9, 1, 4, 0), (9, 2, 3, 1), (9, 2, 4, 6)]
    df = spark.createDataFrame(cells, "eid long, in_eid long, out_eid long, common long")
    assert {(r.in_eid, r.out_eid) for r in B.solvable_by_dominance(df).collect()} == {(1, 3), (2, 4)}
    assert B.solvable_strictly(df).count() == 0
    edges = spark.createDataFrame([(1, 1, 5), (2, 2, 5), (9, 5, 6), (3, 6, 7), (4, 6, 8)], "eid long, src long, dst long")
    members = spark.createDataFrame([(1, 100), (3, 100), (2, 200), (4, 200), (9, 100), (9, 200)], "eid long, member long")
    new, who = B.detangle(edges, members)
    assert {(r.src, r.dst) for r in new.collect()} == {(1, 7), (2, 8)} and {r.member for r in who.collect()} == {100, 200}


def test_subsets(spark):
    sets = [{10, 20, 30}, {10, 20}, {20, 30}, {20}, {20, 30, 40}, {40, 50, 60}, {30, 40}, {40, 50}, {40}]
    df = spark.createDataFrame([(i, x) for i, s in enumerate(sets) for x in s], "s long, x long")
    assert {(r.larger, r.smaller) for r in B.subset_graph(df, "s", "x").collect()} == {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if b < a}


@pytest.mark.parametrize(("values", "want"), [([1, 1], 1), ([1, 1, 1, 1, 2, 3], 1), ([1, 1, 1, 2, 3, 4, 5], 2), ([1, 1, 1, 3, 4, 5], 2), ([1, 1, 1, 2, 3, 4], 2), ([1, 3, 5], 2), ([3], 2)])
def test_median_caller(spark, values, want):
    df = spark.createDataFrame([(0, x) for x in values], "p long, repeat int")
    assert N.median_by_coverage(df, "p").first()["called"] == want


def test_modal_and_consensus(spark):
    df = spark.createDataFrame([(0, x) for x in (2, 2, 3, 3)], "p long, repeat int")
    assert N.modal(df, "p").first()["called"] == 3
    assert N.aligned_consensus(["ACGT", "ACGT", "AGT"]) == "ACGT" and N.aligned_consensus([]) == ""


@pytest.mark.parametrize(("m", "want"), [((10, 0, 0, 10), (55.75072, -200.0)), ((0, 7, 9, 0), (-160.0, 43.580355)), ((5, 5, 5, 5), (-72.12464, -72.12464)), ((8, 1, 2, 9), (17.388112, -161.637392))])
def test_bayesian_phase(spark, m, want):
    df = spark.createDataFrame([m], "m00 long, m01 long, m10 long, m11 long")
    row = D.phase_scores(df).first()
    assert (row.log_in, row.log_out) == pytest.approx(want, abs=1e-5)


def test_spanning_forest_matches_kruskal(spark):
    rng = random.Random(5)
    edges = [(a, b, rng.randrange(2), float(rng.randrange(50))) for a, b in combinations(range(12), 2) if rng.random() < 0.5]
    parent, want = {}, set()
    for a, b, _, w in sorted(edges, key=lambda e: (-e[3], e[0], e[1])):
        if R._find(parent, a) != R._find(parent, b):
            parent[R._find(parent, a)] = R._find(parent, b)
            want.add((a, b))
    df = spark.createDataFrame(edges, "a long, b long, phase int, log_p double")
    assert {(r.a, r.b) for r in D.spanning_forest(df).collect()} == want


def test_intervals(spark):
    rng = random.Random(2)
    rows = [("r", i, s := rng.randrange(500), s + rng.randrange(1, 80)) for i in range(60)]
    df = spark.createDataFrame(rows, "region string, id long, start long, stop long")
    want = {(a[1], b[1]) for a, b in combinations(rows, 2) if a[2] < b[3] and b[2] < a[3]}
    assert {(r.a, r.b) for r in overlapping_intervals(df, 40).collect()} == want


def test_units_and_small_graphs():
    assert parse_bases("120Gb") == 120 * 10**9 and parse_bases("7") == 7
    assert B.reduce_dag([(1, 2), (2, 3), (1, 3)]) == [(1, 2), (2, 3)]
    assert B.dominator_tree([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)], 1) == {2: 1, 3: 1, 4: 1, 5: 4}
    assert B.self_avoiding_paths([(1, 2), (2, 3), (1, 3)], 1, 3) == [[1, 2, 3], [1, 3]]
    assert G.automatic_min_coverage([0, 0, 50, 20, 5, 1, 8, 30, 60, 30, 8]) == 6


def test_candidates_until_equal_a_loop(spark, monkeypatch):
    """The registered query iterates to its stop over the counted documents, as a plain loop does; low stops and tables without enough pairs too."""
    import hashlib
    from collections import Counter, defaultdict

    import __spark_entry__ as entry
    from weftgraph.operators import lowhash as L

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, (r.text or "").lower().split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    buckets = defaultdict(list)
    for i, w in docs:
        for o in range(len(w) - 3):
            buckets[" ".join(w[o : o + 4])].append(i)
    buckets = {f: x for f, x in buckets.items() if 2 <= len(x) <= 10}
    everything = {(a, b) for x in buckets.values() for a in x for b in x if a < b}

    def loop(per_read):
        hits, i = Counter(), 0
        while True:
            for f, x in buckets.items():
                digest = hashlib.md5((f"{i // L.TURNS}|{f}" if i >= L.TURNS else f).encode()).hexdigest()
                if L.draw(int(digest[:13], 16), int(digest[13:26], 16), i) < int(0.02 * L.DRAWS):
                    hits.update((a, b) for a in x for b in x if a < b)
            i += 1
            found = {k: n for k, n in hits.items() if n >= 2}
            if 2 * len(found) / len(docs) >= per_read or len(found) >= len(everything):
                return found

    words = L.word_markers(spark.read.parquet(f"{sf}/documents.parquet"))
    for per_read in (0.2, 0.5):
        got = L.candidates_until(words, len(docs), L.LowHashOptions(hash_fraction=0.02, candidates_per_read=per_read))
        assert {(r.r0, r.r1): r.hits for r in got.collect()} == loop(per_read)
    got = {(r.r0, r.r1): r.hits for r in entry.queries()["lowhash_until"](spark, sf).collect()}
    print("documents", len(docs), "all", len(everything), "found", len(got))
    assert got == loop(20.0)


def test_contamination_in_many_copies_is_found(spark):
    """The registered query against brute force; a passage that many documents hold counts as any other."""
    from collections import Counter

    import __spark_entry__ as entry
    from weftgraph.operators import lowhash as L

    sf = "/root/testdata/sf0.001"

    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)}

    def brute(docs, items):
        hits = Counter()
        for d, t in docs:
            g = grams(t)
            hits.update({(d, i): n for i, x in items if (n := len(g & x)) >= 2})
        return dict(hits)

    read = lambda name, key: [(r[key], r.text) for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]
    want = brute(read("documents", "doc_id"), [(i, grams(t)) for i, t in read("benchmark", "item_id")])
    got = {(r.doc_id, r.item_id): r.hits for r in entry.queries()["contamination_candidates"](spark, sf).collect()}
    print("pairs", len(want), "found", len(got))
    assert got == want
    docs = [(i, f"w{i} the passage that all copies hold x{i}") for i in range(30)]
    of = lambda rows: L.word_markers(spark.createDataFrame(rows, "doc_id long, text string"))
    found = L.cross_candidates(of(docs), of([(7, "the passage that all copies hold")]), m=4, min_frequency=2)
    want = {(i, 7, 3) for i in range(30)}
    assert {(r.left_id, r.right_id, r.hits) for r in found.collect()} == want
    import duckdb

    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.sql("create table benchmark (item_id bigint, text varchar)")
    con.sql("insert into documents values " + ", ".join(f"({i}, '{t}')" for i, t in docs))
    con.sql("insert into benchmark values (7, 'the passage that all copies hold')")
    assert set(con.sql(entry.oracle_sql()["contamination_candidates"]).fetchall()) == want


def test_tangles_in_a_row_are_all_resolved(spark):
    n = 11  # each shares its out-edges with the next, so every round resolves one
    edges = [(1, -1, 0), (2, -2, 0)]
    members = [(1, 100), (2, 200)]
    for i in range(n):
        last = i == n - 1
        edges += [(10 * i + 9, 2 * i, 2 * i + 1), (10 * i + 11, 2 * i + 1, 901 if last else 2 * i + 2), (10 * i + 12, 2 * i + 1, 902 if last else 2 * i + 2)]
        members += [(10 * i + 9, 100), (10 * i + 9, 200), (10 * i + 11, 100), (10 * i + 12, 200)]
    new, who = B.detangle(spark.createDataFrame(edges, "eid long, src long, dst long"), spark.createDataFrame(members, "eid long, member long"))
    assert {(r.src, r.dst) for r in new.collect()} == {(-1, 901), (-2, 902)} and {r.member for r in who.collect()} == {100, 200}


def _reached(out, a, b, without, distance):
    front = {a}
    for _ in range(distance):
        front = {t for s in front for e, t in out[s] if e != without}
        if b in front:
            return True
    return False


@pytest.mark.parametrize("backward", [False, True])
def test_greedy_edits_equal_a_loop(spark, backward):
    draw = random.Random(5)
    edges = [(e, draw.randrange(30), draw.randrange(30), draw.randrange(1, 6)) for e in range(110)]
    left = sorted(edges, key=lambda x: (x[3], x[0]))
    for e in list(left):
        out = defaultdict(list)
        for f, s, t, _ in left:
            out[s].append((f, t))
        a, b = (e[2], e[1]) if backward else (e[1], e[2])
        if _reached(out, a, b, e[0], 5):
            left.remove(e)
    df = spark.createDataFrame(edges, "eid long, src long, dst long, coverage long")
    assert {r.eid for r in G.transitive_reduction(df, distance=5, backward=backward).collect()} == {e[0] for e in left}
    if not backward:
        left, gone = list(edges), set()
        for e in sorted((x for x in edges if x[3] <= 2), key=lambda x: (x[3], x[0])):
            if sum(x[1] == e[1] for x in left) > 1 and sum(x[2] == e[2] for x in left) > 1:
                left.remove(e)
                gone.add(e[0])
        assert {r.eid for r in B.low_coverage_cross_edges(df, 2).collect()} == gone


def test_a_read_of_too_many_markers_is_an_error(spark):
    with pytest.raises(Exception, match="markers"):
        spark.createDataFrame([(1, 1 << 24)], "r long, o int").select(G.marker_key("r", "o")).collect()
