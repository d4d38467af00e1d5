"""k-mer steps that cut reads inside their tasks, against plain loops."""

from collections import Counter, defaultdict

import pytest

from weftgraph.operators import kmers as K

READS = [(1, "ACGTACGTTACGN"), (2, "ACG"), (3, None), (4, ""), (5, "TTTTTTTTTT"), (7, "GATTACAGATTACAACG")]
PLAIN = [(r, b and b.replace("N", "")) for r, b in READS]


def other(bases):
    return bases[::-1].translate(str.maketrans("ACGT", "TGCA"))


def strands(reads):
    return [(2 * r + s, b if s == 0 else other(b)) for r, b in reads if b for s in (0, 1)]


def grams(reads, k):
    return [(o, i, b[i : i + k], len(b)) for o, b in strands(reads) for i in range(len(b) - k + 1)]


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


@pytest.mark.parametrize("reads", [READS, PLAIN], ids=["odd letters", "bases only"])
@pytest.mark.parametrize("k", [3, 9, 17])
@pytest.mark.parametrize("slice_", [1, 1 << 20])
def test_counts_gaps_and_enrichment(spark, monkeypatch, reads, k, slice_):
    monkeypatch.setattr(K, "SLICE", slice_)
    df = spark.createDataFrame(reads, "read_id long, bases string")
    all_ = grams(reads, k)
    assert {r.kmer: r.frequency for r in K.kmer_frequency(df, k).collect()} == Counter(g for _, _, g, _ in all_)
    places = defaultdict(list)
    for o, i, g, _ in all_:
        places[g, o].append(i)
    gap = defaultdict(lambda: None)
    for (g, _), at in places.items():
        for a, b in zip(at, at[1:], strict=False):
            gap[g] = min(b - a, gap[g] or b - a)
    assert {r.kmer: (r.frequency, r.gap) for r in K.nearest_repeats(df, k).collect()} == {g: (n, gap[g]) for g, n in Counter(x[2] for x in all_).items()}
    over = {g for (g, o), at in places.items() if len(at) > max(1, 2.0 * (dict(strands(reads))[o].__len__() + 1 - k) // 4**k)}
    kept = K.select_not_enriched_in_reads(df, k, 2.0, 1.0)
    assert {r.kmer for r in kept.collect()} == {x[2] for x in all_} - over


@pytest.mark.parametrize("reads", [READS, PLAIN], ids=["odd letters", "bases only"])
def test_markers_are_numbered_in_their_rows(spark, monkeypatch, reads):
    df = spark.createDataFrame(reads, "read_id long, bases string")
    chosen = ["ACG", "TTT", "CGN", "TAC"]
    selected = spark.createDataFrame([(x,) for x in chosen], "kmer string")
    want = []
    for o, b in strands(reads):
        found = [(i, b[i : i + 3]) for i in range(len(b) - 2) if b[i : i + 3] in chosen]
        want += [(o, n, g, i, len(found), len(b)) for n, (i, g) in enumerate(found)]
    df_sampled = K.downsample_markers(K.find_markers(df, selected, 3), 0.5)
    sampled = {(r.oriented_id, r.ordinal): r.sampled_ordinal for r in df_sampled.collect()}
    for most in (1 << 20, 0):  # 0: as for a selection too large to send
        monkeypatch.setattr(K, "SMALL_TABLE", most)
        found = K.find_markers(df, selected, 3, counted=True, sample=0.5)
        assert sorted((r.oriented_id, r.ordinal, r.kmer, r.position, r.n, r.length) for r in found.collect()) == sorted(want)
        assert {(r.oriented_id, r.ordinal): r.sampled_ordinal for r in found.collect() if r.sampled_ordinal is not None} == sampled
        arrays = K.markers_by_kmer(K.marker_arrays(df, selected, 3))
        assert sorted(map(str, arrays.collect())) == sorted(map(str, K.markers_by_kmer(K.find_markers(df, selected, 3)).collect()))
        if most:
            assert shuffles(found) == 0 and shuffles(arrays) == 0
