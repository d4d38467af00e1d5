"""Every stage of the pipeline on a small fixture with known decisions."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in P.STAGES:
        from weftgraph.storage import materialize

        out.append(materialize(stage(spark, out[-1], SF), "stage"))
    return out


def test_stages_keep_columns_and_shrink(stages):
    for before, after in zip(stages[:-2], stages[1:-1], strict=True):
        assert after.columns == before.columns and 0 < after.count() <= before.count()
        assert after.join(before, "doc_id", "left_anti").count() == 0


def test_exact_copies_leave_one(stages):
    kept = stages[2]
    assert kept.count() == kept.select("text").distinct().count() == kept.select("doc_id").distinct().count()
    words = F.size(F.split("text", r"\s+"))
    lost = stages[1].where(words > 20).join(kept.select("text"), "text", "left_anti")  # each lost text is near a kept one
    assert lost.count() < 0.2 * stages[1].count()


def test_no_repeat_is_left(stages):
    seen, texts = set(), stages[3].orderBy("doc_id").collect()
    left = 0
    before = {r.doc_id: r.text for r in stages[2].collect()}
    for r in texts:
        body = r.text.encode()
        if r.text == before[r.doc_id]:
            left += sum(body[p : p + 100] in seen for p in range(len(body) - 99))
        seen.update(body[p : p + 100] for p in range(len(body) - 99))
        assert r.n_chars == len(r.text)
    assert left == 0


def test_contaminated_go_and_mix_takes_all_sources(stages):
    from weftgraph.llm.decontaminate import contamination

    bench = stages[0].sparkSession.read.parquet(f"{SF}/benchmark.parquet")
    bad = {r.doc_id for r in contamination(stages[3], bench).where("contaminated").collect()}
    assert {r.doc_id for r in stages[3].collect()} - bad == {r.doc_id for r in stages[4].collect()}
    sums = stages[5].groupBy("source").agg(F.sum("size").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) < 0.15 * r.target + 50 for r in sums)
    assert stages[5].agg(F.max("copy")).first()[0] <= 3


def jaccard(a, b, n=5):
    x, y = ({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_near_copies_are_those_of_the_jaccard_similarity(spark):
    """Pairs of texts of 5 to 120 words against brute force: every link at 0.8 or more and none below."""
    import numpy as np

    rng = np.random.default_rng(5)
    rows, pairs = [], []
    for k in range(400):
        w = [f"{k}w{i}" for i in rng.integers(0, 10**6, int(rng.integers(8, 25) if k % 2 else rng.integers(25, 120)))]
        v = list(w)
        if k % 4 == 1:
            v[-1] = "last"  # short texts, often below 0.8
        elif k % 4 == 3:
            v.append("more")
        else:
            for _ in range(int(rng.integers(1, 4))):
                v[int(rng.integers(len(v)))] = "zz"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
        pairs.append(jaccard(rows[-2][1], rows[-1][1]) >= 0.8)
    kept = {r.doc_id for r in P.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    gone = [2 * k + 1 not in kept for k in range(len(pairs))]
    right = sum(g and p for g, p in zip(gone, pairs, strict=True))
    print("pairs", len(pairs), "similar", sum(pairs), "removed", sum(gone), "rightly", right)
    assert all(2 * k in kept for k in range(len(pairs)))
    assert right == sum(gone) and right >= 0.98 * sum(pairs)


def test_crowded_near_copies_lose_no_link(spark):
    """A crowd of copies that differ among themselves, linked through their pattern or not at all."""
    import numpy as np

    rng = np.random.default_rng(6)
    base = [f"b{i}" for i in range(100)]
    texts = []
    for i in range(240):
        w = list(base)
        for at in rng.choice(100, 1 + i % 7, replace=False):
            w[at] = f"x{i}"
        texts.append(" ".join(w))
    label = list(range(240))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(240):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                label[max(root(i), root(j))] = min(root(i), root(j))
    want = {i for i in range(240) if root(i) == i}
    got = {r.doc_id for r in P.near_duplicate_stage(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), SF).collect()}
    print("groups", len(want), "kept", len(got))
    assert len(want) > 1 and want <= got and len(got) <= 1.02 * len(want) + 1


def test_a_stage_drops_what_those_before_it_left(spark, stages):
    from pathlib import Path

    from weftgraph.storage import materialize

    stage, there = dict(P.STAGES), lambda paths: [x for x in paths if Path(x.removeprefix("file:")).exists()]
    P.sweep(spark)
    near = materialize(stage["near_duplicates"](spark, stages[1], SF), "near")
    left = list(P._LEFT[spark])
    assert there(left)
    clean = stage["decontamination"](spark, near, SF)
    assert not there(left) and near.count() == stages[2].count()
    mixed = stage["mixing"](spark, clean, SF)  # of a result that isn't written: its tables stay
    assert mixed.select("doc_id").distinct().count() <= clean.count() > 0
    P.sweep(spark)
    assert not there(P._LEFT.get(spark, []))


def test_a_task_gives_a_few_rows_a_set_and_all_crowded_keys(spark):
    """Finding 1, pipeline: 150 prints a few bits apart meet under some 100 keys each; a task's rows grow with its sets, not with their keys or pairs."""
    import numpy as np

    from weftgraph.llm import simhash

    rng = np.random.default_rng(7)
    base, rows = rng.integers(-(1 << 62), 1 << 62, 2), []
    for i in range(150):
        w = base.copy()
        for at in rng.choice(120, i % 4, replace=False):
            w[at // 64] ^= np.int64(1) << np.int64(at % 64)
        rows.append((*map(int, w), 1000 + i, 50, 0))
    sets = spark.createDataFrame(rows, "w0 long, w1 long, node long, n long, label long").cache()
    expanded = simhash._expanded(sets, 0, False).cache()
    out = simhash._listed(expanded, 36, 0.8, 1, False, 131).collect()
    per = {kind: sum(r.kind == kind for r in out) for kind in (0, 1, 2)}
    print("rows by kind", per, "of", expanded.count(), "keyed rows")
    assert per[0] <= 2 * len(rows) and per[1] <= len(rows) and per[2] <= 5 * len(rows)
    many = {r.key for r in expanded.groupBy("key").count().where(f"count > {simhash.LISTED}").collect()}
    want = {(r.node, r.key) for r in expanded.collect() if r.key in many}
    segments = spark.createDataFrame([(r.node, [(r.key, r.bits)]) for r in out if r.kind == 2], "node long, segments array<struct<key:long,bits:long>>")
    merged = segments.selectExpr("node", "explode(segments) s").groupBy("node").agg(F.collect_list("s").alias("segments"))
    got = {(r.node, k) for r in simhash._crowded_keys(sets.join(merged, "node")).collect() for k in r["keys"]}
    assert many and got == want
    small = simhash._Best(10)  # rows beyond what is held go out early, and none is lost
    parts = [x for at in range(0, 200, 20) for x in small.add(0, np.full(20, 5), np.arange(at, at + 20), np.full(20, 3))] + list(small.drained())
    assert {n for _, _, node, _ in parts for n in node.tolist()} == set(range(200))


def test_pairs_left_of_crowded_keys_come_once(spark):
    """Finding 1, pipeline: 90 unlike sets with near prints share many crowded keys; each pair is given once, as by brute force, and checked in its blocks."""
    import numpy as np

    from weftgraph.llm import simhash

    rng = np.random.default_rng(9)
    base, rows = rng.integers(-(1 << 62), 1 << 62, 4), []
    for i in range(90):
        w = base.copy()
        for at in rng.choice(256, 2 + i % 9, replace=False):
            w[at // 64] ^= np.int64(1) << np.int64(at % 64) if at % 64 < 63 else np.int64(-(1 << 63))
        rows.append((*map(int, w), 1000 + i, 50, i % 3))
    sets = spark.createDataFrame(rows, "w0 long, w1 long, w2 long, w3 long, node long, n long, label long").withColumn("block", F.col("node") % 4).cache()
    both = [simhash._expanded(sets, p, True).withColumn("p", F.lit(p)) for p in (0, 1)]
    left = simhash._left(both[0].unionByName(both[1]).drop("p").cache(), 36, 0.8, 18).collect()
    seg = lambda w, p, s: ((int(w[2 * p]) & (1 << 64) - 1 | (int(w[2 * p + 1]) & (1 << 64) - 1) << 64) >> 24 * s) & (1 << 24) - 1
    want = set()
    for i, x in enumerate(rows):
        for y in rows[:i]:
            diff = [(int(a) ^ int(b)) & (1 << 64) - 1 for a, b in zip(x[:4], y[:4], strict=True)]
            bits = [d.bit_count() for d in diff]
            meets = any((seg(x, p, s) ^ seg(y, p, s)).bit_count() <= 1 and bits[2 * p] + bits[2 * p + 1] <= 36 for p in (0, 1) for s in range(5))
            if meets and sum(bits) <= 18 and (x[6] != y[6] or x[6] == 0):
                want.add((y[4], x[4]))
    got = [(min(r.a, r.b), max(r.a, r.b)) for r in left]
    print("pairs", len(got))
    assert len(got) == len(set(got)) and set(got) == want and all(r.block_a == r.a % 4 and r.block_b == r.b % 4 for r in left)
    shingles = {r[4]: set(rng.choice(60, 50, replace=False).tolist()) for r in rows}
    table = spark.createDataFrame([(k, sorted(v)) for k, v in shingles.items()], "node long, shingles array<long>")
    found = {(r.a, r.b) for r in simhash._in_blocks(spark.createDataFrame(left), table, 0.8).collect()}
    assert found == {(r.a, r.b) for r in left if len(shingles[r.a] & shingles[r.b]) >= 0.8 * len(shingles[r.a] | shingles[r.b])} and 0 < len(found) < len(left)
