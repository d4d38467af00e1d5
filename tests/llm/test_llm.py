"""The llm operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftgraph.llm import chat, classifiers, decontaminate, language, mixing, ordinal, simhash, suffix_dedup, token_counts, topk

WORDS = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you".split()


def texts(n, seed=0, lo=5, hi=60):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS, int(rng.integers(lo, hi)))) for _ in range(n)]


def docs_of(spark, rows, extra=True):
    """doc_id and text, and columns whose names clash with what operators add."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"n_tokens": F.lit("x"), "size": F.lit("y"), "kept": F.lit(1), "digest": F.lit(2), "key": F.lit(3), "component_id": F.lit("z")}) if extra else df


# ---- 9 token counts ----------------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    bodies = [*texts(40), None, "", " ", "  a  b \n c", "a <|endoftext|> b", "word, word. 's it's\n\nX", "naïve café ñandú", "日本語 テスト  x", "x" * 30_000, "a  b", "a \0b", "\0b a", "\0", " <|endoftext|>word" * 60_000, *texts(3), *texts(3)]
    df = docs_of(spark, list(enumerate(bodies)))
    cache = f"file://{tmp_path}/cache"
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.cached_token_counts(df, path, cache).collect()}
    assert got == {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(bodies)}
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for t in bodies})
    token_counts.cached_token_counts(df, path, cache).collect()  # all known: nothing is added
    assert spark.read.parquet(cache).count() == stored.count()
    assert token_counts.cached_token_counts(df.limit(0), path, f"file://{tmp_path}/none").count() == 0


# ---- 8 decontamination ----------------------------------------------------------------------------------


def judge(docs, bench):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = {}
    for i, t in docs:
        w, hit, items = words(t), set(), set()
        for item, b in bench:
            v = words(b)
            if item is None or not v:
                continue
            for j in range(max(1, len(v) - 12)):
                win = v[j : j + 13]
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit.update(range(s, s + len(win)))
                        items.add(str(item))
        out[i] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontamination_equals_brute_force(spark, monkeypatch):
    bench = [(1, texts(1, 7, 20, 30)[0]), (2, "Short item"), (10, texts(1, 8, 14, 20)[0]), (2, "another one here"), (3, None), (4, "..."), (None, "the of and")]
    bodies = [*texts(30, 1), None, "", "?!", bench[0][1].upper(), "x " + bench[2][1] + " y", "a short-item; SHORT ITEM", " ".join(texts(300, 3)) + " " + bench[0][1]]
    rows = [*enumerate(bodies), (3, bodies[3])]
    want = judge(rows, bench)
    b = spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit(1))
    for limit in (decontaminate.SLICE_WORDS, 5):  # at once, and item by item
        monkeypatch.setattr(decontaminate, "SLICE_WORDS", limit)
        got = decontaminate.contamination(docs_of(spark, rows), b).collect()
        assert len(got) == len(rows) and all((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[r.doc_id] for r in got)
    assert decontaminate.contamination(docs_of(spark, rows), b.limit(0)).where("contaminated or n_hit > 0").count() == 0
    assert decontaminate.contamination(docs_of(spark, []), b).count() == 0


def test_phrase_and_proximity_search(spark):
    docs = [(1, "a b c d e a c b"), (2, "c d"), (3, None), (4, "b x x c"), (5, "b"), (6, "C, b x c d"), (7, "")]
    index = decontaminate.build_index(docs_of(spark, docs).coalesce(1))
    found = lambda phrase, slop: sorted((r.doc_id, r.start) for r in decontaminate.find_phrases(index, [(9, phrase), (8, b"zz a"), (7, b"")], slop).collect())
    assert found(b"b c", 0) == [(1, 1)] and found(b"C d", 0) == [(1, 2), (2, 0), (6, 3)]
    for phrase in (b"b c", b"c b", b"d c b", b"e a"):
        words = phrase.decode().split()
        count = Counter(w for _, t in docs for w in decontaminate.words_of((t or "").encode()))
        rare = min(range(len(words)), key=lambda i: count[words[i].encode()])
        for slop in (1, 2, 3):
            want = []
            for i, t in docs:
                w = [x.decode() for x in decontaminate.words_of((t or "").encode())]
                for p in range(len(w)):
                    s = p - rare
                    if w[p] == words[rare] and all(k == rare or words[k] in w[max(0, s + k - slop) : max(0, s + k + slop + 1)] for k in range(len(words))):
                        want.append((i, s))
            assert found(phrase, slop) == sorted(want), (phrase, slop)


def test_shards_of_few_words(spark):
    """Documents beyond a shard's words and shards of many documents are judged alike."""
    bench = [(1, texts(1, 7, 20, 30)[0])]
    rows = [(i, " ".join([*texts(1, 50 + i, 0, 9), bench[0][1], *texts(1, 90 + i, 0, 700)])) for i in range(9)]
    want = judge(rows, bench)
    index = decontaminate.build_index(docs_of(spark, rows).coalesce(1))
    assert index.count() == 1
    got = decontaminate.contamination(docs_of(spark, rows * 300).coalesce(1), spark.createDataFrame(bench, "item_id long, text string"))
    got = got.groupBy("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").count().collect()
    assert len(got) == 9 and all(r["count"] == 300 and (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[r.doc_id] for r in got)


# ---- 5 SimHash ------------------------------------------------------------------------------------------


def test_simhash_equals_brute_force(spark):
    base = texts(25, 2, 30, 80)
    rng = np.random.default_rng(0)
    near = []
    for t in base[:15]:
        for _ in range(4):
            w = t.split()
            w[int(rng.integers(len(w)))] = "zz"
            near.append(" ".join(w))
    rows = [(i * 3, t) for i, t in enumerate([*base, *near, *base[:5], None, "", " \n", "one", "Two Words", "one"])]
    rows += [(rows[4][0], rows[4][1]), (None, base[3])]
    prints = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        s = [b" ".join(w[j : j + 3]) for j in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        c = [sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in s) for b in range(64)]
        prints[i] = sum(1 << b for b in range(64) if 2 * c[b] > len(s))
    label = {p: p for p in prints.values()}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in label:
        for b in label:
            if a < b and bin(a ^ b).count("1") <= 3:
                label[root(a)] = root(b)
    least = {}
    for i, p in prints.items():
        if i is not None:
            least[root(p)] = min(i, least.get(root(p), i))
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all((r.w0 & (1 << 64) - 1, r.component_id) == (prints[r.doc_id], least[root(prints[r.doc_id])]) for r in got)
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("group", [2048, 4])
def test_links_of_dense_fingerprints(spark, group):
    rng = np.random.default_rng(1)
    prints = set()
    for b in rng.integers(0, 2**63, 12, dtype=np.uint64):
        for _ in range(30):
            x = int(b)
            for k in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(k)
            prints.add(x)
    prints = np.array(sorted(prints), np.uint64)
    df = spark.createDataFrame([(int(x), int(x)) for x in prints.view(np.int64)], "w0 long, node long")

    def parts(pairs):
        label = {int(x): int(x) for x in prints}

        def root(x):
            while label[x] != x:
                x = label[x]
            return x

        for a, b in pairs:
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
        return {x: root(x) for x in label}

    want = parts((int(prints[a]), int(prints[b])) for a in range(len(prints)) for b in range(a) if int(prints[a] ^ prints[b]).bit_count() <= 3)
    got = parts((r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.links(df, group=group).collect())
    assert got == want


# ---- 7 suffix dedup --------------------------------------------------------------------------------------


def removed(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(b[p : p + length])
        raw = np.frombuffer(b, np.uint8)
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(raw[~gone].tobytes()).hexdigest())
    return out


def odd_texts(n=90):
    rng = np.random.default_rng(0)
    pieces = [lambda: "ab" * int(rng.integers(1, 120)), lambda: "x" * int(rng.integers(1, 300)), lambda: "".join(map(chr, rng.integers(97, 100, int(rng.integers(1, 200))))), lambda: "".join(f"{j * j} " for j in range(int(rng.integers(1, 90)))), lambda: "é" * int(rng.integers(1, 90))]
    return [(i, "".join(pieces[int(rng.integers(5))]() for _ in range(int(rng.integers(0, 7)))) if i % 13 else None) for i in range(n)]


def test_repeats_equal_brute_force(spark):
    rows = odd_texts()
    rows.append((200, rows[5][1]))
    long = " ".join(texts(1, 5, 60_000, 60_001))  # longer than what is sketched at a time
    rows += [(300, long), (301, long[1000:250_000] + "!" + long[100_000:])]
    want = removed(rows, 100)
    for parts in (1, 5):
        df = docs_of(spark, [*rows, rows[7]]).repartition(parts)
        got = suffix_dedup.remove_repeats(df).collect()
        assert len(got) == len(rows) + 1 and all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in got)
    plain = df.select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    for most in (4, 40):  # groups dealt out again by longer texts and by windows
        crowded = {r.doc: sum(x & 0xFFFFFFFF for x in r.spans) for r in suffix_dedup.repeated_spans(plain, crowded=most).collect()}
        assert crowded == {i: w[1] for i, w in want.items() if w[1]}
    assert suffix_dedup.remove_repeats(docs_of(spark, [])).count() == 0
    few = suffix_dedup.remove_repeats(docs_of(spark, [(None, "ab" * 99), (None, "ab" * 99), (1, None), (2, "")])).collect()
    assert [r.n_removed for r in few] == [0] * 4


def test_crowded_passage_in_other_surroundings(spark):
    """One passage in many texts, each of its own surroundings, and windows that share 89 bytes but not 100."""
    rng = np.random.default_rng(1)
    passage = texts(1, 9, 60, 61)[0]
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    rows = [(i, word(int(rng.integers(0, 200))) + passage[int(rng.integers(0, 30)) :] + word(int(rng.integers(0, 12))) + "tail" * int(rng.integers(0, 40))) for i in range(120)]
    want = {i: w[1] for i, w in removed(rows, 100).items() if w[1]}
    plain = spark.createDataFrame(rows, "doc long, text string").repartition(4)
    for most in (3, 20, suffix_dedup.CROWDED):
        assert {r.doc: sum(x & 0xFFFFFFFF for x in r.spans) for r in suffix_dedup.repeated_spans(plain, crowded=most).collect()} == want


def test_merges_of_several_shards_decide(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    found = suffix_dedup.found_stretches(docs).groupBy("shards").agg(F.sum(F.col("end") - F.col("start")).alias("bytes")).collect()
    by = {r.shards: r.bytes for r in found}
    assert all(k is None or k >= 2 for k in by) and max(k for k in by if k) > 2 and sum(v for k, v in by.items() if k) > 0.3 * sum(by.values())


@pytest.mark.parametrize(("shard", "most"), [(64, 300), (500, 2000), (32 << 10, 256 << 10)])
def test_merge_equals_brute_force(monkeypatch, shard, most):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix_dedup, "MERGE_BYTES", most)
    rows = [(i, (t or "").encode()) for i, t in odd_texts(40)]
    bodies = [t for _, t in rows]
    windows = np.array([max(0, len(t) - 99) for t in bodies])
    doc, start, end, shards = suffix_dedup.repeated_windows(bodies, windows, np.arange(40), np.zeros(40, np.int64), 100)
    gone = Counter()
    for d, a, b in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True):
        gone[d] += b - a
    assert gone == {i: w[1] for i, w in removed([(i, t.decode()) for i, t in rows], 100).items() if w[1]} and shards >= 2


def test_common_prefixes_of_merged_transforms():
    rng = np.random.default_rng(4)
    bodies = [bytes(rng.integers(97, 99, 60).astype(np.uint8)) for _ in range(6)]
    shards, _, _ = suffix_dedup.shards_of(bodies)
    for depth in (5, 8, 1, 100):
        rounds = -(-depth // min(depth, 31))  # two symbols and the end take two bits
        step = -(-depth // rounds)
        merged, common = suffix_dedup.merge_transforms(shards, depth)
        ahead = np.concatenate([np.stack([np.roll(s, -i) for i in range(depth)], 1) for s in shards])
        prefix = [ahead[p].tobytes() for p in merged]
        assert prefix == sorted(prefix) and sorted(merged) == list(range(len(merged)))
        for i in range(1, len(prefix)):
            same = next((k for k in range(depth) if prefix[i][k] != prefix[i - 1][k]), depth)
            assert common[i] == (same if same == depth else same // step * step)


def test_a_merge_of_many_symbols_takes_few_rounds(monkeypatch):
    """Finding 2, op7_suffix_dedup: words of a round that don't fit a number are named by doubling, so 100 symbols of seven bits take four rounds."""
    rng = np.random.default_rng(8)
    base = bytes(rng.integers(32, 127, 300).astype(np.uint8))
    bodies = [base[:170], base[130:], *(bytes(rng.integers(32, 127, 160).astype(np.uint8)) for _ in range(8)), base[40:200], b"ab" * 90, b"ab" * 60]
    rounds, stable = [], suffix_dedup._stable
    monkeypatch.setattr(suffix_dedup, "_stable", lambda x: (rounds.append(1), stable(x))[1])
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 400)
    shards, _, _ = suffix_dedup.shards_of(bodies)
    for depth, least in ((100, 4), (90, 4), (7, 1), (33, 4)):
        rounds.clear()
        merged, common = suffix_dedup.merge_transforms(shards, depth)
        ahead = np.concatenate([np.stack([np.roll(s, -i) for i in range(depth)], 1) for s in shards])
        prefix = [ahead[p].tobytes() for p in merged]
        assert len(shards) > 2 and len(rounds) <= least
        assert prefix == sorted(prefix) and sorted(merged) == list(range(len(merged)))
        assert [int(x) == depth for x in common[1:]] == [a == b for a, b in zip(prefix, prefix[1:], strict=False)]
    for wide in (1, 62):  # keys that leave room for the place, and keys that don't
        key = np.concatenate([rng.integers(0, 1 << wide, 50), np.full(10, (1 << wide) - 1)])
        order, rank = suffix_dedup._ranked(key, np.int64(6))
        assert (np.diff(key[order]) >= 0).all() and (rank == np.unique(key, return_inverse=True)[1]).all()


# ---- 4 mixing --------------------------------------------------------------------------------------------


def test_mix_hits_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FLIGHT", 60)
    rng = np.random.default_rng(2)
    rows = [(i, None if s == 4 else f"s{s}", int(n)) for i, (s, n) in enumerate(zip(rng.choice(5, 900, p=[0.5, 0.2, 0.2, 0.05, 0.05]), rng.integers(0, 200, 900), strict=True))]
    rows += [(1, rows[1][1], rows[1][2]), (5000, "empty", 0), (None, "s1", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumns({x: F.lit("x") for x in ("target", "order", "base", "share", "left", "n_docs", "flight", "__source")})
    first = mixing.mix(df.repartition(3)).collect()
    assert sorted((str(r.doc_id), r.size, r.copies) for r in first) == sorted((str(r.doc_id), r.size, r.copies) for r in mixing.mix(df.repartition(7)).collect())
    sums = Counter()
    for _, s, n in rows:
        sums[s] += n or 0
    names = [*sorted(s for s in sums if s), None]
    level, weight = 0.0, {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    for _ in range(20):
        fixed = [s for s in names if weight[s] * level > 3 * sums[s]]
        free = sum(weight[s] for s in names if s not in fixed)
        level = (sum(sums.values()) - sum(3 * sums[s] for s in fixed)) / free
    taken = Counter()
    for r in first:
        taken[r.source] += r.copies * r.size
        assert 0 <= r.copies <= 3 and r.target == pytest.approx(min(weight[r.source] * level, 3 * sums[r.source]))
    for r in first:
        assert abs(taken[r.source] - r.target) <= max(3, 0.01 * r.target)
    assert mixing.mix(df.limit(0)).count() == 0


def test_flight_keeps_totals():
    rng = np.random.default_rng(3)
    share, size = np.full(500, 0.37), rng.integers(1, 100, 500).astype(float)
    out = mixing.flight(share, size, rng)
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
    assert out.sum() == pytest.approx(share.sum()) and out @ size == pytest.approx(share @ size)


# ---- 3 top-k ---------------------------------------------------------------------------------------------


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BYTES", 200)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(330)]
    rows += [(400, None), (500, [1.0, None, 2.0, 3.0, 4.0]), (600, [float("nan")] * 5), (None, [1.0] * 5), (700, [1.0, 2.0]), (701, [1.0, 2.0]), (800, rows[100][1]), (801, rows[100][1]), (802, rows[100][1]), rows[200], (900, [1e20, 1.0, 1.0, 1.0, 1.0]), (1000, [None, 1.0, 1.0, 1.0, 1.0]), (1000, [0.5] * 5), (1000, [float("nan"), 1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).repartition(5)
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            vectors[i] = [int(np.floor(1024 * float(np.float32(x)))) for x in v]
    want = {}
    for q in vectors:
        if q % 100 == 0:
            scored = [(-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(vectors[q], v, strict=True)))), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])]
            want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(sorted(scored)[:10])]
    got = {}
    for r in topk.exact_topk(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: sorted(x) for q, x in got.items()} == want
    assert topk.exact_topk(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# ---- 1 and 10 classifiers ---------------------------------------------------------------------------------


def test_quality_and_toxicity_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").withColumn("expected", F.lit("x"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    known, hidden = labels.where("doc_id % 3 != 0"), labels.where("doc_id % 3 = 0")
    graded = classifiers.quality(docs, known).join(hidden, "doc_id").agg(F.avg((F.col("keep") == (F.col("quality") == 1)).cast("int")), F.count("*")).first()
    assert graded[1] > 50 and graded[0] > 0.93
    model = classifiers.fit_toxicity(docs, known)
    toxic = classifiers.grade_texts(docs, model, ordinal.word_score, 1.0).join(hidden, "doc_id")
    assert toxic.agg(F.avg(((F.col("tail") >= 0.5) == (F.col("toxic") == 1)).cast("int"))).first()[0] > 0.92


def test_classifier_edges(spark):
    rows = [(1, None), (2, ""), (2, ""), (3, "x" * 2_500_000), (None, "abc")]
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    got = classifiers.quality(docs_of(spark, rows), labels)
    assert got.count() == 5 and got.where("keep").count() == 5  # one grade only: nothing to judge by
    assert classifiers.quality(docs_of(spark, []), labels.limit(0)).count() == 0
    assert ordinal.word_score(b"idiot " * 400_000, np.ones(ordinal.WORDS)) == pytest.approx(len(np.unique(ordinal.word_columns(b"idiot"))))


def test_ordered_thresholds_with_three_grades():
    rng = np.random.default_rng(0)
    x = rng.normal(size=900)
    grade = np.digitize(x + 0.3 * rng.normal(size=900), [-0.7, 0.6])
    model = ordinal.fit(np.arange(900), np.zeros(900, int), x, grade, 1)
    assert model.thresholds[0] < model.thresholds[1] and model.weights[0] > 0
    assert np.abs(model.expected(x * model.weights[0]) - grade).mean() < 0.35
    assert model.probabilities(np.zeros(1)).sum() == pytest.approx(1)


# ---- 2 language and 6 chat --------------------------------------------------------------------------------


def test_language_evidence(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    odd = spark.createDataFrame([(9001, None, None), (9002, "not a url", ""), (9003, "http://x.example.de/de/", '<html lang="de"></html>'), (9003, "http://x.example.de/de/", '<html lang="de"></html>')], "page_id long, url string, html string")
    both = pages.select("page_id", "url", "html").unionByName(odd).withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in language.identify(both, docs).collect()}
    assert len(got) == pages.count() + 3 and got[9003].language == "de" and got[9001].language is not None
    declared = [r for r in got.values() if r.page_id < 9000 and r.declared]
    assert np.mean([r.language == r.declared for r in declared]) > 0.95
    assert language.identify(both.limit(0), docs).count() == 0
    assert language.identify(both, docs.limit(0)).where("language is null").count() == both.count()


def test_chat_roles_and_blocks(spark, monkeypatch):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(7777, i, "user" if i % 2 == 0 else "assistant", f"line {i}\nmore") for i in range(900)] + [(8888, None, None, None), (None, 0, "user", "hi"), (8889, 0, "strange", "")], "conv_id long, turn long, role string, text string")
    lines = chat.line_features(chat.transcript_lines(turns.unionByName(extra).withColumn("state", F.lit("x")))).cache()
    model = chat.fit_chat(lines)
    found = {(r.conv_id, r.turn, r.line): r.state for r in chat.decode(lines, model).collect()}
    assert len(found) == lines.count()
    monkeypatch.setattr(chat, "BLOCK_TURNS", 7)  # blocks side by side give what one long run gives
    assert {(r.conv_id, r.turn, r.line): r.state for r in chat.decode(lines, model).collect()} == found
    out = chat.canonical_turns(chat.decode(lines, model)).where("true_role is not null")
    assert out.agg(F.avg((F.col("role") == F.col("true_role")).cast("int"))).first()[0] > 0.85
    assert out.where("not rendered rlike '^<.(system|user|assistant).>\\\\n'").count() == 0
