"""Scores, fits and the token cache against plain versions."""

import itertools
import math
import random
import re

import numpy as np

from weftgraph.llm import classifiers, ordinal, token_counts

TEXTS = ["", None, "Plain words, and MORE words.\nA line\nA line", "x", "ab", "é è the the THE " * 40, "word " * 3000, "Plain words, and MORE words.\nA line\nA line"]


def plain_word_columns(text):
    """Every run of letters (A-Z as a-z) and its beginnings, by a polynomial hash of its first 16 bytes."""
    out = set()
    for run in re.findall(rb"[A-Za-z\x80-\xff]+", text):
        low, h = run.lower(), 0
        for j in range(16):
            if j < len(low):
                h = (h + (low[j] + 1) * pow(0x100000001B3, j + 1, 1 << 64)) % (1 << 64)
            if j + 1 in ordinal.BEGINNINGS and (len(low) > j + 1 or j + 1 == 16):
                mixed = (h ^ (j + 1)) * 0xFF51AFD7ED558CCD % (1 << 64)
                out.add(((mixed ^ (mixed >> 32)) >> 7) % ordinal.WORDS)
    return out


def plain_grade(score, thresholds, grades):
    below = [0.0, *(1 / (1 + math.exp(-(t - score))) for t in thresholds), 1.0]
    p = [b - a for a, b in zip(below, below[1:])]
    return sum(x * g for x, g in zip(p, grades)), sum(x for x, g in zip(p, grades) if g >= 1.0)


def test_grades_are_weights_times_features(spark):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(TEXTS)], "doc_id long, text string, tail string")
    for features, score, width in ((ordinal.quality_features, ordinal.quality_score, ordinal.QUALITY_WIDTH), (ordinal.word_features, ordinal.word_score, ordinal.WORDS)):
        model = ordinal.OrdinalModel(np.array([0.0, 1.0, 2.0]), r.normal(size=width), np.array([-0.5, 0.8]))
        got = {x.doc_id: (x.expected, x.tail) for x in classifiers.grade_texts(df, model, score, 1.0).collect()}
        for i, t in enumerate(TEXTS):
            body = (t or "").encode()
            columns, values = features(body)
            if features is ordinal.word_features:
                assert set(columns.tolist()) == plain_word_columns(body)
            want = plain_grade(sum(float(model.weights[c]) * float(v) for c, v in zip(columns, values)), model.thresholds.tolist(), [0.0, 1.0, 2.0])
            assert all(math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9) for a, b in zip(got[i], want))
        assert got[2] == got[7]


def test_fit_comes_near_a_plain_search():
    """Of two columns and three grades: no point of a fine grid around the fit is likelier by much."""
    r = random.Random(1)
    rows, grades = [], []
    for _ in range(300):
        x = [r.random(), r.random()]
        z = 3 * x[0] - 2 * x[1] + math.log(1 / (r.random() + 1e-9) - 1)
        rows.append(x)
        grades.append(0.0 if z < -0.3 else 1.0 if z < 1.2 else 2.0)
    row, column = np.repeat(np.arange(300), 2), np.tile([5, 9], 300)
    model = ordinal.fit(row, column, np.array(rows).ravel(), np.array(grades), 12, l2=0.0, steps=400)

    def loss(w, t):
        total = 0.0
        for x, g in zip(rows, grades):
            s = w[0] * x[0] + w[1] * x[1]
            cut = [1.0 if k > 1 else 0.0 if k < 0 else 1 / (1 + math.exp(s - t[k])) for k in (int(g), int(g) - 1)]
            total -= math.log(max(cut[0] - cut[1], 1e-12))
        return total / len(rows)

    assert set(np.flatnonzero(model.weights)) == {5, 9}
    w, t = [model.weights[5], model.weights[9]], model.thresholds.tolist()
    best, step = [*w, *t], 0.5
    while step > 0.01:  # a plain search from the fit on
        moves = [[x + step * d for x, d in zip(best, m)] for m in itertools.product((-1, 0, 1), repeat=4)]
        least = min(moves, key=lambda p: loss(p[:2], p[2:]) if p[2] < p[3] else 99.0)
        if loss(least[:2], least[2:]) < loss(best[:2], best[2:]) - 1e-9:
            best = least
        else:
            step /= 2
    assert loss(w, t) - loss(best[:2], best[2:]) < 0.01


def test_a_second_run_with_the_cache_encodes_nothing(spark, tmp_path):
    import public_tokenizers

    cache = f"file://{tmp_path}/cache"
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    first = {x.doc_id: x.n_tokens for x in token_counts.cached_token_counts(df, path, cache).collect()}
    entries = spark.read.parquet(cache).count()
    assert entries == len({t or "" for t in TEXTS})
    again = {x.doc_id: x.n_tokens for x in token_counts.cached_token_counts(df, path, cache).collect()}
    assert again == first and spark.read.parquet(cache).count() == entries
    more = df.unionByName(spark.createDataFrame([(90, "something new")], "doc_id long, text string"))
    assert token_counts.cached_token_counts(more, path, cache).count() == len(TEXTS) + 1 and spark.read.parquet(cache).count() == entries + 1
