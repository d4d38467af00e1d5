"""Cumulative-link ordinal regression on hashed text features, shared by quality (1) and toxicity (10)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import as_bytes, bound_batches

#: Features of a text: (columns, values), columns below a fixed number.
Features = Callable[[bytes], tuple[np.ndarray, np.ndarray]]


@dataclass
class OrdinalModel:
    """P(grade <= grades[k]) = sigmoid(thresholds[k] - w.x): one weight vector for all ordered thresholds."""

    grades: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """(rows, grades): the probability of each grade."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))
        below = np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], 1)
        return np.diff(below, axis=1)

    def expected(self, score: np.ndarray) -> np.ndarray:
        return self.probabilities(score) @ self.grades

    def tail(self, score: np.ndarray, grade: float) -> np.ndarray:
        """P(grade at least `grade`)."""
        return self.probabilities(score)[:, self.grades >= grade].sum(1)


def fit(row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, width: int, *, l1: float = 0.0, l2: float = 1e-4, rising: bool = False, steps: int = 150, rate: float = 0.3) -> OrdinalModel:
    """Fit by full-batch Adam with a proximal step for `l1`; `rising` allows weights that raise the grade only.

    Thresholds are a first one and positive gaps, so they stay ordered. With no rows or one grade only, the weights
    are zero and the thresholds follow the grades seen. A column that no row has keeps the weight zero, so only the
    others are fitted.
    """
    grades, y = np.unique(grade.astype(float), return_inverse=True)
    k, n = len(grades), len(grade)
    if k < 2:
        return OrdinalModel(grades if k else np.zeros(1), np.zeros(width), np.zeros(0))
    used, column = np.unique(column, return_inverse=True)
    whole, width = np.zeros(width), len(used)
    weights = np.zeros(width)
    share = np.cumsum(np.bincount(y, minlength=k))[:-1] / n
    thresholds = np.log(share / (1 - share))
    free = np.concatenate([thresholds[:1], np.log(np.maximum(np.diff(thresholds), 1e-3))])
    m_w, v_w, m_t, v_t = np.zeros(width), np.zeros(width), np.zeros(k - 1), np.zeros(k - 1)
    for step in range(1, steps + 1):
        thresholds = free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])
        score = np.bincount(row, weights[column] * value, minlength=n)
        upper = np.where(y < k - 1, thresholds[np.minimum(y, k - 2)] - score, 60.0)
        lower = np.where(y > 0, thresholds[np.maximum(y - 1, 0)] - score, -60.0)
        s_up, s_low = 1 / (1 + np.exp(-np.clip(upper, -60, 60))), 1 / (1 + np.exp(-np.clip(lower, -60, 60)))
        mass = np.maximum(s_up - s_low, 1e-12)
        d_up, d_low = s_up * (1 - s_up) / mass, s_low * (1 - s_low) / mass
        g_score = (d_up - d_low) / n  # of the negative log-likelihood
        g_w = np.bincount(column, g_score[row] * value, minlength=width) + l2 * weights
        g_th = np.zeros(k - 1)
        np.add.at(g_th, y[y < k - 1], -d_up[y < k - 1] / n)
        np.add.at(g_th, y[y > 0] - 1, d_low[y > 0] / n)
        g_t = np.cumsum(g_th[::-1])[::-1].copy()
        g_t[1:] *= np.exp(free[1:])
        lr = rate / (1 + 3 * step / steps)
        m_w, v_w = 0.9 * m_w + 0.1 * g_w, 0.999 * v_w + 0.001 * g_w * g_w
        m_t, v_t = 0.9 * m_t + 0.1 * g_t, 0.999 * v_t + 0.001 * g_t * g_t
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        scale = np.sqrt(v_w / c2) + 1e-8
        weights = weights - lr * (m_w / c1) / scale
        if l1:
            weights = np.sign(weights) * np.maximum(np.abs(weights) - lr * l1 / np.maximum(scale, 1e-6), 0)
        if rising:
            weights = np.maximum(weights, 0)
        free = free - 0.3 * lr * (m_t / c1) / (np.sqrt(v_t / c2) + 1e-8)
    whole[used] = weights
    return OrdinalModel(grades, whole, free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))]))


def labelled_sample(docs: DataFrame, labels: DataFrame, grade: str, rows: int, features: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of at most `rows` labelled documents, those of least hash: (row, column, value, grade).

    The labels chosen are few by that bound, so they go to every task and the documents aren't shuffled;
    what returns is features, not texts.
    """
    bound_batches(docs.sparkSession)
    chosen = (
        labels.select("doc_id", F.col(grade).cast("double").alias("grade")).where("doc_id is not null and grade is not null")
        .groupBy("doc_id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x) for x in as_bytes(batch.column("text"))]
            columns = [pa.array([x.astype(np.int32).tobytes() for x, _ in found], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), *columns], ["doc_id", "grade", "columns", "values"])

    got = picked.mapInArrow(run, "doc_id long, grade double, columns binary, values binary").toArrow().sort_by("doc_id")
    columns = [np.frombuffer(x, np.int32) for x in got.column("columns").to_pylist()]
    values = [np.frombuffer(x, np.float32) for x in got.column("values").to_pylist()]
    if not columns:
        none = np.zeros(0)
        return none.astype(int), none.astype(int), none, none
    row = np.repeat(np.arange(len(columns)), [len(x) for x in columns])
    return row, np.concatenate(columns).astype(np.int64), np.concatenate(values).astype(float), got.column("grade").to_numpy()


# ---- Features ------------------------------------------------------------------------------------

#: Hashed byte trigrams, then one-hot shape buckets.
TRIGRAMS = 1 << 14
BUCKETS = 12
SHAPES = ("upper words", "marks", "repeated words", "distinct words", "distinct lines", "words")
QUALITY_WIDTH = TRIGRAMS + BUCKETS * len(SHAPES)
#: A text's trigram shares add up to this, beside one for each shape.
TRIGRAM_SCALE = 20.0
#: Bytes of a text that are hashed at a time.
PIECE = 1 << 20
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def trigrams(text: bytes) -> Iterator[np.ndarray]:
    """Hashed columns of all byte trigrams, piece by piece."""
    for at in range(0, max(0, len(text) - 2), PIECE):
        b = np.frombuffer(text, np.uint8)[at : at + PIECE + 2].astype(np.uint32)
        h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
        yield (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(18)


def shape_columns(text: bytes) -> np.ndarray:
    """One column of each shape: a text's ratio, cut into BUCKETS."""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    last = iter(words)
    next(last, None)
    ratios = [
        sum(map(bytes.isupper, words)) / max(1, n),
        float(_MARK[np.frombuffer(text, np.uint8)].sum()) / max(1, len(text)) * 3,
        sum(map(eq, words, last)) / max(1, n - 1),
        len(set(words)) / max(1, n),
        len(set(lines)) / max(1, len(lines)),
        min(1.0, np.log2(1 + n) / 14),
    ]
    return TRIGRAMS + np.arange(len(ratios)) * BUCKETS + np.array([min(BUCKETS - 1, int(r * BUCKETS)) for r in ratios])


def quality_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    counts = np.zeros(TRIGRAMS, np.int64)
    for piece in trigrams(text):
        counts += np.bincount(piece, minlength=TRIGRAMS)
    used = np.flatnonzero(counts)
    shapes = shape_columns(text)
    return np.concatenate([used, shapes]), np.concatenate([counts[used] * (TRIGRAM_SCALE / max(1, len(text) - 2)), np.ones(len(shapes))])


def quality_score(text: bytes, weights: np.ndarray) -> float:
    """w.x of quality_features, without building them."""
    total = sum(float(weights[piece].sum()) for piece in trigrams(text))
    return total * TRIGRAM_SCALE / max(1, len(text) - 2) + float(weights[shape_columns(text)].sum())


#: Hashed words and word beginnings, each counted once a text.
WORDS = 1 << 20
BEGINNINGS = (4, 5, 6, 7, 8, 16)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint64)
_POWERS = np.array([pow(0x100000001B3, j + 1, 1 << 64) for j in range(16)], np.uint64)  # the 64-bit FNV prime's powers


def word_columns(text: bytes) -> np.ndarray:
    """Hashed columns of all words (runs of letters, A-Z as a-z) and of their first 4 to 8 bytes, with repeats."""
    out = []
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):  # cut between words
            space = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end))
            end = space if space > at else end
        raw = np.frombuffer(text, np.uint8)[at:end]
        at = end
        letter = _LETTER[raw]
        edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
        begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(begin):
            continue
        size = stop - begin
        low = np.concatenate([_LOWER[raw], np.zeros(16, np.uint64)])
        h = np.zeros(len(begin), np.uint64)
        for j in range(16):
            here = j < size
            h += np.where(here, (low[begin + j] + np.uint64(1)) * _POWERS[j], np.uint64(0))
            if j + 1 in BEGINNINGS:
                long = size > j + 1 if j + 1 < 16 else np.ones(len(size), bool)  # the last is the word itself
                mixed = (h[long] ^ np.uint64(j + 1)) * np.uint64(0xFF51AFD7ED558CCD)
                out.append(((mixed ^ (mixed >> np.uint64(32))) >> np.uint64(7)) & np.uint64(WORDS - 1))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def word_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    used = np.unique(word_columns(text))
    return used, np.ones(len(used))


def word_score(text: bytes, weights: np.ndarray) -> float:
    columns = word_columns(text)
    return float(weights[np.unique(columns[weights[columns] != 0])].sum())
