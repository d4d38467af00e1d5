"""Candidates hashed and paired in the tasks, and alignments summed there: against the joins."""

import random

import numpy as np
from pyspark.sql import functions as F

from weftgraph.operators import alignment as A
from weftgraph.operators import lowhash as L
from weftgraph.storage import collected


def _docs(spark):
    draw = random.Random(5)
    lines = [" ".join(draw.choice("abcdefgh") for _ in range(7)) for _ in range(12)]
    texts = [("  " if i % 5 == 0 else "") + "\t ".join([draw.choice(lines) for _ in range(3)] + ["X%d y\n z %d q" % (i, i % 3)]) for i in range(60)]
    return spark.createDataFrame([*enumerate(texts), (60, None), (61, "a b"), (None, texts[0]), (None, texts[1]), (3, texts[3])], "doc_id long, text string")


def test_candidates_equal_the_joins_and_write_no_table(spark, monkeypatch):
    docs = _docs(spark)
    rows = lambda df: sorted(map(tuple, df.select("r0", "r1", "same_strand", "hits").collect()))
    for gathered in (1 << 20, 16):  # 16: many sendings of a task, each cut at the bound of a bucket
        monkeypatch.setattr(L, "GATHERED", gathered)
        for stranded in (False, True):
            for options in (L.LowHashOptions(hash_fraction=0.1), L.LowHashOptions(hash_fraction=0.3, max_bucket=4, min_bucket=3, iterations=5)):
                hashes = L.low_hashes(L.word_features(docs, 4), options)
                joined = L._pairs(hashes, options, stranded).groupBy("r0", "r1", "same_strand").agg(F.count("*").alias("hits")).where(F.col("hits") >= 2)
                with collected() as written:
                    got = rows(L.candidates(L.word_texts(docs), options, stranded=stranded))
                assert got == rows(joined) == rows(L.candidates(L.word_features(docs, 4), options, stranded=stranded))
                assert not written
    many = L.LowHashOptions(hash_fraction=0.05, iterations=70)
    assert rows(L.candidates(L.word_texts(docs), many)) == rows(L.candidates(L.word_features(docs, 4), many))


def test_a_hash_of_features_low_in_unlike_iterations():
    hashes, bits = np.array([1, 1, 1, 1, 2, 2]), np.array([0b01, 0b11, 0b10, 0b11, 0b101, 0b101])
    hits = {}
    for x, y, n in L._hits(hashes, bits, np.arange(6), 2, 2):
        for a, b, k in zip(x.tolist(), y.tolist(), n.tolist(), strict=True):
            hits[a, b] = hits.get((a, b), 0) + k
    assert hits == {(4, 5): 2}  # of hash 1, either iteration has three entries
    hits = sum(int(n.sum()) for _, _, n in L._hits(hashes, bits, np.arange(6), 2, 3))
    assert hits == 2 * 3 + 2


def test_summed_alignments_are_one_row_a_pair(spark):
    docs = _docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    found = L.candidates(L.word_texts(docs), L.LowHashOptions(hash_fraction=0.3, max_bucket=30))
    lists = L.word_sequences(docs)
    rows = lambda df: sorted(map(tuple, df.collect()))
    info = A.alignment_metrics(A.matched_markers(found, lists, 1, chain=True, summed=True))
    chains = A.alignment_metrics(A.matched_markers(found, lists, 1, chain=True))
    assert info.schema.simpleString() == chains.schema.simpleString()
    assert len(rows(info)) > 20 and rows(info) == rows(chains)
    short = A.AlignOptions(method=1)
    assert rows(A.alignment_metrics(A.compute_alignments(found, lists, short, summed=True))) == rows(A.alignment_metrics(A.compute_alignments(found, lists, short)))
