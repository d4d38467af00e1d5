"""Candidate pairs by low hashes of consecutive markers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.operators.kmers import stable_hash
from weftgraph.shipping import ship
from weftgraph.storage import discard, materialize, small_enough


@dataclass(frozen=True)
class LowHashOptions:
    """Defaults of the candidate search."""

    m: int = 4
    hash_fraction: float = 0.01
    iterations: int = 10
    min_bucket: int = 0
    max_bucket: int = 10
    min_frequency: int = 2
    candidates_per_read: float = 20.0


def word_markers(docs: DataFrame) -> DataFrame:
    """Documents as marker sequences: (oriented_id, ordinal, kmer) of their lower-cased words, on one strand."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != "")
    return docs.select(F.col("doc_id").alias("oriented_id"), F.posexplode(words).alias("ordinal", "kmer"))


def word_sequences(docs: DataFrame) -> DataFrame:
    """(oriented_id, seq): word_markers() with each document's words as one text, which alignments cut where they read it."""
    return word_texts(docs).withColumnRenamed("text", "seq")


def word_texts(docs: DataFrame) -> DataFrame:
    """(oriented_id, text): lower-cased documents whose words candidates() cuts itself, where it hashes them."""
    return docs.select(F.col("doc_id").alias("oriented_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))


def word_features(docs: DataFrame, m: int) -> DataFrame:
    """features() of word_markers(), cut within each document's row, so that no word is shuffled."""
    return features(word_texts(docs), m)


def _text_features(texts: DataFrame, m: int) -> DataFrame:
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    rows = texts.select("oriented_id", words.alias("words")).where(F.size("words") >= m)
    grams = F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))
    return rows.select("oriented_id", F.posexplode(grams).alias("ordinal", "feature"))


def features(markers: DataFrame, m: int) -> DataFrame:
    """(oriented_id, ordinal, feature): every m consecutive markers, joined by spaces. Rows that have a feature pass through, word_texts() are cut."""
    if "feature" in markers.columns:
        return markers
    if "text" in markers.columns:
        return _text_features(markers, m)
    order = Window.partitionBy("oriented_id").orderBy("ordinal")
    parts = [F.col("kmer"), *(F.lead("kmer", i).over(order) for i in range(1, m))]
    found = markers.select("oriented_id", "ordinal", F.when(parts[-1].isNotNull(), F.concat_ws(" ", *parts)).alias("feature"))
    return found.where("feature is not null")


def low_hashes(feats: DataFrame, options: LowHashOptions, iterations: list[int] | None = None) -> DataFrame:
    """(iteration, oriented_id, ordinal, feature, hash) of features that are low in an iteration.

    A feature has one digest for TURNS iterations: iteration i draws first + i * second of the digest's two numbers of 52 bits,
    so only iterations that keep a feature become rows.
    """
    turns = list(range(options.iterations)) if iterations is None else iterations
    low = []
    for block in sorted({x // TURNS for x in turns}):
        digest = F.md5((F.concat(F.lit(f"{block}|"), F.col("feature")) if block else F.col("feature")).cast("binary"))
        # an array of one struct, so that the digest is taken once for all iterations
        drawn = F.array(F.struct(*(F.conv(F.substring(digest, at, 13), 16, 10).cast("long").alias(x) for at, x in ((1, "first"), (14, "second")))))
        here = F.array(*(F.lit(x) for x in turns if x // TURNS == block))
        low.append(F.transform(drawn, lambda d: F.filter(here, lambda i: draw(d["first"], d["second"], i) < int(options.hash_fraction * DRAWS)))[0])  # noqa: B023
    found = feats.withColumn("iteration", F.explode(F.concat(*low)))
    return found.select("iteration", "oriented_id", "ordinal", "feature", stable_hash(F.col("feature")).alias("hash"))


#: Iterations of candidates_until() that run in one round: rounds grow with the logarithm of the iterations up to there.
MOST_AT_ONCE = 512

#: Iterations that share a feature's digest, and the range of the numbers drawn from it.
TURNS, DRAWS = 1000, 16**13


def draw(first, second, iteration):
    """The number that an iteration draws from a feature's digest, of columns or of plain numbers."""
    return (first + (iteration % TURNS) * second) % DRAWS


def bucket_sizes(hashes: DataFrame) -> DataFrame:
    """(iteration, hash, size): entries of each bucket; repeats within a read count."""
    return hashes.groupBy("iteration", "hash").agg(F.count("*").alias("size"))


def _usable(hashes: DataFrame, options: LowHashOptions) -> DataFrame:
    """Entries of buckets within the size bounds. The bounds come before the self-join and keep it linear in the entries."""
    sizes = bucket_sizes(hashes).where(F.col("size").between(max(2, options.min_bucket), options.max_bucket))
    return hashes.join(sizes, ["iteration", "hash"])


def _pairs(hashes: DataFrame, options: LowHashOptions, stranded: bool) -> DataFrame:
    used = _usable(hashes, options)
    left = used.select("iteration", "hash", F.col("oriented_id").alias("u0"), F.col("ordinal").alias("o0"))
    right = used.select("iteration", "hash", F.col("oriented_id").alias("u1"), F.col("ordinal").alias("o1"))
    both = left.join(right, ["iteration", "hash"])
    if stranded:
        both = both.withColumns({"r0": F.floor(F.col("u0") / 2), "r1": F.floor(F.col("u1") / 2), "same_strand": F.col("u0") % 2 == F.col("u1") % 2})
    else:
        both = both.withColumns({"r0": F.col("u0"), "r1": F.col("u1"), "same_strand": F.lit(True)})
    return both.where("r0 < r1")


try:
    from _md5 import md5 as _md5
except ImportError:  # a Python without its own MD5
    from hashlib import md5 as _md5

#: Low hashes that a task gathers before they go out, and pairs that it makes at a time.
GATHERED, PAIRED = 1 << 20, 1 << 20
_LOW_ROWS = "hash long, turns long, oriented_id long"
_LOW_SCHEMA = pa.schema([("hash", pa.int64()), ("turns", pa.int64()), ("oriented_id", pa.int64())])


def _gram_digests(text: bytes, m: int) -> bytes:
    """MD5 digests of every m consecutive words of a text, one behind the other."""
    words = text.split()
    if len(words) < m:
        return b""
    whole = b" ".join(words)
    ends = list(accumulate([len(x) + 1 for x in words]))
    return b"".join([_md5(whole[i : j - 1]).digest() for i, j in zip([0, *ends], ends[m - 1 :], strict=False)])


def _low_turns(digests: bytes, turns: list[int], low: int) -> tuple[np.ndarray, np.ndarray]:
    """stable_hash() of features by their digests, and the iterations of the block 0 in which each is low, as bits by their place in `turns`."""
    words = np.frombuffer(digests, ">u8").reshape(-1, 2).astype(np.uint64)
    first, second = words[:, 0] >> np.uint64(12), (words[:, 0] & np.uint64(0xFFF)) << np.uint64(40) | words[:, 1] >> np.uint64(24)
    bits = np.zeros(len(words), np.int64)
    for k, i in enumerate(turns):
        bits |= (draw(first, second, np.uint64(i)) < np.uint64(low)).astype(np.int64) << np.int64(k)
    return (words[:, 0] >> np.uint64(4)).astype(np.int64), bits


def _low_rows(markers: DataFrame, options: LowHashOptions) -> DataFrame:
    """(hash, turns, oriented_id): a row for every feature that is low in an iteration, with these iterations as bits.

    Of equal (hash, turns) a task sends at most max_bucket + 1 of those it has gathered: they fill a bucket beyond its bound, and
    such a bucket is left out whatever it holds.
    """
    ship(markers.sparkSession)
    m, turns, low, most = options.m, list(range(options.iterations)), int(options.hash_fraction * DRAWS), options.max_bucket + 1
    rows = markers.select("oriented_id", "text") if "text" in markers.columns else features(markers, m).select("oriented_id", F.col("feature").alias("text"))
    whole = "text" in markers.columns

    def gathered(parts: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> pa.RecordBatch:
        hashes, bits = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
        order = np.lexsort((bits, hashes))
        hashes, bits = hashes[order], bits[order]
        begins = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (bits[1:] != bits[:-1])]))
        nth = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
        keep = nth < most
        ids = pa.concat_arrays([x[2] for x in parts]).take(pa.array(order[keep]))
        return pa.RecordBatch.from_arrays([pa.array(hashes[keep]), pa.array(bits[keep]), ids], schema=_LOW_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        held = 0
        for batch in batches:
            texts, ids = batch.column("text").cast(pa.binary()).to_pylist(), batch.column("oriented_id")
            at = 0
            while at < len(texts):  # so many texts at a time that their digests stay few
                digests, counts, size = [], [], 0
                while at + len(counts) < len(texts) and size < 1 << 22:
                    x = texts[at + len(counts)]
                    digests.append(_gram_digests(x, m) if whole else _md5(x).digest())
                    size += len(digests[-1])
                    counts.append(len(digests[-1]) // 16)
                hashes, bits = _low_turns(b"".join(digests), turns, low)
                kept = np.flatnonzero(bits)
                rows = np.repeat(np.arange(at, at + len(counts)), counts)[kept]
                parts.append((hashes[kept], bits[kept], ids.take(pa.array(rows))))
                held += len(kept)
                at += len(counts)
                if held >= GATHERED:
                    yield gathered(parts)
                    parts, held = [], 0
        if held:
            yield gathered(parts)

    return rows.select(F.col("oriented_id").cast("long").alias("oriented_id"), "text").mapInArrow(run, _LOW_ROWS)


def _meeting(owner: np.ndarray, bits: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(owner, owner, iterations) of all two entries of a group, for groups of equal bits that begin at `begins`."""
    for n in np.unique(sizes[sizes > 1]).tolist():
        x, y = np.triu_indices(n, 1)
        starts = begins[sizes == n]
        step = max(1, PAIRED // len(x))
        for part in (starts[i : i + step] for i in range(0, len(starts), step)):
            yield owner[(part[:, None] + x).ravel()], owner[(part[:, None] + y).ravel()], np.repeat(np.bitwise_count(bits[part]).astype(np.int64), len(x))


def _hits(hashes: np.ndarray, bits: np.ndarray, owner: np.ndarray, least: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """_meeting() of whole buckets: entries come sorted by hash. Where features of one hash are low in unlike iterations, each iteration is a group of its own."""
    begins = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    sizes = np.diff(np.append(begins, len(hashes)))
    mixed = np.bitwise_or.reduceat(bits, begins) != np.bitwise_and.reduceat(bits, begins)
    good = ~mixed & (sizes >= least) & (sizes <= most)
    yield from _meeting(owner, bits, begins[good], sizes[good])
    for b, n in zip(begins[mixed].tolist(), sizes[mixed].tolist(), strict=True):
        for k in range(int(np.bitwise_or.reduce(bits[b : b + n])).bit_length()):
            own = owner[b : b + n][bits[b : b + n] >> k & 1 == 1]
            if least <= len(own) <= most:
                yield from _meeting(own, np.ones(len(own), np.int64), np.zeros(1, np.int64), np.array([len(own)]))


def _low_pairs(rows: DataFrame, options: LowHashOptions, stranded: bool) -> DataFrame:
    """(r0, r1, same_strand, hits) of _low_rows(), dealt and sorted by hash; a task sums the hits of the pairs it makes at a time."""
    least, most = max(2, options.min_bucket), options.max_bucket

    def made(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        ids, hashes, bits = table.column("oriented_id").combine_chunks(), table.column("hash").to_numpy(), table.column("turns").to_numpy()
        owner = ids.fill_null(0).to_numpy() if ids.null_count else ids.to_numpy()
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        for x, y, n in _hits(hashes, bits, np.arange(len(owner)), least, most):
            keep = known[x] & known[y]
            u, v, n = owner[x[keep]], owner[y[keep]], n[keep]
            r0, r1 = (u >> 1, v >> 1) if stranded else (u, v)
            same = (u & 1) == (v & 1) if stranded else np.ones(len(u), bool)
            apart = r0 != r1
            r0, r1, same, n = np.minimum(r0, r1)[apart], np.maximum(r0, r1)[apart], same[apart], n[apart]
            order = np.lexsort((same, r1, r0))
            r0, r1, same, n = r0[order], r1[order], same[order], n[order]
            if len(n):
                first = np.flatnonzero(np.concatenate([[True], (r0[1:] != r0[:-1]) | (r1[1:] != r1[:-1]) | (same[1:] != same[:-1])]))
                yield pa.RecordBatch.from_arrays([pa.array(r0[first]), pa.array(r1[first]), pa.array(same[first]), pa.array(np.add.reduceat(n, first))], names=["r0", "r1", "same_strand", "hits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            rest.append(batch)
            held += batch.num_rows
            if held >= GATHERED >> 2:
                table = pa.Table.from_batches(rest)
                keys = table.column("hash").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))  # the last hash may go on
                if cut:
                    yield from made(table.slice(0, cut))
                rest = table.slice(cut).to_batches()
                held = len(keys) - cut
        if held:
            yield from made(pa.Table.from_batches(rest))

    return rows.repartition("hash").sortWithinPartitions("hash").mapInArrow(run, "r0 long, r1 long, same_strand boolean, hits long")


def candidates(markers: DataFrame, options: LowHashOptions = LowHashOptions(), *, stranded: bool = False) -> DataFrame:
    """(r0, r1, same_strand, hits) of read pairs that share at least min_frequency low hashes over all iterations.

    Takes markers, features or word_texts(). Features are hashed and buckets paired in the tasks: a low feature is shuffled once, as a row of
    three numbers for all its iterations.
    """
    if options.iterations > 63:  # more than the bits of a row hold
        pairs = _pairs(materialize(low_hashes(features(markers, options.m), options), "low"), options, stranded).withColumn("hits", F.lit(1).cast("long"))
    else:
        pairs = _low_pairs(_low_rows(markers, options), options, stranded)
    return pairs.groupBy("r0", "r1", "same_strand").agg(F.sum("hits").alias("hits")).where(F.col("hits") >= options.min_frequency)


def candidates_until(markers: DataFrame, reads: int, options: LowHashOptions = LowHashOptions(), *, stranded: bool = False, most: int | None = None) -> DataFrame:
    """Iterate until the candidates found before an iteration reach candidates_per_read a read, or no pair is left to find.

    A feature's bucket has the same size in every iteration, so only features within the size bounds are hashed, and the pairs
    that share one are all that can ever be found. Iterations run several at a time, twice as many each round up to MOST_AT_ONCE; those after the stop are dropped.
    """
    pair = ["r0", "r1", "same_strand"]
    feats = materialize(_usable(features(markers, options.m).withColumns({"iteration": F.lit(0), "hash": F.col("feature")}), options).drop("iteration", "hash", "size"), "features")
    everything = _pairs(feats.withColumns({"iteration": F.lit(0), "hash": F.col("feature")}), options, stranded).select(*pair).distinct().count()
    total: DataFrame | None = None
    done, known, step = 0, 0, 1
    while most is None or done < most:
        until = done + step if most is None else min(most, done + step)
        found = _pairs(low_hashes(feats, options, list(range(done, until))), options, stranded).groupBy(*pair, "iteration").agg(F.count("*").alias("hits"))
        if total is not None:
            found = found.unionByName(total.withColumn("iteration", F.lit(done - 1)))
        found, old = materialize(found, "hits"), total
        so_far = F.sum("hits").over(Window.partitionBy(*pair).orderBy("iteration"))
        reached = found.withColumn("so_far", so_far).where(F.col("so_far") >= options.min_frequency).groupBy(*pair).agg(F.min("iteration").alias("iteration"))
        counts = {r["iteration"]: r["count"] for r in reached.where(F.col("iteration") >= done).groupBy("iteration").count().collect()}
        ended = False
        while done < until and not ended:
            known += counts.get(done, 0)
            done += 1
            ended = 2 * known / max(1, reads) >= options.candidates_per_read or known >= everything
        total = materialize(found.where(F.col("iteration") < done).groupBy(*pair).agg(F.sum("hits").alias("hits")), "hits")
        discard(found, *([] if old is None else [old]))
        if ended:
            break
        step = min(MOST_AT_ONCE, 2 * step)
    return total.where(F.col("hits") >= options.min_frequency)


def bucket_histogram(markers: DataFrame, options: LowHashOptions = LowHashOptions()) -> DataFrame:
    """(iteration, size, buckets, entries)."""
    sizes = bucket_sizes(low_hashes(features(markers, options.m), options))
    return sizes.groupBy("iteration", "size").agg(F.count("*").alias("buckets"), F.sum("size").cast("long").alias("entries"))


def read_statistics(markers: DataFrame, options: LowHashOptions = LowHashOptions()) -> DataFrame:
    """Per read, its low hashes in sparse, good and crowded buckets."""
    hashes = materialize(low_hashes(features(markers, options.m), options), "low")
    joined = hashes.join(bucket_sizes(hashes), ["iteration", "hash"])
    least = max(2, options.min_bucket)
    return joined.groupBy("oriented_id").agg(
        F.count_if(F.col("size") < least).alias("sparse"), F.count_if(F.col("size").between(least, options.max_bucket)).alias("good"),
        F.count_if(F.col("size") > options.max_bucket).alias("crowded"),
    )


def common_features(markers: DataFrame, options: LowHashOptions = LowHashOptions(), *, stranded: bool = False) -> DataFrame:
    """(r0, r1, same_strand, o0, o1) of distinct common features of pairs with at least min_frequency of them.

    Buckets hold equal features, not equal hashes alone.
    """
    hashes = materialize(low_hashes(features(markers, options.m), options).withColumn("hash", F.col("feature")), "low")
    found = _pairs(hashes, options, stranded).select("r0", "r1", "same_strand", "o0", "o1").distinct()
    counts = found.groupBy("r0", "r1", "same_strand").agg(F.count("*").alias("features")).where(F.col("features") >= options.min_frequency)
    return found.join(counts, ["r0", "r1", "same_strand"])


def all_pairs(reads: DataFrame, key: str) -> DataFrame:
    """Every pair of reads in both relative orientations; quadratic by definition, for small sets."""
    left, right = reads.select(F.col(key).alias("r0")), reads.select(F.col(key).alias("r1"))
    return left.join(right, F.col("r0") < F.col("r1")).select("r0", "r1", F.explode(F.array(F.lit(True), F.lit(False))).alias("same_strand"))


def symmetric_view(pairs: DataFrame, *, stranded: bool = True) -> DataFrame:
    """Every pair seen from each of its ends (and strands): (oriented_id, other, ...)."""
    keep = [c for c in pairs.columns if c not in ("r0", "r1", "same_strand")]
    if not stranded:
        ends = F.array(F.struct(F.col("r0").alias("oriented_id"), F.col("r1").alias("other")), F.struct(F.col("r1").alias("oriented_id"), F.col("r0").alias("other")))
    else:
        turn = F.when(F.col("same_strand"), 0).otherwise(1)
        ends = F.array(*(
            F.struct((F.col(a) * 2 + s0).cast("long").alias("oriented_id"), (F.col(b) * 2 + s1).cast("long").alias("other"))
            for a, b, s0, s1 in (("r0", "r1", F.lit(0), turn), ("r0", "r1", F.lit(1), 1 - turn), ("r1", "r0", turn, F.lit(0)), ("r1", "r0", 1 - turn, F.lit(1)))
        ))
    return pairs.select(*keep, F.explode(ends).alias("e")).select(F.col("e.oriented_id").alias("oriented_id"), F.col("e.other").alias("other"), *keep)


def candidate_table(pairs: DataFrame, *, stranded: bool = True) -> DataFrame:
    """Each oriented read's candidate partners as a sorted array."""
    return symmetric_view(pairs, stranded=stranded).groupBy("oriented_id").agg(F.sort_array(F.collect_set("other")).alias("others"))


def cross_candidates(left: DataFrame, right: DataFrame, m: int, min_frequency: int) -> DataFrame:
    """J1 between two sets of marker sequences: (left_id, right_id, hits) of distinct shared features, however many left rows hold them.

    The right set is the small one: a feature's right rows come as one list, so the left side meets each feature once.
    """
    b = features(right, m).groupBy("feature").agg(F.collect_set("oriented_id").alias("right_ids"))
    b = materialize(b, "right_features")
    a = features(left, m).select(F.col("oriented_id").alias("left_id"), "feature")
    shared = a.join(small_enough(b, 128), "feature").select("left_id", "feature", "right_ids").distinct()
    return shared.select("left_id", F.explode("right_ids").alias("right_id")).groupBy("left_id", "right_id").agg(F.count("*").alias("hits")).where(F.col("hits") >= min_frequency)


def common_members(sets: DataFrame, owner: str, member: str) -> DataFrame:
    """(a, b, common) of owners that share members.

    Each member's owners are listed once; what is shuffled are, for each of them, the greater ones as one array, and pairs are made and
    counted where they lie.
    """
    lists = sets.where(F.col(member).isNotNull()).groupBy(member).agg(F.sort_array(F.collect_set(owner)).alias("owners")).where(F.size("owners") > 1)
    rows = lists.select("owners", F.posexplode("owners").alias("i", "a")).where(F.col("i") + 1 < F.size("owners"))
    rows = rows.select("a", F.slice("owners", F.col("i") + 2, F.size("owners")).alias("others")).repartition("a")
    return rows.select("a", F.explode("others").alias("b")).groupBy("a", "b").agg(F.count("*").alias("common"))
