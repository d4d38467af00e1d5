"""k-mers and markers: counting, selection and finding."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.operators.sequences import reverse_complement, with_both_strands
from weftgraph.shipping import ship
from weftgraph.storage import materialize

#: Hashes are the first 15 hexadecimal digits of an MD5, so that other engines can compute them.
HASH_RANGE = 16**15
#: Rows of a k-mer table that may be sent to every executor.
SMALL_TABLE = 1 << 20
#: Bases that a task cuts into k-mers at a time; a longer read is cut alone.
SLICE = 1 << 20


def stable_hash(text: Column) -> Column:
    """60 bits of a string's MD5 as a long."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def explode_kmers(reads: DataFrame, k: int, bases: str = "bases") -> DataFrame:
    """Every k-mer of every row with its position (from 0); rows shorter than k have none.

    Bases are single bytes, and cutting bytes takes no scan from the string's start, as cutting characters does.
    """
    kept = reads.where(F.length(bases) >= k)
    raw = F.col(bases).cast("binary")
    grams = F.transform(F.sequence(F.lit(0), F.length(bases) - k), lambda i: F.substring(raw, i + 1, F.lit(k)).cast("string"))
    return kept.select("*", F.posexplode(grams).alias("position", "kmer"))


@dataclass
class _Grams:
    """The k-mers of some reads: where each starts in their joined bases, the read it is of, its place there, and equal codes for equal k-mers."""

    data: np.ndarray
    k: int
    start: np.ndarray
    read: np.ndarray
    place: np.ndarray
    code: np.ndarray
    lengths: np.ndarray

    def text(self, which: np.ndarray) -> pa.Array:
        """The k-mers at `which`, as strings."""
        grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.data, self.k)[self.start[which]]) if len(which) else np.empty(0, np.uint8)
        return pa.StringArray.from_buffers(len(which), pa.py_buffer(np.arange(len(which) + 1, dtype=np.int32) * np.int32(self.k)), pa.py_buffer(grams))


_BASE = np.full(256, 4, np.int8)
_BASE[list(b"ACGT")] = range(4)
_PARTNER = np.arange(256, dtype=np.uint8)
_PARTNER[list(b"ACGT")] = list(b"TGCA")


def _codes(data: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """A number for the k bases at each start: two bits a base if they are A, C, G and T alone and few enough, else the k-mer's place among all."""
    base = _BASE[data]
    if k <= 15 and not (base == 4).any():
        code = np.zeros(max(0, len(data) - k + 1), np.int32)
        for i in range(k):
            code = code * 4 + base[i : i + len(code)]
        return code[start].astype(np.uint16 if k <= 8 else np.uint32)  # numbers of 16 bits are sorted fastest
    if not len(start):
        return np.empty(0, np.int64)
    grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, k)[start]).view(f"S{k}").ravel()
    return np.unique(grams, return_inverse=True)[1].astype(np.int64)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a sorted row differs from the one before; the first one does."""
    out = np.zeros(len(columns[0]), bool)
    for x in columns:
        out[1:] |= x[1:] != x[:-1]
    out[:1] = True
    return out


def _grams(bases: pa.Array, k: int, turned: bool = False) -> _Grams:
    """All k-mers of an array of reads without nulls, or of their reverse complements."""
    offsets = np.frombuffer(bases.buffers()[1], np.int32)[bases.offset : bases.offset + len(bases) + 1].astype(np.int64)
    data = np.frombuffer(bases.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    if turned:  # the last read comes first
        data, lengths = _PARTNER[data[::-1]], lengths[::-1]
    counts = np.maximum(lengths - k + 1, 0)
    read = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(read)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.repeat(np.cumsum(lengths) - lengths, counts) + place
    return _Grams(data, k, start, read, place, _codes(data, start, k), lengths)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about SLICE bases, which are the last column; a read without bases is dropped."""
    for batch in batches:
        batch = batch.filter(pc.is_valid(batch.column(batch.num_columns - 1)))
        ends = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + SLICE, "right")))
            yield batch.slice(first, last - first)
            first = last


def _sum_by_kmer(reads: DataFrame, k: int, columns: str, measure, merged: list[Column]) -> DataFrame:
    """(kmer, *merged) over one strand: measure() sums each slice of reads in its task, so that only distinct k-mers are shuffled."""
    ship(reads.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            grams = _grams(part.column(0), k)
            which, found = measure(grams)
            yield pa.RecordBatch.from_arrays([grams.text(which), *found.values()], names=["kmer", *found])

    kept = reads.where(F.length("bases") >= k).select("bases")
    return kept.mapInArrow(run, f"kmer string, {columns}").groupBy("kmer").agg(*merged)


def _counted(grams: _Grams) -> tuple[np.ndarray, dict[str, pa.Array]]:
    _, which, n = np.unique(grams.code, return_index=True, return_counts=True)
    return which, {"n": pa.array(n, pa.int64())}


def kmer_frequency(reads: DataFrame, k: int) -> DataFrame:
    """K1, K4: (kmer, frequency) over both strands. One strand is counted, the other follows from it."""
    one = _sum_by_kmer(reads, k, "n long", _counted, [F.sum("n").alias("n")])
    both = one.select(F.explode(F.array(F.col("kmer"), reverse_complement("kmer"))).alias("kmer"), "n")
    return both.groupBy("kmer").agg(F.sum("n").cast("long").alias("frequency"))


def is_run_length_kmer(kmer: Column) -> Column:
    """K1: no two neighbouring bases are equal."""
    return ~kmer.rlike(r"(.)\1")


def select_random(kmers: DataFrame, probability: float) -> DataFrame:
    """K2: k-mers drawn by hash, each with its reverse complement, so that a share `probability` is selected."""
    p = 1 - (1 - probability) ** 0.5
    limit = int(p * HASH_RANGE)
    drawn = (stable_hash(F.col("kmer")) < limit) | (stable_hash(reverse_complement("kmer")) < limit)
    return kmers.where(drawn)


def select_until_density(frequencies: DataFrame, density: float) -> DataFrame:
    """K3: draw canonical pairs in hash order until their frequencies reach `density` of the total."""
    pairs = frequencies.groupBy(canonical(F.col("kmer")).alias("pair")).agg(F.sum("frequency").cast("long").alias("f"))
    total = frequencies.agg(F.sum("frequency").alias("total"))
    hashed = pairs.withColumn("h", stable_hash(F.col("pair")))
    dealt = hashed.repartitionByRange("h", "pair").withColumn("part", F.spark_partition_id())
    within = Window.partitionBy("part").orderBy("h", "pair").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("own", F.coalesce(F.sum("f").over(within), F.lit(0)))
    parts = dealt.groupBy("part").agg(F.sum("f").alias("s"))
    parts = parts.withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    kept = dealt.join(F.broadcast(parts), "part").crossJoin(F.broadcast(total)).where(F.col("own") + F.col("before") < density * F.col("total"))  # one row a partition, and one row
    return frequencies.withColumn("pair", canonical(F.col("kmer"))).join(kept.select("pair"), "pair", "left_semi").drop("pair")


def select_not_enriched(frequencies: DataFrame, k: int, enrichment: float, density: float) -> DataFrame:
    """K3 (method 1): leave out k-mers over floor(enrichment * mean frequency), then draw to a density."""
    possible = 4**k
    limit = frequencies.agg(F.floor(F.lit(enrichment) * F.sum("frequency") / possible).alias("limit"))
    kept = frequencies.crossJoin(F.broadcast(limit)).where("frequency <= limit").drop("limit")  # one row
    return select_until_density(kept, density)


def select_not_enriched_in_reads(reads: DataFrame, k: int, enrichment: float, density: float) -> DataFrame:
    """K5 (method 2): leave out k-mers that are over-enriched in any read or its reverse complement."""
    def measured(grams: _Grams) -> tuple[np.ndarray, dict[str, pa.Array]]:
        # a k-mer and its partner are as often on the two strands, so one strand shows which are over in a read
        order = np.argsort(grams.code, kind="stable")  # equal k-mers stay in order of their reads
        code, read = grams.code[order], grams.read[order]
        first = np.flatnonzero(_changes(code, read))
        n = np.diff(first, append=len(code))
        limit = np.floor(enrichment * (grams.lengths[read[first]] + 1 - k) / 4**k)
        over = n > np.maximum(limit, 1)
        lead = np.flatnonzero(_changes(code[first]))
        sums = np.add.reduceat(n, lead) if len(lead) else n[:0]
        return order[first[lead]], {"n": pa.array(sums, pa.int64()), "over": pa.array(np.logical_or.reduceat(over, lead) if len(lead) else over[:0], pa.bool_())}

    one = _sum_by_kmer(reads, k, "n long, over boolean", measured, [F.sum("n").alias("n"), F.bool_or("over").alias("over")])
    both = one.select(F.explode(F.array(F.col("kmer"), reverse_complement("kmer"))).alias("kmer"), "n", "over")
    by_kmer = both.groupBy("kmer").agg(F.sum("n").cast("long").alias("frequency"), F.bool_or("over").alias("over"))
    return select_until_density(by_kmer.where("not over").drop("over"), density)


def nearest_repeats(reads: DataFrame, k: int) -> DataFrame:
    """K6: (kmer, frequency, gap): the least distance between successive occurrences in any oriented read, null if none repeats."""
    def measured(grams: _Grams) -> tuple[np.ndarray, dict[str, pa.Array]]:
        # occurrences stand in order of read and position, and a stable sort keeps them so
        order = np.argsort(grams.code, kind="stable")
        code, read, place = grams.code[order], grams.read[order], grams.place[order]
        none = np.iinfo(np.int64).max
        gap = np.where(_changes(code, read), none, np.diff(place, prepend=0))
        lead = np.flatnonzero(_changes(code))
        least = np.minimum.reduceat(gap, lead) if len(lead) else gap[:0]
        return order[lead], {"n": pa.array(np.diff(lead, append=len(code)), pa.int64()), "gap": pa.array(np.where(least == none, 0, least), pa.int32(), mask=least == none)}

    one = _sum_by_kmer(reads, k, "n long, gap int", measured, [F.sum("n").alias("n"), F.min("gap").alias("gap")])
    # two occurrences are as far apart on the other strand
    both = one.select(F.explode(F.array(F.col("kmer"), reverse_complement("kmer"))).alias("kmer"), "n", "gap")
    return both.groupBy("kmer").agg(F.sum("n").cast("long").alias("frequency"), F.min("gap").alias("gap"))


def select_distant(reads: DataFrame, k: int, distance: int, density: float) -> DataFrame:
    """K6 (method 4): leave out k-mers, and their reverse complements, that repeat within `distance`."""
    found = nearest_repeats(reads, k)
    return select_until_density(found.where(F.col("gap").isNull() | (F.col("gap") >= distance)).drop("gap"), density)


def select_listed(listed: DataFrame, k: int, run_length: bool = False) -> DataFrame:
    """K-mers of a list and their reverse complements; a wrong length or base is an error."""
    bad = (F.length("kmer") != k) | ~F.col("kmer").rlike("^[ACGT]*$")
    if run_length:
        bad = bad | ~is_run_length_kmer(F.col("kmer"))
    checked = listed.select(F.when(bad, F.raise_error(F.concat(F.lit("not a k-mer: "), F.col("kmer")))).otherwise(F.col("kmer")).alias("kmer"))
    return checked.select(F.explode(F.array(F.col("kmer"), reverse_complement("kmer"))).alias("kmer")).distinct()


def find_markers(reads: DataFrame, selected: DataFrame, k: int, *, sample: float | None = None, counted: bool = False) -> DataFrame:
    """K9: (oriented_id, ordinal, kmer, position) of all selected k-mers on both strands; read_id is the reads' key.

    A selection small enough goes to every executor, and a read's markers are numbered in its own row, so nothing is shuffled.
    counted adds n, the read's markers, and length, its bases. sample adds sampled_ordinal, the ordinal among the markers that
    downsample_markers() keeps, null for the others (K15).
    """
    return _markers(reads, selected, k, sample, counted, False)


def marker_arrays(reads: DataFrame, selected: DataFrame, k: int) -> DataFrame:
    """K9: (oriented_id, kmers, positions): find_markers() with a row a read's strand, in order of position; strands without markers have no row."""
    return _markers(reads, selected, k, None, False, True)


def _markers(reads: DataFrame, selected: DataFrame, k: int, sample: float | None, counted: bool, listed: bool) -> DataFrame:
    kmers = selected.select("kmer").distinct()
    chosen = F.lit(False) if sample is None else _in_sample(F.col("kmer"), sample)
    kmers = materialize(kmers.select("kmer", chosen.alias("chosen")), "selected")
    if kmers.count() > SMALL_TABLE:
        return _markers_by_join(reads, kmers, k, sample, counted, listed)
    spark = reads.sparkSession
    ship(spark)
    rows = sorted((r["kmer"].encode(), r["chosen"]) for r in kmers.where(F.octet_length("kmer") == k).collect())  # SMALL_TABLE at most
    sent = spark.sparkContext.broadcast((b"".join(x for x, _ in rows), np.array([c for _, c in rows], bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, chosen = sent.value
        wanted = np.frombuffer(text, f"S{k}")
        table = np.frombuffer(text, np.uint8)
        plain = np.array([bool((_BASE[table[i * k : i * k + k]] < 4).all()) for i in range(len(wanted))], bool)
        codes = _codes(table[np.repeat(plain, k)], np.arange(plain.sum()) * k, k) if k <= 15 else None
        # sorted k-mers have sorted codes
        which_plain = np.flatnonzero(plain)
        for part in _slices(batches):
            ids = part.column(0)
            for strand in (0, 1):
                grams = _grams(part.column(1), k, turned=bool(strand))
                if codes is not None and not (_BASE[grams.data] == 4).any():
                    known, value, back = codes, grams.code, which_plain
                else:
                    value = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(grams.data, k)[grams.start]).view(f"S{k}").ravel() if len(grams.start) else np.empty(0, f"S{k}")
                    known, back = wanted, np.arange(len(wanted))
                at = np.minimum(np.searchsorted(known, value), max(0, len(known) - 1))
                hit = np.flatnonzero(known[at] == value) if len(known) else np.empty(0, np.int64)
                read, n = grams.read[hit], np.bincount(grams.read[hit], minlength=len(grams.lengths))
                first = np.cumsum(n) - n
                who = np.arange(len(n))[::-1] if strand else np.arange(len(n))  # turned reads come last first
                oriented = pc.add(pc.multiply(pc.cast(ids.take(pa.array(who)), pa.int64()), 2), strand)
                place = pa.array(grams.place[hit], pa.int32())
                if listed:
                    some = np.flatnonzero(n)
                    ends = pa.array(np.append(first[some], len(hit)), pa.int32())
                    yield pa.RecordBatch.from_arrays([oriented.take(pa.array(some)), pa.ListArray.from_arrays(ends, grams.text(hit)), pa.ListArray.from_arrays(ends, place)], names=["oriented_id", "kmers", "positions"])
                    continue
                columns = {"oriented_id": oriented.take(pa.array(read)), "ordinal": pa.array(np.arange(len(hit)) - first[read], pa.int32()), "kmer": grams.text(hit), "position": place}
                if counted:
                    columns |= {"n": pa.array(n[read], pa.int64()), "length": pa.array(grams.lengths[read], pa.int64())}
                if sample is not None:
                    kept = chosen[back[at[hit]]]
                    past = np.cumsum(kept) - kept
                    start = past[np.minimum(first, max(0, len(hit) - 1))] if len(hit) else first
                    columns["sampled_ordinal"] = pa.array(past - start[read] if len(hit) else past, pa.int32(), mask=~kept)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kept = reads.where(F.length("bases") >= k).select("read_id", "bases")
    if listed:
        return kept.mapInArrow(run, "oriented_id long, kmers array<string>, positions array<int>")
    more = (", n long, length long" if counted else "") + (", sampled_ordinal int" if sample is not None else "")
    return kept.mapInArrow(run, f"oriented_id long, ordinal int, kmer string, position int{more}")


def _markers_by_join(reads: DataFrame, kmers: DataFrame, k: int, sample: float | None, counted: bool, listed: bool) -> DataFrame:
    """_markers() for a selection too large to send: the k-mers are shuffled to it."""
    both = with_both_strands(reads, "read_id", "bases").select("oriented_id", "bases", F.length("bases").cast("long").alias("length"))
    found = explode_kmers(both, k).drop("bases").join(kmers, "kmer")
    if listed:
        arrays = found.groupBy("oriented_id").agg(F.array_sort(F.collect_list(F.struct("position", "kmer"))).alias("v"))
        return arrays.select("oriented_id", F.transform("v", lambda x: x["kmer"]).alias("kmers"), F.transform("v", lambda x: x["position"]).alias("positions"))
    order = Window.partitionBy("oriented_id").orderBy("position")
    out = [F.col("oriented_id"), (F.row_number().over(order) - 1).cast("int").alias("ordinal"), F.col("kmer"), F.col("position")]
    if counted:
        out += [F.count("*").over(Window.partitionBy("oriented_id")).alias("n"), F.col("length")]
    if sample is not None:
        out.append(F.when(F.col("chosen"), (F.count_if("chosen").over(order) - 1).cast("int")).alias("sampled_ordinal"))
    return found.select(*out)


def markers_by_kmer(markers: DataFrame) -> DataFrame:
    """Each read's (kmer, ordinal) pairs as one array in order of k-mer, from its markers or from its row of marker_arrays()."""
    if "kmers" in markers.columns:
        pairs = F.arrays_zip(F.col("kmers").alias("kmer"), F.sequence(F.lit(0), F.size("kmers") - 1).alias("ordinal"))
        return markers.select("oriented_id", F.array_sort(pairs).alias("sorted_markers"))
    return markers.groupBy("oriented_id").agg(F.array_sort(F.collect_list(F.struct("kmer", "ordinal"))).alias("sorted_markers"))


def marker_frequency(markers: DataFrame) -> DataFrame:
    """K12."""
    return markers.groupBy("kmer").agg(F.count("*").alias("frequency"))


def reverse_complement_markers(markers: DataFrame, lengths: DataFrame | None, k: int) -> DataFrame:
    """Each marker's partner on the other strand: ordinal n-1-o, position length-k-p.

    Markers that were found counted carry n and length themselves and need no `lengths` (read_id, length).
    """
    if lengths is None:
        return markers.select(*_partner(k))
    counts = markers.groupBy("oriented_id").agg(F.count("*").alias("n"))
    joined = markers.join(counts, "oriented_id").join(lengths, F.floor(F.col("oriented_id") / 2) == F.col("read_id"))
    return joined.select(*_partner(k))


def _partner(k: int) -> list[Column]:
    return [
        F.col("oriented_id").bitwiseXOR(F.lit(1).cast("long")).alias("oriented_id"), (F.col("n") - 1 - F.col("ordinal")).cast("int").alias("ordinal"),
        reverse_complement("kmer").alias("kmer"), (F.col("length") - k - F.col("position")).cast("int").alias("position"),
    ]


def _in_sample(kmer: Column, factor: float) -> Column:
    return stable_hash(canonical(kmer)) < int(factor * HASH_RANGE)


def downsample_markers(markers: DataFrame, factor: float) -> DataFrame:
    """The markers whose strand-invariant hash falls below `factor` of its range, with new ordinals.

    find_markers(sample=factor) numbers them while it finds them, without a shuffle.
    """
    kept = markers.where(_in_sample(F.col("kmer"), factor))
    order = Window.partitionBy("oriented_id").orderBy("ordinal")
    return kept.withColumn("sampled_ordinal", (F.row_number().over(order) - 1).cast("int"))
