"""Token counts with a digest cache (operator 9)."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import bound_batches, table
from weftgraph.storage import new_path

#: White space of any kind before a space: there a text may not be cut.
_BLANK = r"[\s\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]"
_SPACED = re.compile(_BLANK + " ")
_CUT = re.compile("(?<!" + _BLANK + ") ")
#: A word of Latin letters and the marks behind it, which a byte-level BPE never joins.
_WORD = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?*$%&#]*)")
#: Entries of one generation of a worker's memory. A full one becomes the older of two, the former older one goes; no count changes.
MEMO_ENTRIES = 300_000
_LOADED: dict[tuple[str, str], "_Counter"] = {}


class _Memory:
    """Counts of strings, of which those used of late stay."""

    def __init__(self):
        self.now: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def missing(self, wanted: set[str]) -> list[str]:
        if len(self.now) > MEMO_ENTRIES:
            self.now, self.old = {}, self.now
        missing = wanted.difference(self.now)
        if known := missing.intersection(self.old):
            self.now.update((x, self.old[x]) for x in known)
        return list(missing - known)


class _Counter:
    """Counts tokens with the tokenizer's own library.

    A byte-level BPE never joins what a single space parts, so a text's count is the sum over its
    space-led pieces, and the library encodes each distinct piece once per worker. Texts that hold a
    special string, and tokenizers of another kind, are encoded whole.
    """

    def __init__(self, path: str):
        self.memo = _Memory()
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.pieces = False
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        first = spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
        self.pieces = bool(plain and spec["model"].get("type", "BPE") == "BPE")
        self.special = [x["content"] for x in spec.get("added_tokens") or []]
        self.words = _Memory()
        self.encode = lambda texts: [len(x) for x in library.encode_batch_fast(texts, add_special_tokens=False)]
        self.word_ids = lambda text: library.encode(text, add_special_tokens=False).word_ids

    def add(self, pieces: list[str]) -> None:
        """Put pieces into the memory; new words share one call of the library, which numbers its words."""
        words, parts, rest = self.words, [], []
        for piece in pieces:
            if m := _WORD.fullmatch(piece):
                parts.append((piece, " " + m[1], m[2]))
            else:
                rest.append(piece)
        new = words.missing({x for _, x, _ in parts})
        for i in range(0, len(new), 5000):
            part = new[i : i + 5000]
            counts = Counter(self.word_ids("".join(part)))
            if len(counts) != len(part):
                raise ValueError("the tokenizer doesn't keep words apart")
            words.now.update((x, counts[j]) for j, x in enumerate(part))
        marks = list({x for _, _, x in parts}.difference(words.now))
        words.now.update(zip(marks, self.encode(marks), strict=True))
        self.memo.now.update((piece, words.now[word] + words.now[mark]) for piece, word, mark in parts)
        self.memo.now.update(zip(rest, self.encode([x[1:] if x[:1] == "\0" else " " + x for x in rest]), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        if not self.pieces:
            return self.encode(texts)
        memo, cut, out, whole = self.memo, [], [0] * len(texts), []
        for i, text in enumerate(texts):
            if "\0" in text or any(x in text for x in self.special):  # NUL marks a first piece
                whole.append(i)
                cut.append([])
                continue
            pieces = _CUT.split(text) if _SPACED.search(text) else text.split(" ")
            if pieces[0]:
                pieces[0] = "\0" + pieces[0]  # the only piece without a space before it
            else:
                del pieces[0]
            cut.append(pieces)
        if missing := memo.missing(set().union(*cut)):
            self.add(missing)
        look = memo.now.__getitem__
        for i, pieces in enumerate(cut):
            out[i] = sum(map(look, pieces))
        for i, n in zip(whole, self.encode([texts[i] for i in whole]) if whole else (), strict=True):
            out[i] = n
        return out


def _counter(path: str, version: str) -> _Counter:
    if (path, version) not in _LOADED:
        _LOADED[path, version] = _Counter(path)
    return _LOADED[path, version]


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file: another file is another cache key, under whatever name."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def cached_token_counts(docs: DataFrame, tokenizer: str, cache: str, *, text: str = "text") -> DataFrame:
    """Add n_bytes and n_tokens to `docs`, encoding only texts whose digest the cache table lacks.

    `cache` is a Parquet folder of (digest, version, n_tokens) that grows by the distinct misses; it
    may not exist yet. The key is the SHA-256 of the text's UTF-8 bytes and that of the tokenizer
    file, so nothing that could change a count is normalised away: a null text counts as empty and
    every other text as it is. Texts move through one shuffle, after the copies within each input
    partition are merged; what joins back to the rows is digests and counts. Repeated rows stay, each
    with its count. An existing column n_bytes or n_tokens is replaced. An append is one Spark job, so a lost executor
    repeats tasks and not entries, and entries that two writers both added count once.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    version = tokenizer_version(tokenizer)
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(body.cast("binary"), 256))
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    known = jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm)
    texts = docs.select(digest.alias("digest"), body.alias("text"))
    if known:
        kept = spark.read.schema("digest binary, version string, n_tokens long").parquet(cache).where(F.col("version") == version)
        texts = texts.join(kept.select("digest"), "digest", "left_anti")
    misses = texts.groupBy("digest").agg(F.first("text").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer, version)
        for batch in batches:
            counts = counter.count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    found = misses.mapInArrow(encode, "digest binary, n_tokens long")
    found.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    stored = (
        spark.read.schema("digest binary, version string, n_tokens long").parquet(cache)
        .where(F.col("version") == version).groupBy(F.col("digest").alias("__digest")).agg(F.max("n_tokens").alias("n_tokens"))
    )
    rows = docs.drop("n_tokens", "n_bytes").withColumns({"n_bytes": F.octet_length(body).cast("long"), "__digest": digest})
    return rows.join(stored, "__digest").drop("__digest")


def op9_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = cached_token_counts(docs, tokenizer, new_path(spark, "token-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


