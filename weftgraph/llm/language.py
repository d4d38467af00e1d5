"""Language identification of web pages by fusing evidence (operator 2)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import as_bytes, bound_batches, table
from weftgraph.llm.ordinal import TRIGRAMS, trigrams
from weftgraph.storage import materialize

#: Languages that a model may hold; more in the labelled texts are an error, not a cut.
MOST_LANGUAGES = 64
#: Trigrams of one page count as this many independent observations at most, as neighbouring ones aren't.
EVIDENCE = 200.0
#: Pages' worth of its parent's prior that a host, domain or suffix starts with.
SMOOTHING = 4.0
_DROP = re.compile(rb"<!--.*?-->|<(script|style|nav|header|footer|aside|noscript)\b.*?</\1\s*>", re.S | re.I)
_AD = re.compile(rb"""<(div|section|span)\b[^>]*\bclass\s*=\s*["']?[^"'>]*\b(?:ad|ads|advert|banner|menu|sidebar|cookie)\b.*?</\1\s*>""", re.S | re.I)
_TAG = re.compile(rb"<[^>]*>")
_ENTITY = re.compile(rb"&#?\w{1,8};")


def visible_text(html: bytes) -> bytes:
    """The text of a page without markup, scripts, navigation and advertisements; A-Z as a-z."""
    body = _AD.sub(b" ", _DROP.sub(b" ", html))
    return b" ".join(_ENTITY.sub(b" ", _TAG.sub(b" ", body)).lower().split())


def language_model(docs: DataFrame, *, language: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages, in order, and log P(trigram | language), from the trigram counts of all labelled texts.

    Every task adds up one row of counts a language and batch; rows without a language are left out.
    """
    bound_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, raw in zip(batch.column("lang").to_pylist(), as_bytes(batch.column("text")), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(TRIGRAMS, np.int64)
                    if len(sums) > MOST_LANGUAGES:
                        raise ValueError(f"more than {MOST_LANGUAGES} languages")
                for piece in trigrams(b" ".join(raw.lower().split())):
                    sums[lang] += np.bincount(piece, minlength=TRIGRAMS)
        for lang, counts in sums.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used), pa.array(counts[used])], ["lang", "gram", "n"])

    labelled = docs.where(F.col(language).isNotNull()).select(F.col(language).alias("lang"), F.col(text).alias("text"))
    counts = labelled.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts.column("lang").to_pylist()))
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    model = np.full((len(names), TRIGRAMS), 0.5)
    at = {x: i for i, x in enumerate(names)}
    np.add.at(model, ([at[x] for x in counts.column("lang").to_pylist()], counts.column("gram").to_numpy()), counts.column("n").to_numpy())
    return names, np.log(model / model.sum(1, keepdims=True)) if names else model


def page_evidence(pages: DataFrame, names: list[str], model: np.ndarray) -> DataFrame:
    """(page_id, host, domain, suffix, declared, address, text array<double>) of every page.

    text: log-likelihood of the visible text under each language, less the largest. declared: the
    language of the html tag or a content-language, null if none is known. address: the host's last label or a path
    segment that names a known language, null if none does.
    """
    shared = pages.sparkSession.sparkContext.broadcast((names, model))  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, model = shared.value
        for batch in batches:
            out = []
            for raw in as_bytes(batch.column("html")):
                score, n = np.zeros(len(names)), 0
                for piece in trigrams(visible_text(raw)):
                    score += model[:, piece].sum(1)
                    n += len(piece)
                if n > EVIDENCE:
                    score *= EVIDENCE / n
                out.append((score - score.max(initial=-np.inf)).tolist() if len(names) else [])
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("head"), pa.array(out, pa.list_(pa.float64()))], ["page_id", "url", "head", "text"])

    bound_batches(pages.sparkSession)
    head = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})|http-equiv\s*=\s*[\"']?content-language[\"']?\s+content\s*=\s*[\"']?([a-z]{2,3})", 0)
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", head.alias("head")).mapInArrow(run, "page_id long, url string, head string, text array<double>")
    known = F.array(*(F.lit(x) for x in names)) if names else F.array().cast("array<string>")
    url = F.lower(F.coalesce("url", F.lit("")))
    host = F.regexp_extract(url, r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1)
    segments = F.split(F.regexp_replace(url, r"[?#].*$|^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*", ""), "/")
    declared = F.lower(F.regexp_extract("head", r"(?i)([a-z]{2,3})$", 1))
    last = F.substring_index("host", ".", -1)
    return (
        rows.select("page_id", host.alias("host"), segments.alias("segments"), declared.alias("declared"), "text")
        .withColumns({
            "domain": F.substring_index("host", ".", -2), "suffix": last,
            "declared": F.when(F.array_contains(known, F.col("declared")), F.col("declared")),
            "address": F.coalesce(F.when(F.array_contains(known, last), last), F.get(F.filter("segments", lambda x: F.array_contains(known, x)), F.lit(0))) if names else F.lit(None).cast("string"),
        })
        .drop("segments")
    )


def _posterior(logs: F.Column) -> F.Column:
    """Normalised probabilities of an array of logs."""
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, language, probability, declared, address, host) of every page; repeated rows come back each.

    Log-evidence adds up: the text's likelihood, how the declared language and the address's speak for
    each language (both estimated by grouped counts over all pages, with one count added), and the
    host's prior. Priors are counts of text posteriors by host, domain and suffix, each smoothed by SMOOTHING
    pages of the level above and the last by that of all pages; a page's own share is in them. A null url or html
    gives no evidence of its kind. With no labelled text there are no languages: language is null.
    """
    names, model = language_model(docs)
    found = materialize(page_evidence(pages, names, model), "evidence")
    if not names:
        return found.select("page_id", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("probability"), "declared", "address", "host")
    rows = found.withColumn("p", _posterior(F.col("text")))
    sums = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(len(names))]
    total = rows.agg(*sums, F.count("*").alias("n")).first()
    base = [((total[i] or 0.0) + 1.0) / ((total["n"] or 0) + len(names)) for i in range(len(names))]

    def says(column: str) -> F.Column:
        """log P(what the page says | language), as a map of arrays; of as many rows as there are languages."""
        counts = rows.groupBy(column).agg(*sums).collect()
        by = {r[column]: [r[f"s{i}"] for i in range(len(names))] for r in counts}
        sums_ = np.array([[by.get(x, [0.0] * len(names))[i] for i in range(len(names))] for x in [*names, None]]) + 1.0
        logs = np.log(sums_ / sums_.sum(0, keepdims=True))
        pick = F.lit(None).cast("array<double>")
        for x, row in zip([*names, None], logs, strict=True):
            same = F.col(column).isNull() if x is None else F.col(column) == x
            pick = F.when(same, F.array(*(F.lit(float(v)) for v in row))).otherwise(pick)
        return pick

    parent = F.array(*(F.lit(float(x)) for x in base))
    level = rows.groupBy("suffix", "domain", "host").agg(*sums, F.count("*").alias("n"))
    priors: list[DataFrame] = []
    for key, above in (("suffix", None), ("domain", "suffix"), ("host", "domain")):
        own = level.groupBy(*dict.fromkeys([key, *([above] if above else [])])).agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(len(names))), F.sum("n").alias("n"))
        if above:
            own = own.join(priors[-1].withColumnRenamed("prior", "parent"), above)
        else:
            own = own.withColumn("parent", parent)
        prior = F.array(*((F.col(f"s{i}") + SMOOTHING * F.col("parent")[i]) / (F.col("n") + SMOOTHING) for i in range(len(names))))
        priors.append(own.select(key, prior.alias("prior")))
    hosts = materialize(priors[-1], "host-priors")
    evidence = rows.withColumns({"says": says("declared"), "sent": says("address")}).join(hosts, "host")
    fused = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.col("text")[i] + F.col("says")[i] + F.col("sent")[i] + F.log(F.col("prior")[i]))
    known = F.array(*(F.lit(x) for x in names))
    best = F.array_position("posterior", F.array_max("posterior")).cast("int") - 1
    return evidence.withColumn("posterior", _posterior(fused)).select(
        "page_id", known[best].alias("language"), F.array_max("posterior").alias("probability"), "declared", "address", "host"
    )


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
