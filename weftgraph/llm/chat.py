"""Transcript parsing by a hidden Markov model and canonical chat turns (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm.common import bound_batches, table
from weftgraph.storage import materialize

ROLES = ("system", "user", "assistant")
#: A state is a role and whether the line opens a turn (even) or goes on with one (odd).
STATES = 2 * len(ROLES)
#: Source turns that a block of lines holds; blocks of one conversation are decoded side by side.
BLOCK_TURNS = 200
#: Speaker markers, by role, in lower case; the first is the canonical one.
MARKERS = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "customer", "q", "question"),
    "assistant": ("assistant", "ai", "bot", "agent", "a", "answer"),
}
MARKER_CLASSES, LENGTHS, SHAPES = len(ROLES) + 1, 6, 8
_MARKER = r"^\s*(?:#+\s*|\*\*|\[|<\|?)?\s*([A-Za-z]+)\s*(?:\*\*|\]|\|?>)?\s*(?::|\|>|-(?=\s))\s*"


def transcript_lines(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, line, role, body): raw transcript lines of a conversation table.

    A turn opens with its speaker's marker, in one of several styles, or, for one turn in three chosen
    by hash, with none; the other lines of its text follow as they are. role stays for fitting and checking. Null texts are one
    empty line, null turns come first, a null conversation is one of its own; a null or unknown role gets no marker.
    """
    pick = F.pmod(F.xxhash64("conv_id", "turn", F.lit("style")), F.lit(6))
    role = F.lower("role")
    style = F.when(pick < 2, F.lit("")).when(pick == 2, F.concat(F.initcap(role), F.lit(": ")))
    short = F.when(role == "user", "Q").when(role == "assistant", "A").otherwise("Context")
    human = F.when(role == "user", "Human").when(role == "assistant", "AI").otherwise("System")
    style = style.when(pick == 3, F.concat(short, F.lit(": "))).when(pick == 4, F.concat(F.lit("### "), human, F.lit(": "))).otherwise(F.concat(F.lit("["), role, F.lit("]: ")))
    known = F.coalesce(role.isin(*ROLES), F.lit(False))
    text = F.concat(F.when(known, style).otherwise(F.lit("")), F.coalesce("text", F.lit("")))
    lines = turns.select("conv_id", F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), F.when(known, role).alias("role"), F.posexplode(F.split(text, "\n")).alias("line", "body"))
    return lines


def line_features(lines: DataFrame) -> DataFrame:
    """Add marker, length and shape classes of each line, and `rest`, the body without its marker."""
    word = F.lower(F.regexp_extract("body", _MARKER, 1))
    marker = F.lit(0)
    for i, role in enumerate(ROLES):
        marker = F.when(word.isin(*MARKERS[role]), i + 1).otherwise(marker)
    rest = F.when(F.col("marker") > 0, F.regexp_replace("body", _MARKER, "")).otherwise(F.col("body"))
    n = F.length("rest")
    ends = F.col("rest").rlike(r"[.!?:]\s*$").cast("int")
    asks = F.col("rest").rlike(r"\?").cast("int")
    code = F.col("rest").rlike(r"^\s*([-*+]|\d+[.)]|```|    )").cast("int")
    return lines.withColumn("marker", marker).withColumn("rest", rest).withColumns({
        "length": F.when(n == 0, 0).when(n < 40, 1).when(n < 100, 2).when(n < 200, 3).when(n < 400, 4).otherwise(5),
        "shape": (ends + 2 * asks + 4 * code).cast("int"),
    })


class ChatModel:
    """Log-probabilities of first state, transitions and the three line features."""

    def __init__(self, first: np.ndarray, move: np.ndarray, emissions: list[np.ndarray]):
        self.first, self.move, self.emissions = first, move, emissions

    def emission(self, marker: np.ndarray, length: np.ndarray, shape: np.ndarray) -> np.ndarray:
        return sum(table_[:, x] for table_, x in zip(self.emissions, (marker, length, shape), strict=True)).T


def fit_chat(lines: DataFrame) -> ChatModel:
    """Count states, transitions and features over all labelled lines; one is added to each count.

    `lines` comes from line_features() with a role. What the grouped counts return has a fixed size.
    """
    order = Window.partitionBy("conv_id", "turn").orderBy("line")
    index = F.when(F.col("role") == ROLES[0], 0).when(F.col("role") == ROLES[1], 1).otherwise(2)
    known = lines.where(F.col("role").isNotNull()).withColumn("state", index * 2 + (F.row_number().over(order) > 1).cast("int"))
    emissions = [np.ones((STATES, n)) for n in (MARKER_CLASSES, LENGTHS, SHAPES)]
    for row in known.groupBy("state", "marker", "length", "shape").count().collect():
        for table_, name in zip(emissions, ("marker", "length", "shape"), strict=True):
            table_[row["state"], row[name]] += row["count"]
    # within a turn a state goes on; between turns it goes from one role to the next turn's
    turns = known.groupBy("conv_id", "turn", "role").agg(F.count("*").alias("lines"))
    after = Window.partitionBy("conv_id", F.floor(F.col("turn") / BLOCK_TURNS)).orderBy("turn", "role")
    steps = turns.select("role", "lines", F.lead("role").over(after).alias("next"), (F.col("turn") == 0).alias("opens"))
    at = {x: i for i, x in enumerate(ROLES)}
    first, move = np.full(STATES, 1e-3), np.full((STATES, STATES), 1e-3)
    for row in steps.groupBy("role", "next", "opens").agg(F.count("*").alias("n"), F.sum((F.col("lines") > 1).cast("int")).alias("long"), F.sum(F.greatest(F.col("lines") - 2, F.lit(0))).alias("more")).collect():
        i = at[row["role"]]
        move[2 * i, 2 * i + 1] += row["long"]
        move[2 * i + 1, 2 * i + 1] += row["more"]
        if row["next"] is not None:
            j = 2 * at[row["next"]]
            move[2 * i, j] += row["n"] - row["long"]
            move[2 * i + 1, j] += row["long"]
        if row["opens"]:
            first[2 * i] += row["n"]
    if first.max() < 1:
        first[::2] += 1
    move[:, ::2] += 1e-3
    return ChatModel(np.log(first / first.sum()), np.log(move / move.sum(1, keepdims=True)), [np.log(x / x.sum(1, keepdims=True)) for x in emissions])


def _forward(start: np.ndarray, emission: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best scores after the last line, given scores before the first, and each line's best predecessors."""
    back = np.zeros((len(emission), STATES), np.int8)
    score = start
    for t, e in enumerate(emission):
        step = score[:, None] + move
        back[t] = step.argmax(0)
        score = step.max(0) + e
    return score, back


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Blocks of a stream sorted by conversation and block."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        rows = batch.to_pandas()
        if rest is not None:
            rows = pd.concat([rest, rows], ignore_index=True)
        if not len(rows):
            continue
        key = rows["gid"].to_numpy()
        bounds = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield rows.iloc[a:b]
        rest = rows.iloc[bounds[-1] :]
    if rest is not None and len(rest):
        yield rest


def decode(lines: DataFrame, model: ChatModel) -> DataFrame:
    """(conv_id, turn, line, body, rest, state) by Viterbi over each conversation's lines in order.

    A conversation is cut into blocks of BLOCK_TURNS turns. Each block's best score from every entry to
    every exit state is a small matrix; a scan of a conversation's matrices (max-plus products) fixes
    each block's entry scores and exit state, and the blocks are then decoded side by side. So a
    conversation of any length is spread, with the result of one long Viterbi run.
    """
    spark = lines.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    block = F.floor(F.col("turn") / BLOCK_TURNS).cast("long")
    rows = lines.withColumn("block", block)
    rows = rows.withColumn("gid", F.xxhash64("conv_id", "block"))
    dealt = rows.select("gid", "conv_id", "block", "turn", "line", "marker", "length", "shape").repartition("gid").sortWithinPartitions("gid", "conv_id", "block", "turn", "line")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        out = []
        for group in _groups(batches):
            emission = model.emission(*(group[x].to_numpy() for x in ("marker", "length", "shape")))
            best = np.full((STATES, STATES), -np.inf)
            np.fill_diagonal(best, 0.0)
            for e in emission:
                best = (best[:, :, None] + model.move[None, :, :]).max(1) + e[None, :]
            # alone: the scores if the conversation starts here
            score = model.first + emission[0]
            for e in emission[1:]:
                score = (score[:, None] + model.move).max(0) + e
            c = group["conv_id"].iloc[0]
            out.append((group["gid"].iloc[0], None if pd.isna(c) else int(c), int(group["block"].iloc[0]), best.ravel().tolist(), score.tolist()))
            if len(out) >= 500:
                yield _table(out)
                out = []
        if out:
            yield _table(out)

    def _table(out: list) -> pa.RecordBatch:
        gid, conv, blk, best, score = zip(*out, strict=True)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((gid, conv, blk, best, score), kinds, strict=True)], ["gid", "conv_id", "block", "best", "score"])

    blocks = materialize(dealt.mapInArrow(matrices, "gid long, conv_id long, block long, best array<double>, score array<double>"), "blocks")

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ignore_index=True)
        before, score = [], None
        for i in range(len(pdf)):
            before.append(None if score is None else score.tolist())
            if score is None:
                score = np.array(pdf["score"][i])
            else:
                score = (score[:, None] + np.array(pdf["best"][i]).reshape(STATES, STATES)).max(0)
        final = [int(np.argmax(score))]
        for i in range(len(pdf) - 1, 0, -1):
            into = np.array(before[i]) + np.array(pdf["best"][i]).reshape(STATES, STATES)[:, final[-1]]
            final.append(int(np.argmax(into)))
        return pd.DataFrame({"gid": pdf["gid"], "before": before, "final": final[::-1]})

    several = blocks.withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    one = several.where("n = 1").select("gid", F.lit(None).cast("array<double>").alias("before"), F.lit(-1).alias("final"))
    many = several.where("n > 1").select("gid", "conv_id", "block", "best", "score").groupBy("conv_id").applyInPandas(scan, "gid long, before array<double>, final int")
    ends = one.unionByName(many)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for group in _groups(batches):
            emission = model.emission(*(group[x].to_numpy() for x in ("marker", "length", "shape")))
            before, final = group["before"].iloc[0], int(group["final"].iloc[0])
            if before is None or (isinstance(before, float) and np.isnan(before)):
                score, back = _forward(model.first + emission[0], emission[1:], model.move)
                back = np.concatenate([np.zeros((1, STATES), np.int8), back])
            else:
                score, back = _forward(np.asarray(before, float), emission, model.move)
            path = np.zeros(len(group), np.int32)
            path[-1] = int(np.argmax(score)) if final < 0 else final
            for t in range(len(group) - 1, 0, -1):
                path[t - 1] = back[t, path[t]]
            columns = [pa.array(group[x].astype("Int64" if x == "conv_id" else group[x].dtype), pa.string() if x in ("role", "rest") else (pa.int32() if x == "line" else pa.int64())) for x in ("conv_id", "turn", "line", "role", "rest")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(path)], ["conv_id", "turn", "line", "role", "rest", "state"])

    full = rows.select("gid", "conv_id", "block", "turn", "line", "role", "rest", "marker", "length", "shape").join(ends, "gid")
    full = full.repartition("gid").sortWithinPartitions("gid", "conv_id", "block", "turn", "line")
    return full.mapInArrow(states, "conv_id long, turn long, line int, role string, rest string, state int")


def canonical_turns(decoded: DataFrame) -> DataFrame:
    """(conv_id, first_turn, first_line, role, rendered, n_lines, ...): one row a recovered turn, in canonical form.

    A turn is rendered as "<|role|>", a line break, its lines without markers, and "<|end|>".
    Turns are recovered block by block: a turn that a block's end cuts stays two rows, so no row grows with a conversation.
    """
    block = F.floor(F.col("turn") / BLOCK_TURNS)
    order = Window.partitionBy("conv_id", block).orderBy("turn", "line")
    opens = (F.col("state") % 2 == 0) | (F.lag("state").over(order).isNull())
    opens = opens | (F.floor(F.lag("state").over(order) / 2) != F.floor(F.col("state") / 2))
    numbered = decoded.withColumn("nth", F.sum(opens.cast("int")).over(order)).withColumn("block", block)
    grouped = numbered.groupBy("conv_id", "block", "nth").agg(
        F.min(F.struct("turn", "line")).alias("at"), F.min_by("state", F.struct("turn", "line")).alias("state"),
        F.array_sort(F.collect_list(F.struct("turn", "line", "rest"))).alias("lines"), F.count("*").alias("n_lines"),
        F.min_by("role", F.struct("turn", "line")).alias("true_role"),
    )
    role = F.array(*(F.lit(x) for x in ROLES))[F.floor(F.col("state") / 2).cast("int")]
    body = F.array_join(F.transform("lines", lambda x: x["rest"]), "\n")
    rendered = F.concat(F.lit("<|"), role, F.lit("|>\n"), body, F.lit("\n<|end|>"))
    return grouped.select("conv_id", F.col("at.turn").alias("first_turn"), F.col("at.line").alias("first_line"), role.alias("role"), "true_role", "n_lines", rendered.alias("rendered"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    lines = materialize(line_features(transcript_lines(turns)), "lines")
    turns = canonical_turns(decode(lines, fit_chat(lines)))
    return turns.select("conv_id", "first_turn", "first_line", "role", "true_role", "n_lines", "rendered")
