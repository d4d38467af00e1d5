"""Repair of damaged conversation structure by a retained-subsequence dynamic programme (operator 11)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftgraph.llm.common import bound_batches, table
from weftgraph.storage import materialize, small_enough

#: Rows and bytes of text of one run, a stretch of one conversation that is read at a time.
RUN_ROWS, RUN_BYTES = 20_000, 8 << 20
#: White space that a turn may end with or consist of.
_SPACE = " \t\n\x0b\x0c\r"
DELETE, REROLE, INSERT = 3, 2, 2
#: What has been retained last: nothing yet, a system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Turns to insert between what was retained last and the next retained role; a pair that isn't listed can't follow.
_BETWEEN = {
    SYSTEM: ((START, 0),), USER: ((START, 0), (SYSTEM, 0), (USER, 1), (ASSISTANT, 0)), ASSISTANT: ((START, 1), (SYSTEM, 1), (USER, 0), (ASSISTANT, 1)),
}
#: Turns to insert behind the last retained one.
_CLOSING = (0, 2, 1, 0)
_NEVER = 1 << 60

_ROW = pa.struct([("role", pa.string()), ("text", pa.string()), ("n", pa.int64()), ("fault", pa.int32())])
_LONGS = ("n_rows", "blank", "duplicate", "truncated", "illegal", "turns", "min_turn", "max_turn", "first_turn", "last_turn")
_RUN = f"run long, whole boolean, {', '.join(f'{x} long' for x in _LONGS)}, first_initial string, last_initial string, costs array<long>, ranks array<int>, rows array<struct<role: string, text: string, n: long, fault: int>>"


class _Walk:
    """The programme over the rows of one run, from one entry state.

    `least` holds for each state the running minimum of cost less the deletions before it, so that a gap of deleted
    turns is priced by the difference of two prefix sums. Of equal costs the least audit counts. Two audits over the same rows
    differ at a letter of both, never only in length, so the order of the audits so far (`ranks`) and the letters of one step decide.
    """

    def __init__(self, rows: list[dict], entry: int):
        self.deleted = 0
        self.least = [0 if q == entry else _NEVER for q in range(4)]
        self.ranks = [0 if q == entry else 9 for q in range(4)]
        self.steps: list[list[tuple[int, str] | None]] = []
        self.rows = rows
        for row in rows:
            self._take(row)

    def _take(self, row: dict) -> None:
        if row["fault"] == 2:  # every copy has to go
            self.deleted += DELETE * row["n"]
            self.steps.append([(q, "D") for q in range(4)])
            return
        # the copies after the first are duplicates: they go, whatever becomes of the first
        initial, more = row["role"][:1], row["fault"]
        found: list[list[tuple[int, int, str, int]]] = [[(self.least[q], self.ranks[q], "D", q)] if self.least[q] < _NEVER else [] for q in range(4)]
        for state, pairs in _BETWEEN.items():
            keeps = initial == " sua"[state]
            if not keeps and state == SYSTEM:
                continue
            price, letter = (more, "K") if keeps else (more + REROLE, "R")
            for q, n in pairs:
                if self.least[q] < _NEVER:
                    found[state].append((self.least[q] + price + INSERT * n - DELETE, self.ranks[q], "I" * n + letter, q))
        self.deleted += DELETE * row["n"]
        best = [min(x, default=None) for x in found]
        order = {x: i for i, x in enumerate(sorted((x[1], x[2]) for x in best if x))}
        self.least = [x[0] if x else _NEVER for x in best]
        self.ranks = [order[x[1], x[2]] if x else 9 for x in best]
        self.steps.append([(x[3], x[2]) if x else None for x in best])

    def cost(self, state: int) -> int:
        return self.least[state] + self.deleted if self.least[state] < _NEVER else _NEVER

    def edits(self, state: int) -> tuple[str, list[tuple[str, str]]]:
        """The audit that leads to `state`, and the (role, text) of the turns that remain."""
        letters, turns = [], []
        for row, step in zip(self.rows[::-1], self.steps[::-1], strict=True):
            before, word = step[state]
            n = row["n"]
            if word == "D":
                letters.append("D" * n)
            else:
                letters.append(word + "D" * (n - 1))
                turns.append((row["role"] if word[-1] == "K" else _NAMES[state], row["text"]))
                if word[0] == "I":
                    turns.append((_NAMES[ASSISTANT if state == USER else USER], ""))
            state = before
        return "".join(letters[::-1]), turns[::-1]


def _closed(costs: list[int], ranks: list[int]) -> tuple[int, int]:
    """The cheapest end of a conversation: (cost, state)."""
    cost, _, state = min((costs[q] + INSERT * _CLOSING[q], ranks[q], q) for q in range(4))
    return cost, state


def _closing(state: int) -> list[tuple[str, str]]:
    return [("user", ""), ("assistant", "")][2 - _CLOSING[state] :]


def _lines(turns: list[tuple[str, str]]) -> list[bytes]:
    return [f"{role}:{text}".encode("utf-8", "surrogatepass") for role, text in turns]


class _Run:
    def __init__(self, conv, number: int):
        self.conv, self.number, self.opens, self.bytes = conv, number, False, 0
        self.rows: list[dict] = []
        self.count = dict.fromkeys(_LONGS[:6], 0)
        self.turn: dict[str, int | None] = dict.fromkeys(_LONGS[6:])
        self.initials: list[str | None] = [None, None]

    def add(self, turn: int | None, role: str, text: str, n: int, first: bool) -> None:
        body = text.rstrip(_SPACE)
        fault = 2 if not body or not first else int(body[-1] not in ".!?")
        count = self.count
        count["n_rows"] += n
        if not body:
            count["blank"] += n
        else:
            count["duplicate"] += n - first
            count["truncated"] += fault == 1
        initial = role[:1]
        count["illegal"] += n - 1
        if self.initials[1] is not None:
            count["illegal"] += self.initials[1] + initial not in ("su", "ua", "au")
        else:
            self.initials[0] = initial
        self.initials[1] = initial
        if turn is not None:
            t = self.turn
            count["turns"] += t["last_turn"] != turn
            if t["first_turn"] is None:
                t["first_turn"] = t["min_turn"] = turn
            t["last_turn"] = t["max_turn"] = turn
        self.rows.append({"role": role, "text": text, "n": n, "fault": fault})
        self.bytes += len(text)

    def record(self, closes: bool) -> dict:
        whole = self.opens and closes
        walks = [_Walk(self.rows, entry) for entry in ((START,) if self.opens else range(4))]
        costs = [w.cost(q) for w in walks for q in range(4)]
        ranks = [r for w in walks for r in w.ranks]
        return {
            "run": self.number, "whole": whole, **self.count, **self.turn, "first_initial": self.initials[0], "last_initial": self.initials[1], "costs": costs, "ranks": ranks, "rows": self.rows,
        }


def conversation_runs(turns: DataFrame, present: str | None = None, run_rows: int = RUN_ROWS) -> DataFrame:
    """Conversations in their order, cut into runs: counts, and the least costs between any states before and after each run.

    Equal rows are counted together first. Turns are then dealt by ranges of (conversation, turn, role, digest), so that a
    conversation of any size spreads over tasks, and each task reads its sorted rows once. The first turn of each (role, text) comes as a small row of its own right before the row
    it marks, and every conversation as one before all its rows; a conversation that starts and ends within a task is a whole run.
    Rows whose boolean column `present` isn't true only name their conversation.
    """
    spark = turns.sparkSession
    bound_batches(spark)
    rows = (turns.where(F.col(present)) if present else turns).select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    digest = F.unhex(F.sha2("text", 256))
    none = F.lit(None)
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).select("conv_id", "turn", "role", digest.alias("digest"), F.lit(2).alias("kind"), "text", "n")
    least = F.when(F.bool_or(F.col("turn").isNull()), none).otherwise(F.min("turn"))
    firsts = rows.groupBy("conv_id", "role", digest.alias("digest")).agg(least.alias("turn")).select("conv_id", "turn", "role", "digest", F.lit(1).alias("kind"), none.cast("string").alias("text"), F.lit(0).cast("long").alias("n"))
    marks = turns.select("conv_id").distinct().select("conv_id", none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("binary").alias("digest"), F.lit(0).alias("kind"), none.cast("string").alias("text"), F.lit(0).cast("long").alias("n"))
    keys = ["conv_id", "turn", "role", "digest"]
    placed = counted.unionByName(firsts).unionByName(marks).repartitionByRange(*keys).sortWithinPartitions(*keys, "kind")
    schema = StructType([turns.select("conv_id").schema.fields[0], *spark.createDataFrame([], _RUN).schema.fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        run: _Run | None = None
        pending = None
        out: list[dict] = []
        held = 0
        kind_of = None

        def batch_of(records: list[dict]) -> pa.RecordBatch:
            plain = {"run": pa.int64(), "whole": pa.bool_(), **dict.fromkeys(_LONGS, pa.int64()), "first_initial": pa.string(), "last_initial": pa.string(), "costs": pa.list_(pa.int64()), "ranks": pa.list_(pa.int32()), "rows": pa.list_(_ROW)}
            return pa.RecordBatch.from_pylist(records, schema=pa.schema([("conv_id", kind_of), *plain.items()]))

        for batch in batches:
            kind_of = batch.schema.field("conv_id").type
            for conv, turn, role, key, kind, text, n in zip(*(batch.column(x).to_pylist() for x in (*keys, "kind", "text", "n")), strict=True):
                if run is None or conv != run.conv:
                    if run is not None:
                        out.append({"conv_id": run.conv, **run.record(True)})
                        held += run.bytes + 200 * len(run.rows)
                    number += 1
                    run = _Run(conv, number)
                if kind == 0:
                    run.opens = True
                elif kind == 1:
                    pending = turn, role, key
                else:
                    run.add(turn, role, text, n, pending == (turn, role, key))
                    pending = None
                    if len(run.rows) >= run_rows or run.bytes >= RUN_BYTES:
                        out.append({"conv_id": run.conv, **run.record(False)})
                        held += run.bytes + 200 * len(run.rows)
                        number += 1
                        run = _Run(conv, number)
                if held >= RUN_BYTES:
                    yield batch_of(out)
                    out, held = [], 0
        if run is not None:
            out.append({"conv_id": run.conv, **run.record(False)})
        if out:
            yield batch_of(out)

    return placed.mapInArrow(cut, schema)


_CHOSEN = "blank long, duplicate long, truncated long, illegal long, gaps long, cost long, path array<struct<run: long, entry: int, left: int, last: boolean>>"


def _stitch(runs: pa.Table) -> pa.Table:
    """Join the runs of one conversation: its counts, its least cost, and each run's states before and after."""
    costs, ranks, steps = [0, *[_NEVER] * 3], [0, 9, 9, 9], []
    sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    turns, initial, low, high, last = 0, None, None, None, None
    for x in sorted(runs.to_pylist(), key=lambda y: y["run"]):
        for k in sums:
            sums[k] += x[k]
        if x["n_rows"]:
            if initial is not None:
                sums["illegal"] += initial + x["first_initial"] not in ("su", "ua", "au")
            initial = x["last_initial"]
        if x["first_turn"] is not None:
            turns += x["turns"] - (last == x["first_turn"])
            low, high, last = x["min_turn"] if low is None else low, x["max_turn"], x["last_turn"]
        prices, places = x["costs"], x["ranks"]
        entries = [e for e in range(len(prices) // 4) if costs[e] < _NEVER]
        best = [min(((costs[e] + prices[4 * e + q], ranks[e], places[4 * e + q], e) for e in entries if prices[4 * e + q] < _NEVER), default=None) for q in range(4)]
        order = {y: i for i, y in enumerate(sorted(y[1:3] for y in best if y))}
        costs = [y[0] if y else _NEVER for y in best]
        ranks = [order[y[1:3]] if y else 9 for y in best]
        steps.append((x["run"], [y[3] if y else 0 for y in best]))
    cost, state = _closed(costs, ranks)
    path = []
    for i, (run, before) in enumerate(steps[::-1]):
        path.append({"run": run, "entry": before[state], "left": state, "last": i == 0})
        state = before[state]
    gaps = 0 if low is None else high - low + 1 - turns
    step = pa.struct([("run", pa.int64()), ("entry", pa.int32()), ("left", pa.int32()), ("last", pa.bool_())])
    row = {**sums, "gaps": gaps, "cost": cost, "path": path[::-1]}
    fields = [("conv_id", runs.schema.field("conv_id").type), *((k, pa.list_(step) if k == "path" else pa.int64()) for k in row)]
    return pa.Table.from_pylist([{"conv_id": runs.column("conv_id")[0].as_py(), **row}], schema=pa.schema(fields))


def _decided(turns: DataFrame, present: str | None, run_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Whole runs, runs of conversations in several parts with the states chosen for them, and these conversations' counts."""
    runs = materialize(conversation_runs(turns, present, run_rows), "runs")
    parts = runs.where("not whole")
    kind = turns.select("conv_id").schema.fields[0]
    chosen = StructType([kind, *turns.sparkSession.createDataFrame([], _CHOSEN).schema.fields])
    stitched = materialize(parts.drop("rows").groupBy("conv_id").applyInArrow(_stitch, chosen), "stitched")
    path = materialize(stitched.select(F.explode("path").alias("p")).select("p.*"), "path")
    return runs.where("whole"), parts.join(small_enough(path, 32), "run"), stitched.drop("path")


def _rendered(row: dict, whole: bool) -> tuple[str, list[tuple[str, str]], int]:
    """Audit, remaining turns and cost of a run in its chosen states."""
    entry = START if whole else row["entry"]
    walk = _Walk(row["rows"], entry)
    cost, state = _closed([walk.cost(q) for q in range(4)], walk.ranks) if whole else (0, row["left"])
    audit, turns = walk.edits(state)
    if whole or row["last"]:
        audit, turns = audit + "I" * _CLOSING[state], turns + _closing(state)
    return audit, turns, cost


def repaired_turns(turns: DataFrame, present: str | None = None, run_rows: int = RUN_ROWS) -> DataFrame:
    """(conv_id, run, place, role, text): the turns of every repaired conversation, in the order of (run, place)."""
    whole, parts, _ = _decided(turns, present, run_rows)
    kind = turns.select("conv_id").schema.fields[0]
    schema = StructType([kind, *turns.sparkSession.createDataFrame([], "run long, place int, role string, text string").schema.fields])

    def render(is_whole: bool):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    _, kept, _ = _rendered(row, is_whole)
                    fields = [("conv_id", batch.schema.field("conv_id").type), ("run", pa.int64()), ("place", pa.int32()), ("role", pa.string()), ("text", pa.string())]
                    yield pa.RecordBatch.from_pylist([{"conv_id": row["conv_id"], "run": row["run"], "place": j, "role": r, "text": t} for j, (r, t) in enumerate(kept)], schema=pa.schema(fields))

        return go

    return whole.mapInArrow(render(True), schema).unionByName(parts.mapInArrow(render(False), schema))


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_conversations(turns: DataFrame, present: str | None = None, run_rows: int = RUN_ROWS) -> DataFrame:
    """The faults of every conversation and its cheapest repair: one row a conv_id (null is one of its own).

    Rows (conv_id, turn, role, text) come in order of turn, null first; rows of one turn by role and then the
    SHA-256 of the text, equal ones side by side. A null role or text counts as one space. A row is blank without a character
    that isn't white space (\\x20, \\x09-\\x0D), else a duplicate if its role and text have come before, else truncated if its last such
    character is none of `.!?`. The repair keeps turns (cost 0), gives them the role user or assistant (2), deletes them (3, a must for blank and duplicate rows)
    or inserts empty ones (2), one more for each truncated turn that stays, so that the initials of the roles read (s?(ua)+)?; of
    equally cheap ones that of the least audit (K, R, D, I in order). gaps counts missing turn numbers, illegal the adjacent rows whose
    initials are none of su, ua, au.

    A conversation is read in runs of at most `run_rows` rows, wherever they lie; each run gives a table of least costs
    between states, the tables of a conversation are joined in order, and only then are the chosen edits of each run
    written out. The digest of a conversation in several runs is taken over its pieces as they stream by, as a SHA-256 can't be
    taken in parts. Rows whose column `present` isn't true are left out, but their conversation gets its row. Empty tables give no rows; other columns play no part.
    """
    spark = turns.sparkSession
    whole, parts, stitched = _decided(turns, present, run_rows)
    kind = turns.select("conv_id").schema.fields[0]
    schema = StructType([kind, *spark.createDataFrame([], _RESULT).schema.fields])
    names = [x.split()[0] for x in _RESULT.split(", ")]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                audit, kept, cost = _rendered(row, True)
                gaps = 0 if row["min_turn"] is None else row["max_turn"] - row["min_turn"] + 1 - row["turns"]
                digest = hashlib.sha256(b"\n".join(_lines(kept))).hexdigest()
                out.append({"conv_id": row["conv_id"], "gaps": gaps, **{k: row[k] for k in names[1:5]}, "cost": cost, "audit": audit, "repaired_sha256": digest})
            fields = [("conv_id", batch.schema.field("conv_id").type), *((x, pa.int64()) for x in names[:6]), ("audit", pa.string()), ("repaired_sha256", pa.string())]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(fields))

    def piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                audit, kept, _ = _rendered(row, False)
                fields = [("conv_id", batch.schema.field("conv_id").type), ("run", pa.int64()), ("audit", pa.string()), ("lines", pa.int64()), ("body", pa.binary())]
                yield pa.RecordBatch.from_pylist([{"conv_id": row["conv_id"], "run": row["run"], "audit": audit, "lines": len(kept), "body": b"\n".join(_lines(kept))}], schema=pa.schema(fields))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, lines, sha, seen, kind_of = None, [], 0, hashlib.sha256(), False, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"conv_id": conv, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], schema=pa.schema([("conv_id", kind_of), ("audit", pa.string()), ("repaired_sha256", pa.string())]))

        for batch in batches:
            kind_of = batch.schema.field("conv_id").type
            for x in batch.to_pylist():
                if seen and x["conv_id"] != conv:
                    yield done()
                    audit, lines, sha = [], 0, hashlib.sha256()
                conv, seen = x["conv_id"], True
                audit.append(x["audit"])
                if x["lines"]:
                    sha.update(b"\n" * (lines > 0) + x["body"])
                    lines += x["lines"]
        if seen:
            yield done()

    pieces = parts.select("conv_id", "run", "rows", "entry", "left", "last").mapInArrow(piece, StructType([kind, *spark.createDataFrame([], "run long, audit string, lines long, body binary").schema.fields]))
    digests = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "run").mapInArrow(digest, StructType([kind, *spark.createDataFrame([], "audit string, repaired_sha256 string").schema.fields]))
    digests = digests.withColumnRenamed("conv_id", "__conv")
    joined = stitched.join(digests, F.col("conv_id").eqNullSafe(F.col("__conv")))
    return whole.drop("costs", "ranks").mapInArrow(settle, schema).unionByName(joined.select("conv_id", *names))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32 of "conv_id:turn" modulo 20: 0 drops the row, 1 empties its text, 2 takes `.!?` from it, 3 repeats it, 4 makes it the user's.

    A null anywhere is one space, but conv_id and turn stay null. A dropped row stays as one that isn't `present`, which only names its conversation.
    """
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    case = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    text = F.when(case == 1, F.lit("")).when(case == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(case == 4, F.lit("user")).otherwise(role)
    copies = F.when(case == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(case != 0))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("present"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")), "present")
