"""Conversation structure repair: the cheapest edits that make the roles of a conversation legal.

Legal role initials are ``(s?(ua)+)?``. A row may be kept (0), re-roled to user or assistant (1) or
deleted (2, the only edit of blank and duplicate rows), an empty user or assistant turn may be put
in anywhere (5), and a truncated row that stays costs 5 more. Among the cheapest edits those with
the least string of initials (D, I, K, R) are taken.

Method (Four Russians): what is left to pay from each of the four states of the legal pattern is a
vector; less its least entry there are only a few dozen such vectors. Tables over all strings of
``BLOCK`` symbols hold, for each vector behind a block, the vector before it, what it adds and
where each state leaves the block. Conversations are processed from their ends by lookup; blocks
are then expanded backward, symbol by symbol, and edits are read off forward. As the vectors are
costs still to pay, taking the least letter that stays cheapest gives the least string, and a
letter fixes the next state, so ties need no search.

Spread over tasks: rows are sorted by ranges of (conversation, turn, role, text) and cut into chunks
of at most ``CHUNK`` rows. A conversation of one chunk is solved alone. A longer one is a tree over
its chunks (``FAN`` sort partitions meet in a node): summaries, the tables' entries for a
whole chunk, go up, and each chunk's vector behind it and its entry state come down. No task
holds a conversation.

Defined results: null roles and texts count as one space; null conversation ids are one
conversation; null turns come first; rows of one turn are ordered by role, then text; equal rows of a
turn are counted, the first is judged and the others are duplicates. A role without characters fits
nowhere. Texts of any length are only compared, trimmed and carried. An empty table gives empty
results. Columns other than the four named ones don't take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.shared import stored
from quillon.scale import join_small

BLOCK = 4
CHUNK = 4096
FAN = 64
# Rows that share a turn, a role and this many first characters are sorted in one task.
RANGE_CHARS = 256

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
SPACES = " \t\n\x0b\x0c\r"

# States of the pattern: nothing yet, after s, after u, after a. Role classes: s, u, a, other.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
OTHER = 3
KEPT_TO = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
# The state that the next legal user or assistant turn leads to; one of each state.
TURN_TO = (USER, USER, ASSISTANT, USER)
# Symbols: 0 fills up a block, 1 must be deleted, 2 + 2 * class + truncated.
PAD, GONE = 0, 1
SYMBOLS = 10


class Step(NamedTuple):
    """One symbol before a vector: the vector before it, and for each state what is done."""

    before: tuple[int, ...]
    adds: int
    edits: tuple[str, ...]
    made: tuple[str, ...]
    leaves: tuple[int, ...]


def _step(symbol: int, after: tuple[int, ...]) -> Step:
    """``made`` tells the turns that come out: u, a put in, U, A re-roled, K kept."""
    if symbol == PAD:
        return Step(after, 0, ("",) * 4, ("",) * 4, (0, 1, 2, 3))
    role, truncated = (None, 0) if symbol == GONE else divmod(symbol - 2, 2)
    extra = CUT_OFF * truncated

    def choices(state: int) -> list[tuple[int, str, str, int]]:
        found = [(DELETE + after[state], "D", "", state)]
        if symbol != GONE:
            if (state, role) in KEPT_TO:
                to = KEPT_TO[state, role]
                found.append((KEEP + extra + after[to], "K", "K", to))
            to = TURN_TO[state]
            found.append((REROLE + extra + after[to], "R", "UA"[to == ASSISTANT], to))
        return found

    cost = [min(c[0] for c in choices(s)) for s in range(STATES)]
    for _ in range(STATES):
        cost = [min(cost[s], INSERT + cost[TURN_TO[s]]) for s in range(STATES)]
    edits, made, leaves = [], [], []
    for state in range(STATES):
        done, out, at = "", "", state
        while True:
            ways = [(w[1], *w) for w in choices(at) if w[0] == cost[at]]
            if cost[at] == INSERT + cost[TURN_TO[at]]:
                ways.append(("I", cost[at], "I", "ua"[TURN_TO[at] == ASSISTANT], TURN_TO[at]))
            _, _, letter, turn, at = min(ways)
            done, out = done + letter, out + turn
            if letter != "I":
                break
        edits.append(done)
        made.append(out)
        leaves.append(at)
    low = min(cost)
    return Step(tuple(c - low for c in cost), low, tuple(edits), tuple(made), tuple(leaves))


# Behind the last row: what the pattern still asks for is put in.
END = (0, 2 * INSERT, INSERT, 0)
TAIL = ("", "ua", "a", "")


class Tables(NamedTuple):
    vectors: list[tuple[int, ...]]
    steps: list[list[Step]]  # by symbol and vector
    before: np.ndarray  # by block and vector
    adds: np.ndarray
    leaves: np.ndarray  # by block, vector and state


@lru_cache(maxsize=1)
def tables() -> Tables:
    known = {END: 0}
    vectors = [END]
    for vector in vectors:
        for symbol in range(SYMBOLS):
            found = _step(symbol, vector).before
            if found not in known:
                known[found] = len(vectors)
                vectors.append(found)
    steps = [[_step(symbol, v) for v in vectors] for symbol in range(SYMBOLS)]
    one_before = np.array([[known[s.before] for s in row] for row in steps])
    one_adds = np.array([[s.adds for s in row] for row in steps])
    one_leaves = np.array([[s.leaves for s in row] for row in steps])

    n = len(vectors)
    codes = np.arange(SYMBOLS**BLOCK)
    before = np.broadcast_to(np.arange(n), (len(codes), n))
    adds = np.zeros((len(codes), n), dtype=np.int64)
    leaves = np.broadcast_to(np.arange(STATES), (len(codes), n, STATES))
    for at in range(BLOCK):  # from the last symbol, the lowest digit, to the first
        symbol = (codes // SYMBOLS**at % SYMBOLS)[:, None]
        adds = adds + one_adds[symbol, before]
        leaves = np.take_along_axis(leaves, one_leaves[symbol, before], axis=2)
        before = one_before[symbol, before]
    return Tables(vectors, steps, before, adds, leaves)


def blocks_of(symbols: list[int]) -> np.ndarray:
    """Block numbers, left to right; the first is filled up on its left."""
    short = -len(symbols) % BLOCK
    padded = np.array([PAD] * short + symbols, dtype=np.int64).reshape(-1, BLOCK)
    return padded @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))


class Summary(NamedTuple):
    """What rows do to every vector that may stand behind them."""

    before: np.ndarray
    adds: np.ndarray
    leaves: np.ndarray


def summary(symbols: list[int]) -> Summary:
    t = tables()
    n = len(t.vectors)
    before, adds = np.arange(n), np.zeros(n, dtype=np.int64)
    leaves = np.broadcast_to(np.arange(STATES), (n, STATES))
    for code in blocks_of(symbols)[::-1]:
        adds = adds + t.adds[code, before]
        leaves = np.take_along_axis(leaves, t.leaves[code, before], axis=1)
        before = t.before[code, before]
    return Summary(before, adds, leaves)


def joined(left: Summary, right: Summary) -> Summary:
    return Summary(
        left.before[right.before],
        right.adds + left.adds[right.before],
        np.take_along_axis(right.leaves, left.leaves[right.before], axis=1),
    )


def traced(symbols: list[int], behind: int, state: int) -> tuple[list[str], list[str], int]:
    """Edits and turns made for each row, and the state the rows leave."""
    t = tables()
    codes = blocks_of(symbols)
    ends = [behind]
    for code in codes[:0:-1]:
        ends.append(int(t.before[code, ends[-1]]))
    known = {v: i for i, v in enumerate(t.vectors)}
    edits, made = [], []
    skip = -len(symbols) % BLOCK
    for at, vector in enumerate(reversed(ends)):
        block = symbols[max(0, at * BLOCK - skip) : (at + 1) * BLOCK - skip]
        inner = [vector]
        for symbol in block[:0:-1]:
            inner.append(known[t.steps[symbol][inner[-1]].before])
        for symbol, after in zip(block, reversed(inner), strict=True):
            step = t.steps[symbol][after]
            edits.append(step.edits[state])
            made.append(step.made[state])
            state = step.leaves[state]
    return edits, made, state


# --- rows, sorted and cut into chunks ----------------------------------------------------------


def conversation_key(conv: Column) -> Column:
    """A name for each conversation; null ids share one that no id has."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def _judged(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Equal rows of a turn as one with their number; the first fault of each, as a symbol."""
    space = F.lit(" ")
    rows = turns.select(
        conversation_key(turns[conv]).alias("conv"),
        turns[turn].cast("bigint").alias("turn"),
        F.coalesce(turns[role], space).alias("role"),
        F.coalesce(turns[text], space).alias("text"),
    )
    rows = stored(
        rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")),
        "repair-rows",
    ).withColumn("said", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256))
    # Where a role and text come again in another turn: the first turn, nulls before all.
    again = (
        rows.groupBy("conv", "said")
        .agg(
            F.count(F.lit(1)).alias("times"),
            F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"),
        )
        .where("times > 1")
        .select("conv", "said", F.struct("first.known", "first.turn").alias("first"))
    )
    rows = join_small(rows, again, ["conv", "said"], ["turn"], how="left")
    bare = F.rtrim("text", F.lit(SPACES))
    blank = bare == ""
    here = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    # Structs with nulls inside: compared by <=>.
    later = F.coalesce(F.col("first").isNotNull() & ~here.eqNullSafe(F.col("first")), F.lit(False))
    cut = ~F.right(bare, F.lit(1)).isin(".", "!", "?")
    initial = F.left("role", F.lit(1))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    symbol = F.when(blank | later, GONE).otherwise(2 + 2 * kind + cut.cast("int"))
    return rows.select(
        "conv", "turn", "role", "text", "copies",
        blank.alias("blank"), kind.alias("kind"), symbol.alias("symbol"),
    )


def _cut(rows: DataFrame, most: int) -> DataFrame:
    """Rows in order with their place: sort partition, chunk in it, position in the chunk."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    nulls_first = F.col("turn").asc_nulls_first()
    ordered = rows.repartitionByRange(
        parts, "conv", nulls_first, "role", F.left("text", F.lit(RANGE_CHARS))
    ).sortWithinPartitions("conv", nulls_first, "role", "text")
    schema = T.StructType(rows.schema.fields)
    for name in ("part", "chunk", "at"):
        schema = schema.add(name, T.LongType())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, at, last = TaskContext.get().partitionId(), -1, 0, None
        for batch in batches:
            chunks, places = [], []
            for conv in batch.column("conv").to_pylist():
                if conv != last or at == most:
                    chunk, at, last = chunk + 1, 0, conv
                chunks.append(chunk)
                places.append(at)
                at += 1
            if not chunks:
                continue
            added = [pa.array([part] * len(chunks), pa.int64()), pa.array(chunks, pa.int64()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *added], names=[*batch.schema.names, "part", "chunk", "at"]
            )

    return ordered.mapInArrow(place, schema)


# --- summaries up, entries down ------------------------------------------------------------------

LEGAL = {(0, 1), (1, 2), (2, 1)}
NODE = (
    "conv string, part bigint, chunk bigint, before array<int>, adds array<bigint>, "
    "leaves array<int>, illegal bigint, first int, last int"
)


def _packed(name: tuple, s: Summary, illegal: int, first: int, last: int) -> tuple:
    return (*name, s.before.tolist(), s.adds.tolist(), s.leaves.ravel().tolist(), illegal, first, last)


def _unpacked(row) -> Summary:
    return Summary(
        np.asarray(row.before), np.asarray(row.adds), np.asarray(row.leaves).reshape(-1, STATES)
    )


def _illegal(kinds: list[int]) -> int:
    return sum(pair not in LEGAL for pair in zip(kinds, kinds[1:], strict=False))


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        rows = []
        for c in frame.itertuples():
            kinds = [m["kind"] for m in c.marks]
            name = (c.conv, c.part, c.chunk)
            s = summary([m["symbol"] for m in c.marks])
            rows.append(_packed(name, s, _illegal(kinds), kinds[0], kinds[-1]))
        yield pd.DataFrame(rows, columns=[f.split()[0] for f in NODE.split(", ")])


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one parent as one; the parent is named by its first column ``up``."""
    frame = frame.sort_values(["part", "chunk"])
    whole = illegal = first = last = None
    for row in frame.itertuples():
        one = _unpacked(row)
        if whole is None:
            whole, illegal, first, last = one, row.illegal, row.first, row.last
        else:
            whole = joined(whole, one)
            illegal += row.illegal + ((last, row.first) not in LEGAL)
            last = row.last
    name = (frame["conv"].iloc[0], frame["up"].iloc[0], 0)
    row = _packed(name, whole, illegal, first, last)
    return pd.DataFrame([row], columns=[f.split()[0] for f in NODE.split(", ")])


ENTRY = "conv string, part bigint, chunk bigint, behind int, state int, final boolean"


def _descend(frame: pd.DataFrame) -> pd.DataFrame:
    """What stands behind each node of a parent, and the state it is entered in."""
    frame = frame.sort_values(["part", "chunk"]).reset_index(drop=True)
    vector, behind = int(frame["behind"].iloc[0]), [0] * len(frame)
    for i in range(len(frame) - 1, -1, -1):
        behind[i] = vector
        vector = int(frame["before"][i][vector])
    state, states = int(frame["state"].iloc[0]), []
    for i in range(len(frame)):
        states.append(state)
        state = int(frame["leaves"][i][behind[i] * STATES + state])
    final = [False] * (len(frame) - 1) + [bool(frame["final"].iloc[0])]
    return frame[["conv", "part", "chunk"]].assign(behind=behind, state=states, final=final)


def _tree(chunks: DataFrame, parts: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """Roots (conv, cost, illegal) and an entry for each chunk, of conversations of several."""
    levels = [stored(chunks.mapInPandas(_summaries, NODE), "repair-nodes")]
    width = 1
    while True:
        up = F.floor(F.col("part") / width).cast("bigint")
        levels.append(
            stored(levels[-1].withColumn("up", up).groupBy("conv", "up").applyInPandas(_merge, NODE), "repair-nodes")
        )
        # The level just made numbers its nodes by ``up``.
        parts = -(-parts // width)
        if parts <= 1:
            break
        width = fan
    t = tables()
    first = F.array(*(F.lit(v[START]) for v in t.vectors))
    roots = levels[-1].select(
        "conv",
        (F.element_at("adds", 1) + F.element_at(first, F.element_at("before", 1) + 1)).alias("cost"),
        "illegal",
    )
    entries = levels[-1].select(
        "conv", "part", F.lit(0).alias("behind"), F.lit(START).alias("state"), F.lit(True).alias("final")
    )
    for depth in range(len(levels) - 2, -1, -1):
        width = 1 if depth == 0 else fan
        child = levels[depth].withColumn("up", F.floor(F.col("part") / width).cast("bigint"))
        above = entries.withColumnRenamed("part", "up")
        entries = stored(
            join_small(child, above, ["conv", "up"], ["part", "chunk"])
            .groupBy("conv", "up")
            .applyInPandas(_descend, ENTRY),
            "repair-entries",
        )
        if depth:
            entries = entries.drop("chunk")
    return roots, entries


# --- the operator --------------------------------------------------------------------------------

EMITTED = "conv string, part bigint, chunk bigint, edits array<string>, made array<string>, cost bigint, illegal bigint"


def _emitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    t = tables()
    for frame in batches:
        rows = []
        for c in frame.itertuples():
            symbols = [m["symbol"] for m in c.marks]
            edits, made, state = traced(symbols, c.behind, c.state)
            if c.final:
                made[-1] += TAIL[state]
                edits[-1] += "I" * len(TAIL[state])
            cost = illegal = None
            if c.alone:
                before, cost = 0, 0
                for code in blocks_of(symbols)[::-1]:
                    cost += int(t.adds[code, before])
                    before = int(t.before[code, before])
                cost += t.vectors[before][START]
                illegal = _illegal([m["kind"] for m in c.marks])
            # Further copies of a row go right behind its first.
            edits = [
                e[: len(e.rstrip("I")) or None] + "D" * (m["copies"] - 1) + e[len(e.rstrip("I")) :]
                if m["copies"] > 1 else e
                for e, m in zip(edits, c.marks, strict=True)
            ]
            rows.append((c.conv, c.part, c.chunk, edits, made, cost, illegal))
        yield pd.DataFrame(rows, columns=[f.split()[0] for f in EMITTED.split(", ")])


class Repaired(NamedTuple):
    """``summary``: one row for each conversation; ``turns``: its turns after repair.

    Both name conversations by ``conversation_key``. Turns are in order of (part, chunk, at, nth).
    """

    summary: DataFrame
    turns: DataFrame


def repair(
    turns: DataFrame,
    *,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    chunk: int = CHUNK,
    fan: int = FAN,
) -> Repaired:
    spark = turns.sparkSession
    rows = stored(_cut(_judged(turns, conv, turn, role, text), chunk), "repair-sorted")
    chunks = stored(
        rows.groupBy("conv", "part", "chunk").agg(
            F.sort_array(F.collect_list(F.struct("at", "symbol", "kind", "copies"))).alias("marks")
        ),
        "repair-chunks",
    )
    several = chunks.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conv", F.lit(True).alias("long"))
    chunks = stored(join_small(chunks, several, ["conv"], ["part", "chunk"], how="left"), "repair-chunks")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    roots, entries = _tree(chunks.where("long"), parts, fan)
    whole = chunks.where("long is null").select(
        "conv", "part", "chunk", "marks", F.lit(0).alias("behind"), F.lit(START).alias("state"),
        F.lit(True).alias("final"), F.lit(True).alias("alone"),
    )
    pieces = join_small(
        chunks.where("long").drop("long"), entries, ["conv", "part", "chunk"], ["part", "chunk"]
    ).withColumn("alone", F.lit(False))
    emitted = stored(
        whole.unionByName(pieces).mapInPandas(_emitted, EMITTED), "repair-edits"
    )
    audits = emitted.groupBy("conv").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("part", "chunk", F.array_join("edits", "").alias("edits")))),
                lambda piece: piece["edits"],
            ),
            "",
        ).alias("audit"),
        F.max("cost").alias("cost"),
        F.max("illegal").alias("illegal"),
    )
    known = F.col("turn").isNotNull()
    more = F.col("copies") - 1
    gone, fine = F.col("symbol") == GONE, F.col("symbol") != GONE
    faults = rows.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(gone, F.col("copies")).otherwise(more)).alias("duplicate"),
        F.sum(F.when(fine & (F.col("symbol") % 2 == 1), 1).otherwise(0)).alias("truncated"),
        F.sum(more).alias("more"),
        F.sum(F.when(known, 1).otherwise(0)).alias("known"),
    )
    found = faults.join(audits, "conv").join(
        roots.select("conv", F.col("cost").alias("root_cost"), F.col("illegal").alias("root_illegal")),
        "conv",
        "left",
    )
    summary_rows = found.select(
        "conv", "gaps", "blank", "duplicate", "truncated",
        (F.coalesce("root_illegal", "illegal") + F.col("more")).alias("illegal"),
        (F.coalesce("root_cost", "cost") + DELETE * F.col("more")).alias("cost"),
        "audit",
    )
    edits = emitted.select(
        "conv", "part", "chunk", F.posexplode("made").alias("at", "made")
    ).where("made <> ''").withColumn("at", F.col("at").cast("bigint"))
    kept = rows.select("conv", "part", "chunk", "at", "turn", "role", "text").join(
        edits, ["conv", "part", "chunk", "at"]
    )
    each = kept.select("*", F.posexplode(F.split("made", "")).alias("nth", "how")).where("how <> ''")
    how = F.lower("how")
    repaired_turns = each.select(
        "conv", "part", "chunk", "at", "nth",
        F.when(F.col("how") == "K", F.col("role")).when(how == "u", "user").otherwise("assistant").alias("role"),
        F.when(F.col("how").isin("u", "a"), "").otherwise(F.col("text")).alias("text"),
    )
    return Repaired(summary_rows, repaired_turns)


def digests(turns: DataFrame) -> DataFrame:
    """conv, repaired_sha256 of ``role:text`` lines, hashed row by row in order.

    A digest over a whole conversation can't be split; its rows pass through one task, none stays.
    """
    order = ["conv", "part", "chunk", "at", "nth"]
    ordered = turns.repartition("conv").sortWithinPartitions(*order)
    lines = ordered.select("conv", F.concat("role", F.lit(":"), "text").alias("line"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        schema = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])
        for batch in batches:
            done = []
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if conv != last:
                    if digest is not None:
                        done.append((last, digest.hexdigest()))
                    last, digest = conv, hashlib.sha256(line.encode())
                else:
                    digest.update(b"\n")
                    digest.update(line.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], schema=schema)
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([digest.hexdigest()])], schema=schema)

    return lines.mapInArrow(hashed, "conv string, repaired_sha256 string")
