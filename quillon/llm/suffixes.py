"""Repeated byte strings across documents, by fingerprints of sampled positions in three rounds.

Every byte covered by a string of ``LENGTH`` bytes that also starts in a document with a smaller
id is removed. This stands in for prefix doubling: positions aren't sorted or ranked anew until
they are unique. Positions carry a fingerprint of their first bytes (called rank here), a shuffle
brings equal ones together, those found once leave, the others are told apart by longer strings
in two more rounds. 64-bit fingerprints need no numbering across tasks; equal means equal
fingerprints, the bytes aren't compared.

* Round 1 ranks ``HEAD`` bytes. Only sampled positions take part: of the positions inside each
  string of ``LENGTH`` bytes, the one with the smallest rank (an anchor). Equal strings have equal
  anchors, so a string whose anchor is found once is found once itself.
* Round 2 ranks what lies around an anchor, ranks at offsets -d, 0 and +d with d = LENGTH - HEAD:
  all strings that hold the anchor. Equal surroundings are settled by their smallest document;
  so is an anchor whose surroundings are the same everywhere.
* Round 3 ranks the strings themselves, pairs of ranks at 0 and +d, where surroundings differ,
  once for each kind of surroundings.

Texts never move after they have been packed into batches in the shared folder: a round sends
sorted distinct keys (for each batch and key range one row) and gets verdicts back in the same
order, stored by batch. Each text is hashed again in each round instead of being shuffled.

Defined results: null text is empty; texts shorter than ``LENGTH`` lose nothing; a null id counts
as smaller than all others; rows with equal ids never remove from each other, unless ``row``
names a column of numbers that orders them; matches never cross rows; an empty table gives no
rows; further columns are kept, result columns replace those of the same name. A task holds about 30 times a batch's bytes (or the longest text's).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillon.llm.shared import fresh_path

LENGTH = 50
HEAD = 26
BATCH_BYTES = 3 << 20
RANGE_BYTES = 24 << 20
BLOCK = 1 << 17
SENT_BITS = 36
NO_ID = -(1 << 63)
U64 = np.uint64


# --- ranks of all positions of a buffer ---------------------------------------------------------

_MULTIPLY = U64(0x9E3779B97F4A7C15)
_SECOND = U64(0xC2B2AE3D27D4EB4F)


def _letters() -> np.ndarray:
    """A fixed random number for each byte value."""
    state = np.arange(1, 257, dtype=U64) * _MULTIPLY
    for shift in (30, 27, 31):
        state = (state ^ (state >> U64(shift))) * _SECOND
    return state


LETTERS = _letters()


def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The rank of a pair of ranks."""
    out = left * _MULTIPLY
    out ^= out >> U64(32)
    out += right
    out *= _SECOND
    out ^= out >> U64(29)
    return out


def ranks(data: np.ndarray, width: int) -> np.ndarray:
    """Ranks of all strings of ``width`` bytes: doubled, and a last step that overlaps."""
    rank, have = LETTERS[data], 1
    while have < width:
        step = min(have, width - have)
        rank = paired(rank[: len(rank) - step], rank[step:])
        have += step
    return rank


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each run of ``width`` values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = pick(values[: len(values) - step], values[step:])
        have += step
    return values


@dataclass
class Positions:
    """Texts of a batch as one buffer, with ranks, least ranks of strings, and anchors."""

    starts: np.ndarray  # of each text
    ends: np.ndarray
    ids: np.ndarray  # of each text
    rows: np.ndarray  # orders texts with equal ids; 0 where they are one
    rank: np.ndarray  # of HEAD bytes at each position
    least: np.ndarray  # the least rank inside the string at each position; 0 where none fits
    anchors: np.ndarray
    text_of: np.ndarray  # of each anchor

    @property
    def keys(self) -> np.ndarray:
        return self.rank[self.anchors]


def positions(
    texts: list[bytes], ids: np.ndarray, rows: np.ndarray, length: int, head: int
) -> Positions:
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    n, inner = len(data), length - head + 1
    rank, least = np.zeros(n, U64), np.zeros(n, U64)
    fits = np.zeros(n + 1, np.int8)
    long = sizes >= length
    np.add.at(fits, starts[long], 1)
    np.add.at(fits, ends[long] - length + 1, -1)
    fits = np.cumsum(fits[:n], dtype=np.int8).astype(bool)
    found = []
    for low in range(0, n, BLOCK):
        high = min(n, low + BLOCK)
        # Ranks from the first string that could hold a position of the block to the last.
        left = max(0, low - inner + 1)
        right = min(n, high + length - 1)
        own = ranks(data[left:right], head) if right - left >= head else np.zeros(0, U64)
        rank[left : left + len(own)] = own
        smallest = sliding(own, inner, np.minimum) if len(own) >= inner else np.zeros(0, U64)
        smallest = np.where(fits[left : left + len(smallest)], smallest, U64(0))
        least[left : left + len(smallest)] = smallest
        # A position is an anchor if it is the least of some string that holds it.
        framed = np.zeros(high - left + inner - 1, U64)
        framed[inner - 1 : inner - 1 + min(len(smallest), high - left)] = smallest[: high - left]
        best = sliding(framed, inner, np.maximum)[low - left : high - left]
        here = np.nonzero((best == rank[low:high]) & (best > 0))[0]
        found.append(here + low)
    anchors = np.concatenate(found) if found else np.zeros(0, np.int64)
    text_of = np.searchsorted(ends, anchors, side="right")
    return Positions(starts, ends, ids, rows, rank, least, anchors, text_of)


def least_first(
    ids: np.ndarray, rows: np.ndarray, *keys: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """An order by the last key, then the others, id and row; where keys change in it."""
    order = np.lexsort((rows, ids, *keys))
    new = np.ones(len(order), bool)
    new[1:] = False
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    return order, new


def later(ids: np.ndarray, rows: np.ndarray, smallest: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which documents come after the smallest one."""
    return (ids > smallest) | ((ids == smallest) & (rows > first))


# --- packing and side files --------------------------------------------------------------------


def _pack(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
    with pa.ipc.new_stream(sink, rows.schema, options=options) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpack(blob: bytes | pa.Buffer) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _arrays(**columns: np.ndarray) -> bytes:
    return _pack(pa.table({k: pa.array(v) for k, v in columns.items()}))


def pack_batches(docs: DataFrame, text: str, path: str, size_limit: int = BATCH_BYTES) -> DataFrame:
    """Rows in batches of about ``size_limit`` bytes of text: batch, blob."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        waiting: list[pa.RecordBatch] = []
        size = number = 0

        def full() -> pa.RecordBatch:
            nonlocal waiting, size, number
            blob = _pack(pa.Table.from_batches(waiting))
            waiting, size, number = [], 0, number + 1
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 24) + number], pa.int64()), pa.array([blob], pa.binary())],
                names=["batch", "blob"],
            )

        for batch in batches:
            at = batch.schema.get_field_index(text)
            lengths = pa.compute.binary_length(batch.column(at)).fill_null(0).to_numpy()
            first = 0
            for row, n in enumerate(lengths.tolist()):
                size += n
                if size >= size_limit:
                    waiting.append(batch.slice(first, row + 1 - first))
                    first = row + 1
                    yield full()
            if first < batch.num_rows:
                waiting.append(batch.slice(first))
        if waiting:
            yield full()

    packed = docs.mapInArrow(body, "batch bigint, blob binary")
    # The blobs are compressed already.
    packed.write.option("compression", "uncompressed").parquet(path)
    return docs.sparkSession.read.schema("batch bigint, blob binary").parquet(path)


def _side(path: str, batch: int) -> dict[int, pa.Table]:
    """What a round has stored for a batch: a table for each key range."""
    store, folder = fs.FileSystem.from_uri(f"{path}/batch={batch}")
    listed = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    found: dict[int, pa.Table] = {}
    for info in listed:
        if info.base_name.endswith(".parquet"):
            with store.open_input_file(info.path) as file:
                rows = pq.ParquetFile(file).read(columns=["part", "blob"])
            for part, blob in zip(rows["part"].to_pylist(), rows["blob"].to_pylist(), strict=True):
                found[part] = _unpack(blob)
    return found


def _verdicts(path: str, batch: int, name: str) -> np.ndarray:
    """A column of a round's verdicts, in the order of the batch's sorted keys."""
    found = _side(path, batch)
    parts = [found[p][name].to_numpy() for p in sorted(found)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


# --- the rounds --------------------------------------------------------------------------------


class Rounds:
    """What each round sends from a batch, and how its verdicts are read.

    ``parts`` key ranges: a key's upper bits choose its range.
    """

    def __init__(
        self, text: str, key: str, length: int, head: int, bits: int, row: str | None = None
    ) -> None:
        self.text, self.key, self.row = text, key, row
        self.length, self.head, self.bits = length, head, bits
        self.step = length - head
        self.paths: list[str] = []

    def rows(self, blob: bytes) -> pa.Table:
        return _unpack(blob)

    def positions(self, rows: pa.Table) -> Positions:
        texts = [(t or "").encode() for t in rows[self.text].to_pylist()]
        ids = rows[self.key].cast(pa.int64()).fill_null(NO_ID).to_numpy()
        of_row = np.zeros(len(ids), np.int64)
        if self.row is not None:
            of_row = rows[self.row].cast(pa.int64()).to_numpy()
        return positions(texts, ids, of_row, self.length, self.head)

    def told(self, ids: np.ndarray, rows: np.ndarray) -> dict[str, np.ndarray]:
        """What is sent of a document."""
        return {"id": ids} if self.row is None else {"id": ids, "row": rows}

    def smallest(self, at: int, batch: int) -> tuple[np.ndarray, np.ndarray]:
        """Id and row of the smallest documents that a round has stored for a batch."""
        ids = _verdicts(self.paths[at], batch, "smallest")
        if self.row is None:
            return ids, np.zeros(len(ids), np.int64)
        return ids, _verdicts(self.paths[at], batch, "first")

    def split(self, keys: np.ndarray) -> np.ndarray:
        """Where each key range begins among sorted keys."""
        edges = np.arange(1, 1 << self.bits, dtype=U64) << U64(64 - self.bits)
        return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])

    # Round 1: anchors by rank.

    def first(self, batch: int, at: Positions) -> dict[str, np.ndarray]:
        ids, rows = at.ids[at.text_of], at.rows[at.text_of]
        order, new = least_first(ids, rows, at.keys)
        keys, ids, rows = at.keys[order], ids[order], rows[order]
        begins = np.nonzero(new)[0]
        last = np.append(begins[1:], len(keys)) - 1
        many = (ids[begins] != ids[last]) | (rows[begins] != rows[last])
        return {"key": keys[begins], "many": many}

    def shorten(self, sent: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Keys of a range cut to their next ``SENT_BITS`` bits, as steps between neighbours.

        Two ranks that agree in these bits only cost a candidate; later rounds use whole ranks.
        """
        short = (sent["key"] << U64(self.bits)) >> U64(64 - SENT_BITS)
        step = np.diff(short, prepend=U64(0))
        return sent | {"key": step.astype(np.uint32) if step.max() < 1 << 32 else step}

    @staticmethod
    def judge_first(sent: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Is the rank found in two documents?"""
        _, back, times = np.unique(sent["key"], return_inverse=True, return_counts=True)
        many = np.zeros(len(times), bool)
        np.logical_or.at(many, back[sent["many"]], True)
        return {"shared": (many | (times > 1))[back]}

    def shared(self, batch: int, at: Positions) -> Positions:
        """``at`` with the anchors only whose rank is found in two documents."""
        keys = np.unique(at.keys)
        verdict = _verdicts(self.paths[0], batch, "shared").astype(bool)
        if not len(keys):
            return at
        keep = verdict[np.searchsorted(keys, at.keys)]
        return Positions(
            at.starts,
            at.ends,
            at.ids,
            at.rows,
            at.rank,
            at.least,
            at.anchors[keep],
            at.text_of[keep],
        )

    # Round 2: anchors by surroundings.

    def around(self, at: Positions) -> np.ndarray:
        """Rank of all that lies within ``step`` of an anchor, as far as its text reaches."""
        a, start, end = at.anchors, at.starts[at.text_of], at.ends[at.text_of]
        left = np.minimum(self.step, a - start)
        right = np.minimum(self.step, end - (a + self.head))
        reach = (left * (self.step + 1) + right).astype(U64)
        return paired(
            paired(at.rank[a - left], at.rank[a]), paired(at.rank[a + right], reach * _MULTIPLY)
        )

    def second(self, batch: int, at: Positions) -> dict[str, np.ndarray]:
        at = self.shared(batch, at)
        key, around = at.keys, self.around(at)
        ids, rows = at.ids[at.text_of], at.rows[at.text_of]
        order, new = least_first(ids, rows, around, key)
        own = order[new]
        return {"key": key[own], "around": around[own]} | self.told(ids[own], rows[own])

    @staticmethod
    def judge_second(sent: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The smallest document of the surroundings; do the anchor's surroundings differ?"""
        key, around, ids = sent["key"], sent["around"], sent["id"]
        rows = sent.get("row", np.zeros(len(ids), np.int64))
        order, new = least_first(ids, rows, around, key)
        k = key[order]
        new_key = np.ones(len(k), bool)
        new_key[1:] = k[1:] != k[:-1]
        kind = np.cumsum(new) - 1
        anchor = np.cumsum(new_key) - 1
        kinds = np.bincount(anchor[new], minlength=1) if len(k) else np.zeros(1, np.int64)
        best, differ = np.empty(len(k), np.int64), np.empty(len(k), bool)
        best[order] = order[new][kind]
        differ[order] = (kinds > 1)[anchor]
        first = {"first": rows[best]} if "row" in sent else {}
        return {"smallest": ids[best], "differ": differ} | first

    def settled(self, batch: int, at: Positions) -> tuple[Positions, np.ndarray, np.ndarray]:
        """Shared anchors; which are repeats as they stand, which have strings to be ranked."""
        at = self.shared(batch, at)
        if not len(at.anchors):
            return at, np.zeros(0, bool), np.zeros(0, bool)
        key, around, ids = at.keys, self.around(at), at.ids[at.text_of]
        order = np.lexsort((around, key))
        k, r = key[order], around[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
        row = np.empty(len(k), np.int64)
        row[order] = np.cumsum(new) - 1
        smallest, first = self.smallest(1, batch)
        differ = _verdicts(self.paths[1], batch, "differ").astype(bool)[row]
        repeat = later(ids, at.rows[at.text_of], smallest[row], first[row])
        return at, repeat, differ & ~repeat

    # Round 3: the strings of anchors whose surroundings differ.

    def strings(self, at: Positions, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, text and rank of the strings whose least rank is at an anchor of ``open_``."""
        starts, texts = [], []
        anchors, text_of = at.anchors[open_], at.text_of[open_]
        keys = at.rank[anchors]
        low, high = at.starts[text_of], at.ends[text_of] - self.length
        for back in range(self.step + 1):
            p = anchors - back
            own = (p >= low) & (p <= high)
            own[own] = at.least[p[own]] == keys[own]
            starts.append(p[own])
            texts.append(text_of[own])
        start, text = np.concatenate(starts), np.concatenate(texts)
        return start, text, paired(at.rank[start], at.rank[start + self.step])

    def third(self, batch: int, at: Positions) -> dict[str, np.ndarray]:
        at, _, open_ = self.settled(batch, at)
        _, text, key = self.strings(at, open_)
        ids, rows = at.ids[text], at.rows[text]
        order, new = least_first(ids, rows, key)
        own = order[new]
        return {"key": key[own]} | self.told(ids[own], rows[own])

    @staticmethod
    def judge_third(sent: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        ids = sent["id"]
        rows = sent.get("row", np.zeros(len(ids), np.int64))
        order, new = least_first(ids, rows, sent["key"])
        best = np.empty(len(order), np.int64)
        best[order] = order[new][np.cumsum(new) - 1]
        first = {"first": rows[best]} if "row" in sent else {}
        return {"smallest": ids[best]} | first

    def covered(self, batch: int, at: Positions) -> np.ndarray:
        """True for each byte of the buffer that is to be removed."""
        shared, repeat, open_ = self.settled(batch, at)
        n = len(at.rank)
        change = np.zeros(n + 1, np.int64)
        a, text = shared.anchors[repeat], shared.text_of[repeat]
        first = np.maximum(at.starts[text], a - self.step)
        last = np.minimum(a, at.ends[text] - self.length)
        some = last >= first
        np.add.at(change, first[some], 1)
        np.add.at(change, last[some] + self.length, -1)
        start, text, key = self.strings(shared, open_)
        if len(start):
            keys = np.unique(key)
            place = np.searchsorted(keys, key)
            smallest, first = self.smallest(2, batch)
            start = start[later(at.ids[text], at.rows[text], smallest[place], first[place])]
            np.add.at(change, start, 1)
            np.add.at(change, start + self.length, -1)
        return np.cumsum(change[:n]) > 0


def _send(
    batches: DataFrame, rounds: Rounds, make: Callable[[int, Positions], dict[str, np.ndarray]]
) -> DataFrame:
    """part, batch, blob: the sorted keys of each batch, cut into key ranges."""
    make_small = rounds.shorten if make == rounds.first else dict

    def body(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in rows:
            for batch, blob in zip(
                some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True
            ):
                sent = make(batch, rounds.positions(rounds.rows(blob)))
                cuts = rounds.split(sent["key"])
                parts = [p for p in range(len(cuts) - 1) if cuts[p] < cuts[p + 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(parts, pa.int32()),
                        pa.array([batch] * len(parts), pa.int64()),
                        pa.array(
                            [
                                _arrays(**make_small({k: v[cuts[p] : cuts[p + 1]] for k, v in sent.items()}))
                                for p in parts
                            ],
                            pa.binary(),
                        ),
                    ],
                    names=["part", "batch", "blob"],
                )

    return batches.mapInArrow(body, "part int, batch bigint, blob binary")


def _round(
    batches: DataFrame,
    rounds: Rounds,
    make: Callable[[int, Positions], dict[str, np.ndarray]],
    judge: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]],
    path: str,
) -> None:
    """Sends keys, brings each key range together, stores the verdicts by batch."""

    def body(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, pa.Buffer]] = []
        part = None
        for some in rows:
            blobs = some.column(2)
            for at, (p, batch) in enumerate(
                zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)
            ):
                if held and p != part:
                    yield from _judged(part, held, judge)
                    held = []
                part = p
                held.append((batch, blobs[at].as_buffer()))
        if held:
            yield from _judged(part, held, judge)

    judged = (
        _send(batches, rounds, make)
        # The number is given, so that ranges aren't gathered in tasks of a partition's usual size:
        # a task holds what it reads several times.
        .repartition(2 << rounds.bits, "part")
        .sortWithinPartitions("part", "batch")
        .mapInArrow(body, "part int, batch bigint, blob binary")
    )
    (
        judged.repartition("batch")
        .sortWithinPartitions("batch", "part")
        .write.partitionBy("batch")
        .option("compression", "uncompressed")
        .parquet(path)
    )
    rounds.paths.append(path)


def _judged(
    part: int,
    held: list[tuple[int, pa.Buffer]],
    judge: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]],
) -> Iterator[pa.RecordBatch]:
    tables = [_unpack(blob) for _, blob in held]
    sizes = np.cumsum([0, *(t.num_rows for t in tables)])
    columns = [{name: t[name].to_numpy() for name in t.column_names} for t in tables]
    if judge is Rounds.judge_first:
        columns = [c | {"key": np.cumsum(c["key"], dtype=U64)} for c in columns]
    sent = {name: np.concatenate([c[name] for c in columns]) for name in columns[0]}
    verdict = judge(sent)
    for i, (batch, _) in enumerate(held):
        own = {k: v[sizes[i] : sizes[i + 1]] for k, v in verdict.items()}
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()),
                pa.array([batch], pa.int64()),
                pa.array([_arrays(**own)], pa.binary()),
            ],
            names=["part", "batch", "blob"],
        )


RESULTS = (
    "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string"
)


def remove_repeats(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    head: int = HEAD,
    batch_bytes: int = BATCH_BYTES,
    row: str | None = None,
) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256 and kept_text.

    ``kept_text`` is what is left, without the bytes of a character that was cut apart.
    """
    if not 0 < head <= length <= 2 * head:
        raise ValueError("head must be at least half of length")
    results = T.StructType.fromDDL(RESULTS)
    docs = docs.drop(*results.names)
    base = fresh_path(docs.sparkSession, "repeats")
    batches = pack_batches(docs, text, f"{base}/batches", batch_bytes)
    # Key ranges in step with the data: a range holds the keys of RANGE_BYTES of text.
    ranges = batches.select("batch").count() * batch_bytes // RANGE_BYTES
    bits = max(4, ranges.bit_length())
    rounds = Rounds(text, key, length, head, bits, row)
    _round(batches, rounds, rounds.first, rounds.judge_first, f"{base}/first")
    _round(batches, rounds, rounds.second, rounds.judge_second, f"{base}/second")
    _round(batches, rounds, rounds.third, rounds.judge_third, f"{base}/third")
    declared, names = T.StructType([*docs.schema, *results]), docs.columns
    schema = to_arrow_schema(declared)

    def body(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in rows:
            for batch, blob in zip(
                some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True
            ):
                table = rounds.rows(blob)
                at = rounds.positions(table)
                gone = rounds.covered(batch, at)
                made = [
                    _kept((t or "").encode(), gone[start:end])
                    for t, start, end in zip(
                        table[text].to_pylist(), at.starts, at.ends, strict=True
                    )
                ]
                columns = [table[c].combine_chunks() for c in names]
                for values, field in zip(
                    zip(*made, strict=True), list(schema)[len(columns) :], strict=True
                ):
                    columns.append(pa.array(values, field.type))
                yield from pa.Table.from_arrays(columns, schema=schema).to_batches(1000)

    return batches.mapInArrow(body, declared)


def _kept(data: bytes, gone: np.ndarray) -> tuple[int, int, int, str, str]:
    removed = int(gone.sum())
    if not removed:
        return len(data), 0, 0, hashlib.sha256(data).hexdigest(), data.decode()
    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    left = np.frombuffer(data, np.uint8)[~gone].tobytes()
    return (
        len(data),
        removed,
        spans,
        hashlib.sha256(left).hexdigest(),
        left.decode(errors="ignore"),
    )
