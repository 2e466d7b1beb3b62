"""Token ids as Arrow files of equal-length sequences: fixed-size-list batches and masks.

Documents are dealt by ranges of their ids and sorted, every task writes one file. A file holds
record batches with two fixed-size lists: ``ids`` (unsigned 16 or 32 bits, whichever holds the
vocabulary) and ``mask`` (false only in the padding that fills a file's last sequence). The
lists have no gaps, so a memory-mapped file gives any sequence as a view, at its number times
its length. A second file beside it lists the documents (doc_id, start in the file, n_tokens).

Files are written under a name of their own attempt and are valid once listed by the task's
result row, so repeated or speculative tasks do no harm.

Defined results: null and empty texts have the end id alone; equal and null ids (null first)
are ordered by their text, then by nothing but the rows being equal; an empty table gives no
files and no rows; further columns don't take part.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm.shared import WHITE_SPACE, fresh_path
from quillon.session import written

LENGTH = 2048
BATCH_SEQUENCES = 512
END_ID = 1
# A task's memory of words already encoded, at most.
KNOWN_WORDS = 400_000
WORD_CHARS = 200
_SPACES = str.maketrans(dict.fromkeys(WHITE_SPACE, " "))
# What str.split takes for white space and the library doesn't.
_NOT_SPACES = ("\x1c", "\x1d", "\x1e", "\x1f")


# The library's split of a lower-case word, and its spelling of bytes as characters.
PART = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{L}\p{N}]+")
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_HIDDEN = [b for b in range(256) if b not in _PRINTED]
SPELLING = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}
# Below this character every letter is composed, and lower case goes letter by letter.
LATIN_END = "\u0250"


class Encoder(dict):
    """Ids of whole texts, for a tokenizer that drops white space and never joins across it.

    The dictionary itself is the memory of words: a missing word is encoded on the spot. Words of
    Latin letters go to the merging model directly, split and spelt in bytes as the library does
    before it; all others, and all that might hold a special string, go through the library.
    """

    def __init__(self, vocabulary: str) -> None:
        super().__init__()
        self.model = Tokenizer.from_file(vocabulary)
        self.model.no_truncation()
        self.model.no_padding()
        size = self.model.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.code = "<%d" + ("H" if self.kind.itemsize == 2 else "I")
        self.merge = self.model.model.tokenize
        self.special = {t.content[0] for t in self.model.get_added_tokens_decoder().values()}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        plain = part.isascii() and part.isprintable()
        spelt = part if plain else "".join(map(SPELLING.__getitem__, part.encode()))
        ids = [token.id for token in self.merge(spelt)]
        made = struct.pack(self.code % len(ids), *ids)
        if len(part) <= WORD_CHARS:
            if len(self.parts) >= KNOWN_WORDS:
                self.parts.clear()
            self.parts[part] = made
        return made

    def __missing__(self, word: str) -> bytes:
        if max(word) < LATIN_END and self.special.isdisjoint(word):
            known = self.parts
            made = b"".join([known.get(p) or self._part(p) for p in PART.findall(word.lower())])
        else:
            ids = self.model.encode(word, add_special_tokens=False).ids
            made = struct.pack(self.code % len(ids), *ids)
        if len(word) <= WORD_CHARS:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = made
        return made

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as bytes of ``kind``."""
        of = self.__getitem__
        for text in texts:
            if any(c in text for c in _NOT_SPACES):
                words = filter(None, text.translate(_SPACES).split(" "))
            else:
                words = text.split()
            yield b"".join(map(of, words))


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One for each Python worker, whatever the number of tasks it runs."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def _schema(kind: np.dtype, length: int) -> pa.Schema:
    value = pa.from_numpy_dtype(kind)
    return pa.schema(
        [("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))]
    )


def _batch(schema: pa.Schema, ids: np.ndarray, real: int, length: int) -> pa.RecordBatch:
    mask = np.arange(len(ids)) < real
    return pa.RecordBatch.from_arrays(
        [
            pa.FixedSizeListArray.from_arrays(pa.array(ids), length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), length),
        ],
        schema=schema,
    )


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def write_sequences(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    *,
    key: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    end_id: int = END_ID,
) -> DataFrame:
    """Writes the files and returns one row for each: order, file, documents, tokens."""
    rows = docs.select(docs[key].cast("bigint").alias("doc_id"), docs[text].alias("text"))
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()
    )

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(vocabulary)
        schema = _schema(model.kind, length)
        end = np.array([end_id], model.kind).tobytes()
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        order = TaskContext.get().partitionId()
        name = f"{folder}/{order:06d}-{uuid.uuid4().hex}"
        sink = writer = index_sink = index = None
        waiting, total, documents = bytearray(), 0, 0
        block = BATCH_SEQUENCES * length * model.kind.itemsize
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                sink = store.open_output_stream(f"{name}.arrow")
                writer = pa.ipc.new_file(sink, schema)
                index_sink = store.open_output_stream(f"{name}.index.arrow")
                index = pa.ipc.new_file(index_sink, INDEX)
            ids_of = list(model.texts([t or "" for t in batch.column(1).to_pylist()]))
            counts = np.array([len(ids) // model.kind.itemsize + 1 for ids in ids_of])
            starts = total + np.cumsum(counts) - counts
            index.write_batch(
                pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())],
                    schema=INDEX,
                )
            )
            total += int(counts.sum())
            documents += batch.num_rows
            for ids in ids_of:
                waiting += ids
                waiting += end
                while len(waiting) >= block:
                    full = np.frombuffer(bytes(waiting[:block]), model.kind)
                    del waiting[:block]
                    writer.write_batch(_batch(schema, full, len(full), length))
        if writer is None:
            return
        if waiting:
            last = np.frombuffer(bytes(waiting), model.kind)
            filled = np.zeros(-(-len(last) // length) * length, model.kind)
            filled[: len(last)] = last
            writer.write_batch(_batch(schema, filled, len(last), length))
        writer.close()
        sink.close()
        index.close()
        index_sink.close()
        yield pa.RecordBatch.from_pydict(
            {"order": [order], "file": [name], "documents": [documents], "tokens": [total]},
            schema=pa.schema(
                [
                    ("order", pa.int32()),
                    ("file", pa.string()),
                    ("documents", pa.int64()),
                    ("tokens", pa.int64()),
                ]
            ),
        )

    return dealt.mapInArrow(body, "order int, file string, documents bigint, tokens bigint")


def sequence(path: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence ``number`` of a local file and its mask, without copying the ids."""
    reader = pa.ipc.open_file(pa.memory_map(path))
    batch = reader.get_batch(number // BATCH_SEQUENCES)
    row = number % BATCH_SEQUENCES
    ids, mask = batch.column("ids"), batch.column("mask")
    length = ids.type.list_size
    return (
        ids.values.slice((ids.offset + row) * length, length).to_numpy(),
        mask.values.slice((mask.offset + row) * length, length).to_numpy(zero_copy_only=False),
    )


def read_documents(files: DataFrame, path: str) -> DataFrame:
    """doc_id, start over all files, n_tokens, ids_crc32 of each document, from the files.

    A task reads one file, batch by batch; only the files' totals are summed across tasks.
    """
    # One row for each written file: the running sum needs no more than a number of each.
    before = Window.orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    listed = files.select(
        "file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before")
    ).repartition(max(1, files.count()))
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("start", pa.int64()),
            ("n_tokens", pa.int64()),
            ("ids_crc32", pa.int64()),
        ]
    )

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, before_file in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True
            ):
                yield from _read_file(file, before_file)

    def _read_file(file: str, before_file: int) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(path)
        with (
            store.open_input_file(f"{file}.arrow") as source,
            store.open_input_file(f"{file}.index.arrow") as index_source,
        ):
            reader, index = pa.ipc.open_file(source), pa.ipc.open_file(index_source)
            held, held_from, at = np.zeros(0, np.uint32), 0, 0
            for number in range(index.num_record_batches):
                docs = index.get_batch(number)
                starts = docs.column("start").to_numpy()
                counts = docs.column("n_tokens").to_numpy()
                sums = []
                for start, count in zip(starts.tolist(), counts.tolist(), strict=True):
                    parts = [held[start - held_from :]]
                    have = len(parts[0])
                    while have < count:
                        batch = reader.get_batch(at)
                        at += 1
                        ids = batch.column("ids").flatten().to_numpy()
                        mask = batch.column("mask").flatten().to_numpy(zero_copy_only=False)
                        parts.append(ids[mask])
                        have += len(parts[-1])
                    if len(parts) > 1:
                        held, held_from = np.concatenate(parts), start
                    own = held[start - held_from : start - held_from + count]
                    sums.append(zlib.crc32(own.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [
                        docs.column("doc_id"),
                        pa.array(starts + before_file, pa.int64()),
                        docs.column("n_tokens"),
                        pa.array(sums, pa.int64()),
                    ],
                    schema=schema,
                )

    return listed.mapInArrow(
        body, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def documents_through_files(
    docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Writes ``docs`` to a new folder under the shared one and reads them back."""
    path = fresh_path(docs.sparkSession, "sequences")
    files = written(write_sequences(docs, path, vocabulary, key=key, text=text), "files")
    return read_documents(files, path)
