"""Token counts from pre-token frequencies: pieces are counted once for each distinct pre-token.

A byte-level BPE never merges across pre-tokens, so a text's count is the sum of its pre-tokens'
counts. One pass gathers the distinct pre-tokens of the corpus; the library counts the pieces of
each once. A second pass turns every text into pre-token frequencies, joins them to the counts
and sums. Ids are never kept. The most frequent pre-tokens (a bounded number) reach the tasks as
a broadcast table, the others by a shuffle join; both ways give the same sums.

Defined results: null and empty texts have 0 bytes and 0 tokens; ids may be null or repeated,
each row is counted alone; an empty table gives no rows; further columns don't take part.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm.shared import WHITE_SPACE, stored

# At most so many pre-tokens, of at most so many characters, are sent to every task.
BROADCAST_TOKENS = 100_000
BROADCAST_CHARS = 64
# A worker's memory of words already split: at most twice so many.
KNOWN_WORDS = 250_000
WORD_CHARS = 200
PIECES_BATCH = 2_000
ROWS_AT_ONCE = 500
# Distinct pre-tokens that a task holds before it passes them on, and little more.
GATHERED = 200_000

_S = regex.escape(WHITE_SPACE, special_only=False)
# Fixed value: the split of byte-level BPE, with the library's idea of white space.
PRE_TOKEN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)


# A space beside white space.
TOUCHING = tuple({pair for c in WHITE_SPACE for pair in (f" {c}", f"{c} ")})


class PreTokens:
    """Pre-token frequencies of a text, special strings included as pre-tokens of their own."""

    def __init__(self, vocabulary: str) -> None:
        with open(vocabulary, encoding="utf-8") as file:
            added = json.load(file)["added_tokens"]
        self.special = {t["content"] for t in added}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")")
        # Words met lately, and those met before them.
        self.known: dict[str, tuple[str, ...] | None] = {}
        self.older: dict[str, tuple[str, ...] | None] = {}

    def _word(self, word: str) -> tuple[str, ...] | None:
        """The pre-tokens of a space and ``word``; None if white space touches its ends."""
        if word in self.older:
            found = self.older[word]
        elif not word or word[0] in WHITE_SPACE or word[-1] in WHITE_SPACE:
            found = None
        else:
            found = tuple(PRE_TOKEN.findall(f" {word}"))
        if len(word) <= WORD_CHARS:
            if len(self.known) >= KNOWN_WORDS:
                self.older, self.known = self.known, {}
            self.known[word] = found
        return found

    def words(self, text: str) -> tuple[str, list[str]] | None:
        """The text up to its first space and the words behind its spaces, if it can be cut there.

        It can if no space touches other white space or the ends and no special string occurs.
        """
        if any(pair in text for pair in TOUCHING) or any(s in text for s in self.special):
            return None
        first, *words = text.split(" ")
        return (first, words) if first and (not words or words[-1]) else None

    def tokens(self, word: str) -> tuple[str, ...]:
        """The pre-tokens of a space and a word out of ``words``."""
        found = self.known.get(word)
        return self._word(word) if found is None else found

    def _part(self, text: str, counts: Counter) -> None:
        """A part without special strings.

        A space between two other characters always begins a pre-token, so the text may be cut
        there and each word split once. Where longer white space occurs, the whole part is
        split at once instead.
        """
        first, *words = text.split(" ")
        word_tokens = []
        for word, times in Counter(words).items():
            found = self.known.get(word, 0)
            if found == 0:
                found = self._word(word)
            if found is None:
                break
            word_tokens.append((found, times))
        else:
            if not words or (first and first[-1] not in WHITE_SPACE):
                counts.update(PRE_TOKEN.findall(first))
                for found, times in word_tokens:
                    for token in found:
                        counts[token] += times
                return
        counts.update(PRE_TOKEN.findall(text))

    def of(self, text: str) -> Counter:
        counts: Counter = Counter()
        if any(special in text for special in self.special):
            for part in self.cut.split(text):
                if part in self.special:
                    counts[part] += 1
                elif part:
                    self._part(part, counts)
        elif text:
            self._part(text, counts)
        return counts


_SPLITTERS: dict[str, PreTokens] = {}
_MODELS: dict[str, Tokenizer] = {}


def splitter(vocabulary: str) -> PreTokens:
    """One for each Python worker, whatever the number of tasks it runs."""
    if vocabulary not in _SPLITTERS:
        _SUMS.clear()
        _SPLITTERS[vocabulary] = PreTokens(vocabulary)
    return _SPLITTERS[vocabulary]


def library(vocabulary: str) -> Tokenizer:
    """The library's model, one for each Python worker; words split before are forgotten."""
    _SPLITTERS.clear()
    if vocabulary not in _MODELS:
        # Spark's tasks fill the cores; threads of the library would each keep memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        model = Tokenizer.from_file(vocabulary)
        model.no_truncation()
        model.no_padding()
        _MODELS[vocabulary] = model
    return _MODELS[vocabulary]


class Sums:
    """Pieces of a text by the known pre-tokens, and how often each other one occurs."""

    def __init__(self, split: PreTokens, pieces_of: dict[str, int]) -> None:
        self.split, self.pieces_of = split, pieces_of
        self.known: dict[str, tuple[int, tuple[str, ...]]] = {}
        self.older: dict[str, tuple[int, tuple[str, ...]]] = {}

    def _word(self, word: str) -> tuple[int, tuple[str, ...]]:
        found = self.known.get(word) or self.older.get(word)
        if found is None:
            tokens = PRE_TOKEN.findall(f" {word}")
            pieces = [self.pieces_of.get(t) for t in tokens]
            others = tuple(t for t, p in zip(tokens, pieces, strict=True) if p is None)
            found = (sum(p for p in pieces if p is not None), others)
        if len(word) <= WORD_CHARS:
            if len(self.known) >= KNOWN_WORDS:
                self.older, self.known = self.known, {}
            self.known[word] = found
        return found

    def of(self, text: str) -> tuple[int, Counter]:
        total, others = 0, Counter()
        cut = self.split.words(text) if text else None
        if cut is None:
            times_of = self.split.of(text)
        else:
            times_of = Counter(PRE_TOKEN.findall(cut[0]))
            get, make = self.known.get, self._word
            found = [get(word) or make(word) for word in cut[1]]
            total = sum([f[0] for f in found])
            for f in found:
                if f[1]:
                    others.update(f[1])
        for token, times in times_of.items():
            pieces = self.pieces_of.get(token)
            if pieces is None:
                others[token] += times
            else:
                total += pieces * times
        return total, others


_SUMS: dict[str, Sums] = {}


def sums_of_run(run: str, vocabulary: str, pieces_of: dict[str, int]) -> Sums:
    """One for each Python worker and run; that of an earlier run is forgotten."""
    if run not in _SUMS:
        _SUMS.clear()
        _SUMS[run] = Sums(splitter(vocabulary), pieces_of)
    return _SUMS[run]


def distinct_pieces(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """pieces of each row's token, by the library."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = library(vocabulary)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            pieces: list[int] = []
            pa.default_memory_pool().release_unused()
            for at in range(0, len(texts), PIECES_BATCH):
                some = texts[at : at + PIECES_BATCH]
                pieces += [len(e.ids) for e in model.encode_batch(some, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(pieces, pa.int32())],
                names=["token", "times", "pieces"],
            )

    return tokens.mapInArrow(body, "token string, times bigint, pieces int")


def _most_frequent(counted: DataFrame, most: int = BROADCAST_TOKENS) -> DataFrame:
    """At most ``most`` tokens, the most frequent ones, chosen by a threshold.

    Frequencies are counted in steps of a tenth of a doubling, so no task ever sorts tokens.
    """
    short = counted.where(F.length("token") <= BROADCAST_CHARS).withColumn(
        "step", F.floor(F.log2("times") * 10)
    )
    steps = {row["step"]: row["n"] for row in short.groupBy("step").agg(F.count("*").alias("n")).collect()}
    room, least = most, None
    for step in sorted(steps, reverse=True):
        room -= steps[step]
        if room < 0:
            break
        least = step
    chosen = F.lit(False) if least is None else F.col("step") >= least
    return short.where(chosen).select("token", "pieces")


def token_counts(
    docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens of each row."""
    spark = docs.sparkSession
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(vocabulary)
        counts: Counter = Counter()
        words: Counter = Counter()

        def out() -> pa.RecordBatch:
            for word, times in words.items():
                for token in split.tokens(word):
                    counts[token] += times
            made = pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())],
                names=["token", "times"],
            )
            counts.clear()
            words.clear()
            return made

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                for value in batch.column(0).slice(at, ROWS_AT_ONCE).to_pylist():
                    if not value:
                        continue
                    cut = split.words(value)
                    if cut is None:
                        counts.update(split.of(value))
                    else:
                        counts.update(PRE_TOKEN.findall(cut[0]))
                        words.update(cut[1])
                if len(counts) + len(words) > GATHERED:
                    yield out()
            pa.default_memory_pool().release_unused()
        yield out()

    tokens = (
        rows.select("text")
        .mapInArrow(gather, "token string, times bigint")
        .groupBy("token")
        .agg(F.sum("times").alias("times"))
    )
    counted = stored(distinct_pieces(tokens, vocabulary), "pieces")
    common = _most_frequent(counted).toPandas()
    near = spark.sparkContext.broadcast(
        dict(zip(common["token"].tolist(), common["pieces"].tolist(), strict=True))
    )
    # A row of its own for each input row, so that repeated and null ids stay apart.
    kind = rows.schema["doc_id"].dataType.simpleString()

    run = uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums_of = sums_of_run(run, vocabulary, near.value)
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS_AT_ONCE):
                yield some(whole.slice(low, ROWS_AT_ONCE), sums_of)
            pa.default_memory_pool().release_unused()

    def some(batch: pa.RecordBatch, sums_of: Sums) -> pa.RecordBatch:
        sizes, sums, far, far_times, offsets = [], [], [], [], [0]
        for value in batch.column(2).to_pylist():
            total, others = sums_of.of(value or "")
            far += others.keys()
            far_times += others.values()
            sizes.append(len((value or "").encode()))
            sums.append(total)
            offsets.append(len(far))
        pairs = pa.StructArray.from_arrays(
            [pa.array(far, pa.string()), pa.array(far_times, pa.int64())], ["token", "times"]
        )
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(sizes, pa.int64()),
                pa.array(sums, pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs),
            ],
            names=["doc_id", "row", "n_bytes", "near", "far"],
        )

    counts = rows.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), "text"
    ).mapInArrow(
        count,
        f"doc_id {kind}, row bigint, n_bytes bigint, near bigint, "
        "far array<struct<token: string, times: bigint>>",
    )
    # One row for the text itself, one for each of its other pre-tokens; sums are combined
    # before the shuffle by row.
    parts = counts.select(
        "doc_id", "row", "n_bytes", "near", F.explode_outer("far").alias("far")
    )
    # Rows without other pre-tokens get a key of their own that no token has.
    parts = parts.select(
        "doc_id",
        "row",
        "n_bytes",
        "near",
        F.coalesce("far.token", F.concat(F.lit("\x00row "), "row")).alias("token"),
        "far.times",
    )
    joined = parts.join(counted.select("token", "pieces"), "token", "left")
    return joined.groupBy("row", "doc_id").agg(
        F.max("n_bytes").alias("n_bytes"),
        (F.max("near") + F.coalesce(F.sum(F.col("times") * F.col("pieces")), F.lit(0)))
        .cast("bigint")
        .alias("n_tokens"),
    ).select("doc_id", "n_bytes", "n_tokens")
