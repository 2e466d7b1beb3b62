"""Spelling variants: words one edit apart, grouped under their far more frequent forms.

Method: a word is the vector of its letter counts. One deleted or inserted letter moves it by an
L1 distance of 1, one replaced letter by exactly 2. For each pair of lengths (L, L) and (L, L + 1)
words of length L are range queries into a k-d tree over the words of the other length; nodes
whose box is too far are pruned; what is left is verified letter by letter.

Spread over tasks: the upper part of the trees, at most ``CELLS`` cells, is fitted on at most
``SAMPLE_WORDS`` words drawn by hash; it only decides which task looks where. Every word is a
point of one cell and a query to all cells that its range touches. Cells and their queries are
cut into blocks of at most about ``BLOCK_WORDS``, each pair of blocks is one group, in which
the lower part of the tree is built on tight boxes. No pair in range is lost at any size.

Defined results: null texts have no words, a null id counts as an empty one; letters are
``[A-Za-z\\u00C0-\\u00FF]``, only A-Z is lower-cased; repeated rows count again; texts and words of
any length are whole; an empty table gives no rows; other columns don't take part.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import stored
from quillon.scale import join_small

# Words as the UTF-8 bytes of [a-zÀ-ÿ]+ after lower-casing A-Z.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
LETTERS = 26 + 64
DELETE_EVERY = 199
MIN_LETTERS, MIN_COUNT, FORM_TIMES = 6, 5, 5

SAMPLE_WORDS = 200_000
CELLS = 4096
CELL_WORDS = 512
BLOCK_WORDS = 8192
LEAF = 32
TILE = 1 << 22

_CODE = np.zeros(256, dtype=np.int64)
_CODE[np.arange(ord("a"), ord("z") + 1)] = np.arange(26)
_CODE[0xC0:0x100] = np.arange(26, LETTERS)


# --- counting --------------------------------------------------------------------------------


def thinned(name: bytes, runs: list[bytes], damage: bool) -> Iterator[bytes]:
    """Lower-cased runs; where 199 divides crc32 of ``<id>:<run>`` one letter is taken out."""
    start = zlib.crc32(name)
    for run in runs:
        if damage:
            h = zlib.crc32(run, start)
            if h % DELETE_EVERY == 0:
                letters = run.decode()
                at = h % len(letters)
                run = (letters[:at] + letters[at + 1 :]).encode()
        if len(run) >= MIN_LETTERS:
            yield run


def word_counts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", damage: bool = False) -> DataFrame:
    """word, n: words of at least six letters found at least five times in all texts."""
    rows = docs.select(docs[key].cast("string").alias("k"), docs[text].alias("t"))
    held = 200_000

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        size = 0

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode() for w in seen], pa.string())
            made = pa.RecordBatch.from_arrays([words, pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return made

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not body:
                    continue
                runs = RUN.findall(body.encode().lower())
                for word in thinned(f"{name or ''}:".encode(), runs, damage):
                    n = seen.get(word)
                    if n is None:
                        seen[word] = 1
                        size += len(word)
                    else:
                        seen[word] = n + 1
                if len(seen) > held or size > 16_000_000:
                    yield out()
                    size = 0
        if seen:
            yield out()

    return (
        rows.mapInArrow(count, "word string, n bigint")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .where((F.col("n") >= MIN_COUNT) & (F.length("word") >= MIN_LETTERS))
    )


# --- vectors and trees -------------------------------------------------------------------------


def vectors(words: list[str]) -> np.ndarray:
    """Letter counts, one row for each word; all letters are below U+0100."""
    data = [w.encode("latin-1") for w in words]
    owner = np.repeat(np.arange(len(data)), [len(d) for d in data])
    codes = _CODE[np.frombuffer(b"".join(data), dtype=np.uint8)]
    counts = np.bincount(owner * LETTERS + codes, minlength=len(data) * LETTERS)
    return counts.reshape(-1, LETTERS).astype(np.int32)


@dataclass
class Node:
    """A cell, or two parts: ``low`` holds vectors with at most ``most`` of letter ``dim``."""

    cell: int = -1
    dim: int = -1
    most: int = -1
    low: Node | None = None
    high: Node | None = None


@dataclass
class Upper:
    """The upper part of the trees, one by length; a length unseen in the sample is one cell."""

    roots: dict[int, Node] = field(default_factory=dict)
    cells: int = 0

    def cell(self) -> Node:
        self.cells += 1
        return Node(cell=self.cells - 1)


def split_at(points: np.ndarray) -> tuple[int, int] | None:
    """The letter that varies most, and a value that leaves points on both sides."""
    spread = points.var(axis=0)
    dim = int(spread.argmax())
    if not spread[dim]:
        return None
    values = np.sort(points[:, dim])
    most = int(values[(len(values) - 1) // 2])
    return dim, most if most < values[-1] else int(values[values < values[-1]][-1])


def grown(upper: Upper, points: np.ndarray, size: int) -> Node:
    cut = split_at(points) if len(points) > size else None
    if cut is None:
        return upper.cell()
    dim, most = cut
    low = points[:, dim] <= most
    return Node(-1, dim, most, grown(upper, points[low], size), grown(upper, points[~low], size))


def upper_trees(words: list[str], total: int, cell_words: int = CELL_WORDS) -> Upper:
    """Trees over a sample of ``words`` out of ``total``, so that cells get about ``cell_words``."""
    upper = Upper()
    cells = max(1, min(CELLS, total // cell_words))
    size = max(1, len(words) // cells)
    by_length: dict[int, list[str]] = {}
    for word in words:
        by_length.setdefault(len(word), []).append(word)
    for length in sorted(by_length):
        upper.roots[length] = grown(upper, vectors(by_length[length]), size)
    return upper


def routed(node: Node, points: np.ndarray, radius: int) -> list[tuple[np.ndarray, int]]:
    """(rows of ``points``, cell) for all cells whose box is within ``radius`` of the point."""
    found = []
    todo = [(node, np.arange(len(points)), np.zeros(len(points), dtype=np.int64), {})]
    while todo:
        at, rows, far, box = todo.pop()
        if not len(rows):
            continue
        if at.cell >= 0:
            found.append((rows, at.cell))
            continue
        values = points[rows, at.dim]
        least, most = box.get(at.dim, (-1, 1 << 30))
        before = np.maximum(least - values, 0) + np.maximum(values - most, 0)
        for child, side in ((at.low, (least, min(most, at.most))), (at.high, (max(least, at.most + 1), most))):
            after = np.maximum(side[0] - values, 0) + np.maximum(values - side[1], 0)
            dist = far - before + after
            near = dist <= radius
            todo.append((child, rows[near], dist[near], box | {at.dim: side}))
    return found


def in_range(points: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query rows, point rows) within an L1 distance of ``radius``: a k-d tree on tight boxes."""
    used = (points.any(axis=0)) | (queries.any(axis=0))
    points, queries = points[:, used].astype(np.int16), queries[:, used].astype(np.int16)
    todo = [(np.arange(len(points)), np.arange(len(queries)))]
    while todo:
        mine, asked = todo.pop()
        box = points[mine]
        low, high = box.min(axis=0), box.max(axis=0)
        near = np.concatenate([
            (np.maximum(low - q, 0) + np.maximum(q - high, 0)).sum(axis=1) <= radius
            for q in (queries[asked[i : i + 20_000]] for i in range(0, len(asked), 20_000))
        ])
        asked = asked[near]
        if not len(asked):
            continue
        cut = split_at(box) if len(mine) > LEAF else None
        if cut is None:
            step = max(1, TILE // (len(mine) * box.shape[1]))
            for i in range(0, len(asked), step):
                part = asked[i : i + step]
                for j in range(0, len(mine), TILE // box.shape[1] or 1):
                    some = mine[j : j + (TILE // box.shape[1] or 1)]
                    dist = np.abs(queries[part][:, None, :] - points[some][None, :, :]).sum(axis=2)
                    q, p = np.nonzero(dist <= radius)
                    if len(q):
                        yield part[q], some[p]
            continue
        dim, most = cut
        left = box[:, dim] <= most
        todo += [(mine[left], asked), (mine[~left], asked)]


def one_edit(short: list[str], long: list[str]) -> np.ndarray:
    """Which pairs are one edit apart; lengths are equal, or the second one letter longer."""
    if not short:
        return np.zeros(0, dtype=bool)
    n = len(short[0])
    a = np.frombuffer("".join(short).encode("latin-1"), dtype=np.uint8).reshape(-1, n)
    b = np.frombuffer("".join(long).encode("latin-1"), dtype=np.uint8).reshape(-1, len(long[0]))
    if a.shape == b.shape:
        return (a != b).sum(axis=1) == 1
    head = np.minimum.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    tail = np.minimum.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= n


# --- pairs ---------------------------------------------------------------------------------------


def near_pairs(
    words: DataFrame,
    *,
    sample: int = SAMPLE_WORDS,
    cell_words: int = CELL_WORDS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """word, n, near, near_n: every pair one edit apart, both ways round."""
    spark = words.sparkSession
    total = words.count()
    drawn = words.select("word").orderBy(F.xxhash64("word"), "word").limit(sample)
    upper = upper_trees([r.word for r in drawn.collect()], total, cell_words)
    roots, cells = upper.roots, upper.cells

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_length: dict[int, list[int]] = {}
            names = batch.column(0).to_pylist()
            for i, word in enumerate(names):
                by_length.setdefault(len(word), []).append(i)
            for length, at in by_length.items():
                points = vectors([names[i] for i in at])
                kinds = [(length, 0, False), (length, 2, True), (length + 1, 1, True)]
                for there, radius, asks in kinds:
                    # A length that the sample lacks is one cell of its own, after the others.
                    node = roots.get(there) or Node(cell=cells + there)
                    sent = routed(node, points, radius)
                    if not sent:
                        continue
                    rows = np.asarray(at)[np.concatenate([rows for rows, _ in sent])]
                    cell = np.repeat([cell for _, cell in sent], [len(rows) for rows, _ in sent])
                    yield pa.RecordBatch.from_arrays(
                        [*batch.take(pa.array(rows)).columns, pa.array(cell, pa.int64()), pa.array([asks] * len(rows))],
                        names=["word", "n", "cell", "asks"],
                    )

    sent = stored(
        words.select("word", "n").mapInArrow(placed, "word string, n bigint, cell bigint, asks boolean"), "spelling-cells"
    )
    # Blocks of cells and of their queries; cells without points are asked in vain.
    sizes = sent.groupBy("cell").agg(
        F.sum(F.when(F.col("asks"), 0).otherwise(1)).alias("points"),
        F.sum(F.when(F.col("asks"), 1).otherwise(0)).alias("queries"),
    ).where("points > 0").select(
        "cell",
        F.ceil(F.col("points") / block_words).alias("point_blocks"),
        F.ceil(F.col("queries") / block_words).alias("query_blocks"),
    )
    dealt = join_small(sent, sizes, ["cell"], ["word"])
    mine = F.pmod(F.xxhash64("word"), F.when(F.col("asks"), F.col("query_blocks")).otherwise(F.col("point_blocks")))
    other = F.when(F.col("asks"), F.col("point_blocks")).otherwise(F.col("query_blocks"))
    dealt = dealt.withColumn("mine", mine).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("bigint"), other - 1))
    )
    groups = dealt.select(
        "word", "n", "asks", "cell",
        F.when(F.col("asks"), F.col("other")).otherwise(F.col("mine")).alias("point_block"),
        F.when(F.col("asks"), F.col("mine")).otherwise(F.col("other")).alias("query_block"),
    )

    def searched(group: pa.Table) -> pa.Table:
        points = group.filter(pc.invert(group["asks"]))
        names, ns = points["word"].to_pylist(), points["n"].to_numpy()
        asked: dict[int, tuple[list[str], list[int]]] = {}
        for word, n, asks in zip(*(group[c].to_pylist() for c in ("word", "n", "asks")), strict=True):
            if asks:
                words, counts = asked.setdefault(len(word), ([], []))
                words.append(word)
                counts.append(n)
        out = []
        if names and asked:
            have = vectors(names)
            length = len(names[0])
            for own, (theirs, counts) in asked.items():
                theirs_n = np.asarray(counts)
                for q, p in in_range(have, vectors(theirs), 2 if own == length else 1):
                    right = one_edit([theirs[i] for i in q], [names[i] for i in p])
                    q, p = q[right], p[right]
                    a, b = [theirs[i] for i in q], [names[i] for i in p]
                    out.append((a, theirs_n[q], b, ns[p]))
                    if own != length:
                        out.append((b, ns[p], a, theirs_n[q]))
        parts = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table(
            [
                pa.array([x for part in column for x in part], kind)
                for column, kind in zip(parts, (pa.string(), pa.int64()) * 2, strict=True)
            ],
            names=["word", "n", "near", "near_n"],
        )

    return groups.groupBy("cell", "point_block", "query_block").applyInArrow(
        searched, "word string, n bigint, near string, near_n bigint"
    )


def roots_of(links: DataFrame, rounds: int) -> DataFrame:
    """word, root: links (word, form) followed to their ends by pointer doubling."""
    at = links.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        after = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = stored(
            join_small(at, after, ["root"], ["word"], how="left").select(
                "word", F.coalesce("next", "root").alias("root")
            ),
            "spelling-roots",
        )
    return at


def variants(docs: DataFrame, *, key: str = "doc_id", text: str = "text", damage: bool = False) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs``."""
    words = stored(word_counts(docs, key=key, text=text, damage=damage), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_pairs(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), best.alias("best"), F.max("n").alias("own")
    )
    near = stored(
        near.select(
            "word", "n_near",
            *(
                F.when(-F.col("best.less") >= FORM_TIMES * F.col("own"), value).alias(name)
                for name, value in (("form", F.col("best.near")), ("form_n", -F.col("best.less")))
            ),
        ),
        "spelling-near",
    )
    links = near.where("form is not null").select("word", "form", "form_n")
    # Each step multiplies n by five or more, so the longest way is known from the largest n.
    most = links.agg(F.max("form_n")).first()[0] or 0
    steps, reach = 1, MIN_COUNT * FORM_TIMES
    while reach < most:
        steps, reach = steps + 1, reach * FORM_TIMES
    roots = roots_of(links, (steps - 1).bit_length())
    found = near.join(roots, "word", "left")
    return words.join(found, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n",
    )
