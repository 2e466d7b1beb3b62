"""N-gram Jaccard join by chosen paths: sets are split on sampled shared tokens.

1. Each text becomes its set of word shingles; texts with equal sets are one class from then on.
2. Every set has ``COORDINATES`` minimum hashes. From the root of each of ``RUNS`` independent
   trees, ``BRANCHES`` coordinates are drawn at a node, and a set goes on to the child named by
   its minimum there, so two sets share a child with the probability of their similarity. A node
   with few sets is searched whole. In a larger one all are compared with some ``LEADERS`` of them,
   drawn by hash, in blocks, and linked to those they resemble. The largest group of leaders that
   resemble each other, with all that is linked to it, is the node's main group: its pairs are
   connected already. If all belong to it, the node is done; if only a few don't, these are
   compared with all, and the node is done as well. Else it is split again, without the leaders
   (all were compared with them) and without its core: sets that agree with the main group's first
   leader in at least 28 coordinates (``MARGIN``) more than any set outside the group does. Such a
   set and one outside differ where only one of them agrees with the leader, so they agree in 36
   coordinates of 64 or fewer; a pair at a similarity of 0.8 does so with a probability of 1.4e-5.
   All runs read the same sketches, so they don't lower it; it concerns only pairs of a core set
   and one outside in a node split again. No other pair of a node is left out unless it is
   compared or connected.
   With two branches and a similarity of 0.8 a pair that is never split
   apart survives at 94 % a run; at the usual depth of one, six runs miss it with 0.2^12.
   Nodes left at ``DEPTH`` are searched whole in tiles, whatever their size.
   Searching a node compares sketches and keeps a forest that connects what resembles each
   other even loosely (``LOOSE``, many deviations below the threshold).
3. The loose forests of all nodes give candidate groups. In each, all pairs are verified exactly
   on whole sets, in tiles of at most ``TILE`` x ``TILE``; only counts and a forest of the true
   links leave a tile.
4. The true links' components are the classes.

Never are the pairs of a group written out; a group of any size is spread over tiles.

Defined results: a text of fewer words than a shingle is one shingle of all its words; texts
without words are linked to nothing, each a class of its own; null ids are ids; rows with equal
ids are rows of their own in counts; an empty table gives no rows; further columns don't take
part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.graph import components
from quillon.llm.shared import stored
from quillon.scale import join_small

WIDTH = 5
THRESHOLD = 0.8
COORDINATES = 64
RUNS = 6
BRANCHES = 2
SMALL_NODE = 48
DEPTH = 8
LOOSE = 0.4
# 28 of 64 coordinates.
MARGIN = 0.4375
# Sets of a large node that all others are compared with (drawn, or the few outside its main
# group), and the others that make a block.
LEADERS = 16
FEW = 64
BLOCK = 96
TILE = 256
WORD = re.compile(r"[^\W_]+")
KNOWN_WORDS = 200_000
U64 = np.uint64


# --- sets ------------------------------------------------------------------------------------


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> U64(33))
    values = values * U64(0xFF51AFD7ED558CCD)
    values ^= values >> U64(33)
    values *= U64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> U64(33))


SEEDS = _mixed(np.arange(1, COORDINATES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


class Shingles:
    """Sorted distinct hashes of a text's word shingles; a bounded memory of word hashes."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.known: dict[str, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        words = WORD.findall((text or "").lower())
        if not words:
            return np.zeros(0, U64)
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known = self.known
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word.encode())
        hashes = np.fromiter(map(known.__getitem__, words), U64, len(words))
        width = min(self.width, len(words))
        n = len(words) - width + 1
        shingle = np.full(n, U64(width))
        for at in range(width):
            shingle = _mixed(shingle + hashes[at : at + n])
        return np.unique(shingle)


def name_of(hashes: np.ndarray) -> bytes | None:
    """A set's name: equal for equal sets, null for the empty one."""
    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least hash at each coordinate, as 32 bits."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, U64)
    for low in range(0, len(hashes), 4096):
        some = hashes[low : low + 4096, None] * SEEDS
        some ^= some >> U64(32)
        np.minimum(out, some.min(axis=0), out=out)
    # The low half is as random as the high half, which is small in a minimum.
    return _mixed(out).astype(np.uint32)


def mark_of(key: Column, text: Column) -> Column:
    unnamed = F.concat(F.lit("null "), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.coalesce(key.cast("string"), unnamed)


def sets_of(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """doc_id, mark, node (the set's name), n (its size), sketch (minima as bytes).

    ``mark`` finds the text again: the id, for a null one a digest of the text.
    """
    rows = docs.select(
        docs[key].alias("doc_id"), docs[text].alias("text"), mark_of(docs[key], docs[text]).alias("mark")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in batches:
            names, sizes, sketches = [], [], []
            for value in batch.column(1).to_pylist():
                hashes = shingles.of(value)
                names.append(name_of(hashes))
                sizes.append(len(hashes))
                sketches.append(minima(hashes).tobytes() if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(names, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array(sketches, pa.binary()),
                ],
                names=["doc_id", "mark", "node", "n", "sketch"],
            )

    return rows.mapInArrow(
        body, f"doc_id {kind}, mark string, node binary, n bigint, sketch binary"
    )


# --- runs of rows with one key ----------------------------------------------------------------


def by_run(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of sorted batches, cut where the first ``keys`` columns change."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        change[0] = last is not None and tuple(c[0] for c in columns) != last
        last = tuple(c[-1] for c in columns)
        cuts = [0, *np.nonzero(change)[0].tolist(), batch.num_rows]
        for at, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if (at or (low == 0 and change[0])) and held:
                yield pa.Table.from_batches(held)
                held = []
            if high > low:
                held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def forest(alike: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a square matrix of links."""
    n = len(alike)
    group = np.arange(n)
    edges = []
    for i in range(1, n):
        near = np.nonzero(alike[i, :i])[0]
        for g in np.unique(group[near]).tolist():
            j = int(near[group[near] == g][0])
            if group[i] != group[j]:
                edges.append((j, i))
                group[group == group[i]] = group[j]
    return edges


EDGES = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def search_whole(nodes: DataFrame) -> DataFrame:
    """Loose edges (a, b) inside each path; ``nodes`` has path, node, sketch."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for rows in by_run(batches, 1):
            names = rows["node"].to_pylist()
            sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint32)
            sketch = sketch.reshape(len(names), COORDINATES)
            alike = np.empty((len(names), len(names)), bool)
            for i in range(len(names)):
                alike[i] = (sketch == sketch[i]).mean(axis=1) >= LOOSE
            for i, j in forest(alike):
                a.append(names[i])
                b.append(names[j])
            if len(a) > 20_000:
                yield pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=EDGES)
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=EDGES)

    return (
        nodes.select("path", "node", "sketch")
        .repartition("path")
        .sortWithinPartitions("path", "node")
        .mapInArrow(body, "a binary, b binary")
    )


# --- chosen paths ------------------------------------------------------------------------------


def children(nodes: DataFrame, runs: int | None = None) -> DataFrame:
    """path, node: where each set goes from the node it is at (``path``), or from ``runs`` roots."""
    at = F.col("path")
    if runs is not None:
        at = F.explode(F.transform(F.sequence(F.lit(1), F.lit(runs)), lambda r: F.xxhash64(r)))
    placed = nodes.select("node", "sketch", at.alias("path"))
    branch = F.explode(F.sequence(F.lit(0), F.lit(BRANCHES - 1)))
    # Branch b draws from its own share of the coordinates, so no two are the same.
    share = COORDINATES // BRANCHES
    placed = placed.select("node", "sketch", "path", branch.alias("branch"))
    coordinate = F.pmod(F.xxhash64("path", "branch"), F.lit(share)) + F.col("branch") * share
    value = F.substring(F.col("sketch"), (coordinate * 4 + 1).cast("int"), F.lit(4))
    return placed.select(F.xxhash64("path", "branch", value).alias("path"), "node")


LED = pa.schema(
    [
        ("path", pa.int64()),
        ("node", pa.binary()),
        ("sketch", pa.binary()),
        ("near", pa.float64()),
        ("main", pa.bool_()),
        ("other", pa.binary()),
    ]
)


def grouped(alike: np.ndarray) -> tuple[np.ndarray, int, list[tuple[int, int]]]:
    """Rows against leaders, the leaders' own rows first: which are of the main group, its first
    leader, and edges (row, leader) that join groups of leaders.

    The main group is chosen by the links among leaders alone, so each block of a node chooses
    the same; rows of a block may join further leaders to it.
    """
    n = alike.shape[1]
    group, edges = np.arange(n), []

    def join(row: int, first: int) -> None:
        for at in np.nonzero(alike[row])[0].tolist():
            if group[at] != group[first]:
                edges.append((row, at))
                group[group == group[at]] = group[first]

    for row in range(n):
        join(row, row)
    core = int(np.nonzero(group == np.bincount(group, minlength=n).argmax())[0][0])
    linked = np.nonzero(alike[n:].any(axis=1))[0] + n
    if len(linked):
        _, kinds = np.unique(alike[linked], axis=0, return_index=True)
        for row in linked[kinds].tolist():
            join(row, int(alike[row].argmax()))
    return (alike & (group == group[core])).any(axis=1), core, edges


def blocks_of(nodes: DataFrame) -> DataFrame:
    """Large nodes in blocks, each with all leaders of its node in front of its own sets."""
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    own = F.array(F.pmod(F.xxhash64("node"), blocks).cast("int"))
    all_of_them = F.sequence(F.lit(0), blocks - 1)
    tiles = nodes.withColumn("block", F.explode(F.when(F.col("lead"), all_of_them).otherwise(own)))
    return (
        tiles.select(F.xxhash64("path", "block").alias("tile"), "path", "node", "sketch", "lead")
        .repartition("tile")
        .sortWithinPartitions("tile", F.desc("lead"), "node")
    )


def against_leaders(rows: pa.Table) -> tuple[list[bytes], int, np.ndarray]:
    """Names of a block's sets, how many lead, and each one's resemblance to these."""
    names = rows["node"].to_pylist()
    n = int(np.count_nonzero(rows["lead"].to_numpy()))
    sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint32)
    sketch = sketch.reshape(len(names), COORDINATES)
    agree = np.zeros((len(names), n))
    for i in range(n):
        agree[:, i] = (sketch == sketch[i]).mean(axis=1)
    return names, n, agree


def led(nodes: DataFrame) -> DataFrame:
    """Sets of large nodes compared with the leaders of their node, in blocks.

    ``nodes`` has path, node, sketch, size and lead. Rows of the result with a path are the sets
    that don't lead: how near they come to the main group's first leader, and whether they
    belong to the group. Where ``other`` is set, it is an edge.
    """

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_run(batches, 1):
            names, n, agree = against_leaders(rows)
            alike = agree >= LOOSE
            near, main, edges = np.zeros(len(names)), np.zeros(len(names), bool), []
            first = [None] * len(names)
            if n:
                main, core, edges = grouped(alike)
                near = agree[:, core]
                some, which = alike.any(axis=1).tolist(), alike.argmax(axis=1).tolist()
                first = [names[at] if linked else None for linked, at in zip(some, which, strict=True)]
            rest, more = rows.slice(n), len(edges)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([*rest["path"].chunks, pa.nulls(more, pa.int64())]),
                    pa.array(names[n:] + [names[row] for row, _ in edges], pa.binary()),
                    pa.concat_arrays([*rest["sketch"].chunks, pa.nulls(more, pa.binary())]),
                    pa.array([*near[n:].tolist(), *[None] * more], pa.float64()),
                    pa.array([*main[n:].tolist(), *[None] * more], pa.bool_()),
                    pa.array(first[n:] + [names[at] for _, at in edges], pa.binary()),
                ],
                schema=LED,
            )

    return blocks_of(nodes).mapInArrow(
        body, "path bigint, node binary, sketch binary, near double, main boolean, other binary"
    )


def few_outside(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) of the sets outside a main group, which lead here, among themselves and to
    the group: one to the group is enough, as it is connected."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_run(batches, 1):
            names, n, agree = against_leaders(rows)
            alike = agree >= LOOSE
            pairs = forest(alike[:n])
            into = alike[n:]
            for at in np.nonzero(into.any(axis=0))[0].tolist():
                pairs.append((at, n + int(into[:, at].argmax())))
            yield pa.RecordBatch.from_pydict(
                {"a": [names[i] for i, _ in pairs], "b": [names[j] for _, j in pairs]}, schema=EDGES
            )

    return blocks_of(nodes).mapInArrow(body, "a binary, b binary")


def edges_of(compared: DataFrame) -> DataFrame:
    return compared.where("other is not null").select(
        F.col("node").alias("a"), F.col("other").alias("b")
    )


def loose_edges(sets: DataFrame, *, runs: int = RUNS, small: int = SMALL_NODE, depth: int = DEPTH) -> DataFrame:
    """Edges that connect all sets that resemble each other; ``sets`` has node, sketch."""
    edges = None
    at = children(sets, runs)
    for level in range(1, depth + 1):
        paths = stored(at, "paths")
        sizes = paths.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        shared = stored(paths.join(sizes, "path"), "shared")
        few = shared.where(F.col("size") <= small)
        found = stored(search_whole(few.select("path", "node").join(sets, "node")), "found")
        edges = found if edges is None else edges.unionByName(found)
        big = shared.where(F.col("size") > small)
        if not big.limit(1).count():
            return edges
        # About LEADERS of a node lead, drawn by hash.
        lead = F.pmod(F.xxhash64("node", "path"), F.col("size")) < LEADERS
        compared = stored(led(big.join(sets, "node").withColumn("lead", lead)), "compared")
        edges = edges.unionByName(edges_of(compared))
        # What is outside the main group of a node, and how near it comes to the group's leader.
        mixed = stored(
            compared.where("path is not null").groupBy("path").agg(
                F.count(F.lit(1)).alias("size"),
                F.count_if(~F.col("main")).alias("outside"),
                F.max(F.when(~F.col("main"), F.col("near"))).alias("nearest"),
            ).where("outside > 0"),
            "outside",
        )
        open_ = join_small(compared.where("path is not null"), mixed, ["path"], ["node"])
        lone = open_.where(F.col("outside") <= FEW).withColumn("lead", ~F.col("main"))
        edges = edges.unionByName(stored(few_outside(lone), "lone"))
        rest = open_.where(F.col("outside") > FEW)
        rest = rest.where(F.col("near") < F.col("nearest") + MARGIN)
        rest = stored(rest.select("path", "node", "sketch"), "mixed")
        if not rest.limit(1).count():
            return edges
        if level < depth:
            at = children(rest)
    # Whatever is still together is compared pair by pair, in tiles.
    left = rest.groupBy("path").agg(F.count(F.lit(1)).alias("size"))
    return edges.unionByName(search_whole(tiled(rest.join(left, "path"), small)))


def tiled(nodes: DataFrame, small: int) -> DataFrame:
    """Each path in blocks of about half of ``small`` sets; a path for each pair of blocks."""
    blocks = F.ceil(F.col("size") / F.lit(max(1, small // 2))).cast("int")
    placed = nodes.withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    )
    other = placed.withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    return other.select(
        F.xxhash64(
            "path", F.least("block", "other"), F.greatest("block", "other")
        ).alias("path"),
        "node",
        "sketch",
    )


# --- verification ------------------------------------------------------------------------------


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs."""
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    if n == 2:
        out[0, 1] = out[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
        return out
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = np.nonzero(times > 1)[0]
    place = np.full(len(times), -1)
    place[several] = np.arange(len(several))
    spot = place[token]
    owner, spot = owner[spot >= 0], spot[spot >= 0]
    order = np.argsort(spot, kind="stable")
    owner, spot = owner[order], spot[order]
    wide = 4096
    for low in range(0, len(several), wide):
        first, last = np.searchsorted(spot, [low, low + wide])
        held = np.zeros((n, min(wide, len(several) - low)), np.float32)
        held[owner[first:last], spot[first:last] - low] = 1
        out += held @ held.T
    return out


LINKS = pa.schema(
    [("node", pa.binary()), ("other", pa.binary()), ("links", pa.int64())]
)


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """node, other, links: documents linked to a set, and a forest of the true links.

    ``members`` has group, size (sets in the group), node, n, weight (documents), hashes.
    Rows with links carry a tile's count for the node, rows with other an edge.
    """
    # A tile holds one block, or two different ones of which only pairs across count. Blocks are
    # of half a tile, so both fit.
    blocks = F.greatest(F.ceil(F.col("size") / F.lit(TILE // 2)), F.lit(1)).cast("int")
    whole = F.when(F.col("size") <= TILE, F.lit(1)).otherwise(blocks)
    placed = members.withColumn("blocks", whole).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    )
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select(
        F.xxhash64("group", F.least("block", "other"), F.greatest("block", "other")).alias("tile"),
        F.col("block"),
        (F.col("block") == F.col("other")).alias("within"),
        "node",
        "n",
        "weight",
        "hashes",
    )

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, others, links = [], [], []
        for run in by_run(batches, 1):
            names = run["node"].to_pylist()
            once = [i for i, name in enumerate(names) if not i or name != names[i - 1]]
            if len(once) < 2:
                continue
            rows = run if len(once) == len(names) else run.take(once)
            names = [names[i] for i in once]
            sets = [np.frombuffer(h, U64) for h in rows["hashes"].to_pylist()]
            n, weight = rows["n"].to_numpy(), rows["weight"].to_numpy()
            block = rows["block"].to_numpy()
            common = intersections(sets)
            alike = common >= threshold * (n[:, None] + n - common) - 1e-6
            np.fill_diagonal(alike, False)
            if not rows["within"][0].as_py():
                alike &= block[:, None] != block
            near = alike @ weight
            for i in np.nonzero(near)[0].tolist():
                nodes.append(names[i])
                others.append(None)
                links.append(int(near[i]))
            for i, j in forest(alike):
                nodes.append(names[i])
                others.append(names[j])
                links.append(None)
            if len(nodes) > 20_000:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.binary()), pa.array(others, pa.binary()), pa.array(links, pa.int64())],
                    schema=LINKS,
                )
                nodes, others, links = [], [], []
        if nodes:
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.binary()), pa.array(others, pa.binary()), pa.array(links, pa.int64())],
                schema=LINKS,
            )

    return (
        tiles.repartition("tile")
        .sortWithinPartitions("tile", "node")
        .mapInArrow(body, "node binary, other binary, links bigint")
    )


def with_hashes(texts: DataFrame, width: int) -> DataFrame:
    """``texts`` (group, size, node, weight, text) with n and hashes instead of the text.

    Rows whose text isn't that of the set (an id used twice) are left out, and so are most
    repeated rows; tiles leave out the rest.
    """

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in batches:
            keep, hashes, sizes = [], [], []
            names, done = batch.column(2).to_pylist(), set()
            for at, value in enumerate(batch.column(4).to_pylist()):
                if names[at] in done:
                    continue
                own = shingles.of(value)
                if name_of(own) == names[at]:
                    done.add(names[at])
                    keep.append(at)
                    hashes.append(own.tobytes())
                    sizes.append(len(own))
            taken = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i).take(taken) for i in range(4)),
                    pa.array(sizes, pa.int64()),
                    pa.array(hashes, pa.binary()),
                ],
                names=["group", "size", "node", "weight", "n", "hashes"],
            )

    return texts.select("group", "size", "node", "weight", "text").mapInArrow(
        body, "group binary, size bigint, node binary, weight bigint, n bigint, hashes binary"
    )


def similar_documents(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    threshold: float = THRESHOLD,
    runs: int = RUNS,
    small: int = SMALL_NODE,
    depth: int = DEPTH,
) -> DataFrame:
    """doc_id, class_id (least id of the class), n_links (other documents at the threshold)."""
    rows = stored(sets_of(docs, key, text, width), "sets")
    classes = stored(
        rows.where("node is not null")
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("first_id"),
            F.min_by("mark", F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("mark"),
            F.count(F.lit(1)).alias("weight"),
            F.first("sketch").alias("sketch"),
        ),
        "classes",
    )
    edges = loose_edges(classes.select("node", "sketch"), runs=runs, small=small, depth=depth)
    groups = stored(components(edges), "groups")
    sizes = groups.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    candidates = stored(
        groups.join(sizes, "label")
        .join(classes.select("node", "mark", "weight"), "node")
        .select(F.col("label").alias("group"), "size", "node", "weight", "mark"),
        "candidates",
    )
    texts = docs.select(mark_of(docs[key], docs[text]).alias("mark"), docs[text].alias("text"))
    texts = join_small(texts, candidates, ["mark"], ["text"])
    links = stored(verified(with_hashes(texts, width), threshold), "links")
    near = links.where("links is not null").groupBy("node").agg(F.sum("links").alias("near"))
    labels = components(
        links.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    )
    known = classes.select("node", "first_id", "weight").join(labels, "node", "left").join(
        near, "node", "left"
    ).withColumn("label", F.coalesce("label", "node"))
    least = known.groupBy("label").agg(F.min("first_id").alias("class_id"))
    named = stored(
        known.join(least, "label").select(
            "node",
            "class_id",
            (F.col("weight") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"),
        ),
        "named",
    )
    lonely = rows.where("node is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links")
    )
    return (
        rows.where("node is not null")
        .select("doc_id", "node")
        .join(named, "node")
        .select("doc_id", "class_id", "n_links")
        .unionByName(lonely)
    )
