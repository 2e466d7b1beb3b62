"""Exact nearest vectors for a table of queries, and the default text embedding."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.bm25 import top_k
from quillon.operators.filters import FILTER_COLUMNS
from quillon.scale import BROADCAST_BYTES

DIMENSION = 64
QUERY_BLOCK = 2048
VECTOR_BLOCK = 8192
# Scores that are worked out at a time.
TILE = 1 << 20
# Words a task remembers the slots of.
KNOWN_WORDS = 1 << 20


class _Slots(dict):
    """The slot of each word met so far."""

    def __init__(self, dimension: int) -> None:
        self.dimension, self.digits = dimension, max(1, math.ceil(math.log2(dimension) / 4))

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        # The hash is a 128-bit number; its last hex digits decide it modulo a power of two.
        self[word] = int(md5(word.encode()).hexdigest()[-self.digits :], 16) % self.dimension
        return self[word]


def hashed_words(text: Column, dimension: int = DIMENSION) -> Column:
    """The offline embedding: a-z words counted in md5 buckets (a power of two), length 1."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def unit_counts(texts: pd.Series) -> pd.Series:
        slots, words = _Slots(dimension), re.compile("[a-z]+")

        def one(lowered: str) -> np.ndarray:
            times = Counter(words.findall(lowered))
            at = np.array([slots[w] for w in times], dtype=np.int64)
            counts = np.bincount(at, np.fromiter(times.values(), np.float64, len(times)), dimension)
            return counts / (np.sqrt(counts @ counts) or 1.0)

        return texts.map(one)

    return unit_counts(F.lower(text))


def _allowed(queries: pd.DataFrame, rows: pd.DataFrame, fields: list[str]) -> np.ndarray | None:
    """Which (query, row) pairs the filters let through, as a mask; None if all.

    Labels become numbers; a field is then one product of 0/1 matrices, queries by labels and
    labels by rows.
    """
    mask: np.ndarray | None = None
    for field in fields:
        wanted = [() if w is None else tuple(w) for w in queries[f"q_{field}"]]
        labels = {label: i for i, label in enumerate({v for values in wanted for v in values})}
        if not labels:
            continue
        held = [() if t is None else t for t in rows[field]] if field == "topics" else [
            (t,) for t in rows[field]
        ]
        asks, has = (
            _incidence(side, labels) for side in (wanted, held)
        )
        free = np.array([not values for values in wanted])[:, None]
        passes = free | (asks @ has.T > 0)
        mask = passes if mask is None else mask & passes
    return mask


def _incidence(sets: Sequence[Sequence[str]], labels: dict[str, int]) -> np.ndarray:
    out = np.zeros((len(sets), len(labels)), np.float32)
    pairs = [(i, labels[v]) for i, values in enumerate(sets) for v in values if v in labels]
    if pairs:
        out[tuple(zip(*pairs, strict=True))] = 1
    return out


def _at_least(scores: np.ndarray, k: int) -> np.ndarray | float:
    """For each row of scores a value that at least ``k`` of them reach: the ``k``-th best of the
    best of stretches."""
    wide = scores.shape[1]
    stretch = max(1, wide // (4 * k))
    if wide // stretch <= k:
        return -np.inf
    tops = scores[:, : wide // stretch * stretch].reshape(len(scores), -1, stretch).max(axis=2)
    return np.partition(tops, -k, axis=1)[:, -k, None]


def _reaching(
    q: np.ndarray, v: np.ndarray, mask: np.ndarray | None, kth: np.ndarray, k: int, at: slice
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, score) of what can be among the best ``k`` of the queries ``at``."""
    scores = q[at] @ v.T
    if mask is not None:
        scores[~mask[at]] = -np.inf
    if np.isnan(scores.min(initial=0)):
        scores[np.isnan(scores)] = -np.inf
    # Scores count to 9 digits; what is further below what k rows reach can't be among the hits.
    least = np.maximum(np.broadcast_to(_at_least(scores, k), (len(scores), 1)), kth[at])
    found = np.flatnonzero(scores >= np.maximum(least - 1e-8, np.finfo(np.float64).min))
    query, place = np.divmod(found, scores.shape[1])
    return query + at.start, place, scores.ravel()[found]


def _nearest(
    queries: pd.DataFrame, rows: pd.DataFrame, k: int, fields: list[str],
    before: pd.DataFrame | None = None,
) -> pd.DataFrame:
    """The best ``k`` rows of one block, and of those ``before``, for each query of one block, by
    dot product; ``query`` is a query's place in its block."""
    q = np.stack(queries["vec"].to_numpy()).astype(np.float64)
    v = np.stack(rows["vec"].to_numpy()).astype(np.float64)
    mask = _allowed(queries, rows, fields)
    kth = np.full((len(q), 1), -np.inf)
    if before is not None:
        full = before[before["rank"] == k - 1]
        kth[full["query"].to_numpy(), 0] = full["dense_score"].to_numpy()
    # Some scores at a time, so that they stay near the processor.
    step = max(1, TILE // max(1, len(v)))
    parts = [_reaching(q, v, mask, kth, k, slice(at, at + step)) for at in range(0, len(q), step)]
    query, place, score = (np.concatenate(x) for x in zip(*parts, strict=True))
    found = pd.DataFrame(
        {
            "query": query,
            "query_id": queries["query_id"].to_numpy()[query],
            "chunk_id": rows["chunk_id"].to_numpy()[place],
            "dense_score": score,
        }
    )
    if before is not None:
        found = pd.concat([before.drop(columns="rank"), found], ignore_index=True)
    found["rank"] = -found["dense_score"].round(9)
    found = found.sort_values(["query", "rank", "chunk_id"], kind="stable", ignore_index=True)
    found["rank"] = found.groupby("query").cumcount()
    return found[found["rank"] < k]


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 15, *, block: int = VECTOR_BLOCK
) -> DataFrame:
    """``hits(query_id, chunk_id, dense_score, dense_rank)`` by cosine of unit vectors.

    Blocks of vectors meet blocks of queries as matrix products, and only the best ``k`` of
    all its meetings leave a task. No vector is ever shuffled.
    """
    fields = [f for f in FILTER_COLUMNS if f in vectors.columns and f"q_{f}" in queries.columns]
    rows = vectors.where("retrievable") if "retrievable" in vectors.columns else vectors
    rows = rows.select("chunk_id", "vec", *fields)
    asked = queries.select("query_id", "vec", *[f"q_{f}" for f in fields])
    schema = T.StructType(
        [
            T.StructField("query_id", asked.schema["query_id"].dataType),
            T.StructField("chunk_id", rows.schema["chunk_id"].dataType),
            T.StructField("dense_score", T.DoubleType()),
        ]
    )
    size = asked.agg(
        F.count(F.lit(1)),
        F.coalesce(F.sum(F.size("vec") * 8 + 64), F.lit(0)),
    ).first()
    # Questions travel to the vectors in blocks of a checked size; the vectors stay in place.
    blocks = min(size[0], -(-size[1] // max(1, BROADCAST_BYTES))) or 1
    local = None
    for number in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).toPandas()
        if some.empty and local is not None:
            continue
        found = rows.mapInPandas(
            _scan(vectors.sparkSession.sparkContext.broadcast(some), block, k, fields), schema
        )
        local = found if local is None else local.unionByName(found)
    return top_k(local, k, "dense_score", "dense_rank")


def _scan(held, block: int, k: int, fields: list[str]):
    """The best ``k`` of a task's vectors for each of the questions sent along."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, best = held.value, {}
        for frame in frames:
            for at in range(0, len(frame), block):
                piece = frame.iloc[at : at + block]
                for start in range(0, len(table), QUERY_BLOCK):
                    some = table.iloc[start : start + QUERY_BLOCK]
                    best[start] = _nearest(some, piece, k, fields, best.get(start))
        for found in best.values():
            yield found[["query_id", "chunk_id", "dense_score"]]

    return scan
