"""Spelling variants against plain counting and all pairs, on small tables."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np

from quillon.llm import spelling

SCHEMA = "doc_id bigint, text string, word string, n int"


def counted(docs: list[tuple], damage: bool) -> dict[str, int]:
    seen: Counter = Counter()
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if damage and h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 6:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= 5}


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(words: dict[str, int]) -> set[tuple]:
    close: dict[str, list[str]] = {w: [] for w in words}
    for a, b in itertools.combinations(words, 2):
        if abs(len(a) - len(b)) <= 1 and near(a, b):
            close[a].append(b)
            close[b].append(a)
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    rows = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, len(close[w]), words[form[w]] if form[w] else None))
    return rows


def made_up(seed: int, size: int, letters: str = "abcéÉñ×") -> list[str]:
    rng = random.Random(seed)
    bases = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 8))) for _ in range(size)]
    words = []
    for base in bases:
        words += [base] * rng.choice([5, 5, 30, 200])
        for _ in range(3):
            at = rng.randrange(len(base))
            kind = rng.randrange(3)
            put = rng.choice(letters) if kind else ""
            words += [base[:at] + put + base[at + (kind != 1) :]] * rng.choice([1, 5, 6, 26])
    rng.shuffle(words)
    return words


def rows_of(df) -> set[tuple]:
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_variants_of_odd_tables(spark):
    words = made_up(2, 80)
    docs = [(i % 40 or None, " ".join(words[i::97])) for i in range(97)]
    docs += [(5, None), (6, ""), (7, "12 34"), (8, "x" * 50_000), (9, ("Größere-größere\n" * 40))]
    docs += [docs[3]] * 3
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], SCHEMA)
    for damage in (False, True):
        assert rows_of(spelling.variants(df, damage=damage)) == expected(counted(docs, damage))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rows_of(spelling.variants(df, damage=True)) == set()


def test_pairs_in_many_cells_and_blocks(spark):
    """Cells of a few words, blocks of fewer, a sample that lacks most lengths: nothing is lost."""
    words = {w: i + 5 for i, w in enumerate(sorted(set(made_up(4, 150, "abcd"))))}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    found = spelling.near_pairs(df, sample=60, cell_words=20, block_words=7).collect()
    pairs = {
        (a, words[a], b, words[b])
        for a, b in itertools.permutations(words, 2)
        if abs(len(a) - len(b)) <= 1 and near(a, b)
    }
    assert len(found) == len(pairs)
    assert {tuple(r) for r in found} == pairs


def test_range_search_against_all_distances():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 3, (400, spelling.LETTERS)) * (rng.random((400, spelling.LETTERS)) < 0.04)
    points[:90] = points[0]  # more equal vectors than a leaf holds
    queries = points[rng.integers(0, 400, 150)].copy()
    queries[np.arange(150), rng.integers(0, spelling.LETTERS, 150)] += 1
    dist = np.abs(queries[:, None, :] - points[None]).sum(axis=2)
    for radius in (1, 2):
        found = {(int(q), int(p)) for a, b in spelling.in_range(points, queries, radius) for q, p in zip(a, b, strict=True)}
        assert found == {(int(q), int(p)) for q, p in zip(*np.nonzero(dist <= radius), strict=True)}


def test_one_edit_looks_at_the_order_of_letters():
    pairs = [("abcdef", "abcdeg"), ("abcdef", "abcdfe"), ("abcdef", "abcdefg"), ("abcdef", "bacdefg"), ("aaaaaa", "aaaaaaa")]
    assert [bool(spelling.one_edit([a], [b])[0]) for a, b in pairs] == [True, False, True, False, True]
