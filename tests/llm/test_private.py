"""Personal data: plain patterns, all tag sequences, slopes by differences, held-out sentences."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from quillon.llm import private

SCHEMA = "doc_id bigint, text string, spans string, n_ip int"


def plain_base(text: str) -> list[tuple]:
    """The contract's patterns as they stand."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        if 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return found


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(8)
    parts = ["a@b.c", "@", ".", "-", "+", "_", " ", "1", "255", "256", "4111111111111111", "(", ")", "x", "é", "+49", "\n", "%", "00"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert private.base_spans(text) == plain_base(text), text
    for text, _ in private.examples(4):
        assert private.base_spans(text) == plain_base(text)


@pytest.mark.parametrize("unit", ["a", "1", "1.", "+1 ", "a@", "1-", " (1", "a.b@c-", "@1.2"])
def test_long_texts_take_linear_time(unit):
    text = unit * (100_000 // len(unit))
    (base, added), = private.all_spans(private.trained(), [text])
    assert all(0 <= s < e <= len(text) for _, s, e in base + added)


def test_viterbi_finds_the_best_of_all_tag_sequences():
    rng = np.random.default_rng(5)
    field = private.Field(
        rng.normal(size=(len(private.OFFSETS), private.WIDTH, private.N_TAGS)),
        rng.normal(size=(private.WIDTH, private.WIDTH, private.N_TAGS)),
        rng.normal(size=(private.N_TAGS, private.N_TAGS)) + private.barred(),
    )
    rows = [rng.integers(0, private.WIDTH, n).tolist() for n in (1, 4, 2, 4, 3)]
    for row, tags in zip(rows, private.decode(field, rows, step_rows=3), strict=True):
        scores = field.scores(private.padded([row]))[0]

        def worth(path, scores=scores):
            steps = sum(field.step[a, b] for a, b in zip(path, path[1:], strict=False))
            return private.FIRST[path[0]] + steps + sum(scores[i, t] for i, t in enumerate(path))

        best = max(itertools.product(range(private.N_TAGS), repeat=len(row)), key=worth)
        assert worth(tuple(tags.tolist())) == pytest.approx(worth(best))


def test_likelihood_of_all_sequences_sums_to_one():
    """After a fit, the gold tags of a tiny table are the likeliest of all sequences."""
    rows, tags = [[3, 9, 5], [9, 5]], [[0, 3, 4], [3, 4]]
    field = private.fit(rows, tags, rounds=30)
    for row, gold in zip(rows, tags, strict=True):
        scores = field.scores(private.padded([row]))[0]
        worth = {
            path: private.FIRST[path[0]] + sum(field.step[a, b] for a, b in zip(path, path[1:], strict=False))
            + sum(scores[i, t] for i, t in enumerate(path))
            for path in itertools.product(range(private.N_TAGS), repeat=len(row))
        }
        assert max(worth, key=worth.get) == tuple(gold)
        total = np.log(sum(np.exp(w) for w in worth.values()))
        assert np.exp(worth[tuple(gold)] - total) > 0.9


def test_held_out_sentences():
    right = missed = extra = 0
    for text, spans in private.examples(seed=77, times=20):
        (base, added), = private.all_spans(private.trained(), [text])
        found = set(base) | set(added)
        right += len(found & set(spans))
        missed += len(set(spans) - found)
        extra += len(found - set(spans))
    assert right / (right + missed) >= 0.95
    assert right / (right + extra) >= 0.95


def test_values_that_patterns_swallow():
    texts = [
        "word +1 (243) 555-5526 4111111111111111 word",
        "word 7536784127813050 4111111111111111 word",
        "write to anna (at) post (dot) org today",
        "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" only words. Version 2.0.",
    ]
    found = private.all_spans(private.trained(), texts)
    assert ("card", 23, 39) in found[0][0] + found[0][1]
    assert ("phone", 5, 22) in found[0][0] + found[0][1]
    assert ("card", 22, 38) in found[1][1]
    assert [k for k, _, _ in found[2][1]] == ["email"]
    assert found[3] == ([], [])


def test_table_with_odd_rows(spark):
    docs = [(1, None), (2, ""), (None, "a@b.cd é 1.2.3.4"), (3, "plain words"), (3, "plain words"), (4, "x" * 100_000 + " a@b.cd")]
    df = spark.createDataFrame([(*d, "clash", 5) for d in docs], SCHEMA)
    rows = private.personal_data(df).collect()
    assert len(rows) == len(docs)
    texts = {(i, t) for i, t in docs}
    by_row = sorted((r.doc_id if r.doc_id is not None else -1, r.spans, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in rows)
    wanted = []
    for doc_id, text in docs:
        (base, added), = private.all_spans(private.trained(), [text or ""])
        joined = private.ordered(base)
        counts = [sum(k == kind for k, _, _ in base) for kind in private.KINDS]
        wanted.append((doc_id if doc_id is not None else -1, private.ordered(base + added), hashlib.sha256(joined.encode()).hexdigest(), *counts))
    assert by_row == sorted(wanted)
    assert len(texts) == 5
    assert private.personal_data(spark.createDataFrame([], SCHEMA)).collect() == []
