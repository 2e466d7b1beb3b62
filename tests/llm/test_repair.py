"""Conversation repair against a plain search for the cheapest, ASCII-least edits."""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

from quillon.llm import repair

NEXT = {"-": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}
KEPT = {"-": "su", "s": "u", "u": "a", "a": "u"}
SCHEMA = "conv_id bigint, turn bigint, role string, text string, part int, symbol string"


def plain(rows: list[tuple]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired text of one conversation."""
    rows = sorted(
        ((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
        key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]),
    )
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    faults, seen = [], set()
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        if not bare:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))

    @lru_cache(maxsize=None)
    def best(i: int, state: str, inserted: int) -> tuple[int, str, tuple]:
        ways = []
        if i == len(rows) and state in "-a":
            ways.append((0, "", ()))
        if inserted < 3:
            to = NEXT[state]
            cost, edits, out = best(i, to, inserted + 1)
            ways.append((cost + 5, "I" + edits, (f"{NAMES[to]}:", *out)))
        if i < len(rows):
            cost, edits, out = best(i + 1, state, 0)
            ways.append((cost + 2, "D" + edits, out))
            if faults[i] in ("", "truncated"):
                more = 5 * (faults[i] == "truncated")
                _, role, text = rows[i]
                if role[:1] and role[:1] in KEPT[state]:
                    cost, edits, out = best(i + 1, role[0], 0)
                    ways.append((cost + more, "K" + edits, (f"{role}:{text}", *out)))
                to = NEXT[state]
                cost, edits, out = best(i + 1, to, 0)
                ways.append((cost + more + 1, "R" + edits, (f"{NAMES[to]}:{text}", *out)))
        return min(ways) if ways else (10**9, "", ())

    cost, edits, out = best(0, "-", 0)
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return gaps, *counts, illegal, cost, edits, digest


def found(spark, rows: list[tuple], **how) -> dict:
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)
    done = repair.repair(df, **how)
    digests = {r.conv: r.repaired_sha256 for r in repair.digests(done.turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {
        r.conv: (
            r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit,
            digests.get(r.conv, empty),
        )
        for r in done.summary.collect()
    }


def made_up(seed: int, conversations: int, longest: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for conv in [*range(conversations), None]:
        for _ in range(rng.randint(1, longest)):
            turn = rng.choice([None, *range(longest)])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "cut off", "", " \n", None, f"T{rng.randint(0, 30)}?", "Ünd. "])
            rows += [(conv, turn, role, text)] * rng.choice([1, 1, 1, 2, 4])
    return rows


def expected(rows: list[tuple]) -> dict:
    by_conv: dict = {}
    for conv, *row in rows:
        by_conv.setdefault("" if conv is None else f"={conv}", []).append(tuple(row))
    return {conv: plain(group) for conv, group in by_conv.items()}


def test_small_conversations(spark):
    rows = made_up(3, 60, 9)
    assert found(spark, rows) == expected(rows)


def test_conversations_over_many_chunks(spark):
    """Chunks of three rows and two parts to a node: long conversations climb several levels."""
    rows = made_up(5, 6, 45)
    assert found(spark, rows, chunk=3, fan=2) == expected(rows)


def test_copies_and_long_texts(spark):
    rows = [(1, 0, "user", "Hm.")] * 120 + [(1, 1, "assistant", "x" * 300_000 + ".")]
    rows += [(2, None, "user", "same?")] * 40 + [(3, 5, "system", "Only.")]
    assert found(spark, rows) == expected(rows)


def test_empty_table(spark):
    assert found(spark, []) == {}


def test_vectors_are_few_and_blocks_agree_with_steps():
    t = repair.tables()
    assert len(t.vectors) < 200
    rng = random.Random(1)
    for _ in range(300):
        symbols = [rng.randrange(1, repair.SYMBOLS) for _ in range(rng.randint(1, 11))]
        behind = rng.randrange(len(t.vectors))
        whole = repair.summary(symbols)
        for state in range(repair.STATES):
            assert repair.traced(symbols, behind, state)[2] == whole.leaves[behind][state]
