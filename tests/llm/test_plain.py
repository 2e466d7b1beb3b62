"""Shards, rules and chat order against plain Python written from the definitions."""

from __future__ import annotations

import random
import zlib

import xxhash
import zstandard
from pyspark.sql import functions as F

from quillon.llm import chat, rules, shards


def walked(key: str, most: int) -> int:
    """The shard of a key among ``most``, jump by jump."""
    at = shard = 0
    step = 0
    while at < most:
        step += 1
        seed = xxhash.xxh64_intdigest(key.encode(), seed=42)
        draw = xxhash.xxh64_intdigest(step.to_bytes(4, "little"), seed=seed) >> 33
        at = int((at + 1) * (float(1 << 31) / float(draw + 1)))
        if at < most:
            shard = at
    return shard


def test_shards_are_those_of_a_plain_walk(spark):
    rows = spark.range(3000).select("id", shards.jump_shards(F.col("id"), 7, 40, 41).alias("j")).collect()
    for r in rows:
        assert [r.j.of_7, r.j.of_40, r.j.of_41] == [walked(str(r.id), n) for n in (7, 40, 41)]


def test_shards_keep_columns_with_working_names(spark):
    rows = [(i, f"text {i % 7}", i, -i, f"j{i}", 777, i % 3) for i in range(60)] + [(None, None, 0, 0, "", 1, 2)] * 3
    schema = "doc_id bigint, text string, _slice int, _begin int, _jump string, _row int, __at_slice int"
    docs = spark.createDataFrame(rows, schema)
    placed = shards.shard_documents(docs, 5)
    kept = [tuple(r[c] for c in docs.columns) for r in placed.collect()]
    assert sorted(kept, key=repr) == sorted(rows, key=repr)
    again = shards.shard_documents(docs.withColumnRenamed("_row", "_at_row"), 5)
    assert sorted((r._at_row for r in again.collect())) == sorted(r[5] for r in rows)


def plain_rules(text: str | None) -> tuple:
    text = text or ""
    spaces = " \t\n\x0b\x0c\r"
    words, word = [], ""
    for ch in text + " ":
        if ch in spaces:
            words += [word] * bool(word)
            word = ""
        else:
            word += ch
    lines, earlier, doubled = text.split("\n"), set(), 0
    for line in lines:
        if line.strip(spaces):
            doubled += line in earlier
            earlier.add(line)
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    n = len(words)
    failed = n < 50 or 100 * len(repeated) > 50 * n
    data = text.encode()
    fits = False
    if data:
        pack = lambda part: len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(part)) / len(part)
        low, high = next(
            limits for top, limits in (
                (512, (0.36, 1.0)), (1024, (0.34, 0.8)), (4096, (0.31, 0.7)), (16384, (0.28, 0.62)), (1e18, (0.26, 0.58))
            ) if len(data) < top
        )
        parts = [data[i : i + 4096] for i in range(0, len(data), 4096)]
        if len(parts) > 1 and len(parts[-1]) < 2048:
            parts[-2:] = [parts[-2] + parts[-1]]
        out = sum(not 0.31 <= pack(p) <= 0.66 for p in parts) if len(parts) > 1 else 0
        fits = low <= pack(data) <= high and 2 * out <= len(parts)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), doubled, len(repeated), failed, fits and not failed


def test_rules_are_those_of_plain_counting(spark):
    rng = random.Random(9)
    texts: list = [None, "", " ", "a", "same line\nsame line\n\n\n \n"]
    for _ in range(250):
        size = rng.choice([20, 60, 200, 900, 3000])
        pool = [
            "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäé#*|<") for _ in range(rng.randint(1, 9)))
            for _ in range(rng.choice([4, 40, 400, 4000]))
        ]
        texts.append("".join(rng.choice(pool) + rng.choice([" ", " ", " ", "\n", "  ", " ", "\t"]) for _ in range(size)))
    texts += ["".join(chr(rng.randint(33, 0x2FFF)) for _ in range(9000)), "word " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    found = {r.doc_id: tuple(r[c] for c in names) for r in rules.quality_rules(docs).collect()}
    assert found == {i: plain_rules(t) for i, t in enumerate(texts)}
    assert {row[-1] for row in found.values()} == {True, False}


def test_turn_order_is_a_walk_over_roles(spark):
    rng = random.Random(3)
    follows = {"": {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}
    rows, wanted = [], {}
    for conv in range(200):
        roles = [rng.choice(["user", "assistant", "user", "assistant", "system"]) for _ in range(rng.randint(1, 5))]
        if conv % 3 == 0:
            roles = ["user", "assistant"] * rng.randint(1, 3)
        rows += [(conv, i, role, zlib.crc32(str((conv, i)).encode()).__str__()) for i, role in enumerate(roles)]
        steps = zip(["", *roles], roles, strict=False)
        wanted[conv] = all(b in follows[a] for a, b in steps) and roles[-1] == "assistant"
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = {r.conv_id: r.order_ok for r in chat.format_conversations(turns).collect()}
    assert found == wanted and len(set(found.values())) == 2
