"""The training-data operators against brute force, libraries and round trips, on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import (
    chat,
    counts,
    graph,
    jaccard,
    leaks,
    pieces,
    quality,
    rules,
    sequences,
    shards,
    suffixes,
)

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [
    None,
    "",
    " ",
    "\n\n  \t",
    "a",
    "two words",
    "dup dup dup dup dup",
    "▁ marks ▁▁ and  spaces   three",
    "end\n next \n\n line  \nlast ",
    "<|endoftext|> inside<|endoftext|>",
    "tab\x1cfs\x00nul 　wide é ﬁ 🙂 Σς İ",
    "</s>[INST] \\s \\l < > [/INST]",
    "long" * 3000,
]


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    parts = ["the", "an", "tion", "er", "ing", "Re", "st", "ou", "é", "ly", "on"]
    return " ".join("".join(draw.choices(parts, k=draw.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts() -> list[tuple[int | None, str | None]]:
    """Odd texts, copies, near copies, shared passages, repeated rows and a null id."""
    rows = list(enumerate(ODD))
    shared = prose(99, 60)
    for i in range(30):
        rows.append((100 + i, prose(i, 40 + 5 * i)))
    for i in range(12):
        rows.append((200 + i, prose(3, 55)))
        words = prose(25, 150).split()
        words[(i * 13) % 150] = f"changed{i}"
        rows.append((300 + i, " ".join(words)))
        rows.append((400 + i, f"{prose(500 + i, 30)}\n{shared} {prose(600 + i, 30)}"))
    rows += [(100, prose(0, 40)), (None, prose(1, 45)), (None, "lonely null id")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With extra columns that bear names which results or inner steps use."""
    rows = [(d, t, "en", f"src{i % 3}", len(t or "")) for i, (d, t) in enumerate(texts)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return frame.withColumns(
        {c: F.lit(7) for c in ("node", "size", "shard", "slot", "batch", "n_bytes", "kept", "row")}
    )


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def by_row(frame, *columns):
    """Rows as sorted tuples; null ids make keys that don't sort otherwise."""
    return sorted(map(tuple, frame.select(*columns).collect()), key=repr)


# --- pieces ---------------------------------------------------------------------------------


def test_pieces_equal_the_library():
    own = pieces.Pieces(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    draw = random.Random(4)
    vocabulary = list(own.id_of)
    made = ["".join(draw.choices("abcdehnrst  ▁\né", k=draw.randint(1, 60))) for _ in range(2000)]
    made += [
        "".join(draw.choices(vocabulary, k=8)).replace(pieces.SPACE, " ") for _ in range(2000)
    ]
    for text in made + [t for t in ODD if t] + [prose(1, 300), " " * 40 + "x"]:
        ids = library.encode(text)
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids)
        assert own.joined(text) == (len(ids), ",".join(map(str, ids)), library.decode(ids))


def test_pieces_over_a_table(docs, texts, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for d, t in texts:
        ids = library.encode(t or "")
        sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((d, len(ids), sha))
    assert by_row(pieces.round_trip(docs, PIECES), "doc_id", "n_tokens", "ids_sha256") == sorted(
        want, key=repr
    )
    encoded = pieces.encode_documents(docs, PIECES)
    back = by_row(pieces.decode_documents(encoded, PIECES), "doc_id", "text")
    assert back == sorted(((d, library.decode(library.encode(t or ""))) for d, t in texts), key=repr)
    assert pieces.round_trip(empty, PIECES).count() == 0


# --- suffixes -------------------------------------------------------------------------------


def brute_repeats(rows, length):
    first: dict[bytes, float] = {}
    order = lambda d: float("-inf") if d is None else d
    for d, t in sorted(rows, key=lambda r: order(r[0])):
        data = (t or "").encode()
        for i in range(len(data) - length + 1):
            first.setdefault(data[i : i + length], order(d))
    out = []
    for d, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < order(d):
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for part in bytes(gone).split(b"\0") if part)
        out.append((d, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batch_bytes", [1 << 20, 3000])
def test_repeats_equal_brute_force(docs, texts, empty, batch_bytes):
    done = suffixes.remove_repeats(docs, batch_bytes=batch_bytes)
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert by_row(done, *columns) == brute_repeats(texts, suffixes.LENGTH)
    assert "lang" in done.columns
    if batch_bytes == 3000:
        assert suffixes.remove_repeats(empty).count() == 0


def test_a_batch_of_repeats_stays_small():
    """Positions of a whole batch and what is sent of it, two tasks beside their executor."""
    draw = np.random.default_rng(3)
    texts = [draw.integers(97, 123, 1 << 16, np.uint8).tobytes() for _ in range(suffixes.BATCH_BYTES >> 16)]
    rounds = suffixes.Rounds("text", "doc_id", suffixes.LENGTH, suffixes.HEAD, 4)
    ids = np.arange(len(texts))
    tracemalloc.start()
    rounds.first(0, suffixes.positions(texts, ids, ids * 0, suffixes.LENGTH, suffixes.HEAD))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def test_repeats_of_few_letters(spark):
    draw = random.Random(5)
    rows = [(i, "".join(draw.choices("ab", k=draw.randint(0, 400)))) for i in range(60)]
    rows += [(70 + i, "ab" * 90 + "x" * i) for i in range(8)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    done = suffixes.remove_repeats(frame, length=12, head=7, batch_bytes=2000)
    got = by_row(done, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_repeats(rows, 12)


# --- sequences ------------------------------------------------------------------------------


def test_sequences_read_back(docs, texts, empty, tmp_path):
    library = Tokenizer.from_file(WORDS)
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at, stream = [], 0, []
    for d, t in order:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        want.append((d, at, len(ids), crc))
        at += len(ids)
        stream += ids
    got = by_row(
        sequences.documents_through_files(docs, WORDS), "doc_id", "start", "n_tokens", "ids_crc32"
    )
    assert got == sorted(want, key=repr)
    assert sequences.documents_through_files(empty, WORDS).count() == 0

    path = f"file://{tmp_path}/seq"
    files = sequences.write_sequences(docs.coalesce(1), path, WORDS, length=64).orderBy("order")
    read = []
    for row in files.collect():
        assert row["file"].startswith(f"{tmp_path}/seq")
        for number in range(-(-row["tokens"] // 64)):
            ids, mask = sequences.sequence(f"{row['file']}.arrow", number)
            assert len(ids) == len(mask) == 64
            read += ids[mask].tolist()
    assert read == stream


# --- quality --------------------------------------------------------------------------------


def test_classifier_on_held_out_rows(spark):
    rows, labels = [], []
    for i in range(600):
        text, low, toxic = prose(i, 80), i % 5 == 0, i % 7 == 0
        if low:
            text = " ".join(f"{w}$$$" for w in text.split())
        if toxic:
            text += " moron idiot " + prose(i + 9000, 10)
        rows.append((i, text, "en" if i % 2 else "fr", f"src{i % 4}"))
        if i < 400:
            labels.append((i, int(not low), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in quality.classify(docs, known).collect()}
    right = sum(kept[i] == (i % 5 != 0 and i % 7 != 0) for i in range(400, 600))
    assert right >= 196
    # Without labels nothing is rejected; nulls everywhere do no harm.
    odd = docs.unionByName(spark.createDataFrame([(None, None, None, None)], docs.schema))
    unlabelled = quality.classify(odd, known.where("false"))
    assert unlabelled.where("kept").count() == 601
    assert quality.classify(odd, known).count() == 601
    assert quality.classify(docs.where("false"), known).count() == 0


def test_sparse_sites_are_shrunk(spark):
    rows = [("big", "a", 2.0)] * 400 + [("big", "b", 2.0)] * 390 + [("bad", "a", -2.0)] * 300
    rows += [("small", "a", -2.0), (None, None, 2.0)]
    evidence = spark.createDataFrame(rows, "site_0 string, site_1 string, evidence double")
    found = {
        (r["site_0"], r["site_1"]): r["path_posterior"]
        for r in quality.site_posteriors(evidence).collect()
    }
    assert found["bad", "a"] < 0.2 < 0.8 < found["big", "a"]
    # One bad document doesn't make a bad site.
    assert found["bad", "a"] + 0.1 < found["small", "a"] < found["big", "a"]


# --- leaks ----------------------------------------------------------------------------------


def test_leaks_equal_brute_force(spark, docs, texts, empty):
    bench = [(1, prose(3, 30)), (2, prose(77, 40)), (3, "two words"), (4, None), (5, ""), (6, "a")]
    bench += [(None, prose(4, 20)), (7, " ".join(prose(5, 40).split()[:36]) + " x y z w"), (1, "b")]
    items = spark.createDataFrame(bench, "item_id bigint, text string").withColumn("size", F.lit(1))
    words = lambda t: [w for w in _words(t or "") if w]

    def shingles(t, n):
        w = words(t)
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else set()

    sizes: dict = defaultdict(set)
    for i, t in bench:
        if words(t):
            n = min(5, len(words(t)))
            sizes[i, n] |= shingles(t, n)
    by_id = defaultdict(list)
    for d, t in texts:
        by_id[d].append(t)
    want = []
    for d, own in by_id.items():
        for (i, n), s in sizes.items():
            hit = len(set().union(*(shingles(t, n) for t in own)) & s)
            if hit >= 0.8 * len(s) - 1e-9:
                want.append((d, i, len(s), hit))
    got = by_row(leaks.contained_items(docs, items), "doc_id", "item_id", "size", "matched")
    assert got == sorted(want, key=repr)
    assert {i for _, i, _, _ in got} >= {1, 3, 6, 7, None}
    assert leaks.contained_items(empty, items).count() == 0
    assert leaks.contained_items(docs, items.where("false")).count() == 0


def test_leaks_by_joins_are_the_same(spark, docs, monkeypatch):
    items = spark.createDataFrame([(1, prose(3, 30)), (2, "two words")], "item_id bigint, text string")
    columns = ("doc_id", "item_id", "matched")
    want = by_row(leaks.contained_items(docs, items), *columns)
    monkeypatch.setattr(leaks, "fits_broadcast", lambda df: False)
    assert by_row(leaks.contained_items(docs, items), *columns) == want


def _words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split(" ")


# --- rules ----------------------------------------------------------------------------------


def test_base_counts_by_example():
    text = "one two three\none two three\n\n#a *b c"
    assert rules.base_counts(text) == (9, 27, 2, 1, 6, True)
    assert rules.base_counts(None) == rules.base_counts("") == (0, 0, 0, 0, 0, True)
    assert rules.base_counts("a b c a b c d e f")[4] == 6
    assert rules.base_counts("x x x x")[4] == 4
    assert rules.base_counts("\x1cword \xa0word")[0] == 2


def test_compression_bands():
    fine = prose(1, 400)
    noise = "".join(random.Random(3).choices([chr(c) for c in range(0x21, 0x2FF)], k=9000))
    assert rules.compression(fine)[2]
    assert not rules.compression("again and again. " * 800)[2]
    assert not rules.compression(noise)[2]
    # Half of the chunks repeat although the whole is within its band.
    mixed = prose(2, 3000) + "tick tock " * 4000
    assert rules.compression(mixed)[1] > 0.5
    assert not rules.compression(mixed)[2]


def test_rules_over_a_table(docs, texts, empty):
    got = by_row(rules.quality_rules(docs), "doc_id", "n_words", "n_repeat_words", "kept")
    want = []
    for d, t in texts:
        judged = rules.judge(t)
        want.append((d, judged[0], judged[4], judged[-1]))
    assert got == sorted(want, key=repr)
    assert rules.quality_rules(empty).count() == 0


# --- jaccard --------------------------------------------------------------------------------


def brute_classes(rows, threshold):
    sets = []
    for _, t in rows:
        w = jaccard.WORD.findall((t or "").lower())
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    group = list(range(len(rows)))
    links = Counter()
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (d, _), g in zip(rows, group, strict=True):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    return sorted(((d, least.get(g), links[i]) for i, ((d, _), g) in enumerate(zip(rows, group, strict=True))), key=repr)


@pytest.mark.parametrize(
    "limits", [{}, {"small": 2, "depth": 2}], ids=["usual", "every node is too large"]
)
def test_similar_documents_equal_brute_force(spark, docs, texts, empty, limits, monkeypatch):
    rows = [r for r in texts if r[0] is not None]
    if limits:
        monkeypatch.setattr(jaccard, "TILE", 4)
    found = jaccard.similar_documents(docs.where("doc_id is not null"), **limits)
    assert by_row(found, "doc_id", "class_id", "n_links") == brute_classes(rows, 0.8)
    if not limits:
        assert jaccard.similar_documents(empty).count() == 0
        assert jaccard.similar_documents(docs).count() == len(texts)


def test_null_ids_do_not_meet(spark):
    """Near copies without ids are told apart by their texts, and classes come out whole."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    texts = []
    for i in range(60):
        words = list(base)
        words[i] = f"other{i}"
        texts.append(" ".join(words))
    rows = [(None, t) for t in texts] + [(None, "quite another text of six words")] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    links = Counter(r.n_links for r in jaccard.similar_documents(docs).collect())
    sets = [plain_shingles(t) for t in texts]
    wanted = Counter(
        sum(a is not b and len(a & b) >= 0.8 * len(a | b) for b in sets) for a in sets
    )
    assert links == wanted + Counter({2: 3})


def plain_shingles(text: str) -> set:
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_core_loses_no_similar_pair():
    """What a core set and an unlinked one may agree in at most is out of reach of a true pair."""
    n, p = jaccard.COORDINATES, jaccard.THRESHOLD
    agree = n - math.ceil(jaccard.MARGIN * n)
    chance = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(agree + 1))
    assert chance < 1e-4


def test_leaders_settle_a_loose_family(spark, monkeypatch):
    """Sets of one family, many of them just too far from any single one, are not split again."""
    draw = np.random.default_rng(5)
    base = draw.integers(0, 1 << 32, jaccard.COORDINATES, np.uint32)
    own = draw.integers(0, 1 << 32, (400, jaccard.COORDINATES), np.uint32)
    sketches = np.where(draw.random(own.shape) < 0.68, base, own)
    near = (sketches[:, None] == sketches).mean(axis=2)
    assert 0.1 < (near < jaccard.LOOSE).mean() < 0.5
    rows = [(bytes([i // 256, i % 256]), s.tobytes()) for i, s in enumerate(sketches)]
    sets = spark.createDataFrame(rows, "node binary, sketch binary")
    levels, children = [], jaccard.children
    monkeypatch.setattr(
        jaccard, "children", lambda *given: levels.append(given) or children(*given)
    )
    found = graph.components(jaccard.loose_edges(sets)).groupBy("label").count().collect()
    assert [row["count"] for row in found] == [400]
    assert len(levels) == 1


def test_grouped_leaders_reach_no_unlinked_row():
    alike = np.zeros((9, 3), bool)
    alike[[0, 1, 2], [0, 1, 2]] = True
    alike[0, 1] = alike[1, 0] = True
    alike[3, 0] = alike[4, 1] = alike[5, 2] = alike[7, 2] = alike[8, 2] = True
    main, core, edges = jaccard.grouped(alike)
    assert core == 0 and main.tolist() == [True, True, False, True, True, False, False, False, False]
    assert len(edges) == 1 and set(edges[0]) == {0, 1}
    alike[7, 1] = True
    main, core, edges = jaccard.grouped(alike)
    assert main.tolist() == [True] * 6 + [False, True, True] and (7, 2) in edges[1:]


def test_components(spark):
    edges = [(f"c{i}", f"c{i + 1}") for i in range(60)] + [("hub", f"s{i}") for i in range(40)]
    edges += [("x", "x"), ("s1", "hub")]
    found = graph.components(spark.createDataFrame(edges, "a string, b string")).collect()
    by_label = defaultdict(set)
    for row in found:
        by_label[row["label"]].add(row["node"])
    assert sorted(map(len, by_label.values())) == [41, 61]
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0


# --- counts ---------------------------------------------------------------------------------


def test_token_counts_equal_the_library(docs, texts, empty, monkeypatch):
    library = Tokenizer.from_file(BYTES)
    draw = random.Random(8)
    want = sorted(
        (
            (d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids))
            for d, t in texts
        ),
        key=repr,
    )
    columns = ("doc_id", "n_bytes", "n_tokens")
    assert by_row(counts.token_counts(docs, BYTES), *columns) == want
    # With few tokens sent to the tasks the join gives the same.
    monkeypatch.setattr(counts._most_frequent, "__defaults__", (3,))
    assert by_row(counts.token_counts(docs, BYTES), *columns) == want
    assert counts.token_counts(empty, BYTES).count() == 0
    split = counts.PreTokens(BYTES)
    for _ in range(3000):
        text = "".join(draw.choices(["a", "'s", " ", "\n", "B9", "é", "!", "\t", "  "], k=12))
        assert sorted(split.of(text).elements()) == sorted(counts.PRE_TOKEN.findall(text))


# --- chat -----------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    hard = "</s>[INST] <|end|>\n \\l \\s \\\\ <|user|>\n>"
    rows = [
        (1, 0, "system", "be\nkind"),
        (1, 1, "user", hard),
        (1, 2, "assistant", hard),
        (2, 0, "assistant", "first"),
        (2, 1, "user", None),
        (3, 0, "user", ""),
        (3, 0, "user", ""),
        (3, None, None, "no role"),
        (4, 1, "assistant", ""),
        (4, 0, "user", "x" * 50_000),
        (None, 0, "to<ol>|>", "t"),
    ]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    made = chat.format_conversations(turns.withColumn("said", F.lit(1)).repartition(3)).select(
        "conv_id",
        "order_ok",
        chat.read_turns(chat.formatted_text(F.col("segments"))).alias("turns"),
        chat.read_loss_text(F.col("segments")).alias("loss"),
    )
    found = {r["conv_id"]: r for r in made.collect()}
    as_read = lambda c: [tuple(t) for t in found[c]["turns"]]
    assert as_read(1) == [("system", "be\nkind"), ("user", hard), ("assistant", hard)]
    assert as_read(2) == [("assistant", "first"), ("user", "")]
    assert as_read(3) == [("", "no role"), ("user", ""), ("user", "")]
    assert as_read(None) == [("to<ol>|>", "t")]
    assert found[1]["loss"] == hard and found[4]["loss"] == ""
    assert {c: r["order_ok"] for c, r in found.items()} == {
        1: True, 2: False, 3: False, 4: True, None: False
    }
    assert chat.format_conversations(turns.where("false")).count() == 0


# --- shards ---------------------------------------------------------------------------------


def test_shards(spark, docs, texts, empty, tmp_path):
    placed = shards.shard_documents(docs, 5)
    rows = placed.collect()
    assert len(rows) == len(texts)
    by_shard = defaultdict(list)
    for r in rows:
        assert r["grown_shard"] in (r["shard"], 5)
        assert r["text_crc32"] == zlib.crc32((r["text"] or "").encode())
        assert r["size"] == len((r["text"] or "").encode()) + 16
        by_shard[r["shard"]].append(r["slot"])
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    keys = spark.range(20_000).withColumn("j", shards.jump_shards(F.col("id"), 1, 9, 10, 11))
    sizes = keys.groupBy("j.of_10").count().collect()
    assert len(sizes) == 10 and all(1800 < r["count"] < 2200 for r in sizes)
    moved = keys.where("j.of_10 <> j.of_11")
    assert 1500 < moved.count() < 2150 and moved.where("j.of_11 <> 10").count() == 0
    assert keys.where("j.of_1 <> 0 or (j.of_9 <> j.of_10 and j.of_10 <> 9)").count() == 0
    assert shards.shard_documents(empty, 5).count() == 0
    shards.write_shards(placed.select("doc_id", "shard", "slot"), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(texts)
