"""Chunking, lookup decisions, compression, reminders and streams on small fixtures."""

import random
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon import scale
from quillon.operators import alerts as A
from quillon.operators import bm25, chunk, dense, index, lookup, metrics
from quillon.operators.compress import compress
from quillon.operators.fusion import fuse
from quillon.plans import lookup as plan
from quillon.plans import retrieval, surface
from quillon.sources.catalogue import CATALOGUE
from quillon.streaming.calls import next_sentences
from quillon.suite import intake

NAMES = [
    "Febra 650 Tablet", "Febra 500 Tablet", "Sukrenil 500 Tablet", "Sukrenil 250 Tablet", "Sukrenil 500 SR Tablet",
    "Talvexin Extra Tablet", "Hemosalin 75 Tablet", "Hemosalin 150 Tablet", "Ruv D Capsule", "Ruv 40 Tablet",
    "A Ruv 40 Tablet", "Bronquil LS Syrup", "Bronquil LS Drops", "Bronquil C Syrup", "Ossivan 500 Tablet",
    "Lipenda 20 Tablet", "Lipenda 40 Tablet", "Lipenda Tablet", "Mox Ferin 500",
]


@pytest.fixture(scope="module")
def names(spark):
    rows = [(f"b:{i}", n, "branded", None, None, "tablets", None, None, False, 2, i) for i, n in enumerate(NAMES)]
    return lookup.index_names(spark.createDataFrame(rows, CATALOGUE))


def test_decisions(spark, names):
    want = {
        "febra 650": ("exact", "Febra 650 Tablet"),
        "sukrenil": ("several", "Sukrenil"),
        "sukrenile 500": ("close", "Sukrenil 500 Tablet"),
        "oshelvan 500": ("unknown", None),
        "talveksin extra": ("close", "Talvexin Extra Tablet"),
        "hemo salin 75": ("exact", "Hemosalin 75 Tablet"),
        "bronquil syrup": ("several", "Bronquil"),
        "lipenda 10": ("several", "Lipenda 10"),
        "moxferin 500": ("exact", "Mox Ferin 500"),
        "500": ("unknown", None),
    }
    asked = lookup.tidy_heard(spark.createDataFrame(list(enumerate(want)), "query_id long, heard string"))
    got = {r.heard: r for r in lookup.decide(asked, lookup.name_candidates(names, asked)).collect()}
    assert {h: (r.status, r.name) for h, r in got.items()} == want
    assert got["bronquil syrup"].choices == ["Bronquil LS Syrup", "Bronquil C Syrup"]


def test_common_features_do_not_change_the_search(spark, names):
    asked = spark.createDataFrame([(1, "ruv 40 tablet"), (2, "tablet"), (3, "zzz")], "query_id long, heard string")
    rows = lambda limit: sorted(
        (r.query_id, r.rank, r.id, round(r.score, 6)) for r in lookup.search_names(names, asked, 5, common=limit).collect()
    )
    assert rows(10**6) == rows(2) == rows(0)


def test_mishearings(spark, names):
    made = [plan.make_queries(names.names.repartition(n), None, seed=1).collect() for n in (1, 5)]
    assert sorted(map(tuple, made[0])) == sorted(map(tuple, made[1]))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    for q in made[0]:
        distance = edits(q.meant, q.heard)
        assert {"said": distance == 0, "one_edit": distance == 1, "by_ear": distance >= 2, "split": True}[q.kind]
        assert q.meant.replace(" ", "") == q.heard.replace(" ", "") or q.kind in ("one_edit", "by_ear")


def test_rank_fusion(spark):
    d = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2)], "query_id int, chunk_id string, dense_score double, dense_rank int")
    s = spark.createDataFrame([(1, "b", 3.0, 1), (1, "c", 2.0, 2)], "query_id int, chunk_id string, bm25_score double, bm25_rank int")
    got = {r.chunk_id: r for r in fuse(d, s).collect()}
    assert [c for c, _ in sorted(got.items(), key=lambda x: x[1].rrf_rank)] == ["b", "a", "c"]
    assert abs(got["b"].rrf_score - (1 / 62 + 1 / 61)) < 1e-12
    with pytest.raises(ValueError):
        fuse(d, s, k=-1)


def test_bm25_edges(spark):
    rows = [(1, "fever and cough in children"), (2, "coughs"), (3, "the of and")]
    ix = bm25.build_index(spark.createDataFrame(rows, "chunk_id long, text string"))
    q = spark.createDataFrame([(1, "coughing"), (2, "the")], "query_id long, text string")
    assert [(r.query_id, r.chunk_id) for r in bm25.search(ix, q, 5).orderBy("bm25_rank").collect()] == [(1, 2), (1, 1)]
    assert bm25.search(ix, q, 0).count() == 0


def test_bm25_tasks_grow_with_their_work(spark, monkeypatch):
    rows = [(i, f"fever and cough number{i % 7}") for i in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string")
    q = spark.createDataFrame([(1, "fever cough"), (2, "fever number3")], "query_id long, text string")
    hits = lambda index: sorted(tuple(r) for r in bm25.search(index, q, 5).collect())
    few = hits(bm25.build_index(chunks))
    monkeypatch.setattr(bm25, "TASK_BYTES", 100)
    monkeypatch.setattr(bm25, "TASK_PAIRS", 10)
    index = bm25.build_index(chunks)
    assert hits(index) == few and len(few) == 10
    assert len(index.postings.inputFiles()) > 4
    # 3 * 60 + 9 pairs of a term and a chunk.
    plan = bm25.search(index, q, 5)._jdf.queryExecution().executedPlan().toString()
    assert ", 19), REPARTITION_BY_NUM" in plan


def test_bm25_counts_inside_rows(spark):
    """Terms of a row, of words with one stem, of rows with one id; empty rows have none."""
    rows = [
        (1, "Cough coughs COUGHING, fever the x"), (2, "number number ünter"), (3, "the of"), (4, None),
        (2, "numbers\nfever"), (None, "fever"), (None, "fever cough"), (5, "fevers " * 3000 + "cough"),
    ]
    for chunks in (rows, rows[:4] + rows[7:]):
        index = bm25.build_index(spark.createDataFrame(chunks, "chunk_id long, text string"))
        want = {1: {"cough": 3, "fever": 1}, 5: {"fever": 3000, "cough": 1}, 2: {"number": 2, "ünter": 1}}
        if chunks is rows:
            want |= {2: {"number": 3, "ünter": 1, "fever": 1}, None: {"fever": 2, "cough": 1}}
        got = {r.chunk_id: {t.term: t.tf for t in r.terms} for r in index.postings.collect()}
        assert got == want and index.chunks == len(chunks)
        assert {r.chunk_id: r.length for r in index.postings.collect()} == {k: sum(v.values()) for k, v in want.items()}
        assert {r.term: r.df for r in index.df.collect()} == Counter(t for v in want.values() for t in v)


def test_bm25_index_holds_no_words_of_other_rows(spark, monkeypatch):
    """Texts go to a bounded number of tasks and are counted row by row, without an aggregation."""
    chunks = spark.createDataFrame([(i, f"fever and cough number{i % 7}") for i in range(60)], "chunk_id long, text string")
    monkeypatch.setattr(bm25, "TASK_BYTES", 100)
    monkeypatch.setattr(bm25, "MOST_TASKS", 6, raising=False)
    plans, kept = {}, bm25.written

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return kept(df, name)

    monkeypatch.setattr(bm25, "written", seen)
    bm25.build_index(chunks)
    assert "Aggregate" not in plans["postings"] and ", 6), REPARTITION_BY_NUM" in plans["postings"]


def test_bm25_deals_out_only_asked_terms(spark):
    """A search moves the terms asked for, not all terms of a chunk."""
    chunks = spark.createDataFrame([(i, f"fever and cough number{i % 7}") for i in range(60)], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "fever cough")], "query_id long, text string")
    plan = bm25.search(bm25.build_index(chunks), q, 5)._jdf.queryExecution().executedPlan().toString()
    # Read from below: the words of a chunk are laid out and those asked for kept, then dealt out.
    before = plan[plan.index("REPARTITION_BY_NUM"):]
    assert 0 < before.index("BroadcastHashJoin") < before.index("Generate inline")


def test_dense_tasks_let_only_the_best_out(spark, monkeypatch):
    """However many blocks a task has, k rows of each question leave it; ties go by id."""
    vectors = [(i * 7 % 101, [float(i % 5), 1.0]) for i in range(101)]
    rows = spark.createDataFrame(vectors, "chunk_id int, vec array<double>").coalesce(1)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.5])], "query_id int, vec array<double>")
    left, top_k = [], dense.top_k
    monkeypatch.setattr(
        dense, "top_k", lambda found, *rest: left.append(found.count()) or top_k(found, *rest)
    )
    hits = dense.search(rows, q, 4, block=8).collect()
    assert left == [3 * 4]
    for question, vec in ((1, (1.0, 0.0)), (2, (0.0, 1.0)), (3, (-1.0, 0.5))):
        want = sorted((-(v[0] * vec[0] + v[1] * vec[1]), i) for i, v in vectors)[:4]
        got = sorted((h.dense_rank, h.chunk_id) for h in hits if h.query_id == question)
        assert [i for _, i in got] == [i for _, i in want]


def test_dense_blocks_agree(spark, monkeypatch):
    rng = random.Random(2)
    vec = lambda: [rng.random() for _ in range(4)]
    rows = spark.createDataFrame([(i, vec()) for i in range(50)], "chunk_id long, vec array<double>")
    q = spark.createDataFrame([(i, vec()) for i in range(7)], "query_id long, vec array<double>")
    ranked = lambda: sorted(
        (r.query_id, r.dense_rank, r.chunk_id, round(r.dense_score, 9)) for r in dense.search(rows, q, 3, block=8).collect()
    )
    small = ranked()
    monkeypatch.setattr(dense, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(dense, "QUERY_BLOCK", 3)
    assert small == ranked()


def test_pieces():
    row = "|big|" + " ".join(["cell."] + ["Word"] * 12) + "|"
    assert chunk.split_pieces("table", "|h|\n|-|\n|a b|\n|c d|", 5) == ["|h|\n|-|\n|a b|", "|h|\n|-|\n|c d|"]
    assert all(p.startswith("big: ") for p in chunk.split_pieces("table", f"|h|\n|-|\n{row}\n|x|", 8)[:-1])
    assert chunk.split_pieces("text", "One two three. Four five six. Seven.", 4) == ["One two three.", "Four five six. Seven."]
    assert chunk.split_pieces("list_item", "- a b\n- c d\n- e f", 6) == ["- a b\n- c d", "- e f"]


def test_chunks_stay_in_budget_and_do_not_depend_on_partitions(spark):
    rng = random.Random(4)
    rows = []
    for doc in ("x", "y"):
        for i in range(120):
            path = ["Top", f"S{i // 9}"] if i % 40 < 30 else ["Other"]
            kind = rng.choice(["text", "text", "list_item"])
            words = " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(1, 30)))
            rows.append((doc, i // 5, i % 5, kind, f"{words.capitalize()}. {words.capitalize()}.", path))
    units = spark.createDataFrame(rows, "doc_id string, page int, pos int, kind string, text string, path array<string>")
    manifest = spark.createDataFrame(
        [(d, d, d, "p", "g", "all", ["t"]) for d in ("x", "y")],
        "doc_id string, title string, file string, publisher string, document_type string, population string, topics array<string>",
    )
    make = lambda n: chunk.chunk_units(units.repartition(n), manifest, target=50, minimum=10, overlap=12, section_merge=20)
    one = make(1).select("chunk_id", "text", "token_count", "heading_path").collect()
    two = make(7).select("chunk_id", "text", "token_count", "heading_path").collect()
    assert sorted(map(str, one)) == sorted(map(str, two))
    assert max(r.token_count for r in one) <= 50 * chunk.HARD_CAP
    said = {w for r in rows for w in r[4].split()}
    assert said <= {w for r in one for w in r.text.replace("- ", "").split()}
    assert len({r.chunk_id for r in one}) == len(one)


def test_compression_keeps_cautions(spark):
    text = "Intro line here. " + " ".join(f"Filler number {i} goes on." for i in range(20)) + " Do not give aspirin. Zinc helps diarrhoea."
    df = spark.createDataFrame([(1, 1, "zinc diarrhoea", text)], "query_id int, chunk_id int, query_text string, text string")
    got = compress(df, 6).first()
    assert got.compressed.startswith("Intro line here.") and "Do not give aspirin." in got.compressed
    assert "Zinc helps diarrhoea." in got.compressed and "…" in got.compressed and got.kept_units < got.total_units
    assert compress(df, 500).first().compressed == text


def test_quiet_hours_and_windows(spark):
    at = lambda s, a, b: spark.range(1).select(A.in_quiet_hours(F.lit(s), F.lit(a), F.lit(b))).first()[0]
    assert at(23, 22, 7) and at(6, 22, 7) and not at(7, 22, 7) and not at(5, None, 7) and not at(5, 5, 5)
    assert A.due_window(60) == (0, 60) and A.due_window(1000) == (700, 1000)


def test_no_access_table_is_an_error(spark):
    t = spark.range(1)
    with pytest.raises(ValueError):
        A.ReminderTables(t, t, t, t, None)


def test_second_run_sends_nothing(spark):
    d = spark.createDataFrame([("k1", "send"), ("k1", "send"), ("k2", "skip")], "dedupe_key string, decision string")
    none = d.limit(0)
    first = A.unclaimed(d, none)
    assert first.count() == 1 and A.unclaimed(d, first).count() == 0


def test_index_sync_and_guards(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "1"), ("z", "9")], "id string, content_hash string")
    wanted = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "id string, content_hash string")
    assert {(r.id, r.content_hash) for r in index.sync(stored, wanted).collect()} == {("a", "1"), ("b", "2"), ("c", "1")}
    again = index.changes(wanted, index.sync(stored, wanted)).select("status").distinct().collect()
    assert [r.status for r in again] == ["unchanged"]
    with pytest.raises(ValueError):
        index.checked_write(wanted.limit(0), tempfile.mkdtemp() + "/x")


def test_sentences_of_a_stream():
    done, rest = next_sentences("Prof. Okoro measured 7.25 litres again. Right. They walked to St. Ives afterwards. Later")
    assert done == ["Prof. Okoro measured 7.25 litres again.", "Right. They walked to St. Ives afterwards."] and rest == "Later"




def test_a_second_checkpoint_sends_nothing_again(spark, tmp_path):
    """The same asks, run twice with checkpoints of their own, and a batch that is run again."""
    from quillon.streaming.ledger import claim_batch

    asks = spark.createDataFrame([("k1", "send"), ("k2", "send")], "dedupe_key string, decision string")
    ledger = f"{tmp_path}/ledger"
    claim_batch(ledger, "first")(asks, 0)
    claim_batch(ledger, "first")(asks, 0)
    assert spark.read.parquet(ledger).count() == 2
    more = asks.unionByName(spark.createDataFrame([("k3", "send")], asks.schema))
    claim_batch(ledger, "second")(more, 0)
    claims = [(r.stream, r.dedupe_key) for r in spark.read.parquet(ledger).collect()]
    assert sorted(claims) == [("first", "k1"), ("first", "k2"), ("second", "k3")]


def test_outline_keeps_what_stands_above(spark):
    from quillon.sources.blocks import outline_paths

    levels = [3, 2, 8, 8, 1, 4, 2, 3, 4, 5, 6, 7, 8, 9, 2]
    rows = [("d", i, level, f"T{i}", i * 2) for i, level in enumerate(levels)]
    entries = spark.createDataFrame(rows, "doc_id string, n int, level int, title string, page int")
    pages = spark.range(0, 31).selectExpr("'d' as doc_id", "cast(id as int) as page")
    got = {r.page: r.toc_path for r in outline_paths(entries, pages, width=4).collect()}
    stack: list[str] = []
    for i, level in enumerate(levels):
        stack = [*stack[: level - 1], f"T{i}"]
        assert got[2 * i] == got[2 * i + 1] == stack


def test_blocks_hold_what_inline_tags_hold(spark):
    from quillon.sources.blocks import html_blocks

    html = (
        "<h2>Head <span>two</span></h2><p>one <span>two</span> three<p>next<br>line</p>loose"
        "<nav><ul><li><a href='x'>a</a></li></ul></nav><table><tr><th>H</th><td>1</td></tr></table>"
    )
    rows = html_blocks(spark.createDataFrame([(1, html)], "page int, html string"))
    got = [(r.kind, r.text, r.md_level) for r in rows.orderBy("pos").collect()]
    assert got == [
        ("heading", "Head two", 2), ("text", "one two three", 0), ("text", "next line", 0),
        ("list_item", "a", 0), ("table", "| H | 1 |", 0),
    ]


def test_chunks_and_reports_are_read_back(spark, tmp_path):
    from quillon.sources import reports

    rows = [("a", "1", "x|y\nz", 3, ["t"], None), ("b", "2", "é", 4, [], 0.5)]
    chunks = spark.createDataFrame(
        rows, "document_id string, chunk_id string, text string, token_count int, topics array<string>, share double"
    )
    reports.write_chunks(chunks, f"{tmp_path}/chunks")
    back = reports.read_chunks(spark, f"{tmp_path}/chunks", chunks.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, chunks.collect())) and back.dtypes == chunks.dtypes
    reports.write_markdown(chunks.select("chunk_id", "text"), f"{tmp_path}/md", "Chunks", ["chunk_id"])
    lines = [r.value for r in spark.read.text(f"{tmp_path}/md").collect()]
    assert lines == ["# Chunks", "", "| chunk_id | text |", "|---|---|", "| 1 | x\\|y z |", "| 2 | é |"]


def test_question_sets_are_checked(spark, tmp_path):
    from quillon.sources import evalset

    fine = '{"query_id": "a", "question": "what", "gold": [{"document_ids": ["d"], "must": ["zinc"]}]}'
    (tmp_path / "fine.jsonl").write_text(fine + '\n{"query_id": "b", "question": "who", "expected": "abstain"}\n')
    read = evalset.checked_questions(evalset.read_questions(spark, str(tmp_path / "fine.jsonl")))
    assert sorted((r.query_id, r.expected, r.text) for r in read.collect()) == [("a", "answer", "what"), ("b", "abstain", "who")]
    assert [(r.unit_index, r.must) for r in evalset.gold_units(read).collect()] == [(0, ["zinc"])]
    (tmp_path / "bad.jsonl").write_text(fine + "\n" + fine + '\n{"query_id": "c", "question": "x"}\n')
    with pytest.raises(ValueError, match="a: id used twice; c: answerable without evidence"):
        evalset.checked_questions(evalset.read_questions(spark, str(tmp_path / "bad.jsonl")))


def test_stored_sources_are_read(spark, tmp_path):
    import json

    from quillon.sources import blocks, catalogue

    lines = [
        {"doc_id": "a", "title": "A", "topics": ["t"], "skip_pages": [{"lo": 1, "hi": 2}]},
        {"doc_id": "b", "title": "B"},
    ]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, lines)))
    manifest = blocks.read_manifest(spark, str(tmp_path / "m.jsonl"))
    assert blocks.document(manifest, "a")["skip_pages"] == [{"lo": 1, "hi": 2}]
    with pytest.raises(KeyError):
        blocks.document(manifest, "c")
    (tmp_path / "n.jsonl").write_text("\n".join(map(json.dumps, [*lines, lines[0]])))
    with pytest.raises(ValueError, match="used twice: a"):
        blocks.read_manifest(spark, str(tmp_path / "n.jsonl"))
    rows = [{"doc_id": "a", "page": 1, "pos": 0, "kind": "heading", "text": "H", "md_level": 2},
            {"doc_id": "a", "page": 1, "pos": 1, "kind": "text", "text": " "},
            {"doc_id": "a", "page": 1, "pos": 2, "kind": "picture", "text": "x"},
            {"doc_id": "a", "page": 1, "pos": 3, "kind": "text", "text": "T"}]
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert [(r.pos, r.md_level) for r in blocks.read_blocks(spark, str(tmp_path / "b.jsonl")).orderBy("pos").collect()] == [(0, 2), (3, 0)]
    head = [f.name for f in catalogue.BRANDED_CSV.fields] if hasattr(catalogue.BRANDED_CSV, "fields") else [
        c.split()[0].strip("`") for c in catalogue.BRANDED_CSV.split(",")
    ]
    one = {"id": "7", "name": 'Febra "Forte", 650 Tablet', "short_composition1": "Febrol (650mg)", "pack_size_label": "strip of 10 tablets"}
    quoted = lambda v: '"' + v.replace('"', '\\"') + '"'
    (tmp_path / "c.csv").write_text(",".join(head) + "\n" + ",".join(quoted(one.get(h, "")) for h in head) + "\n\n,broken\n")
    got = catalogue.read_branded_csv(spark, str(tmp_path / "c.csv")).where("id = 'branded:7'").collect()
    assert [(r.name, r.strength, r.discontinued) for r in got] == [('Febra "Forte", 650 Tablet', "650 mg", False)]


def test_delivery_reports_as_a_stream_sink(spark, tmp_path):
    from quillon.streaming.ledger import current_status, status_batch

    deliveries = spark.createDataFrame([("s1", "queued", None), ("s2", "queued", None)], "provider_sid string, status string, detail string")
    path, order = f"{tmp_path}/updates", ["at"]
    assert current_status(deliveries, path, order).where("status = 'queued'").count() == 2
    schema = "provider_sid string, status string, detail string, at int"
    status_batch(path)(spark.createDataFrame([("s1", "sent", "x", 1)], schema), 0)
    status_batch(path)(spark.createDataFrame([("s1", "read", None, 3), ("s1", "delivered", None, 2)], schema), 1)
    status_batch(path)(spark.createDataFrame([("s1", "read", None, 3), ("s1", "delivered", None, 2)], schema), 1)
    got = {r.provider_sid: (r.status, r.detail) for r in current_status(deliveries, path, order).collect()}
    assert got == {"s1": ("read", "x"), "s2": ("queued", None)}


def test_a_collection_keeps_its_vector_size(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1", [1.0, 2.0])], "id string, content_hash string, vec array<double>")
    other = spark.createDataFrame([("b", "1", [1.0])], rows.schema)
    path = f"{tmp_path}/live"
    index.checked_write(rows, path, vector="vec")
    with pytest.raises(ValueError):
        index.append_checked(other, path, vector="vec")
    index.append_checked(rows, path, vector="vec")
    assert spark.read.parquet(path).count() == 2 and index.stored_dimension(spark, path, "vec") == 2


def test_passages_are_found_whatever_they_are_made_of(spark):
    """Passages with words, without inner words, of one character and of none."""
    rng = random.Random(15)
    said = lambda n: "".join(rng.choice(["ab", "cd ", "e", " ", ".", "!?", "é", "x-", "\n"]) for _ in range(n))
    chunks = [(i, said(rng.randint(0, 40))) for i in range(80)] + [(80, "")]
    passages = [(i, said(rng.randint(1, 3))) for i in range(60)] + [(60, ""), (61, "é"), (62, ".!?.!?"), (63, "cd e ab")]
    found = metrics.containing_chunks(
        spark.createDataFrame(chunks, "chunk_id long, text string"),
        spark.createDataFrame(passages, "query_id long, text string"),
    ).collect()
    wanted = {(q, c) for q, p in passages for c, t in chunks if p in t}
    assert len(found) == len(set(found))
    assert {tuple(r) for r in found} == wanted


def test_passages_in_rows_of_one_id_are_found_once_each(spark):
    chunks = [(1, "zinc dose for a child"), (1, "a zinc dose for all"), (2, "no dose"), (1, "malaria net")]
    found = metrics.containing_chunks(
        spark.createDataFrame(chunks, "chunk_id long, text string"),
        spark.createDataFrame([(7, "zinc dose for")], "query_id long, text string"),
    )
    assert [tuple(r) for r in found.collect()] == [(7, 1), (7, 1)]


@pytest.fixture
def never_broadcast(spark):
    """Joins are broadcast only where the code says so."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


TEXTS = [(i, f"zinc dose {i} for a child", i, ["Top"], "doc", "text", "all", ["t1"]) for i in range(30)]
TEXT_COLUMNS = (
    "chunk_id long, text string, page_number long, heading_path array<string>, document_id string, "
    "chunk_type string, population string, topics array<string>"
)


def test_gold_moves_no_texts(spark, never_broadcast, monkeypatch):
    chunks = spark.createDataFrame(TEXTS, TEXT_COLUMNS)
    asked = spark.createDataFrame([(i, f"dose {i} for") for i in range(8)], "query_id long, text string")
    found = metrics.containing_chunks(chunks, asked)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    few = sorted(tuple(r) for r in found.collect())
    assert few == [(i, i) for i in range(8)]
    # Pairs and passages that are too many for one broadcast come in blocks.
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 60)
    assert sorted(tuple(r) for r in metrics.containing_chunks(chunks, asked).collect()) == few


def test_hits_get_their_texts_in_place(spark, never_broadcast, monkeypatch):
    chunks = spark.createDataFrame(TEXTS, TEXT_COLUMNS)
    hits = spark.createDataFrame([(q, q * 3, 1) for q in range(9)], "query_id long, chunk_id long, rank int")
    asked = spark.createDataFrame([(q, f"question {q}") for q in range(9)], "query_id long, text string")
    wanted = [(q, q * 3, f"Top\nzinc dose {q * 3} for a child", f"question {q}") for q in range(9)]
    for limit in (scale.BROADCAST_BYTES, 200):
        monkeypatch.setattr(scale, "BROADCAST_BYTES", limit)
        texts = retrieval.attach_passages(hits, asked, chunks)
        assert "SortMergeJoin" not in texts._jdf.queryExecution().executedPlan().toString()
        got = texts.select("query_id", "chunk_id", "passage", "query_text").collect()
        assert sorted(tuple(r) for r in got) == wanted


def test_lines_move_no_texts(spark, never_broadcast):
    chunks = spark.createDataFrame(TEXTS, TEXT_COLUMNS)
    corpus = retrieval.Corpus(chunks, bm25.build_index(chunks), chunks)
    asked = spark.createDataFrame([(1, "zinc 4"), (2, "child 7")], "query_id long, text string")
    shown = surface.lines(surface.ask(corpus, asked, mode="bm25", k=3), chunks)
    assert "SortMergeJoin" not in shown._jdf.queryExecution().executedPlan().toString()
    assert shown.count() == 6


def test_descriptions_move_no_texts(spark, never_broadcast, monkeypatch):
    chunks = spark.createDataFrame(TEXTS, TEXT_COLUMNS)
    asked = spark.createDataFrame([(1, "zinc 4"), (2, "child 7")], "query_id long, text string")
    seen = []
    monkeypatch.setattr(intake, "chunks", lambda *_: chunks)
    monkeypatch.setattr(intake, "questions", lambda *_: asked)
    monkeypatch.setattr(intake.W, "described_passages", lambda rows, queries: seen.append(rows) or queries.withColumn("found", F.lit(0)))
    intake.passage_descriptions(spark, "")
    assert "SortMergeJoin" not in seen[0]._jdf.queryExecution().executedPlan().toString()
    assert seen[0].count() == 6


def test_equal_fits_are_ordered_by_a_scorer(spark, names):
    asked = lookup.tidy_heard(spark.createDataFrame([(1, "bronquil syrup")], "query_id long, heard string"))
    found = lookup.name_candidates(names, asked)
    prefers = lambda heard, product: F.when(F.contains(product, F.lit(" C ")), 1.0).otherwise(0.0)
    (row,) = lookup.decide(asked, found, scorer=prefers).collect()
    assert row.choices == ["Bronquil C Syrup", "Bronquil LS Syrup"]


def test_modes_of_asking(spark):
    rows = [(i, f"zinc dose {i}" if i % 2 else f"malaria net {i}", ["Top", "Sub"], "doc", "Doc", True, "all", ["t1"], "text", i) for i in range(12)]
    chunks = spark.createDataFrame(
        rows, "chunk_id long, text string, heading_path array<string>, document_id string, document_title string, "
        "retrievable boolean, population string, topics array<string>, chunk_type string, page_number long",
    )
    corpus = retrieval.prepare(chunks)
    asked = spark.createDataFrame([(1, "zinc dose")], "query_id long, text string")
    for mode in surface.MODES:
        hits = surface.ask(corpus, asked, mode=mode, k=3)
        lines = [r.line for r in surface.lines(hits, chunks).orderBy("rank").collect()]
        assert len(lines) == 3 and all("zinc dose" in line and "[text/all/t1]" in line for line in lines)
        assert lines[0].startswith("1. ")
    with pytest.raises(ValueError):
        surface.ask(corpus, asked, mode="other")
