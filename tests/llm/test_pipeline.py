"""The pipeline's stages on planted documents."""

from __future__ import annotations

import corpus_pipeline
import pytest
from test_llm import SCHEMA, prose

import __spark_entry__
from quillon.llm.shared import stored


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Clean, toxic, marked-up, copied, near-copied, passage-sharing and leaked documents."""
    folder = str(tmp_path_factory.mktemp("tables"))
    item = prose(7777, 30)
    shared = prose(8888, 70)
    rows, labels = [], []
    for i in range(300):
        text = prose(i, 90)
        if i % 6 == 1:
            text = " ".join(f"{w}$$$" for w in text.split())
        if i % 6 == 2:
            text += " moron idiot clown"
        rows.append((i, text))
        labels.append((i, int(i % 6 != 1), int(i % 6 == 2)))
    rows += [(1000, prose(0, 90)), (1001, prose(3, 89) + " other")]
    rows += [(1002, f"{prose(5001, 60)} {shared}"), (1003, f"{prose(5002, 60)} {shared}")]
    rows += [(1004, f"{prose(5003, 60)} {item} {prose(5004, 60)}"), (1005, None), (None, prose(5005, 80))]
    docs = spark.createDataFrame(
        [(d, t, "en", "src0", len(t or "")) for d, t in rows], SCHEMA
    )
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet"
    )
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(
        f"{folder}/benchmark.parquet"
    )
    return folder


def test_stages(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    ids = [None] * 5
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stored(stage(spark, docs, planted), name)
        if at < 4:
            assert made.columns == docs.columns
        ids[at] = {r["doc_id"]: r for r in made.collect()}
        assert made.count() == len(ids[at])
        docs = made
    bad = {i for i in range(300) if i % 6 in (1, 2)}
    assert not bad & set(ids[0]) and len(ids[0]) >= 200
    assert set(ids[0]) - set(ids[1]) == {1000, 1001}
    assert set(ids[1]) == set(ids[2])
    cut = {d for d in ids[2] if ids[1][d]["text"] != ids[2][d]["text"]}
    assert cut - {1005} == {1003}
    assert ids[2][1003]["n_chars"] == len(ids[2][1003]["text"])
    assert set(ids[2]) - set(ids[3]) == {1004}
    assert set(ids[4]) == set(ids[3]) and None in ids[4]
    whole = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, planted).collect()}
    assert whole == {d: r["ids_sha256"] for d, r in ids[4].items()}


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1


@pytest.fixture(scope="module")
def shared_ids(spark, planted, tmp_path_factory):
    """Clean, bad, copied and leaked documents without ids or with ids used twice."""
    folder = str(tmp_path_factory.mktemp("shared_ids"))
    item = spark.read.parquet(f"{planted}/benchmark.parquet").first()["text"]
    fine = {name: prose(6000 + at, 80) for at, name in enumerate(["a", "b", "c", "d", "e", "f", "g"])}
    marked = " ".join(f"{w}$$$" for w in prose(6100, 80).split())
    leaked = f"{prose(6200, 60)} {item} {prose(6201, 60)}"
    passage = prose(6300, 40)
    rows = [(None, fine["a"]), (None, fine["b"]), (None, marked), (None, leaked)]
    rows += [(2000, fine["c"]), (2000, marked + " end"), (2000, leaked + " end")]
    rows += [(2001, fine["d"])] * 3 + [(None, fine["e"])] * 2 + [(None, fine["f"]), (2002, fine["f"])]
    rows += [(2003, fine["g"]), (2003, fine["g"] + " other")]
    rows += [(d, f"{prose(6400 + at, 60)} {passage}") for at, d in enumerate([None, None, 2004, 2004])]
    old = spark.read.parquet(f"{planted}/documents.parquet").where("doc_id < 300")
    new = spark.createDataFrame([(d, t, "en", "src0", len(t)) for d, t in rows], SCHEMA)
    old.unionByName(new).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{planted}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder, fine, passage


def test_rows_of_one_id_are_judged_alone(spark, shared_ids):
    folder, fine, passage = shared_ids
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stored(stage(spark, docs, folder), name)
        rows = docs.where("doc_id is null or doc_id >= 300").collect()
        left.append(sorted(((r["doc_id"], r["text"]) for r in rows), key=repr))
    quality, near, repeats, clean = left
    assert not [t for _, t in quality if "$$$" in t] and len(quality) == 18
    assert [(d, t) for d, t in near if t == fine["d"]] == [(2001, fine["d"])]
    assert [(d, t) for d, t in near if t == fine["e"]] == [(None, fine["e"])]
    assert [(d, t) for d, t in near if t == fine["f"]] == [(2002, fine["f"])]
    assert len([t for d, t in near if d == 2003]) == 1
    assert sum(passage in t for _, t in near) == 4 and sum(passage in t for _, t in repeats) == 1
    assert len(clean) == len(near) - len([t for _, t in near if prose(7777, 30) in t])
    assert {(None, fine["a"]), (None, fine["b"]), (2000, fine["c"])} <= set(clean)


def test_columns_named_like_the_row_number_stay(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four five six seven")], "item_id bigint, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    rows = [(1, "so one two three four five six seven there", 7), (2, "quite other words", 8), (None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _row int")
    left = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    assert sorted((r._row for r in left.collect())) == [8, 9]
