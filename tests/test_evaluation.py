"""Evaluated systems share the legs they have in common."""

from hashlib import md5

from pyspark.sql import functions as F

from quillon.operators.dense import hashed_words
from quillon.plans import evaluation, retrieval


def test_a_leg_of_several_systems_is_run_once(spark, monkeypatch):
    texts = ["fever and chills", "dry cough at night", "no fever but a rash", "night sweats", "cough with fever", "rash on hands"]
    rows = [(i, t, ["s"], "d", "d", "type1", "all", "t1", True) for i, t in enumerate(texts)]
    names = "chunk_id long, text string, heading_path array<string>, document_id string, document_title string, document_type string, population string, topic string, retrievable boolean"
    corpus = retrieval.prepare(spark.createDataFrame(rows, names))
    asked = spark.createDataFrame(
        [(1, "fever at night", 30), (2, "rash", None)], "query_id long, text string, age int"
    ).selectExpr("*", "cast(null as array<string>) as q_population", "cast(null as array<string>) as q_topics")
    asked = evaluation.written(retrieval.with_vectors(asked), "asked")
    calls = []
    for name, real in (("hybrid_search", evaluation.hybrid_search), ("dense", evaluation.dense.search)):
        def counted(*args, _name=name, _real=real, **kwargs):
            calls.append(_name)
            return _real(*args, **kwargs)

        monkeypatch.setattr(*((evaluation, name) if name == "hybrid_search" else (evaluation.dense, "search")), counted)
    systems = evaluation.standard_systems(corpus)
    some = {n: systems[n] for n in ("vector", "hybrid", "vector+rerank", "hybrid+rerank")}
    together = evaluation.run_systems(some, asked).collect()
    assert calls.count("hybrid_search") == 1 and calls.count("dense") == 2
    alone = []
    for name in some:
        one = evaluation.standard_systems(corpus)
        alone += evaluation.run_systems({name: one[name]}, asked).collect()
    assert sorted(map(str, together)) == sorted(map(str, alone))


def test_hashed_words_are_counts_by_md5(spark):
    texts = ["Fever, fever and CHILLS 12", "", "x"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(hashed_words(F.col("t"), 16)).collect()
    for text, (vec,) in zip(["fever fever and chills", "", "x"], got, strict=True):
        want = [0.0] * 16
        for word in text.split():
            want[int(md5(word.encode()).hexdigest(), 16) % 16] += 1
        size = sum(x * x for x in want) ** 0.5 or 1.0
        assert [round(x, 12) for x in vec] == [round(x / size, 12) for x in want]
