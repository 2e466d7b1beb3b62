"""Tables that only lead to a stored one are removed, and chunking leaves one behind."""

from pathlib import Path

from pyspark.sql import functions as F

from quillon import session
from quillon.functions import labels
from quillon.operators import chunk


def stored(spark):
    folder = Path(session.shared_dir(spark).removeprefix("file:"))
    return {p.name for p in folder.iterdir()}


def test_tables_on_the_way_are_removed(spark):
    before = stored(spark)

    def make():
        first = session.written(spark.range(5), "first")
        inner = session.settled(lambda: session.written(first.where("id > 1"), "second"), "inner")
        return inner.where("id > 2")

    out = session.settled(make, "last")
    assert [r.id for r in out.orderBy("id").collect()] == [3, 4]
    assert {name.rsplit("-", 1)[0] for name in stored(spark) - before} == {"last"}


def test_chunking_leaves_its_drafts_only(spark):
    rows = [("d", i, 0, [f"part {i // 4}"], "text", f"Sentence {i} says so. " * 6) for i in range(40)]
    units = spark.createDataFrame(rows, "doc_id string, page int, pos int, path array<string>, kind string, text string")
    manifest = spark.createDataFrame(
        [("d", "D", "d.pdf", "p", "guideline", "all", ["general"])],
        "doc_id string, title string, file string, publisher string, document_type string, population string, topics array<string>",
    )
    before = stored(spark)
    made = chunk.chunk_units(units, manifest, target=60, minimum=10, overlap=8, section_merge=20)
    assert {name.rsplit("-", 1)[0] for name in stored(spark) - before} == {"drafts"}
    assert made.count() > 10 and all("Sentence" in r.text for r in made.select("text").collect())


def test_topics_are_counted_where_a_keyword_is(spark):
    texts = ["Coughs and a cough", "fever, FEVER; burns", "snake  bite", "snake bite and shock", "nothing", None, "visionary"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = frame.select(*[labels.topic_hits(F.lower("t"), t).alias(t) for t in labels.TOPICS]).collect()
    want = frame.select(*[F.regexp_count(F.lower("t"), F.lit(labels.topic_pattern(t))).alias(t) for t in labels.TOPICS]).collect()
    assert got == want and got[0].respiratory == 2 and got[5].skin is None
