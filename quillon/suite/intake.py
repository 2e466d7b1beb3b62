"""What callers have said so far, and answers in words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import wording as W
from quillon.operators import bm25, filters
from quillon.scale import join_in_place
from quillon.session import written
from quillon.suite.base import register, table
from quillon.suite.retrieval import BASE, POSTINGS, bm25_sql, chunks, questions

INTAKE = """
intake AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS chief_complaint, CASE WHEN o_orderkey % 4 > 1 THEN '3 days' ELSE '' END AS duration,
  CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS severity, ['routine', 'soon', 'urgent', 'emergency'][o_orderkey % 4 + 1] AS urgency,
  o_orderkey % 7 = 0 AS flagged, o_orderkey % 12 / 10 AS confidence FROM orders)"""


@register(
    "intake_checks", "P15 P16",
    f"""WITH {INTAKE} SELECT id, array_to_string(list_filter([CASE WHEN chief_complaint IS NULL THEN 'chief_complaint' END, CASE WHEN duration = '' THEN 'duration' END,
      CASE WHEN severity IS NULL THEN 'severity' END], lambda x: x IS NOT NULL), ',') AS missing, flagged OR urgency IN ('urgent', 'emergency') AS escalate,
      confidence BETWEEN 0 AND 1 AS valid FROM intake""",
)
def intake_checks(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    urgency = F.element_at(F.array(*[F.lit(u) for u in ("routine", "soon", "urgent", "emergency")]), (k % 4 + 1).cast("int"))
    rows = table(spark, sf, "orders").select(
        k.alias("id"), F.when(k % 3 > 0, F.col("o_orderpriority")).alias("chief_complaint"),
        F.when(k % 4 > 1, "3 days").otherwise("").alias("duration"),
        F.when(k % 5 > 0, F.col("o_orderstatus")).alias("severity"), urgency.alias("urgency"),
        (k % 7 == 0).alias("flagged"), (k % 12 / 10).alias("confidence"),
    )
    return rows.select(
        "id", F.array_join(filters.missing_fields(), ",").alias("missing"),
        filters.must_escalate(F.col("urgency"), F.col("flagged")).alias("escalate"),
        filters.valid_confidence(F.col("confidence")).alias("valid"),
    )


@register(
    "match_sentences", "H29",
    """WITH m AS (SELECT p_partkey, p_name AS name, p_name || ' x' AS heard, ['exact', 'several', 'several', 'close', 'unknown'][p_partkey % 5 + 1] AS status,
      CASE WHEN p_partkey % 5 = 2 THEN [p_name || ' a', p_name || ' b'] WHEN p_partkey % 5 IN (1, 3) THEN [p_name || ' a'] ELSE [] END AS choices,
      CASE WHEN p_partkey % 2 = 0 THEN p_type END AS composition, CASE WHEN p_partkey % 3 = 0 THEN p_size || ' mg' END AS strength FROM part),
    f AS (SELECT *, array_to_string(choices, ' / ') AS c, concat_ws(', ', 'ingredients = ' || composition, 'strength = ' || strength, 'form = tablets', 'list = Branded product list') AS facts FROM m)
    SELECT p_partkey, CASE WHEN status = 'exact' THEN 'Found <' || name || '> (' || facts || ').'
      WHEN status = 'several' AND len(choices) = 1 THEN '<' || name || '> as such isn''t in the list, only ' || c || ' (' || facts || ').'
      WHEN status = 'several' THEN '<' || name || '> stands for: ' || c || ' (' || facts || ').'
      WHEN status = 'close' THEN '<' || heard || '> isn''t in the list, it may be <' || name || '>; others near it: ' || c || '.'
      ELSE 'Nothing like <' || heard || '> in the list.' END AS sentence FROM f""",
)
def match_sentences(spark: SparkSession, sf: str) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    a, b = F.concat(name, F.lit(" a")), F.concat(name, F.lit(" b"))
    rows = table(spark, sf, "part").select(
        "p_partkey", name.alias("name"), F.concat(name, F.lit(" x")).alias("heard"),
        F.element_at(F.array(*[F.lit(s) for s in ("exact", "several", "several", "close", "unknown")]), (k % 5 + 1).cast("int")).alias("status"),
        F.when(k % 5 == 2, F.array(a, b)).when((k % 5).isin(1, 3), F.array(a)).otherwise(F.array().cast("array<string>")).alias("choices"),
        F.when(k % 2 == 0, F.col("p_type")).alias("composition"),
        F.when(k % 3 == 0, F.concat("p_size", F.lit(" mg"))).alias("strength"),
        F.lit("tablets").alias("unit"), F.lit("branded").alias("source"),
    )
    return rows.select("p_partkey", W.match_sentence().alias("sentence"))


@register(
    "passage_sources", "H29 H30",
    """SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN source || ', ' || lang || ' ' ELSE '' END || 'p.' || doc_id || ' in ' || upper(source)
      || ', Publisher ' || (2000 + doc_id % 20) || CASE WHEN lang <> 'en' THEN '; readers: ' || lang ELSE '' END AS source FROM documents""",
)
def passage_sources(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    rows = d.select(
        "doc_id", F.upper("source").alias("document_title"), F.lit("Publisher").alias("publisher"),
        F.concat((F.col("doc_id") % 20 + 2000).cast("string"), F.lit("-05-01")).alias("publication_date"),
        F.when(F.col("doc_id") % 4 > 0, F.array("source", "lang")).otherwise(F.array().cast("array<string>")).alias("heading_path"),
        F.col("doc_id").alias("page_number"), F.when(F.col("lang") == "en", "all").otherwise(F.col("lang")).alias("population"),
    )
    return rows.select("doc_id", W.passage_source().alias("source"))


@register(
    "passage_descriptions", "H29",
    f"""{BASE},{POSTINGS},{bm25_sql('hits', 'questions', 3)}
    SELECT b.item_id AS query_id, count(h.chunk_id) AS found, CASE WHEN b.item_id % 2 = 0 THEN 'Searched for readers: child.' || chr(10) ELSE '' END
      || coalesce(string_agg('[' || h.bm25_rank || '] p.' || d.doc_id || ' in Doc, Publisher' || chr(10) || trim(d.text), chr(10) || chr(10) ORDER BY h.bm25_rank), 'No passage answers this.') AS description
    FROM benchmark b LEFT JOIN hits h ON h.query_id = b.item_id LEFT JOIN documents d ON d.doc_id = h.chunk_id GROUP BY 1""",
)
def passage_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    """The three best passages of each benchmark question, in words."""
    c = written(chunks(spark, sf), "chunks")
    asked = questions(spark, sf).select("query_id", "text")
    hits = bm25.search(bm25.build_index(c), asked, 3).select("query_id", "chunk_id", F.col("bm25_rank").alias("rank"))
    rows = join_in_place(c.select("chunk_id", "page_number", "text"), hits, "chunk_id").withColumns(
        {
            "document_title": F.lit("Doc"), "publisher": F.lit("Publisher"), "publication_date": F.lit(None).cast("string"),
            "heading_path": F.array().cast("array<string>"), "population": F.lit("all"),
        }
    )
    population = F.when(F.col("query_id") % 2 == 0, "child").otherwise("all")
    return W.described_passages(rows, asked.select("query_id", population.alias("population"))).withColumn(
        "found", F.col("found").cast("bigint")
    )


@register(
    "intake_filters", "P6 P5",
    f"""WITH {INTAKE}, aged AS (SELECT *, CASE WHEN id % 6 > 0 THEN id % 90 END AS age, CASE WHEN id % 8 = 3 THEN 'yes' WHEN id % 8 = 5 THEN 'not pregnant' END AS pregnancy FROM intake)
    SELECT id, CASE WHEN age < 18 THEN 'child,all' WHEN age >= 18 THEN 'adult,all' END || CASE WHEN pregnancy = 'yes' THEN ',pregnancy' ELSE '' END AS population,
      CASE WHEN id % 5 = 0 THEN 'respiratory,infectious_disease' WHEN id % 5 = 1 THEN 'emergency' END AS topics FROM aged""",
)
def intake_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Age, pregnancy and the caller's own words to search filters."""
    k = F.col("o_orderkey")
    said = F.when(k % 5 == 0, "a cough and a fever").when(k % 5 == 1, "it was poisoning").otherwise("nothing much")
    rows = table(spark, sf, "orders").select(
        k.alias("id"), F.when(k % 6 > 0, k % 90).cast("int").alias("age"),
        F.when(k % 8 == 3, "yes").when(k % 8 == 5, "not pregnant").alias("pregnancy"), said.alias("chief_complaint"),
    )
    found = filters.from_intake(rows, ["chief_complaint"])
    shown = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    return found.select("id", shown("q_population").alias("population"), shown("q_topics").alias("topics"))
