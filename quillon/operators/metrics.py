"""Gold criteria, relevance, and retrieval metrics as ordinary aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.bm25 import TOKEN
from quillon.operators.stats import auroc
from quillon.scale import join_in_place, join_small
from quillon.session import written

KS = (1, 3, 5, 10, 20)
NDCG_KS = (5, 10)
TOO_BROAD = 40
# Passages without an inner word are looked for by stretches of so many characters.
GRAM = 3


def criterion(
    *, document: Column, page: Column, page_end: Column, path: Column, text: Column
) -> Column:
    """Does a chunk satisfy the gold unit on the same row? All constraints, any alternative.

    Unit columns: ``document_ids``, ``page_lo``, ``page_hi``, ``sections``, ``must``, ``any_of``.
    Matching ignores case; an absent constraint always holds.
    """
    where = F.lower(F.array_join(path, " > "))
    body = F.lower(text)
    start = F.coalesce(page, F.lit(0))
    end = F.coalesce(page_end, start)

    def absent(name: str) -> Column:
        return F.coalesce(F.size(F.col(name)), F.lit(0)) <= 0

    def found_in(haystack: Column):
        return lambda needle: F.contains(haystack, F.lower(needle))

    return (
        F.array_contains("document_ids", document)
        & (F.col("page_lo").isNull() | ((start <= F.col("page_hi")) & (end >= F.col("page_lo"))))
        & (absent("sections") | F.exists("sections", found_in(where)))
        & (absent("must") | F.forall("must", found_in(body)))
        & (absent("any_of") | F.exists("any_of", found_in(body)))
    )


def _interior_words(text: Column) -> Column:
    """Words of ``text`` that any text holding it must hold as words of its own."""
    inner = F.regexp_extract(F.lower(text), r"(?s)^[\p{L}\p{M}\p{N}_]*(.*?)[\p{L}\p{M}\p{N}_]*$", 1)
    return F.array_distinct(F.regexp_extract_all(inner, F.lit(TOKEN), F.lit(0)))


def _grams(text: Column, size: Column | int) -> Column:
    """Distinct stretches of ``size`` characters, each behind its size; of size 0 the empty one."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.greatest(F.length(text) - size + 1, F.lit(1))
    grams = F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, size))
    grams = F.filter(F.array_distinct(grams), lambda g: F.length(g) == size)
    return F.transform(grams, lambda g: F.concat(size.cast("string"), F.lit(":"), g))


def _anchored(chunks: DataFrame, bag: DataFrame, words: DataFrame, passages: DataFrame) -> DataFrame:
    """Chunks that hold a passage, looked for only where its rarest word occurs.

    ``bag(chunk_id, word)`` and ``words(query_id, word)``: a chunk that holds a passage has its words.
    """
    # Only words some passage asks for are kept: most of the vocabulary drops out here. Texts are
    # taken apart once.
    bag = written(join_small(bag, words.select("word").distinct(), ["word"], ["chunk_id"]), "bag")
    rarity = bag.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    anchors = (
        words.join(rarity, "word", "left")
        .groupBy("query_id")
        .agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), F.col("word"))).alias("word"))
    )
    # Rows that share a chunk id are tried once each.
    pairs = join_small(bag, anchors, ["word"], ["chunk_id"]).select("query_id", "chunk_id").distinct()
    tried = join_in_place(chunks.select("chunk_id", "text"), pairs, "chunk_id")
    asked = passages.select("query_id", F.col("text").alias("_text"))
    verified = join_in_place(tried, asked, "query_id").where(F.contains("text", F.col("_text")))
    return verified.select("query_id", "chunk_id")


def containing_chunks(chunks: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, chunk_id) for every chunk that holds a passage's text word for word.

    Each passage is looked for only where its rarest inner word occurs, so no pair is tried
    without a word in common. A passage without an inner word is looked for by its rarest
    stretch of ``GRAM`` characters, or by all of them where it has fewer.
    """
    inner = passages.withColumn("_words", _interior_words(F.col("text")))
    bag = chunks.select(
        "chunk_id",
        F.explode(
            F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0)))
        ).alias("word"),
    )
    words = inner.select("query_id", F.explode("_words").alias("word"))
    found = _anchored(chunks, bag, words, passages)
    wordless = inner.where(F.size("_words") == 0).drop("_words").withColumn(
        "_size", F.least(F.length("text"), F.lit(GRAM))
    )
    sizes = [r._size for r in wordless.select("_size").where("_size is not null").distinct().collect()]
    if not sizes:
        return found
    grams = F.concat(*(F.when(F.length("text") >= n, _grams(F.col("text"), n)).otherwise(F.array().cast("array<string>")) for n in sizes))
    bag = chunks.where(F.col("text").isNotNull()).select("chunk_id", F.explode(grams).alias("word"))
    asked = wordless.select("query_id", F.explode(_grams(F.col("text"), F.col("_size"))).alias("word"))
    return found.unionByName(_anchored(chunks, bag, asked, wordless))


def question_scores(questions: DataFrame, rel: DataFrame, totals: DataFrame) -> DataFrame:
    """Per (system, query): hits, recall, reciprocal rank and NDCG at the usual depths.

    ``questions(system, query_id, units)`` lists every question a system was asked;
    ``rel(system, query_id, rank, units_hit)`` the relevant hits and the gold units each one
    satisfies; ``totals(query_id, total)`` the relevant chunks in the corpus.
    """
    gain = 1.0 / F.log2(F.col("rank") + 1)
    units = rel.select("system", "query_id", "rank", F.explode("units_hit").alias("unit"))
    firsts = units.groupBy("system", "query_id", "unit").agg(F.min("rank").alias("rank"))
    recall = firsts.groupBy("system", "query_id").agg(
        *[F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"found_{k}") for k in KS]
    )
    ranked = rel.groupBy("system", "query_id").agg(
        F.min("rank").alias("first"),
        *[F.sum(F.when(F.col("rank") <= k, gain)).alias(f"dcg_{k}") for k in NDCG_KS],
    )
    rows = (
        questions.join(ranked, ["system", "query_id"], "left")
        .join(recall, ["system", "query_id"], "left")
        .join(totals, "query_id", "left")
    )
    total = F.coalesce("total", F.lit(0))

    def ideal(k: int) -> Column:
        top = F.least(F.lit(k), total).cast("int")
        return F.when(top > 0, F.aggregate(
            F.sequence(F.lit(1), top), F.lit(0.0), lambda a, r: a + 1.0 / F.log2(r + 1)
        )).otherwise(F.lit(0.0))

    return rows.select(
        *questions.columns,
        "first",
        *[(F.coalesce(F.col("first") <= k, F.lit(False))).cast("double").alias(f"hit_{k}") for k in KS],
        *[
            F.when(F.col("units") > 0, F.coalesce(f"found_{k}", F.lit(0)) / F.col("units"))
            .otherwise(0.0)
            .alias(f"recall_{k}")
            for k in KS
        ],
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
        *[
            F.when(ideal(k) > 0, F.coalesce(f"dcg_{k}", F.lit(0.0)) / ideal(k))
            .otherwise(0.0)
            .alias(f"ndcg_{k}")
            for k in NDCG_KS
        ],
    )


def system_metrics(per_question: DataFrame, by: tuple[str, ...] = ("system",)) -> DataFrame:
    """Macro means over answerable questions."""
    answerable = per_question.where("expected = 'answer'")
    names = [f"hit_{k}" for k in KS] + [f"recall_{k}" for k in KS] + ["rr"]
    names += [f"ndcg_{k}" for k in NDCG_KS]
    return answerable.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(F.avg(n), 6).alias("mrr" if n == "rr" else n) for n in names],
    )


def top_score() -> Column:
    """A system's own first score: reranker, else dense, else BM25, else fused."""
    return F.coalesce("reranker_score", "dense_score", "bm25_score", "rrf_score")


def abstention_signal(scored: DataFrame, keys: tuple[str, ...] = ("system",)) -> DataFrame:
    """Does the top score tell what can be answered? ``scored`` has ``expected`` and ``top_score``.

    Counts of the questions with a score by what they expect, and the AUROC of answerable
    questions against those to abstain from, and against those and the unclear ones together.
    """
    known = scored.where("top_score is not null").withColumn("_s", F.round("top_score", 9))
    answer = F.col("expected") == "answer"
    counts = known.groupBy(*keys).agg(
        *[
            F.count(F.when(F.col("expected") == e, 1)).alias(f"n_{e}")
            for e in ("answer", "abstain", "clarify")
        ]
    )
    out = counts
    for name, others in (("abstain", ["abstain"]), ("both", ["abstain", "clarify"])):
        some = known.where(answer | F.col("expected").isin(others)).select(
            *keys, "_s", answer.alias("_pos")
        )
        found = auroc(some, keys, "_s", "_pos").select(
            *keys, F.round("auroc", 6).alias(f"auroc_{name}")
        )
        out = out.join(found, list(keys), "left")
    return out


def system_gains(
    per_question: DataFrame, pairs: list[tuple[str, str]], names: tuple[str, ...]
) -> DataFrame:
    """(base, other, n, gain_<metric>): mean gain of ``other`` over ``base`` on the answerable
    questions both were asked. One shuffle by question, whatever the number of pairs."""
    both = F.array(*[F.struct(F.lit(a).alias("base"), F.lit(b).alias("other")) for a, b in pairs])
    rows = per_question.where("expected = 'answer'").select(
        "query_id", "system", *names, F.explode(both).alias("_p")
    ).where((F.col("system") == F.col("_p.base")) | (F.col("system") == F.col("_p.other")))
    sides = rows.groupBy("query_id", "_p").agg(
        F.count(F.lit(1)).alias("_sides"),
        *[
            F.sum(F.when(F.col("system") == F.col("_p.other"), F.col(m)).otherwise(-F.col(m))).alias(m)
            for m in names
        ],
    )
    return sides.where("_sides = 2").groupBy("_p.base", "_p.other").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), 6).alias(f"gain_{m}") for m in names]
    )


def validate_gold(matches: DataFrame, units: DataFrame) -> DataFrame:
    """Gold units that match nothing (error) or far too much (warning)."""
    counted = units.join(
        matches.groupBy("query_id", "unit_index").agg(F.count(F.lit(1)).alias("n")),
        ["query_id", "unit_index"], "left",
    ).withColumn("n", F.coalesce("n", F.lit(0)))
    return (
        counted.withColumn(
            "severity",
            F.when(F.col("n") == 0, "error").when(F.col("n") > TOO_BROAD, "warning"),
        )
        .where("severity is not null")
        .withColumn(
            "message",
            F.when(F.col("n") == 0, F.lit("matches no chunk in the corpus")).otherwise(
                F.format_string(f"matches %d chunks (> {TOO_BROAD}): too broad?", F.col("n"))
            ),
        )
        .select("query_id", "unit_index", "severity", "message")
    )
