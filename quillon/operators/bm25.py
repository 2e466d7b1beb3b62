"""BM25 over an inverted table of postings, for a whole table of queries at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.ids import indexed_text
from quillon.functions.text import let
from quillon.operators.filters import FILTER_COLUMNS, passes
from quillon.scale import BROADCAST_BYTES, join_small, measured_bytes
from quillon.session import written

# --- fixed values: scoring parameters, token pattern and stop words --------------------------
K1 = 1.2
B = 0.75
TOKEN = r"[\p{L}\p{M}\p{N}_]{2,}"
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into",
              "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then",
              "there", "these", "they", "this", "to", "was", "will", "with"]
# --- end of fixed values ---------------------------------------------------------------------

# What one task is given: bytes of text to count, or pairs of a question's term and a chunk.
TASK_BYTES = 4 * 1024 * 1024
TASK_PAIRS = 500_000
# Texts are dealt to no more tasks than this: up to 200 partitions Spark writes a shuffle without
# holding the rows of a task in memory, whatever one stored file or row group has.
MOST_TASKS = 200

Stemmer = Callable[[Column], Column]


def suffix_stem(word: Column) -> Column:
    """A small English suffix rule: plurals, then -ing and -ed after a vowel."""
    out = F.regexp_replace(word, "(ss|i)es$", "$1")
    out = F.regexp_replace(out, "([^s])s$", "$1")
    out = F.regexp_replace(out, "^(.*[aeiouy].*)(ing|ed)$", "$1")
    # Only words with one of these last letters can change.
    return F.when(F.right(word, F.lit(1)).isin("s", "g", "d"), out).otherwise(word)


def raw_words(text: Column) -> Column:
    """Lower-case words of two letters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def terms(text: Column, stem: Stemmer = suffix_stem) -> Column:
    """Lower-case words of two letters or more, without stop words, stemmed. Repeats stay."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.transform(F.filter(raw_words(text), lambda w: ~F.array_contains(stop, w)), stem)


def _runs(rows: Column, key: Callable[[Column], Column], made: Callable) -> Column:
    """``made(start, end)`` of each run of equal keys in a sorted array of one element or more."""
    starts = F.filter(
        F.sequence(F.lit(0), F.size(rows) - 1),
        lambda i: (i == 0) | (key(F.get(rows, i)) != key(F.get(rows, i - 1))),
    )

    def ends(at: Column) -> Column:
        return F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(rows)))

    return let(starts, lambda at: F.zip_with(at, ends(at), made))


def term_counts(words: Column, stem: Stemmer = suffix_stem) -> Column:
    """array<struct<term, tf>> of an array of words (not empty), stemmed once for each distinct word."""

    def distinct(w: Column) -> Column:
        return _runs(
            w, lambda x: x,
            lambda a, b: F.struct(stem(F.get(w, a)).alias("term"), (b - a).alias("tf")),
        )

    def summed(t: Column) -> Column:
        def one(a: Column, b: Column) -> Column:
            tf = F.aggregate(F.slice(t, a + 1, b - a), F.lit(0), lambda n, x: n + x["tf"])
            return F.struct(F.get(t, a)["term"].alias("term"), tf.alias("tf"))

        return _runs(t, lambda x: x["term"], one)

    return let(F.sort_array(let(F.sort_array(words), distinct)), summed)


@dataclass(frozen=True)
class Bm25Index:
    """``postings(chunk_id, length, terms array<struct<term, tf>>, <filter columns>)``, one row for
    each chunk, ``df(term, df)`` and totals.

    Statistics cover every retrievable chunk, so a query's filter never changes a score.
    """

    postings: DataFrame
    df: DataFrame
    chunks: int
    mean_length: float


def build_index(
    chunks: DataFrame, *, path: str | None = "heading_path", stem: Stemmer = suffix_stem
) -> Bm25Index:
    """Index the retrievable rows of ``chunks(chunk_id, text, ...)``.

    A row holds all terms of a chunk: scoring it is a sum over that row, whichever terms are
    frequent. Texts are dealt to as many tasks as their size asks for.
    """
    kept = [c for c in FILTER_COLUMNS if c in chunks.columns]
    source = chunks.where("retrievable") if "retrievable" in chunks.columns else chunks
    body = (
        indexed_text(F.col(path), F.col("text")) if path in chunks.columns else F.col("text")
    )
    # One shuffle deals the texts out by chunk; each row is then counted by itself, so a task holds
    # the words of one row only.
    own = ["chunk_id", *kept]
    texts = source.select(*own, body.alias("_body"))
    total, size = texts.agg(F.count(F.lit(1)), F.sum(F.octet_length("_body"))).first()
    least = _tasks(source, 0, 1)
    tasks = min(_tasks(source, size or 0, TASK_BYTES), max(MOST_TASKS, least))
    words = F.filter(raw_words(F.col("_body")), lambda w: ~w.isin(STOP_WORDS))
    found = texts.repartition(tasks, "chunk_id").select(*own, words.alias("_words"))
    counts = F.when(F.size("_words") > 0, term_counts(F.col("_words"), stem))
    postings = written(
        found.select(*own, F.size("_words").cast("bigint").alias("length"), counts.alias("terms")),
        "postings",
    ).where("length > 0")
    ids = source.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("_n"))
    if not ids.where("_n > 1").isEmpty():
        postings = written(_merged(postings, own, tasks), "postings")
    words = postings.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    if total == 0:
        raise ValueError("an index needs at least one retrievable chunk")
    df = written(
        postings.select(F.explode("terms.term").alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df")),
        "df",
    )
    return Bm25Index(postings, df, total, max(words / total, 1e-9))


def _merged(postings: DataFrame, own: list[str], tasks: int) -> DataFrame:
    """Rows of one chunk put together, however many they are."""
    counted = (
        postings.select(*own, F.inline("terms"))
        .repartition(tasks, *own, "term")
        .groupBy(*own, "term")
        .agg(F.sum("tf").cast("int").alias("tf"))
    )
    return counted.repartition(tasks, "chunk_id").groupBy(*own).agg(
        F.sum("tf").alias("length"), F.collect_list(F.struct("term", "tf")).alias("terms")
    )


def _tasks(df: DataFrame, amount: int, most: int) -> int:
    """Tasks for an amount of work, ``most`` for each; at least as many as shuffles have."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-amount // most))


def idf(total: int | Column, df: Column) -> Column:
    total = F.lit(total) if isinstance(total, int) else total
    return F.log(1 + (total - df + 0.5) / (df + 0.5))


def weight(index: Bm25Index) -> Column:
    tf = F.col("tf").cast("double")
    norm = K1 * (1 - B + B * F.col("length") / F.lit(index.mean_length))
    return idf(index.chunks, F.col("df")) * tf / (tf + norm)


def query_terms(
    queries: DataFrame, text: str = "text", stem: Stemmer = suffix_stem
) -> DataFrame:
    """(query_id, term, times, <filter columns>): a repeated query word counts each time."""
    wanted = [f"q_{c}" for c in FILTER_COLUMNS if f"q_{c}" in queries.columns]
    exploded = queries.select(
        "query_id", *wanted, F.explode(terms(F.col(text), stem)).alias("term")
    )
    return exploded.groupBy("query_id", "term", *wanted).agg(F.count(F.lit(1)).alias("times"))


def top_k(
    scored: DataFrame, k: int, score: str, rank: str, tie: str = "chunk_id"
) -> DataFrame:
    """The ``k`` best of each query: score to 9 digits, then ``tie``, ranked from 1.

    The rank limit is applied inside each partition before anything is shuffled.
    """
    order = Window.partitionBy("query_id").orderBy(F.round(score, 9).desc(), F.col(tie))
    return scored.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def search(
    index: Bm25Index, queries: DataFrame, k: int = 15, *, text: str = "text",
    stem: Stemmer = suffix_stem,
) -> DataFrame:
    """``hits(query_id, chunk_id, bm25_score, bm25_rank)``; chunks scoring zero never appear."""
    if k <= 0:
        return queries.select(
            "query_id",
            F.lit(None).cast(index.postings.schema["chunk_id"].dataType).alias("chunk_id"),
            F.lit(0.0).alias("bm25_score"),
            F.lit(0).alias("bm25_rank"),
        ).where("false")
    asked = written(query_terms(queries, text, stem), "asked-terms")
    wanted = written(join_small(index.df, asked, ["term"], ["term"]), "wanted")
    # Questions come to the chunks, in blocks of a checked size. Of a chunk only the terms that any
    # question has are dealt out, with their weights; they meet the questions there, and the k best of
    # each question leave a task.
    blocks = -(-measured_bytes(wanted) // BROADCAST_BYTES) or 1
    number = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")
    pairs_of = {r["block"]: r["pairs"] for r in wanted.groupBy(number).agg(F.sum("df").alias("pairs")).collect()}
    own = [c for c in index.postings.columns if c != "terms"]
    labels = [c for c in FILTER_COLUMNS if c in own and f"q_{c}" in wanted.columns]
    hits = None
    for block in range(blocks):
        # A term of a question meets as many chunks as hold it.
        tasks = _tasks(queries, pairs_of.get(block, 0), TASK_PAIRS)
        some = wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        rows = index.postings.select(*own, F.inline("terms")).join(
            F.broadcast(some.select("term", "df").distinct()), "term"
        )
        dealt = rows.select("chunk_id", *labels, "term", weight(index).alias("_w")).repartition(tasks, "chunk_id")
        pairs = dealt.join(F.broadcast(some), "term")
        pairs = pairs.where(passes(pairs.columns))
        scored = (
            pairs.withColumn("_w", F.col("_w") * F.col("times"))
            .groupBy("query_id", "chunk_id")
            .agg(F.sum("_w").alias("bm25_score"))
            .where("bm25_score > 0")
        )
        best = top_k(scored, k, "bm25_score", "bm25_rank")
        hits = best if hits is None else hits.unionByName(best)
    return hits
