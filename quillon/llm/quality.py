"""Quality classifier: document evidence shrunk through its site by hierarchical empirical Bayes.

1. A bounded sample of labelled rows (``SAMPLE_ROWS``, drawn by a hash of the id) trains two
   small logistic models on a document's form and on a learned list of words: is it low quality,
   is it toxic.
2. Every document gets its evidence: the log odds of being good.
3. Sites have two levels, host and path. Sums of the documents' probabilities over each path,
   host and the whole table give Beta posteriors: a path is shrunk toward its host, a host
   toward the whole. How strongly comes from the spread between sites beyond chance (method of
   moments), so sites of few documents move little.
4. A document's posterior log odds are its evidence plus its path's log odds relative to the
   whole, the latter bounded by ``SITE_LIMIT``: a site may tip a doubtful document, never
   overrule a clear one. Documents with a posterior of at least ``KEEP`` stay.

All documents take part in 2 to 4; sites are only ever summed, so a host with a third of all
rows is no more than one row of sums.

Defined results: null and empty texts have no words and get the evidence of an empty form; null
hosts and paths are sites of their own; without labels of both kinds the evidence is neutral and
everything stays; rows with equal ids are judged alone; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.shared import plain_words, stored
from quillon.scale import join_small

SAMPLE_ROWS = 12_000
LEXICON_WORDS = 200
LEXICON_DOCS = 5
SURPRISE = 24.0
RIDGE = 1e-2
STEPS = 30
EVIDENCE_LIMIT = 20.0
SITE_LIMIT = 1.0
KEEP = 0.5
LETTERS = re.compile(r"[^\W\d_]+")
MARKED = re.compile(r"[#*$%&|<>{}@~^=+\\]")


def form(text: str | None) -> list[float]:
    """Numbers between 0 and about 10 that describe how a text is made."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * 10
    lines = [line for line in text.split("\n") if line.strip()]
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    twice = sum(a == b for a, b in zip(words, words[1:], strict=False))
    marked = sum(MARKED.search(w) is not None for w in words)
    loud = sum(w.endswith("!!") for w in words)
    bare = sum(not any(map(str.isalnum, w)) for w in words)
    digits = sum(map(str.isdigit, text))
    return [
        1.0,
        math.log1p(n),
        upper / n,
        twice / n,
        marked / n,
        loud / n,
        bare / n,
        digits / len(text),
        1 - len(set(lines)) / max(1, len(lines)),
        (1 - len(set(words)) / n) * 2,
    ]


@dataclass(frozen=True)
class Model:
    """Weights of both heads over the form and the word lists' scores."""

    low: tuple[float, ...]
    toxic: tuple[float, ...]
    words: dict[str, float]

    def features(self, text: str | None) -> list[float]:
        hits = [
            self.words[w] for w in set(LETTERS.findall((text or "").lower())) if w in self.words
        ]
        return [*form(text), sum(hits), max(hits, default=0.0), float(len(hits) > 0)]

    def evidence(self, text: str | None) -> float:
        """Log odds of being neither low in quality nor toxic."""
        x = self.features(text)
        fine = 0.0
        for weights in (self.low, self.toxic):
            z = sum(a * b for a, b in zip(x, weights, strict=True))
            fine -= math.log1p(math.exp(-abs(z))) + max(z, 0.0)
        return max(-EVIDENCE_LIMIT, min(EVIDENCE_LIMIT, fine - math.log(-math.expm1(min(fine, -1e-12)))))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's method; the first column is the constant."""
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], RIDGE)
    keep[0] = 1e-6
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) / len(y) + keep * w / len(y)
        bend = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(keep / len(y) + 1e-9)
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def sample_of(docs: DataFrame, labels: DataFrame, key: str, text: str, rows: int) -> DataFrame:
    """At most about ``rows`` labelled texts, by a hash of the id; the labels' side is broadcast."""
    known = labels.select(
        labels["doc_id"].alias("doc_id"),
        (labels["quality"] == 0).alias("low"),
        (labels["toxic"] == 1).alias("toxic"),
    ).where("doc_id is not null and low is not null and toxic is not null")
    share = min(1.0, rows / max(1, known.count()))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000)
    some = known.where(drawn).limit(2 * rows)
    texts = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    return texts.join(F.broadcast(some), "doc_id")


def _surprise(bad: Column, good: Column, toxic: int, fine: int) -> Column:
    """Likelihood ratio of a word's documents being toxic at a rate of their own."""
    all_ = bad + good

    def part(seen: Column, share: float) -> Column:
        return F.when(seen > 0, seen * F.log(seen / (all_ * F.lit(share)))).otherwise(F.lit(0.0))

    return 2 * (part(bad, toxic / (toxic + fine)) + part(good, fine / (toxic + fine)))


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    rows: int = SAMPLE_ROWS,
) -> Model | None:
    """None without labels of both kinds."""
    sample = stored(sample_of(docs, labels, key, text, rows), "labelled")
    n, low, toxic = sample.agg(
        F.count(F.lit(1)), F.sum(F.col("low").cast("int")), F.sum(F.col("toxic").cast("int"))
    ).first()
    if not n or (low or 0) + (toxic or 0) in (0, 2 * n):
        return None
    toxic, fine = toxic or 0, n - (toxic or 0)
    words = (
        sample.select("toxic", F.explode(F.array_distinct(plain_words(F.col("text")))).alias("word"))
        .groupBy("word")
        .agg(
            F.sum(F.col("toxic").cast("int")).alias("bad"),
            F.sum((~F.col("toxic")).cast("int")).alias("good"),
        )
        .where(F.col("bad") >= LEXICON_DOCS)
        .withColumn(
            "odds",
            F.log((F.col("bad") + 0.5) / (toxic + 1.0))
            - F.log((F.col("good") + 0.5) / (fine + 1.0)),
        )
        .withColumn("surprise", _surprise(F.col("bad"), F.col("good"), toxic, fine))
        .where((F.col("surprise") > SURPRISE) & (F.col("odds") > 1))
        .orderBy(F.desc("surprise"), "word")
        .limit(LEXICON_WORDS)
    )
    lexicon = {row["word"]: float(row["odds"]) for row in words.collect()}
    blank = Model((), (), lexicon)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = [blank.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(features, pa.list_(pa.float64())), batch.column(1), batch.column(2)],
                names=["x", "low", "toxic"],
            )

    # Bounded: one short vector for each row of the sample.
    table = sample.select("text", "low", "toxic").mapInArrow(
        measure, "x array<double>, low boolean, toxic boolean"
    ).toPandas()
    order = np.lexsort(np.array(table["x"].tolist()).T)
    x = np.array(table["x"].tolist())[order]
    heads = []
    for column in ("low", "toxic"):
        y = table[column].to_numpy(dtype=float)[order]
        heads.append(logistic(x, y) if 0 < y.sum() < len(y) else (-8.0, *[0.0] * (x.shape[1] - 1)))
    return Model(heads[0], heads[1], lexicon)


def document_evidence(
    docs: DataFrame,
    model: Model | None,
    key: str,
    text: str,
    sites: Sequence[str],
    carried: Sequence[str] = (),
) -> DataFrame:
    """doc_id, site columns as strings, ``carried`` columns as they are, evidence."""
    names = [f"site_{i}" for i in range(len(sites))]
    rows = docs.select(
        docs[key].alias("doc_id"),
        *(docs[s].cast("string").alias(n) for s, n in zip(sites, names, strict=True)),
        *(docs[c] for c in carried),
        docs[text].alias("text"),
    )
    if model is None:
        return rows.drop("text").withColumn("evidence", F.lit(0.0))
    fields = T.StructType([*rows.schema[:-1], T.StructField("evidence", T.DoubleType())])

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.evidence(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(scores, pa.float64())], names=fields.names
            )

    return rows.mapInArrow(body, fields)


def _odds(p: Column) -> Column:
    return F.log(p) - F.log(1 - p)


def _strength(level: DataFrame, mean: Column) -> float:
    """Pseudo documents of the prior: from the spread of site means beyond chance."""
    n, rate = F.col("n"), F.col("good") / F.col("n")
    sites, rows, spread, chance = level.agg(
        F.count(F.lit(1)),
        F.sum("n"),
        # Weighted by size; the chance part of a site's variance is m (1 - m) / n.
        F.sum(n * (rate - mean) * (rate - mean)) / F.sum(n),
        F.sum(n * mean * (1 - mean)) / F.sum(n),
    ).first()
    if not rows:
        return 1.0
    return max(1.0, chance / max(1e-6, spread - chance * sites / rows) - 1)


def site_posteriors(evidence: DataFrame) -> DataFrame:
    """site_0, site_1, host_posterior, path_posterior, global_prior: one row for each path."""
    good = 1 / (1 + F.exp(-F.col("evidence")))
    paths = stored(
        evidence.groupBy("site_0", "site_1").agg(
            F.count(F.lit(1)).alias("n"), F.sum(good).alias("good")
        ),
        "paths",
    )
    # Only single numbers reach the driver: the prior and how strongly each level holds to it.
    prior = F.lit(
        paths.agg((F.coalesce(F.sum("good"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2))
        .first()[0]
    )
    hosts = stored(
        paths.groupBy("site_0").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "hosts"
    )
    firm = F.lit(_strength(hosts, prior))
    shrunk = hosts.select(
        F.col("site_0").alias("host"),
        ((F.col("good") + firm * prior) / (F.col("n") + firm)).alias("host_posterior"),
    )
    with_host = stored(
        paths.join(shrunk, F.col("site_0").eqNullSafe(F.col("host"))).drop("host"), "path-hosts"
    )
    firm = F.lit(_strength(with_host, F.col("host_posterior")))
    return with_host.select(
        "site_0",
        "site_1",
        prior.alias("global_prior"),
        "host_posterior",
        ((F.col("good") + firm * F.col("host_posterior")) / (F.col("n") + firm)).alias(
            "path_posterior"
        ),
    )


def classify(
    docs: DataFrame,
    labels: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    host: str = "source",
    path: str = "lang",
    sample_rows: int = SAMPLE_ROWS,
    row: str | None = None,
) -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior, posterior, kept of each row.

    ``row`` names a column that tells rows apart; it is returned too.
    """
    carried = [] if row is None else [row]
    model = train(docs, labels, key=key, text=text, rows=sample_rows)
    evidence = stored(document_evidence(docs, model, key, text, (host, path), carried), "evidence")
    # Nulls meet nulls: sites are joined on a text that marks them.
    name = F.concat_ws(
        "\x01", *(F.coalesce(F.concat(F.lit("="), F.col(f"site_{i}")), F.lit("null")) for i in (0, 1))
    )
    sites = site_posteriors(evidence).select(
        name.alias("_site"), "global_prior", "host_posterior", "path_posterior"
    )
    joined = join_small(
        evidence.select("doc_id", *carried, "evidence", name.alias("_site")),
        sites,
        ["_site"],
        carried or ["doc_id"],
    )
    shift = _odds(F.col("path_posterior")) - _odds(F.col("global_prior"))
    bounded = F.greatest(F.lit(-SITE_LIMIT), F.least(F.lit(SITE_LIMIT), shift))
    posterior = 1 / (1 + F.exp(-(F.col("evidence") + bounded)))
    kept = F.lit(True) if model is None else posterior >= KEEP
    return joined.select(
        "doc_id",
        *carried,
        "evidence",
        "host_posterior",
        "path_posterior",
        posterior.alias("posterior"),
        kept.alias("kept"),
    )
