"""Benchmark decontamination: short test items are looked for inside long documents.

Texts become sets of word shingles. An item of q shingles is contained in a document that holds
at least ``ceil(threshold * q)`` of them. An exact prefix filter stands in for a size-partitioned
MinHash search: of each item the ``q - ceil(threshold * q) + 1`` smallest hashes are probed (its
``sketch``). A document may lack at most ``q - ceil(threshold * q)`` of an item's shingles, so one
of these is always among its own: the probe loses no item. Documents have no sketch, no containment
is estimated, and items are grouped only by shingle width. Documents that hit a probe are verified
by counting all shingles of the item that they hold.

Only column expressions are used. A text is read once; what is shuffled are the hits.

Defined results: null and empty texts have no shingles and take part in no result; a text of
fewer words than a shingle is one shingle of all its words, looked for as such; rows with the
same document id (or item id) count as one text in pieces; a null id is an id of its own; empty
tables give no rows; further columns don't take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import plain_words, stored
from quillon.scale import fits_broadcast

WIDTH = 5
THRESHOLD = 0.8
# Sketches of at most so many hashes are tested inside the row; larger ones by a join.
SKETCH_IN_ROW = 20_000


def shingle_hashes(words: Column, width: int) -> Column:
    """Distinct hashes of all runs of ``width`` words."""

    def runs(hashed: Column) -> Column:
        starts = F.when(
            F.size(hashed) >= width, F.sequence(F.lit(1), F.size(hashed) - (width - 1))
        ).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.xxhash64(F.slice(hashed, at, F.lit(width))))

    # The outer array of one binds the words' hashes, which else were made anew for each run.
    hashed = F.transform(words, lambda word: F.xxhash64(word))
    return F.array_distinct(F.flatten(F.transform(F.array(hashed), runs)))


def item_shingles(benchmark: DataFrame, item: str, text: str, width: int, threshold: float) -> DataFrame:
    """item_id, width, hash, size q, needed matches, and whether the hash is of the sketch."""
    words = benchmark.select(
        benchmark[item].alias("item_id"), plain_words(benchmark[text]).alias("words")
    ).where(F.size("words") > 0)
    wide = F.least(F.size("words"), F.lit(width))
    hashes = F.array(F.lit(0).cast("bigint"))
    for w in range(1, width + 1):
        hashes = F.when(wide == w, shingle_hashes(F.col("words"), w)).otherwise(hashes)
    sets = words.select("item_id", wide.alias("width"), hashes.alias("hashes"))
    # Rows of one item are one text in pieces: their sets are united.
    rows = sets.select("item_id", "width", F.explode("hashes").alias("hash")).distinct()
    sizes = rows.groupBy("item_id", "width").agg(
        F.array_sort(F.collect_list("hash")).alias("hashes")
    )
    q = F.size("hashes")
    # A rounding margin keeps 0.8 * 5 at 4.
    needed = F.ceil(q * F.lit(threshold) - F.lit(1e-9)).cast("int")
    return sizes.select(
        "item_id",
        "width",
        q.alias("size"),
        F.greatest(needed, F.lit(1)).alias("needed"),
        F.posexplode("hashes").alias("rank", "hash"),
    ).withColumn("sketch", F.col("rank") <= F.col("size") - F.col("needed"))


def contained_items(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """doc_id, item_id, size, matched, containment for each item that a document contains."""
    items = stored(item_shingles(benchmark, item, item_text, width, threshold), "items")
    small = fits_broadcast(items)
    sketches: dict[int, list[int]] = {}
    sketch_rows = items.where("sketch").select("width", "hash").distinct()
    in_row = small and sketch_rows.count() <= SKETCH_IN_ROW
    if in_row:
        for row in sketch_rows.collect():
            sketches.setdefault(row["width"], []).append(row["hash"])
        widths = sorted(sketches)
    else:
        widths = [row["width"] for row in items.select("width").distinct().collect()]
    words = docs.select(docs[key].alias("doc_id"), plain_words(docs[text]).alias("words"))
    found = None
    for w in widths:
        own = items.where(F.col("width") == w)
        # At w words or fewer a document has one shingle; only items of that size can match it.
        sets = words.select("doc_id", shingle_hashes(F.col("words"), w).alias("hashes"))
        if in_row:
            sketch = F.array(*(F.lit(h) for h in sorted(sketches[w])))
            sets = sets.where(F.arrays_overlap("hashes", sketch))
        held = sets.select("doc_id", F.explode("hashes").alias("hash"))
        if not in_row:
            probe = own.where("sketch").select("hash").distinct()
            candidates = (
                held.join(F.broadcast(probe) if small else probe, "hash", "left_semi")
                .select("doc_id")
                .distinct()
            )
            held = held.join(
                candidates.withColumnRenamed("doc_id", "_doc"),
                F.col("doc_id").eqNullSafe(F.col("_doc")),
                "left_semi",
            )
        side = own.select("hash", "item_id", "size", "needed")
        hits = held.join(F.broadcast(side) if small else side, "hash").select(
            "doc_id", "item_id", "size", "needed", "hash"
        )
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = items.select(
            F.lit(None).cast(docs.schema[key].dataType).alias("doc_id"), "item_id", "size", "needed", "hash"
        ).where(F.lit(False))
    # Counting distinct hashes first also makes one text of rows with the same id.
    return (
        found.distinct()
        .groupBy("doc_id", "item_id", "size", "needed")
        .agg(F.count(F.lit(1)).alias("matched"))
        .where(F.col("matched") >= F.col("needed"))
        .select(
            "doc_id",
            "item_id",
            F.col("size").cast("bigint").alias("size"),
            "matched",
            (F.col("matched") / F.col("size")).alias("containment"),
        )
    )
