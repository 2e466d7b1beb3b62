"""Pages as typed blocks, outlines, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.scale import block_scan
from quillon.session import written

EXTRACTOR_VERSION = "1"
# --- fixed values: which markup makes which kind of block ------------------------------------
DROPPED = r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>|<!--.*?-->"
# A block runs to its own closing tag or to where the next block begins, whatever is inside.
OPENED = "h[1-6]|p|li|tr|nav|footer"
BLOCK = (
    rf"(?is)<({OPENED})(?:\s[^>]*)?>"
    rf"(.*?)(?=</?(?:{OPENED}|ul|ol|table)(?:\s[^>]*)?>|\z)"
)
CELL = r"(?i)</t[dh]\s*>\s*(?:<t[dh](?:\s[^>]*)?>)?|<t[dh](?:\s[^>]*)?>"
KINDS = {"p": "text", "li": "list_item", "tr": "table", "footer": "page_footer", "nav": "page_header"}
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
# --- end of fixed values ---------------------------------------------------------------------


MANIFEST = (
    "doc_id string, title string, file string, publisher string, document_type string, "
    "population string, topics array<string>, skip_pages array<struct<lo: bigint, hi: bigint>>"
)
BLOCKS = "doc_id string, page bigint, pos int, kind string, text string, md_level int"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The documents to take in, from JSON lines; an id that is used twice is an error."""
    rows = spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(path)
    twice = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"ids used twice: {', '.join(str(r.doc_id) for r in twice)}")
    return rows


def document(manifest: DataFrame, doc_id: str) -> dict:
    """The manifest's entry of one document."""
    found = manifest.where(F.col("doc_id") == doc_id).limit(1).collect()
    if not found:
        raise KeyError(doc_id)
    return found[0].asDict(recursive=True)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Stored typed blocks as JSON lines: rows of known kinds with text, in declared types."""
    rows = spark.read.schema(BLOCKS).json(path)
    known = [*KINDS.values(), "heading"]
    return rows.where(F.col("kind").isin(known) & (F.trim("text") != "")).fillna({"md_level": 0})


def plain_text(markup: Column) -> Column:
    out = F.regexp_replace(markup, r"(?i)<br\s*/?>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def html_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row for each block in page order: ``(…, pos, kind, text, md_level)``.

    A table row is one block, its cells between bars. Empty blocks and text outside of blocks drop.
    """
    kept = [c for c in pages.columns if c != html]
    body = F.regexp_replace(html, DROPPED, "")
    found = F.zip_with(
        F.regexp_extract_all(body, F.lit(BLOCK), F.lit(1)),
        F.regexp_extract_all(body, F.lit(BLOCK), F.lit(2)),
        lambda tag, text: F.struct(F.lower(tag).alias("tag"), text.alias("text")),
    )
    rows = pages.select(*kept, F.posexplode(found).alias("pos", "_b"))
    tag, inner = F.col("_b.tag"), F.col("_b.text")
    heading = tag.rlike("^h[1-6]$")
    kind = F.when(heading, "heading")
    for name, to in KINDS.items():
        kind = kind.when(tag == name, to)
    text = plain_text(F.when(tag == "tr", F.regexp_replace(inner, CELL, " | ")).otherwise(inner))
    return rows.select(
        *kept, "pos", kind.alias("kind"), text.alias("text"),
        F.when(heading, F.substring(tag, 2, 1).cast("int")).otherwise(0).alias("md_level"),
    ).where(~F.col("text").rlike("^[| ]*$"))


def outline_paths(entries: DataFrame, pages: DataFrame, width: int = 256) -> DataFrame:
    """``entries(doc_id, n, level, title, page)`` to the outline path active on each page.

    An entry of level L cuts the path to its first L - 1 titles and is put behind them, so it
    comes to depth ``min(L, depth before + 1)``: a level that was skipped leaves no gap, and what
    stands at a place above stays. The depth after t entries is t less the running maximum of
    (s - L of entry s); the title at each depth is the last one that came to it.
    """
    clean = F.trim(F.regexp_replace("title", r"(?U)\s+", " "))
    named = entries.where((clean != "") & ~F.col("title").startswith("_Hlk"))
    marks = named.select("doc_id", "page", F.lit(0).alias("_kind"), "n", "level", clean.alias("title"))
    asked = pages.select(
        "doc_id", "page", F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("n"),
        F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("title"),
    )
    rows = marks.withColumn("n", F.col("n").cast("long")).unionByName(asked)
    along = (["doc_id"], F.floor(F.col("page") / width), ["page", "_kind", "n"])
    counted = block_scan(rows, *along, t=("sum", 1 - F.col("_kind")))
    sunk = F.when(F.col("_kind") == 0, F.col("t") - F.greatest("level", F.lit(1)))
    deep = block_scan(counted, *along, _sunk=("max", sunk)).withColumn(
        "depth", (F.col("t") - F.greatest(F.coalesce("_sunk", F.lit(0)), F.lit(0))).cast("int")
    )
    deep = written(deep.drop("t", "_sunk"), "outline-depths")
    most = deep.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    here = {
        f"l{k}": ("fill", F.when((F.col("_kind") == 0) & (F.col("depth") == k), F.col("title")))
        for k in range(1, most + 1)
    }
    placed = block_scan(deep, *along, **here) if here else deep
    path = F.slice(F.array(*(F.col(c) for c in here)).cast("array<string>"), F.lit(1), F.col("depth"))
    return placed.where("_kind = 1").select("doc_id", "page", path.alias("toc_path"))


def fingerprint(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def to_extract(files: DataFrame, done: DataFrame, version: str = EXTRACTOR_VERSION) -> DataFrame:
    """Files whose content or extractor version was not processed before."""
    seen = done.where(F.col("version") == version).select("doc_id", "sha256")
    return files.join(seen, ["doc_id", "sha256"], "left_anti")


def without_skipped(pages: DataFrame, skips: DataFrame) -> DataFrame:
    """Pages outside every skip range; ``skips(doc_id, skip_pages array<struct<lo,hi>>)`` holds one
    small row for each document of the manifest."""
    joined = pages.join(skips, "doc_id", "left")
    inside = F.exists("skip_pages", lambda r: F.col("page").between(r["lo"], r["hi"]))
    return joined.where(~F.coalesce(inside, F.lit(False))).drop("skip_pages")
