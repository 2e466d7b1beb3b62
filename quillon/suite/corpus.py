"""Pages and documents as blocks, sections, chunks and an index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import labels as LB
from quillon.functions import text as X
from quillon.functions.ids import chunk_id, content_hash
from quillon.operators import chunk as CH
from quillon.operators import index as IX
from quillon.operators import ingest as IN
from quillon.operators import structure as ST
from quillon.scale import spread
from quillon.session import discard, settled, shared_dir, written
from quillon.sources import blocks as B
from quillon.sources import reports
from quillon.suite.base import register, table


def page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Web pages; the host is the document, the page id its page number."""
    p = spread(table(spark, sf, "pages"))
    host = F.regexp_extract("url", "^https?://([^/]*)", 1)
    return B.html_blocks(p.select(host.alias("doc_id"), F.col("page_id").alias("page"), "html"))


def line_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents as they stand, as blocks: lines with cell borders are tables, every fourth
    other line that can be one is a heading, every fourth a list item. The source is the document,
    the document its page."""
    d = spread(table(spark, sf, "documents").select("source", "doc_id", "text"))
    lines = d.select(
        F.col("source").alias("doc_id"), F.col("doc_id").alias("page"),
        F.posexplode(F.split("text", "\n")).alias("pos", "text"),
    ).where(F.trim("text") != "")
    short = F.length("text") <= 100
    kind = (
        F.when(F.contains("text", F.lit("|")), "table")
        .when((F.col("pos") % 4 == 0) & short, "heading")
        .when(F.col("pos") % 4 == 3, "list_item")
        .otherwise("text")
    )
    mark = F.substring(F.md5(F.concat_ws("|", "page", "pos")), 1, 1)
    return lines.select(
        "doc_id", "page", "pos", kind.alias("kind"), "text", mark.alias("mark"),
        (F.col("page") % 4).cast("int").alias("md_level"),
    )


def with_numbers(blocks: DataFrame) -> DataFrame:
    """Headings get section numbers from their place: some bare, some deep, some none."""
    number = (
        F.when(F.col("mark") < "4", F.concat(F.col("page") % 3 + 1, F.lit(" "), "text"))
        .when(F.col("mark") < "8", F.concat(F.col("page") % 3 + 1, F.lit("."), F.col("pos") % 3 + 1, F.lit(" "), "text"))
        .when(F.col("mark") < "b", F.concat(F.col("page") % 3 + 1, F.lit("."), F.col("pos") % 3 + 1, F.lit("."), F.col("page") % 2 + 1, F.lit(" "), "text"))
        .when(F.col("mark") == "b", (F.col("page") % 3 + 1).cast("string"))
        .when(F.col("mark") == "c", F.concat(F.lit("Annex "), "text"))
        .otherwise(F.col("text"))
    )
    return blocks.withColumn("text", F.when(F.col("kind") == "heading", number).otherwise(F.col("text")))


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "documents").select("source").distinct()
    return s.select(
        F.col("source").alias("doc_id"), F.concat("source", F.lit(".pdf")).alias("file"),
        F.upper("source").alias("title"), F.lit("publisher").alias("publisher"),
        F.lit("guideline").alias("document_type"), F.lit("all").alias("population"),
        F.array(F.lit("general")).alias("topics"),
    )


# --- SQL -------------------------------------------------------------------------------------

LINES = r"""
lines AS (SELECT *, CASE WHEN contains(text, '|') THEN 'table' WHEN pos % 4 = 0 AND length(text) <= 100 THEN 'heading' WHEN pos % 4 = 3 THEN 'list_item' ELSE 'text' END AS kind,
    substring(md5(page || '|' || pos), 1, 1) AS mark, page % 4 AS md_level FROM
  (SELECT source AS doc_id, d.doc_id AS page, i - 1 AS pos, ls[i] AS text
   FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents) d, unnest(range(1, len(ls) + 1)) t(i)) WHERE trim(text) <> '')"""


def normal_sql(text: str) -> str:
    """A line without inline markup. Underscores and tags do not occur in these texts; what a
    pattern only looks at is taken and put back, twice where matches may touch."""
    out = text
    for old, new in X.LIGATURES.items():
        out = f"replace({out}, '{old}', '{new}')"
    word = r"[\p{L}\p{M}\p{N}]"
    for pattern, into, times in (
        (r"(?s)\*\*==>.*?<==\*\*", "", 1),
        (r"(?s)\*\*(.+?)\*\*", r"\1", 1),
        (rf"({word})(ffi|ffl|fi|fl|ff) ([a-z])", r"\1\2\3", 2),
        (r"(^|[^A-Za-z])(fi|fl|ff) ([a-z]{2})", r"\1\2\3", 2),
        (rf"({word})- ([a-z])", r"\1\2", 2),
        (r"[ \t]+", " ", 1),
        (r"^\s+|\s+$", "", 1),
        (r"^((?:[-*•■]\s+)?)u\s+([A-Z])", r"\1\2", 1),
    ):
        for _ in range(times):
            out = f"regexp_replace({out}, '{pattern}', '{into}', 'g')"
    return out


def heading_sql(text: str) -> str:
    """A heading whose markup is gone: no dots or colons at its ends, no drop cap set apart."""
    return rf"regexp_replace(trim({text}, ' .:'), '^((?:\d+(?:\.\d+)*\s+)?)([B-HJ-Z]) ([a-z]{{3}})', '\1\2\3')"


def is_heading_sql(h: str) -> str:
    return rf"length({h}) BETWEEN 3 AND 100 AND length(regexp_replace({h}, '[^\p{{Nd}}]', '', 'g')) * 10 < length({h}) * 3 AND regexp_matches({h}, '\p{{L}}')"


def display_sql(h: str) -> str:
    """Title case of an all-capitals heading; none of the acronyms occur in these texts."""
    letters = rf"regexp_replace({h}, '[^\p{{L}}]', '', 'g')"
    acronyms = ", ".join(f"'{a}'" for a in X.ACRONYMS)
    small = ", ".join(f"'{s}'" for s in X.SMALL_WORDS)
    core = r"upper(regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g'))"
    return rf"""CASE WHEN {letters} <> '' AND NOT regexp_matches({letters}, '[^\p{{Lu}}]') THEN array_to_string(list_transform(string_split({h}, ' '),
      lambda w, i: CASE WHEN i > 1 AND lower(w) IN ({small}) THEN lower(w)
        WHEN {core} IN ({acronyms}) OR (length({core}) BETWEEN 2 AND 4 AND NOT regexp_matches({core}, '[AEIOU]')) THEN w
        ELSE upper(substring(w, 1, 1)) || lower(substring(w, 2)) END), ' ') ELSE {h} END"""


CLEAN = rf"""
normed AS (SELECT * REPLACE ({normal_sql("CASE WHEN kind = 'heading' THEN regexp_replace(text, '^#{1,6}\\s*', '') ELSE text END")} AS text) FROM SOURCE),
cleaned AS (SELECT * REPLACE (CASE kind WHEN 'heading' THEN {heading_sql("regexp_replace(text, '\\s+', ' ', 'g')")}
    WHEN 'table' THEN CASE WHEN trim(text, '| ') = '' THEN '' ELSE text END
    ELSE trim(regexp_replace(text, '\s+', ' ', 'g')) END AS text) FROM normed),
bulleted AS (SELECT *, kind = 'heading' AND regexp_matches(regexp_replace(text, '^#{{1,6}}\s*', ''), '^\s*[-*•●■▪◦‣]') AS bullet FROM cleaned WHERE text <> ''),
roled AS (SELECT *, CASE WHEN bullet THEN 'unit' WHEN kind = 'heading' AND regexp_matches(text, '(?i)^(?:chapter\s+)?\d{{1,2}}\.?$') THEN 'bare'
    WHEN kind = 'heading' AND {is_heading_sql('text')} THEN 'head' ELSE 'unit' END AS role FROM bulleted)"""
DOC = "PARTITION BY doc_id ORDER BY page, pos"
UNITS_OUT = r"""SELECT doc_id, page, pos, CASE WHEN bullet OR kind = 'list_item' THEN 'list_item' WHEN kind = 'table' THEN 'table' ELSE 'text' END AS kind,
  CASE WHEN bullet OR kind = 'list_item' THEN '- ' || regexp_replace(text, '^\s*(?:[-*•●■▪◦‣–]|\d+[.)])\s+', '') ELSE text END AS text, path FROM pathed
  WHERE role = 'unit' AND NOT (kind = 'text' AND (doc_id, text) IN (SELECT (doc_id, text) FROM repeated))"""
REPEATED = """
page_count AS (SELECT doc_id, count(DISTINCT page) AS pages FROM SOURCE GROUP BY 1),
repeated AS (SELECT doc_id, text, count(*) AS n FROM (SELECT DISTINCT doc_id, page, text FROM cleaned WHERE kind = 'text' AND length(text) >= 40)
  JOIN page_count USING (doc_id) GROUP BY 1, 2 HAVING count(*) >= greatest(6, 0.04 * any_value(pages)))"""
NUMBERED_LINES = """
numbered AS (SELECT * REPLACE (CASE WHEN kind <> 'heading' THEN text WHEN mark < '4' THEN (page % 3 + 1) || ' ' || text
  WHEN mark < '8' THEN (page % 3 + 1) || '.' || (pos % 3 + 1) || ' ' || text
  WHEN mark < 'b' THEN (page % 3 + 1) || '.' || (pos % 3 + 1) || '.' || (page % 2 + 1) || ' ' || text
  WHEN mark = 'b' THEN (page % 3 + 1)::VARCHAR WHEN mark = 'c' THEN 'Annex ' || text ELSE text END AS text) FROM lines)"""


def dedup_sql(parts: str) -> str:
    """Null parts and parts equal to the one before them dropped, joined."""
    return f"""array_to_string(list_filter(list_filter({parts}, lambda x: x IS NOT NULL), lambda x, i: i = 1 OR
      lower(x) <> lower(list_filter({parts}, lambda y: y IS NOT NULL)[i - 1])), ' > ')"""


def _units(units: DataFrame) -> DataFrame:
    return units.withColumn("path", F.array_join("path", " > "))


MARKDOWN = f"""
heads AS (SELECT *, row_number() OVER ({DOC}) AS n, least(greatest(md_level, 1), 3) AS d FROM roled WHERE role = 'head'),
deep AS (SELECT *, min(d - n) OVER ({DOC}) AS m FROM heads),
leveled AS (SELECT *, least(n, n + m)::BIGINT AS p, {display_sql('text')} AS shown FROM deep),
slots AS (SELECT r.*, max(CASE WHEN l.p = 1 THEN l.n END) OVER w AS n1, max(CASE WHEN l.p = 2 THEN l.n END) OVER w AS n2, max(CASE WHEN l.p = 3 THEN l.n END) OVER w AS n3,
    last_value(CASE WHEN l.p = 1 THEN shown END IGNORE NULLS) OVER w AS s1, last_value(CASE WHEN l.p = 2 THEN shown END IGNORE NULLS) OVER w AS s2,
    last_value(CASE WHEN l.p = 3 THEN shown END IGNORE NULLS) OVER w AS s3
  FROM roled r LEFT JOIN leveled l USING (doc_id, page, pos) WINDOW w AS (PARTITION BY r.doc_id ORDER BY r.page, r.pos)),
parts AS (SELECT *, [s1, CASE WHEN n2 > n1 THEN s2 END, CASE WHEN n3 > n2 AND n3 > n1 THEN s3 END] AS ps FROM slots),
pathed AS (SELECT *, {dedup_sql('ps')} AS path FROM parts)"""


@register(
    "sections_markdown", "C1 W5 W7 J8 H2 H4 P10",
    f"WITH {LINES},{CLEAN.replace('SOURCE', 'lines')},{MARKDOWN},{REPEATED.replace('SOURCE', 'lines')} {UNITS_OUT}",
)
def sections_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return _units(ST.structure_units(line_blocks(spark, sf), "markdown"))


CAPS = f"""
caps_lines AS (SELECT * REPLACE (CASE WHEN kind = 'heading' AND mark < '4' THEN upper(replace(text, 'ß', 'SS')) ELSE text END AS text) FROM lines),"""
CAPS_PATH = rf"""
marked AS (SELECT *, {display_sql('text')} AS shown, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) >= 3
    AND NOT regexp_matches(regexp_replace(text, '[^\p{{L}}]', '', 'g'), '[^\p{{Lu}}]') AS caps FROM roled),
filled AS (SELECT *, last_value(CASE WHEN role = 'head' AND caps THEN shown END IGNORE NULLS) OVER ({DOC}) AS base,
    last_value(CASE WHEN role = 'head' THEN CASE WHEN caps THEN '' ELSE shown END END IGNORE NULLS) OVER ({DOC}) AS sub FROM marked),
parts AS (SELECT *, [base, nullif(sub, '')] AS ps FROM filled),
pathed AS (SELECT *, {dedup_sql('ps')} AS path FROM parts)"""


@register(
    "sections_caps_topics", "C1 W4 P11",
    f"WITH {LINES},{CAPS}{CLEAN.replace('SOURCE', 'caps_lines')},{CAPS_PATH},{REPEATED.replace('SOURCE', 'caps_lines')} {UNITS_OUT}",
)
def sections_caps_topics(spark: SparkSession, sf: str) -> DataFrame:
    b = line_blocks(spark, sf)
    loud = (F.col("kind") == "heading") & (F.col("mark") < "4")
    return _units(ST.structure_units(b.withColumn("text", F.when(loud, F.upper("text")).otherwise(F.col("text"))), "caps_topics"))


NUM = r"(?i)^(?:chapter\s+|section\s+)?(\d{1,2}(?:\.\d{1,2}){0,4})\.?\s+(\S.*)$"
NUMBERED = rf"""
hs AS (SELECT *, lag(CASE WHEN role = 'bare' THEN text ELSE '' END) OVER ({DOC}) AS pending FROM roled WHERE role IN ('head', 'bare')),
hs2 AS (SELECT * REPLACE (CASE WHEN coalesce(pending, '') <> '' AND NOT regexp_matches(text, '{NUM}') THEN pending || ' ' || text ELSE text END AS text) FROM hs WHERE role = 'head'),
hs3 AS (SELECT *, regexp_matches(text, '(?i)^annex') AS top, regexp_extract(text, '{NUM}', 1) AS no, regexp_extract(text, '{NUM}', 2) AS rest, row_number() OVER ({DOC}) AS n FROM hs2),
hs4 AS (SELECT *, CASE WHEN top THEN []::VARCHAR[] WHEN no <> '' THEN string_split(no, '.') END AS nums,
    CASE WHEN no <> '' AND NOT top THEN no || ' ' || {display_sql('rest')} ELSE {display_sql('text')} END AS title FROM hs3),
mains AS (SELECT *, lag(nums) OVER ({DOC}) AS was FROM hs4 WHERE nums IS NOT NULL),
anc AS (SELECT *, {', '.join(f"last_value(CASE WHEN was IS NULL OR len(nums) <= {k} OR nums[:{k}] <> was[:{k}] THEN {{'v': nums, 't': title}} END IGNORE NULLS) OVER ({DOC}) AS a{k}" for k in (1, 2, 3))} FROM mains),
mp AS (SELECT doc_id, page, pos, n, [{', '.join(f"CASE WHEN len(nums) > {k} AND a{k}.v = nums[:{k}] THEN a{k}.t END" for k in (1, 2, 3))}, title] AS ps FROM anc),
filled AS (SELECT r.*, last_value(CASE WHEN mp.n IS NOT NULL THEN mp.ps END IGNORE NULLS) OVER w AS ps0, max(mp.n) OVER w AS n0,
    max(CASE WHEN h.nums IS NULL THEN h.n END) OVER w AS n1, last_value(CASE WHEN h.n IS NOT NULL AND h.nums IS NULL THEN h.title END IGNORE NULLS) OVER w AS sub
  FROM roled r LEFT JOIN hs4 h USING (doc_id, page, pos) LEFT JOIN mp USING (doc_id, page, pos) WINDOW w AS (PARTITION BY r.doc_id ORDER BY r.page, r.pos)),
parts AS (SELECT *, list_append(coalesce(ps0, []), CASE WHEN n0 IS NULL OR n1 > n0 THEN sub END) AS ps FROM filled),
pathed AS (SELECT *, {dedup_sql('ps')} AS path FROM parts)"""


@register(
    "sections_numbered", "C1 W6",
    f"WITH {LINES},{NUMBERED_LINES},{CLEAN.replace('SOURCE', 'numbered')},{NUMBERED},{REPEATED.replace('SOURCE', 'numbered')} {UNITS_OUT}",
)
def sections_numbered(spark: SparkSession, sf: str) -> DataFrame:
    return _units(ST.structure_units(with_numbers(line_blocks(spark, sf)), "numbered"))


TOC_PAGES = """
toc AS (SELECT doc_id, page, CASE WHEN page % 3 = 0 THEN ['Part ' || (page // 50)] WHEN page % 3 = 1 THEN ['Part ' || (page // 50), 'Chapter ' || (page // 10)] ELSE [] END AS base
  FROM (SELECT DISTINCT doc_id, page FROM lines))"""
PAGED = f"""
based AS (SELECT *, sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page) AS no FROM bases),
joined AS (SELECT r.*, b.base, b.no, CASE WHEN role = 'head' THEN {display_sql('text')} END AS shown FROM roled r JOIN based b USING (doc_id, page)),
filled AS (SELECT *, last_value(CASE WHEN shown IS NOT NULL THEN {{'no': no, 't': shown}} END IGNORE NULLS) OVER ({DOC}) AS level FROM joined),
parts AS (SELECT *, list_append(base, CASE WHEN level.no = no THEN level.t END) AS ps FROM filled),
pathed AS (SELECT *, {dedup_sql('ps')} AS path FROM parts)"""


@register(
    "sections_toc", "C1 W4",
    f"""WITH {LINES},{CLEAN.replace('SOURCE', 'lines')},{TOC_PAGES},
    bases AS (SELECT *, base <> coalesce(lag(base) OVER (PARTITION BY doc_id ORDER BY page), []) AS changed FROM toc),{PAGED},{REPEATED.replace('SOURCE', 'lines')} {UNITS_OUT}""",
)
def sections_toc(spark: SparkSession, sf: str) -> DataFrame:
    b = line_blocks(spark, sf)
    part = F.concat(F.lit("Part "), F.floor(F.col("page") / 50))
    chapter = F.concat(F.lit("Chapter "), F.floor(F.col("page") / 10))
    path = F.when(F.col("page") % 3 == 0, F.array(part)).when(F.col("page") % 3 == 1, F.array(part, chapter)).otherwise(F.array().cast("array<string>"))
    outline = b.select("doc_id", "page").distinct().withColumn("toc_path", path)
    return _units(ST.structure_units(b, "toc", outline=outline))


def headed(blocks: DataFrame) -> DataFrame:
    """Two running headers for each page: one of a few section names, one the document's own."""
    pages = blocks.select("doc_id", "page").distinct()
    names = F.element_at(
        F.array(*[F.lit(n) for n in ("FEVER AND COUGH Assessment", "Small print", "DEP 1", "SKIN CARE")]),
        (F.floor(F.col("page") / 40) % 4 + 1).cast("int"),
    )
    first = pages.select("doc_id", "page", F.lit(-2).alias("pos"), F.lit("page_header").alias("kind"), names.alias("text"))
    own = pages.select("doc_id", "page", F.lit(-1).alias("pos"), F.lit("page_footer").alias("kind"), F.concat(F.lit("Handbook "), F.col("doc_id")).alias("text"))
    mark, level = F.lit("").alias("mark"), F.lit(0).alias("md_level")
    return blocks.unionByName(first.select("*", mark, level)).unionByName(own.select("*", mark, level))


RUNNING = """
heads0 AS (SELECT doc_id, page, ['Fever and Cough', 'Small print', NULL, 'Skin Care'][page // 40 % 4 + 1] AS name,
    ['FEVER AND COUGH Assessment', 'Small print', NULL, 'SKIN CARE'][page // 40 % 4 + 1] AS raw FROM (SELECT DISTINCT doc_id, page FROM lines)),
often AS (SELECT doc_id, raw FROM heads0 GROUP BY 1, 2 HAVING count(*) > greatest(0.3 * (SELECT count(*) FROM heads0 h WHERE h.doc_id = heads0.doc_id), 5)),
titles AS (SELECT doc_id, page, CASE WHEN (doc_id, raw) NOT IN (SELECT (doc_id, raw) FROM often WHERE raw IS NOT NULL) THEN name END AS title FROM heads0)"""


@register("running_titles", "A3 W8 H7 P11", f"WITH {LINES},{RUNNING} SELECT doc_id, page, title FROM titles WHERE title IS NOT NULL")
def running_titles(spark: SparkSession, sf: str) -> DataFrame:
    return ST.running_titles(headed(line_blocks(spark, sf)))


@register(
    "sections_running", "C1 W4 W8 J9",
    f"""WITH {LINES},{CLEAN.replace('SOURCE', 'lines')},{RUNNING},
    aliased AS (SELECT doc_id, page, CASE WHEN title = 'Skin Care' THEN 'Skin conditions' ELSE title END AS title FROM titles),
    seen AS (SELECT *, last_value(title IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page) AS now,
      last_value(title IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM aliased),
    bases AS (SELECT doc_id, page, CASE WHEN now IS NULL THEN [] ELSE [now] END AS base, title IS NOT NULL AND title IS DISTINCT FROM was AS changed FROM seen),
    {PAGED},{REPEATED.replace('SOURCE', 'lines')} {UNITS_OUT}""",
)
def sections_running(spark: SparkSession, sf: str) -> DataFrame:
    b = headed(line_blocks(spark, sf))
    return _units(ST.structure_units(b, "running", aliases={"skin care": "Skin conditions"}))


@register("repeated_paragraphs", "A4", f"WITH {LINES},{CLEAN},{REPEATED} SELECT doc_id, text, n FROM repeated".replace("SOURCE", "lines"))
def repeated_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return ST.repeated_paragraphs(line_blocks(spark, sf))


# Pieces between block tags, each beginning with its tag; what follows a closing tag is no block.
HTML = r"""
body AS (SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS doc_id, page_id AS page,
    regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'g') AS h FROM pages),
cut AS (SELECT doc_id, page, string_split(regexp_replace(h, '(?is)(</?(?:h[1-6]|p|li|tr|nav|footer|ul|ol|table)(?:\s[^>]*)?>)', chr(1) || '\1', 'g'), chr(1)) AS pieces FROM body),
ps AS (SELECT doc_id, page, pieces[i] AS piece, i FROM cut, unnest(range(1, len(pieces) + 1)) u(i)),
opened AS (SELECT doc_id, page, i, lower(regexp_extract(piece, '(?is)^<(h[1-6]|p|li|tr|nav|footer)(?:\s[^>]*)?>', 1)) AS tag,
    regexp_replace(piece, '(?is)^<[^>]*>', '') AS inner_text FROM ps),
ex AS (SELECT doc_id, page, tag, row_number() OVER (PARTITION BY page ORDER BY i) - 1 AS pos,
    regexp_replace(regexp_replace(CASE WHEN tag = 'tr' THEN regexp_replace(inner_text, '(?i)</t[dh]\s*>\s*(?:<t[dh](?:\s[^>]*)?>)?|<t[dh](?:\s[^>]*)?>', ' | ', 'g') ELSE inner_text END,
      '(?i)<br\s*/?>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM opened WHERE tag <> ''),
blocks AS (SELECT doc_id, page, pos, CASE tag WHEN 'p' THEN 'text' WHEN 'li' THEN 'list_item' WHEN 'tr' THEN 'table' WHEN 'footer' THEN 'page_footer' WHEN 'nav' THEN 'page_header' ELSE 'heading' END AS kind,
    trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS text,
    CASE WHEN tag LIKE 'h_' THEN substring(tag, 2, 1)::INT ELSE 0 END AS md_level FROM ex)"""


@register("page_blocks", "S2 S3", f"WITH {HTML} SELECT * FROM blocks WHERE NOT regexp_matches(text, '^[| ]*$')")
def html_page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return page_blocks(spark, sf)


@register(
    "kept_pages", "P8 S1",
    f"""WITH p AS (SELECT page_id AS page, regexp_extract(url, '^https?://([^/]*)', 1) AS doc_id FROM pages)
    SELECT doc_id, page FROM p WHERE NOT (page BETWEEN length(doc_id) AND length(doc_id) + 9 OR page BETWEEN 100 AND 119)""",
)
def kept_pages(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select(
        F.regexp_extract("url", "^https?://([^/]*)", 1).alias("doc_id"), F.col("page_id").alias("page")
    )
    low = F.length("doc_id").cast("long")
    ranges = F.array(
        F.struct(low.alias("lo"), (low + 9).alias("hi")),
        F.struct(F.lit(100).cast("long").alias("lo"), F.lit(119).cast("long").alias("hi")),
    )
    return B.without_skipped(p, p.select("doc_id").distinct().withColumn("skip_pages", ranges))


@register(
    "outline_paths", "S4",
    """WITH RECURSIVE e AS (SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS doc_id, page_id AS page, page_id * 5 % 8 + 1 AS level, 'Title ' || page_id AS title,
      row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/]*)', 1) ORDER BY page_id) AS i FROM pages WHERE page_id % 4 > 0),
    walk AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS stack FROM e
      UNION ALL SELECT w.doc_id, e.i, list_append(w.stack[1:e.level - 1], e.title) FROM walk w JOIN e ON e.doc_id = w.doc_id AND e.i = w.i + 1),
    p AS (SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS doc_id, page_id AS page FROM pages),
    seen AS (SELECT p.doc_id, p.page, count(e.i) AS i FROM p LEFT JOIN e ON e.doc_id = p.doc_id AND e.page <= p.page GROUP BY 1, 2)
    SELECT seen.doc_id, seen.page, coalesce(array_to_string(stack, ' > '), '') AS path FROM seen LEFT JOIN walk USING (doc_id, i)""",
)
def outline_paths(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select(
        F.regexp_extract("url", "^https?://([^/]*)", 1).alias("doc_id"), F.col("page_id").alias("page")
    )
    entries = p.where("page % 4 > 0").select(
        "doc_id", F.col("page").alias("n"), (F.col("page") * 5 % 8 + 1).cast("int").alias("level"),
        F.concat(F.lit("Title "), "page").alias("title"), "page",
    )
    return B.outline_paths(entries, p).select("doc_id", "page", F.array_join("toc_path", " > ").alias("path"))


@register(
    "unprocessed_files", "S5",
    """SELECT page_id AS doc_id, sha256(html) AS sha256 FROM pages WHERE page_id % 3 = 0""",
)
def unprocessed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Two thirds of the pages were processed before."""
    files = table(spark, sf, "pages").select(
        F.col("page_id").alias("doc_id"), B.fingerprint(F.col("html")).alias("sha256")
    )
    done = files.where("doc_id % 3 > 0").withColumn("version", F.lit(B.EXTRACTOR_VERSION))
    return B.to_extract(files, done)


# --- labels over documents -------------------------------------------------------------------

EXTRA = ["give ors and zinc for diarrhoea, refer urgently", "Strong recommendation: vaccines for measles",
         "| a | 12 |\n| b | 13 |\n| c | 14 |\n| d | 15 |", "malaria and malaria and fever", "All rights reserved",
         "headache, eye, ear, tablets of paracetamol dose"]
SECTIONS = ["Newborn care", "Adults with cough", "References", "Pregnancy", "General"]


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a section and a line of medical words, so that the labels have work to do."""
    d = table(spark, sf, "documents")
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % k + 1).cast("int"))
    return d.select(
        "doc_id", F.array(F.lit("Guide"), pick(SECTIONS, 5)).alias("path"),
        F.concat("text", F.lit("\n"), pick(EXTRA, 6)).alias("text"),
        (F.col("doc_id") % 10 / 10).alias("share"),
    )


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("\n", "' || chr(10) || '") + "'" for v in values) + "]"


LABELLED = f"""
docs AS (SELECT doc_id, ['Guide', {_sql_list(SECTIONS)}[doc_id % 5 + 1]] AS path, text || chr(10) || {_sql_list(EXTRA)}[doc_id % 6 + 1] AS text, doc_id % 10 / 10 AS share FROM documents)"""
HITS = ", ".join(
    f"{{'s': -(3 * len(regexp_extract_all(lower(array_to_string(path, ' ')), '{LB.topic_pattern(t)}')) + len(regexp_extract_all(lower(text), '{LB.topic_pattern(t)}'))), 'i': {i}, 't': '{t}'}}"
    for i, t in enumerate(LB.TOPICS)
)


def _flag(pattern: str) -> str:
    return pattern.replace("U)", ")") if pattern.startswith("(?iU)") else pattern


@register(
    "chunk_labels", "H12 H13 H14 T7 P7 C5",
    f"""WITH {LABELLED}, scored AS (SELECT *, list_sort(list_filter([{HITS}], lambda x: x.s <= -2)) AS hits, array_to_string(path, ' ') AS heading FROM docs)
    SELECT doc_id, CASE WHEN len(hits) > 0 THEN array_to_string(list_transform(hits[1:3], lambda x: x.t), ',') ELSE 'general' END AS topics,
      CASE WHEN regexp_matches(heading, '{_flag(LB.PREGNANCY)}') THEN 'pregnancy' WHEN regexp_matches(heading, '{_flag(LB.CHILD)}') THEN 'child'
        WHEN regexp_matches(heading, '{_flag(LB.ADULT)}') THEN 'adult' ELSE 'all' END AS population,
      CASE WHEN regexp_matches(heading, '{LB.WARNING}') OR regexp_matches(text, '{LB.WARNING}') THEN 'warning'
        WHEN regexp_matches(heading, '{LB.RECOMMENDATION}') OR regexp_matches(text, '{LB.RECOMMENDATION}') THEN 'recommendation'
        WHEN share >= 0.5 THEN 'table' ELSE 'text' END AS chunk_type,
      len(list_filter(path, lambda x: regexp_matches(x, '{_flag(LB.EXCLUDED_SECTION)}'))) = 0 AND NOT regexp_matches(text, '{LB.FRONT_MATTER}')
        AND NOT (len(rs) >= 4 AND len(list_filter(rs, lambda x: regexp_matches(x, '\\|\\s*\\d{{1,4}}\\s*\\|\\s*$'))) / greatest(len(rs), 1) >= 0.6) AS retrievable
    FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '|')) AS rs FROM scored)""",
)
def chunk_labels(spark: SparkSession, sf: str) -> DataFrame:
    path, text = F.col("path"), F.col("text")
    return labelled(spark, sf).select(
        "doc_id", F.array_join(LB.chunk_topics(path, text, F.array(F.lit("general"))), ",").alias("topics"),
        LB.chunk_population(F.lit("all"), path).alias("population"),
        LB.chunk_type(path, text, F.col("share")).alias("chunk_type"),
        LB.is_retrievable(path, text).alias("retrievable"),
    )


@register(
    "inferred_topics", "H15 P6",
    f"""WITH {LABELLED}, scored AS (SELECT doc_id, list_sort(list_filter([{HITS.replace("lower(array_to_string(path, ' '))", "''")}], lambda x: x.s <= -1)) AS hits FROM docs)
    SELECT doc_id, array_to_string(list_transform(hits[1:2], lambda x: x.t), ',') AS topics FROM scored""",
)
def inferred_topics(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(spark, sf).select("doc_id", F.array_join(LB.infer_topics(F.col("text")), ",").alias("topics"))


@register(
    "chunk_ids", "H9 H10 W11",
    """SELECT source || ':p' || lpad((doc_id % 1000)::VARCHAR, 4, '0') || ':' || substring(sha1(source || '|' || lang || '|' || source || '|' || text), 1, 12) AS chunk_id,
      sha1('words' || chr(10) || text) AS content_hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1, 2""",
)
def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(
        chunk_id(F.col("source"), F.col("doc_id") % 1000, F.array("lang", "source"), F.col("text")).alias("chunk_id"),
        content_hash("words", F.col("text")).alias("content_hash"), "doc_id",
    )
    return d.groupBy("chunk_id", "content_hash").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))


@register("document_chunks", "C1 C2 C3 C4 C5 H8 W9 W10 W11")
def document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunks = all_chunks(spark, sf)
    return chunks.select(
        "chunk_id", "document_id", F.array_join("heading_path", " > ").alias("path"), "page_number", "page_end",
        "token_count", "chunk_type", "population", F.array_join("topics", ",").alias("topics"), "retrievable",
    )


def all_chunks(spark: SparkSession, sf: str) -> DataFrame:
    units = settled(lambda: ST.structure_units(line_blocks(spark, sf), "markdown"), "units")
    chunks = CH.chunk_units(units, manifest(spark, sf), target=200, minimum=40, overlap=30, section_merge=80)
    discard(units)
    return chunks


def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as finished chunks, for the report."""
    return table(spark, sf, "documents").select(
        F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_id"), F.col("lang").alias("population"),
        F.col("n_chars").alias("token_count"), (F.col("n_chars") >= 40).alias("retrievable"),
        F.concat(F.lit("t"), F.col("doc_id") % 9).alias("topic"),
    )


@register("ingest_report", "A2 S6 S20")
def ingest_report(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks of a run, written by document and read back, and what is reported of them."""
    folder = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    made = all_chunks(spark, sf)
    reports.write_chunks(made, f"{folder}/chunks")
    chunks = reports.read_chunks(spark, f"{folder}/chunks", made.schema)
    pages = table(spark, sf, "documents").groupBy(F.col("source").alias("document_id")).agg(
        F.countDistinct("doc_id").alias("pages")
    )
    report = written(IN.document_report(chunks, pages), "report")
    reports.write_markdown(report, f"{folder}/report", "Chunks by document", ["document_id"])
    return report


@register(
    "document_report", "A2",
    """WITH d AS (SELECT source AS document_id, *, 't' || (doc_id % 9) AS topic, CASE WHEN doc_id % 5 = 0 THEN 'table' ELSE 'text' END AS kind FROM documents WHERE doc_id % 16 > 0),
    p AS (SELECT source AS document_id, count(DISTINCT doc_id) AS pages FROM documents GROUP BY 1),
    one AS (SELECT document_id, count(*) AS chunks, count(*) FILTER (n_chars >= 40) AS retrievable, count(DISTINCT lang) AS sections,
      round(quantile_cont(n_chars, 0.5), 1) AS tokens_p50, round(quantile_cont(n_chars, 0.95), 1) AS tokens_p95, max(n_chars) AS tokens_max FROM d GROUP BY 1),
    k AS (SELECT document_id, string_agg(kind || '=' || n, ',' ORDER BY kind) AS chunk_types FROM (SELECT document_id, kind, count(*) AS n FROM d GROUP BY 1, 2) GROUP BY 1),
    l AS (SELECT document_id, string_agg(lang || '=' || n, ',' ORDER BY lang) AS populations FROM (SELECT document_id, lang, count(*) AS n FROM d GROUP BY 1, 2) GROUP BY 1),
    t AS (SELECT document_id, string_agg(topic || '=' || n, ',' ORDER BY n DESC, topic) AS top_topics FROM
      (SELECT document_id, topic, count(*) AS n FROM d GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n DESC, topic) <= 5) GROUP BY 1)
    SELECT document_id, pages, coalesce(chunks, 0) AS chunks, coalesce(retrievable, 0) AS retrievable, coalesce(sections, 0) AS sections, coalesce(tokens_p50, 0) AS tokens_p50,
      coalesce(tokens_p95, 0) AS tokens_p95, coalesce(tokens_max, 0) AS tokens_max, coalesce(chunk_types, '') AS chunk_types, coalesce(populations, '') AS populations, coalesce(top_topics, '') AS top_topics
    FROM p LEFT JOIN one USING (document_id) LEFT JOIN k USING (document_id) LEFT JOIN l USING (document_id) LEFT JOIN t USING (document_id)""",
)
def document_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report's arithmetic over documents as chunks, by languages as sections."""
    d = table(spark, sf, "documents")
    rows = d.where("doc_id % 16 > 0").select(
        F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_id"), F.array("lang").alias("heading_path"),
        F.col("n_chars").alias("token_count"), (F.col("n_chars") >= 40).alias("retrievable"),
        F.when(F.col("doc_id") % 5 == 0, "table").otherwise("text").alias("chunk_type"), F.col("lang").alias("population"),
        F.concat(F.lit("t"), F.col("doc_id") % 9).alias("topic"),
    )
    pages = d.groupBy(F.col("source").alias("document_id")).agg(F.countDistinct("doc_id").alias("pages"))
    return IN.document_report(rows, pages)


@register(
    "chunk_samples", "T9",
    """SELECT source AS document_id, doc_id AS chunk_id FROM documents WHERE n_chars >= 40
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY ('0x' || substring(md5('7|' || doc_id), 1, 8))::BIGINT, doc_id) <= 4""",
)
def chunk_samples(spark: SparkSession, sf: str) -> DataFrame:
    from quillon.functions.ids import draw

    order = Window.partitionBy("document_id").orderBy(draw("7", F.col("chunk_id")), "chunk_id")
    rows = report_rows(spark, sf).where("retrievable")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n <= 4").select("document_id", "chunk_id")


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    """What an earlier run stored: some documents missing, some with other text, some since gone."""
    d = table(spark, sf, "documents")
    old = d.where("doc_id % 4 != 0").select(
        F.col("doc_id").alias("id"),
        F.sha1(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text")).cast("binary")).alias("content_hash"),
    )
    gone = d.where("doc_id % 11 = 0").select((-F.col("doc_id") - 1).alias("id"), F.sha1(F.col("text").cast("binary")).alias("content_hash"))
    return old.unionByName(gone)


def _wanted(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha1(F.col("text").cast("binary")).alias("content_hash"))


STORED = """
stored AS (SELECT doc_id AS id, sha1(CASE WHEN doc_id % 5 = 0 THEN text || ' old' ELSE text END) AS content_hash FROM documents WHERE doc_id % 4 <> 0
  UNION ALL SELECT -doc_id - 1, sha1(text) FROM documents WHERE doc_id % 11 = 0),
wanted AS (SELECT doc_id AS id, sha1(text) AS content_hash FROM documents)"""


@register(
    "index_changes", "S12 S13 J6 U2",
    f"""WITH {STORED} SELECT coalesce(w.id, s.id) AS id, CASE WHEN s.id IS NULL THEN 'new' WHEN w.id IS NULL THEN 'stale'
      WHEN w.content_hash <> s.content_hash THEN 'changed' ELSE 'unchanged' END AS status FROM wanted w FULL JOIN stored s ON w.id = s.id""",
)
def index_changes(spark: SparkSession, sf: str) -> DataFrame:
    return IX.changes(_wanted(spark, sf), _stored(spark, sf))


@register("index_snapshot", "S6 S14 S15", f"WITH {STORED} SELECT id, content_hash FROM wanted")
def index_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return IX.sync(_stored(spark, sf), _wanted(spark, sf))
