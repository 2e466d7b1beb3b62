"""The parts table as three product lists: parsing, merging, features, search, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import names as N
from quillon.operators import lookup as L
from quillon.operators.dense import hashed_words
from quillon.operators.stats import wilson
from quillon.plans import lookup as plan
from quillon.scale import spread
from quillon.session import written
from quillon.sources import catalogue as C
from quillon.suite.base import register, table
from quillon.suite.retrieval import vectors_sql

FORMS = {"ECONOMY": "Tablet", "SMALL": "Capsule", "LARGE": "Syrup", "STANDARD": "Injection"}


def _form():
    out = F.lit("Drops")
    for kind, form in FORMS.items():
        out = F.when(F.col("p_type") == kind, form).otherwise(out)
    return out


def part_name():
    return F.concat_ws(
        " ", "p_name", "p_brand", F.concat("p_size", F.lit("mg")), _form()
    )


def branded_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every third part as a row of the branded list."""
    p = table(spark, sf, "part").where("p_partkey % 3 = 2")
    key = F.col("p_partkey")
    return p.select(
        F.col("p_partkey").cast("string").alias("id"),
        part_name().alias("name"),
        F.when(key % 4 == 0, "TRUE").otherwise("FALSE").alias("Is_discontinued"),
        F.col("p_brand").alias("manufacturer_name"),
        F.concat(F.lit("strip of  10 "), F.lower(_form()), F.lit("s")).alias("pack_size_label"),
        F.when(key % 5 == 0, F.col("p_name"))
        .otherwise(F.concat("p_name", F.lit("  ("), F.col("p_size"), F.lit("mg) ")))
        .alias("short_composition1"),
        F.when(key % 2 == 0, F.concat(F.lower("p_type"), F.lit(" (5ml)"))).alias("short_composition2"),
    )


def generic_rows(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").where("p_partkey % 3 = 1")
    code = F.when(F.col("p_partkey") % 10 == 0, "code").otherwise(F.col("p_partkey").cast("string"))
    return p.select(
        F.array(
            F.col("p_partkey").cast("string"), code,
            F.concat_ws(
                " ", "p_name", F.concat("p_size", F.lit("mg and 5 g/10ml")), _form()
            ),
            F.lit("10's"),
        ).alias("cells")
    )


def list_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every third part as lines of the essential list; the brand is the document."""
    p = table(spark, sf, "part").where("p_partkey % 3 = 0")
    key = F.col("p_partkey")
    lines = F.array(
        F.concat(F.lit("1.2."), key, F.lit(" - "), F.col("p_name")),
        F.concat(F.col("p_brand"), F.lit(" (A)")),
        F.lit("P, S"),
        F.concat(F.lit("Tablet "), F.col("p_size"), F.lit("mg")),
        F.concat(F.lit("in strip of "), key % 10),
        F.when(key % 2 == 0, F.concat(F.lit("Syrup "), F.col("p_size"), F.lit("mg/5ml"))).otherwise("As licensed"),
        F.when(key % 7 == 0, "* note").otherwise("S"),
        F.when(key % 5 == 0, "Medicine level"),
    )
    return p.select(
        F.col("p_brand").alias("doc_id"), key.alias("_k"), F.posexplode(lines).alias("_i", "line")
    ).where("line is not null").select(
        "doc_id", (F.col("_k") * 10 + F.col("_i")).alias("line_no"), "line"
    )


def products(spark: SparkSession, sf: str) -> DataFrame:
    return C.load(
        C.essential(C.list_entries(list_lines(spark, sf))),
        C.generic(generic_rows(spark, sf)),
        C.branded(branded_rows(spark, sf)),
    )


def merged(spark: SparkSession, sf: str) -> DataFrame:
    return C.merge(products(spark, sf))


def heard(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier asks for a part, with the second letter of its name left out."""
    s = table(spark, sf, "supplier")
    p = table(spark, sf, "part")
    return s.join(p, p.p_partkey == s.s_suppkey * 2).select(
        F.col("s_suppkey").alias("query_id"),
        F.concat_ws(
            " ",
            F.concat(F.substring("p_name", 1, 1), F.substr("p_name", F.lit(3))),
            F.col("p_size").cast("string"),
        ).alias("heard"),
    )


# --- SQL -------------------------------------------------------------------------------------


def quoted(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


FORM_SQL = "CASE p_type WHEN 'ECONOMY' THEN 'Tablet' WHEN 'SMALL' THEN 'Capsule' WHEN 'LARGE' THEN 'Syrup' WHEN 'STANDARD' THEN 'Injection' ELSE 'Drops' END"
PART_NAME_SQL = f"p_name || ' ' || p_brand || ' ' || p_size || 'mg ' || {FORM_SQL}"


def tokens_sql(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '\d+(?:\.\d+)?|[a-z]+')"


def name_tokens_sql(text: str) -> str:
    t = tokens_sql(text)
    return rf"""list_filter({t}, lambda x, i: NOT CASE WHEN list_contains({quoted(N.UNIT_LETTERS)}, x)
      THEN i > 1 AND coalesce(regexp_matches({t}[i - 1], '^\d') OR list_contains({quoted(N.NOISE_WORDS)}, {t}[i - 1])
        OR list_contains({quoted(N.UNIT_LETTERS)}, {t}[i - 1]), false)
      ELSE list_contains({quoted(N.NOISE_WORDS)}, x) END)"""


def is_form_sql(x: str) -> str:
    return f"list_contains({quoted(N.FORM_WORDS)}, {x})"


def sound_sql(w: str) -> str:
    out = w
    for old, new in N.SOUND_PAIRS:
        out = f"replace({out}, '{old}', '{new}')"
    out = rf"translate(regexp_replace({out}, 'c([eiy])', 's\1', 'g'), 'cqzwx', 'kksv#')"
    out = f"substring({out}, 1, 1) || regexp_replace(substring({out}, 2), '[aeiouyh]', '', 'g')"
    for unit in "bdfgjklmnprstv#":
        out = f"regexp_replace({out}, '{unit}+', '{unit}', 'g')"
    return f"replace({out}, '#', 'ks')"


def phrase_sql(nt: str) -> str:
    stop = rf"list_filter({nt}, lambda x, i: regexp_matches(x, '^\d') OR {is_form_sql('x')})"
    return f"array_to_string(list_slice({nt}, 1, least(3, coalesce(list_position({nt}, {stop}[1]) - 1, len({nt})))), '')"


def features_sql(name: str, source: str, key: str, text: str) -> str:
    """(key, feature) rows of a table's names."""
    return rf"""
{name}_t AS (SELECT {key}, {name_tokens_sql(text)} AS nt FROM {source}),
{name}_p AS (SELECT {key}, {phrase_sql('nt')} AS run FROM {name}_t),
{name}_w AS (SELECT DISTINCT {key}, t FROM (SELECT {key}, unnest(nt) AS t FROM {name}_t)),
{name} AS (SELECT DISTINCT * FROM (
  SELECT {key}, 'n:' || (t::DOUBLE)::VARCHAR AS feature FROM {name}_w WHERE regexp_matches(t, '^\d')
  UNION ALL SELECT {key}, 'w:' || t FROM {name}_w WHERE NOT regexp_matches(t, '^\d')
  UNION ALL SELECT {key}, 'g:' || substring('^' || t || '$', i::BIGINT, 3) FROM (SELECT *, unnest(range(1, length(t) + 1)) AS i FROM {name}_w
    WHERE NOT regexp_matches(t, '^\d') AND NOT {is_form_sql('t')})
  UNION ALL SELECT {key}, 'p:' || {sound_sql('t')} FROM {name}_w WHERE NOT regexp_matches(t, '^\d') AND NOT {is_form_sql('t')}
    AND length({sound_sql('t')}) >= 2
  UNION ALL SELECT {key}, 'c:' || substring(run, i::BIGINT, 3) FROM (SELECT *, unnest(range(1, length(run) - 1)) AS i FROM {name}_p WHERE length(run) >= 3)
  UNION ALL SELECT {key}, 'pc:' || {sound_sql('run')} FROM {name}_p WHERE length(run) >= 3))"""


def spaced_sql(s: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({s}, '(\d)([A-Za-z%])', '\1 \2', 'g'), '\s+', ' ', 'g'))"


def strengths_sql(s: str) -> str:
    pat = N.STRENGTH.replace("'", "''")
    return rf"""nullif(array_to_string(list_transform(list_zip(regexp_extract_all({s}, '{pat}', 1), regexp_extract_all({s}, '{pat}', 2)),
      lambda z: {spaced_sql('z[1]')} || CASE WHEN coalesce(z[2], '') <> '' THEN '/' || {spaced_sql('z[2]')} ELSE '' END), ' + '), '')"""


def unit_sql(s: str) -> str:
    cases = " ".join(rf"WHEN regexp_matches(lower({s}), '{p}') THEN '{u}'" for u, p in N.UNITS)
    return f"CASE {cases} END"


BRANDED = f"""
branded_raw AS (SELECT p_partkey AS k, {PART_NAME_SQL} AS name, p_partkey % 4 = 0 AS discontinued,
    'strip of 10 ' || lower({FORM_SQL}) || 's' AS pack, p_brand AS manufacturer, p_name AS n1,
    CASE WHEN p_partkey % 5 <> 0 THEN p_size || ' mg' END AS s1, p_partkey % 2 = 0 AS two, lower(p_type) AS n2
  FROM part WHERE p_partkey % 3 = 2),
branded AS (SELECT 'branded:' || k AS id, name, 'branded' AS source,
    n1 || coalesce(' ' || s1, '') || CASE WHEN two THEN ' + ' || n2 || ' 5 ml' ELSE '' END AS composition,
    CASE WHEN s1 IS NOT NULL THEN s1 || CASE WHEN two THEN ' + 5 ml' ELSE '' END END AS strength,
    {unit_sql("name || ' ' || pack")} AS unit, pack, manufacturer, discontinued, 2 AS source_order, k AS position FROM branded_raw)"""
GENERIC = f"""
generic_raw AS (SELECT p_partkey AS k, p_name || ' ' || p_size || 'mg and 5 g/10ml ' || {FORM_SQL} AS name FROM part
  WHERE p_partkey % 3 = 1 AND p_partkey % 10 <> 0),
generic AS (SELECT 'generic:' || k AS id, name, 'generic' AS source, name AS composition, {strengths_sql('name')} AS strength,
    {unit_sql("name || ' 10''s'")} AS unit, '10''s' AS pack, NULL AS manufacturer, false AS discontinued,
    1 AS source_order, k AS position FROM generic_raw)"""
LINES = """
lines AS (SELECT * FROM (SELECT p_brand AS doc_id, p_partkey * 10 + i AS line_no,
    CASE i WHEN 0 THEN '1.2.' || p_partkey || ' - ' || p_name WHEN 1 THEN p_brand || ' (A)' WHEN 2 THEN 'P, S'
      WHEN 3 THEN 'Tablet ' || p_size || 'mg' WHEN 4 THEN 'in strip of ' || (p_partkey % 10)
      WHEN 5 THEN CASE WHEN p_partkey % 2 = 0 THEN 'Syrup ' || p_size || 'mg/5ml' ELSE 'As licensed' END
      WHEN 6 THEN CASE WHEN p_partkey % 7 = 0 THEN '* note' ELSE 'S' END
      WHEN 7 THEN CASE WHEN p_partkey % 5 = 0 THEN 'Medicine level' END END AS line
  FROM part, range(8) t(i) WHERE p_partkey % 3 = 0) WHERE line IS NOT NULL)"""
ENTRIES = r"""
marked AS (SELECT *, regexp_matches(line, '^\d+(\.\d+){1,4}\b') AS starts,
    regexp_matches(line, '^\d+(\.\d+){1,4}\b') OR line LIKE '*%' OR regexp_matches(line, '(?i)^(medicine|level of|healthcare|dosage form|section\b)') AS resets,
    regexp_matches(line, '^[PST](\s*,\s*[PST])*$') AS level FROM lines),
placed AS (SELECT *, last_value(CASE WHEN resets THEN line_no END IGNORE NULLS) OVER w AS entry_at,
    last_value(CASE WHEN level AND NOT resets THEN line_no END IGNORE NULLS) OVER w AS level_at FROM marked
  WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
inside AS (SELECT p.*, s.line AS start_line, p.level_at > p.entry_at AS in_forms FROM placed p JOIN marked s ON s.doc_id = p.doc_id AND s.line_no = p.entry_at AND s.starts),
kinds AS (SELECT *, CASE WHEN line_no = entry_at THEN 'start' WHEN level THEN 'level' WHEN in_forms THEN 'form' ELSE 'name' END AS kind FROM inside),
named AS (SELECT doc_id, entry_at, regexp_extract(any_value(start_line), '^(\d+(?:\.\d+){1,4})', 1) AS number,
    trim(regexp_replace(regexp_replace(string_agg(CASE WHEN kind = 'start' THEN regexp_replace(line, '^\d+(\.\d+){1,4}[\s–-]*', '') ELSE line END, ' ' ORDER BY line_no), '\*+', '', 'g'), '\s*\([AB]\)', '', 'g')) AS name
  FROM kinds WHERE kind IN ('start', 'name') GROUP BY 1, 2
  HAVING (doc_id, entry_at) IN (SELECT (doc_id, entry_at) FROM kinds WHERE kind = 'level' OR in_forms)),
opened AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\p{Lu}') OR seen = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, entry_at ORDER BY line_no) AS form_no
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, entry_at ORDER BY line_no) - 1 AS seen FROM kinds WHERE kind = 'form')),
forms AS (SELECT doc_id, entry_at, form_no, string_agg(line, ' ' ORDER BY line_no) AS form FROM opened GROUP BY 1, 2, 3)"""
ESSENTIAL = f"""
essential AS (SELECT 'essential:' || number AS id, name, 'essential' AS source, name AS composition, NULL AS strength, NULL AS unit,
    NULL AS pack, NULL AS manufacturer, false AS discontinued, 0 AS source_order, entry_at * 1000 AS position FROM named
  UNION ALL SELECT 'essential:' || number || ':' || form_no, name || ' ' || form, 'essential', name, {strengths_sql('form')},
    {unit_sql('form')}, form, NULL, false, 0, entry_at * 1000 + form_no FROM named JOIN forms USING (doc_id, entry_at)
    WHERE {unit_sql('form')} IS NOT NULL OR regexp_matches(form, '\\d'))"""
PRODUCTS = f"{LINES},{ENTRIES},{ESSENTIAL},{GENERIC},{BRANDED}, products AS (SELECT * FROM essential UNION ALL SELECT * FROM generic UNION ALL SELECT * FROM branded)"
MERGED = """
ordered AS (SELECT *, lower(name) AS name_key, row_number() OVER (PARTITION BY lower(name) ORDER BY source_order, position, id) AS n FROM products),
merged AS (SELECT name_key, max(CASE WHEN n = 1 THEN id END) AS id, max(CASE WHEN n = 1 THEN name END) AS name,
    max(CASE WHEN n = 1 THEN source END) AS source, max(CASE WHEN n = 1 THEN composition END) AS composition,
    CASE WHEN count(strength) = count(*) AND count(DISTINCT strength) = 1 THEN max(strength) END AS strength,
    max(CASE WHEN n = 1 THEN unit END) AS unit, bool_and(discontinued) AS discontinued FROM ordered GROUP BY 1)"""
HEARD = """
heard AS (SELECT s_suppkey AS query_id, substring(p_name, 1, 1) || substring(p_name, 3) || ' ' || p_size AS heard
  FROM supplier JOIN part ON p_partkey = s_suppkey * 2)"""
LISTED = ["id", "name", "source", "composition", "strength", "unit", "pack", "manufacturer", "discontinued"]


@register(
    "product_lists", "S7 S8 S9 S10 H24 H25 U1",
    f"WITH {PRODUCTS} SELECT {', '.join(LISTED)} FROM products",
)
def product_lists(spark: SparkSession, sf: str) -> DataFrame:
    return products(spark, sf).select(*LISTED)


@register(
    "essential_list_entries", "S9",
    f"WITH {LINES},{ENTRIES} SELECT doc_id, entry_at, number, name, form FROM named JOIN forms USING (doc_id, entry_at)",
)
def essential_list_entries(spark: SparkSession, sf: str) -> DataFrame:
    entries = C.list_entries(list_lines(spark, sf))
    return entries.select("doc_id", F.col("at").alias("entry_at"), "number", "name", F.explode("forms").alias("form"))


MERGED_COLUMNS = ["name_key", "id", "name", "source", "composition", "strength", "unit", "discontinued"]


@register("catalogue_merge", "A18 S10", f"WITH {PRODUCTS},{MERGED} SELECT {', '.join(MERGED_COLUMNS)} FROM merged")
def catalogue_merge(spark: SparkSession, sf: str) -> DataFrame:
    return merged(spark, sf).select(*MERGED_COLUMNS)


@register(
    "catalogue_by_source", "A25",
    f"WITH {PRODUCTS},{MERGED} SELECT source, count(*) AS names, count(strength) AS with_strength, count(unit) AS with_unit FROM merged GROUP BY 1",
)
def catalogue_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return merged(spark, sf).groupBy("source").agg(
        F.count(F.lit(1)).alias("names"), F.count("strength").alias("with_strength"),
        F.count("unit").alias("with_unit"),
    )


@register(
    "name_tokens", "H16 H17 H18 H26",
    rf"""SELECT p_partkey, array_to_string(nt, ' ') AS name_tokens,
      array_to_string(list_filter(nt, lambda x: NOT {is_form_sql('x')}), ' ') AS content_tokens, {phrase_sql('nt')} AS phrase
    FROM (SELECT p_partkey, {name_tokens_sql(PART_NAME_SQL)} AS nt FROM part)""",
)
def name_tokens(spark: SparkSession, sf: str) -> DataFrame:
    name = part_name()
    return table(spark, sf, "part").select(
        "p_partkey",
        F.array_join(N.name_tokens(name), " ").alias("name_tokens"),
        F.array_join(N.content_tokens(name), " ").alias("content_tokens"),
        N.brand_phrase(name).alias("phrase"),
    )


@register(
    "sound_keys", "H19 H21",
    f"""SELECT word, {sound_sql('word')} AS sound, levenshtein(word, {sound_sql('word')}) AS edits FROM (SELECT DISTINCT word FROM
      (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents))""",
)
def sound_keys(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "documents").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")
    ).distinct()
    keyed = words.withColumn("sound", N.sound(F.col("word")))
    return keyed.withColumn("edits", F.levenshtein("word", "sound").cast("bigint"))


@register(
    "name_features", "H23 A6",
    f"""WITH {PRODUCTS},{MERGED},{features_sql('f', 'merged', 'id', 'name')}, n AS (SELECT count(*) AS n FROM merged)
    SELECT feature, count(*) AS df, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM f, n GROUP BY 1""",
)
def name_features(spark: SparkSession, sf: str) -> DataFrame:
    names = written(merged(spark, sf), "merged")
    size = names.count()
    rows = names.select("id", F.explode(N.feature_texts(F.col("name"))).alias("feature"))
    counted = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("df"))
    return counted.withColumn("idf", F.round(L.idf(size, F.col("df")), 6))


SEARCHED = f"""{PRODUCTS},{MERGED},{HEARD},{features_sql('f', 'merged', 'id', 'name')},{features_sql('qf', 'heard', 'query_id', 'heard')},
n AS (SELECT count(*) AS n FROM merged),
rare AS (SELECT feature, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM f, n GROUP BY 1),
found AS (SELECT query_id, id, sum(idf) AS score FROM qf JOIN rare USING (feature) JOIN f USING (feature) GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM found QUALIFY rank <= 64)"""


@register(
    "name_search", "J1 M1 T1 A6",
    f"WITH {SEARCHED} SELECT query_id, id, round(score, 6) AS score, rank FROM top",
)
def name_search(spark: SparkSession, sf: str) -> DataFrame:
    index = L.index_names(merged(spark, sf))
    found = L.search_names(index, L.tidy_heard(heard(spark, sf)))
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@register(
    "two_leg_candidates", "J11 M1 F5",
    f"""WITH {SEARCHED},
    {vectors_sql('nv', 'merged', 'id', 'name')},{vectors_sql('qv', 'heard', 'query_id', 'heard')},
    near AS (SELECT query_id, id, round(coalesce(d, 0), 9) AS score FROM (SELECT query_id, id FROM heard, merged)
      LEFT JOIN (SELECT query_id, id, sum(qv.x * nv.x) AS d FROM qv JOIN nv USING (slot) GROUP BY 1, 2) USING (query_id, id)),
    said AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM near QUALIFY rank <= 16),
    legs AS (SELECT query_id, id, 0 AS leg, rank FROM top UNION ALL SELECT query_id, id, 1, rank FROM said
      WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM top))
    SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY leg, rank, id) AS rank FROM legs""",
)
def two_leg_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """An encoder's 16 nearest names are added behind the first leg's."""
    asked = written(L.tidy_heard(heard(spark, sf)), "heard")
    index = L.index_names(merged(spark, sf))
    second = L.encoder_leg(
        spread(index.names.select("id", "name")).select("id", hashed_words(F.col("name")).alias("vec")),
        asked.select("query_id", hashed_words(F.col("heard")).alias("vec")),
    )
    return L.append_leg(L.search_names(index, asked), second).select("query_id", "id", "rank")


@register("name_decisions", "M2 M3 M4 M5 H20 H22 A19 A20 T5 T6 T8")
def name_decisions(spark: SparkSession, sf: str) -> DataFrame:
    asked = written(L.tidy_heard(heard(spark, sf)), "heard")
    index = L.index_names(merged(spark, sf))
    found = written(L.name_candidates(index, asked), "found")
    answers = L.decide(asked, found)
    return answers.withColumn("choices", F.array_join("choices", "; "))


@register("misheard_queries", "M6 H26")
def misheard_queries(spark: SparkSession, sf: str) -> DataFrame:
    return plan.make_queries(merged(spark, sf), per_kind=None)


@register("lookup_evaluation", "M7 M8 A14 A15 A16 U4")
def lookup_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    index = L.index_names(merged(spark, sf))
    asked = written(plan.make_queries(index.names, per_kind=None), "queries")
    return plan.tally(written(plan.run(index, asked), "results"))


def words_sql(name: str, source: str, text: str, word: str) -> str:
    """Distinct content words of a table's names, with their sound."""
    return f"""
{name} AS (SELECT DISTINCT {word}, {sound_sql(word)} AS s{word} FROM (SELECT unnest(list_filter(nt, lambda x: NOT {is_form_sql('x')})) AS {word}
  FROM (SELECT {name_tokens_sql(text)} AS nt FROM {source})))"""


# Matching blocks by recursion: the longest common run of a stretch (the first in a, then in b),
# then what lies before and behind it in both words.
LIKENESS = rf"""
likeness AS (WITH RECURSIVE wp AS (SELECT *, regexp_matches(a, '^\d') AS an, regexp_matches(b, '^\d') AS bn FROM aw JOIN bw ON substring(sa, 1, 1) = substring(sb, 1, 1)),
sure AS (SELECT a, b FROM wp WHERE a = b OR (an AND bn AND try_cast(a AS DOUBLE) = try_cast(b AS DOUBLE))),
rated AS (SELECT * FROM wp WHERE (a, b) NOT IN (SELECT (a, b) FROM sure) AND NOT an AND NOT bn AND least(length(a), length(b)) > 3),
walk AS (
  SELECT a, b, 0::BIGINT AS al, length(a) AS ah, 0::BIGINT AS bl, length(b) AS bh, 0::BIGINT AS k FROM rated
  UNION ALL SELECT a, b, unnest([al, -m.i + m.k]), unnest([-m.i, ah]), unnest([bl, -m.j + m.k]), unnest([-m.j, bh]), unnest([m.k, 0])
  FROM (SELECT *, list_max(flatten(list_transform(range(al, ah), lambda i: list_transform(range(bl, bh), lambda j: {{
      'k': list_max(list_transform(range(0, least(ah - i, bh - j) + 1), lambda n: CASE WHEN substring(a, i + 1, n) = substring(b, j + 1, n) THEN n ELSE 0 END)), 'i': -i, 'j': -j}})))) AS m
    FROM walk WHERE ah > al AND bh > bl) WHERE m.k > 0),
alike AS (SELECT a, b, 2.0 * sum(k) / (length(a) + length(b)) AS alike FROM walk GROUP BY a, b)
  SELECT a, b, 1.0::DOUBLE AS alike, true AS near, true AS near_spelt FROM sure
  UNION ALL SELECT a, b, alike, levenshtein(a, b) <= 1 OR (sa = sb AND alike >= 0.6), levenshtein(a, b) <= 1 FROM alike JOIN rated USING (a, b) WHERE alike > 0)"""


@register(
    "word_likeness", "H20 H22",
    f"""WITH {PRODUCTS},{MERGED},{HEARD},{words_sql('aw', 'heard', 'heard', 'a')},{words_sql('bw', 'merged', 'name', 'b')},{LIKENESS}
    SELECT a, b, round(alike, 6) AS alike, near, near_spelt FROM likeness""",
)
def word_likeness(spark: SparkSession, sf: str) -> DataFrame:
    """Likeness of every heard word and every catalogue word that share a first sound."""
    asked = heard(spark, sf).select(F.explode(N.content_tokens(F.col("heard"))).alias("a")).distinct()
    have = merged(spark, sf).select(F.explode(N.content_tokens(F.col("name"))).alias("b")).distinct()
    first = lambda c: F.substring(N.sound(F.col(c)), 1, 1)
    pairs = asked.withColumn("_s", first("a")).join(have.withColumn("_s", first("b")), "_s").drop("_s")
    return L.score_pairs(pairs).withColumn("alike", F.round("alike", 6))


# --- outcome tables over events as results ---------------------------------------------------


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Events as lookup results: type and value decide kind, rank and outcome."""
    e = table(spark, sf, "events")
    kinds = {"view": "said", "click": "one_edit", "purchase": "by_ear", "signup": "split"}
    kind = F.lit("by_ear")
    for event, name in kinds.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
    outcome = F.element_at(
        F.array(*[F.lit(o) for o in plan.OUTCOMES]), (F.col("event_id") % 6 + 1).cast("int")
    )
    return e.select(
        kind.alias("kind"),
        F.when(F.col("user_id") % 9 > 0, F.col("user_id") % 80 + 1).alias("rank"),
        outcome.alias("outcome"),
        F.when(F.col("event_id") % 4 == 0, "exact").otherwise("close").alias("status"),
        F.concat(F.lit("user"), F.col("user_id")).alias("meant"),
        F.concat(
            F.when(F.col("event_id") % 5 == 0, "x").otherwise("u"), F.lit("ser"), F.col("event_id") % 1000
        ).alias("heard"),
    )


RESULTS = """results AS (SELECT CASE event_type WHEN 'view' THEN 'said' WHEN 'click' THEN 'one_edit' WHEN 'signup' THEN 'split' ELSE 'by_ear' END AS kind,
  CASE WHEN user_id % 9 > 0 THEN user_id % 80 + 1 END AS rank,
  ['named', 'offered', 'as_said', 'beyond_listed', 'not_found', 'wrong'][event_id % 6 + 1] AS outcome,
  CASE WHEN event_id % 4 = 0 THEN 'exact' ELSE 'close' END AS status, 'user' || user_id AS meant,
  CASE WHEN event_id % 5 = 0 THEN 'x' ELSE 'u' END || 'ser' || (event_id % 1000) AS heard FROM events)"""
COUNTS = "count(*) AS queries, " + ", ".join(
    [f"count(*) FILTER (rank <= {k}) AS within_{k}" for k in plan.CUTOFFS]
    + [f"count(*) FILTER (outcome = '{o}') AS {o}" for o in plan.OUTCOMES]
)


@register(
    "outcome_tally", "A14 A15 A16 U4",
    f"""WITH {RESULTS}, t AS (SELECT CASE WHEN GROUPING(kind) = 0 THEN kind WHEN GROUPING(misheard) = 0 AND misheard THEN 'misheard'
        WHEN GROUPING(misheard) = 1 THEN 'all' END AS scope, {COUNTS} FROM (SELECT *, kind <> 'said' AS misheard FROM results)
      GROUP BY GROUPING SETS ((kind, misheard), (misheard), ())),
    r AS (SELECT *, named + offered AS resolved, (named + offered) / queries AS p FROM t WHERE scope IS NOT NULL)
    SELECT * EXCLUDE (p), round(greatest(0, (p + 3.8416 / (2 * queries) - 1.96 * sqrt(p * (1 - p) / queries + 3.8416 / (4 * queries * queries))) / (1 + 3.8416 / queries)), 6) AS low,
      round(least(1, (p + 3.8416 / (2 * queries) + 1.96 * sqrt(p * (1 - p) / queries + 3.8416 / (4 * queries * queries))) / (1 + 3.8416 / queries)), 6) AS high FROM r""",
)
def outcome_tally(spark: SparkSession, sf: str) -> DataFrame:
    return plan.tally(results(spark, sf))


@register(
    "miss_cuts", "A17 H21",
    f"""WITH {RESULTS}, cuts AS (
      SELECT *, CASE WHEN substring(heard, 1, 1) = substring(meant, 1, 1) THEN 'first letter kept' ELSE 'first letter changed' END AS cut
        FROM results WHERE kind IN ('one_edit', 'by_ear')
      UNION ALL SELECT *, least(levenshtein(meant, heard), 4) || ' letters' FROM results WHERE kind = 'by_ear'
      UNION ALL SELECT *, CASE WHEN status = 'exact' THEN 'wrong, stated' ELSE 'wrong, to confirm' END FROM results WHERE outcome = 'wrong')
    SELECT kind, cut, {COUNTS} FROM cuts GROUP BY 1, 2""",
)
def miss_cuts(spark: SparkSession, sf: str) -> DataFrame:
    return plan.miss_cuts(results(spark, sf))


@register(
    "share_intervals", "A16",
    """SELECT l_returnflag, l_linestatus, hits, total, round(greatest(0, (p + z / (2 * total) - 1.96 * sqrt(p * (1 - p) / total + z / (4.0 * total * total))) / (1 + z / total)), 6) AS low,
      round(least(1, (p + z / (2 * total) + 1.96 * sqrt(p * (1 - p) / total + z / (4.0 * total * total))) / (1 + z / total)), 6) AS high
    FROM (SELECT l_returnflag, l_linestatus, count(*) FILTER (l_quantity > 40) AS hits, count(*) AS total, hits / total AS p, 1.96 * 1.96 AS z FROM lineitem GROUP BY 1, 2)""",
)
def share_intervals(spark: SparkSession, sf: str) -> DataFrame:
    counted = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.when(F.col("l_quantity") > 40, 1)).alias("hits"), F.count(F.lit(1)).alias("total")
    )
    low, high = wilson(F.col("hits"), F.col("total"))
    return counted.withColumn("low", F.round(low, 6)).withColumn("high", F.round(high, 6))


