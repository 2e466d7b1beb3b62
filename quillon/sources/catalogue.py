"""Three kinds of product list read into one catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.names import ingredient, strengths_in, unit_for
from quillon.functions.text import squeeze
from quillon.scale import block_scan
from quillon.session import written

CATALOGUE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("composition", T.StringType()),
        T.StructField("strength", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("pack", T.StringType()),
        T.StructField("manufacturer", T.StringType()),
        T.StructField("discontinued", T.BooleanType()),
        T.StructField("source_order", T.IntegerType()),
        T.StructField("position", T.LongType()),
    ]
)
BRANDED_CSV = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in (
            "id", "name", "price", "Is_discontinued", "manufacturer_name", "type",
            "pack_size_label", "short_composition1", "short_composition2",
        )
    ]
)
# --- fixed values: source priority and the marks of the line list ----------------------------
SOURCE_ORDER = {"essential": 0, "generic": 1, "branded": 2}
SOURCE_NAMES = {
    "essential": "Essential list",
    "generic": "Generic product list",
    "branded": "Branded product list",
}
LIST_NUMBER = r"(?U)^(\d+(?:\.\d+){1,4})\b[\s\-–]*(.*)$"
LIST_LEVEL = r"(?U)^[PST](\s*,\s*[PST])*$"
LIST_HEADER = r"(?iU)^(medicine|level of|healthcare|dosage form|section\b)"
# --- end of fixed values ---------------------------------------------------------------------


def _shaped(df: DataFrame) -> DataFrame:
    for field in CATALOGUE.fields:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(None))
    df = df.withColumn("discontinued", F.coalesce(F.col("discontinued").cast("boolean"), F.lit(False)))
    return df.select(*[F.col(f.name).cast(f.dataType) for f in CATALOGUE.fields])


def read_branded_csv(spark: SparkSession, path: str) -> DataFrame:
    """The branded list as it is published: a header, quoted cells, damaged rows tolerated."""
    raw = (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("multiLine", False)
        .schema(BRANDED_CSV)
        .csv(path)
    )
    return branded(raw)


def _or_null(text):
    clean = squeeze(F.coalesce(text, F.lit("")))
    return F.when(clean != "", clean)


def branded(rows: DataFrame) -> DataFrame:
    """Branded rows with up to two ingredients; the strength only if every part states one."""
    both = F.filter(
        F.array(ingredient(F.col("short_composition1")), ingredient(F.col("short_composition2"))),
        lambda p: p.isNotNull(),
    )
    out = rows.withColumn("_parts", both).withColumn("name", squeeze(F.coalesce("name", F.lit(""))))
    out = out.where("name != ''")
    shown = F.array_join(F.transform("_parts", lambda p: F.concat_ws(" ", p["name"], p["strength"])), " + ")
    every = (F.size("_parts") > 0) & F.forall("_parts", lambda p: p["strength"].isNotNull())
    pack = _or_null(F.col("pack_size_label"))
    return _shaped(
        out.select(
            F.concat(F.lit("branded:"), squeeze(F.col("id"))).alias("id"),
            "name",
            F.lit("branded").alias("source"),
            F.when(F.size("_parts") > 0, shown).alias("composition"),
            F.when(every, F.array_join(F.transform("_parts", lambda p: p["strength"]), " + ")).alias("strength"),
            unit_for(F.col("name"), pack).alias("unit"),
            pack.alias("pack"),
            _or_null(F.col("manufacturer_name")).alias("manufacturer"),
            (F.upper(squeeze(F.coalesce("Is_discontinued", F.lit("")))) == "TRUE").alias("discontinued"),
            F.lit(SOURCE_ORDER["branded"]).alias("source_order"),
            squeeze(F.col("id")).try_cast("bigint").alias("position"),
        )
    )


def generic(rows: DataFrame) -> DataFrame:
    """Table rows (serial, code, name, pack); anything else in the table is not a product."""
    cell = [F.get("cells", F.lit(i)) for i in range(4)]
    good = rows.where(
        (F.size("cells") >= 4) & cell[0].rlike(r"^\d+$") & cell[1].rlike(r"^\d+$")
    )
    return _shaped(
        good.select(
            F.concat(F.lit("generic:"), cell[1]).alias("id"),
            cell[2].alias("name"),
            F.lit("generic").alias("source"),
            cell[2].alias("composition"),
            strengths_in(cell[2]).alias("strength"),
            unit_for(cell[2], cell[3]).alias("unit"),
            cell[3].alias("pack"),
            F.lit(SOURCE_ORDER["generic"]).alias("source_order"),
            cell[0].try_cast("bigint").alias("position"),
        )
    )


def list_entries(lines: DataFrame, block_lines: int = 4096) -> DataFrame:
    """``lines(doc_id, line_no, line)`` to ``(doc_id, at, number, name, forms)``.

    A numbered line starts an entry, its name follows, then a level line, then its forms; a
    lower-case line continues the form before it. A header or starred line ends the entry.
    Where each line belongs comes from running values along the lines of a document.
    """
    clean = lines.select("doc_id", "line_no", squeeze(F.col("line")).alias("line"))
    clean = clean.where((F.col("line") != "") & ~F.col("line").rlike(r"^\d+$"))
    starts = F.col("line").rlike(LIST_NUMBER)
    ends = starts | F.startswith("line", F.lit("*")) | F.col("line").rlike(LIST_HEADER)
    level = F.col("line").rlike(LIST_LEVEL)
    block = F.floor(F.col("line_no") / block_lines)
    reset = F.when(
        ends,
        F.struct(
            F.col("line_no").alias("at"),
            F.when(starts, F.regexp_extract("line", LIST_NUMBER, 1)).alias("number"),
        ),
    )
    placed = block_scan(
        clean, ["doc_id"], block, ["line_no"],
        entry=("fill", reset), level_at=("fill", F.when(level & ~ends, F.col("line_no"))),
    ).where("entry.number is not null")
    in_forms = F.coalesce(F.col("level_at") > F.col("entry.at"), F.lit(False))
    own = F.col("line_no") == F.col("entry.at")
    kind = (
        F.when(own, "start").when(level, "level").when(in_forms, "form").otherwise("name")
    )
    placed = written(
        placed.select(
            "doc_id", "line_no", "entry.at", "entry.number", kind.alias("kind"),
            F.when(own, F.regexp_extract("line", LIST_NUMBER, 2)).otherwise(F.col("line")).alias("line"),
            in_forms.alias("in_forms"),
        ),
        "entries",
    )
    is_form = F.col("kind") == "form"
    seen = block_scan(
        placed, ["doc_id"], block, ["line_no"],
        form_before=("before", F.when(is_form, F.col("line_no"))),
    )
    opens = is_form & (
        F.col("line").rlike(r"^\p{Lu}")
        | (F.coalesce(F.col("form_before"), F.lit(-1)) < F.col("at"))
    )
    formed = block_scan(
        seen, ["doc_id"], block, ["line_no"],
        form_at=("fill", F.when(opens, F.col("line_no"))),
    )

    def joined(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), " "
            ).alias(name)
        )

    names = joined(
        formed.where("kind in ('start', 'name') and line != ''"), ["doc_id", "at", "number"], "name"
    )
    forms = joined(formed.where("kind = 'form'"), ["doc_id", "at", "form_at"], "form")
    forms = forms.groupBy("doc_id", "at").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("form_at", "form"))), lambda s: s["form"]).alias("forms")
    )
    finished = formed.where("in_forms or kind = 'level'").select("doc_id", "at").distinct()
    name = F.regexp_replace(squeeze(F.regexp_replace("name", r"\*+", "")), r"(?U)\s*\([AB]\)", "")
    return (
        names.join(finished, ["doc_id", "at"], "left_semi")
        .join(forms, ["doc_id", "at"], "left")
        .select("doc_id", "at", "number", squeeze(name).alias("name"), "forms")
    )


def essential(entries: DataFrame) -> DataFrame:
    """One product for the entry itself and one for each form somebody would name."""
    named = entries.where(F.col("name").rlike("[A-Za-z]{3}"))
    with_forms = named.withColumn(
        "_f",
        F.explode(
            F.concat(
                F.array(F.struct(F.lit(0).alias("i"), F.lit(None).cast("string").alias("form"))),
                F.coalesce(
                    F.transform("forms", lambda f, i: F.struct((i + 1).alias("i"), f.alias("form"))),
                    F.array().cast("array<struct<i:int,form:string>>"),
                ),
            )
        ),
    )
    form, i = F.col("_f.form"), F.col("_f.i")
    kept = with_forms.where((i == 0) | unit_for(form).isNotNull() | form.rlike(r"\d"))
    return _shaped(
        kept.select(
            F.when(i == 0, F.concat(F.lit("essential:"), "number"))
            .otherwise(F.concat_ws(":", F.lit("essential"), "number", i.cast("string")))
            .alias("id"),
            F.concat_ws(" ", "name", form).alias("name"),
            F.lit("essential").alias("source"),
            F.col("name").alias("composition"),
            F.when(i > 0, strengths_in(form)).alias("strength"),
            F.when(i > 0, unit_for(form)).alias("unit"),
            form.alias("pack"),
            F.lit(SOURCE_ORDER["essential"]).alias("source_order"),
            (F.col("at") * 1000 + i).alias("position"),
        )
    )


def load(*sources: DataFrame | None) -> DataFrame:
    """All sources in priority order; a missing one is left out."""
    present = [s for s in sources if s is not None]
    if not present:
        raise ValueError("no catalogue source is present")
    return reduce(DataFrame.unionByName, present)


def merge(products: DataFrame) -> DataFrame:
    """One product for each name, whatever its case: the first by source, then position.

    The strength goes if any other of that name differs; discontinued only if all are.
    """
    order = F.struct("source_order", "position", "id")
    first = F.min_by(F.struct(*[c for c in products.columns]), order)
    same = (
        (F.count("strength") == F.count(F.lit(1))) & (F.min("strength") == F.max("strength"))
    )
    merged = products.groupBy(F.lower("name").alias("name_key")).agg(
        first.alias("m"), same.alias("same"), F.every("discontinued").alias("gone")
    )
    kept = [f.name for f in CATALOGUE.fields if f.name not in ("strength", "discontinued")]
    return merged.select(
        "name_key",
        *[F.col(f"m.{c}") for c in kept],
        F.when(F.coalesce("same", F.lit(False)), F.col("m.strength")).alias("strength"),
        F.col("gone").alias("discontinued"),
    )
