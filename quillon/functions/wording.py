"""Small texts and codes: clock times, labels, phone numbers, languages, answers in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import let, squeeze
from quillon.sources.catalogue import SOURCE_NAMES

# --- fixed values: codes, names and patterns -------------------------------------------------
MOBILE = r"^[6-9]\d{9}$"
LANGUAGES = {"en": "English", "hi": "Hindi", "kn": "Kannada", "ta": "Tamil", "te": "Telugu",
             "mr": "Marathi", "bn": "Bengali", "ml": "Malayalam", "gu": "Gujarati"}
CALL_STATUS = {"completed": "answered", "busy": "no_answer", "no-answer": "no_answer",
               "failed": "failed", "canceled": "failed"}
MESSAGE_STATUS = {30001: "sent", 30002: "delivered", 30003: "read"}
DETAIL_CHARS = 200
# --- end of fixed values ---------------------------------------------------------------------


def lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def clock_iso(seconds: Column) -> Column:
    return F.format_string(
        "%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    )


def clock_text(seconds: Column) -> Column:
    """28800 is "8:00 AM"."""
    hour = F.floor(seconds / 3600)
    shown = F.when(hour % 12 == 0, F.lit(12).cast("bigint")).otherwise(hour % 12)
    return F.concat(
        F.format_string("%d:%02d ", shown, F.floor(seconds % 3600 / 60)),
        F.when(hour < 12, "AM").otherwise("PM"),
    )


def first_name(full_name: Column) -> Column:
    first = F.get(F.split(squeeze(F.coalesce(full_name, F.lit(""))), " "), F.lit(0))
    return F.when(F.coalesce(first, F.lit("")) != "", first).otherwise("there")


def medicine_label(name: Column, strength: Column) -> Column:
    known = F.when(F.coalesce(name, F.lit("")) == "", "your medicine").otherwise(name)
    return F.when(
        F.coalesce(strength, F.lit("")) != "", F.concat_ws(" ", known, strength)
    ).otherwise(known)


def joined_labels(labels: Column) -> Column:
    """Distinct labels in order: "a", "a and b", "a, b and c"."""
    return let(
        F.array_sort(F.array_distinct(labels)),
        lambda names: F.when(F.size(names) == 1, F.get(names, F.lit(0))).otherwise(
            F.concat(
                F.array_join(F.slice(names, F.lit(1), F.size(names) - 1), ", "),
                F.lit(" and "),
                F.element_at(names, -1),
            )
        ),
    )


def mobile_number(number: Column) -> Column:
    """A ten-digit mobile number in international form, else null."""
    digits = F.regexp_replace(F.coalesce(number, F.lit("")), r"\D", "")
    last = F.right(digits, F.lit(10))
    return F.when(last.rlike(MOBILE), F.concat(F.lit("+91"), last))


def masked_number(number: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(number, F.lit("")), r"\D", "")
    return F.when(
        F.length(digits) >= 4, F.concat(F.lit("***"), F.right(digits, F.lit(4)))
    ).otherwise("***")


def language_code(value: Column) -> Column:
    """A code ("hi"), a code with a region ("hi-IN") or an English name, to the code."""
    key = F.lower(F.trim(value))
    code = F.get(F.split(key, "-"), F.lit(0))
    by_name = {name.lower(): code_ for code_, name in LANGUAGES.items()}
    return F.coalesce(F.when(code.isin(*LANGUAGES), code), lookup(by_name, key))


def dedupe_key(*parts: Column | str) -> Column:
    return F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def opening_line(service: str, name: Column, label: Column, at: Column, count: Column) -> Column:
    """What a reminder call begins with: who calls, what is due, since when."""
    due = F.when(count > 1, " are due").otherwise(" is due")
    since = F.when(at.isNotNull(), F.concat(F.lit(" since "), clock_text(at))).otherwise("")
    return F.concat(
        F.lit("Good day "), name, F.lit(f". {service} calling: "), label, due, since,
        F.lit(". Is that done already?"),
    )


def match_sentence() -> Column:
    """A lookup answer in words: the finding, then the facts all products it could be share."""
    listed, said = F.array_join("choices", " / "), F.concat(F.lit("<"), "heard", F.lit(">"))
    name = F.concat(F.lit("<"), "name", F.lit(">"))
    count, status = F.size("choices"), F.col("status")
    fact = {
        "ingredients": F.when(F.col("composition") != F.col("name"), F.col("composition")),
        "strength": F.when(F.col("strength") != "", F.col("strength")),
        "form": F.when(F.col("unit") != "", F.col("unit")),
        "list": lookup(SOURCE_NAMES, F.col("source")),
    }
    facts = F.concat_ws(", ", *(F.concat(F.lit(f"{k} = "), v) for k, v in fact.items()))
    others = F.when(count > 0, F.concat(F.lit("; others near it: "), listed)).otherwise("")
    finding = (
        F.when(status == "exact", F.concat(F.lit("Found "), name))
        .when(
            status == "several",
            F.when(count > 1, F.concat(name, F.lit(" stands for: "), listed)).otherwise(
                F.concat(name, F.lit(" as such isn't in the list, only "), listed)
            ),
        )
        .when(
            status == "close",
            F.concat(said, F.lit(" isn't in the list, it may be "), name, others),
        )
        .otherwise(F.concat(F.lit("Nothing like "), said, F.lit(" in the list"), others))
    )
    known = status.isin("exact", "several") & (facts != "")
    return F.concat(finding, F.when(known, F.concat(F.lit(" ("), facts, F.lit(")"))).otherwise(""), F.lit("."))


def passage_source() -> Column:
    """Where a passage is from: section and page first, then the document, then for whom."""
    path = F.array_join("heading_path", ", ")
    year = F.substring("publication_date", 1, 4)
    issued = F.concat_ws(" ", "publisher", year)
    place = F.concat_ws(" ", F.when(path != "", path), F.concat(F.lit("p."), F.col("page_number")))
    return F.concat(
        place,
        F.lit(" in "),
        F.col("document_title"),
        F.when(issued != "", F.concat(F.lit(", "), issued)).otherwise(""),
        F.when(F.col("population") != "all", F.concat(F.lit("; readers: "), F.col("population"))).otherwise(""),
    )


def passage_block() -> Column:
    """One passage as a numbered paragraph of an answer: its source, then its text."""
    return F.concat(
        F.lit("["), F.col("rank"), F.lit("] "), passage_source(), F.lit("\n"), F.trim("text")
    )


def described_passages(
    passages: DataFrame, queries: DataFrame, keys: str = "query_id", width: int = 20
) -> DataFrame:
    """``(query_id, found, description)``: the blocks of a query's best passages in rank order.

    ``passages`` has at most ``width`` rows a query (rank 1 to ``width``; others are not shown);
    ``queries(query_id, population)`` names for whom was searched. A query without passages says
    so, and a search that was held to a population says which.
    """
    blocks = (
        passages.where(F.col("rank") <= width)
        .select(keys, "rank", passage_block().alias("block"))
        .groupBy(keys)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("blocks"))
    )
    held = F.when(
        F.col("population").isNotNull() & (F.col("population") != "all"),
        F.concat(F.lit("Searched for readers: "), F.col("population"), F.lit(".\n")),
    ).otherwise("")
    body = F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n")
    return queries.join(blocks, keys, "left").select(
        keys,
        F.coalesce(F.size("blocks"), F.lit(0)).alias("found"),
        F.concat(held, F.coalesce(body, F.lit("No passage answers this."))).alias("description"),
    )
