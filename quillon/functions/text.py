"""Cleaning, heading tests, sentence units: all plain column expressions.

Patterns are Java regular expressions; ``(?U)`` makes word characters and spaces Unicode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: they decide the result and are stated as they are -----------------------
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl",
             " ": " ", "­": ""}
PICTURE = r"(?s)\*\*==>.*?<==\*\*"
CITATION = r"(?U)\s*_(?:\[\d+(?:\s*[,–-]\s*\d+)*\]|\(\d+(?:\s*[,–-]\s*\d+)*\))_"
SUPERSCRIPT_REF = r"(?U)(?<!\bm)(?<!\bcm)<sup>\s*[\d,\s*†‡a-z]{1,6}\s*</sup>"
INLINE_TAG = r"(?i)</?(?:sup|sub|mark|b|i|u|em|strong)>"
HTML_BREAK = r"<br\s*/?>"
BOLD = r"(?s)\*\*(.+?)\*\*"
ITALIC = r"(?sU)(?<![\w*])_(?!_)(.+?)(?<!_)_(?!\w)"
SPLIT_LIGATURE = r"(?U)(\w)(ffi|ffl|fi|fl|ff) (?=[a-z])"
LEADING_SPLIT_LIGATURE = r"(?<![A-Za-z])(fi|fl|ff) (?=[a-z]{2,})"
HYPHEN_BREAK = r"(?U)(\w)- (?=[a-z])"
LINE_EDGES = r"(?mU)^\s+|\s+$"
GLYPH_BULLET = r"(?m)^((?:[-*•■]\s+)?)u\s+(?=[A-Z])"
BULLET_PREFIX = r"(?U)^\s*(?:[-*•●■▪◦‣–]|\d+[.)])\s+"
BULLET = r"(?U)^\s*[-*•●■▪◦‣]"
HEADING_MARK = r"(?U)^#{1,6}\s*"
DROP_CAP = r"(?U)^((?:\d+(?:\.\d+)*\s+)?)([B-HJ-Z]) (?=[a-z]{3,})"
SENTENCE_END = r"(?U)(?<=[.!?;])\s+(?=[A-Z0-9(\"'•-])"
PAGE_NUMBER = r"(?iU)^(?:page\s+)?\d{1,4}(?:\s+of\s+\d{1,4})?$"
CODE_LIKE = r"(?U)^[A-Za-z]{1,4}(?:\s?\d+)?$"
MAX_HEADING_CHARS = 100
SMALL_WORDS = ["a", "an", "and", "and/or", "as", "at", "by", "for", "in", "of", "on", "or", "the",
               "to", "with"]
ACRONYMS = ["HIV", "AIDS", "TB", "COPD", "ART", "ARV", "ITN", "ITNS", "IRS", "SMC", "PMC", "MDA",
            "CVC", "CVCS", "BSI", "BSIS", "ORS", "IMCI", "MNS", "PTSD", "ADHD", "ECG", "BP", "IV",
            "IM", "WHO", "STI", "STIS", "UTI", "ENT", "CPR", "HPV", "BCG", "DTP", "MMR", "IPTP",
            "PDMC", "ACT", "ACTS", "RDT", "RDTS", "G6PD", "APC", "TIA", "NCD", "NCDS", "DKA", "ECP",
            "MSE", "MC", "GDG", "GPS", "CLABSI", "MMIS", "ICU", "HAI", "HAIS"]
# --- end of fixed values ---------------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value worked out once, where an expression needs it more than once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(text: Column) -> Column:
    """Whitespace runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _where_marked(text: Column, mark: str, pattern: str, into: str) -> Column:
    def replaced(t: Column) -> Column:
        return F.when(F.contains(t, F.lit(mark)), F.regexp_replace(t, pattern, into)).otherwise(t)

    return let(text, replaced)


def normalise(text: Column) -> Column:
    """Inline markup and extraction artefacts removed; the lines stay. Order matters."""
    out = text
    for old, new in LIGATURES.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    # A pattern is only tried on texts that hold what it cannot match without.
    for mark, pattern, into in (
        ("**==>", PICTURE, ""),
        ("_", CITATION, ""),
        ("<sup>", SUPERSCRIPT_REF, ""),
        ("<", INLINE_TAG, ""),
        ("<br", HTML_BREAK, " "),
        ("**", BOLD, "$1"),
        ("_", ITALIC, "$1"),
        ("f", SPLIT_LIGATURE, "$1$2"),
        ("f", LEADING_SPLIT_LIGATURE, "$1"),
        ("- ", HYPHEN_BREAK, "$1"),
    ):
        out = _where_marked(out, mark, pattern, into)
    for pattern, into in (
        (r"\r\n?", "\n"),
        (r"[ \t]+", " "),
        (LINE_EDGES, ""),
        (r"\n{2,}", "\n"),
        (r"^\n|\n$", ""),
        (GLYPH_BULLET, "$1"),
    ):
        out = F.regexp_replace(out, pattern, into)
    return out


def clean_paragraph(text: Column) -> Column:
    return squeeze(normalise(text))


def clean_list_item(text: Column) -> Column:
    return F.concat(F.lit("- "), F.regexp_replace(clean_paragraph(text), BULLET_PREFIX, ""))


def clean_heading(text: Column) -> Column:
    bare = clean_paragraph(F.regexp_replace(text, HEADING_MARK, ""))
    return F.regexp_replace(F.btrim(bare, F.lit(" .:")), DROP_CAP, "$1$2")


def clean_table(text: Column) -> Column:
    """Rows that hold nothing but cell borders are dropped."""
    return F.array_join(
        F.filter(F.split(normalise(text), "\n"), lambda row: F.btrim(row, F.lit("| ")) != ""), "\n"
    )


def starts_with_bullet(text: Column) -> Column:
    return F.regexp_replace(text, HEADING_MARK, "").rlike(BULLET)


def letters_of(text: Column) -> Column:
    return F.regexp_replace(text, r"\P{L}", "")


def _all_upper(letters: Column) -> Column:
    return ~letters.rlike(r"\P{Lu}")


def is_all_caps(text: Column) -> Column:
    return let(letters_of(text), lambda found: (F.length(found) >= 3) & _all_upper(found))


def is_code_like(text: Column) -> Column:
    return text.rlike(CODE_LIKE)


def is_heading(text: Column) -> Column:
    """3 to 100 characters, less than 30% digits, at least one letter."""
    return let(
        text,
        lambda t: F.length(t).between(3, MAX_HEADING_CHARS)
        & (F.regexp_count(t, F.lit(r"\p{Nd}")) * 10 < F.length(t) * 3)
        & t.rlike(r"\p{L}"),
    )


def leading_caps_name(text: Column) -> Column:
    """A capitalised name in front of a caption: "DEPRESSION Assessment" gives "DEPRESSION"."""

    def in_caps(word: Column) -> Column:
        letters = letters_of(word)
        return (word == "&") | ((letters != "") & _all_upper(letters))

    def name_in(words: Column) -> Column:
        stops = F.filter(
            F.transform(words, lambda w, i: F.when(~in_caps(w), i)), lambda i: i.isNotNull()
        )
        return F.array_join(F.slice(words, F.lit(1), F.get(stops, F.lit(0))), " ")

    name = let(F.split(squeeze(text), " "), name_in)
    return let(name, lambda n: F.when((n != "") & is_all_caps(n), n).otherwise(text))


def capwords(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def display_case(heading: Column) -> Column:
    """An ALL-CAPS heading in title case; acronyms and vowel-less short tokens stay as they are."""
    acronyms = F.array(*[F.lit(a) for a in ACRONYMS])
    small = F.array(*[F.lit(s) for s in SMALL_WORDS])

    def stays(word: Column) -> Column:
        return let(
            F.upper(F.regexp_replace(word, r"^\p{Punct}+|\p{Punct}+$", "")),
            lambda core: F.array_contains(acronyms, core)
            | (F.length(core).between(2, 4) & ~core.rlike("[AEIOU]")),
        )

    def one(word: Column, i: Column) -> Column:
        return (
            F.when((i > 0) & F.array_contains(small, F.lower(word)), F.lower(word))
            .when(stays(word), word)
            .otherwise(capwords(word))
        )

    def shown(text: Column) -> Column:
        in_caps = let(letters_of(text), lambda found: (found != "") & _all_upper(found))
        return F.when(
            in_caps, F.array_join(F.transform(F.split(text, " "), one), " ")
        ).otherwise(text)

    return let(heading, shown)


def word_count(text: Column) -> Column:
    """The default token counter: words. Any Column -> Column counter can take its place."""
    trimmed = squeeze(text)
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " ")))


TokenCounter = Callable[[Column], Column]


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, SENTENCE_END), lambda s: F.trim(s) != "")


def split_units(text: Column) -> Column:
    """Bullet and table lines whole, other lines by sentence."""
    lines = F.filter(F.transform(F.split(text, "\n"), squeeze_ends), lambda line: line != "")
    return F.flatten(
        F.transform(
            lines,
            lambda line: F.when(line.rlike(r"^[-|]"), F.array(line)).otherwise(
                F.filter(
                    F.transform(F.split(line, SENTENCE_END), squeeze_ends), lambda s: s != ""
                )
            ),
        )
    )


def squeeze_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def adjacent_distinct(parts: Column) -> Column:
    """Path parts equal to the part before them (whatever the case) dropped."""
    return F.filter(
        parts,
        lambda part, i: (i == 0)
        | (F.lower(part) != F.lower(F.try_element_at(parts, F.greatest(i, F.lit(1))))),
    )


def common_prefix(a: Column, b: Column) -> Column:
    differs = F.filter(
        F.transform(
            F.arrays_zip(a.alias("a"), b.alias("b")),
            lambda pair, i: F.when(~pair["a"].eqNullSafe(pair["b"]), i),
        ),
        lambda i: i.isNotNull(),
    )
    length = F.coalesce(F.try_element_at(differs, F.lit(1)), F.size(a))
    return F.slice(a, F.lit(1), length)
