"""How a product name is broken up, keyed by sound, and read for strengths and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import let, squeeze

# --- fixed values: word lists, unit patterns and sound rules --------------------------------
NAME_TOKEN = r"\d+(?:\.\d+)?|[a-z]+"
WRITTEN_TOKEN = r"\d+(?:\.\d+)?|[A-Za-z]+"
FORM_WORDS = ["tablet", "tablets", "tab", "tabs", "capsule", "capsules", "cap", "caps", "syrup",
              "suspension", "injection", "inj", "cream", "gel", "ointment", "drops", "drop",
              "solution", "lotion", "powder", "sachet", "sachets", "spray", "inhaler", "respules",
              "rotacaps", "infusion", "liquid", "oral", "soap", "shampoo", "granules", "lozenges",
              "patch", "pessary", "suppository", "vial", "ampoule", "injectable", "emulsion",
              "paste", "rinse", "wash", "linctus", "expectorant", "elixir"]
NOISE_WORDS = ["mg", "mcg", "ml", "gm", "kg", "iu", "ip", "bp", "usp", "and", "with", "per", "in",
               "of", "for", "the"]
UNIT_LETTERS = ["g", "s", "w", "v"]
UNITS = [
    ("tablets", r"\btab(let)?s?\b"),
    ("capsules", r"\bcap(sule)?s?\b"),
    ("injections", r"\b(injection|injectable|vial|ampoule|infusion|syringe|penfill|cartridge)s?\b"),
    ("sachets", r"\bsachets?\b"),
    ("ml", r"\b(syrup|suspension|solution|liquid|drops?|linctus|expectorant|elixir)\b"),
]
STRENGTH = (
    r"(?i)(\d+(?:\.\d+)?\s?(?:mcg|mg|gm|g|iu|%)(?:\s?w/[wv])?)"
    r"(?:\s?(?:per|/)\s?(\d+(?:\.\d+)?\s?ml|ml))?"
)
INGREDIENT = r"^(.*?)\s*\(([^()]*)\)\s*$"
SOUND_PAIRS = [("ph", "f"), ("ck", "k"), ("sh", "s"), ("th", "t")]
LEADING_WORDS = 3
# --- end of fixed values ---------------------------------------------------------------------


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def is_number(token: Column) -> Column:
    return token.rlike(r"^\d")


def is_form(token: Column) -> Column:
    return F.array_contains(_words(FORM_WORDS), token)


def _is_noise(tokens: Column, token: Column, i: Column) -> Column:
    before = F.get(tokens, i - 1)
    unit_context = (
        is_number(before)
        | F.array_contains(_words(NOISE_WORDS), before)
        | F.array_contains(_words(UNIT_LETTERS), before)
    )
    # The word before decides for single unit letters; the first word has none before it.
    return F.when(
        F.array_contains(_words(UNIT_LETTERS), token),
        (i > 0) & F.coalesce(unit_context, F.lit(False)),
    ).otherwise(F.array_contains(_words(NOISE_WORDS), token))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(NAME_TOKEN), F.lit(0))


def name_tokens(text: Column) -> Column:
    return let(
        tokens(text), lambda found: F.filter(found, lambda t, i: ~_is_noise(found, t, i))
    )


def content_tokens(text: Column) -> Column:
    return F.filter(name_tokens(text), lambda t: ~is_form(t))


def form_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(tokens(text), is_form))


def content_words(text: Column) -> Column:
    """Structs (lower, written) of each word that says which product it is."""
    written = F.regexp_extract_all(text, F.lit(WRITTEN_TOKEN), F.lit(0))
    paired = F.transform(
        written, lambda w: F.struct(F.lower(w).alias("lower"), w.alias("written"))
    )
    return let(
        paired,
        lambda all_: F.filter(
            all_, lambda p, i: ~is_form(p["lower"]) & ~_is_noise(all_["lower"], p["lower"], i)
        ),
    )


def _before_first(items: Column, stop) -> Column:
    """The items in front of the first one for which ``stop`` holds."""

    def cut(all_: Column) -> Column:
        stops = F.filter(
            F.transform(all_, lambda x, i: F.when(stop(x), i)), lambda i: i.isNotNull()
        )
        return F.slice(all_, F.lit(1), F.coalesce(F.get(stops, F.lit(0)), F.size(all_)))

    return let(items, cut)


def _phrase(found: Column) -> Column:
    lead = _before_first(found, lambda t: is_number(t) | is_form(t))
    return F.array_join(F.slice(lead, 1, LEADING_WORDS), "")


def brand_phrase(text: Column) -> Column:
    """Up to three leading words, before any number or form, run together."""
    return _phrase(name_tokens(text))


def sound(word: Column) -> Column:
    """The first letter and the consonants, spelt one way."""
    out = word
    for old, new in SOUND_PAIRS:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(out, "c(?=[eiy])", "s")
    # x stands for one unit until repeats are collapsed; only then is it written ks.
    out = F.translate(out, "cqzwx", "kksv#")
    out = F.concat(
        F.substring(out, 1, 1), F.regexp_replace(F.substr(out, F.lit(2)), "[aeiouyh]", "")
    )
    return F.replace(F.regexp_replace(out, r"(.)\1+", "$1"), F.lit("#"), F.lit("ks"))


def _trigrams(text: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))),
        lambda i: F.substr(text, i, F.lit(3)),
    )


def feature_texts(name: Column) -> Column:
    """``kind:value`` of every feature: words, numbers, letter groups and sound keys."""

    def of_token(t: Column) -> Column:
        number = F.concat(F.lit("n:"), t.try_cast("double").cast("string"))
        word = F.concat(F.lit("w:"), t)
        groups = F.transform(
            _trigrams(F.concat(F.lit("^"), t, F.lit("$"))), lambda g: F.concat(F.lit("g:"), g)
        )
        keyed = let(
            sound(t),
            lambda key: F.when(F.length(key) >= 2, F.array(F.concat(F.lit("p:"), key))).otherwise(
                F.array().cast("array<string>")
            ),
        )
        return (
            F.when(is_number(t), F.array(number))
            .when(is_form(t), F.array(word))
            .otherwise(F.concat(F.array(word), groups, keyed))
        )


    def of_phrase(run: Column) -> Column:
        return F.when(
            F.length(run) >= 3,
            F.concat(
                F.transform(_trigrams(run), lambda g: F.concat(F.lit("c:"), g)),
                F.array(F.concat(F.lit("pc:"), sound(run))),
            ),
        ).otherwise(F.array().cast("array<string>"))

    return let(
        name_tokens(name),
        lambda found: F.array_distinct(
            F.concat(
                F.flatten(F.transform(found, of_token)), let(_phrase(found), of_phrase)
            )
        ),
    )


def _hashed(texts: Column) -> Column:
    return F.array_distinct(F.transform(texts, lambda f: F.crc32(f.cast("binary"))))


def features(name: Column) -> Column:
    """The features as 32-bit hashes."""
    return _hashed(feature_texts(name))


def split_features(name: Column) -> Column:
    """A struct of the same hashes in two sorted parts: ``words``, and what ``numbers`` add."""
    return let(
        feature_texts(name),
        lambda texts: let(
            F.array_sort(_hashed(F.filter(texts, lambda f: ~f.startswith("n:")))),
            lambda words: F.struct(
                words.alias("words"),
                F.array_sort(F.array_except(_hashed(texts), words)).alias("numbers"),
            ),
        ),
    )


# --- catalogue fields ------------------------------------------------------------------------


def spaced(strength: Column) -> Column:
    return squeeze(F.regexp_replace(strength, r"(\d)([A-Za-z%])", "$1 $2"))


def unit_for(*texts: Column) -> Column:
    text = F.lower(F.concat_ws(" ", *texts))
    out = F.lit(None).cast("string")
    for unit, pattern in reversed(UNITS):
        out = F.when(text.rlike(pattern), unit).otherwise(out)
    return out


def strengths_in(text: Column) -> Column:
    """Every strength written in a name: "100mg and 325mg" gives "100 mg + 325 mg"."""
    amounts = F.regexp_extract_all(text, F.lit(STRENGTH), F.lit(1))
    volumes = F.regexp_extract_all(text, F.lit(STRENGTH), F.lit(2))
    parts = F.zip_with(
        amounts, volumes,
        lambda a, v: F.concat(
            spaced(a), F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit("/"), spaced(v))).otherwise("")
        ),
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, " + "))


def ingredient(text: Column) -> Column:
    """Struct (name, strength) of "Amoxycillin (500mg)"; null for an empty text."""
    clean = squeeze(F.coalesce(text, F.lit("")))
    inside = spaced(F.regexp_extract(clean, INGREDIENT, 2))
    matched = clean.rlike(INGREDIENT)
    return F.when(
        clean != "",
        F.struct(
            F.when(matched, squeeze(F.regexp_extract(clean, INGREDIENT, 1)))
            .otherwise(clean)
            .alias("name"),
            F.when(matched & (inside != ""), inside).alias("strength"),
        ),
    )


# --- spoken forms ----------------------------------------------------------------------------


def spoken_words(name: Column) -> Column:
    """Up to three leading words a person says for a name."""
    return F.slice(_before_first(content_tokens(name), is_number), 1, LEADING_WORDS)


def spoken_number(name: Column) -> Column:
    """The number said after them: the first one, if at most three words come before it."""

    def number_in(found: Column) -> Column:
        before = F.size(_before_first(found, is_number))
        return let(before, lambda n: F.when(n.between(1, LEADING_WORDS), F.get(found, n)))

    return let(content_tokens(name), number_in)
