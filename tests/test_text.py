"""Cleaning, labels, names: what each rule is for, by example."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import labels as LB
from quillon.functions import names as N
from quillon.functions import text as X
from quillon.functions import wording as W


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("suﬃcient  “rest”", "sufficient “rest”"),
        ("drink **four** cups _[7, 9]_ slowly", "drink four cups slowly"),
        ("saline<sup>1</sup> 30 m<sup>2</sup>", "saline 30 m2"),
        ("diffi culty and infl ating", "difficulty and inflating"),
        ("sub- stance<br>next", "substance next"),
        ("- u Breathe out", "- Breathe out"),
        ("**==> picture [1 x 2] <==** kept", "kept"),
        ("an _important_ word, snake_case_name", "an important word, snake_case_name"),
    ],
)
def test_clean_paragraph(spark, raw, clean):
    assert value(spark, X.clean_paragraph(F.lit(raw))) == clean


def test_headings(spark):
    assert value(spark, X.clean_heading(F.lit("## 4 C omplex fractures:"))) == "4 Complex fractures"
    assert value(spark, X.display_case(F.lit("NOTES ON THE HIV CLINIC"))) == "Notes on the HIV Clinic"
    assert value(spark, X.display_case(F.lit("Mixed CASE"))) == "Mixed CASE"
    assert value(spark, X.leading_caps_name(F.lit("SLEEP Questions"))) == "SLEEP"
    assert value(spark, X.clean_table(F.lit("|a|b|\n| | |\n|1|2|"))) == "|a|b|\n|1|2|"
    assert value(spark, X.clean_list_item(F.lit("• 1. drink"))) == "- 1. drink"
    assert not value(spark, X.is_heading(F.lit("12 34 5a")))


def test_path_helpers(spark):
    path = F.array(F.lit("A"), F.lit("a"), F.lit("b"))
    assert value(spark, X.adjacent_distinct(path)) == ["A", "b"]
    other = F.array(F.lit("A"), F.lit("x"))
    assert value(spark, X.common_prefix(path, other)) == ["A"]


def test_units_of_text(spark):
    text = "One dose. Then rest.\n- item one. still item\n| a | b |"
    assert value(spark, X.split_units(F.lit(text))) == ["One dose.", "Then rest.", "- item one. still item", "| a | b |"]


def test_topics_need_whole_words(spark):
    assert value(spark, LB.infer_topics(F.lit("mirrors near the floor"))) == []
    assert value(spark, LB.infer_topics(F.lit("My ears hurt and I cough, coughs"))) == ["respiratory", "eye_ent"]


def test_labels(spark):
    path = F.array(F.lit("1 References"))
    assert not value(spark, LB.is_retrievable(path, F.lit("text")))
    assert value(spark, LB.is_retrievable(F.array(F.lit("Care")), F.lit("text")))
    toc = "| a | 1 |\n| b | 2 |\n| c | 3 |\n| d | 4 |"
    assert not value(spark, LB.is_retrievable(F.array(F.lit("Care")), F.lit(toc)))
    kind = LB.chunk_type(F.array(F.lit("Danger signs")), F.lit("x"), F.lit(0.9))
    assert value(spark, kind) == "warning"
    assert value(spark, LB.chunk_population(F.lit("all"), F.array(F.lit("Newborn care")))) == "child"


def test_sound_brings_near_misses_together(spark):
    for a, b in (("sukrenile", "sukrenil"), ("talveksin", "talvexin"), ("lipendah", "lipenda")):
        assert value(spark, N.sound(F.lit(a))) == value(spark, N.sound(F.lit(b)))
    assert value(spark, N.sound(F.lit("xyz"))) == "kss"


def test_name_parts(spark):
    assert value(spark, N.name_tokens(F.lit("R-Velpine 5 g w/w"))) == ["r", "velpine", "5"]
    assert value(spark, N.strengths_in(F.lit("A 100mg and B 30mg/5ml"))) == "100 mg + 30 mg/5 ml"
    assert value(spark, N.unit_for(F.lit("Syrup"), F.lit("bottle"))) == "ml"
    assert value(spark, N.spoken_words(F.lit("Dorvinal K 3mg/250mg Tablet"))) == ["dorvinal", "k"]
    assert value(spark, N.spoken_number(F.lit("Dorvinal K 3mg/250mg Tablet"))) == "3"


def test_wording(spark):
    assert value(spark, W.clock_text(F.lit(8 * 3600))) == "8:00 AM"
    assert value(spark, W.clock_text(F.lit(0))) == "12:00 AM"
    three = F.array(F.lit("c"), F.lit("a"), F.lit("b"), F.lit("a"))
    assert value(spark, W.joined_labels(three)) == "a, b and c"
    assert value(spark, W.mobile_number(F.lit("+91 91234-56780"))) == "+919123456780"
    assert value(spark, W.mobile_number(F.lit("0000000000"))) is None
    assert value(spark, W.first_name(F.lit("  "))) == "there"
