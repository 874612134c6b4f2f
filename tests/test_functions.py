"""Rules of the text, number and scoring functions, case by case."""

import pytest
from pyspark.sql import functions as F

from veritrail.functions import numbers as N, scoring as S, text as T
from veritrail.operators import claims as C
from veritrail.plans import review as V


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "want"), [("a?b?c ?d", "a b c ?d"), ("x y​z％", "x yz%"), ("", "")])
def test_normalize_invisibles(spark, text, want):
    assert value(spark, T.normalize_invisibles(F.lit(text))) == want


def test_extract_numbers(spark):
    text = "147,746백만원 3.5 % 12%p 5만원 2023년 1234,567"
    assert value(spark, N.extract_numbers(F.lit(text))) == ["147,746백만원", "3.5%", "12%", "5", "2023년", "1234", "567"]


def test_number_variants(spark):
    got = value(spark, N.number_variants(F.lit("147,746백만원")))
    assert {"147746백만원", "1477억원", "1,477억원", "147,746,000천원", "147746000000원"} <= set(got)
    assert "0.500억원" in value(spark, N.number_variants(F.lit("50백만원")))
    assert value(spark, N.number_variants(F.lit("3.5%"))) == ["3.5%", "3.5％"]


@pytest.mark.parametrize(("token", "want"), [("1억원", 100.0), ("12%", None), ("5", None)])
def test_claim_amount(spark, token, want):
    assert value(spark, N.claim_amount(F.lit(token))) == want


def test_years_units_sentences(spark):
    assert value(spark, N.extract_years(F.lit("120000"))) == ["2000"]
    assert value(spark, N.extract_units(F.lit("up 3억원"))) == ["억원", "원", "p"]
    assert value(spark, T.split_sentences(F.lit("a 3.5% b! c"))) == ["a 3", "5% b", "c"]


@pytest.mark.parametrize(("text", "want"), [
    ("# T\nRevenue was 3.5 in total. It rose again.", ["Revenue was 3.5 in total.", "It rose again."]),
    ("U.S. output rose a lot.", ["U DOT S DOT? output rose a lot."]),
    ("| name | value |\n|---|---|\n| alpha | 12345 |", ["| name | value |", "| alpha | 12345 |"]),
    ("short.", []), (None, []),
])
def test_claims(spark, text, want):
    assert value(spark, C.claims_of(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(("n", "lengths"), [(2000, [900, 900, 440]), (900, [900]), (0, [])])
def test_chunk_text(spark, n, lengths):
    assert [len(x) for x in value(spark, C.chunk_text(F.lit("x" * n)))] == lengths


def test_chunk_text_rejects_overlap():
    with pytest.raises(ValueError):
        C.chunk_text("text", 100, 100)


def test_direction_unit_proximity(spark):
    pair = F.lit("증가"), F.lit("감소")
    assert value(spark, S.direction_score(*pair)) == 0.0 and value(spark, S.direction_conflict(*pair))
    assert value(spark, S.direction_score(F.lit("x"), F.lit("감소"))) == 0.5
    assert value(spark, S.unit_match(F.lit("x"), F.lit("y"))) == 0.5
    none = F.array().cast("array<string>")
    assert value(spark, S.proximity(F.lit("매출 5"), F.lit(""), F.array(F.lit("5")), F.array(F.array(F.lit("5"))))) == 0.0
    assert value(spark, S.proximity(F.lit("매출 5"), F.lit(""), none, F.array(none))) == 0.5


def test_highlight(spark):
    got = value(spark, T.highlight_snippet(F.lit("a <12> 12억"), F.array(F.lit("12"), F.lit("12억"))))
    assert got == "a &lt;<b>12</b>&gt; <b><b>12</b>억</b>"


def test_grades_and_ids(spark):
    assert [value(spark, V.report_grade(F.lit(x))) for x in (95.0, 94.9, 49.9)] == ["S", "A+", "F"]
    assert V.id_ranges("10-1, 12, x") == [(1, 10), (12, 12)]


def test_combine_status(spark):
    assert value(spark, S.combine_status(F.lit("PARTIAL"), F.lit("UNSUPPORTED"))) == "PARTIAL"
