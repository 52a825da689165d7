"""Missing values, numbers and dates on hand-made rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortspark import functions as fn
from cohortspark.operators import cohort, covariates, diagnoses


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, expected", [
    ("4.50 uIU/mL", 4.5), ("<0.01", None), ("", None), (" 5", None), ("1d", None), ("NaN", None), ("Inf", None),
    ("-3", -3.0), ("1e2", 100.0), (".5 x", 0.5), ("7.", 7.0), ("1.2.3", None), (None, None)])
def test_first_word_number(spark, text, expected):
    assert one(spark, fn.first_word_number(F.lit(text).cast("string"))) == expected


@pytest.mark.parametrize("text, expected", [("<0.01", 0.01), ("4.5 mL", 4.5), ("1-2", None), ("", None), ("abc", None)])
def test_stripped_number(spark, text, expected):
    assert one(spark, fn.stripped_number(F.lit(text))) == expected


@pytest.mark.parametrize("parts, expected", [
    ((2000, 2, 29), dt.date(2000, 2, 29)), ((2001, 2, 29), None), ((2001, 13, 1), None), ((2001, None, 1), None),
    ((None, 1, 1), None), ((2001, 5, None), None), ((1999, 12, 31), dt.date(1999, 12, 31))])
def test_birth_date(spark, parts, expected):
    assert one(spark, fn.birth_date(*[F.lit(p).cast("int") for p in parts])) == expected


def test_two_age_definitions_differ_on_a_leap_day(spark):
    birth, index = F.lit(dt.date(2000, 2, 29)), F.lit(dt.date(2021, 2, 28))
    assert one(spark, fn.anniversary_years(birth, index)) == 20
    assert one(spark, fn.duration_years(F.lit(dt.date(2000, 1, 1)), F.lit(dt.date(2001, 1, 1)))) == 366 / 365.25
    assert one(spark, fn.anniversary_years(F.lit(dt.date(2000, 3, 5)), F.lit(dt.date(2019, 3, 5)))) == 19
    assert one(spark, fn.anniversary_years(F.lit(dt.date(2000, 3, 5)), F.lit(dt.date(2019, 3, 4)))) == 18


@pytest.mark.parametrize("days, expected", [(-181, False), (-180, True), (-1, True), (0, False)])
def test_lookback_bounds(spark, days, expected):
    index = dt.date(2020, 7, 1)
    date = F.lit(index + dt.timedelta(days=days))
    assert one(spark, fn.in_lookback(date, F.lit(index), 180)) is expected


def test_aggregates_are_missing_when_an_input_is(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 3.0)], "k string, v double")
    rows = df.groupBy("k").agg(fn.na_agg(F.avg, "v").alias("m"), fn.na_agg(F.max, "v").alias("x")).collect()
    assert {r["k"]: (r["m"], r["x"]) for r in rows} == {"a": (None, None), "b": (2.5, 3.0)}


def test_choice_on_unknown_condition_is_missing(spark):
    assert one(spark, fn.if_else(F.lit(None).cast("boolean"), F.lit(1), F.lit(0))) is None
    assert one(spark, covariates.recode_gender(F.lit(None).cast("bigint"))) is None
    assert one(spark, covariates.recode_gender(F.lit(8507))) == 1


@pytest.mark.parametrize("age, group", [(18, 7), (19, 1), (29, 1), (30, 2), (79, 6), (80, 7)])
def test_age_groups(spark, age, group):
    assert one(spark, covariates.age_group(F.lit(age))) == group


@pytest.mark.parametrize("code, by_letter, by_block", [
    ("A00", 1, 1), ("C7A", 2, 2), ("D00", None, 2), ("D01", 2, 2), ("D48", 2, 2), ("D49", None, None), ("D50", 3, 3),
    ("D89", 3, 3), ("D90", None, None), ("D3A", None, 2), ("H00", 7, 7), ("H59", 7, 7), ("H60", 8, 8), ("H95", 8, 8),
    ("H96", None, None), ("S01", 19, 19), ("T99", 19, None), ("U07", None, 22), ("V01", 20, 20), ("W01", None, 20),
    ("Y98", 20, 20), ("Z00", 21, 21), ("E91", 4, None), (None, None, None)])
def test_chapters(spark, code, by_letter, by_block):
    column = F.lit(code).cast("string")
    assert one(spark, diagnoses.chapter_of(column)) == by_letter
    assert one(spark, diagnoses.chapter_of(column, "blocks")) == by_block


def test_range_limits_are_strict(spark):
    assert [one(spark, cohort.outside_range(F.lit(v))) for v in (0.49, 0.5, 4.5, 4.51)] == [True, False, False, True]
