"""Exclusion windows, case selection, numbering and group extremes on hand-made rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import cohort, relational
from cohortspark.storage import Scratch, shared_folder

DAY0 = dt.date(2020, 1, 1)


def day(n):
    return None if n is None else DAY0 + dt.timedelta(days=n)


def ids(df):
    return sorted(r["person_id"] for r in df.collect())


@pytest.fixture()
def members(spark):
    return spark.createDataFrame([(i, DAY0) for i in range(1, 8)], "person_id bigint, enroll_date date")


def test_point_exclusion_reaches_back_without_limit_and_ends_on_day_364(spark, members):
    events = spark.createDataFrame([(1, day(-9000)), (2, day(0)), (3, day(364)), (4, day(365)), (5, None),
                                    (6, day(400)), (6, day(3))], "person_id bigint, d date")
    assert ids(cohort.exclude_if_event(members, events, start="d")) == [4, 5, 7]


def test_drug_exclusion_modes(spark, members):
    rows = [(1, day(-10), day(400)),   # spans the whole window
            (2, day(-10), day(0)), (3, day(364), day(500)), (4, day(365), day(400)), (5, day(-9), day(-1)),
            (6, day(10), None)]
    events = spark.createDataFrame(rows, "person_id bigint, s date, e date")
    endpoint = cohort.exclude_if_event(members, events, start="s", end="e", lo=0, mode="endpoint")
    overlap = cohort.exclude_if_event(members, events, start="s", end="e", lo=0, mode="overlap")
    assert ids(endpoint) == [1, 4, 5, 7]
    assert ids(overlap) == [4, 5, 7]


def test_screen_counts_rules_in_order(spark):
    labs = spark.createDataFrame(
        [(p, 10 * p + i, 1001, day(d), v) for p, tests in {
            1: [(0, 1.0), (365, 9.0)], 2: [(0, 1.0), (364, 9.0)], 3: [(0, 1.0)], 4: [(0, 1.0)], 5: [(0, 1.0)],
            6: [(0, 1.0)], 7: [(0, 1.0)], 8: [(0, 1.0)]}.items() for i, (d, v) in enumerate(tests)],
        "person_id bigint, measurement_id bigint, measurement_concept_id bigint, measurement_date date, value double")
    person = spark.createDataFrame([(p, 8507, 1980 if p != 3 else 2010, 2, 30 if p == 8 else 1) for p in range(1, 9)],
                                   "person_id bigint, gender_concept_id bigint, year_of_birth int, "
                                   "month_of_birth int, day_of_birth int")
    conditions = spark.createDataFrame([(4, day(100))], "person_id bigint, condition_start_date date")
    procedures = spark.createDataFrame([(5, 1, day(-5), "KP45520"), (7, 4036252, day(365), "M1"),
                                        (6, 4036252, day(364), "M1")],
                                       "person_id bigint, procedure_concept_id bigint, procedure_date date, "
                                       "procedure_source_value string")
    drugs = spark.createDataFrame([], "person_id bigint, drug_exposure_start_date date, drug_exposure_end_date date")
    rows = cohort.screen(labs, person, conditions, procedures, drugs).collect()
    assert {r["person_id"]: r["passed"] for r in rows} == {1: 6, 2: 1, 3: 0, 4: 2, 5: 3, 6: 5, 7: 6, 8: 0}


def test_screen_agrees_with_the_single_exclusions(study):
    adults = cohort.adults(cohort.cohort_entry(study.labs), study.tables.person)
    assert ids(study.screened.filter("passed >= 1")) == ids(adults)
    assert ids(study.screened.filter("passed >= 2")) == ids(cohort.exclude_abnormal(adults, study.labs))


def test_cases_take_the_first_high_value_and_dense_numbers(spark):
    members = spark.createDataFrame([(p, DAY0, dt.date(1980, 2, 29), 40.0, 8507) for p in (30, 10, 20)],
                                    "person_id bigint, enroll_date date, birth date, age double, gender_concept_id bigint")
    labs = spark.createDataFrame([(30, 3, day(500), 9.0), (30, 2, day(400), 6.0), (30, 1, day(400), 7.0),
                                  (10, 4, day(700), 4.6), (20, 5, day(700), 4.5)],
                                 "person_id bigint, measurement_id bigint, measurement_date date, value double")
    rows = cohort.select_cases(members, labs, Scratch(spark)).orderBy("case_number").collect()
    assert [(r["case_number"], r["person_id"], r["value"]) for r in rows] == [(1, 10, 4.6), (2, 30, 7.0)]
    assert rows[1]["age"] == 40 if day(400) < dt.date(2021, 2, 28) else 41


def test_numbering_is_dense_over_many_partitions(spark):
    df = spark.range(0, 5000, 1, 7).select((F.pmod(F.col("id") * 7919, F.lit(100_003))).alias("key"))
    rows = relational.number_rows(df, "key", "n", Scratch(spark)).orderBy("key").collect()
    assert [r["n"] for r in rows] == list(range(1, 5001))


def test_group_extreme_keeps_ties(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 2, "z"), ("b", None, "n"), ("b", 5, "m")],
                               "g string, v int, t string")
    assert sorted(r["t"] for r in relational.group_extreme(df, "g", "v").collect()) == ["m", "x", "y"]
    assert sorted(r["t"] for r in relational.group_extreme(df, "g", "v", largest=True).collect()) == ["m", "z"]


def test_scratch_uses_the_folder_of_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert named is None or shared_folder(spark) == named
    scratch = Scratch(spark)
    table = scratch.cut(spark.range(3), "three")
    assert scratch.root.startswith(shared_folder(spark)) and table.count() == 3
    path = scratch.write(spark.range(3), "gone")
    scratch.discard(path)
    assert scratch.intact()
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
