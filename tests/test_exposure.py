"""Exposure windows, spans and eras on hand-made rows and against a row-by-row rule."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from cohortspark.operators import covariates, exposure

INDEX = dt.date(2020, 7, 1)


def day(n):
    return None if n is None else INDEX + dt.timedelta(days=n)


@pytest.fixture()
def anchors(spark):
    return spark.createDataFrame([(1, 1, INDEX)], "person_id bigint, case_number bigint, indexdt2 date")


def drugs(spark, rows):
    return spark.createDataFrame([(1, day(s), n) for s, n in rows],
                                 "person_id bigint, drug_exposure_start_date date, days_supply int")


def test_exposures_are_kept_by_endpoint_and_clipped(spark, anchors):
    rows = [(-200, 21), (-200, 20), (-200, 400), (-10, 100), (0, 5), (-1, 1), (-5, None), (-1, 1)]
    kept = exposure.exposure_window(anchors, drugs(spark, rows)).collect()
    got = sorted((r["drug_exposure_start_date2"], r["drug_end_date2"] or dt.date.max) for r in kept)
    assert got == [(day(-180), day(-180)), (day(-10), day(-1)), (day(-5), dt.date.max), (day(-1), day(-1))]
    overlapping = exposure.exposure_window(anchors, drugs(spark, rows), mode="overlap")
    assert overlapping.count() == 5   # the exposure that spans the window counts, too


@pytest.mark.parametrize("start, supply, expected", [
    (-30, 1, 1), (-1, 1, 1), (-31, 1, 2), (-60, 1, 2), (-61, 1, 3), (-90, 1, 3), (-91, 1, 4), (-180, 1, 4),
    (-100, 40, 3), (-100, 200, 1)])
def test_recency(spark, anchors, start, supply, expected):
    rows = exposure.recency_class(exposure.exposure_window(anchors, drugs(spark, [(start, supply)]))).collect()
    assert [(r["allo"], r["w"]) for r in rows] == [(1, expected)]


@pytest.mark.parametrize("rows, days", [
    ([(-100, 10)], 10),
    ([(-100, 10), (-95, 26)], 31),          # ends 30 days after the previous start
    ([(-100, 10), (-95, 27)], 10),          # 31 days: breaks, and stays broken
    ([(-100, 10), (-95, 27), (-90, 5)], 10),
    ([(-100, 20), (-98, 3)], 20),           # nested
    ([(-100, None), (-99, 3)], None)])      # a missing end makes the length unknown
def test_continuous_use(spark, anchors, rows, days):
    got = exposure.continuous_use(exposure.exposure_window(anchors, drugs(spark, rows))).collect()
    assert [r["drugday"] for r in got] == [days]


def eras_row_by_row(rows):
    """(start, end) rows of one person, in order; the rule applied one row at a time."""
    big = dt.date.max
    ordered = sorted(rows, key=lambda r: (r[0] or big, r[1] or big))
    eras, previous = [], None
    for start, end in ordered:
        if eras and previous is not None and start is not None and start <= previous + dt.timedelta(days=7):
            eras[-1].append((start, end))
        else:
            eras.append([(start, end)])
        previous = end
    out = []
    for era in eras:
        starts, ends = [s for s, _ in era], [e for _, e in era]
        out.append((None if None in starts else min(starts), None if None in ends else max(ends)))
    return out


def test_eras_follow_the_rule_row_by_row(spark):
    rng = random.Random(7)
    rows = []
    for person in range(60):
        for _ in range(rng.randint(1, 12)):
            start = rng.randint(0, 60)
            end = None if rng.random() < 0.15 else start + rng.randint(-12, 15)
            for _ in range(rng.choice([1, 1, 2, 3])):   # repeated rows
                rows.append((person, None if rng.random() < 0.03 else day(start), day(end)))
    df = spark.createDataFrame(rows, "person_id bigint, drug_exposure_start_date date, drug_exposure_end_date date")
    key = lambda r: tuple(str(v) for v in r)
    got = sorted(((r["person_id"], r["start_date"], r["last_intake"]) for r in exposure.drug_eras(df).collect()), key=key)
    expected = sorted(((p, *era) for p in range(60)
                       for era in eras_row_by_row([r[1:] for r in rows if r[0] == p])), key=key)
    assert got == expected


def test_eras_by_running_maximum_join_nested_use(spark):
    df = spark.createDataFrame([(1, day(0), day(100)), (1, day(5), day(10)), (1, day(50), day(60))],
                               "person_id bigint, drug_exposure_start_date date, drug_exposure_end_date date")
    assert exposure.drug_eras(df).count() == 2
    assert [(r["start_date"], r["last_intake"], r["drug_days"])
            for r in exposure.drug_eras(df, compare="running_max").collect()] == [(day(0), day(100), 100)]


def test_the_longer_era_rule_selects_the_same_eras(study):
    """``last > idx - 180 OR (start <= idx AND last >= idx)``: the second half adds nothing."""
    dates = study.exposed.select("person_id", "indexdt")
    all_eras = study.eras.join(dates, "person_id")
    longer = all_eras.filter("last_intake > date_sub(indexdt, 180) OR (start_date <= indexdt AND last_intake >= indexdt)")
    assert longer.count() == study.near_eras.count()


def test_period_ends_a_year_after_the_last_era(spark):
    eras = spark.createDataFrame([(1, day(0), day(10)), (1, day(40), day(50))],
                                 "person_id bigint, start_date date, last_intake date")
    row = exposure.exposure_period(eras).first()
    assert (row["entire_start"], row["entire_end"], row["cohort_out_date"]) == (day(0), day(50), day(415))


def test_class_flags_keep_a_row_for_unlisted_classes(spark, anchors):
    taken = spark.createDataFrame([(1, 7, day(-20), 5)],
                                  "person_id bigint, drug_concept_id bigint, drug_exposure_start_date date, days_supply int")
    codes = spark.createDataFrame([(7, "other")], "concept_id bigint, drname string")
    rows = covariates.class_flags(anchors, taken, codes).collect()
    assert len(rows) == 1 and all(rows[0][f"cdr{i}"] == 0 for i in range(1, 19))


def test_missing_flag_values_count_as_zero(spark, anchors):
    conditions = spark.createDataFrame([(1, 5, day(-1)), (1, 6, day(-181)), (1, 6, day(0))],
                                       "person_id bigint, condition_concept_id bigint, condition_start_date date")
    codes = spark.createDataFrame([(5, None), (6, 1)], "concept_id bigint, dis1 int")
    assert [r["cdis1"] for r in covariates.condition_flag(anchors, conditions, codes).collect()] == [0]


def test_score_counts_the_seventh_flag_twice_and_not_the_last(spark):
    from cohortspark.constants import COMORBIDITIES
    rows = [[1 if name == on else 0 for name in COMORBIDITIES] for on in COMORBIDITIES]
    df = spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{c} int" for c in COMORBIDITIES))
    scores = [r["CCI"] for r in covariates.comorbidity_score(df).collect()]
    grades = [r["CCIGR"] for r in covariates.comorbidity_score(df).collect()]
    assert scores == [0, 2, 0, 0, 2, 1, 5, 0, 2, 0, 1, 2, 1, 2, 4, 6, 0]
    assert grades == [{0: 1, 1: 2, 2: 3}.get(s, 4) for s in scores]


@pytest.mark.parametrize("compare", ["previous_row", "running_max"])
def test_eras_by_blocks_equal_eras_by_person(spark, compare):
    rng = random.Random(12)
    rows = [(p, day(None if rng.random() < 0.05 else rng.randint(0, 900)), day(None if rng.random() < 0.1 else rng.randint(-20, 1000)))
            for p in (1, 2, 3, None) for _ in range(rng.choice([1, 40, 120]))]
    rows += [(4, day(10 * i), day(10 * i + rng.randint(1, 8))) for i in range(100)] + rows[:30] * 2
    df = spark.createDataFrame(rows, "person_id bigint, drug_exposure_start_date date, drug_exposure_end_date date")
    expected = sorted(map(tuple, exposure.drug_eras(df, compare=compare).drop("era").collect()), key=str)
    for width in (1, 30, 366, 100_000):
        got = exposure.scanned_eras(df, compare=compare, block_days=width)
        assert sorted(map(tuple, got.drop("era").collect()), key=str) == expected
    with pytest.raises(ValueError):
        exposure.scanned_eras(df, compare="other")
