"""Cohort entry, exclusions, attrition and case selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark import constants as k
from cohortspark.functions import (anniversary_years, birth_date, duration_years, first_word_number,
                                   stripped_number, within_days)
from cohortspark.operators.relational import first_event, number_rows
from cohortspark.sources import contains_any, in_codes
from cohortspark.storage import Scratch, shuffled


def numeric_lab(measurement: DataFrame, codes: DataFrame, *, value: str = "value_source_value",
                method: str = "first_word") -> DataFrame:
    """Laboratory rows on the code list whose text holds a number, with the number as ``value``."""
    parse = {"first_word": first_word_number, "strip": stripped_number}[method]
    return (in_codes(measurement, "measurement_concept_id", codes)
            .select("person_id", "measurement_id", "measurement_concept_id", "measurement_date",
                    parse(F.col(value)).alias("value"))
            .filter(F.col("value").isNotNull()))


def cohort_entry(labs: DataFrame) -> DataFrame:
    """Date of each person's first laboratory value."""
    return labs.groupBy("person_id").agg(F.min("measurement_date").alias("enroll_date"))


def adults(entry: DataFrame, person: DataFrame, *, min_age: int = k.MIN_AGE) -> DataFrame:
    """Members old enough at entry; an unknown birth date fails the test."""
    return with_demographics(entry, person).filter(F.col("age") >= min_age)


def with_demographics(entry: DataFrame, person: DataFrame) -> DataFrame:
    """Entry with gender, birth date and age (elapsed years) at entry."""
    demographics = person.select("person_id", "gender_concept_id",
                                 birth_date(F.col("year_of_birth"), F.col("month_of_birth"),
                                            F.col("day_of_birth")).alias("birth"))
    return (entry.join(shuffled(demographics), "person_id", "left")
            .withColumn("age", duration_years(F.col("birth"), F.col("enroll_date"))))


def outside_range(value: Column, low: float = k.LOWER_LIMIT, high: float = k.UPPER_LIMIT) -> Column:
    return (value > high) | (value < low)


def exclude_if_event(cohort: DataFrame, events: DataFrame, *, start: str, end: str | None = None,
                     anchor: str = "enroll_date", lo: int | None = None, hi: int = k.BASELINE_DAYS,
                     mode: str = "point") -> DataFrame:
    """Members without an event in days ``lo``..``hi`` after the anchor (``lo=None``: ever before, too).

    ``point`` tests the start, ``endpoint`` tests start or end (an event that spans the whole window does not
    count), ``overlap`` tests any common day.
    """
    if mode == "point" and lo is None:
        # The earliest event decides, so events shrink to one row per person before the join.
        first = events.groupBy("person_id").agg(F.min(start).alias("_first"))
        hit = [cohort["person_id"] == first["person_id"],
               first["_first"] <= F.date_add(cohort[anchor], hi)]
        return cohort.join(shuffled(first), hit, "left_anti")
    return cohort.join(shuffled(_persons_with_event(cohort, events, start, end, anchor, lo, hi, mode)),
                       "person_id", "left_anti")


def _persons_with_event(cohort: DataFrame, events: DataFrame, start: str, end: str | None, anchor: str,
                        lo: int | None, hi: int, mode: str) -> DataFrame:
    def inside(date: Column) -> Column:
        if lo is None:
            return date <= F.date_add(F.col("_anchor"), hi)
        return within_days(date, F.col("_anchor"), lo, hi)

    anchors = cohort.select("person_id", F.col(anchor).alias("_anchor"))
    if mode == "point":
        hit = inside(F.col(start))
    elif mode == "endpoint":
        hit = inside(F.col(start)) | inside(F.col(end))
    elif mode == "overlap":
        hit = F.col(start) <= F.date_add(F.col("_anchor"), hi)
        if lo is not None:
            hit &= F.coalesce(F.col(end), F.col(start)) >= F.date_add(F.col("_anchor"), lo)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    dates = [start] if end is None else [start, end]
    return (events.select("person_id", *dates).join(shuffled(anchors), "person_id").filter(hit)
            .select("person_id").distinct())


def exclude_abnormal(cohort: DataFrame, labs: DataFrame, *, low: float = k.LOWER_LIMIT,
                     high: float = k.UPPER_LIMIT, days: int = k.BASELINE_DAYS) -> DataFrame:
    """Members without a value outside the range up to ``days`` after entry."""
    abnormal = labs.filter(outside_range(F.col("value"), low, high))
    return exclude_if_event(cohort, abnormal, start="measurement_date", hi=days)


def screen(labs: DataFrame, person: DataFrame, conditions: DataFrame, procedures: DataFrame, drugs: DataFrame, *,
           procedure_column: str = "procedure_source_value", patterns: Sequence[str] = k.SURGERY_PATTERNS,
           procedure_codes: Sequence[int] = k.RADIOIODINE_CODES, min_age: int = k.MIN_AGE, low: float = k.LOWER_LIMIT,
           high: float = k.UPPER_LIMIT, days: int = k.BASELINE_DAYS, scratch: Scratch | None = None) -> DataFrame:
    """One row per tested person with every entry rule as a flag; ``conditions`` and ``drugs`` are already
    restricted to the excluded codes.

    Each event table is aggregated to one row per person first, so all rules share the person partitioning and
    the table is built in one pass. ``passed`` counts the rules met in order: 1 adult, 2 laboratory,
    3 condition, 4 surgery, 5 drug, 6 procedure code. With a scratch folder the entry dates, which two rules need, are
    written once and laid out by person.
    """
    first_date = F.min("measurement_date")
    lab = labs.groupBy("person_id").agg(
        first_date.alias("enroll_date"),
        F.min(F.when(outside_range(F.col("value"), low, high), F.col("measurement_date"))).alias("_abnormal"))
    if scratch is not None:
        lab = scratch.cut_by(lab, "entry", "person_id")
    condition = conditions.groupBy("person_id").agg(F.min("condition_start_date").alias("_condition"))
    surgery = contains_any(procedure_column, patterns)
    treated = F.col("procedure_concept_id").isin(*procedure_codes)
    procedure = procedures.filter(surgery | treated).groupBy("person_id").agg(
        F.min(F.when(surgery, F.col("procedure_date"))).alias("_surgery"),
        F.min(F.when(treated, F.col("procedure_date"))).alias("_treated"))
    entry = lab.select("person_id", "enroll_date")
    drug = (_persons_with_event(entry, drugs, "drug_exposure_start_date", "drug_exposure_end_date",
                                "enroll_date", 0, days, "endpoint")
            .withColumn("_drug", F.lit(True)))

    last = F.date_add("enroll_date", days)

    def clear(first: str) -> Column:
        return F.coalesce(F.col(first) > last, F.lit(True))

    rules = [F.coalesce(F.col("age") >= min_age, F.lit(False)), clear("_abnormal"), clear("_condition"),
             clear("_surgery"), F.col("_drug").isNull(), clear("_treated")]
    passed, so_far = F.lit(0), F.lit(True)
    for rule in rules:
        so_far = so_far & rule
        passed = passed + so_far.cast("int")
    return (with_demographics(lab, person).join(shuffled(condition), "person_id", "left")
            .join(shuffled(procedure), "person_id", "left").join(shuffled(drug), "person_id", "left")
            .select("person_id", "enroll_date", "birth", "age", "gender_concept_id", passed.alias("passed")))


def select_cases(cohort: DataFrame, labs: DataFrame, scratch: Scratch, *,
                 threshold: float = k.UPPER_LIMIT) -> DataFrame:
    """Members with a value above the threshold: first such value, age in birthdays, number in person order."""
    high = labs.filter(F.col("value") > threshold).select("person_id", "measurement_id", "measurement_date", "value")
    first = first_event(high, "person_id", [F.col("measurement_date"), F.col("measurement_id")])
    cases = (cohort.join(shuffled(first), "person_id")
             .select("person_id", "enroll_date", F.col("measurement_date").alias("indexdt"), "birth",
                     anniversary_years(F.col("birth"), F.col("measurement_date")).alias("age"),
                     "value", "gender_concept_id", F.lit(1).alias("TSH")))
    # Written first: range partitioning samples its input, which would run the whole plan a second time.
    return number_rows(scratch.cut(cases, "unnumbered"), "person_id", "case_number", scratch)


def attrition(person: DataFrame, screened: DataFrame, cases: DataFrame, matches: DataFrame) -> DataFrame:
    """The ten labelled counts of the cohort, as one row each."""
    total = person.agg(F.count_distinct("person_id").alias("c1"))
    stages = screened.agg(F.count(F.lit(1)).alias("c2"),
                          *[F.count_if(F.col("passed") >= i).alias(f"c{i + 2}") for i in range(1, 7)])
    counts = [total, stages, cases.agg(F.count(F.lit(1)).alias("c9")),
              matches.agg(F.count(F.lit(1)).alias("c10"))]
    tall = [df.select(F.inline(F.array(*[
        F.struct(F.lit(int(c[1:])).alias("no"), F.lit(k.ATTRITION_LABELS[int(c[1:]) - 1]).alias("name"),
                 F.col(c).alias("number")) for c in df.columns]))) for df in counts]
    result = tall[0]
    for part in tall[1:]:
        result = result.unionByName(part)
    return result
