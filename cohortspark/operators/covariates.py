"""Covariate flags in the look-back window, the analysis table and the comorbidity score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark import constants as k
from cohortspark.functions import if_else
from cohortspark.operators.exposure import exposures_before
from cohortspark.operators.intervals import dates_in_windows
from cohortspark.storage import shuffled

KEY = ["person_id", "case_number"]


def case_control_table(cases: DataFrame, matches: DataFrame, cohort: DataFrame) -> DataFrame:
    """Cases and their controls; a control takes its case's index date and has no value."""
    case_rows = cases.withColumn("indexdt2", F.col("indexdt"))
    controls = (matches.join(shuffled(cases.select("case_number", F.col("indexdt").alias("indexdt2"))), "case_number")
                .join(shuffled(cohort.select("person_id", "enroll_date", "gender_concept_id",
                                             F.floor("age").cast("int").alias("age"))), "person_id")
                .withColumn("TSH", F.lit(0)))
    columns = ["person_id", "enroll_date", "age", "gender_concept_id", "value", "TSH", "case_number", "indexdt2"]
    return case_rows.unionByName(controls, allowMissingColumns=True).select(*columns)


def events_in_lookback(anchors: DataFrame, events: DataFrame, date: str, *, days: int = k.LOOKBACK_DAYS) -> DataFrame:
    """Events of the anchored persons on a day of the look-back window, once per anchor row."""
    return dates_in_windows(anchors.select(*KEY, "indexdt2"), events, [date], F.date_sub("indexdt2", days),
                            F.date_sub("indexdt2", 1), width=days)


def flags(anchors: DataFrame, conditions: DataFrame, codes: DataFrame, columns: Mapping[str, str], *,
          days: int = k.LOOKBACK_DAYS) -> DataFrame:
    """Largest value of each code-list column over the conditions in the look-back window, missing counted as 0.

    ``columns`` maps code-list columns to the names of the flags.
    """
    coded = conditions.join(codes, conditions["condition_concept_id"] == codes["concept_id"])
    return (events_in_lookback(anchors, coded, "condition_start_date", days=days).groupBy(*KEY)
            .agg(*[F.expr(f"max(coalesce({c}, 0)) AS {name}") for c, name in columns.items()]))


def comorbidity_flags(anchors: DataFrame, conditions: DataFrame, codes: DataFrame, **options) -> DataFrame:
    return flags(anchors, conditions, codes, {c: c for c in k.COMORBIDITIES}, **options)


def condition_flag(anchors: DataFrame, conditions: DataFrame, codes: DataFrame, **options) -> DataFrame:
    return flags(anchors, conditions, codes, {"dis1": "cdis1"}, **options)


def condition_flags(anchors: DataFrame, conditions: DataFrame, comorbidity_codes: DataFrame,
                    condition_codes: DataFrame, **options) -> DataFrame:
    """Comorbidity flags and the condition flag in one pass over the conditions.

    The two lists become one by a union, whose size Spark knows from the files; a full join's estimate would be the
    product of both, and the conditions would be shuffled by concept for it.
    """
    both = comorbidity_codes.unionByName(condition_codes, allowMissingColumns=True)
    codes = both.groupBy("concept_id").agg(*[F.max(c).alias(c) for c in both.columns if c != "concept_id"])
    return flags(anchors, conditions, codes, {**{c: c for c in k.COMORBIDITIES}, "dis1": "cdis1"}, **options)


def class_flags(anchors: DataFrame, drugs: DataFrame, codes: DataFrame, *,
                classes: Sequence[str] = k.DRUG_CLASSES, days: int = k.LOOKBACK_DAYS) -> DataFrame:
    """One 0/1 flag per drug class taken in the look-back window; other classes alone give a row of zeros."""
    classed = drugs.join(codes, drugs["drug_concept_id"] == codes["concept_id"])
    taken = exposures_before(anchors.select(*KEY, "indexdt2"), classed, days=days)
    return taken.groupBy(*KEY).agg(*[F.expr(f"max(int(drname <=> '{name}')) AS cdr{i}")
                                     for i, name in enumerate(classes, start=1)])


def class_table(drugs: DataFrame, codes: DataFrame, *, classes: Sequence[str] = k.DRUG_CLASSES) -> DataFrame:
    """One row per person with a listed drug, and a 0/1 column named after each class."""
    classed = drugs.join(codes, drugs["drug_concept_id"] == codes["concept_id"])
    wide = classed.groupBy("person_id").pivot("drname", list(classes)).agg(F.count(F.lit(1)))
    return wide.select("person_id", *[(F.coalesce(F.col(c), F.lit(0)) > 0).cast("int").alias(c) for c in classes])


def fill_zero(df: DataFrame, prefixes: Sequence[str], names: Sequence[str] = ()) -> DataFrame:
    """Missing values replaced by 0 in the named columns and those with one of the prefixes."""
    return df.selectExpr(*[f"coalesce({c}, 0) AS {c}" if c in names or c.startswith(tuple(prefixes)) else c
                           for c in df.columns])


def age_group(age: Column, bands: Sequence[tuple[int, int]] = k.AGE_BANDS) -> Column:
    """Number of the age band; ages outside all bands share the last number."""
    group = F.lit(len(bands) + 1)
    for number, (low, high) in reversed(list(enumerate(bands, start=1))):
        group = F.when(age.between(low, high), F.lit(number)).otherwise(group)
    return group


def analysis_table(case_control: DataFrame, *parts: DataFrame, bands: Sequence[tuple[int, int]] = k.AGE_BANDS) -> DataFrame:
    """Case-control rows with all covariates joined on (person, case), missing flags as 0, age band and entry year."""
    table = case_control
    for part in parts:
        table = table.join(shuffled(part), KEY, "left")
    return (fill_zero(table, ("CCI", "cdis", "cdr"), ("w", "allo"))
            .withColumns({"agegr": age_group(F.col("age"), bands), "enrollyear": F.year("enroll_date")}))


def recode_gender(gender: Column, code: int = k.MALE) -> Column:
    """1 for the given concept, else 0; a missing gender stays missing."""
    return if_else(gender == code, F.lit(1), F.lit(0))


def comorbidity_score(df: DataFrame, *, weights: Mapping[str, int] = k.SCORE_WEIGHTS,
                      cuts: Sequence[int] = k.SCORE_CUTS) -> DataFrame:
    """The weighted sum of the comorbidity flags as ``CCI``, and its grade as ``CCIGR``."""
    score = F.expr(" + ".join(f"{w} * {c}" for c, w in weights.items()))
    grade = F.lit(len(cuts) + 1)
    for number, cut in reversed(list(enumerate(cuts, start=1))):
        grade = F.when(F.col("CCI") < cut, F.lit(number)).otherwise(grade)
    return df.withColumn("CCI", score).withColumn("CCIGR", grade)
