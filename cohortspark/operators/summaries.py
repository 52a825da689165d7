"""Frequency tables and laboratory summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark import constants as k
from cohortspark.functions import na_agg, stripped_number
from cohortspark.operators.intervals import dates_in_windows
from cohortspark.operators.relational import group_extreme, mean_and_n
from cohortspark.storage import shuffled


def frequency_table(df: DataFrame, *, outcome: str = "TSH",
                    variables: Sequence[str] = k.TABLE_VARIABLES) -> DataFrame:
    """Every variable's levels against the outcome: counts and shares, empty cells as 0, missing levels dropped."""
    wide = df.selectExpr(outcome, *[f"string({c}) AS {c}" for c in variables])
    counts = (wide.unpivot(outcome, list(variables), "variable", "value").filter(F.col("value").isNotNull())
              .groupBy("variable", "value")
              .agg(F.count_if(F.col(outcome) == 0).alias("control"), F.count_if(F.col(outcome) == 1).alias("patient")))
    total = F.col("control") + F.col("patient")
    return counts.select("variable", "value", total.alias("total"),
                         "control", F.try_divide("control", total).alias("control_ratio"),
                         "patient", F.try_divide("patient", total).alias("patient_ratio"))


def model_variables(frequencies: DataFrame, *, skip: Sequence[str] = k.NOT_MODELLED) -> DataFrame:
    """Variables whose level 1 occurs among both cases and controls."""
    return (frequencies.filter((F.col("value") == "1") & ~F.col("variable").isin(*skip)
                               & (F.col("control") != 0) & (F.col("patient") != 0))
            .select("variable").distinct())


def exposed_cases(analysis: DataFrame) -> DataFrame:
    """Cases that took the drug in the look-back window."""
    return (analysis.filter(F.col("value").isNotNull() & (F.col("allo") == 1))
            .select("person_id", "case_number", "enroll_date", F.col("indexdt2").alias("indexdt")))


def labs_in_period(labs: DataFrame, period: DataFrame) -> DataFrame:
    """Values taken during each person's period of use."""
    return dates_in_windows(period.select("person_id", "entire_start", "entire_end"), labs, ["measurement_date"],
                            F.col("entire_start"), F.col("entire_end"), width=k.LOOKBACK_DAYS)


def lab_summary(labs: DataFrame, period: DataFrame) -> DataFrame:
    """Mean and number of values: first ever, first in the period, largest in the period, all in the period.

    A person's tied rows all count. ``labs`` are the exposed cases' values, ``period`` their periods of use.
    """
    inside = labs_in_period(labs, period).select("person_id", "measurement_date", "value")
    parts = {
        "TSH_cohortin": group_extreme(labs.select("person_id", "measurement_date", "value"),
                                      "person_id", "measurement_date"),
        "TSH_indexdt": group_extreme(inside, "person_id", "measurement_date"),
        "TSH_after_indexdt_max": group_extreme(inside, "person_id", "value", largest=True),
        "TSH_after_indexdt_mean": inside,
    }
    rows = [mean_and_n(df, "value", "value_mean").withColumn("name", F.lit(name)) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, rows)


def before_after(eras: DataFrame, measurement: DataFrame, *, column: str = "measurement_concept_id",
                 code_sets: Mapping[str, Sequence[int]] = k.HORMONES, string_min: bool = False) -> DataFrame:
    """Mean value and number of persons per code set, at the first test before an era and at the last test on or
    after the index date. The tests are scanned once and the eras once.

    ``string_min`` takes the smallest text before it is read as a number, instead of the smallest number.
    """
    code_of = F.col(column).cast("string")
    belongs = F.coalesce(*[F.when(code_of.isin(*[str(c) for c in codes]), F.lit(name))
                           for name, codes in code_sets.items()])
    persons = eras.groupBy("person_id", "index_date").agg(F.max("start_date").alias("_last_start"))
    tests = (measurement.withColumn("_set", belongs).filter(F.col("_set").isNotNull())
             .select("_set", "person_id", "measurement_id", "measurement_date", "value_source_value")
             .join(shuffled(persons), "person_id"))

    text, day = F.col("value_source_value"), F.col("measurement_date")
    lowest = na_agg(F.min, text).try_cast("double") if string_min else na_agg(F.min, stripped_number(text))
    before, after = F.max(day < F.col("_last_start")), F.max(day >= F.col("index_date"))
    # One row per person, set and day says all: the day's smallest value, and the value of its first test.
    days = tests.groupBy("_set", "person_id", "measurement_date").agg(
        before.alias("_before"), after.alias("_after"), F.struct(lowest.alias("value")).alias("_lowest"),
        F.min_by(F.struct(stripped_number(text).alias("value")), "measurement_id").alias("_first"))
    ends = days.groupBy("_set", "person_id").agg(
        F.min_by("_lowest", F.when(F.col("_before"), day)).alias("_1"), F.max_by("_first", F.when(F.col("_after"), day)).alias("_2"))
    both = (ends.select("_set", F.inline(F.array(*[F.struct(F.lit(n).alias("_when"), F.col(f"_{n}").alias("_test")) for n in (1, 2)])))
            .filter(F.col("_test").isNotNull()).select("_set", "_when", F.col("_test.value").alias("_value")))
    means = (both.groupBy("_set", "_when").agg(na_agg(F.avg, "_value").alias("value"), F.count(F.lit(1)).alias("n"))
             .select("value", "n", F.concat_ws("_", "_set", "_when").alias("name")))
    # A set without any test still has its two rows.
    rows = [F.struct(F.lit(f"{name}_{when}").alias("name")) for name in code_sets for when in (1, 2)]
    every = measurement.sparkSession.range(1).select(F.inline(F.array(*rows)))
    return (every.join(means, "name", "left")
            .select("value", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "name"))
