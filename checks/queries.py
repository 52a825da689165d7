"""One query per operator, over the whole supplied tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.binding import clinical_tables, code_lists
from cohortspark import constants as k
from cohortspark.functions import (anniversary_years, birth_date, duration_years, na_agg,
                                   stripped_number)
from cohortspark.operators import clogit, cohort, covariates, diagnoses, distinct, exposure, matching, relational, summaries
from cohortspark.plans.study import MODEL_CANDIDATES, Study
from cohortspark.sources import (contains_any, csv_codes, dynamic_codes, in_codes, listed_events, literal_codes,
                                 of_persons, read_csv, run_template, write_csv, write_table)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_STUDIES: dict[tuple[str, str], Study] = {}


def study_of(spark: SparkSession, folder: str) -> Study:
    """The study on the tables of a folder; its written stages serve all queries of the session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STUDIES or not _STUDIES[key].scratch.intact():
        _STUDIES[key] = Study(spark, clinical_tables(spark, folder), code_lists(spark))
    return _STUDIES[key]


def query(build: Callable[[Study], DataFrame]) -> Callable[[Study], DataFrame]:
    """Register a query under the name of the function that builds it from the study."""
    QUERIES[build.__name__] = lambda spark, folder: build(study_of(spark, folder))
    return build


def r6(column: str | Column) -> Column:
    return F.round(column if isinstance(column, Column) else F.col(column), 6)


def big(column: str) -> Column:
    return F.col(column).cast("bigint").alias(column)


# ---- scans, sources, sinks -------------------------------------------------------------------------------------

@query
def scan_person(s: Study) -> DataFrame:
    return s.tables.person.select("person_id", "year_of_birth", "month_of_birth", "day_of_birth", "gender_concept_id")


@query
def scan_code_list(s: Study) -> DataFrame:
    return in_codes(s.tables.measurement, "measurement_concept_id", s.codes.lab).select(
        "measurement_id", "person_id", "measurement_concept_id", "measurement_date")


@query
def scan_person_subset(s: Study) -> DataFrame:
    return of_persons(s.tables.person, cohort.cohort_entry(s.labs)).select("person_id", "gender_concept_id")


@query
def scan_dynamic_column(s: Study) -> DataFrame:
    codes = literal_codes(s.spark, k.T3_CODES)
    return dynamic_codes(s.tables.measurement, s.hormone_column, codes).select(
        "measurement_id", "person_id", "measurement_date")


@query
def scan_like_any(s: Study) -> DataFrame:
    return (s.tables.procedure_occurrence.filter(contains_any(s.procedure_column, k.SURGERY_PATTERNS))
            .select("person_id", "procedure_date", "procedure_source_value"))


def coded_conditions(s: Study) -> DataFrame:
    return diagnoses.count_codes(s.tables.condition_occurrence, s.tables.concept_relationship, s.tables.concept)


def conditions_by_block(s: Study) -> DataFrame:
    return (coded_conditions(s).groupBy(F.substring("concept_code", 1, 3).alias("ICD"))
            .agg(F.sum("n").alias("n")))


@query
def scan_vocabulary(s: Study) -> DataFrame:
    return coded_conditions(s)


@query
def csv_code_list(s: Study) -> DataFrame:
    path = f"{s.scratch.root}/target-drugs.csv"
    write_csv(s.tables.drug_exposure.select(F.col("drug_concept_id").alias("concept_id"))
              .filter("concept_id % 20 < 4 AND concept_id <> 5").distinct(), path)
    listed = in_codes(s.tables.drug_exposure, "drug_concept_id", csv_codes(s.spark, path))
    return listed.groupBy("drug_concept_id").agg(F.count(F.lit(1)).alias("n"))


@query
def icd_chapter_lookup(s: Study) -> DataFrame:
    return diagnoses.chapters(conditions_by_block(s), mode="blocks").select(
        "Chapter", "n", "Block", "Title", "K_title")


@query
def sink_csv_roundtrip(s: Study) -> DataFrame:
    path = f"{s.scratch.root}/case-control.csv"
    table = s.case_control
    write_csv(table, path)
    return read_csv(s.spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema))


@query
def sink_parquet_roundtrip(s: Study) -> DataFrame:
    path = f"{s.scratch.root}/case-control.parquet"
    write_table(s.case_control, path)
    return s.spark.read.parquet(path)


# ---- projections and scalar functions ----------------------------------------------------------------------------

@query
def project_column_range(s: Study) -> DataFrame:
    names = s.scored.columns
    chosen = names[names.index("CCI1"):names.index("CCI17") + 1]
    return s.scored.select("person_id", "case_number", *chosen)


@query
def impute_by_prefix(s: Study) -> DataFrame:
    flags = covariates.comorbidity_flags(s.case_control, s.tables.condition_occurrence, s.codes.comorbidity)
    joined = s.case_control.select("person_id", "case_number").join(flags, ["person_id", "case_number"], "left")
    return covariates.fill_zero(joined, ("CCI",))


@query
def rename_columns(s: Study) -> DataFrame:
    return (cohort.cohort_entry(s.labs).withColumnRenamed("enroll_date", "first_test_date")
            .withColumnRenamed("person_id", "subject_id"))


@query
def clean_numeric_regex(s: Study) -> DataFrame:
    return s.tables.measurement.select(
        "measurement_id", stripped_number(F.col("value_source_value")).alias("value"))


def births(s: Study) -> DataFrame:
    return s.tables.person.select("person_id", "gender_concept_id", birth_date(
        F.col("year_of_birth"), F.col("month_of_birth"), F.col("day_of_birth")).alias("birth"))


@query
def birth_dates(s: Study) -> DataFrame:
    return births(s).select("person_id", "birth")


@query
def age_duration(s: Study) -> DataFrame:
    age = duration_years(F.col("birth"), F.col("enroll_date"))
    return cohort.cohort_entry(s.labs).join(births(s), "person_id").select(
        "person_id", r6(age).alias("age"), F.floor(age).cast("int").alias("full_years"))


@query
def age_anniversary(s: Study) -> DataFrame:
    return (s.labs.join(births(s), "person_id")
            .select("measurement_id", anniversary_years(F.col("birth"), F.col("measurement_date")).alias("age")))


@query
def exposure_end(s: Study) -> DataFrame:
    return (exposure.with_exposure_end(s.tables.drug_exposure)
            .groupBy("drug_concept_id").agg(F.min("drug_end_date").alias("first_end"),
                                            F.max("drug_end_date").alias("last_end")))


@query
def enroll_year(s: Study) -> DataFrame:
    return cohort.cohort_entry(s.labs).select("person_id", F.year("enroll_date").alias("enrollyear"))


@query
def recode_gender(s: Study) -> DataFrame:
    return s.tables.person.select("person_id", covariates.recode_gender(F.col("gender_concept_id")).alias("gender"))


@query
def odds_ratio_ci(s: Study) -> DataFrame:
    ratios = clogit.odds_ratio(F.col("estimate"), F.col("std_error"))
    return s.crude_odds.select("variable", "level", *[r6(c).alias(name) for name, c in ratios.items()])


@query
def icd_chapter(s: Study) -> DataFrame:
    return conditions_by_block(s).select("ICD", "n", diagnoses.chapter_of(F.col("ICD")).alias("Chapter"))


@query
def icd_three_char(s: Study) -> DataFrame:
    names = diagnoses.three_character_codes(s.tables.concept)
    return (conditions_by_block(s).join(names, F.col("ICD") == F.col("concept_code"))
            .select("ICD", "concept_name", "n"))


# ---- filters and joins ----------------------------------------------------------------------------------------

@query
def filter_numeric_lab(s: Study) -> DataFrame:
    return s.labs


@query
def filter_out_of_range(s: Study) -> DataFrame:
    return s.labs.filter(cohort.outside_range(F.col("value"))).select("measurement_id", "person_id", "value")


@query
def lookback_endpoint(s: Study) -> DataFrame:
    return exposure.exposures_before(s.case_control.select("person_id", "case_number", "indexdt2"),
                                     s.target_drugs).select(
        "person_id", "case_number", "drug_concept_id", "drug_exposure_start_date", "drug_end_date")


@query
def lookback_point(s: Study) -> DataFrame:
    return covariates.events_in_lookback(s.case_control, s.tables.condition_occurrence, "condition_start_date").select(
        "person_id", "case_number", "condition_concept_id", "condition_start_date")


@query
def events_in_period(s: Study) -> DataFrame:
    return summaries.labs_in_period(s.labs, s.period).select("measurement_id", "person_id", "measurement_date")


@query
def lookback_overlap(s: Study) -> DataFrame:
    return exposure.exposures_before(s.case_control.select("person_id", "case_number", "indexdt2"),
                                     s.target_drugs, mode="overlap").select(
        "person_id", "case_number", "drug_concept_id", "drug_exposure_start_date", "drug_end_date")


# A statement whose table, column, codes and dates are given when it is run.
CODED_EVENTS = """
SELECT measurement_id, person_id, measurement_date FROM {events}
WHERE array_contains(:codes, CAST(IDENTIFIER(:column) AS STRING)) AND measurement_date BETWEEN :first AND :last"""


@query
def template_events(s: Study) -> DataFrame:
    return run_template(s.spark, CODED_EVENTS, {"events": s.tables.measurement}, {"column": s.hormone_column},
                        codes=[str(c) for c in (*k.T3_CODES, *k.FREE_T4_CODES)], first=date(1994, 1, 1), last=date(1996, 12, 31))


@query
def semi_filter(s: Study) -> DataFrame:
    return of_persons(s.labs, s.exposed).select("measurement_id", "person_id")


@query
def anti_filter(s: Study) -> DataFrame:
    return s.tables.person.join(cohort.cohort_entry(s.labs), "person_id", "left_anti").select("person_id")


@query
def join_left(s: Study) -> DataFrame:
    return s.tables.person.select("person_id").join(cohort.cohort_entry(s.labs), "person_id", "left")


@query
def join_left_renamed(s: Study) -> DataFrame:
    counts = s.tables.condition_occurrence.groupBy("condition_concept_id").agg(F.count(F.lit(1)).alias("n"))
    return (counts.join(s.codes.comorbidity, F.col("condition_concept_id") == F.col("concept_id"), "left")
            .select("condition_concept_id", "n", "CCI1", "CCI2", "CCI17"))


@query
def join_inner(s: Study) -> DataFrame:
    return (s.cohort.select("person_id", "enroll_date").join(s.labs, "person_id")
            .select("person_id", "enroll_date", "measurement_id", "value"))


@query
def new_pairs(s: Study) -> DataFrame:
    return s.new_pairs


@query
def group_extreme_ties(s: Study) -> DataFrame:
    return relational.group_extreme(s.labs, "person_id", "value", largest=True).select(
        "person_id", "measurement_id", "value")


# ---- aggregations, windows, sort, sample ------------------------------------------------------------------------

@query
def count_distinct_person(s: Study) -> DataFrame:
    return s.tables.measurement.agg(F.count_distinct("person_id").alias("persons"))


@query
def count_distinct_bitmaps(s: Study) -> DataFrame:
    """Counted on bitmaps of the measurements of either half of the concepts, merged."""
    halves = [distinct.person_bitmaps(s.tables.measurement.filter(F.col("measurement_concept_id") % 2 == i)) for i in (0, 1)]
    return distinct.counted(distinct.merged(halves))


@query
def attrition_merged(s: Study) -> DataFrame:
    return distinct.attrition_of(s.attrition_bitmaps)


@query
def scan_listed_events(s: Study) -> DataFrame:
    return listed_events(s.tables.measurement, "measurement_concept_id", s.codes.lab).select(
        "measurement_id", "person_id", "measurement_concept_id", "measurement_date")


@query
def agg_min_max(s: Study) -> DataFrame:
    value = stripped_number(F.col("value_source_value"))
    return s.tables.measurement.groupBy("person_id").agg(
        F.min("measurement_date").alias("first_date"), F.max("measurement_date").alias("last_date"),
        na_agg(F.min, value).alias("lowest"), na_agg(F.max, value).alias("highest"))


@query
def agg_count(s: Study) -> DataFrame:
    return s.tables.measurement.groupBy("measurement_concept_id").agg(F.count(F.lit(1)).alias("n"))


@query
def count_of_counts(s: Study) -> DataFrame:
    return (s.matches.groupBy("case_number").agg(F.count(F.lit(1)).alias("controls"))
            .groupBy("controls").agg(F.count(F.lit(1)).alias("n")))


@query
def mean_and_n(s: Study) -> DataFrame:
    return relational.mean_and_n(s.labs, "value").select(r6("value").alias("value"), "n")


@query
def pivot_flags(s: Study) -> DataFrame:
    return covariates.class_table(s.tables.drug_exposure, s.codes.covariate_drug)


@query
def distinct_rows(s: Study) -> DataFrame:
    return s.tables.drug_exposure.select("person_id", "drug_concept_id").distinct()


@query
def first_per_group(s: Study) -> DataFrame:
    return relational.first_event(s.labs, "person_id", [F.col("measurement_date"), F.col("measurement_id")])


@query
def last_per_group(s: Study) -> DataFrame:
    return relational.first_event(s.labs, "person_id",
                                  [F.col("measurement_date").desc_nulls_last(), F.col("measurement_id")])


@query
def lag_gap(s: Study) -> DataFrame:
    return (exposure.exposure_gaps(s.exposures)
            .select("person_id", "case_number", "drug_exposure_start_date2", "drug_end_date2", "cwc"))


@query
def case_numbering(s: Study) -> DataFrame:
    return relational.number_rows(cohort.cohort_entry(s.labs), "person_id", "number", s.scratch)


@query
def sorted_output(s: Study) -> DataFrame:
    return s.case_control.select("case_number", "TSH", "person_id").orderBy("case_number", "TSH", "person_id")


@query
def sample_k_per_group(s: Study) -> DataFrame:
    order = [relational.seeded_order(42, "person_id", "measurement_id"), F.col("measurement_id")]
    return relational.sample_per_group(s.tables.measurement.select("person_id", "measurement_id"),
                                       ["person_id"], order, 4)


# ---- cohort, exclusions, matching ----------------------------------------------------------------------------

@query
def cohort_entry(s: Study) -> DataFrame:
    return cohort.cohort_entry(s.labs)


def adults(s: Study) -> DataFrame:
    return cohort.adults(cohort.cohort_entry(s.labs), s.tables.person)


@query
def adult_cohort(s: Study) -> DataFrame:
    return adults(s).select("person_id", "enroll_date", "birth", r6("age").alias("age"), "gender_concept_id")


@query
def exclude_abnormal_first_year(s: Study) -> DataFrame:
    return cohort.exclude_abnormal(adults(s), s.labs).select("person_id")


@query
def exclude_prior_condition(s: Study) -> DataFrame:
    events = in_codes(s.tables.condition_occurrence, "condition_concept_id", s.codes.excluded_condition)
    return cohort.exclude_if_event(adults(s), events, start="condition_start_date").select("person_id")


@query
def exclude_prior_procedure(s: Study) -> DataFrame:
    events = s.tables.procedure_occurrence.filter(contains_any(s.procedure_column, k.SURGERY_PATTERNS))
    return cohort.exclude_if_event(adults(s), events, start="procedure_date").select("person_id")


@query
def exclude_procedure_code(s: Study) -> DataFrame:
    events = in_codes(s.tables.procedure_occurrence, "procedure_concept_id",
                      literal_codes(s.spark, k.RADIOIODINE_CODES))
    return cohort.exclude_if_event(adults(s), events, start="procedure_date").select("person_id")


def _excluded_drug(s: Study, mode: str) -> DataFrame:
    events = in_codes(s.tables.drug_exposure, "drug_concept_id", s.codes.excluded_drug)
    return cohort.exclude_if_event(adults(s), events, start="drug_exposure_start_date", end="drug_exposure_end_date",
                                   lo=0, mode=mode).select("person_id")


@query
def exclude_drug_in_window(s: Study) -> DataFrame:
    return _excluded_drug(s, "endpoint")


@query
def exclude_drug_overlap(s: Study) -> DataFrame:
    return _excluded_drug(s, "overlap")


@query
def screened_cohort(s: Study) -> DataFrame:
    return s.cohort.select("person_id", "enroll_date", "gender_concept_id", r6("age").alias("age"))


@query
def attrition(s: Study) -> DataFrame:
    return s.attrition.select("no", "name", big("number"))


@query
def select_cases(s: Study) -> DataFrame:
    return s.cases.select("case_number", "person_id", "enroll_date", "indexdt", "birth", "age", "value",
                          "gender_concept_id")


@query
def candidate_counts(s: Study) -> DataFrame:
    return matching.candidate_counts(s.cases, s.pool)


@query
def match_controls(s: Study) -> DataFrame:
    return s.matches


@query
def union_case_control(s: Study) -> DataFrame:
    return s.case_control


# ---- exposure, covariates, tables, models -----------------------------------------------------------------------

@query
def clip_exposure(s: Study) -> DataFrame:
    return s.exposures


@query
def recency_class(s: Study) -> DataFrame:
    return exposure.recency_class(s.exposures)


@query
def continuous_use_days(s: Study) -> DataFrame:
    return exposure.continuous_use(s.exposures)


@query
def comorbidity_flags(s: Study) -> DataFrame:
    return covariates.comorbidity_flags(s.case_control, s.tables.condition_occurrence, s.codes.comorbidity)


@query
def condition_flag(s: Study) -> DataFrame:
    return covariates.condition_flag(s.case_control, s.tables.condition_occurrence, s.codes.covariate_condition)


@query
def drug_class_flags(s: Study) -> DataFrame:
    return covariates.class_flags(s.case_control, s.tables.drug_exposure, s.codes.covariate_drug)


@query
def assemble_analysis_table(s: Study) -> DataFrame:
    return s.analysis


@query
def comorbidity_score(s: Study) -> DataFrame:
    return s.scored.select("person_id", "case_number", "CCI", "CCIGR", "gender_concept_id")


@query
def frequency_table(s: Study) -> DataFrame:
    return s.frequencies.select("variable", "value", "total", "control", r6("control_ratio").alias("control_ratio"),
                                "patient", r6("patient_ratio").alias("patient_ratio"))


@query
def model_variable_list(s: Study) -> DataFrame:
    return s.model_variables


def _coefficients(table: DataFrame) -> DataFrame:
    doubles = ("OR", "lower_ci", "upper_ci", "estimate", "std_error", "statistic", "p_value")
    return table.select("variable", "level", *[r6(c).alias(c) for c in doubles], "converged")


@query
def crude_odds_ratios(s: Study) -> DataFrame:
    return _coefficients(s.crude_odds)


@query
def adjusted_odds_ratios(s: Study) -> DataFrame:
    return _coefficients(s.adjusted_odds)


@query
def frequency_matched_odds(s: Study) -> DataFrame:
    """The crude models of strata by gender, age band and entry year, which hold many cases each."""
    strata = s.scored.withColumn("stratum", F.concat_ws("-", "gender_concept_id", "agegr", "enrollyear"))
    return _coefficients(clogit.crude_odds(strata, s.model_variables, strata="stratum", candidates=MODEL_CANDIDATES))


# ---- follow-up ---------------------------------------------------------------------------------------------------

@query
def drug_era(s: Study) -> DataFrame:
    return exposure.drug_eras(s.target_drugs).select("person_id", "start_date", "last_intake", "drug_days")


@query
def drug_era_running_max(s: Study) -> DataFrame:
    return exposure.drug_eras(s.target_drugs, compare="running_max").select(
        "person_id", "start_date", "last_intake", "drug_days")


@query
def drug_era_scan(s: Study) -> DataFrame:
    return exposure.scanned_eras(s.target_drugs).select("person_id", "start_date", "last_intake", "drug_days")


@query
def drug_era_scan_running_max(s: Study) -> DataFrame:
    return exposure.scanned_eras(s.target_drugs, compare="running_max", block_days=90).select(
        "person_id", "start_date", "last_intake", "drug_days")


@query
def eras_near_index(s: Study) -> DataFrame:
    return s.near_eras.drop("era")


@query
def exposure_period(s: Study) -> DataFrame:
    return s.period


@query
def lab_summary(s: Study) -> DataFrame:
    return s.lab_summary.select("name", r6("value_mean").alias("value_mean"), "n")


@query
def before_after_series(s: Study) -> DataFrame:
    return s.hormone_series.select("name", r6("value").alias("value"), "n")


@query
def before_after_text(s: Study) -> DataFrame:
    series = summaries.before_after(s.near_eras, s.tables.measurement, column=s.hormone_column, string_min=True)
    return series.select("name", r6("value").alias("value"), "n")


def _contents(files: dict[str, DataFrame]) -> DataFrame:
    """The cells of result files, read as text, one row each: (name, item, field, value). Numbers are rounded."""
    keys = {"TABLE1": ("variable", "value"), "TABLE2": ("variable",), "TABLE3": ("variable",), "diagram": ("no", "name"), "TSH_table": ("name",),
            "t_series": ("name",), "newdisease_topN": ("ICD",), "newdisease_ICDchapter": ("Chapter",)}
    cells = []
    for name, df in files.items():
        fields = [c for c in df.columns if c not in keys[name]]
        text = df.select(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in keys[name]]).alias("item"),
                         *[F.col(c).cast("string").alias(c) for c in fields])
        number = F.col("text").try_cast("double")
        cells.append(text.unpivot("item", fields, "field", "text").select(
            F.lit(name).alias("name"), "item", "field", F.when(number.isNull(), F.col("text")).alias("text"), r6(number).alias("value")))
    return reduce(DataFrame.unionByName, cells)


@query
def sink_result_files(s: Study) -> DataFrame:
    """The attrition table and the crude models as they are read back from the written files, and the rows of the other files."""
    paths = s.write_results(f"{s.scratch.root}/results-{uuid.uuid4().hex}", "SITE")
    files = {name: s.spark.read.csv(path, header=True, nullValue="NA") for name, path in paths.items()}
    counts = [files[name].agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit(name).alias("name"), F.lit("").alias("item"), F.lit("rows").alias("field"), F.lit(None).cast("string").alias("text"), "value")
        for name in files]
    return reduce(DataFrame.unionByName, [_contents({name: files[name] for name in ("diagram", "TABLE2", "TABLE1", "newdisease_topN")}), *counts])


@query
def published_results(s: Study) -> DataFrame:
    """The same contents of a published set, found by its manifest."""
    published = s.publish_results(f"{s.scratch.root}/published-{uuid.uuid4().hex}", "SITE")
    rows = published.manifest().select("name", F.lit("").alias("item"), F.lit("rows").alias("field"), F.lit(None).cast("string").alias("text"),
                                       F.col("rows").cast("double").alias("value"))
    return _contents({name: published.read(name) for name in ("diagram", "TABLE2", "TABLE1", "newdisease_topN")}).unionByName(rows)


@query
def classify_relative_to_index(s: Study) -> DataFrame:
    return diagnoses.classify(s.tables.condition_occurrence, s.near_eras)


@query
def top_new_diagnoses(s: Study) -> DataFrame:
    return s.new_codes.orderBy(F.desc("n"), "ICD")


@query
def icd_chapter_rollup(s: Study) -> DataFrame:
    return s.new_chapters.select("Chapter", "n", "Block", "Title", "K_title")
