"""The matched case-control study, from clinical tables to result files."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark import constants as k
from cohortspark.operators import clogit, cohort, covariates, diagnoses, distinct, exposure, matching, summaries
from cohortspark.plans.parameters import StudyParameters
from cohortspark.sources import ClinicalTables, CodeLists, ResultSet, listed_events, of_persons, write_csv, write_table
from cohortspark.storage import Scratch

MODEL_CANDIDATES = tuple(v for v in k.TABLE_VARIABLES if v not in (*k.NOT_MODELLED, "enrollyear"))


class Study:
    """Stages of the study. Each is lazy; those that several later stages read are written once to the scratch folder, laid out
    by the person (and case) that later stages join on."""

    def __init__(self, spark: SparkSession, tables: ClinicalTables, codes: CodeLists, *,
                 parameters: StudyParameters | None = None, seed: int = 42,
                 procedure_column: str = "procedure_source_value",
                 hormone_column: str = "measurement_concept_id"):
        self.spark, self.tables, self.codes = spark, tables, codes
        self.seed, self.procedure_column, self.hormone_column = seed, procedure_column, hormone_column
        self.parameters = parameters or StudyParameters()
        self.scratch = Scratch(spark)

    @cached_property
    def labs(self) -> DataFrame:
        """Parsed once, for the screening, the case selection and the follow-up."""
        return self.scratch.cut_by(cohort.numeric_lab(self.tables.measurement, self.codes.lab), "labs", "person_id")

    @cached_property
    def screened(self) -> DataFrame:
        p = self.parameters
        excluded = listed_events(self.tables.condition_occurrence, "condition_concept_id", self.codes.excluded_condition)
        drugs = listed_events(self.tables.drug_exposure, "drug_concept_id", self.codes.excluded_drug)
        flags = cohort.screen(self.labs, self.tables.person, excluded, self.tables.procedure_occurrence, drugs,
                              procedure_column=self.procedure_column, patterns=p.surgery_patterns,
                              procedure_codes=p.procedure_codes, min_age=p.min_age, low=p.lower_limit, high=p.upper_limit,
                              days=p.baseline_days, scratch=self.scratch)
        return self.scratch.cut_by(flags, "screened", "person_id")

    @cached_property
    def cohort(self) -> DataFrame:
        return self.screened.filter(F.col("passed") == 6).drop("passed")

    @cached_property
    def cases(self) -> DataFrame:
        return self.scratch.cut(cohort.select_cases(self.cohort, self.labs, self.scratch,
                                                    threshold=self.parameters.upper_limit), "cases")

    @cached_property
    def pool(self) -> DataFrame:
        return self.scratch.cut(matching.control_pool(self.cohort, self.cases), "pool")

    @cached_property
    def matches(self) -> DataFrame:
        """Written, because several stages read it."""
        p = self.parameters
        return self.scratch.cut(matching.match_controls(
            self.cases, self.pool, self.scratch, exact=p.exact, controls=p.controls, age_band=p.age_band,
            date_band=p.entry_band, seed=self.seed), "matches")

    @cached_property
    def attrition(self) -> DataFrame:
        return cohort.attrition(self.tables.person, self.screened, self.cases, self.matches)

    @cached_property
    def attrition_bitmaps(self) -> DataFrame:
        """The persons behind each line of the attrition table, to be merged with those of other sites or increments."""
        return distinct.attrition_bitmaps(self.tables.person, self.screened, self.cases, self.matches)

    @cached_property
    def case_control(self) -> DataFrame:
        return self.scratch.cut_by(covariates.case_control_table(self.cases, self.matches, self.cohort), "case-control",
                                   *covariates.KEY)

    @cached_property
    def target_drugs(self) -> DataFrame:
        """Written once, for the exposures and the eras."""
        return self.scratch.cut(listed_events(self.tables.drug_exposure, "drug_concept_id", self.codes.target_drug), "target-drugs")

    @cached_property
    def exposures(self) -> DataFrame:
        return exposure.exposure_window(self.case_control, self.target_drugs, days=self.parameters.lookback_days,
                                        mode=self.parameters.exposure_mode)

    @cached_property
    def analysis(self) -> DataFrame:
        """One row per person and case, with every covariate, gender still as a concept."""
        exposures = self.scratch.cut_by(self.exposures, "exposures", *covariates.KEY)
        p = self.parameters
        table = covariates.analysis_table(
            self.case_control, exposure.recency_class(exposures, bins=p.recency_bins),
            exposure.continuous_use(exposures, gap=p.span_gap),
            covariates.condition_flags(self.case_control, self.tables.condition_occurrence,
                                       self.codes.comorbidity, self.codes.covariate_condition, days=p.lookback_days),
            covariates.class_flags(self.case_control, self.tables.drug_exposure, self.codes.covariate_drug,
                                   classes=p.drug_classes, days=p.lookback_days), bands=p.age_bands)
        return self.scratch.cut(table, "analysis")

    @cached_property
    def scored(self) -> DataFrame:
        """The analysis table with score, grade and gender as 0/1."""
        p = self.parameters
        return (covariates.comorbidity_score(self.analysis, weights=p.score_weights, cuts=p.score_cuts)
                .withColumn("gender_concept_id", covariates.recode_gender(F.col("gender_concept_id"), p.gender_code)))

    @cached_property
    def frequencies(self) -> DataFrame:
        return self.scratch.cut(summaries.frequency_table(self.scored), "frequencies")

    @cached_property
    def model_variables(self) -> DataFrame:
        return summaries.model_variables(self.frequencies)

    @cached_property
    def crude_odds(self) -> DataFrame:
        return clogit.crude_odds(self.scored, self.model_variables, candidates=MODEL_CANDIDATES)

    @cached_property
    def adjusted_odds(self) -> DataFrame:
        chosen = {row["variable"] for row in self.model_variables.collect()}   # at most 37 names
        return clogit.adjusted_odds(self.scored, [v for v in MODEL_CANDIDATES if v in chosen])

    @cached_property
    def exposed(self) -> DataFrame:
        return summaries.exposed_cases(self.analysis)

    @cached_property
    def eras(self) -> DataFrame:
        p = self.parameters
        drugs = of_persons(self.target_drugs, self.exposed)
        if p.era_block_days is not None:
            return exposure.scanned_eras(drugs, gap=p.era_gap, compare=p.era_compare, block_days=p.era_block_days)
        return exposure.drug_eras(drugs, gap=p.era_gap, compare=p.era_compare)

    @cached_property
    def near_eras(self) -> DataFrame:
        return self.scratch.cut(exposure.eras_near_index(self.eras, self.exposed, days=self.parameters.lookback_days), "eras")

    @cached_property
    def period(self) -> DataFrame:
        return exposure.exposure_period(self.near_eras, follow_up=self.parameters.follow_up_days)

    @cached_property
    def lab_summary(self) -> DataFrame:
        labs = self.scratch.cut(of_persons(self.labs, self.exposed), "exposed-labs")
        return summaries.lab_summary(labs, self.period)

    @cached_property
    def hormone_series(self) -> DataFrame:
        return summaries.before_after(self.near_eras, self.tables.measurement, column=self.hormone_column,
                                      code_sets=self.parameters.hormones, string_min=self.parameters.string_min)

    @cached_property
    def new_pairs(self) -> DataFrame:
        return diagnoses.new_diagnoses(self.tables.condition_occurrence, self.near_eras)

    @cached_property
    def new_codes(self) -> DataFrame:
        """Written once, for the list of codes and the chapters: a row per code, made from all conditions."""
        return self.scratch.cut(diagnoses.roll_up(self.new_pairs, self.tables.concept_relationship, self.tables.concept), "new-codes")

    @cached_property
    def new_chapters(self) -> DataFrame:
        return diagnoses.chapters(self.new_codes, mode=self.parameters.chapter_mode)

    @property
    def results(self) -> dict[str, DataFrame]:
        """Every result of the study under the name of its file."""
        return {
            "TABLE1": self.frequencies.orderBy("variable", "value"),
            "TABLE2": self.crude_odds.orderBy("variable"),
            "TABLE3": self.adjusted_odds,
            "diagram": self.attrition.orderBy("no"),
            "TSH_table": self.lab_summary,
            "t_series": self.hormone_series,
            "newdisease_topN": self.new_codes.orderBy(F.desc("n"), "ICD"),
            "newdisease_ICDchapter": self.new_chapters.orderBy(F.asc_nulls_last("Chapter")),
        }

    def publish_results(self, folder: str, site: str) -> ResultSet:
        """Write every result as CSV, all under one manifest, which replaces the set before only when everything is there."""
        published = ResultSet(self.spark, folder, site)
        published.publish(self.results)
        return published

    def write_results(self, folder: str, site: str) -> dict[str, str]:
        """Write every result as CSV (the three tables also as parquet) and return the paths."""
        results = self.results
        paths = {name: f"{folder}/{site}-{name}.csv" for name in results}
        for name, df in results.items():
            write_csv(df, paths[name])
            if name.startswith("TABLE"):
                write_table(df, f"{folder}/{site}-{name}.parquet")
        return paths

    def close(self) -> None:
        """Delete the written stages; the stages cannot be read afterwards."""
        self.scratch.close()
