"""Studies with other parameters, executed plans, and code lists by column name."""

from __future__ import annotations

import re

import pytest
from compare import difference, duck
from conftest import DATA
from pyspark.sql import functions as F

from checks import oracle
from checks.binding import clinical_tables, code_lists
from cohortspark import constants as k
from cohortspark.operators import clogit, cohort, covariates, exposure, matching, summaries
from cohortspark.operators.intervals import dates_in_windows
from cohortspark.plans.parameters import StudyParameters
from cohortspark.plans.study import Study
from cohortspark.sources import csv_codes
from cohortspark.storage import Scratch


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_other_parameters_match_sql(spark, monkeypatch):
    p = StudyParameters(lower_limit=0.6, upper_limit=4.0, min_age=25, baseline_days=300, controls=2, age_band=8, entry_band=60,
                        lookback_days=150, age_bands=((25, 49), (50, 69)))
    study = Study(spark, clinical_tables(spark, DATA), code_lists(spark), parameters=p)
    changes = [("age >= 19", "age >= 25"), ("+ 364", "+ 300"), ("e.value > 4.5 OR e.value < 0.5", "e.value > 4.0 OR e.value < 0.6"),
               ("value > 4.5)", "value > 4.0)"), ("c.age - 5 AND c.age + 5", "c.age - 8 AND c.age + 8"),
               ("c.enroll_date - 30 AND c.enroll_date + 30", "c.enroll_date - 60 AND c.enroll_date + 60"), (", 1, 4) AS got", ", 1, 2) AS got")]
    steps = {}
    for name, text in oracle.STEPS.items():
        for old, new in changes:
            text = text.replace(old, new)
        steps[name] = text
    monkeypatch.setattr(oracle, "STEPS", steps)
    oracle.needs.cache_clear()
    con = duck(DATA)
    for stage, name in ((study.attrition.withColumn("number", F.col("number").cast("bigint")), "attrition"), (study.matches, "match_controls")):
        assert difference(stage, con, oracle.sql(oracle.TEXTS[name])) is None
    oracle.needs.cache_clear()
    bands = {r["agegr"] for r in study.analysis.select("agegr").distinct().collect()}
    assert bands <= {1, 2, 3}
    study.close()


def test_conditions_are_not_shuffled_by_concept(spark, tmp_path):
    conditions = str(tmp_path / "conditions")
    spark.range(200_000).selectExpr("id % 5000 AS person_id", "id % 9000 AS condition_concept_id",
                                    "date_add(DATE'2020-01-01', CAST(id % 300 AS INT)) AS condition_start_date").write.parquet(conditions)
    (spark.range(5000).selectExpr("id AS concept_id", *[f"CAST(id % 2 AS INT) AS {c}" for c in k.COMORBIDITIES])
     .write.csv(str(tmp_path / "cci"), header=True))
    spark.range(250).selectExpr("id AS concept_id", "1 AS dis1").write.csv(str(tmp_path / "dis"), header=True)
    from cohortspark.sources.codes import COMORBIDITY_SCHEMA, COVARIATE_CONDITION_SCHEMA
    anchors = spark.range(500).selectExpr("id AS person_id", "id AS case_number", "DATE'2020-09-01' AS indexdt2")
    flags = covariates.condition_flags(anchors, spark.read.parquet(conditions),
                                       csv_codes(spark, str(tmp_path / "cci"), COMORBIDITY_SCHEMA),
                                       csv_codes(spark, str(tmp_path / "dis"), COVARIATE_CONDITION_SCHEMA))
    plan = executed(flags)
    assert not re.search(r"Exchange hashpartitioning\(condition_concept_id", plan)


def test_one_scan_each(spark, study, tmp_path):
    measurement, eras, analysis = (str(tmp_path / n) for n in ("measurement", "eras", "analysis"))
    study.tables.measurement.write.parquet(measurement)
    study.near_eras.write.parquet(eras)
    study.scored.write.parquet(analysis)
    series = summaries.before_after(spark.read.parquet(eras), spark.read.parquet(measurement))
    assert plan_scans(series, "measurement") == 1 and plan_scans(series, "/eras") == 1
    scored = spark.read.parquet(analysis)
    for df in (clogit.stratum_counts(scored, ["allo", "CCI1"]), clogit.stratum_differences(scored, ["allo", "CCI1"])):
        assert plan_scans(df, "analysis") == 1


def plan_scans(df, name: str) -> int:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    files = [f for f in df.inputFiles() if name in f]
    assert files
    columns = {"measurement": "value_source_value", "/eras": "last_intake|start_date", "analysis": "case_number"}[name]
    return sum(bool(re.search(columns, line)) for line in plan.splitlines() if "Relation [" in line)


def test_labs_are_scanned_once_in_screen(spark, study, tmp_path):
    labs = str(tmp_path / "labs")
    study.labs.write.parquet(labs)
    t, scratch = study.tables, Scratch(spark)
    flags = cohort.screen(spark.read.parquet(labs), t.person, t.condition_occurrence.limit(0), t.procedure_occurrence.limit(0),
                          t.drug_exposure.limit(0), scratch=scratch)
    assert not any(labs in f for f in flags.inputFiles())   # all later reads are of the written entry dates
    scratch.close()


def test_code_lists_by_header_name(spark, tmp_path):
    path = str(tmp_path / "codes.csv")
    with open(path, "w") as f:
        f.write("note,drname,concept_id\nx,statin,5\ny,NA,6\nz,other,NA\n")
    rows = csv_codes(spark, path, "concept_id bigint, drname string").collect()
    assert sorted((r["concept_id"], r["drname"]) for r in rows if r["concept_id"]) == [(5, "statin"), (6, None)]
    with pytest.raises(ValueError, match="dis1"):
        csv_codes(spark, path, "concept_id bigint, dis1 int")


def test_separated_variable_leaves_the_others_their_estimates(spark):
    import random
    rng = random.Random(3)
    draw = lambda q: int(rng.random() < q)
    rows = []
    for n in range(200):
        c = int(n % 10 == 0)   # only ever in cases
        rows.append((n, 1, draw(0.5), draw(0.45), c))
        rows += [(n, 0, draw(0.35), draw(0.35), 0) for _ in range(3)]
    df = spark.createDataFrame(rows, "case_number bigint, TSH int, a int, b int, c int")
    fits = {r["variable"]: r for r in clogit.adjusted_odds(df, ["a", "b", "c"]).collect()}
    assert fits["c"]["converged"] is False and fits["c"]["estimate"] is None
    # Strata whose case alone has c say nothing more once c runs off.
    limit = {r["variable"]: r for r in clogit.adjusted_odds(df.filter("case_number % 10 <> 0"), ["a", "b"]).collect()}
    for v in "ab":
        assert fits[v]["converged"] and fits[v]["estimate"] == pytest.approx(limit[v]["estimate"], abs=1e-4)
        assert fits[v]["std_error"] == pytest.approx(limit[v]["std_error"], abs=1e-4)


def test_ties_and_laboratory_summary_read_their_rows_once(spark, study):
    from cohortspark.operators.relational import group_extreme

    plan = executed(group_extreme(study.labs, "person_id", "value", largest=True))
    assert "WindowGroupLimit" in plan and plan.count("Scan") == 1 and "Join" not in plan


def broadcast_keys(df):
    """The first join key of every join in the plan that sends a side to all tasks."""
    return re.findall(r"BroadcastHashJoin \[(\w+)#", df._jdf.queryExecution().executedPlan().toString())


def test_tables_of_persons_and_events_are_not_broadcast(study):
    """However small they are here: by the size of their files they would be sent up to a size that strains the driver."""
    t = study.tables
    cases, pool = (matching._on_grid(x) for x in (study.cases, study.pool))
    served = matching._served(cases, pool, ("gender_concept_id",), 2, 90, 4)
    plans = {
        "screen": cohort.screen(study.labs, t.person, t.condition_occurrence, t.procedure_occurrence, t.drug_exposure),
        "pool": matching.control_pool(study.cohort, study.cases), "counts": matching.candidate_counts(study.cases, study.pool),
        "positions": matching._positions(pool, ["gender_concept_id"]), "served": served,
        "case_control": covariates.case_control_table(study.cases, study.matches, study.cohort),
        "exposures": study.exposures, "overlap": exposure.exposure_window(study.case_control, study.target_drugs, mode="overlap"),
        "eras": exposure.eras_near_index(study.eras, study.exposed), "period": summaries.labs_in_period(study.labs, study.period),
        "series": summaries.before_after(study.near_eras, t.measurement), "pairs": study.new_pairs}
    grows = {"person_id", "case_number", "l_orderkey", "o_orderkey", "o_custkey", "gender_concept_id"}
    assert {name: sent for name, df in plans.items() if (sent := grows & set(broadcast_keys(df)))} == {}


def test_rounds_of_the_matching_are_not_broadcast(study):
    cases, pool = (matching._on_grid(x) for x in (study.cases, study.pool))
    served = matching._served(cases, pool, ("gender_concept_id",), 2, 90, 4)
    asked = matching._round(served, None, None, ["gender_concept_id"], seed=1, page=32, controls=4)
    later = matching._round(served, asked, asked, ["gender_concept_id"], seed=1, page=32, controls=4)
    assert not {"case_number", "gender_concept_id"} & set(broadcast_keys(later))


def test_new_codes_are_made_once(study):
    """The chapters read the written list of codes, not the conditions again."""
    plan = study.new_chapters._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" not in plan and "condition_concept_id" not in plan


def test_events_meet_only_windows_of_their_person(spark):
    """Null and repeated keys: the events left out early are those that meet no window anyway."""
    anchors = spark.createDataFrame([(1, 10, 20), (1, 10, 20), (2, 5, 6), (None, 1, 90)], "person_id long, a int, b int")
    events = spark.createDataFrame([(1, 15), (1, 15), (1, 21), (2, 5), (3, 15), (None, 15), (2, None)], "person_id long, d int")
    dated = events.select("person_id", F.date_from_unix_date("d").alias("day"))
    met = dates_in_windows(anchors, dated, ["day"], F.date_from_unix_date("a"), F.date_from_unix_date("b"), width=7)
    assert sorted(tuple(r) for r in met.select("person_id", F.unix_date("day")).collect()) == [(1, 15)] * 4 + [(2, 5)]
