"""A study on tables and code lists read from files, as a user would run it."""

from __future__ import annotations

from dataclasses import fields

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from checks.binding import clinical_tables, code_lists
from cohortspark.operators import summaries
from cohortspark.plans.study import Study
from cohortspark.sources import (ClinicalTables, CodeLists, ResultSet, csv_codes, dynamic_codes, in_codes, literal_codes, run_template,
                                 write_csv, write_table)
from cohortspark.sources import files as result_files
from cohortspark.storage import Scratch


def test_study_from_files(spark, study, tmp_path):
    tables, codes = clinical_tables(spark, DATA), code_lists(spark)
    for field in fields(tables):
        write_table(getattr(tables, field.name), str(tmp_path / f"{field.name}.parquet"))
    for field in fields(codes):
        write_csv(getattr(codes, field.name), str(tmp_path / f"{field.name}.csv"))
    read = CodeLists.from_csv(spark, **{f.name: str(tmp_path / f"{f.name}.csv") for f in fields(codes)})
    assert read.comorbidity.filter("CCI1 IS NULL").count() == codes.comorbidity.filter("CCI1 IS NULL").count() > 0
    again = Study(spark, ClinicalTables.from_parquet(spark, str(tmp_path)), read)
    for stage in ("attrition", "matches", "frequencies"):
        one, two = (sorted(map(tuple, getattr(s, stage).collect()), key=str) for s in (again, study))
        assert one == two


def test_catalog_tables(spark):
    for field in fields(ClinicalTables):
        spark.range(1).createOrReplaceGlobalTempView(field.name)
    tables = ClinicalTables.from_catalog(spark, "global_temp")
    assert tables.person.count() == 1
    for field in fields(ClinicalTables):
        spark.catalog.dropGlobalTempView(field.name)


def test_missing_concepts_never_match(spark):
    events = spark.createDataFrame([(1, 5, "5"), (2, None, None), (3, 6, "6")], "id int, code bigint, text string")
    codes = spark.createDataFrame([(5,), (None,)], "concept_id bigint")
    assert [r["id"] for r in in_codes(events, "code", codes).collect()] == [1]
    assert [r["id"] for r in dynamic_codes(events, "text", literal_codes(spark, [6])).collect()] == [3]


def test_small_lists_are_broadcast_by_their_known_size(spark):
    big = spark.range(10_000_000).withColumnRenamed("id", "code")
    plan = in_codes(big, "code", literal_codes(spark, [1, 2, 3]))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_before_value_by_text_and_by_number(spark):
    eras = spark.createDataFrame([(1, "2020-05-01", "2020-06-01"), (1, "2020-08-01", "2020-06-01")],
                                 "person_id bigint, start_date string, index_date string")
    eras = eras.withColumns({c: F.col(c).cast("date") for c in ("start_date", "index_date")})
    tests = spark.createDataFrame(
        [(1, 1, 7, "2020-01-01", "10.0"), (2, 1, 7, "2020-01-01", "9.0"), (3, 1, 7, "2020-07-01", "3 u"),
         (4, 1, 7, "2020-07-02", "<4"), (5, 1, 8, "2020-09-01", "1")],
        "measurement_id bigint, person_id bigint, measurement_concept_id bigint, d string, value_source_value string")
    tests = tests.withColumn("measurement_date", F.col("d").cast("date")).drop("d")
    def series(**options):
        rows = summaries.before_after(eras, tests, code_sets={"A": [7], "B": [8]}, **options).collect()
        return {r["name"]: (r["value"], r["n"]) for r in rows}
    assert series() == {"A_1": (9.0, 1), "A_2": (4.0, 1), "B_1": (None, 0), "B_2": (1.0, 1)}
    assert series(string_min=True)["A_1"] == (10.0, 1)


def test_unreadable_codes_are_named_and_counted(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("name,concept_id\nx, 12 \ny,NA\nz,\nw,7\n")
    assert sorted((r[0] for r in csv_codes(spark, str(good)).collect()), key=str) == [12, 7, None, None]
    bad.write_text("concept_id,dis1\n1,1\n12x,0\n3.5,yes\n")
    with pytest.raises(ValueError, match=r"bad.csv has 2 lines with an unreadable concept_id such as '12x'"):
        csv_codes(spark, str(bad))
    with pytest.raises(ValueError, match=r"2 lines with an unreadable concept_id .* and 1 lines with an unreadable dis1 such as 'yes'"):
        csv_codes(spark, str(bad), "concept_id bigint, dis1 int")


def test_templates_bind_values_and_refuse_what_is_no_column(spark):
    events = spark.createDataFrame([(1, "a", 5), (2, "b' OR '1' = '1", 6), (3, None, 7)], "id int, code string, other int")
    text = "SELECT id FROM {events} WHERE array_contains(:codes, IDENTIFIER(:column)) AND other < :most"

    def ids(column, codes, most=100):
        return sorted(r["id"] for r in run_template(spark, text, {"events": events}, {"column": column}, codes=codes, most=most).collect())
    assert ids("code", ["a"]) == [1] and ids("code", ["a"], 5) == [] and ids("other", [6, 7]) == [2, 3]
    assert ids("code", ["' OR true --", "b' OR '1' = '1"]) == [2]   # values are values
    for hostile in ("code) OR (true", "code`", "a.b", "", "code -- ", "code; DROP TABLE x"):
        with pytest.raises(ValueError):
            ids(hostile, ["a"])


def test_results_are_published_together_or_not_at_all(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    one = spark.createDataFrame([(1, "x", 0.1), (1, "x", 0.1), (None, None, None)], "a int, b string, c double")
    results = ResultSet(spark, folder, "SITE")
    with pytest.raises(FileNotFoundError):
        results.read("one")
    results.publish({"one": one, "two": one.limit(1)})
    read = lambda r: sorted(map(tuple, r.read("one").collect()), key=str)
    before = read(results)
    assert before == sorted(map(tuple, one.collect()), key=str) and results.version() == 1

    written = []
    real = result_files.write_csv

    def dies(df, path):
        if written:
            raise OSError("lost")
        written.append(path)
        real(df, path)
    monkeypatch.setattr(result_files, "write_csv", dies)
    with pytest.raises(OSError):
        results.publish({"one": one.limit(0), "two": one})
    monkeypatch.setattr(result_files, "write_csv", real)
    again = ResultSet(spark, folder, "SITE")
    assert written and again.version() == 1 and read(again) == before   # the old set is whole

    again.publish({"one": one.limit(0), "two": one})
    assert again.version() == 2 and again.read("one").count() == 0
    assert again.read("one", version=1).count() == 3
    path = again.manifest().filter("name = 'two'").first()["path"]
    one.limit(2).write.mode("append").csv(path, header=True, nullValue="NA")
    with pytest.raises(ValueError, match="not what was published"):
        again.read("two")


def test_tables_laid_out_by_person_need_no_exchange(spark):
    from cohortspark.operators import cohort, exposure
    from cohortspark.plans.study import Study

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    scratch = Scratch(spark)
    laid_out = Study(spark, clinical_tables(spark, DATA).by_person(scratch), code_lists(spark))
    try:
        def exchanges(df):
            return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        t = laid_out.tables
        assert exchanges(cohort.cohort_entry(laid_out.labs)) == 0
        assert exchanges(cohort.screen(laid_out.labs, t.person, t.condition_occurrence, t.procedure_occurrence, t.drug_exposure)) == 0
        assert exchanges(laid_out.cohort.join(laid_out.labs.groupBy("person_id").agg(F.max("value")), "person_id")) == 0
        exposures = scratch.cut_by(laid_out.exposures, "exposures", "person_id", "case_number")
        table = laid_out.case_control
        for part in (exposure.recency_class(exposures), exposure.continuous_use(exposures)):
            table = table.join(part, ["person_id", "case_number"], "left")
        assert exchanges(table) == 0
        again = sorted(map(tuple, laid_out.screened.collect()), key=str)
        assert again == sorted(map(tuple, Study(spark, clinical_tables(spark, DATA), code_lists(spark)).screened.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        laid_out.close()
        scratch.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(scratch.root.rsplit("/", 1)[1].replace("-", "_"))]


def test_short_lists_reach_the_scan_and_change_nothing(spark, study, tmp_path):
    from cohortspark.sources import listed_events

    stored = str(tmp_path / "measurement")
    study.tables.measurement.write.parquet(stored)
    events, results = spark.read.parquet(stored), []
    for most, pushed in ((1000, True), (0, False)):
        df = listed_events(events, "measurement_concept_id", study.codes.lab, most=most)
        results.append(sorted(map(tuple, df.collect()), key=str))
        plan = df._jdf.queryExecution().executedPlan().toString()
        filters = plan.split("PushedFilters")[1]
        assert ("In(measurement_concept_id" in filters) == pushed and ("Join" in plan) != pushed
        assert pushed or ("GreaterThanOrEqual(measurement_concept_id" in filters and "LessThanOrEq" in filters)   # the text is cut short
    assert results[0] == results[1] == sorted(
        map(tuple, in_codes(events, "measurement_concept_id", study.codes.lab).select(*events.columns).collect()), key=str)
    nobody = spark.createDataFrame([(None,)], "concept_id bigint")
    assert listed_events(events, "measurement_concept_id", nobody).count() == 0
    small = spark.createDataFrame([(1,), (2,), (None,)], "concept int")
    wide = spark.createDataFrame([(2,), (2 ** 40,), (-2 ** 40,), (None,)], "concept_id bigint")
    assert all([r[0] for r in listed_events(small, "concept", wide, most=most).collect()] == [2] for most in (1000, 0))
