"""Every registered query against its SQL twin, and the published counts of the whole funnel."""

from __future__ import annotations

import os

import pytest
from compare import difference, duck
from conftest import DATA

import __spark_entry__ as entry
from checks.oracle import ORACLES
from checks.queries import QUERIES, study_of


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


def test_every_oracle_has_a_query():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"adjusted_odds_ratios"}))
def test_query_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, DATA), con, ORACLES[name]) is None


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the sf0.01 tables")
def test_adjusted_model_matches_sql(spark):
    """On sf0.01, where no variable is separated."""
    name, folder = "adjusted_odds_ratios", "/root/testdata/sf0.01"
    assert difference(QUERIES[name](spark, folder), duck(folder), ORACLES[name]) is None


def test_entry_is_the_attrition_table(spark):
    numbers = [r["number"] for r in entry.entry(spark).orderBy("no").collect()]
    assert numbers == [150, 149, 104, 97, 93, 85, 81, 74, 9, 7]


def test_adjusted_odds_have_one_row_per_variable(spark):
    names = {r["variable"] for r in QUERIES["model_variable_list"](spark, DATA).collect()}
    rows = QUERIES["adjusted_odds_ratios"](spark, DATA).collect()
    assert {r["variable"] for r in rows} == names
    assert all((r["estimate"] is None) != r["converged"] for r in rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the sf0.01 tables")
def test_exclusion_modes_differ(spark):
    one, two = (QUERIES[n](spark, "/root/testdata/sf0.01").count() for n in ("exclude_drug_in_window", "exclude_drug_overlap"))
    assert (one, two) == (997, 995)


def test_separated_variable_is_reported_without_estimate(spark):
    row = QUERIES["crude_odds_ratios"](spark, DATA).filter("variable = 'allo'").first()
    assert row["converged"] is False and row["OR"] is None


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the sf0.01 tables")
def test_counts_at_sf001(spark):
    study = study_of(spark, "/root/testdata/sf0.01")
    numbers = [r["number"] for r in study.attrition.orderBy("no").collect()]
    assert numbers == [1500, 1494, 1027, 952, 907, 840, 814, 759, 78, 223]
    assert study.labs.count() == 8970
    assert study.pool.count() == 681
    sizes = study.matches.groupBy("case_number").count().groupBy("count").count().collect()
    assert {r[0]: r[1] for r in sizes} == {1: 10, 2: 8, 3: 7, 4: 44}
    assert study.case_control.count() == 301
    assert study.exposures.count() == 215
    assert study.eras.count() == 344
    assert study.near_eras.count() == 164
    assert study.new_pairs.count() == 391
    assert study.new_codes.count() == 172
    allo = study.crude_odds.filter("variable = 'allo'").first()
    assert (round(allo["estimate"], 6), round(allo["std_error"], 6)) == (0.221489, 0.296905)


def test_results_are_written(spark, study, tmp_path):
    paths = study.write_results(str(tmp_path), "SITE")
    assert set(paths) == {"TABLE1", "TABLE2", "TABLE3", "diagram", "TSH_table", "t_series", "newdisease_topN",
                          "newdisease_ICDchapter"}
    diagram = spark.read.csv(paths["diagram"], header=True)
    assert diagram.columns == ["no", "name", "number"] and diagram.count() == 10
    table1 = spark.read.parquet(paths["TABLE1"].replace(".csv", ".parquet"))
    assert table1.count() == study.frequencies.count()
