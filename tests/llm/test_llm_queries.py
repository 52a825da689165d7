"""Corpus queries against their SQL twins, and the registry."""

from __future__ import annotations

import pytest
from compare import difference, duck
from conftest import DATA

import __spark_entry__ as entry
from cohortspark.llm.oracle import ORACLES
from cohortspark.llm.queries import QUERIES


def test_all_operators_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert set(QUERIES) <= names and "pipeline" in names
    assert {n.split("_")[0] for n in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert difference(QUERIES[name](spark, DATA), duck(DATA), ORACLES[name]) is None
