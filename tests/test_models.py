"""Conditional models: closed forms, numeric derivatives and degenerate data."""

from __future__ import annotations

import itertools
import math
import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from cohortspark.operators import clogit, summaries


def matched(spark, strata, names):
    """Rows from strata given as (case vector, [control vectors])."""
    rows = []
    for number, (case, controls) in enumerate(strata, start=1):
        rows.append((number, 1, *case))
        rows += [(number, 0, *c) for c in controls]
    return spark.createDataFrame(rows, "case_number bigint, TSH int, " + ", ".join(f"{n} int" for n in names))


def random_strata(seed, n, p, sizes=(0, 4)):
    rng = random.Random(seed)
    draw = lambda q: tuple(int(rng.random() < q) for _ in range(p))
    return [(draw(0.5), [draw(0.35) for _ in range(rng.randint(*sizes))]) for _ in range(n)]


def test_pairs_give_the_ratio_of_discordant_pairs(spark):
    strata = [((1,), [(0,)])] * 30 + [((0,), [(1,)])] * 12 + [((1,), [(1,)])] * 5 + [((0,), [(0,)])] * 9
    row = clogit.crude_odds(matched(spark, strata, ["x"]), ["x"]).first()
    assert row["OR"] == pytest.approx(30 / 12) and row["converged"]
    assert row["std_error"] == pytest.approx(math.sqrt(1 / 30 + 1 / 12))
    assert row["lower_ci"] == pytest.approx(math.exp(row["estimate"] - 1.96 * row["std_error"]))
    assert row["p_value"] == pytest.approx(math.erfc(abs(row["statistic"]) / math.sqrt(2)))


def test_crude_and_adjusted_agree_on_one_variable(spark):
    df = matched(spark, random_strata(3, 120, 1), ["x"])
    crude, adjusted = clogit.crude_odds(df, ["x"]).first(), clogit.adjusted_odds(df, ["x"]).first()
    assert crude["estimate"] == pytest.approx(adjusted["estimate"], abs=1e-7)
    assert crude["std_error"] == pytest.approx(adjusted["std_error"], abs=1e-7)


def log_likelihood(strata, beta):
    total = 0.0
    for case, controls in strata:
        scores = [np.dot(case, beta)] + [np.dot(c, beta) for c in controls]
        total += scores[0] - math.log(sum(math.exp(s) for s in scores))
    return total


def test_likelihood_and_derivatives_match_numeric_ones(spark):
    strata, beta, h = random_strata(5, 60, 3), np.array([0.3, -0.2, 0.7]), 1e-5
    sets = clogit.stratum_differences(matched(spark, strata, "abc"), list("abc"))
    value, score, information = clogit.likelihood_at(sets, beta)
    # Sets in which all covariates are equal add the same constant at every point, and are left out.
    change = value - clogit.likelihood_at(sets, np.zeros(3))[0]
    assert change == pytest.approx(log_likelihood(strata, beta) - log_likelihood(strata, np.zeros(3)))
    for j in range(3):
        e = np.eye(3)[j] * h
        assert score[j] == pytest.approx((log_likelihood(strata, beta + e) - log_likelihood(strata, beta - e)) / (2 * h), abs=1e-5)
        up, down = clogit.likelihood_at(sets, beta + e)[1], clogit.likelihood_at(sets, beta - e)[1]
        assert information[j] == pytest.approx(-(up - down) / (2 * h), abs=1e-4)


def test_adjusted_estimate_is_the_maximum(spark):
    strata = random_strata(8, 150, 3)
    rows = clogit.adjusted_odds(matched(spark, strata, "abc"), list("abc")).collect()
    assert [r["variable"] for r in rows] == list("abc") and all(r["converged"] for r in rows)
    best = np.array([r["estimate"] for r in rows])
    for j in range(3):
        for delta in (0.01, -0.01):
            assert log_likelihood(strata, best + np.eye(3)[j] * delta) < log_likelihood(strata, best)


def test_separated_variable_has_no_estimate(spark):
    df = matched(spark, [((1,), [(0,), (0,)])] * 6, ["x"])
    for row in (clogit.crude_odds(df, ["x"]).first(), clogit.adjusted_odds(df, ["x"]).first()):
        assert row["converged"] is False and row["estimate"] is None and row["OR"] is None


def test_dependent_column_has_no_estimate(spark):
    strata = [((a, a), [(b, b) for (b,) in controls]) for (a,), controls in random_strata(11, 80, 1)]
    rows = {r["variable"]: r for r in clogit.adjusted_odds(matched(spark, strata, "ab"), ["a", "b"]).collect()}
    assert rows["a"]["converged"] and rows["b"]["estimate"] is None


def test_strata_without_controls_or_variation_change_nothing(spark):
    strata = random_strata(13, 80, 1, sizes=(1, 4))
    more = strata + [((1,), [])] * 5 + [((1,), [(1,)])] * 5
    one, two = (clogit.crude_odds(matched(spark, s, ["x"]), ["x"]).first() for s in (strata, more))
    assert one["estimate"] == pytest.approx(two["estimate"])
    assert clogit.crude_odds(matched(spark, [((1,), [])], ["x"]), ["x"]).first()["converged"] is False


def enumerated(strata, beta):
    """Log likelihood from its definition: (case vectors, control vectors) per stratum, all choices of as many members."""
    total = 0.0
    for cases, controls in strata:
        members = [*cases, *controls]
        own = sum(np.dot(c, beta) for c in cases)
        total += own - math.log(sum(math.exp(sum(np.dot(m, beta) for m in chosen)) for chosen in itertools.combinations(members, len(cases))))
    return total


def several(spark, strata, names):
    rows = []
    for number, (cases, controls) in enumerate(strata, start=1):
        rows += [(number, 1, *c) for c in cases] + [(number, 0, *c) for c in controls]
    return spark.createDataFrame(rows, "case_number bigint, TSH int, " + ", ".join(f"{n} int" for n in names))


def random_sets(seed, n, p):
    rng = random.Random(seed)
    draw = lambda q: tuple(int(rng.random() < q) for _ in range(p))
    return [([draw(0.5) for _ in range(rng.randint(0, 4))], [draw(0.35) for _ in range(rng.randint(0, 5))]) for _ in range(n)]


def test_several_cases_match_enumeration_of_all_choices(spark):
    strata, h = random_sets(4, 80, 3), 1e-5
    strata += strata[:20] + [(c[::-1], d[::-1]) for c, d in strata[:10]]   # equal sets are counted together in any order
    df = several(spark, strata, "abc")
    sets = clogit.stratum_differences(df, list("abc")).cache()
    for beta in (np.zeros(3), np.array([0.4, -0.7, 1.1])):
        value, score, information = clogit.likelihood_at(sets, beta)
        change = value - clogit.likelihood_at(sets, np.zeros(3))[0]
        assert change == pytest.approx(enumerated(strata, beta) - enumerated(strata, np.zeros(3)))
        for j in range(3):
            e = np.eye(3)[j] * h
            assert score[j] == pytest.approx((enumerated(strata, beta + e) - enumerated(strata, beta - e)) / (2 * h), abs=1e-4)
            up, down = clogit.likelihood_at(sets, beta + e)[1], clogit.likelihood_at(sets, beta - e)[1]
            assert information[j] == pytest.approx(-(up - down) / (2 * h), abs=1e-3)
    sets.unpersist()
    rows = clogit.adjusted_odds(df, list("abc")).collect()
    best = np.array([r["estimate"] for r in rows])
    for j in range(3):
        for delta in (0.01, -0.01):
            assert enumerated(strata, best + np.eye(3)[j] * delta) < enumerated(strata, best)


def test_crude_models_of_several_cases(spark):
    strata = random_sets(6, 60, 1)
    df = several(spark, strata, "x")
    crude, adjusted = clogit.crude_odds(df, ["x"]).first(), clogit.adjusted_odds(df, ["x"]).first()
    assert crude["estimate"] == pytest.approx(adjusted["estimate"], abs=1e-6)
    assert crude["std_error"] == pytest.approx(adjusted["std_error"], abs=1e-6)
    # One stratum of all persons: the conditional estimate of a two by two table, by its definition.
    df = several(spark, [([(1,)] * 7 + [(0,)] * 5, [(1,)] * 4 + [(0,)] * 9)], "x")
    row = clogit.crude_odds(df, ["x"]).first()
    ways = {d: math.comb(11, d) * math.comb(14, 12 - d) for d in range(12)}
    mean = lambda b: sum(d * w * math.exp(b * d) for d, w in ways.items()) / sum(w * math.exp(b * d) for d, w in ways.items())
    assert mean(row["estimate"]) == pytest.approx(7, abs=1e-6) and row["converged"]


def test_strata_without_case_or_control_say_nothing(spark):
    base = random_sets(8, 30, 2)
    more = [*base, ([], [(1, 0), (0, 1)]), ([(1, 1), (0, 1)], []), ([(1, 0), (1, 0)], [(1, 0)])]
    for fit in (clogit.crude_odds, clogit.adjusted_odds):
        one, two = (sorted((r["variable"], r["estimate"]) for r in fit(several(spark, s, "ab"), ["a", "b"]).collect()) for s in (base, more))
        assert [v for v, _ in one] == ["a", "b"] and [x for _, x in one] == pytest.approx([x for _, x in two])


def test_kernels_need_nothing_but_numpy_and_arrow_on_the_executors(tmp_path):
    kernels = [clogit._newton_per_variable(20, 1e-9), clogit._partial_sums(2, np.zeros(2))]
    file = tmp_path / "kernels"
    file.write_bytes(cloudpickle.dumps(kernels))
    load = "import pickle, sys; pickle.load(open(sys.argv[1], 'rb'))"
    subprocess.run([sys.executable, "-c", load, str(file)], cwd=tmp_path, check=True,
                   env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {
                       "PYTHONPATH": os.pathsep.join(p for p in sys.path if "repo" not in p)})


def test_empty_model(spark):
    assert clogit.adjusted_odds(matched(spark, random_strata(1, 5, 1), ["x"]), []).count() == 0


def test_frequency_table_fills_empty_cells_and_drops_missing(spark):
    df = spark.createDataFrame([(0, 1, None), (0, 0, 2), (1, 0, 2)], "TSH int, a int, b int")
    rows = {(r["variable"], r["value"]): r for r in summaries.frequency_table(df, variables=["a", "b"]).collect()}
    assert set(rows) == {("a", "0"), ("a", "1"), ("b", "2")}
    assert (rows["a", "1"]["control"], rows["a", "1"]["patient"], rows["a", "1"]["patient_ratio"]) == (1, 0, 0.0)
    assert [r["variable"] for r in summaries.model_variables(summaries.frequency_table(df, variables=["a", "b"])).collect()] == []
