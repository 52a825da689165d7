"""Conditional logistic regression on matched sets, with the exact likelihood.

A stratum with m members and k cases contributes exp(sum of x over the cases . b), divided by the sum of that over all
choices of k members. Both models first shrink the data to counts: a crude model needs only (stratum size, cases, exposed
members, exposed cases), where the number of exposed cases is a noncentral hypergeometric variable; an adjusted one the
distinct sets of covariate differences to the cases' mean, where the sum over choices follows by a recursion over the members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RUNS_OFF = 1e-2   # an estimate that moves so much while the likelihood does not has no maximum
_Z = 1.96  # Fixed value: the normal quantile of the 95 % interval.
_COEFFICIENTS = "estimate double, std_error double, statistic double, p_value double, converged boolean"


def _coefficient_rule():
    """How a fit becomes a coefficient row. Made inside a function so that it travels to the executors by value."""
    def row(estimate: float, information: float, converged: bool) -> dict:
        if not converged:
            return {"estimate": None, "std_error": None, "statistic": None, "p_value": None, "converged": False}
        error = 1 / math.sqrt(information)
        z = estimate / error
        return {"estimate": estimate, "std_error": error, "statistic": z,
                "p_value": math.erfc(abs(z) / math.sqrt(2)), "converged": True}
    return row


def _exposed_case_rule():
    """Mean and variance of the number of exposed cases per row of counts. Made inside a function so that it travels by value."""
    def moments(beta: float, cases: np.ndarray, m: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        odds = e * math.exp(beta)
        mean = odds / (odds + m - e)
        variance = mean * (1 - mean)
        for i in np.flatnonzero(cases > 1):
            k, size, exposed = int(cases[i]), int(m[i]), int(e[i])
            d = np.arange(max(0, k - size + exposed), min(k, exposed) + 1)
            weight = np.array([math.lgamma(exposed + 1) - math.lgamma(x + 1) - math.lgamma(exposed - x + 1) + math.lgamma(size - exposed + 1)
                               - math.lgamma(k - x + 1) - math.lgamma(size - exposed - k + x + 1) for x in d.tolist()]) + d * beta
            weight = np.exp(weight - weight.max())
            mean[i] = (weight * d).sum() / weight.sum()
            variance[i] = (weight * (d - mean[i]) ** 2).sum() / weight.sum()
        return mean, variance
    return moments


def odds_ratio(estimate: Column, error: Column) -> dict[str, Column]:
    """Odds ratio and its 95 % interval."""
    return {"OR": F.exp(estimate), "lower_ci": F.exp(estimate - _Z * error), "upper_ci": F.exp(estimate + _Z * error)}


def stratum_counts(df: DataFrame, variables: Sequence[str], *, outcome: str = "TSH",
                   strata: str = "case_number") -> DataFrame:
    """Number of strata per variable, stratum size m, number of cases, exposed members e and exposed cases d; sets that
    cannot inform the model (without cases or controls, or all members alike) are left out."""
    sums = [F.expr(f"struct(sum(int({v} = 1)) AS e, sum(int({v} = 1 AND {outcome} = 1)) AS d) AS {v}")
            for v in variables]
    per_stratum = df.groupBy(strata).agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col(outcome) == 1).alias("cases"),
                                         *sums)
    tall = ", ".join(f"struct('{v}' AS variable, {v}.e, {v}.d)" for v in variables)
    return (per_stratum.selectExpr("m", "cases", f"inline(array({tall}))")
            .filter((F.col("cases") > 0) & (F.col("cases") < F.col("m")) & (F.col("e") > 0) & (F.col("e") < F.col("m")))
            .groupBy("variable", "cases", "m", "e", "d").agg(F.count(F.lit(1)).alias("n")))


def crude_odds(df: DataFrame, variables: DataFrame | Sequence[str], *, outcome: str = "TSH",
               strata: str = "case_number", candidates: Sequence[str] | None = None, max_iter: int = 20,
               tol: float = 1e-9) -> DataFrame:
    """One-variable models of binary variables: estimate, odds ratio and interval of each.

    ``variables`` are names, or a table of names chosen among ``candidates``; the choice is then made by a join.
    """
    names = list(candidates) if candidates is not None else list(variables)
    counts = stratum_counts(df, names, outcome=outcome, strata=strata)
    if candidates is not None:
        counts = counts.join(variables, "variable", "left_semi")

    newton = _newton_per_variable(max_iter, tol)
    fits = counts.groupBy("variable").applyInArrow(newton, f"variable string, {_COEFFICIENTS}")
    if candidates is not None:
        listed = variables
    else:
        listed = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in names])).alias("variable"))
    return _finish(listed.join(fits, "variable", "left").withColumn("converged", F.coalesce("converged", F.lit(False))))


def _newton_per_variable(max_iter: int, tol: float):
    """Newton steps on the counts of one variable: few rows, however many strata they stand for."""
    coefficient, moments = _coefficient_rule(), _exposed_case_rule()
    schema = pa.schema([("variable", pa.string()), ("estimate", pa.float64()), ("std_error", pa.float64()),
                        ("statistic", pa.float64()), ("p_value", pa.float64()), ("converged", pa.bool_())])

    def newton(rows: pa.Table) -> pa.Table:
        name = rows.column("variable")[0].as_py()
        cases, n, m, e, d = (rows.column(c).to_numpy().astype(float) for c in ("cases", "n", "m", "e", "d"))
        beta, information, converged = 0.0, 0.0, False
        for _ in range(max_iter):
            share, spread = moments(beta, cases, m, e)
            information = float((n * spread).sum())
            if information < tol:
                break
            step = float((n * (d - share)).sum()) / information
            if abs(beta + step) > 500:
                break
            beta += step
            if abs(step) <= tol * max(1.0, abs(beta)):
                converged = True
                break
        return pa.Table.from_pylist([{"variable": name, **coefficient(beta, information, converged)}], schema=schema)
    return newton


def _finish(fits: DataFrame) -> DataFrame:
    return (fits.withColumns({"level": F.lit("1"), **odds_ratio(F.col("estimate"), F.col("std_error"))})
            .select("variable", "level", "OR", "lower_ci", "upper_ci", "estimate", "std_error", "statistic",
                    "p_value", "converged"))


def stratum_differences(df: DataFrame, variables: Sequence[str], *, outcome: str = "TSH",
                        strata: str = "case_number") -> DataFrame:
    """Distinct sets of covariate differences with the number of cases and of strata that show them.

    With one case a set holds the controls minus the case, which itself is 0. With more it holds all members minus the mean of
    the cases, so that a choice of as many members as there are cases weighs exp of its sum. A stratum has the size that the
    matching gave it; one without a case or without a control says nothing.
    """
    x = F.expr("array(" + ", ".join(f"double({v})" for v in variables) + ")")
    case = F.col(outcome) == 1
    rows = df.select(strata, case.alias("_case"), x.alias("_x")).filter(~F.exists("_x", F.isnull))
    members = rows.groupBy(strata).agg(
        F.collect_list(F.when(F.col("_case"), F.col("_x"))).alias("_of_cases"),
        F.collect_list(F.when(~F.col("_case"), F.col("_x"))).alias("_of_controls")).filter(F.size("_of_cases") > 0)
    cases = F.size("_of_cases")
    # Cases are added up in sorted order, so that equal strata have equal sums.
    center = F.transform(F.aggregate(F.slice(F.array_sort("_of_cases"), F.lit(2), cases), F.array_min("_of_cases"),
                                     lambda a, b: F.zip_with(a, b, lambda x, y: x + y)), lambda x: x / cases)
    compared = F.when(cases == 1, F.col("_of_controls")).otherwise(F.concat("_of_cases", "_of_controls"))
    differences = F.array_sort(F.transform(compared, lambda member: F.zip_with(member, "_center", lambda a, b: a - b)))
    informative = F.exists("differences", lambda z: F.exists(z, lambda v: v != 0)) & (F.size("_of_controls") > 0)
    return (members.withColumn("_center", center).withColumn("differences", differences).filter(informative)
            .groupBy(cases.alias("cases"), "differences").agg(F.count(F.lit(1)).alias("n")))


def _partial_sums(p: int, beta: np.ndarray):
    """Per-partition log likelihood, score and information at ``beta``; vectorised over the one-case strata of a batch."""
    def several(z: np.ndarray, k: int) -> tuple[float, np.ndarray, np.ndarray]:
        """Logarithm, gradient and second derivative of the sum over all choices of k members: the sum for j members grows by
        those with the next member in place of the last one chosen."""
        eta = z @ beta
        top = float(eta.max())
        weight = np.exp(eta - top)
        total, first, second = np.zeros(k + 1), np.zeros((k + 1, p)), np.zeros((k + 1, p, p))
        total[0] = 1.0
        for w, x in zip(weight, z):
            cross = first[:-1, :, None] * x
            second[1:] += w * (second[:-1] + cross + cross.transpose(0, 2, 1) + total[:-1, None, None] * np.outer(x, x))
            first[1:] += w * (first[:-1] + total[:-1, None] * x)
            total[1:] += w * total[:-1]
        mean = first[k] / total[k]
        return math.log(total[k]) + k * top, mean, second[k] / total[k] - np.outer(mean, mean)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_likelihood, score, information = 0.0, np.zeros(p), np.zeros((p, p))
        for batch in batches:
            single = pc.equal(batch.column("cases"), 1)
            for row in batch.filter(pc.invert(single)).to_pylist():
                value, mean, spread = several(np.array(row["differences"]), row["cases"])
                log_likelihood -= row["n"] * value
                score -= row["n"] * mean
                information += row["n"] * spread
            batch = batch.filter(single)
            if batch.num_rows == 0:
                continue
            sets = batch.column("differences")
            sizes = pc.list_value_length(sets).to_numpy(zero_copy_only=False)
            z = sets.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(float)
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
            stratum = np.repeat(np.arange(len(sizes)), sizes)
            eta = z @ beta
            top = np.maximum(np.maximum.reduceat(eta, first), 0.0)   # the case itself has eta 0
            weight = np.exp(eta - top[stratum])
            total = np.add.reduceat(weight, first) + np.exp(-top)
            share = weight / total[stratum]
            mean = np.add.reduceat(share[:, None] * z, first, axis=0)
            log_likelihood -= float(n @ (np.log(total) + top))
            score -= n @ mean
            information += (z * (share * n[stratum])[:, None]).T @ z - (mean * n[:, None]).T @ mean
        values = np.concatenate([[log_likelihood], score, information.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(values.size, dtype=np.int32)), pa.array(values)],
                                         names=["cell", "value"])
    return sums


def likelihood_at(sets: DataFrame, beta: Sequence[float]) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood, score vector and information matrix, summed by Spark."""
    p = len(beta)
    rows = (sets.mapInArrow(_partial_sums(p, np.asarray(beta, dtype=float)), "cell int, value double")
            .groupBy("cell").agg(F.sum("value").alias("value")).collect())   # 1 + p + p*p numbers
    values = np.zeros(1 + p + p * p)
    for row in rows:
        values[row["cell"]] = row["value"]
    return float(values[0]), values[1:p + 1], values[p + 1:].reshape(p, p)


def adjusted_odds(df: DataFrame, variables: Sequence[str], *, outcome: str = "TSH", strata: str = "case_number",
                  max_iter: int = 60, tol: float = 1e-9) -> DataFrame:
    """One model with all variables. Each Newton step is one Spark job over the distinct strata; the driver only sees
    a p x p matrix. A variable that is a combination of earlier ones gets no coefficient."""
    spark = df.sparkSession
    schema = f"variable string, {_COEFFICIENTS}"
    variables = list(variables)
    if not variables:
        return _finish(spark.createDataFrame([], schema))
    sets = stratum_differences(df, variables, outcome=outcome, strata=strata).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = _newton(sets, variables, max_iter, tol)
    finally:
        sets.unpersist()
    return _finish(spark.createDataFrame(rows, schema))


def _newton(sets: DataFrame, variables: list[str], max_iter: int, tol: float) -> list[dict]:
    """Newton steps until no estimate moves. A variable that still moves when the likelihood has stopped to change runs off to
    infinity (it is separated): it stays where it is, without an estimate, and the others go on."""
    p = len(variables)
    beta, converged = np.zeros(p), False
    log_likelihood, score, information = likelihood_at(sets, beta)
    free = _independent(information)
    for _ in range(max_iter):
        if not free:
            break
        step = np.zeros(p)
        step[free] = np.linalg.solve(information[np.ix_(free, free)], score[free])
        beta = beta + step
        new = likelihood_at(sets, beta)
        while new[0] < log_likelihood - 1e-9 * abs(log_likelihood) and np.abs(step).max() > tol:
            step = step / 2     # the full step overshot
            beta = beta - step
            new = likelihood_at(sets, beta)
        still = abs(new[0] - log_likelihood) <= 1e-9 * (abs(new[0]) + 0.1)
        log_likelihood, score, information = new
        if np.abs(step).max() <= tol * max(1.0, float(np.abs(beta[free]).max())):
            converged = True
            break
        if still:
            free = [j for j in free if abs(step[j]) <= _RUNS_OFF]
    variance = np.linalg.pinv(information[np.ix_(free, free)]) if free else np.zeros((0, 0))
    rows, coefficient = [], _coefficient_rule()
    for j, name in enumerate(variables):
        fitted = converged and j in free
        spread = float(variance[free.index(j), free.index(j)]) if fitted else 0.0
        rows.append({"variable": name, **coefficient(float(beta[j]), 1 / spread if fitted else 0.0, fitted)})
    return rows


def _independent(information: np.ndarray, tolerance: float = 1e-9) -> list[int]:
    """Columns that add information to the ones kept before them."""
    kept: list[int] = []
    for j in range(information.shape[0]):
        own = information[j, j]
        if own <= tolerance:
            continue
        if kept:
            block, cross = information[np.ix_(kept, kept)], information[kept, j]
            own_left = own - cross @ np.linalg.solve(block, cross)
        else:
            own_left = own
        if own_left > tolerance * own:
            kept.append(j)
    return kept
