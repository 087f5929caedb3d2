"""Rank-revealing least squares against high precision and minimum-norm solves."""

from decimal import Decimal, getcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyspark.operators import least_squares as ls


def frame(spark, x, y, parts=5):
    names = [f"x{i}" for i in range(x.shape[1])]
    rows = [(*map(float, a), float(b)) for a, b in zip(x, y)]
    return names, spark.createDataFrame(rows, ", ".join(f"{n} double" for n in [*names, "y"])).repartition(parts)


def minimum_norm(x, y):
    b = np.linalg.lstsq(x - x.mean(axis=0), y - y.mean(), rcond=1e-12)[0]
    return b, y.mean() - x.mean(axis=0) @ b


def exact(x, y):
    """Normal equations in 60 digits."""
    getcontext().prec = 60
    a = [[Decimal(1), *map(Decimal, map(float, row))] for row in x]
    k = len(a[0])
    m = [[sum(r[i] * r[j] for r in a) for j in range(k)] + [sum(r[i] * Decimal(float(t)) for r, t in zip(a, y))] for i in range(k)]
    for i in range(k):
        pivot = max(range(i, k), key=lambda r: abs(m[r][i]))
        m[i], m[pivot] = m[pivot], m[i]
        for r in range(k):
            if r != i:
                f = m[r][i] / m[i][i]
                m[r] = [u - f * v for u, v in zip(m[r], m[i])]
    return [float(m[i][k] / m[i][i]) for i in range(k)]


def test_condition_number_of_1e8(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (200, 3))
    x[:, 2] = x[:, 0] + x[:, 1] + 1e-8 * rng.normal(0, 1, 200)
    y = x @ [1.0, -2.0, 3.0] + rng.normal(0, 0.1, 200) * 1e-6
    names, df = frame(spark, x, y)
    fit = ls.least_squares(df, names, "y")
    want = exact(x, y)
    assert fit.rank == 3 and np.linalg.cond(x - x.mean(axis=0)) > 1e8
    assert np.allclose([fit.intercept, *fit.coefficients], want, rtol=1e-5, atol=1e-6)


@pytest.mark.parametrize("parts", [1, 3, 150])
def test_collinear_columns_take_the_shortest_solution(spark, parts):
    rng = np.random.default_rng(2)
    x = rng.normal(5, 2, (300, 6))
    x[:, 3] = x[:, 0]
    x[:, 4] = 2 * x[:, 1] - x[:, 2]
    x[:, 5] = 7.0
    y = x[:, 0] - x[:, 1] + rng.normal(0, 1, 300)
    names, df = frame(spark, x, y, parts)
    fit = ls.least_squares(df, names, "y")
    b, intercept = minimum_norm(x, y)
    assert fit.rank == 3 and np.allclose(fit.coefficients, b, atol=1e-9) and fit.intercept == pytest.approx(intercept)
    assert fit.coefficients[0] == pytest.approx(fit.coefficients[3]) and fit.coefficients[5] == 0
    scored = fit.transform(df).agg(F.sum((F.col("y") - F.col("prediction"))**2)).first()[0]
    assert scored == pytest.approx(((y - intercept - x @ b)**2).sum())


def test_units_do_not_change_rank_or_predictions(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (120, 3)) * [1e-9, 1.0, 1e12] + [0, 5, 3e13]
    y = x @ [1e9, 1.0, 1e-12] + rng.normal(0, 0.1, 120)
    names, df = frame(spark, x, y)
    fit = ls.least_squares(df, names, "y")
    assert fit.rank == 3 and np.allclose(fit.coefficients / [1e9, 1, 1e-12], 1, atol=0.1)


def test_edge_cases(spark):
    names, df = frame(spark, np.array([[1.0, 2.0]]), np.array([3.0]))
    one = ls.least_squares(df, names, "y")
    assert one.rank == 0 and one.intercept == 3.0 and not one.coefficients.any()
    few = ls.least_squares(df.unionByName(df.select(F.lit(2.0).alias("x0"), F.lit(2.0).alias("x1"), F.lit(5.0).alias("y"))), names, "y")
    assert few.rank == 1 and few.coefficients[0] == pytest.approx(2.0)
    empty = ls.least_squares(df, [], "y")
    assert empty.rank == 0 and empty.intercept == 3.0
    for bad in (df.limit(0), df.withColumn("x0", F.lit(None).cast("double")), df.withColumn("y", F.lit(float("nan")))):
        with pytest.raises(ValueError):
            ls.least_squares(bad, names, "y")
    assert [r.feature for r in one.table(spark, "m").collect()] == ["intercept", "x0", "x1"]
