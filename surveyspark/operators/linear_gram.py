"""Cross-validated linear / elastic-net regression from sufficient statistics.

A least-squares fit, with or without an elastic-net penalty, depends on the
data only through the row count, the sums and the cross-products of
``(features, label)``. One ``groupBy(fold)`` aggregation therefore yields
everything every grid point on every fold needs:

* training statistics of fold ``f`` = totals minus fold ``f``;
* the validation error of any coefficient vector on fold ``f`` is a
  quadratic form in fold ``f``'s own statistics.

So a ``folds x grid`` search costs two scans of the data (centring means,
then the per-fold Gram aggregation) however large the grid, instead of one
or more scans per fit. The per-fold matrices are ``(p+1) x (p+1)``; solving
on the driver is O(p^2) per coordinate sweep and independent of row count.

Objective (the one Spark ML's ``LinearRegression`` minimises with
``standardization=True``; here with an intercept), with ``z`` the standardised
features, ``w'`` the standardised coefficients, ``sigma_y`` the label's
standard deviation::

    1/(2n) sum (y - mean_y - z.w')^2 + l2/2 |w'|^2 + l1 |w'|_1
    l1 = regParam * elasticNetParam
    l2 = regParam * (1 - elasticNetParam) / sigma_y

solved to convergence by cyclic coordinate descent (an error if it does not
converge). Missing values are refused, as the assembler does; so are folds
without rows. Refit the chosen point to convergence too, so that selection and
final model solve the same problem.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tuning import FIT_LOG_SCHEMA, CVResult


def fold_statistics(df: DataFrame, features: Sequence[str], label: str, fold_col: str
                    ) -> tuple[np.ndarray, dict[int, tuple[float, np.ndarray, np.ndarray]]]:
    """Per-fold ``(n, sum v, sum v v^T)`` of ``v = (features, label) - shift``.

    ``shift`` is the global mean (one aggregation pass), subtracted before
    the cross-products so that the sums do not lose precision to large
    means. Returns ``shift`` and a dict fold -> statistics; the collected
    result has ``folds`` rows of ``(p+1)(p+2)/2`` numbers.
    """
    cols = list(features) + [label]
    k = len(cols)
    shift_row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                       *[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(f"z{i}")
                         for i, c in enumerate(cols)], F.count(F.lit(1)).alias("n")).first()
    invalid = [c for i, c in enumerate(cols) if shift_row[f"z{i}"]]
    if invalid:
        raise ValueError(f"missing values in {', '.join(invalid)}: drop or fill them first")
    if not shift_row["n"]:
        raise ValueError("no rows to fit")
    shift = np.array([float(shift_row[f"m{i}"]) for i in range(k)])
    centred = [(F.col(c).cast("double") - F.lit(shift[i])) for i, c in enumerate(cols)]
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(centred[i]).alias(f"s{i}") for i in range(k)]
    aggs += [F.sum(centred[i] * centred[j]).alias(f"c{i}_{j}")
             for i in range(k) for j in range(i, k)]
    out = {}
    for row in df.groupBy(fold_col).agg(*aggs).collect():
        s = np.array([float(row[f"s{i}"]) for i in range(k)])
        c = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                c[i, j] = c[j, i] = float(row[f"c{i}_{j}"])
        out[int(row[fold_col])] = (float(row["n"]), s, c)
    return shift, out


def _moments(n: float, s: np.ndarray, c: np.ndarray):
    mean = s / n
    cov = c / n - np.outer(mean, mean)          # population covariance
    return mean, cov


def _about(origin: np.ndarray, n: float, s: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Mean products of the columns as they were before ``origin`` was subtracted."""
    cross = np.outer(s / n, origin)
    return c / n + cross + cross.T + np.outer(origin, origin)


def solve_elastic_net(n: float, s: np.ndarray, c: np.ndarray, reg: float, mix: float,
                      tol: float = 1e-12, max_sweeps: int = 100_000,
                      origin: np.ndarray | None = None):
    """Coefficients ``(intercept, w)`` in the shifted units of ``s``/``c``.

    Features and label are standardised with population moments (as the
    normal-equation solver does); the intercept is recovered from the means.
    ``origin``, the shift of the statistics, asks for a fit without an intercept:
    products are taken about zero in place of the means, scales stay the same, and
    the returned intercept only carries the shift. A constant feature gets 0.
    """
    p = len(s) - 1
    mean, cov = _moments(n, s, c)
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    sd_y = sd[p]
    products = cov if origin is None else _about(origin, n, s, c)
    active = sd[:p] > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        g = products[:p, :p] / np.outer(sd[:p], sd[:p])
        q = products[:p, p] / sd[:p]
    g[~active, :] = 0.0
    g[:, ~active] = 0.0
    q[~active] = 0.0
    l1 = reg * mix
    l2 = reg * (1.0 - mix) / sd_y if sd_y > 0 else 0.0
    w = np.zeros(p)
    if l1 == 0.0:
        idx = np.where(active)[0]
        a = g[np.ix_(idx, idx)] + l2 * np.eye(len(idx))
        w[idx] = np.linalg.lstsq(a, q[idx], rcond=None)[0]
    else:
        for _ in range(max_sweeps):
            delta = 0.0
            for j in range(p):
                if not active[j]:
                    continue
                r = q[j] - g[j] @ w + g[j, j] * w[j]
                new = np.sign(r) * max(abs(r) - l1, 0.0) / (g[j, j] + l2)
                delta = max(delta, abs(new - w[j]))
                w[j] = new
            if delta < tol:
                break
        else:
            raise ArithmeticError(f"no convergence in {max_sweeps} sweeps (reg={reg}, mix={mix})")
    coef = np.where(active, w / np.where(sd[:p] > 0, sd[:p], 1.0), 0.0)
    intercept = mean[p] - coef @ mean[:p] if origin is None else coef @ origin[:p] - origin[p]
    return intercept, coef


def sse(n: float, s: np.ndarray, c: np.ndarray, intercept: float, coef: np.ndarray) -> float:
    """Sum of squared residuals of ``y - intercept - x.coef`` from the
    (shifted) statistics of the scored rows."""
    beta = np.concatenate([-coef, [1.0]])           # residual = beta.v - intercept
    return float(beta @ c @ beta - 2.0 * intercept * (beta @ s) + n * intercept ** 2)


def gram_cross_validate(df: DataFrame, features: Sequence[str], label: str, fold_col: str,
                        num_folds: int, grid: Sequence[tuple],
                        labels: Sequence[str], refit=None) -> CVResult:
    """RMSE cross-validation of ``(regParam, elasticNetParam)`` points, or of
    ``(regParam, elasticNetParam, fitIntercept)``.

    ``labels`` name the grid points in the fit log. ``refit`` (optional)
    is called with the best point of ``grid`` and returns the
    final model fitted on all rows (e.g. a Spark ML pipeline).
    """
    spark = df.sparkSession
    data = df.select(*features, label, fold_col)
    shift, per_fold = fold_statistics(data, features, label, fold_col)
    absent = [f for f in range(num_folds) if f not in per_fold]
    if absent or len(per_fold) < 2:
        raise ValueError(f"folds without rows: {absent}")
    total_n = sum(v[0] for v in per_fold.values())
    total_s = sum(v[1] for v in per_fold.values())
    total_c = sum(v[2] for v in per_fold.values())
    rows = []
    solved: dict[tuple, tuple] = {}
    for f in range(num_folds):
        vn, vs, vc = per_fold[f]
        tn, ts, tc = total_n - vn, total_s - vs, total_c - vc
        for j, (reg, mix, *rest) in enumerate(grid):
            intercept = not rest or bool(rest[0])
            key = (f, reg, 0.0 if reg == 0 else mix, intercept)
            if key not in solved:
                b0, w = solve_elastic_net(tn, ts, tc, reg, mix, origin=None if intercept else shift)
                solved[key] = (b0, w)
            b0, w = solved[key]
            rmse = float(np.sqrt(max(sse(vn, vs, vc, b0, w), 0.0) / vn))
            rows.append((f, j, labels[j], rmse))
    avg = [float(np.mean([r[3] for r in rows if r[1] == j])) for j in range(len(grid))]
    best = min(range(len(avg)), key=lambda j: (avg[j], j))
    model = refit(grid[best]) if refit else None
    fit_log = spark.createDataFrame(rows, FIT_LOG_SCHEMA)
    return CVResult(fit_log, avg, best, labels[best], model, "rmse", True)
