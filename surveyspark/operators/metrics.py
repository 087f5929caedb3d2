"""Regression metrics as aggregate expressions.

Returning one-row DataFrames keeps scoring lazy and inside whole-stage
codegen; ``metric_columns`` evaluates many prediction columns in a single
pass (one job per validation fold instead of one per model).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALLER_IS_BETTER = {"rmse": True, "mse": True, "mae": True, "r2": False}


def _sq(label: str, prediction: str) -> Column:
    return F.pow(F.col(label) - F.col(prediction), F.lit(2))


def rmse_column(label: str, prediction: str = "prediction") -> Column:
    return F.sqrt(F.avg(_sq(label, prediction)))


def metric_column(metric: str, label: str, prediction: str, label_mean: Column | None = None
                  ) -> Column:
    """Aggregate expression for ``metric``; ``r2`` needs ``label_mean``."""
    if metric == "rmse":
        return rmse_column(label, prediction)
    if metric == "mse":
        return F.avg(_sq(label, prediction))
    if metric == "mae":
        return F.avg(F.abs(F.col(label) - F.col(prediction)))
    if metric == "r2":
        dev = F.pow(F.col(label) - label_mean, F.lit(2))
        return F.lit(1.0) - F.sum(_sq(label, prediction)) / F.sum(dev)
    raise ValueError(f"unsupported metric {metric!r}")


def rmse(df: DataFrame, label: str, prediction: str = "prediction",
         alias: str = "rmse") -> DataFrame:
    return df.agg(rmse_column(label, prediction).alias(alias))


def r2(df: DataFrame, label: str, prediction: str = "prediction", alias: str = "r2") -> DataFrame:
    """Coefficient of determination against the mean of the scored rows
    (the mean is fetched first and used as a constant)."""
    mean = df.agg(F.avg(label)).first()[0]
    return df.agg(metric_column("r2", label, prediction, F.lit(mean)).alias(alias))


def metric_columns(df: DataFrame, metric: str, label: str, predictions: Sequence[str]
                   ) -> list[float]:
    """Evaluate ``metric`` for every prediction column in one pass."""
    if metric == "r2":
        src, lm = df, F.lit(df.agg(F.avg(label)).first()[0])
    else:
        src, lm = df, None
    row = src.agg(*[metric_column(metric, label, p, lm).alias(f"m{i}")
                    for i, p in enumerate(predictions)]).first()
    return [float(row[f"m{i}"]) if row[f"m{i}"] is not None else float("nan")
            for i in range(len(predictions))]
