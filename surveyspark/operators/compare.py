"""Comparison tables over model results: coefficients side by side,
baselines next to tuned models, generalisation ratio, coefficient size
next to forest importance. All inputs are small (features x models or
grid-sized) DataFrames; joins are on explicit keys, never on position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coefficient_table(long: DataFrame, models: Sequence[str]) -> DataFrame:
    """``(model, feature, coefficient)`` -> one row per feature, one column
    per model. The model list is explicit, so the pivot needs no extra job
    to discover its values."""
    return long.groupBy("feature").pivot("model", list(models)).agg(F.first("coefficient"))


def metric_row(df: DataFrame, model: str, split: str, metric_col: str,
               metric: str = "rmse") -> DataFrame:
    """Tag a one-row metric DataFrame with its model and the split it was
    measured on (validation means and test scores are not the same thing)."""
    return df.select(F.lit(model).alias("model"), F.lit(split).alias("metric_split"),
                     F.lit(metric).alias("metric"), F.col(metric_col).alias("value"))


def model_comparison(rows: Sequence[DataFrame]) -> DataFrame:
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def generalisation_ratio(test_metric: DataFrame, ranked: DataFrame,
                         test_col: str = "rmse") -> DataFrame:
    """Test metric of the refitted best model over the best mean CV metric."""
    best = ranked.where(F.col("rank") == 1).select("avg_metric").first()[0]
    b = F.lit(best).cast("double")
    return test_metric.select(F.col(test_col).alias("test_metric"), b.alias("best_cv"),
                              (F.col(test_col) / b).alias("ratio"))


def importance_vs_coefficient(coefs: DataFrame, imps: DataFrame) -> DataFrame:
    """|scaled coefficient| beside forest importance, per feature."""
    c = coefs.where(F.col("feature") != "intercept").select(
        "feature", F.abs("coefficient").alias("abs_coefficient"))
    return c.join(imps.select("feature", "importance"), "feature", "inner")
