"""Regression models as Spark ML pipelines.

Fitting is distributed by Spark ML: feature statistics and the normal
equations (or tree split statistics) are aggregated on the executors and
only p-sized summaries reach the driver. Coefficient and importance tables
are built from those p values, so their size is bounded by the feature
count, never by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

FEATURES = "features"
SCALED = "scaled_features"


def assembler(features: Sequence[str], output: str = FEATURES) -> VectorAssembler:
    """Vector of ``features``; invalid (null/NaN) values raise, as by default."""
    return VectorAssembler(inputCols=list(features), outputCol=output)


def scaler(input_col: str = FEATURES, output: str = SCALED) -> StandardScaler:
    """Divide by the sample standard deviation; no centring (library defaults)."""
    return StandardScaler(inputCol=input_col, outputCol=output)


def intercept_only(label: str) -> Pipeline:
    """Linear regression on an empty feature vector: predicts the training mean."""
    return Pipeline(stages=[assembler([], "empty_features"),
                            LinearRegression(labelCol=label, featuresCol="empty_features")])


def ols(label: str, features: Sequence[str]) -> Pipeline:
    """Unregularised least squares on raw features."""
    return Pipeline(stages=[assembler(features),
                            LinearRegression(labelCol=label, featuresCol=FEATURES,
                                             regParam=0.0, elasticNetParam=0.0)])


def linear_stage(label: str, features_col: str = SCALED, max_iter: int = 5,
                 reg_param: float = 0.0, elastic_net: float = 0.0) -> LinearRegression:
    return LinearRegression(labelCol=label, featuresCol=features_col, maxIter=max_iter,
                            regParam=reg_param, elasticNetParam=elastic_net)


def scaled_linear(label: str, features: Sequence[str], max_iter: int = 5,
                  reg_param: float = 0.0, elastic_net: float = 0.0, tol: float = 1e-6) -> Pipeline:
    return Pipeline(stages=[assembler(features), scaler(),
                            linear_stage(label, SCALED, max_iter, reg_param, elastic_net).setTol(tol)])


def forest_stage(label: str, features_col: str = SCALED, seed: int = 42, num_trees: int = 20,
                 max_depth: int = 5, max_bins: int = 32) -> RandomForestRegressor:
    """Random forest; the seed is always explicit (the library default is
    derived from a class-name hash and is not stable across processes)."""
    return RandomForestRegressor(labelCol=label, featuresCol=features_col, seed=seed,
                                 numTrees=num_trees, maxDepth=max_depth, maxBins=max_bins)


def forest(label: str, features: Sequence[str], seed: int = 42, num_trees: int = 20,
           max_depth: int = 5) -> Pipeline:
    return Pipeline(stages=[assembler(features), scaler(),
                            forest_stage(label, SCALED, seed, num_trees, max_depth)])


def feature_stages(features: Sequence[str], scale: bool = True) -> Pipeline:
    """Assembler (+ scaler): the part of a pipeline that tuning fits once per fold."""
    stages = [assembler(features)] + ([scaler()] if scale else [])
    return Pipeline(stages=stages)


def last_stage(model):
    return model.stages[-1] if isinstance(model, PipelineModel) else model


def coefficients(spark: SparkSession, model, features: Sequence[str], name: str) -> DataFrame:
    """``(model, feature, coefficient)`` rows, intercept first."""
    lm = last_stage(model)
    rows = [(name, "intercept", float(lm.intercept))]
    rows += [(name, f, float(c)) for f, c in zip(features, lm.coefficients.toArray())]
    schema = StructType([StructField("model", StringType()), StructField("feature", StringType()),
                         StructField("coefficient", DoubleType())])
    return spark.createDataFrame(rows, schema)


def importances(spark: SparkSession, model, features: Sequence[str], name: str) -> DataFrame:
    """``(model, feature, importance)``; importances sum to 1."""
    fm = last_stage(model)
    vals = fm.featureImportances.toArray()
    rows = [(name, f, float(v)) for f, v in zip(features, vals)]
    schema = StructType([StructField("model", StringType()), StructField("feature", StringType()),
                         StructField("importance", DoubleType())])
    return spark.createDataFrame(rows, schema)


def scaled_columns(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Fit the scaler on ``df`` and return ``keep`` columns plus one
    ``<feature>_scaled`` column per feature."""
    fitted = feature_stages(features, scale=True).fit(df)
    arr = vector_to_array(F.col(SCALED))
    return (fitted.transform(df)
                  .select(*keep, *[arr[i].alias(f"{f}_scaled") for i, f in enumerate(features)]))
