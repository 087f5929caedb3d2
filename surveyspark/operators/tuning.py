"""Grid search with k-fold cross-validation that keeps every fold's metric.

``cross_validate`` returns the fit log -- one row per (fold, grid point) --
as a DataFrame, so the running average over folds, the ranking by mean
metric, the top-k list and the spread are ordinary aggregations and window
functions over it. The log is bounded by ``folds x grid`` rows; no data row
reaches the driver.

Execution plan:

* folds come from a hash of the row key (``split.with_folds``), so a fold
  is the same rows whatever the partitioning;
* feature stages that need no fitting (the assembler) run once and their rows
  are cached once, spilling to disk; folds are filters on that one copy;
* fitted stages (the scaler) are fitted once per fold on that fold's training
  rows, not once per grid point;
* grid points that define the same model (e.g. any ``elasticNetParam`` at
  ``regParam = 0``) are fitted once and share the result;
* all ``folds x grid`` fits share one thread pool, each a distributed Spark job;
* all models of a fold are scored in one aggregation pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import takewhile
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.param import Param
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType
from pyspark.storagelevel import StorageLevel

from .metrics import SMALLER_IS_BETTER, metric_columns

FIT_LOG_SCHEMA = StructType([
    StructField("fold", IntegerType()), StructField("param_id", IntegerType()),
    StructField("params", StringType()), StructField("metric", DoubleType()),
])


def _fmt(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


def param_label(param_map: dict[Param, object]) -> str:
    """``name=value`` pairs sorted by name, space separated."""
    return " ".join(f"{p.name}={_fmt(v)}" for p, v in sorted(param_map.items(),
                                                             key=lambda kv: kv[0].name))


def linear_canonical(param_map: dict[Param, object]) -> tuple:
    """Identity of a linear-regression grid point: at ``regParam = 0`` the
    elastic-net mix has no effect, so it is left out of the key."""
    items = {p.name: v for p, v in param_map.items()}
    if float(items.get("regParam", 0.0)) == 0.0:
        items.pop("elasticNetParam", None)
    return tuple(sorted(items.items()))


def _default_canonical(param_map: dict[Param, object]) -> tuple:
    return tuple(sorted((p.name, v) for p, v in param_map.items()))


@dataclass
class CVResult:
    fit_log: DataFrame              # fold, param_id, params, metric
    avg_metrics: list[float]
    best_index: int
    best_params: str
    best_model: PipelineModel | None
    metric: str
    smaller_is_better: bool


def cross_validate(df: DataFrame, estimator: Estimator, param_maps: Sequence[dict],
                   label: str, fold_col: str, num_folds: int, metric: str = "rmse",
                   feature_stages: Pipeline | None = None, parallelism: int = 4,
                   canonical: Callable[[dict], tuple] | None = None,
                   refit: bool = True) -> CVResult:
    """Fit every grid point on every fold's training rows, score it on the
    fold's validation rows, and (``refit``) fit the best point on all rows.

    ``estimator`` is the final model stage; ``feature_stages`` come ahead of it:
    leading ones that need no fitting run once over the input, the others are
    fitted per fold. The best point minimises the mean metric (maximises for
    ``r2``), ties going to the earlier grid point.
    """
    spark = df.sparkSession
    key_of = canonical or _default_canonical
    first_of: dict[tuple, int] = {}
    for j, pm in enumerate(param_maps):
        first_of.setdefault(key_of(pm), j)
    distinct = sorted(set(first_of.values()))

    stages = list(feature_stages.getStages()) if feature_stages is not None else []
    stateless = list(takewhile(lambda s: isinstance(s, Transformer), stages))
    per_fold = Pipeline(stages=stages[len(stateless):])
    data = df
    for stage in stateless:
        data = stage.transform(data)
    data = data.persist(StorageLevel.MEMORY_AND_DISK)

    def prepare(i):
        train, valid = data.where(F.col(fold_col) != i), data.where(F.col(fold_col) == i)
        fitted = per_fold.fit(train)
        return fitted.transform(train), fitted.transform(valid)

    def score(i, valid, models):
        scored, preds = valid, []
        for j in distinct:
            m = models[(i, j)].copy()
            m.setPredictionCol(f"_pred{j}")
            scored = m.transform(scored)
            preds.append(f"_pred{j}")
        return dict(zip(distinct, metric_columns(scored, metric, label, preds)))

    values: dict[int, dict[int, float]] = {}
    tasks = [(i, j) for i in range(num_folds) for j in distinct]
    pool = ThreadPool(processes=max(1, min(parallelism, len(tasks))))
    try:
        prepared = {i: prepare(i) for i in range(num_folds)}
        models = dict(pool.map(
            lambda ij: (ij, estimator.fit(prepared[ij[0]][0], param_maps[ij[1]])), tasks, chunksize=1))
        for i in range(num_folds):
            values[i] = score(i, prepared[i][1], models)
    finally:
        pool.close()
        data.unpersist()

    log_rows = [(i, j, param_label(pm), values[i][first_of[key_of(pm)]])
                for i in range(num_folds) for j, pm in enumerate(param_maps)]
    smaller = SMALLER_IS_BETTER[metric]
    avg = []
    for j in range(len(param_maps)):
        vals = [r[3] for r in log_rows if r[1] == j]
        avg.append(sum(vals) / len(vals))
    best = min(range(len(avg)), key=lambda j: (avg[j] if smaller else -avg[j], j))
    best_model = None
    if refit:
        best_model = Pipeline(stages=stages + [estimator.copy(param_maps[best])]).fit(df)
    fit_log = spark.createDataFrame(log_rows, FIT_LOG_SCHEMA)
    return CVResult(fit_log, avg, best, param_label(param_maps[best]), best_model, metric,
                    smaller)


def running_average(fit_log: DataFrame) -> DataFrame:
    """Mean metric over folds 0..i for every grid point, in fold order."""
    w = (Window.partitionBy("param_id").orderBy("fold")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return fit_log.withColumn("running_avg", F.avg("metric").over(w))


def ranking(fit_log: DataFrame, smaller_is_better: bool = True) -> DataFrame:
    """One row per grid point: mean, sample std and last-fold metric, ranked
    best first (ties by label). The window runs over ``grid`` rows only."""
    agg = (fit_log.groupBy("param_id", "params")
           .agg(F.avg("metric").alias("avg_metric"), F.stddev_samp("metric").alias("std_metric"),
                F.max_by("metric", "fold").alias("last_fold_metric"),
                F.count(F.lit(1)).alias("folds")))
    key = F.col("avg_metric").asc() if smaller_is_better else F.col("avg_metric").desc()
    return agg.withColumn("rank", F.row_number().over(
        Window.orderBy(key, F.col("params").asc())).cast("int"))


def top_k(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.where(F.col("rank") <= k)
