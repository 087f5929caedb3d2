"""Models and tuning: Gram-matrix solver against Spark ML, fit-log
invariants, forest invariants (rows-only keys are checked here)."""

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from surveyspark import catalog as C
from surveyspark.operators import linear_gram, models, tuning
from surveyspark.operators import split as sp
from surveyspark.sources import LABEL, MODEL_FEATURES

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def train(spark):
    tr, _ = C.train_test(spark, SF_SMALL)
    yield tr.cache()
    tr.unpersist()  # a later module's plans would read the cache


def test_gram_solver_matches_spark_ml(spark, train):
    df = train.withColumn("fold", F.lit(0))
    shift, stats = linear_gram.fold_statistics(df, MODEL_FEATURES, LABEL, "fold")
    n, s, c = stats[0]
    va = models.assembler(MODEL_FEATURES).transform(train)
    for reg, mix, tol in [(0.0, 0.0, 1e-9), (0.05, 0.0, 1e-9), (0.09, 1.0, 1e-6),
                          (0.02, 0.4, 1e-6)]:
        lr = LinearRegression(labelCol=LABEL, featuresCol="features", regParam=reg,
                              elasticNetParam=mix, maxIter=1000, tol=1e-12).fit(va)
        b0, w = linear_gram.solve_elastic_net(n, s, c, reg, mix)
        b0 = b0 + shift[-1] - w @ shift[:-1]
        assert np.max(np.abs(lr.coefficients.toArray() - w)) < tol
        assert abs(lr.intercept - b0) < 100 * tol


def test_gram_solver_without_intercept_matches_spark_ml(spark, train):
    shift, stats = linear_gram.fold_statistics(train.withColumn("fold", F.lit(0)), MODEL_FEATURES, LABEL, "fold")
    va = models.assembler(MODEL_FEATURES).transform(train)
    data = np.array(train.select(*MODEL_FEATURES, LABEL).collect(), float)
    sd = data.std(axis=0)
    for reg, mix, tol in [(0.0, 0.0, 1e-8), (0.05, 0.0, 1e-8), (0.02, 0.4, 1e-5)]:
        lr = LinearRegression(labelCol=LABEL, featuresCol="features", regParam=reg, fitIntercept=False,
                              elasticNetParam=mix, maxIter=1000, tol=1e-13).fit(va)
        b0, w = linear_gram.solve_elastic_net(*stats[0], reg, mix, origin=shift)
        # the library stops its L1 iterations at about 1e-6; the slopes of the objective are exact
        assert np.max(np.abs(lr.coefficients.toArray() - w)) < tol
        assert abs(b0 + shift[-1] - w @ shift[:-1]) < 1e-9 and lr.intercept == 0
        slope = (data[:, :-1] / sd[:-1]).T @ (data[:, -1] - data[:, :-1] @ w) / len(data)
        slope -= reg * (1 - mix) / sd[-1] * w * sd[:-1]
        assert np.all(w != 0) and np.max(np.abs(slope - reg * mix * np.sign(w))) < 1e-9


def test_gram_cv_over_fit_intercept_agrees_with_spark_ml_cv(spark, train):
    folded = sp.with_folds(train, C.portable_hash("fold"), 3)
    lr = LinearRegression(labelCol=LABEL, featuresCol=models.FEATURES, regParam=0.0)
    grid = ParamGridBuilder().addGrid(lr.fitIntercept, [True, False]).build()
    ml = tuning.cross_validate(folded, lr, grid, LABEL, "fold", 3, refit=False,
                               feature_stages=models.feature_stages(["prim_min", "age"], scale=False))
    gram = linear_gram.gram_cross_validate(folded, ["prim_min", "age"], LABEL, "fold", 3,
                                           [(0.0, 0.0, True), (0.0, 0.0, False)], ["a", "b"], refit=lambda p: p)
    want = {(r.fold, r.param_id): r.metric for r in ml.fit_log.collect()}
    got = {(r.fold, r.param_id): r.metric for r in gram.fit_log.collect()}
    assert want.keys() == got.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    assert gram.best_model == (0.0, 0.0, gram.best_index == 0) and gram.best_index == ml.best_index


def test_large_penalty_zeroes_coefficients(spark, train):
    df = train.withColumn("fold", F.lit(0))
    _, stats = linear_gram.fold_statistics(df, MODEL_FEATURES, LABEL, "fold")
    _, w = linear_gram.solve_elastic_net(*stats[0], reg=1e6, mix=1.0)
    assert np.all(w == 0)


def test_fit_log_invariants(spark, train):
    folded = sp.with_folds(train, C.portable_hash("fold"), 3)
    lr = LinearRegression(labelCol=LABEL, featuresCol=models.FEATURES)
    grid = (ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.5])
            .addGrid(lr.elasticNetParam, [0.0, 1.0]).build())
    res = tuning.cross_validate(folded, lr, grid, LABEL, "fold", 3,
                                feature_stages=models.feature_stages(["prim_min"], scale=False),
                                canonical=tuning.linear_canonical, parallelism=2)
    log = res.fit_log.collect()
    assert len(log) == 3 * len(grid)
    for j in range(len(grid)):
        vals = [r.metric for r in log if r.param_id == j]
        assert res.avg_metrics[j] == pytest.approx(np.mean(vals))
    # regParam = 0 makes elasticNetParam irrelevant: identical metrics
    by = {(r.fold, r.params): r.metric for r in log}
    for f in range(3):
        assert by[(f, "elasticNetParam=0 regParam=0")] == by[(f, "elasticNetParam=1 regParam=0")]
    ranked = tuning.ranking(res.fit_log).orderBy("rank").collect()
    assert ranked[0].avg_metric == min(res.avg_metrics)
    assert ranked[0].param_id == res.best_index
    run = tuning.running_average(res.fit_log).where("fold = 2").collect()
    for r in run:
        assert r.running_avg == pytest.approx(res.avg_metrics[r.param_id])


def test_gram_cv_agrees_with_spark_ml_cv_on_ridge(spark):
    from surveyspark.catalog import elastic_net_cv, elastic_net_cv_spark_ml
    a = elastic_net_cv(spark, SF_SMALL)
    b = elastic_net_cv_spark_ml(spark, SF_SMALL)
    la = {(r.fold, r.params): r.metric for r in a.fit_log.collect()}
    lb = {(r.fold, r.params): r.metric for r in b.fit_log.collect()}
    assert la.keys() == lb.keys()
    for key in la:
        if "elasticNetParam=0 " in key[1] or key[1].endswith("regParam=0"):
            assert la[key] == pytest.approx(lb[key], rel=1e-7)      # closed form
        else:
            assert la[key] == pytest.approx(lb[key], rel=1e-2)      # Spark ML stops at maxIter=5
    worst = max(a.avg_metrics)
    assert a.avg_metrics[a.best_index] <= worst


def test_forest_invariants(spark):
    imps = C.q_forest_importances(spark, SF_SMALL).collect()
    assert sum(r.importance for r in imps) == pytest.approx(1.0, abs=1e-5)
    assert {r.feature for r in imps} == set(MODEL_FEATURES)
    ranked = C.q_forest_cv(spark, SF_SMALL).collect()
    assert len(ranked) == len(C.FOREST_TREES) * len(C.FOREST_DEPTHS)
    assert sorted(r.rank for r in ranked) == list(range(1, len(ranked) + 1))
    assert all(r.folds == 4 for r in ranked)
    top = C.q_forest_topk(spark, SF_SMALL).collect()
    assert len(top) == 5
    ratio = C.q_forest_generalisation_ratio(spark, SF_SMALL).first()
    assert ratio.ratio == pytest.approx(ratio.test_metric / ratio.best_cv, rel=1e-5)


def test_intercept_model_predicts_training_mean(spark, train):
    model = models.intercept_only(LABEL).fit(train)
    mean = train.agg(F.avg(LABEL)).first()[0]
    assert models.last_stage(model).intercept == pytest.approx(mean)


def test_scaling_leaves_ols_predictions_unchanged(spark, train):
    raw = models.ols(LABEL, ["prim_min", "age"]).fit(train).transform(train)
    scl = models.scaled_linear(LABEL, ["prim_min", "age"]).fit(train).transform(train)
    a = raw.agg(F.sum("prediction")).first()[0]
    b = scl.agg(F.sum("prediction")).first()[0]
    assert a == pytest.approx(b, rel=1e-9)


def test_gram_cv_agrees_with_converged_spark_ml(spark, train):
    """L1 points too, at the same tolerance."""
    folded = sp.with_folds(train, C.portable_hash("fold"), 3)
    points = [(0.02, 0.4), (0.09, 1.0), (0.05, 0.0)]
    gram = linear_gram.gram_cross_validate(folded, MODEL_FEATURES, LABEL, "fold", 3, points, list("abc"))
    lr = models.linear_stage(LABEL, models.SCALED, max_iter=1000).setTol(1e-13)
    grid = [{lr.regParam: reg, lr.elasticNetParam: mix} for reg, mix in points]
    ml = tuning.cross_validate(folded, lr, grid, LABEL, "fold", 3,
                               feature_stages=models.feature_stages(MODEL_FEATURES), refit=False)
    a = {(r.fold, r.param_id): r.metric for r in gram.fit_log.collect()}
    b = {(r.fold, r.param_id): r.metric for r in ml.fit_log.collect()}
    assert a.keys() == b.keys()
    for key in a:
        assert a[key] == pytest.approx(b[key], rel=1e-6)


def test_tuned_model_is_the_selected_optimum(spark):
    cv = C.elastic_net_cv(spark, SF_SMALL)
    train, _ = C.train_test(spark, SF_SMALL)
    shift, stats = linear_gram.fold_statistics(train.withColumn("fold", F.lit(0)), MODEL_FEATURES, LABEL, "fold")
    reg, mix = next((float(pm[lr.regParam]), float(pm[lr.elasticNetParam])) for lr, grid in [C.elastic_net_grid()]
                    for i, pm in enumerate(grid) if i == cv.best_index)
    _, w = linear_gram.solve_elastic_net(*stats[0], reg, mix)
    lm = models.last_stage(cv.best_model)
    sd = [r for r in train.agg(*[F.stddev_samp(f) for f in MODEL_FEATURES]).first()]
    assert np.allclose(lm.coefficients.toArray() / np.array(sd), w, atol=1e-5)


def test_gram_refuses_missing_values_empty_folds_and_slow_convergence(spark, train):
    folded = sp.with_folds(train, C.portable_hash("fold"), 3)
    holes = folded.withColumn("age", F.when(F.col("age") % 5 != 0, F.col("age")))
    with pytest.raises(ValueError, match="age"):
        linear_gram.gram_cross_validate(holes, ["prim_min", "age"], LABEL, "fold", 3, [(0.1, 0.0)], ["a"])
    with pytest.raises(ValueError, match="folds"):
        linear_gram.gram_cross_validate(folded, ["prim_min"], LABEL, "fold", 4, [(0.1, 0.0)], ["a"])
    _, stats = linear_gram.fold_statistics(train.withColumn("fold", F.lit(0)), MODEL_FEATURES, LABEL, "fold")
    with pytest.raises(ArithmeticError):
        linear_gram.solve_elastic_net(*stats[0], reg=0.01, mix=0.5, max_sweeps=1)


def test_cross_validation_equals_separate_fits(spark, train):
    """One cached copy and one pool give what plain fits per fold give."""
    folded = sp.with_folds(train, C.portable_hash("fold"), 3)
    lr = LinearRegression(labelCol=LABEL, featuresCol=models.SCALED)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.3]).build()
    stages = models.feature_stages(["prim_min", "age"], scale=True)
    res = tuning.cross_validate(folded, lr, grid, LABEL, "fold", 3, feature_stages=stages, parallelism=3, refit=False)
    log = {(r.fold, r.param_id): r.metric for r in res.fit_log.collect()}
    assert len(log) == 6
    for f in range(3):
        tr, va = folded.where(F.col("fold") != f), folded.where(F.col("fold") == f)
        fitted = stages.fit(tr)
        for j, pm in enumerate(grid):
            scored = lr.copy(pm).fit(fitted.transform(tr)).transform(fitted.transform(va))
            want = scored.agg(F.sqrt(F.avg((F.col(LABEL) - F.col("prediction")) ** 2))).first()[0]
            assert log[(f, j)] == pytest.approx(want, rel=1e-9)
