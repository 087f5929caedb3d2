"""Partition-independent forests: against an exhaustive numpy tree, a repartition,
and direct fits of every smaller setting."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyspark import catalog as C
from surveyspark.operators import forest as ft
from surveyspark.operators import split as sp
from surveyspark.plans import plan_text
from surveyspark.sources import LABEL, MODEL_FEATURES, SURVEY_KEY

from .conftest import SF_SMALL


def same(a: ft.Trees, b: ft.Trees, trees: int, nodes: int) -> bool:
    return (np.array_equal(a.feature[:trees, :nodes], b.feature[:trees, :nodes])
            and np.array_equal(a.cut[:trees, :nodes], b.cut[:trees, :nodes])
            and np.array_equal(a.value[:trees, :nodes], b.value[:trees, :nodes], equal_nan=True))


@pytest.fixture(scope="module")
def folded(spark):
    train, _ = C.train_test(spark, SF_SMALL)
    return sp.with_folds(train, C.portable_hash("fold"), 4)


@pytest.fixture(scope="module")
def grown(folded):
    return ft.grow(folded, MODEL_FEATURES, LABEL, SURVEY_KEY, trees=4, depth=4, fold_col="fold", folds=4)


def numbers(spark, n=500, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 3, (n, 3)), 1)
    x[:, 2] = rng.integers(0, 3, n)
    y = np.round(2 * (x[:, 0] > 1) + x[:, 2] * (x[:, 1] < 0) + rng.normal(0, 0.3, n), 3)
    rows = [(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "id long, a double, b double, c double, y double")


def exhaustive(x, y, cuts, depth, node=1, out=None):
    """node -> (feature, cut number) by trying every cut of every feature."""
    out = {} if out is None else out
    if depth and len(y):
        best = None
        for f in range(x.shape[1]):
            for k, c in enumerate(cuts[f]):
                left = x[:, f] <= c
                if 0 < left.sum() < len(y):
                    gain = y[left].sum()**2 / left.sum() + y[~left].sum()**2 / (~left).sum() - y.sum()**2 / len(y)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, f, k, left)
        if best:
            _, f, k, left = best
            out[node] = (f, k)
            exhaustive(x[left], y[left], cuts, depth - 1, 2 * node, out)
            exhaustive(x[~left], y[~left], cuts, depth - 1, 2 * node + 1, out)
    return out


def test_one_tree_equals_exhaustive_search(spark):
    x, y, df = numbers(spark)
    grid = ft.grow(df, ["a", "b", "c"], "y", ["id"], trees=1, depth=3, bins=16)
    for f in range(3):
        assert np.allclose(grid.cuts[f], np.unique(np.percentile(x[:, f], [100 * i / 16 for i in range(1, 16)])))
    want = exhaustive(x, y, grid.cuts, 3)
    tree = grid.sets[-1]
    assert {i: (tree.feature[0, i], tree.cut[0, i]) for i in np.flatnonzero(tree.feature[0] >= 0)} == want
    left = x[:, want[1][0]] <= grid.cuts[want[1][0]][want[1][1]]
    assert tree.value[0, 2] == pytest.approx(y[left].mean()) and tree.value[0, 1] == pytest.approx(y.mean())
    scored = grid.forest(1, 3).transform(df).select("y", "prediction").collect()
    assert len({r.prediction for r in scored}) <= 8
    assert np.mean([(r.y - r.prediction)**2 for r in scored]) < 0.5 * np.var(y)


def test_a_repartition_changes_nothing(folded, grown):
    again = ft.grow(folded.repartition(3), MODEL_FEATURES, LABEL, SURVEY_KEY, trees=4, depth=4, fold_col="fold", folds=4)
    assert all(same(a, b, 4, 32) for a, b in zip(grown.sets, again.sets))
    grid = [(2, 2), (4, 4)]
    assert [round(r.metric, 9) for r in grown.fit_log(grid).collect()] == [round(r.metric, 9) for r in again.fit_log(grid).collect()]


def test_smaller_settings_are_cut_from_the_grown_trees(spark, folded, grown):
    direct = ft.grow(folded, MODEL_FEATURES, LABEL, SURVEY_KEY, trees=2, depth=2, fold_col="fold", folds=4)
    assert all(same(a, b, 2, 4) for a, b in zip(grown.sets, direct.sets))
    assert [r.metric for r in direct.fit_log([(2, 2)]).collect()] == pytest.approx([r.metric for r in grown.fit_log([(2, 2)]).collect()])
    fold0 = folded.where("fold <> 0")
    alone = ft.grow(fold0, MODEL_FEATURES, LABEL, SURVEY_KEY, trees=2, depth=2)
    if all(np.array_equal(a, b) for a, b in zip(alone.cuts, direct.cuts)):
        assert same(alone.sets[0], direct.sets[0], 2, 4)
    rows = folded.where("fold = 0")
    kept = ft.Forest(grown.features, grown.cuts, grown.sets[0], 2, 2).transform(rows)
    want = kept.agg(F.sqrt(F.avg((F.col(LABEL) - F.col("prediction"))**2))).first()[0]
    assert grown.fit_log([(2, 2)]).where("fold = 0").first().metric == pytest.approx(want, rel=1e-9)


def test_bagging_weights_are_poisson(spark):
    w = [r[0] for r in spark.range(20_000).select(ft.poisson_weight(["id"], "s")).collect()]
    assert np.mean(w) == pytest.approx(1, abs=0.03) and np.var(w) == pytest.approx(1, abs=0.05)
    assert np.mean(np.array(w) == 0) == pytest.approx(np.exp(-1), abs=0.015)


def test_importances_and_edge_cases(spark, grown):
    imps = {r.feature: r.importance for r in grown.forest(4, 4).importances(spark, "f").collect()}
    assert sum(imps.values()) == pytest.approx(1) and max(imps, key=imps.get) == "prim_min"
    _, y, df = numbers(spark, 60)
    flat = ft.grow(df, ["a"], "y", ["id"], trees=1, depth=0)
    assert {round(r.prediction, 9) for r in flat.forest(1, 0).transform(df).collect()} == {round(float(y.mean()), 9)}
    same_y = ft.grow(df.withColumn("y", F.lit(2.5)), ["a", "b"], "y", ["id"], trees=2, depth=3)
    assert (same_y.sets[0].feature == -1).all()
    assert sum(r.importance for r in same_y.forest(2, 3).importances(spark, "f").collect()) == 0
    for bad in (df.withColumn("a", F.when(F.col("id") != 3, F.col("a"))), df.withColumn("b", F.when(F.col("id") == 3, float("nan")).otherwise(F.col("b"))),
                df.limit(0)):
        with pytest.raises(ValueError):
            ft.grow(bad, ["a", "b"], "y", ["id"])
    for wrong in ({"trees": 0}, {"depth": 40}, {"bins": 1}):
        with pytest.raises(ValueError):
            ft.grow(df, ["a"], "y", ["id"], **wrong)
    with pytest.raises(ValueError):
        grown.forest(5, 4)


def test_search_takes_a_pass_a_level(spark, folded, monkeypatch):
    levels = []
    best = ft._best_splits
    monkeypatch.setattr(ft, "_best_splits", lambda *a: levels.append(a[3]) or best(*a))
    grid = ft.grow(folded, MODEL_FEATURES, LABEL, SURVEY_KEY, trees=3, depth=3, fold_col="fold", folds=4)
    found = ft.search(grid, [(n, d) for n in (1, 2, 3) for d in (1, 2, 3)])
    assert levels == [0, 1, 2] and found.fit_log.count() == 36
    assert (found.best_model.trees, found.best_model.depth) == [(n, d) for n in (1, 2, 3) for d in (1, 2, 3)][found.best_index]


def test_weights_hash_a_key_once_a_tree(spark):
    df = spark.createDataFrame([(i, "x|y" if i % 3 else None) for i in range(200)], "id long, s string")
    salts = [f"7|tree {t}" for t in range(6)]
    drawn = df.select("id", "s", ft.poisson_weights(["id", "s"], salts).alias("w"))
    assert plan_text(drawn).count("md5(") <= 2  # in the plan's tree and its details; 8 a tree before
    for r in drawn.collect():
        for salt, w in zip(salts, r.w, strict=True):
            u = int(hashlib.md5(f"{salt}|{r.id}|{r.s or ''}".encode()).hexdigest()[:15], 16)
            assert w == sum(u >= bound for bound in ft.POISSON)


def test_source_rows_are_read_once(spark):
    _, _, df = numbers(spark, 100)
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        read.add(1)
        return x

    ft.grow(df.withColumn("a", counted("a")), ["a", "b"], "y", ["id"], trees=2, depth=2)
    assert read.value == 100
    with pytest.raises(ValueError, match="missing values in y"):
        ft.grow(df.withColumn("y", F.lit(float("nan"))), ["a", "b"], "y", ["id"])


def test_whole_sums_are_exact(spark):
    at = np.array([0, 1, 0, 0])
    for big in (5, 2**53, 2**61):
        assert ft._whole_sums(at, np.array([big, 1, 1, -3]), 2).tolist() == [big - 2, 1]
    assert ft._whole_sums(at[:0], at[:0], 2).tolist() == [0, 0]
