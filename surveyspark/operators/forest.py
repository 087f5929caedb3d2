"""Random forests that do not depend on partitioning, and one fit for a whole grid.

A library forest draws its bootstrap per partition and takes split candidates from a
row sample, so a repartition changes the model. Here every choice is a function of
the data:

* bagging: a row's weight in tree t is a Poisson(1) number read off the MD5 of its
  key and t;
* split candidates: exact quantiles of each feature over all training rows;
* a node's features: the ones of least MD5 of seed, tree and node (a third of them,
  all if there is one tree);
* sums: the label is rounded to ``digits`` decimals and summed as integers, so sums
  are exact in any order; equal gains go to the earlier feature, then the lower cut.

All trees of all training sets (the rows outside each fold, and all rows) grow side
by side, one level a pass: a task adds its rows to one histogram per (tree, node,
feature, cut) in numpy, Spark sums the histograms, takes running sums over the cuts
and keeps each node's best split, and only the splits reach the driver. A tree's
growth does not depend on its final depth nor on the number of trees, so one fit at
the greatest depth holds every smaller setting: shallower trees are its trees cut at
that depth, smaller forests its first trees. A grid of trees x depths over k folds
takes depth + 1 passes instead of k x grid fits.

Memory: a task holds trees x 2^level x features of a node x bins pairs of integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import ship, written
from .quantiles import exact_quantiles
from .split import HASH_DIGITS
from .tuning import FIT_LOG_SCHEMA, CVResult

MAX_DEPTH = 12
#: P(Poisson(1) <= k) times 2^60 for k = 0, 1, ...: where a hash passes, one more is drawn.
POISSON = [int(p * (1 << 60)) for p in np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)])]


def poisson_weights(key: Sequence[str], salts: Sequence[str]) -> Column:
    """An array of 0 to 8 per salt: Poisson(1), up to a tail of about 1e-6, from the
    row's key. The 15 digits of ``split.key_hash`` are compared as text, which orders
    them as their numbers do; a row's key is spelled once and each hash made once,
    however many salts there are."""
    spelled = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    prefixes = F.array(*[F.lit(f"{salt}|" if key else salt) for salt in salts])
    bounds = [F.lit(f"{bound:0{HASH_DIGITS}x}") for bound in POISSON]

    def weight(digits: Column) -> Column:
        below = F.when(digits < bounds[0], 0)
        for k, bound in enumerate(bounds[1:], 1):
            below = below.when(digits < bound, k)
        return below.otherwise(len(bounds))

    hashes = F.transform(F.array(spelled), lambda text: F.transform(
        prefixes, lambda prefix: F.substring(F.md5(F.concat(prefix, text)), 1, HASH_DIGITS)))
    return F.transform(hashes[0], weight)


def poisson_weight(key: Sequence[str], salt: str) -> Column:
    """The weight of one salt."""
    return poisson_weights(key, [salt])[0]


def node_features(features: int, trees: int, seed: int, tree: int, node: int) -> list[int]:
    """The features a node may split on, ascending."""
    if trees == 1:
        return list(range(features))
    drawn = sorted(range(features), key=lambda f: hashlib.md5(f"{seed}|{tree}|{node}|{f}".encode()).hexdigest())
    return sorted(drawn[:-(-features // 3)])


@dataclass
class Trees:
    """Trees as arrays over (tree, node); node 1 is the root, 2i and 2i + 1 the
    children of i. ``feature`` is -1 where a node has no split."""

    feature: np.ndarray
    cut: np.ndarray  # a value's bin is the number of cuts below it; bins up to this go left
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(trees: int, depth: int) -> Trees:
        shape = (trees, 2 << depth)
        return Trees(np.full(shape, -1), np.zeros(shape, int), np.full(shape, np.nan), np.zeros(shape))

    def step(self, tree: int, node: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """The next node of each row; rows at a leaf stay."""
        f = self.feature[tree, node]
        right = bins[np.arange(len(node)), np.maximum(f, 0)] > self.cut[tree, node]
        return np.where(f < 0, node, 2 * node + right)


def _bins(columns: Sequence[np.ndarray], cuts: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, np.asarray(x, float)) for x, c in zip(columns, cuts)], axis=1)


@dataclass
class Forest:
    """The first ``trees`` trees of a grown set, cut at ``depth``."""

    features: list[str]
    cuts: list[np.ndarray]
    grown: Trees
    trees: int
    depth: int

    def predict(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        bins = _bins(columns, self.cuts)
        total = np.zeros(len(bins))
        for t in range(self.trees):
            node = np.ones(len(bins), int)
            for _ in range(self.depth):
                node = self.grown.step(t, node, bins)
            total += self.grown.value[t, node]
        return total / self.trees

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        @F.pandas_udf("double")
        def scored(*columns: pd.Series) -> pd.Series:
            return pd.Series(self.predict([c.to_numpy() for c in columns]))

        return df.withColumn(output, scored(*(F.col(f"`{f}`").cast("double") for f in self.features)))

    def importances(self, spark: SparkSession, name: str) -> DataFrame:
        """``(model, feature, importance)``: each tree's gains by feature, made one,
        averaged over the trees and made one."""
        total = np.zeros(len(self.features))
        inner = np.arange(self.grown.feature.shape[1]) < 1 << self.depth
        for t in range(self.trees):
            split = inner & (self.grown.feature[t] >= 0)
            own = np.bincount(self.grown.feature[t][split], self.grown.gain[t][split], len(total))
            total += own / own.sum() if own.sum() > 0 else 0.0
        total = total / total.sum() if total.sum() > 0 else total
        return spark.createDataFrame([(name, f, float(x)) for f, x in zip(self.features, total)],
                                     "model string, feature string, importance double")


@dataclass
class GrownGrid:
    """All trees of all training sets: set f < folds is the rows outside fold f, the
    last set all rows."""

    features: list[str]
    cuts: list[np.ndarray]
    sets: list[Trees]
    data: DataFrame
    folds: int
    depth: int
    trees: int

    def forest(self, trees: int, depth: int) -> Forest:
        """A forest fitted on all rows."""
        if not (0 < trees <= self.trees and 0 <= depth <= self.depth):
            raise ValueError("the grid holds no forest so large")
        return Forest(self.features, self.cuts, self.sets[-1], trees, depth)

    def fit_log(self, grid: Sequence[tuple[int, int]]) -> DataFrame:
        """RMSE on each fold of each (trees, depth), fitted on the other folds, in
        the form of ``tuning.cross_validate``'s fit log."""
        for trees, depth in grid:
            self.forest(trees, depth)
        own, cuts, sets, wanted = self.features, self.cuts, self.sets[:self.folds], sorted({d for _, d in grid})
        counts = sorted({n for n, _ in grid})

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int, int], list[float]] = {}
            for batch in batches:
                bins = _bins([batch.column(f"x{i}").to_numpy() for i in range(len(own))], cuts)
                label, fold = batch.column("label").to_numpy(), batch.column("fold").to_numpy()
                for f, trees in enumerate(sets):
                    mine = bins[fold == f]
                    if not len(mine):
                        continue
                    node = np.ones((max(counts), len(mine)), int)
                    for d in range(max(wanted) + 1):
                        if d:
                            node = np.stack([trees.step(t, node[t], mine) for t in range(len(node))])
                        if d not in wanted:
                            continue
                        total = np.cumsum(np.take_along_axis(trees.value[:len(node)], node, axis=1), axis=0)
                        for n in counts:
                            miss = np.square(label[fold == f] - total[n - 1] / n).sum()
                            have = sums.setdefault((f, n, d), [0.0, 0])
                            have[0] += float(miss)
                            have[1] += len(mine)
            if sums:
                f, n, d = zip(*sums)
                miss, rows = zip(*sums.values())
                yield pa.RecordBatch.from_pydict({"fold": pa.array(f, pa.int32()), "trees": pa.array(n, pa.int32()),
                                                  "depth": pa.array(d, pa.int32()), "miss": miss, "rows": pa.array(rows, pa.int64())})

        spark = self.data.sparkSession
        scores = self.data.mapInArrow(scored, "fold int, trees int, depth int, miss double, rows long")
        points = spark.createDataFrame(
            [(i, n, d, f"maxDepth={d} numTrees={n}") for i, (n, d) in enumerate(grid)],
            "param_id int, trees int, depth int, params string")
        log = (scores.groupBy("fold", "trees", "depth").agg(F.sqrt(F.sum("miss") / F.sum("rows")).alias("metric"))
               .join(F.broadcast(points), ["trees", "depth"]))  # one row per grid point
        rows = log.select(*FIT_LOG_SCHEMA.names).collect()  # folds x grid numbers
        if len(rows) != self.folds * len(grid):
            raise ValueError("a fold without rows")
        return spark.createDataFrame(sorted(map(tuple, rows)), FIT_LOG_SCHEMA)


def search(grown: GrownGrid, grid: Sequence[tuple[int, int]]) -> CVResult:
    """The (trees, depth) of least mean RMSE over the folds, ties to the earlier;
    the best model is the forest of that size grown on all rows."""
    log = grown.fit_log(grid)
    values: dict[int, list[float]] = {}
    for r in log.collect():  # folds x grid rows
        values.setdefault(r["param_id"], []).append(r["metric"])
    means = [sum(values[j]) / len(values[j]) for j in range(len(grid))]
    best = min(range(len(grid)), key=lambda j: (means[j], j))
    trees, depth = grid[best]
    return CVResult(log, means, best, f"maxDepth={depth} numTrees={trees}", grown.forest(trees, depth), "rmse", True)


def cuts_of(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Per feature up to ``bins - 1`` split candidates: the distinct exact quantiles."""
    names = [f"q{i}" for i in range(1, bins)]
    cells = F.array(*(F.struct(F.lit(i).alias("position"), F.col(f"`{f}`").cast("double").alias("value")) for i, f in enumerate(features)))
    rows = exact_quantiles(df.select(F.inline(cells)), "value", ["position"], [i / bins for i in range(1, bins)], names=names)
    found = {r["position"]: np.unique([r[n] for n in names]) for r in rows.collect()}  # one row a feature
    return [found.get(i, np.empty(0)) for i in range(len(features))]


def grow(df: DataFrame, features: Sequence[str], label: str, key: Sequence[str], trees: int = 20, depth: int = 5,
         fold_col: str | None = None, folds: int = 0, seed: int = 42, bins: int = 32, digits: int = 6) -> GrownGrid:
    """Grow ``trees`` trees of ``depth`` on all rows, and on all but each of
    ``folds`` folds. ``key`` tells rows apart; one tree alone is grown on all rows
    with weight 1 and splits on any feature. Missing values are refused.
    """
    if not 0 <= depth <= MAX_DEPTH or trees < 1 or bins < 2:
        raise ValueError(f"one tree or more, of a depth up to {MAX_DEPTH}, and two bins or more")
    ship(df.sparkSession)
    own, p = list(features), len(features)
    weights = (poisson_weights(key, [f"{seed}|tree {t}" for t in range(trees)]) if trees > 1 else F.array(F.lit(1)))
    y = F.col(f"`{label}`").cast("double")
    data = written(df.select(
        *(F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(own)), y.alias("label"),
        F.when(~F.isnan(y), F.round(y * 10**digits).cast("long")).alias("y"),
        (F.col(fold_col) if fold_col else F.lit(-1)).cast("int").alias("fold"), weights.cast("array<int>").alias("w")))
    used = {f"x{i}": f for i, f in enumerate(own)} | {"label": label}
    holes = data.agg(*[F.count_if(F.col(x).isNull() | F.isnan(x)).alias(x) for x in used], F.count(F.lit(1)).alias("n")).first()
    if missing := [c for x, c in used.items() if holes[x]]:
        raise ValueError(f"missing values in {', '.join(missing)}: drop or fill them first")
    if not holes["n"]:
        raise ValueError("no rows to fit")
    cuts = cuts_of(data, [f"x{i}" for i in range(p)], bins)
    sets = [Trees.empty(trees, depth) for _ in range(folds + 1)]
    width = max(len(c) for c in cuts) + 1 if cuts else 1
    unit = 10.0 ** -digits
    for level in range(depth):
        best = _best_splits(data, sets, cuts, level, width, p, trees, seed).collect()  # one row a node
        for r in best:
            grown, t, node = sets[r["set_no"]], r["tree"], r["node"]
            n, s = float(r["n"]), float(r["s"])
            grown.value[t, node] = s / n * unit
            if r["gain"] is None or not r["gain"] > 0:
                continue
            nl, sl = float(r["nl"]), float(r["sl"])
            grown.feature[t, node], grown.cut[t, node], grown.gain[t, node] = r["feature"], r["bin"], r["gain"]
            grown.value[t, 2 * node], grown.value[t, 2 * node + 1] = sl / nl * unit, float(r["s"] - r["sl"]) / (n - nl) * unit
    if not depth:
        for r in _best_splits(data, sets, cuts, 0, width, p, trees, seed).collect():
            sets[r["set_no"]].value[r["tree"], 1] = float(r["s"]) / float(r["n"]) * unit
    return GrownGrid(own, cuts, sets, data, folds, depth, trees)


def _whole_sums(at: np.ndarray, numbers: np.ndarray, cells: int) -> np.ndarray:
    """Sums of whole numbers by cell, exact: in doubles while no sum can pass 2^53."""
    if np.abs(numbers.astype(float)).max(initial=0.0) * len(numbers) < 2.0**53:
        return np.bincount(at, numbers, cells).astype(np.int64)
    total = np.zeros(cells, np.int64)
    np.add.at(total, at, numbers)
    return total


def _best_splits(data: DataFrame, sets: list[Trees], cuts: list[np.ndarray], level: int, width: int, p: int,
                 trees: int, seed: int) -> DataFrame:
    """Per open node of ``level`` its sums and best split: one pass over the rows."""
    first, nodes, last = 1 << level, 1 << level, len(sets) - 1
    allowed = np.array([[node_features(p, trees, seed, t, first + i) for i in range(nodes)] for t in range(trees)])
    each = allowed.shape[2]  # features a node may split on: only these are counted
    place = np.arange(each)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, last + 1, trees, nodes * each * width), np.int64)
        for batch in batches:
            bins = _bins([batch.column(f"x{i}").to_numpy() for i in range(p)], cuts)
            y, fold = batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            weight = batch.column("w").flatten().to_numpy().reshape(len(y), trees)
            for s, grown in enumerate(sets):
                for t in range(trees):
                    rows = np.flatnonzero((weight[:, t] > 0) & ((fold != s) | (s == last)))
                    mine, w = bins[rows], weight[rows, t].astype(np.int64)
                    node = np.ones(len(rows), int)
                    for _ in range(level):
                        node = grown.step(t, node, mine)
                    live = node >= first
                    if not live.all():
                        rows, mine, w, node = rows[live], mine[live], w[live], node[live]
                    node = node - first
                    at = ((node[:, None] * each + place) * width + np.take_along_axis(mine, allowed[t, node], axis=1)).ravel()
                    for total, number in zip(sums[:, s, t], (w, w * y[rows])):
                        total += _whole_sums(at, np.repeat(number, each), len(total))
        sums = sums.reshape(2, last + 1, trees, nodes, each, width)
        s, t, node, f, b = np.nonzero(sums[0])
        for start in range(0, len(s), 50_000):
            part = slice(start, start + 50_000)
            cell = (s[part], t[part], node[part], f[part], b[part])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int32()) for x in (s[part], t[part], node[part] + first, allowed[cell[1], cell[2], cell[3]], b[part])]
                + [pa.array(sums[0][cell]), pa.array(sums[1][cell])], ["set_no", "tree", "node", "feature", "bin", "w", "wy"])

    cells = data.mapInArrow(counted, "set_no int, tree int, node int, feature int, bin int, w long, wy long")
    exact = "decimal(38,0)"
    summed = cells.groupBy("set_no", "tree", "node", "feature", "bin").agg(
        F.sum(F.col("w").cast("decimal(20,0)")).cast(exact).alias("w"), F.sum(F.col("wy").cast("decimal(20,0)")).cast(exact).alias("wy"))
    one = Window.partitionBy("set_no", "tree", "node", "feature")  # at most `bins` rows
    upto = one.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (summed.withColumn("nl", F.sum("w").over(upto).cast(exact)).withColumn("sl", F.sum("wy").over(upto).cast(exact))
           .withColumn("n", F.sum("w").over(one).cast(exact)).withColumn("s", F.sum("wy").over(one).cast(exact)))
    n, s, nl, sl = (F.col(c).cast("double") for c in ("n", "s", "nl", "sl"))
    nr, sr = n - nl, (F.col("s") - F.col("sl")).cast("double")
    gain = F.when(nr > 0, sl * sl / nl + sr * sr / nr - s * s / n)
    ranked = Window.partitionBy("set_no", "tree", "node").orderBy(F.col("gain").desc_nulls_last(), "feature", "bin")
    return cut.withColumn("gain", gain).withColumn("rank", F.row_number().over(ranked)).where("rank = 1")
