"""Exact quantiles per group without holding a group in one task.

``percentile`` merges every distinct value of a group into one buffer in
one task; for a hot group of continuous values that is unbounded. Here the
order statistics behind each quantile are found by interval refinement:

1. per group: total weight ``n``, ``min``, ``max``; each quantile ``p``
   needs the values at 0-based ranks ``floor(p (n-1))`` and the next one
   (linear interpolation, as ``quantile_cont`` / ``numpy.percentile``);
2. each target rank keeps a value interval ``[lo, hi]`` known to contain it
   and the weight below ``lo``; one pass counts the rows of each interval in
   at most ``buckets`` sub-buckets (partial sums map-side, so only bucket
   counts are shuffled, never values), and the bucket holding the rank,
   shrunk to its own min/max, becomes the new interval;
3. a target is done when its interval is a single value.

Buckets split by sign while an interval spans zero, by logarithm while its
ends differ by more than ``LINEAR_RATIO``, and by equal width below that, so
any doubles need one sign pass, about two logarithmic and at most seven linear
ones with 1,024 buckets: there is one path, it always ends, and nothing is
ranked.

Every pass reads ``df`` again, narrowed to the group, value and weight columns
(cheap over a written table), and leaves only per-target state (groups x 2 x
quantiles rows), written so that lineage stays short and removed when the next
one stands. The join of rows with their group's intervals is left to the
optimizer: the interval side is small and broadcast once AQE has measured it, and
an ordinary, skew-splittable join otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import drop_written, written

LINEAR_RATIO = 1024.0


def _bucket(v: Column, lo: Column, hi: Column, buckets: int) -> Column:
    """Sub-bucket of ``v`` in ``[lo, hi]``; never decreasing in ``v``."""
    last = F.lit(buckets - 1)
    small, large = F.least(F.abs(lo), F.abs(hi)), F.greatest(F.abs(lo), F.abs(hi))
    span = F.log2(F.abs(hi)) - F.log2(F.abs(lo))     # negative below zero, as v moves
    logarithmic = F.floor((F.log2(F.abs(v)) - F.log2(F.abs(lo))) / span * buckets)
    linear = F.floor((v - lo) / (hi - lo) * buckets)  # one sign here, so hi - lo is finite
    return (F.when((lo < 0) & (hi > 0) | (small == 0), F.signum(v) + 1)
             .when(large / LINEAR_RATIO > small, F.least(F.greatest(logarithmic, F.lit(0)), last))
             .otherwise(F.least(linear, last))).cast("int")


def exact_quantiles(df: DataFrame, value: str, groups: Sequence[str], probs: Sequence[float],
                    weight: str | None = None, buckets: int = 1024,
                    names: Sequence[str] | None = None) -> DataFrame:
    """``groups`` + one column per probability (``q0, q1, ...`` or ``names``).

    Missing values and groups are left out; NaN counts as missing.
    """
    names = list(names) if names else [f"q{i}" for i in range(len(probs))]
    g = [f"_g{i}" for i in range(len(groups))]
    w = F.col(f"`{weight}`").cast("long") if weight else F.lit(1).cast("long")
    base = df.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(groups, g)],
                     F.col(f"`{value}`").cast("double").alias("_v"), w.alias("_w")).dropna()
    base = base.withColumn("_v", F.col("_v") + F.lit(0.0))   # one zero
    stats = written(base.groupBy(*g).agg(F.sum("_w").alias("_n"), F.min("_v").alias("_min"),
                                         F.max("_v").alias("_max")))
    targets = []
    for i, p in enumerate(probs):
        k = F.floor(F.lit(float(p)) * (F.col("_n") - 1).cast("double")).cast("long")
        targets.append(F.struct(F.lit(2 * i).alias("_t"), k.alias("_rank")))
        targets.append(F.struct(F.lit(2 * i + 1).alias("_t"),
                                F.least(k + 1, F.col("_n") - 1).alias("_rank")))
    state = (stats.select(*g, "_min", "_max", F.inline(F.array(*targets)))
                  .select(*g, "_t", "_rank", F.col("_min").alias("_lo"), F.col("_max").alias("_hi"),
                          F.lit(0).cast("long").alias("_below")))
    state = written(state)
    while not state.where(F.col("_lo") < F.col("_hi")).isEmpty():
        narrowed = written(_refine(base, state, g, buckets))
        drop_written(state)
        state = narrowed

    picks = []
    for i, name in enumerate(names):
        picks.append(F.max(F.when(F.col("_t") == 2 * i, F.col("_lo"))).alias(f"_a{i}"))
        picks.append(F.max(F.when(F.col("_t") == 2 * i + 1, F.col("_lo"))).alias(f"_b{i}"))
    out = state.groupBy(*g).agg(*picks).join(stats.select(*g, "_n"), g)
    exprs = []
    for i, (p, name) in enumerate(zip(probs, names)):
        pos = F.lit(float(p)) * (F.col("_n") - 1).cast("double")
        a, b = F.col(f"_a{i}"), F.col(f"_b{i}")
        exprs.append((a + (b - a) * (pos - F.floor(pos))).alias(name))
    return out.select(*[F.col(a).alias(c) for c, a in zip(groups, g)], *exprs)


def _refine(base: DataFrame, state: DataFrame, g: list[str], buckets: int) -> DataFrame:
    """One pass: narrow every open target to the sub-bucket holding its rank."""
    v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
    open_ = state.where(lo < hi)
    intervals = open_.select(*g, "_lo", "_hi", "_below").distinct()   # targets share intervals at first
    key = [*g, "_lo", "_hi", "_below"]
    counts = (base.join(intervals, g).where((v >= lo) & (v <= hi))
                  .select(*key, _bucket(v, lo, hi, buckets).alias("_b"), "_v", "_w")
                  .groupBy(*key, "_b").agg(F.sum("_w").alias("_c"), F.min("_v").alias("_bmin"),
                                           F.max("_v").alias("_bmax")))
    running = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("_end", F.col("_below") + F.sum("_c").over(running))  # at most `buckets` rows a key
    hit = (open_.join(counts, key).where((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_c")))
                .select(*g, "_t", "_rank", F.col("_bmin").alias("_lo"), F.col("_bmax").alias("_hi"),
                        (F.col("_end") - F.col("_c")).alias("_below")))
    return state.where(lo >= hi).unionByName(hit)
