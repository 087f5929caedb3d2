"""Bounded samples that do not depend on partitioning.

The rows of least key hash are a uniform sample without replacement, the same rows on
any cluster, and mergeable: the k least of two parts' k least are the whole's. Each
task passes on at most k rows (a group), so a hot group shuffles k rows a task; for
groups this holds up to ``spark.sql.optimizer.windowGroupLimitThreshold`` rows (1,000).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bottom_k(df: DataFrame, order: Column, k: int, groups: Sequence[str] = (), tiebreak: Sequence[str] = (),
             weight_col: str = "weight") -> DataFrame:
    """At most ``k`` rows of ``df``, per group if ``groups`` are named, those of least
    ``order`` (ties by ``tiebreak``). ``weight_col`` is how many rows each stands
    for: the group's rows over its sampled rows. A missing group is a group."""
    if k < 1:
        raise ValueError("a sample has at least one row")
    hashed = df.withColumn("_order", order)
    if not groups:
        n = df.count()
        picked = hashed.orderBy("_order", *tiebreak).limit(k)
        return picked.drop("_order").withColumn(weight_col, F.lit(n / min(k, n) if n else 1.0))
    first = Window.partitionBy(*groups).orderBy("_order", *tiebreak)
    picked = hashed.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= k).drop("_order", "_place")
    g = [f"_g{i}" for i in range(len(groups))]
    sizes = df.groupBy(*[F.col(f"`{c}`").alias(a) for c, a in zip(groups, g)]).agg(F.count(F.lit(1)).alias("_n"))
    same = F.lit(True)
    for c, a in zip(groups, g):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(a))
    weight = F.col("_n").cast("double") / F.least(F.col("_n"), F.lit(k))
    return picked.join(sizes, same).withColumn(weight_col, weight).drop("_n", *g)
