"""Distributions: equal-width bins, histograms, box statistics per group,
joint (2-D) histograms, pairwise correlations, most frequent values.

Plots are replaced by the aggregates behind them. Every operator is one or
two aggregation passes; ranges come from a ``min``/``max`` aggregate whose
two numbers enter the row expressions as constants. No data row reaches the
driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binning import bin_index, bin_label, bin_lower, bin_upper
from .frequent import most_frequent
from .quantiles import exact_quantiles


def _valid(column: str, exclude: Sequence | None) -> Column:
    x = F.col(column)
    return (x.isNotNull() & ~x.isin(list(exclude))) if exclude else x.isNotNull()


def value_range(df: DataFrame, column: str, exclude: Sequence | None = None
                ) -> tuple[float | None, float | None]:
    """``(lo, hi)`` of the non-null, non-excluded values: one small action
    returning two numbers, used as literals by the bin expressions."""
    x = F.col(column).cast("double")
    row = df.where(_valid(column, exclude)).agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    return row["lo"], row["hi"]


def _lit(v) -> Column:
    return F.lit(v).cast("double")


def with_bins(df: DataFrame, column: str, n: int, labels: Sequence[str] | None = None,
              exclude: Sequence | None = None, out: str = "bin") -> DataFrame:
    """Attach ``{out}``, ``{out}_label``, ``{out}_lo``, ``{out}_hi``.

    ``n`` equal-width, left-closed bins over the observed range (the maximum
    falls in the last bin). Values listed in ``exclude`` (sentinel codes)
    neither shape the range nor get a bin; by default every value counts,
    sentinels included, as in the analysed notebook.

    The range is fetched first (one aggregate, two numbers) and enters the
    row expressions as constants; the input is read twice, so write an
    expensive input first.
    """
    lo_v, hi_v = value_range(df, column, exclude)
    lo, hi = _lit(lo_v), _lit(hi_v)
    x = F.when(_valid(column, exclude), F.col(column).cast("double"))
    b = F.col(out)
    return (df.withColumn(out, bin_index(x, lo, hi, n))
              .withColumn(f"{out}_label", bin_label(b, labels))
              .withColumn(f"{out}_lo", bin_lower(b, lo, hi, n))
              .withColumn(f"{out}_hi", bin_upper(b, lo, hi, n)))


def bin_counts(df: DataFrame, column: str, n: int, labels: Sequence[str] | None = None,
               exclude: Sequence | None = None) -> DataFrame:
    """Frequency of each non-empty bin (value counts of the binned column)."""
    binned = with_bins(df.select(column), column, n, labels, exclude)
    return (binned.where(F.col("bin").isNotNull())
                  .groupBy("bin", "bin_label", "bin_lo", "bin_hi")
                  .agg(F.count(F.lit(1)).alias("n")))


def histogram(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """``n`` equal-width bins with counts, empty bins included (count 0)."""
    src = df.select(column)
    lo_v, hi_v = value_range(src, column)
    lo, hi = _lit(lo_v), _lit(hi_v)
    counts = (src.select(bin_index(F.col(column).cast("double"), lo, hi, n).alias("bin"))
                 .where(F.col("bin").isNotNull())
                 .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    frame = (df.sparkSession.range(1, n + 1, numPartitions=1)
             .select(F.col("id").cast("int").alias("bin")))
    b = F.col("bin")
    return (frame.join(F.broadcast(counts), "bin", "left")   # at most n rows
                 .select("bin", bin_lower(b, lo, hi, n).alias("bin_lo"),
                         bin_upper(b, lo, hi, n).alias("bin_hi"),
                         F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))


def box_stats(df: DataFrame, value: str, groups: str | Sequence[str],
              whisker: float = 1.5) -> DataFrame:
    """Box-plot statistics of ``value`` per group.

    Quartiles interpolate linearly; whiskers reach the furthest value within
    ``whisker * IQR`` of the box and never into it; outliers are the values
    beyond the whiskers. Rows with a missing group or value are left out.

    Plan: one map-side aggregate for count, sum and range, the passes of
    ``quantiles.exact_quantiles`` for the quartiles, and one more aggregate that
    places the whiskers, over rows joined with their group's fences (one row per
    group). Only partial aggregates are shuffled; no task holds a group. The
    input is read again by each pass, so write an expensive one first.
    """
    gcols = [groups] if isinstance(groups, str) else list(groups)
    g = [f"_g{i}" for i in range(len(gcols))]
    src = df.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(gcols, g)],
                    F.col(f"`{value}`").cast("double").alias("_x")).dropna()
    x = F.col("_x")
    quarts = exact_quantiles(src, "_x", g, [0.25, 0.5, 0.75], names=["_q1", "_q2", "_q3"])
    moments = src.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"), F.avg(x).alias("_mean"),
                                  F.min(x).alias("_min"), F.max(x).alias("_max"))
    reach_of = F.lit(whisker) * (F.col("_q3") - F.col("_q1"))
    fences = quarts.select(*g, (F.col("_q1") - reach_of).alias("_lo"), (F.col("_q3") + reach_of).alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    reach = (src.join(fences, g).groupBy(*g)
                .agg(F.min(F.when(x >= lo, x)).alias("_wlo"), F.max(F.when(x <= hi, x)).alias("_whi"),
                     F.count_if((x < lo) | (x > hi)).alias("_out")))
    q1, q3, wlo, whi = (F.col(c) for c in ("_q1", "_q3", "_wlo", "_whi"))
    return moments.join(quarts, g).join(reach, g).select(
        *[F.col(a).alias(c) for c, a in zip(gcols, g)], F.col("_n").alias("n"), F.col("_mean").alias("mean"),
        q1.alias("q1"), F.col("_q2").alias("median"), q3.alias("q3"), (q3 - q1).alias("iqr"),
        F.when(wlo.isNull() | (wlo > q1), q1).otherwise(wlo).alias("whislo"),
        F.when(whi.isNull() | (whi < q3), q3).otherwise(whi).alias("whishi"),
        F.col("_out").cast("bigint").alias("n_outliers"), F.col("_min").alias("min"), F.col("_max").alias("max"))


def joint_histogram(df: DataFrame, x: str, y: str, nx: int = 10, ny: int = 10) -> DataFrame:
    """Counts over an ``nx`` x ``ny`` grid of equal-width bins (non-empty cells),
    with each cell's marginal counts and the Pearson correlation of the rows.

    Two passes: ranges and correlation (one row, constants below), then the
    cells; marginals are sums over at most ``nx * ny`` cells.
    """
    src = df.select(F.col(f"`{x}`").cast("double").alias("_x"), F.col(f"`{y}`").cast("double").alias("_y")).dropna()
    xd, yd = F.col("_x"), F.col("_y")
    r = src.agg(F.min(xd).alias("xlo"), F.max(xd).alias("xhi"), F.min(yd).alias("ylo"),
                F.max(yd).alias("yhi"), F.corr(xd, yd).alias("r")).first()
    bx = bin_index(xd, _lit(r["xlo"]), _lit(r["xhi"]), nx)
    by = bin_index(yd, _lit(r["ylo"]), _lit(r["yhi"]), ny)
    cells = (src.select(bx.alias("bin_x"), by.alias("bin_y"))
                .groupBy("bin_x", "bin_y").agg(F.count(F.lit(1)).alias("n")))
    return cells.select("*", F.sum("n").over(Window.partitionBy("bin_x")).alias("n_x"),
                        F.sum("n").over(Window.partitionBy("bin_y")).alias("n_y"), _lit(r["r"]).alias("corr"))


def column_histograms(df: DataFrame, columns: Sequence[str], n: int = 10) -> DataFrame:
    """``column_name, bin, bin_lo, bin_hi, n`` for every column (non-empty bins),
    as the diagonal of the pairwise view.

    Two passes for any number of columns: all ranges, then all counts; rows are
    turned long within the task and combined before the shuffle.
    """
    cols = list(columns)
    x = [F.col(f"`{c}`").cast("double") for c in cols]
    r = df.agg(*[F.min(e).alias(f"lo{i}") for i, e in enumerate(x)],
               *[F.max(e).alias(f"hi{i}") for i, e in enumerate(x)]).first()
    ends = [(_lit(r[f"lo{i}"]), _lit(r[f"hi{i}"])) for i in range(len(cols))]
    bins = F.array(*[F.struct(F.lit(i).alias("i"), bin_index(e, lo, hi, n).alias("bin"))
                     for i, (e, (lo, hi)) in enumerate(zip(x, ends))])
    counts = (df.select(F.inline(bins)).where(F.col("bin").isNotNull())
                .groupBy("i", "bin").agg(F.count(F.lit(1)).alias("n")))
    at = F.col("i") + 1
    lo, hi = (F.element_at(F.array(*[e[k] for e in ends]), at) for k in (0, 1))
    b = F.col("bin")
    return counts.select(F.element_at(F.array(*map(F.lit, cols)), at).alias("column_name"), "bin",
                         bin_lower(b, lo, hi, n).alias("bin_lo"), bin_upper(b, lo, hi, n).alias("bin_hi"), "n")


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair ``i < j`` over the rows where both
    columns hold a value.

    Two passes: the first (an action returning ``k`` means) finds a centring
    shift; the second is one wide map-side aggregate of six sums per pair, each
    over the pair's own rows, so missing values need no other path. Null for
    pairs without spread.
    """
    cols = list(columns)
    x = [F.col(f"`{c}`").cast("double") for c in cols]
    means = df.agg(*[F.avg(e).alias(f"m{i}") for i, e in enumerate(x)]).first()
    d = [e - F.lit(float(means[f"m{i}"] or 0.0)) for i, e in enumerate(x)]
    pairs, aggs = [], []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            both = d[i].isNotNull() & d[j].isNotNull()
            terms = {"n": F.lit(1.0), "sx": d[i], "sy": d[j], "pxy": d[i] * d[j], "pxx": d[i] * d[i], "pyy": d[j] * d[j]}
            aggs += [F.sum(F.when(both, t)).alias(f"{name}_{i}_{j}") for name, t in terms.items()]
            pairs.append(F.struct(F.lit(cols[i]).alias("col_x"), F.lit(cols[j]).alias("col_y"),
                                  *[F.col(f"{name}_{i}_{j}").alias(name) for name in terms]))
    n = F.col("n")
    cxy = F.col("pxy") - F.col("sx") * F.col("sy") / n
    cxx = F.col("pxx") - F.col("sx") * F.col("sx") / n
    cyy = F.col("pyy") - F.col("sy") * F.col("sy") / n
    den = F.sqrt(cxx * cyy)
    return (df.agg(*aggs).select(F.inline(F.array(*pairs)))
              .select("col_x", "col_y", F.when(den > 0, cxy / den).alias("corr")))


def top_values(df: DataFrame, column: str, k: int = 25, dropna: bool = False) -> DataFrame:
    """The ``k`` most frequent values with counts; ties broken by value."""
    return most_frequent(df, column, k, dropna=dropna)


def rows_with_top_values(df: DataFrame, column: str, k: int = 25) -> DataFrame:
    """Rows whose ``column`` is among its ``k`` most frequent values.

    A left-semi join against the top-k table, broadcast because it holds at
    most ``k`` rows. Matching is null-safe: when missing values are among
    the most frequent (the list keeps them), missing rows are kept too, as a
    frame ``isin`` over that list does.
    """
    top = F.broadcast(top_values(df, column, k).select(F.col(column).alias("_top")))  # k rows
    return df.join(top, F.col(column).eqNullSafe(F.col("_top")), "left_semi")
