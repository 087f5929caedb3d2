"""Pairwise moments of many columns as block matrices.

With M the matrix of ones where a value is present and X the centred values (zero
where missing), the rows that hold both of columns i and j have

    count  (M'M)[i, j]        sum of x_i  (X'M)[i, j]
    sum of x_i^2  ((X*X)'M)[i, j]        sum of x_i x_j  (X'X)[i, j]

so four matrix products a batch give every pair's sums: work and memory per task are
four k x k matrices for any number of rows, and the plan does not grow with the
pairs. Tasks' matrices are added by ``FAN_IN`` tasks and then by one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 64
ROWS = 8_192


def pair_sums(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The centring shift (k means) and the four k x k sums, stacked. Null and NaN
    are missing."""
    k = len(columns)
    x = [F.col(f"`{c}`").cast("double") for c in columns]
    present = df.select(*(F.when(~F.isnan(e), e).alias(f"x{i}") for i, e in enumerate(x)))
    means = present.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(k)]).first()
    shift = np.array([float(m) if m is not None and np.isfinite(m) else 0.0 for m in means])

    def emit(sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"sums": [sums.tobytes()]})

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                v = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.slice(at, ROWS).columns]).astype(float) - shift
                mask = ~np.isnan(v)
                v, mask = np.where(mask, v, 0.0), mask.astype(float)
                sums += np.stack([mask.T @ mask, v.T @ mask, (v * v).T @ mask, v.T @ v])
        yield emit(sums)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, k, k))
        for batch in batches:
            for one in batch.column(0).to_pylist():
                sums += np.frombuffer(one).reshape(4, k, k)
        yield emit(sums)

    parts = present.mapInArrow(products, "sums binary").repartition(FAN_IN).mapInArrow(added, "sums binary")
    out = parts.repartition(1).mapInArrow(added, "sums binary").collect()  # one row of 4 k^2 numbers
    total = np.zeros((4, k, k))
    for row in out:
        total += np.frombuffer(row["sums"]).reshape(4, k, k)
    return shift, total


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``col_x, col_y, n, mean_x, mean_y, corr`` of every pair ``i < j``, over the
    rows where both columns hold a value; ``corr`` is null without spread, the means
    without rows."""
    cols = list(columns)
    shift, (n, sx, sxx, sxy) = pair_sums(df, cols)
    rows = []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            m = n[i, j]
            if not m:
                rows.append((cols[i], cols[j], 0, None, None, None))
                continue
            cov = sxy[i, j] - sx[i, j] * sx[j, i] / m
            vx, vy = sxx[i, j] - sx[i, j]**2 / m, sxx[j, i] - sx[j, i]**2 / m
            # what is left of a constant column is rounding
            spread = vx > 1e-13 * (sxx[i, j] + m * shift[i]**2) and vy > 1e-13 * (sxx[j, i] + m * shift[j]**2)
            rows.append((cols[i], cols[j], int(m), float(shift[i] + sx[i, j] / m), float(shift[j] + sx[j, i] / m),
                         float(cov / np.sqrt(vx * vy)) if spread else None))
    schema = "col_x string, col_y string, n long, mean_x double, mean_y double, corr double"
    return df.sparkSession.createDataFrame(rows, schema)  # one row a pair of columns
