"""Least squares that takes collinear and badly scaled columns.

Rows (1, features, label) are reduced to triangular factors by QR, batch by batch in
each task, and the tasks' factors are merged the same way, by ``FAN_IN`` tasks and
then by one: no cross-products are formed, so the condition number is not squared, and what moves is
one (p + 2) x (p + 2) triangle a task. The first column of ones makes the rest of the
factor that of the centred data.

The factor's columns are scaled to unit length and decomposed by SVD; singular values
under ``rcond`` times the greatest count as zero, which gives the rank. Of all
solutions the one of least norm (in the features' own units, without the intercept)
is returned: equal columns share their effect.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import ship

FAN_IN = 64
#: Rows of a batch that are factored at once.
ROWS = 20_000


def _triangle(rows: np.ndarray) -> np.ndarray:
    """The R factor of ``rows``, square, without signs on its diagonal."""
    k = rows.shape[1]
    if len(rows) < k:
        rows = np.vstack([rows, np.zeros((k - len(rows), k))])
    r = np.linalg.qr(rows, mode="r")
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def _emit(r: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if r is not None:
        yield pa.RecordBatch.from_pydict({"r": [np.ascontiguousarray(r).tobytes()]})


@dataclass
class LinearFit:
    features: list[str]
    coefficients: np.ndarray
    intercept: float
    rank: int
    rows: int

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        value = F.lit(self.intercept)
        for f, b in zip(self.features, self.coefficients):
            value = value + F.lit(float(b)) * F.col(f"`{f}`").cast("double")
        return df.withColumn(output, value)

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """``(model, feature, coefficient)`` rows, intercept first."""
        rows = [(name, "intercept", self.intercept)] + [(name, f, float(b)) for f, b in zip(self.features, self.coefficients)]
        return spark.createDataFrame(rows, "model string, feature string, coefficient double")


def factor(df: DataFrame, features: Sequence[str], label: str) -> np.ndarray:
    """The triangular factor of (1, features, label) over all rows."""
    ship(df.sparkSession)
    k = len(features) + 2

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = np.column_stack([np.ones(part.num_rows)] + [c.to_numpy(zero_copy_only=False) for c in part.columns])
                r = _triangle(x if r is None else np.vstack([r, x]))
        yield from _emit(r)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for one in batch.column(0).to_pylist():
                own = np.frombuffer(one).reshape(k, k)
                r = own if r is None else _triangle(np.vstack([r, own]))
        yield from _emit(r)

    rows = df.select(*(F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate([*features, label])))
    # two levels: each merging task takes its share of all triangles one by one
    out = rows.mapInArrow(reduced, "r binary").repartition(FAN_IN).mapInArrow(merged, "r binary")
    out = out.repartition(1).mapInArrow(merged, "r binary")  # at most FAN_IN triangles
    found = out.collect()  # one triangle
    return _triangle(np.vstack([np.frombuffer(r["r"]).reshape(k, k) for r in found])) if found else np.zeros((k, k))


def solve(r: np.ndarray, rcond: float = 1e-12) -> tuple[np.ndarray, float, int]:
    """Coefficients of least norm, intercept and rank from ``factor``'s triangle."""
    p = len(r) - 2
    x, y = r[1:p + 1, 1:p + 1], r[1:p + 1, p + 1]
    size = np.linalg.norm(x, axis=0)
    # a column is constant if hardly anything is left of it without its mean
    moving = size > 1e-13 * np.maximum(np.linalg.norm(r[:p + 1, 1:p + 1], axis=0), 1e-300)
    scale = np.where(moving, size, 1.0)
    u, s, vt = np.linalg.svd(np.where(moving, x, 0.0) / scale)
    rank = int((s > rcond * s[0]).sum()) if p and s[0] > 0 else 0
    z = vt[:rank].T @ ((u[:, :rank].T @ y) / s[:rank])
    b, free = z / scale, vt[rank:].T / scale[:, None]
    if free.size:  # of all solutions b + free a, the shortest
        b = b - free @ np.linalg.lstsq(free, b, rcond=None)[0]
    b = np.where(moving, b, 0.0)
    return b, float((r[0, p + 1] - r[0, 1:p + 1] @ b) / r[0, 0]), rank


def least_squares(df: DataFrame, features: Sequence[str], label: str, rcond: float = 1e-12) -> LinearFit:
    """Fit ``label`` on ``features``. Missing values are refused, as are no rows."""
    used = [*features, label]
    holes = df.agg(*[F.count_if(F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`").cast("double"))).alias(f"z{i}")
                     for i, c in enumerate(used)], F.count(F.lit(1)).alias("n")).first()
    if missing := [c for i, c in enumerate(used) if holes[f"z{i}"]]:
        raise ValueError(f"missing values in {', '.join(missing)}: drop or fill them first")
    if not holes["n"]:
        raise ValueError("no rows to fit")
    b, intercept, rank = solve(factor(df, features, label), rcond)
    return LinearFit(list(features), b, intercept, rank, holes["n"])
