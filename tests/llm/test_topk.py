import math
import random

import numpy as np
import pytest

from surveyspark.llm import topk


def plain(rows, k=5, every=50):
    kept = {}
    for i, v in rows:
        if i is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        kept[(i, tuple(math.floor(256 * float(np.float32(c))) for c in v))] = None
    out = []
    for qi, q in kept:
        if qi % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in kept if (i, v) != (qi, q))[:k]
            out += [(qi, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    return sorted(map(tuple, topk.top_k(df, **kw).collect()))


@pytest.mark.parametrize("scale", [0.01, 1.0, 1e5])
def test_against_brute_force(spark, scale, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, scale * (1 + i % 4), 6)]) for i in range(400)]
    rows += [(i + 1000, rows[7][1]) for i in range(60)]  # ties
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "CELL_BLOCKS", 2)
    monkeypatch.setattr(topk, "TILE", 8)
    assert run(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, 1.0]), (50, None), (100, [None, 1.0]), (150, [float("nan"), 1.0]),
            (200, [float("inf"), 0.0]), (None, [1.0, 1.0]), (1, [0.0, 0.0]), (2, [1.0]), (3, []), (250, [-1.0, -0.0]), (4, [1.0, 2.0])]
    assert run(spark, rows) == plain(rows)


def test_huge_components_are_exact(spark):
    rows = [(i, [float(2**random.Random(i).randrange(10, 21) + i), 3.0]) for i in range(0, 120, 10)]
    assert run(spark, rows) == plain(rows)


def test_scores_beyond_64_bits_rank_exactly(spark):
    got = run(spark, [(0, [1e30]), (1, [1e30]), (2, [2e30]), (3, [-1e30])])
    assert [(r[1], r[2]) for r in got] == [(1, 2), (2, 1), (3, 3)]
    assert got[0][3] == 2**63 - 1 and got[2][3] == -2**63


def test_few_rows_and_none(spark):
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(1, [1.0]), (2, [1.0])]) == []
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 256 * 512)]


def test_repeated_rows_are_rows(spark, monkeypatch):
    """Every row but the query's own is a candidate, equal ones included."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-4, 5, 3)]) for i in range(90)]
    rows += [rows[50]] * 3 + [rows[0]] + [rows[7]] * 40 + [(50, rows[7][1]), (50, [9.0, 9.0, 9.0])]
    want = []
    for at, (qi, q) in enumerate(rows):
        if qi % 50 == 0:
            scored = sorted((-sum(int(256 * a) * int(256 * b) for a, b in zip(q, v)), i)
                            for other, (i, v) in enumerate(rows) if other != at)[:5]
            want += [(qi, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    assert run(spark, rows, repeated_rows=True) == sorted(want)
    assert run(spark, rows) == plain(rows)
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "CELL_BLOCKS", 1)
    assert run(spark, rows, repeated_rows=True) == sorted(want)
    assert run(spark, [(0, [1.0])] * 2, repeated_rows=True) == [(0, 1, 0, 256 * 256)] * 2
