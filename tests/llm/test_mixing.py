import hashlib
import random
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from surveyspark.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        left = Fraction(total - sum(most * sizes[s] for s in full))
        free = [s for s in order if s not in full]
        goal = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if goal[s] > most * sizes[s]}
        if not over:
            return {s: float(goal.get(s, most * sizes[s])) for s in order}
        full |= over


def plain_taken(rows, key="mix"):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").encode().split())
    goals, out = plain_targets(sizes), []
    for source, size in sizes.items():
        own = sorted((hashlib.md5(f"{key}|{'null' if i is None else i}".encode()).hexdigest(), len((t or "").encode().split()), str(i), i)
                     for i, t, s in rows if s == source)
        passes, rest = divmod(int(goals[source] + 0.5), size) if size else (0, 0)
        start = 0
        for _, n, _, i in own:
            out.append((i, n, size, round(goals[source], 6), passes * n + max(0, min(n, rest - start))))
            start += n
    return sorted(out, key=str)


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    sources = ["a"] * 20 + ["b", "ä", "Z", "c", None, "tiny"]
    return [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 40, 300]))) + " \n", rng.choice(sources) if i else "tiny")
            for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, shard string")


def taken(frame):
    return sorted(((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in mixing.taken_words(frame).collect()), key=str)


def test_taken_against_plain(spark):
    rows = corpus()
    mixed = mixing.mix(table(spark, rows), block_words=64)
    assert taken(mixed) == plain_taken(rows)
    again = mixing.mix(table(spark, rows[::-1]).repartition(5), block_words=64)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, again.collect()))


def test_buckets_do_not_change_the_mix(spark, monkeypatch):
    rows = corpus(300, 2)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    assert taken(mixing.mix(table(spark, rows))) == plain_taken(rows)


def test_edge_cases(spark):
    rows = [(None, "a b", None), (None, "a b", None), (1, None, "s"), (2, "", "s"), (3, "x y z", "s"), (3, "x y z", "s"),
            (4, None, "wordless"), (5, "long " * 200_000, "t")]
    assert taken(mixing.mix(table(spark, rows))) == plain_taken(rows)
    assert mixing.mix(table(spark, rows).limit(0)).collect() == []
    wordless = mixing.mix(table(spark, [(1, "", "a"), (2, None, None)]))
    assert taken(wordless) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    for bad in ({"weights": ()}, {"weights": (1, 0)}, {"max_epochs": 0}, {"shards": 0}):
        with pytest.raises(ValueError):
            mixing.mix(table(spark, rows), **bad)


def test_shards_hold_disjoint_blocks_by_their_quotas(spark):
    rows = corpus(600, 5)
    mixed = mixing.mix(table(spark, rows), shards=5, block_words=256)
    copies = mixed.select("doc_id", "source", "size", F.inline("copies")).collect()
    assert len({(r["doc_id"], r["epoch"]) for r in copies}) == len(copies)
    assert {r["shard"] for r in copies} == set(range(5))
    assert sum(r["words"] not in (r["size"], 0) for r in copies) <= 7  # one cut copy a source at most
    written = mixing.mixed_rows(table(spark, rows), mixed).collect()
    assert sum(len(r["text"].split()) for r in written) == sum(r["words"] for r in copies)
    assert len({r["order_key"] for r in written}) == len(written)


def test_splitting_tree_keeps_quotas(spark):
    quotas = [0, 1, 7, 1000, 40, 3]
    for shards in (1, 2, 3, 7, 16):
        frame = spark.createDataFrame([(quotas,)], "quotas array<long>")
        leaves = mixing.split_quotas(frame, shards, "k").orderBy("shard").collect()
        assert [r["shard"] for r in leaves] == list(range(shards))
        assert [sum(c) for c in zip(*(r["quotas"] for r in leaves))] == quotas
        totals = [sum(r["quotas"]) for r in leaves]
        assert min(min(r["quotas"]) for r in leaves) >= 0 and max(totals) - min(totals) <= shards.bit_length()


def test_hypergeometric_is_the_inverse_distribution(spark):
    cases, rng = [], random.Random(4)
    for _ in range(120):
        n = rng.randrange(1, 60)
        cases.append((rng.randrange(n + 1), n, rng.randrange(n + 1), rng.random()))
    cases += [(3, 10, 4, 0.0), (3, 10, 4, 1 - 2**-53), (0, 5, 5, 0.3), (5, 5, 0, 0.9)]
    got = spark.createDataFrame(cases, "k long, n long, d long, u double").select(
        "k", "n", "d", "u", mixing.hypergeometric(F.col("k"), F.col("n"), F.col("d"), F.col("u")).alias("x")).collect()
    for k, n, d, u, x in got:
        total, below = comb(n, d), 0
        lo, hi = max(0, d + k - n), min(k, d)
        want = lo
        while want < hi and below + comb(k, want) * comb(n - k, d - want) <= u * total:
            below += comb(k, want) * comb(n - k, d - want)
            want += 1
        assert x == want or abs(below / total - u) < 1e-9


def test_large_draws_have_the_right_moments(spark):
    k, n, d = 300_000, 1_000_000, 400_000
    row = spark.range(300).select(mixing.hypergeometric(F.lit(k), F.lit(n), F.lit(d), mixing._uniform(F.lit("m"), F.col("id"))).alias("x")
                                  ).agg(F.avg("x"), F.stddev("x")).first()
    spread = (d * k / n * (1 - k / n) * (n - d) / (n - 1)) ** 0.5
    assert abs(row[0] - d * k / n) < 4 * spread / 300 ** 0.5 and 0.85 < row[1] / spread < 1.15


def test_block_permutation_is_a_bijection(spark):
    for count in (1, 2, 3, 5, 12, 97, 400):
        got = spark.range(count).select(mixing._position(F.col("id"), F.lit(count).cast("long"), "k", F.lit(1)).alias("p")).collect()
        assert sorted(r["p"] for r in got) == list(range(count))


def test_no_python_in_the_plan(spark):
    plan = mixing.taken_words(mixing.mix(table(spark, corpus(50))))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
