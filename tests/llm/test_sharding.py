import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from surveyspark.llm import sharding


@given(st.integers(1, 3000), st.integers(0, 2**64 - 1))
@settings(max_examples=60, deadline=None)
def test_permutation_is_a_bijection(n, key):
    p = sharding.Permutation(n, key)
    placed = p.place(np.arange(n))
    assert sorted(placed.tolist()) == list(range(n))
    assert p.row_of(placed).tolist() == list(range(n))


def test_place_and_row_of_are_inverse():
    for row in (0, 1, 999):
        assert sharding.row_of(*sharding.place(row, 1000, 16, 5), 1000, 16, 5) == row


def test_rows_law_sizes_and_slots(spark):
    rows = [(i, f"text {i % 7}" if i % 5 else None, 1.0) for i in range(203)] + [(None, "", 0.0), (3, "text 3", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size double")
    got = sharding.shard(docs).collect()
    assert len(got) == len(rows)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}


def test_same_result_however_the_rows_are_dealt(spark):
    docs = spark.createDataFrame([(i, "é" * (i % 13)) for i in range(500)], "doc_id long, text string")
    one = sharding.shard(docs.repartition(7)).collect()
    two = sharding.shard(docs.coalesce(1).orderBy("text")).collect()
    assert sorted(one) == sorted(two)
    by_id = {r["doc_id"]: r for r in one}
    assert sharding.place(123, 500, 16, 20240229) == (by_id[123]["shard"], by_id[123]["slot"])


def test_empty_table(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
