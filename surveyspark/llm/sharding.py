"""Feistel sharding: a keyed permutation of the global row numbers.

Rows are numbered 0 to n-1 in the order of (id, size, CRC, hash of the text);
a Feistel network over the smallest even-split power of two that holds n, with
cycle walking back into [0, n), permutes the numbers. The permuted number p
gives ``shard = p % shards`` and ``slot = p // shards``: shard counts differ by
one at most, slots are gapless, and both can be computed from a row number
alone (``place``), as can the row number from shard and slot (``row_of``).

Only a narrow table (no texts) is range-partitioned and sorted; the numbers
come from per-partition positions plus partition offsets, so no window sees
all rows. Rows that tie in every sort column are told apart by an arbitrary
number, which also lets a hot id spread over partitions; such rows are equal,
so the result as a set of rows is the same on every run.

Edge cases: a null text has size 1 and CRC 0; null ids sort first; an empty
table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.common import cut, map_batches

ROUNDS = 8


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, the round function's hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Permutation:
    """A keyed bijection of [0, n)."""

    def __init__(self, n: int, key: int):
        if n >= 1 << 62:
            raise ValueError("at most 2**62 rows")
        bits = max(2, (max(n, 1) - 1).bit_length())
        self.n, self.low, self.high = n, np.uint64(bits // 2), np.uint64(bits - bits // 2)
        keys = np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.keys = _mix(keys + np.uint64(key & (2**64 - 1)))

    def _masks(self) -> tuple[np.uint64, np.uint64]:
        one = np.uint64(1)
        return (one << self.high) - one, (one << self.low) - one

    def _once(self, x: np.ndarray, inverse: bool) -> np.ndarray:
        """One pass of the network: halves take turns to be XORed with the
        other half's hash, so unequal halves need no swap."""
        top, bottom = self._masks()
        a, b = x >> self.low, x & bottom
        order = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
        for i in order:
            if i % 2:
                b = b ^ (_mix(a + self.keys[i]) & bottom)
            else:
                a = a ^ (_mix(b + self.keys[i]) & top)
        return (a << self.low) | b

    def _walk(self, x: np.ndarray, inverse: bool) -> np.ndarray:
        x = self._once(np.asarray(x, np.uint64), inverse)
        while (outside := x >= np.uint64(self.n)).any():
            x[outside] = self._once(x[outside], inverse)
        return x.astype(np.int64)

    def place(self, rows: np.ndarray) -> np.ndarray:
        return self._walk(rows, False)

    def row_of(self, placed: np.ndarray) -> np.ndarray:
        return self._walk(placed, True)


def place(row: int, n: int, shards: int, key: int) -> tuple[int, int]:
    """Shard and slot of a global row number."""
    p = int(Permutation(n, key).place(np.array([row]))[0])
    return p % shards, p // shards


def row_of(shard: int, slot: int, n: int, shards: int, key: int) -> int:
    """The global row number that lies in ``slot`` of ``shard``."""
    return int(Permutation(n, key).row_of(np.array([slot * shards + shard]))[0])


def number_rows(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``row_number`` 0 to n-1 in ``order``, and n.

    The sorted rows are written once; of them only one count per partition
    comes to the driver.
    """
    sorted_rows = (rows.withColumn("tie_no", F.monotonically_increasing_id())
                   .repartitionByRange(*order, "tie_no").sortWithinPartitions(*order, "tie_no")
                   .withColumn("part_no", F.spark_partition_id())
                   .withColumn("place_no", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    kept = cut(sorted_rows)
    counts = kept.groupBy("part_no").count().orderBy("part_no").collect()
    starts = [0, *accumulate(r["count"] for r in counts)]
    offsets = kept.sparkSession.createDataFrame(
        [(r["part_no"], s) for r, s in zip(counts, starts)], "part_no int, start_no long")
    numbered = (kept.join(F.broadcast(offsets), "part_no")  # one row per partition
                .withColumn("row_number", F.col("place_no") + F.col("start_no"))
                .drop("part_no", "place_no", "start_no", "tie_no"))
    return numbered, starts[-1]


def shard(docs: DataFrame, shards: int = 16, key: int = 20240229, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``id_col, size, text_crc32, law, shard, slot, grown_shard`` per row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
                         F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    numbered, n = number_rows(narrow, ["id", "size", "text_crc32", "text_hash"])

    def run(batch: pa.RecordBatch):
        p = Permutation(n, key).place(batch.column(3).to_numpy(zero_copy_only=False))
        yield {"id": batch.column(0), "size": batch.column(1), "text_crc32": batch.column(2),
               "shard": (p % shards).astype(np.int32), "slot": p // shards}

    placed = map_batches(numbered.select("id", "size", "text_crc32", "row_number"), run,
                         f"id {dict(docs.dtypes)[id_col]}, size long, text_crc32 long, shard int, slot long",
                         rows=10_000)
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"),
                         "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
