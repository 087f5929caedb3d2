"""SimHash near-duplicate classes by a Gray-order hierarchical index.

Fingerprints. Whole texts, A-Z lower-cased, cut into words at ASCII white
space; shingles of ``shingle`` words, repeats included, joined by a space; XXH64
(seed 42) of each; a fingerprint bit is 1 if it is set in over half of the
hashes. A text of fewer words is one shingle; one without words (null, empty)
has fingerprint zero, which links like any other.

Index. Only distinct fingerprints take part. The upper nodes are masked bit
patterns: the 64 bits form six blocks, and a node is a choice of four blocks
with their values. Two fingerprints that differ in at most 2 bits agree in at
least four blocks, so they meet under a node; Spark deals the nodes by a
shuffle. Within a node members are sorted by Gray rank, so neighbours share
long bit patterns; a tree over the sorted run keeps, per group, the bits all
its members share. The search walks the tree for all members at once, adds up
the differences in shared bits, and drops whole groups once they exceed the
bound. A node spans at most 22 free bits, which bounds it whatever the data;
linked members are united at once, so a node gives at most one edge per member,
never all pairs.

Classes. Edges between distinct fingerprints are closed by alternating
large-star and small-star steps (joins and aggregates; a star's centre is a
skewable join key, never a collected group), cut by checkpoints. The class id
is the least document id in the class; with several rows of one id, or null
ids, nulls are ignored unless a class has none but nulls.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.common import cut, map_arrow, map_batches

#: Words joined at once while a text is hashed; bounds memory for long texts.
CHUNK = 50_000
#: (offset, width) of the six blocks of the 64 bits.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Members per leaf and children per node of the tree.
FAN = 16


def fingerprint(text: str | None, shingle: int) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    n, ones = len(words) - k + 1, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        to = min(at + CHUNK, n)
        part = words[at:to + k - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        h64 = xxhash.xxh64_intdigest
        hashes = [h64(joined[a:b], 42) for a, b in zip(starts[:to - at].tolist(), ends[k - 1:].tolist())]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        # rows of 255 sum in bytes, which numpy does much faster than wider types
        for r in range(0, len(bits), 255):
            ones += bits[r:r + 255].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """``id, text_hash, fp`` (the 64 bits as a signed long) per row."""
    def run(batch: pa.RecordBatch):
        fp = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
        yield {"id": batch.column(0), "text_hash": batch.column(2), "fp": fp.view(np.int64)}

    return map_batches(docs.select(id_col, text_col, F.xxhash64(text_col)), run,
                       f"id {dict(docs.dtypes)[id_col]}, text_hash long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each pattern in the reflected Gray order."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Tree:
    """Shared bits of runs of Gray-sorted fingerprints, ``FAN`` to a group."""

    def __init__(self, fp: np.ndarray):
        self.fp, self.levels = fp, []
        low = high = fp  # AND and OR of a group's members
        while len(low) > 1:
            at = np.arange(0, len(low), FAN)
            low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
            self.levels.append((~(low ^ high), low))  # bits all share, and their values
        self.levels.reverse()

    def links(self, max_bits: int):
        """Pairs (i, j), i < j, within ``max_bits``, in blocks of queries."""
        n = len(self.fp)
        for at in range(0, n, 4096):
            query = np.arange(at, min(at + 4096, n))
            node = np.zeros(len(query), np.int64)
            seen = np.zeros(len(query), np.uint64)  # shared bits already counted
            spent = np.zeros(len(query), np.int64)
            for depth, (shared, value) in enumerate(self.levels):
                if depth:
                    query, node, seen, spent = self._open(query, node, seen, spent, len(value))
                fresh = shared[node] & ~seen
                spent = spent + np.bitwise_count((self.fp[query] ^ value[node]) & fresh)
                keep = spent <= max_bits
                query, node, seen, spent = query[keep], node[keep], shared[node][keep], spent[keep]
            query, node, seen, spent = self._open(query, node, seen, spent, n)
            keep = (query < node) & (np.bitwise_count((self.fp[query] ^ self.fp[node]) & ~seen) + spent <= max_bits)
            yield query[keep], node[keep]

    @staticmethod
    def _open(query, node, seen, spent, size):
        """Replace each (query, node) by the node's children."""
        child = (node[:, None] * FAN + np.arange(FAN)).ravel()
        inside = child < size
        spread = [np.repeat(x, FAN)[inside] for x in (query, seen, spent)]
        return spread[0], child[inside], spread[1], spread[2]


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union-find over links; roots are the least members."""
    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)


def node_edges(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) joining the members of one node, at most one each."""
    fp = fp[np.argsort(gray_rank(fp), kind="stable")]
    parent = np.arange(len(fp))
    for a, b in Tree(fp).links(max_bits):
        unite(parent, a, b)
    for i in range(len(fp)):  # parents come first, so one pass flattens
        parent[i] = parent[parent[i]]
    linked = np.flatnonzero(parent != np.arange(len(fp)))
    return fp[linked].view(np.int64), fp[parent[linked]].view(np.int64)


def fingerprint_edges(distinct: DataFrame, max_bits: int) -> DataFrame:
    """``a, b`` edges whose closure links all fingerprints within ``max_bits``."""
    if max_bits > 2:
        raise ValueError("four of six blocks agree for up to 2 differing bits")
    masks = [sum(((1 << w) - 1) << o for o, w in some) for some in combinations(BLOCKS, 4)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    nodes = distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m).cast("long"))
                                                         for m in signed))).alias("choice", "pattern"))

    def run(batches):
        """Sorted rows arrive node by node; a node may span Arrow batches."""
        held: list[np.ndarray] = []
        last = None
        for batch in batches:
            fp, choice, pattern = (batch.column(i).to_numpy() for i in range(3))
            if not len(fp):
                continue
            new = np.flatnonzero((choice[1:] != choice[:-1]) | (pattern[1:] != pattern[:-1])) + 1
            starts, ends = np.concatenate(([0], new)), np.concatenate((new, [len(fp)]))
            out_a, out_b = [], []

            def flush():
                if sum(map(len, held)) > 1:
                    a, b = node_edges(np.concatenate(held).view(np.uint64), max_bits)
                    out_a.append(a)
                    out_b.append(b)
                held.clear()

            first = (choice[0], pattern[0])
            if held and first != last:
                flush()
            big = np.flatnonzero(ends - starts > 1)
            wanted = {0, len(starts) - 1, *big.tolist()}
            for i in sorted(wanted):
                if i:
                    flush()
                held.append(fp[starts[i]:ends[i]].copy())
            last = (choice[-1], pattern[-1])
            if out_a:
                yield pa.RecordBatch.from_pydict({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})
        if sum(map(len, held)) > 1:
            a, b = node_edges(np.concatenate(held).view(np.uint64), max_bits)
            yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    dealt = nodes.repartition("choice", "pattern").sortWithinPartitions("choice", "pattern")
    return map_arrow(dealt, run, "a long, b long")


def close_links(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node with an edge: root is the least node of its
    component (as a signed long). Alternates large-star and small-star until a
    round changes nothing."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def least_joined(pairs: DataFrame) -> DataFrame:
        """Pairs (u, v) with ``m``, the least of u and its neighbours."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.join(least, "u")

    while True:
        both = edges.selectExpr("a u", "b v").unionByName(edges.selectExpr("b u", "a v"))
        large = (least_joined(both).where("v > u and v <> m").selectExpr("v a", "m b").distinct())
        down = least_joined(large.selectExpr("a u", "b v"))  # every v is below its u
        small = (down.where("v <> m").selectExpr("v a", "m b")
                 .unionByName(down.selectExpr("u a", "m b")).where("a <> b").distinct())
        after = cut(small)
        same = (after.count() == edges.count()
                and after.join(edges, ["a", "b"], "left_anti").isEmpty())
        edges = after
        if same:
            return edges.selectExpr("a node", "b root")


def component_roots(kept: DataFrame, first: Column, max_bits: int) -> DataFrame:
    """``fp, first, root`` per distinct fingerprint; ``first`` aggregates its rows."""
    roots = close_links(fingerprint_edges(kept.select("fp").distinct(), max_bits))
    # per fingerprint first: the join then sees each fingerprint once
    return kept.groupBy("fp").agg(first.alias("first")).join(
        roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint`` (16 hex digits)``, component_id`` per row."""
    kept = cut(fingerprints(docs, shingle, id_col, text_col).select("id", "fp"))
    classes = component_roots(kept, F.min("id"), max_bits)
    ids = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(ids, "root").select("fp", "component_id")
    return kept.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row of ``docs``, with all columns, per class: the one of least id (a
    null id only for want of others), then of least text hash. Ids need not be
    unique: a row is found again by its id and text."""
    kept = cut(fingerprints(docs, shingle, id_col, text_col))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash"))
    chosen = (component_roots(kept, first, max_bits).groupBy("root").agg(F.min("first").alias("first"))
              .select(F.col("first.id").alias("chosen_id"), F.col("first.text_hash").alias("chosen_hash")))
    # nested, so that no column of ``docs`` clashes with the keys
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"))
    return (keyed.join(chosen, F.col("id").eqNullSafe(F.col("chosen_id"))
                       & (F.col("text_hash") == F.col("chosen_hash")), "left_semi")
            .dropDuplicates(["id", "text_hash"]).select("row.*"))
