"""Exact top-k inner products over norm-sorted, SVD-rotated vector blocks.

Components are scaled and floored to integers, so scores are exact integers.
Vectors are range-sorted by length and packed into blocks, longest first. Each
query gets a first threshold (its k-th best score so far) from the longest
vectors, a bounded seed that is broadcast. Query blocks and vector blocks then
meet in the cells of a grid (an equi-join on the cell, no cell sees more than a
fixed number of blocks); a vector block whose longest vector cannot reach any
threshold of a query block is not even sent, nor is a query block to rows of the
grid (runs of blocks by descending length) that hold no block for it. In a cell, vectors are tried by
descending length: a tile is dropped once length times length is under the
thresholds; partial sums over the leading dimensions of an SVD rotation plus the
Cauchy-Schwarz bound of the residual lengths prune pairs; what is left is scored
exactly and lifts the thresholds. The best k of all blocks follow from a ranked
window whose partial limits run before its shuffle.

Bounds carry a relative slack well over the rounding of doubles, so pruning
never drops a result; the rotation is fitted on a bounded sample and only
affects speed. Scores use doubles while these are exact and Python integers
beyond; a score outside 64 bits is clipped to them after ranking.

Edge cases: rows with a null id, a null vector or a null or non-finite
component take no part; vectors of unequal size are compared as if padded with
zeros; rows that share an id but not the vector are different rows, each a query
of its own if the id is one. Equal (id, vector) rows are one row, or, with
``repeated_rows``, rows of their own: each is a query and a candidate for the others
(``k + 1`` copies take part as candidates, more cannot be among any best ``k``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.llm.common import cut, map_arrow, map_batches

#: Vectors in a block, queries in a block, vector blocks that share a cell row.
BLOCK, QUERY_BLOCK, CELL_BLOCKS = 2048, 512, 16
#: Bytes of seed vectors and of the rotation's sample, at most.
SEED_BYTES = 4 << 20
TILE = 256
SLACK = 1e-9
LONG = 2**63 - 1


def quantised(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``id, v`` (little-endian doubles of integers, binary) of the rows that
    take part."""
    def run(batch: pa.RecordBatch):
        ids, out = [], []
        for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if i is None or x is None or any(c is None for c in x):
                continue
            row = np.asarray(x, np.float64)
            if np.isfinite(row).all():
                with np.errstate(over="ignore"):
                    row = np.floor(row * scale)
                if np.isfinite(row).all():
                    ids.append(i)
                    out.append((row + 0.0).tobytes())  # no negative zeros
        yield {"id": ids, "v": out}

    return map_batches(vectors.select(F.col(id_col).cast("long"), vector_col), run, "id long, v binary")


def unpack(rows: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims))
    for i, row in enumerate(rows):
        x = np.frombuffer(row)
        out[i, :len(x)] = x
    return out


def exact_scores(a: np.ndarray, b: np.ndarray):
    """Inner products of rows: doubles where they are exact, else Python ints."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2**53:
        return a @ b.T
    to_int = np.frompyfunc(int, 1, 1)
    return to_int(a).dot(to_int(b).T)


def rotation(sample: np.ndarray) -> np.ndarray:
    """Right singular vectors, strongest first."""
    if not len(sample):
        return np.eye(sample.shape[1])
    unit = sample / max(1.0, float(np.abs(sample).max()))
    values, vectors = np.linalg.eigh(unit.T @ unit)
    return vectors[:, np.argsort(-values)]


class Best:
    """The k best (score, id) of each query seen so far."""

    def __init__(self, thresholds: np.ndarray, k: int):
        self.k, self.least = k, thresholds.astype(object)
        self.rows: list[list[tuple]] = [[] for _ in thresholds]

    def add(self, q: int, scores, ids: np.ndarray) -> None:
        rows = self.rows[q] + [(-int(s), int(i)) for s, i in zip(scores, ids)]
        rows.sort()
        self.rows[q] = rows[:self.k]
        if len(rows) >= self.k:
            self.least[q] = max(self.least[q], -rows[self.k - 1][0])


def search(queries: np.ndarray, query_ids: np.ndarray, thresholds: np.ndarray, vectors: np.ndarray,
           ids: np.ndarray, lead: np.ndarray, turn: np.ndarray, k: int) -> Best:
    """The best k among ``vectors`` (longest first) per query, of those that
    reach the query's threshold; a query's own row (the ``lead`` of equal rows) is
    left out."""
    best = Best(thresholds, k)
    big = max(float(np.abs(queries).max(initial=1)), float(np.abs(vectors).max(initial=1)))
    unit_q, unit_x = queries / big, vectors / big  # bounds are computed on this scale
    head = max(1, queries.shape[1] // 4)
    rot_q, rot_x = unit_q @ turn, unit_x @ turn
    len_q, len_x = np.linalg.norm(unit_q, axis=1), np.linalg.norm(unit_x, axis=1)
    rest_q, rest_x = np.linalg.norm(rot_q[:, head:], axis=1), np.linalg.norm(rot_x[:, head:], axis=1)
    for at in range(0, len(vectors), TILE):
        tile = slice(at, at + TILE)
        least = np.array([float(t) for t in best.least]) / big / big
        ceiling = len_q * len_x[tile].max() * (1 + SLACK) + SLACK * SLACK
        some = np.flatnonzero(ceiling >= least)
        if not len(some):
            continue
        bound = rot_q[some, :head] @ rot_x[tile, :head].T + np.outer(rest_q[some], rest_x[tile])
        slack = SLACK * np.outer(len_q[some], len_x[tile]) + SLACK * SLACK
        open_pairs = bound + slack >= least[some][:, None]
        rows = np.flatnonzero(open_pairs.any(1))
        cols = np.flatnonzero(open_pairs.any(0))
        if not len(rows):
            continue
        scores = exact_scores(queries[some[rows]], vectors[tile][cols])
        for r, row in enumerate(rows):
            q = some[row]
            hit = np.flatnonzero(open_pairs[row, cols] & (scores[r] >= best.least[q]).astype(bool))
            hit = hit[[not (ids[tile][cols[h]] == query_ids[q] and lead[tile][cols[h]]
                            and np.array_equal(vectors[tile][cols[h]], queries[q])) for h in hit]] \
                if (ids[tile][cols[hit]] == query_ids[q]).any() else hit
            if len(hit) > k:  # only the k-th best and better, with its ties
                cut_off = sorted(scores[r][hit], reverse=True)[k - 1]
                hit = hit[(scores[r][hit] >= cut_off).astype(bool)]
            if len(hit):
                best.add(q, scores[r][hit], ids[tile][cols[hit]])
    return best


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id",
          vector_col: str = "embedding", repeated_rows: bool = False) -> DataFrame:
    """``query_id, rank, vec_id, score`` for queries whose id ``every`` divides."""
    spark = vectors.sparkSession
    copies = F.count("*") if repeated_rows else F.lit(1).cast("long")
    rows = cut(quantised(vectors, scale, id_col, vector_col).groupBy("id", "v").agg(copies.alias("n"))
               .select("id", "v", "n", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k + 1)).cast("int"))).alias("no")))
    size = F.octet_length("v")
    stats = rows.agg(F.count("*").alias("n"), F.max(size).alias("bytes")).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not stats["n"]:
        return spark.createDataFrame([], result)
    dims = max(1, stats["bytes"] // 8)

    def lengths(batch: pa.RecordBatch):
        x = unpack(batch.column(1).to_pylist(), dims)
        peak = np.abs(x).max(axis=1, initial=1)
        yield {"id": batch.column(0), "v": batch.column(1),
               "length": peak * np.sqrt(np.square(x / peak[:, None]).sum(1)),
               "n": batch.column(2), "lead": batch.column(3).to_numpy() == 1}

    sized = map_batches(rows, lengths, "id long, v binary, length double, n long, lead boolean")
    few = int(max(k + 1, min(2048, SEED_BYTES // (8 * dims))))
    draw = F.xxhash64("id", "v")
    seed = sized.orderBy(F.desc("length"), "id", "v", "lead").limit(few).collect()  # few rows of at most SEED_BYTES
    sample = rows.where(F.abs(draw % 1_000_000) < 1_000_000 * min(1.0, few / stats["n"])).limit(2 * few).collect()
    turn = spark.sparkContext.broadcast(rotation(unpack([r["v"] for r in sample], dims)))
    seeds = spark.sparkContext.broadcast(
        (unpack([r["v"] for r in seed], dims), np.array([r["id"] for r in seed], np.int64),
         np.array([r["lead"] for r in seed], bool)))

    def reach(batch: pa.RecordBatch):
        """First thresholds; ``reach`` is the least length that can matter."""
        x, ids = unpack(batch.column(1).to_pylist(), dims), batch.column(0).to_numpy()
        best = search(x, ids, np.full(len(x), -np.inf), *seeds.value, turn.value, k)
        least = np.array([float(t) for t in best.least])
        length = batch.column(2).to_numpy()
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            out = np.where((least > 0) & (length > 0), least / length * (1 - 1e-6), 0.0)
        yield {"id": ids, "v": batch.column(1), "reach": out,
               "least": [None if t == -np.inf else str(int(t)) for t in best.least], "n": batch.column(3)}

    queries = map_batches(sized.where((F.col("id") % every == 0) & F.col("lead")), reach,
                          "id long, v binary, reach double, least string, n long", rows=QUERY_BLOCK)

    def packed(size: int, *names: str):
        """Blocks of the sorted rows of a partition: ids, vectors, the first row's
        sort key, and lists of the further columns."""
        def run(batches):
            held: list[tuple] = []

            def block(some):
                ids, v, key, *more = zip(*some)
                x = unpack(list(v), dims)
                out = {"ids": [np.array(ids, np.int64).tobytes()], "x": [x.tobytes()], "first": [float(key[0])]}
                return pa.RecordBatch.from_pydict(out | {n: [list(c)] for n, c in zip(names, more)})

            for batch in batches:
                held += zip(*(c.to_pylist() for c in batch.columns))
                while len(held) >= size:
                    yield block(held[:size])
                    held = held[size:]
            if held:
                yield block(held)
        return run

    parts = max(1, stats["n"] // (4 * BLOCK))
    query_blocks = cut(map_arrow(
        queries.repartitionByRange(max(1, parts // every + 1), "reach", "id", "v").sortWithinPartitions("reach", "id", "v"),
        packed(QUERY_BLOCK, "least", "copies"), "ids binary, x binary, first double, least array<string>, copies array<long>")
        .withColumn("query_block", F.monotonically_increasing_id()))
    reaches = sorted((r["first"], r["query_block"])  # one number per query block
                     for r in query_blocks.select("first", "query_block").toLocalIterator())
    order = spark.sparkContext.broadcast((np.array([r for r, _ in reaches]), np.array([b for _, b in reaches])))
    if not reaches:
        return spark.createDataFrame([], result)

    def wanted(batch: pa.RecordBatch):
        """The query blocks for which a vector block's longest vector matters."""
        firsts, blocks = order.value
        yield {"ids": batch.column(0), "x": batch.column(1), "lead": batch.column(3), "grid_row": batch.column(4),
               "query_block": [blocks[:np.searchsorted(firsts, f, "right")] for f in batch.column(2).to_pylist()]}

    # partitions follow one another by descending length, so do the rows of the grid
    in_row = max(1, CELL_BLOCKS * BLOCK * parts // stats["n"])
    blocks = cut(map_arrow(sized.drop("n").repartitionByRange(parts, F.desc("length"), "id", "v")
                           .sortWithinPartitions(F.desc("length"), "id", "v"), packed(BLOCK, "lead"),
                           "ids binary, x binary, first double, lead array<boolean>")
                 .withColumn("grid_row", F.floor(F.spark_partition_id() / in_row).cast("long")))
    longest = blocks.groupBy("grid_row").agg(F.max("first").alias("first")).collect()  # one number per grid row
    longest = sorted((r["grid_row"], r["first"]) for r in longest)
    grid = spark.sparkContext.broadcast((np.array([g for g, _ in longest]), np.array([f for _, f in longest])))
    cells = (map_batches(blocks, wanted, "ids binary, x binary, lead array<boolean>, grid_row long, query_block array<long>",
                         rows=16)
             .select("ids", "x", "lead", "grid_row", F.explode("query_block").alias("query_block")))

    def wanting(batch: pa.RecordBatch):
        """The grid rows that hold a vector block long enough for a query block."""
        numbers, peaks = grid.value
        yield {"q_ids": batch.column(0), "q_x": batch.column(1), "least": batch.column(3), "copies": batch.column(4),
               "query_block": batch.column(5), "grid_row": [numbers[peaks >= f] for f in batch.column(2).to_pylist()]}

    spread = (map_batches(query_blocks, wanting, "q_ids binary, q_x binary, least array<string>, copies array<long>, "
                                                 "query_block long, grid_row array<long>", rows=16)
              .withColumn("grid_row", F.explode("grid_row")))

    def score(batch: pa.RecordBatch):
        out: dict[str, list] = {"query_block": [], "query_no": [], "query_id": [], "vec_id": [], "score": [], "exact": [],
                                "copies": []}
        for ids, x, lead, q_ids, q_x, least, copies, number in zip(*(c.to_pylist() for c in batch.columns)):
            q_ids = np.frombuffer(q_ids, np.int64)
            floor = np.array([-np.inf if t is None else int(t) for t in least], object)
            best = search(np.frombuffer(q_x).reshape(-1, dims), q_ids, floor,
                          np.frombuffer(x).reshape(-1, dims), np.frombuffer(ids, np.int64),
                          np.array(lead), turn.value, k)
            for q, found in enumerate(best.rows):
                for minus, i in found:
                    out["query_block"].append(number)
                    out["query_no"].append(q)
                    out["query_id"].append(int(q_ids[q]))
                    out["copies"].append(copies[q])
                    out["vec_id"].append(i)
                    out["score"].append(min(LONG, max(-LONG - 1, -minus)))
                    out["exact"].append(f"{10**80 - minus:090d}")  # sorts as the exact score does
        yield out

    scored = map_batches(cells.join(spread, ["query_block", "grid_row"])
                         .select("ids", "x", "lead", "q_ids", "q_x", "least", "copies", "query_block"), score,
                         "query_block long, query_no int, query_id long, vec_id long, score long, exact string, copies long",
                         rows=4)
    ranked = Window.partitionBy("query_block", "query_no").orderBy(F.desc("exact"), "vec_id")
    return (scored.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))  # each equal query row
            .select("query_id", "rank", "vec_id", "score"))
