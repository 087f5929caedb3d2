"""The prefix trie of conversations: which turns they share, and what that saves.

A conversation is its sequence of turns; a node is a distinct sequence of first
turns, from the root (no turn). Turns are told apart by 128 bits of a SHA-256 over
role and text, so a conversation becomes its path of 16 bytes a turn, and texts are
read once and shuffled never.

Truncation peeling finds all nodes and their sums in one descent: from the greatest
depth down, conversations that end at a depth join the nodes that survive from below;
all are regrouped by their path without its last turn, which adds up members,
children, leaves and savings and gives each stripped node its parent.

The descent runs in tasks over ranges of the sorted distinct paths, so a subtree lies
in one task or in neighbouring ones. Only the nodes on a range's first and last path
can be shared with a neighbour; their partial sums go on as one path each to the next
round, over at most ``FAN_IN`` paths a task, until one task is left: the rounds grow
with the logarithm of the number of ranges, not with the depth. A task holds one
range (about ``RANGE_TURNS`` turns of 24 bytes), or one longer conversation.

Copies are merged before: a path's conversations are numbered through a range sort
and digested as a stream of chunks, so that a path shared by a third of all
conversations is no one row and no one task's memory.

Edge cases: null role or text is empty; turns are ordered null first, turns of equal
number by their digest; rows of null conversation id are no conversation and take no
part; a conversation without turns is a member of the root; an empty table has no
nodes. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.common import cut, map_arrow

RANGE_TURNS = 400_000
FAN_IN = 512
CHUNK_IDS = 1024
#: Most rows of split nodes that are broadcast to name their children's parent.
BROADCAST_ROWS = 100_000
SALTS = 16
EMPTY = hashlib.sha256(b"").hexdigest()

NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string")
PARTS = ("path binary, chars array<long>, at array<int>, members array<long>, first array<long>, kids array<long>, "
         "leaves array<long>, saved array<long>, ends array<string>")


def turn_items(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """``conv_id, items``: per conversation its turns in order, each a digest (32
    hex digits) and the code points of its text."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    whole = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.substring(F.sha2(whole, 256), 1, 32).alias("digest"), F.char_length(text).cast("long").alias("chars"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "digest", "chars")))  # nulls first
    return turns.groupBy("conv_id").agg(ordered.alias("items")).select(
        "conv_id", F.transform("items", lambda x: F.struct(x["digest"].alias("digest"), x["chars"].alias("chars"))).alias("items"))


def with_shared_heads(items: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Conversation c with its first h turns replaced by those of conversation
    c - c % group (all if fewer, none if absent), h = crc32(decimal c) % most."""
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = items.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.slice("items", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    joined = items.withColumn("base", base).join(heads, "base", "left").withColumn("h", h)
    head = F.when(F.col("head").isNull() | (F.col("h") == 0), F.slice("items", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    return joined.select("conv_id", F.concat(head, F.slice("items", F.col("h") + 1, F.size("items"))).alias("items"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (path_id, conv_id) to rows of up to ``CHUNK_IDS`` ids of one path."""
    path, ids = None, []
    for batch in batches:
        out: list[tuple] = []
        for p, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (p != path or len(ids) == CHUNK_IDS):
                out.append((path, ids[0], len(ids), ",".join(map(str, ids))))
                ids = []
            path = p
            ids.append(i)
        if out:
            yield _rows(out)
    if ids:
        yield _rows([(path, ids[0], len(ids), ",".join(map(str, ids)))])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    p, f, n, t = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(p, pa.binary()), pa.array(f, pa.int64()), pa.array(n, pa.int64()),
                                       pa.array(t, pa.string())], ["path_id", "first_id", "n", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks to one row a path: number, least id and SHA-256 of all ids."""
    path, first, n, digest = None, None, 0, None
    for batch in batches:
        out: list[tuple] = []
        for p, f, k, t in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if p != path:
                if digest:
                    out.append((path, first, n, digest.hexdigest()))
                path, first, n, digest = p, f, 0, hashlib.sha256()
            else:
                digest.update(b",")
            n += k
            digest.update(t.encode())
        if out:
            yield _rows(out)
    if digest:
        yield _rows([(path, first, n, digest.hexdigest())])


def ended(rows: DataFrame) -> DataFrame:
    """``path_id, first_id, n, ids`` (the SHA-256 of the ids in order) per path of
    ``rows`` (``path_id, conv_id``)."""
    dealt = rows.select("path_id", "conv_id").repartitionByRange("path_id", "conv_id").sortWithinPartitions("path_id", "conv_id")
    schema = "path_id binary, first_id long, n long, ids string"
    chunks = map_arrow(dealt, _chunks, schema)
    return map_arrow(chunks.repartition("path_id").sortWithinPartitions("path_id", "first_id"), _digests, schema)


def _common(cells: np.ndarray, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """How many first turns each path shares with the path before it."""
    shared = np.zeros(len(depth), np.int64)
    live, d = np.arange(1, len(depth)), 0
    while True:
        live = live[np.minimum(depth[live], depth[live - 1]) > d]
        if not len(live):
            return shared
        live = live[(cells[start[live] + d] == cells[start[live - 1] + d]).all(axis=1)]
        d += 1
        shared[live] = d


def _key(path: bytes, depth: int) -> bytes:
    return hashlib.sha256(b"%d:" % depth + path[:16 * depth]).digest()[:16]


def peel(items: pa.Table, whole: bool, keys: bool) -> Iterator[dict]:
    """The nodes of sorted paths (columns ``PARTS``), and what goes on.

    Yields dicts of columns: nodes (``NODE`` with ``key`` if ``keys``, and
    ``parent_key`` in place of a parent that neighbours may share), then the
    partial sums along the first and the last path, unless ``whole``.
    """
    paths = items["path"].to_pylist()
    m = len(paths)
    if not m:
        return
    depth = np.array([len(p) // 16 for p in paths], np.int64)
    start = np.cumsum(depth) - depth
    shared = _common(np.frombuffer(b"".join(paths), np.uint64).reshape(-1, 2), start, depth)

    def flat(name: str) -> np.ndarray:
        return items[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)

    chars = flat("chars")
    at = flat("at").astype(np.int64)
    owner = np.repeat(np.arange(m), pa.compute.list_value_length(items["at"]).to_numpy())
    parts = {name: flat(name) for name in ("members", "first", "kids", "leaves", "saved")}
    ends = items["ends"].combine_chunks().flatten()
    end_no = np.where(ends.is_valid().to_numpy(zero_copy_only=False), np.arange(len(ends)), -1)
    order = np.lexsort((owner, -at))
    bounds = np.searchsorted(-at[order], -np.arange(int(at.max()) + 2), side="right")  # entries of depth >= d

    none = np.empty(0, np.int64)
    alive = {k: none for k in ("lo", "hi", "first", "members", "kids", "leaves", "saved", "end", "own")}
    chains: dict[int, list[tuple]] = {0: [], m - 1: []}

    def emitted(nodes: dict, d: int, parent: np.ndarray, known: np.ndarray) -> dict:
        sha = [ends[i].as_py() if i >= 0 else EMPTY for i in nodes["end"].tolist()]
        lo = nodes["lo"].tolist()
        return {"conv_id": nodes["first"], "depth": np.full(len(lo), d), "parent_conv_id": pa.array(parent, mask=~known),
                "n_convs": nodes["members"], "n_children": nodes["kids"], "n_leaves": nodes["leaves"],
                "saved_tokens": nodes["saved"], "ends_sha256": sha,
                "key": [_key(paths[i], d) if keys else None for i in lo],
                "parent_key": [None if k or not d else _key(paths[i], d - 1) for i, k in zip(lo, known.tolist())]}

    for d in range(int(at.max()), -1, -1):
        here = order[bounds[d + 1]:bounds[d]]
        kids = len(alive["lo"])
        lo = np.concatenate((alive["lo"], owner[here]))
        by_place = np.argsort(lo, kind="stable")
        lo = lo[by_place]
        new = np.ones(len(lo), bool)
        new[1:] = (lo[1:] != lo[:-1]) & (shared[lo[1:]] < d)
        heads = np.flatnonzero(new)

        def added(mine: np.ndarray, theirs: np.ndarray, how=np.add) -> np.ndarray:
            return how.reduceat(np.concatenate((mine, theirs))[by_place], heads)

        nodes = {"lo": lo[heads], "hi": added(alive["hi"], owner[here], np.maximum),
                 "first": added(alive["first"], parts["first"][here], np.minimum),
                 "members": added(alive["members"], parts["members"][here]), "kids": added(alive["own"], parts["kids"][here]),
                 "leaves": added(alive["leaves"], parts["leaves"][here]),
                 "saved": added(alive["saved"], parts["saved"][here]),
                 "end": added(np.full(kids, -1), end_no[here], np.maximum)}
        edge = np.zeros(len(heads), bool) if whole else (nodes["lo"] == 0) | (nodes["hi"] == m - 1)
        own = np.flatnonzero(alive["own"])
        if len(own):
            group = np.empty(len(lo), np.int64)
            group[by_place] = np.cumsum(new) - 1
            parent = group[own]
            yield emitted({k: v[own] for k, v in alive.items()}, d + 1, nodes["first"][parent], ~edge[parent])
        for g in np.flatnonzero(edge).tolist():
            chain = 0 if nodes["lo"][g] == 0 else m - 1
            end = int(nodes["end"][g])
            chains[chain].append((d, *(int(nodes[k][g]) for k in ("members", "first", "kids", "leaves", "saved")),
                                  ends[end].as_py() if end >= 0 else None))
        nodes["leaves"] = np.where(nodes["kids"] == 0, 1, nodes["leaves"])
        if d:
            nodes["saved"] = nodes["saved"] + (nodes["members"] - 1) * chars[start[nodes["lo"]] + d - 1]
        # an edge node stays as a place without numbers, so that what lies beside it is seen as such
        alive = nodes | {k: np.where(edge, 0, nodes[k]) for k in ("members", "leaves", "saved")}
        alive["first"] = np.where(edge, np.iinfo(np.int64).max, nodes["first"])
        alive["own"] = (~edge).astype(np.int64)
    if whole:
        yield emitted(alive, 0, np.zeros(len(alive["lo"]), np.int64), np.zeros(len(alive["lo"]), bool))
    for i, chain in chains.items():
        if chain:
            columns = zip(("at", "members", "first", "kids", "leaves", "saved", "ends"), map(list, zip(*chain)))
            yield {"path": [paths[i]], "chars": [chars[start[i]:start[i] + depth[i]].tolist()],
                   **{name: [values] for name, values in columns}}


def _round(items: DataFrame, ranges: int, keys: bool) -> DataFrame:
    """One descent over ``ranges`` ranges of paths: node columns, or those of ``PARTS``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(f"{NODE}, key binary, parent_key binary, {PARTS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(target)
        held = list(batches)
        if not held:
            return
        for columns in peel(pa.Table.from_batches(held), ranges == 1, keys):
            n = len(next(iter(columns.values())))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema],
                schema=schema)

    return map_arrow(items.repartitionByRange(ranges, "path").sortWithinPartitions("path"), run, target)


def prefix_trie(items: DataFrame, range_turns: int = RANGE_TURNS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per node, columns ``NODE``, out of ``turn_items``' columns.

    ``conv_id`` is a node's least member, ``parent_conv_id`` its parent's (root:
    null), ``n_leaves`` the childless nodes of its subtree, ``saved_tokens`` summed
    over its subtree each node's code points times its members but one, and
    ``ends_sha256`` the digest of the ids of the conversations that end there.
    """
    if range_turns < 1 or fan_in < 3:
        raise ValueError("a range holds a turn or more, and a round must shorten the next")
    spark = items.sparkSession
    path = F.unhex(F.array_join(F.transform("items", lambda x: x["digest"]), ""))
    rows = cut(items.select("conv_id", path.alias("path"), F.transform("items", lambda x: x["chars"]).alias("chars"))
               .withColumn("path_id", F.unhex(F.substring(F.sha2("path", 256), 1, 32))))
    distinct = rows.groupBy("path_id").agg(F.first("path").alias("path"), F.first("chars").alias("chars"))
    zero = F.array(F.lit(0).cast("long"))
    merged = cut(distinct.join(ended(rows), "path_id").select(
        "path", "chars", F.array(F.size("chars")).alias("at"), F.array("n").alias("members"), F.array("first_id").alias("first"),
        zero.alias("kids"), zero.alias("leaves"), zero.alias("saved"), F.array("ids").alias("ends")))
    turns = merged.agg(F.sum(F.size("chars") + 1)).first()[0] or 0
    ranges = -(-turns // range_turns)
    if ranges > 1:  # use the cluster's tasks, but no more ranges than needed to fill them
        ranges = max(ranges, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges, part, found, keys = max(1, ranges), merged, [], False
    while True:
        out = cut(_round(part, ranges, keys))
        found.append(out.where("conv_id is not null"))
        if ranges == 1:
            break
        part = out.where("path is not null").select(*(c.split()[0] for c in PARTS.split(", ")))
        ranges, keys = -(-2 * ranges // fan_in), True
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    columns = [c.split()[0] for c in NODE.split(", ")]
    done = nodes.where("parent_key is null").select(columns)
    if not keys:
        return done
    split = nodes.where("key is not null").select(F.col("key").alias("split_key"), F.col("conv_id").alias("split_conv"))
    waiting = nodes.where("parent_key is not null")
    if split.count() <= BROADCAST_ROWS:
        named = waiting.join(F.broadcast(split), F.col("parent_key") == F.col("split_key"))
    else:  # a split node, the root above all, may have very many children
        salted = split.withColumn("split_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        named = waiting.withColumn("salt", F.pmod(F.xxhash64("conv_id", "ends_sha256"), F.lit(SALTS)).cast("int")).join(
            salted, (F.col("parent_key") == F.col("split_key")) & (F.col("salt") == F.col("split_salt")))
    return done.unionByName(named.withColumn("parent_conv_id", F.col("split_conv")).select(columns))
