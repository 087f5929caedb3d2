"""Byte-level BPE as DuckDB recursive queries, run per partition.

Spark reads the texts and deals the partitions. In each task the pre-split
pattern cuts a text into words; the distinct words that the task has not met
yet become token-position rows ``(wid, pos, id)`` that start as single bytes.
One recursive query then joins neighbouring tokens with the merge table, picks
each word's leftmost pair of least rank and contracts it, until no word has a
pair left. A second query decodes the ids by an ordered aggregation of the
token bytes. Words repeat heavily, so a task keeps a bounded table of solved
words and sends only new ones to DuckDB.

Results equal those of the public rank-file tokenizers without special tokens.

Edge cases: a null or empty text has no tokens (``n_tokens`` 0, both digests of
the empty string). A word that is itself a token is taken whole, as those
tokenizers do. One step contracts one pair of a word, so a word of n bytes
costs about n*n/2 rows; words over ``LONG_WORD`` bytes (unbroken runs) are
merged by a heap over the same ranks instead, with the same result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from surveyspark.llm.common import map_batches

#: Bytes above which a word goes through the heap.
LONG_WORD = 64
#: Solved words kept by a task; a full table keeps those of the current block.
CACHE_WORDS = 400_000
#: Words looked up at once: bounds memory for very long texts.
BLOCK_WORDS = 100_000

#: Rows that one recursive query may make: half the sum of its words' squared bytes.
QUERY_ROWS = 2_000_000
#: Over the length of any word in the query: ``rank * SPAN + pos`` orders pairs.
SPAN = 1024

#: ``step`` holds, for each word still changing, its tokens after n contractions,
#: each with the id that follows it.
MERGE_QUERY = f"""
WITH RECURSIVE step(n, wid, pos, id, next_id) AS (
  SELECT 0::INT, wid::INT, pos::INT, id::INT, lead(id) OVER (PARTITION BY wid ORDER BY pos)::INT FROM start
  UNION ALL
  SELECT n + 1, wid, CASE WHEN pos > spot THEN pos - 1 ELSE pos END, CASE WHEN pos = spot THEN made ELSE id END,
         CASE WHEN pos = spot THEN after WHEN pos = spot - 1 THEN made ELSE next_id END
  FROM (
    SELECT s.n, s.wid, s.pos, s.id, s.next_id, least % {SPAN} AS spot, least // {SPAN} AS made, gone.next_id AS after
    FROM step s
    JOIN (SELECT p.wid, min(m.rank * {SPAN} + p.pos)::INT AS least
          FROM step p JOIN merges m ON m.pair = p.id::BIGINT * 65536 + p.next_id
          GROUP BY p.wid) best ON best.wid = s.wid
    JOIN step gone ON gone.wid = best.wid AND gone.pos = least % {SPAN} + 1)
  WHERE pos <> spot + 1
)
SELECT step.wid, pos, id
FROM step JOIN (SELECT wid, max(n) AS n FROM step GROUP BY wid) ends ON ends.wid = step.wid AND ends.n = step.n
"""

DECODE_QUERY = """
SELECT wid, string_agg(v.hex, '' ORDER BY pos) AS hex
FROM tokens JOIN vocabulary v USING (id) GROUP BY wid
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: one ``base64(token) rank`` per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class WordCoder:
    """Encodes and decodes distinct words; one per Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.solved: dict[str, tuple[str, bytes]] = {}
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        self.decimal = {rank: str(rank) for rank in ranks.values()}
        rows = [(ranks[t[:i]] * 65536 + ranks[t[i:]], rank) for t, rank in ranks.items()
                for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        pair, rank = np.array(rows, np.int64).reshape(-1, 2).T
        self._load("merges", pa.table({"pair": pair, "rank": rank.astype(np.int32)}))
        self._load("vocabulary", pa.table({"id": pa.array(ranks.values(), pa.int32()),
                                           "hex": [t.hex() for t in ranks]}))

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register("rows_in", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM rows_in")
        self.db.unregister("rows_in")

    def _heap(self, word: bytes) -> list[int]:
        """Leftmost least-rank merges of one long word by a heap of pairs."""
        parts = [word[i:i + 1] for i in range(len(word))]
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        end = len(parts)
        pairs = [(self.ranks[parts[i] + parts[i + 1]], i, 2) for i in range(end - 1)
                 if parts[i] + parts[i + 1] in self.ranks]
        heapq.heapify(pairs)
        while pairs:
            _, i, size = heapq.heappop(pairs)
            j = after[i]
            if not parts[i] or j >= end or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i], parts[j] = parts[i] + parts[j], b""
            after[i] = after[j]
            if after[j] < end:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < end and (both := parts[a] + parts[b]) in self.ranks:
                    heapq.heappush(pairs, (self.ranks[both], a, len(both)))
        return [self.ranks[p] for p in parts if p]

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token-position rows ``(wid, pos, id)`` of ``words`` at the fixpoint."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        wid = np.repeat(np.arange(len(words)), size)
        pos = np.arange(len(wid)) - np.repeat(np.cumsum(size) - size, size)
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        self.db.register("start", pa.table({"wid": wid, "pos": pos, "id": ids}))
        out = self.db.sql(MERGE_QUERY).to_arrow_table()
        self.db.unregister("start")
        return tuple(out[c].to_numpy() for c in ("wid", "pos", "id"))

    def _solve(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        found = [(i, 0, self.ranks[w]) for i, w in enumerate(raw) if w in self.ranks]
        found += [(i, p, t) for i, w in enumerate(raw) if len(w) > LONG_WORD and w not in self.ranks
                  for p, t in enumerate(self._heap(w))]
        parts = [np.array(found, np.int64).reshape(-1, 3).T]
        # words of like length together: a long one does not keep short ones waiting
        rest = sorted((i for i, w in enumerate(raw) if len(w) <= LONG_WORD and w not in self.ranks),
                      key=lambda i: len(raw[i]))
        at = 0
        while at < len(rest):
            to, made = at, 0
            while to < len(rest) and (to == at or made < QUERY_ROWS and len(raw[rest[to]]) <= 2 * len(raw[rest[at]]) + 32):
                made += len(raw[rest[to]]) ** 2 // 2 + 1
                to += 1
            wid, pos, ids = self._merge([raw[i] for i in rest[at:to]])
            parts.append(np.stack([np.array(rest[at:to])[wid], pos, ids]))
            at = to
        wid, pos, ids = np.concatenate(parts, axis=1)
        data = self.decode(wid, pos, ids, len(words))
        order = np.lexsort((pos, wid))
        ends = np.cumsum(np.bincount(wid, minlength=len(words))).tolist()
        text = list(map(self.decimal.__getitem__, ids[order].tolist()))
        start = 0
        for word, end, got in zip(words, ends, data):
            self.solved[word] = (" ".join(text[start:end]), got)
            start = end

    def decode(self, wid: np.ndarray, pos: np.ndarray, ids: np.ndarray, n: int) -> list[bytes]:
        """The bytes of sequences 0 to n-1 given as ``(wid, pos, id)`` rows."""
        self.db.register("tokens", pa.table({"wid": wid, "pos": pos, "id": ids}))
        out = self.db.sql(DECODE_QUERY).to_arrow_table()
        self.db.unregister("tokens")
        data = [b""] * n
        for i, text in zip(out["wid"].to_pylist(), out["hex"].to_pylist()):
            data[i] = bytes.fromhex(text)
        return data

    def learn(self, words: Iterable[str]) -> None:
        wanted = set(words)
        new = [w for w in wanted if w not in self.solved]
        if len(self.solved) + len(new) > CACHE_WORDS:  # keep what this block needs
            self.solved = {w: self.solved[w] for w in wanted if w in self.solved}
        if new:
            self._solve(new)

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text in blocks; long texts are not split at once."""
        if len(text) < 4 * BLOCK_WORDS:
            yield self.split.findall(text)
            return
        found = (m.group() for m in self.split.finditer(text))
        while block := list(itertools.islice(found, BLOCK_WORDS)):
            yield block


_CODERS: dict[tuple, WordCoder] = {}


def coder(key: tuple, lines: bytes, pattern: str) -> WordCoder:
    """One coder per worker process and vocabulary."""
    if key not in _CODERS:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines.splitlines())}
        _CODERS[key] = WordCoder(ranks, pattern)
    return _CODERS[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per document: ``id_col``, ``n_tokens``, ``ids_sha256`` (digest of
    the decimal ids joined by a space), ``decoded_sha256`` (digest of the decoded
    bytes) and, with ``keep_ids``, ``ids array<int>`` (null otherwise).

    The rank file (fixed size, under 1 MB) is read once and broadcast.
    """
    with open(ranks_path, "rb") as f:
        lines = f.read()
    key = (hashlib.sha256(lines).hexdigest(), pattern)
    shared = docs.sparkSession.sparkContext.broadcast(lines)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        c = coder(key, shared.value, pattern)
        out: dict[str, list] = {"id": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
        texts = [t or "" for t in batch.column(1).to_pylist()]
        # short texts: one look-up of new words for the slice
        short = [c.split.findall(t) if len(t) < 4 * BLOCK_WORDS else None for t in texts]
        c.learn(itertools.chain.from_iterable(w for w in short if w))
        for text, words in zip(texts, short):
            ids_digest, data_digest, n, kept = hashlib.sha256(), hashlib.sha256(), 0, []
            for block in (c.words(text) if words is None else [words]):
                if not block:
                    continue
                if words is None:
                    c.learn(block)
                ids, data = zip(*map(c.solved.__getitem__, block))
                joined = " ".join(ids)
                ids_digest.update((" " + joined if n else joined).encode())
                data_digest.update(b"".join(data))
                n += joined.count(" ") + 1
                if keep_ids:
                    kept.extend(map(int, joined.split(" ")))
            out["n_tokens"].append(n)
            out["ids_sha256"].append(ids_digest.hexdigest())
            out["decoded_sha256"].append(data_digest.hexdigest())
            out["ids"].append(kept if keep_ids else None)
        out["id"] = batch.column(0)
        yield out

    kind = dict(docs.dtypes)[id_col]
    mapped = map_batches(docs.select(id_col, text_col), run,
                         f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>")
    return mapped.withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
           ids_col: str = "ids") -> DataFrame:
    """Decode token-id arrays: ``id_col``, ``data binary`` and ``text`` (the bytes
    as UTF-8, malformed parts replaced). A null array decodes to empty. The ids
    become token-position rows, aggregated in order by DuckDB."""
    with open(ranks_path, "rb") as f:
        lines = f.read()
    key = (hashlib.sha256(lines).hexdigest(), pattern)
    shared = tokens.sparkSession.sparkContext.broadcast(lines)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        c = coder(key, shared.value, pattern)
        lists = [x or [] for x in batch.column(1).to_pylist()]
        size = np.array([len(x) for x in lists], np.int64)
        data = c.decode(np.repeat(np.arange(len(lists)), size), np.arange(size.sum()),
                        np.array([i for x in lists for i in x], np.int64), len(lists))
        yield {"id": batch.column(0), "data": data, "text": [d.decode("utf-8", "replace") for d in data]}

    kind = dict(tokens.dtypes)[id_col]
    return map_batches(tokens.select(id_col, ids_col), run, f"id {kind}, data binary, text string",
                       rows=200).withColumnRenamed("id", id_col)
