"""Benchmark decontamination by size-partitioned MinHash containment search.

Texts are lower-cased and cut into words (runs of ASCII letters and digits and
of all non-ASCII characters); shingles are ``shingle`` words (a shorter item is
one shingle). An item is contained in a document if at least ``threshold`` of
its distinct shingles stand there.

Items are partitioned by their number of shingles into classes that double. An
item's sketch is its bottom-m MinHash values, m = n - ceil(threshold * n) + 1
of n: of any ``threshold`` of the shingles at least one is in the sketch, so no
contained item is missed. Documents are hashed as a whole: only shingle hashes
under the largest sketch value of a class are looked up in its sketch, and a
class is left out for documents with fewer words than its items need. Every
candidate (document, item) is then verified by exact shingle containment.

Items are the stated query set: they come in blocks of at most ``BLOCK_BYTES``
of text, each broadcast in turn, and documents are never shuffled.

Edge cases: null, empty and word-less items or documents match nothing; items
are told apart by id, and rows with equal id and text are one item; repeated
documents each give their rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.common import map_batches

#: Bytes of item text in one broadcast block (the sketches are smaller).
BLOCK_BYTES = 4 << 20
WORD = re.compile("[0-9a-z\\u0080-\\U0010ffff]+")
#: Bytes of a document hashed at once.
PIECE = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.zeros(256, bool)
_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _powers(base: int) -> np.ndarray:
    steps = np.full(PIECE + 2, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_PRIME = 0x100000001B3
_POWERS, _BACK = _powers(_PRIME), _powers(pow(_PRIME, -1, 1 << 64))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash per word of lower-cased UTF-8 text, by prefix sums."""
    x = np.frombuffer(data, np.uint8)
    edge = np.diff(_BYTE[x].astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _POWERS[:len(x)])))
    h = (sums[end] - sums[start]) * _BACK[start]
    h = (h ^ (h >> np.uint64(31))) * ODD
    return h ^ (h >> np.uint64(29))


def pieces(data: bytes) -> Iterator[bytes]:
    """Pieces of at most about ``PIECE`` bytes that cut no word, if it can be helped."""
    at = 0
    while len(data) - at > PIECE:
        to = max(data.rfind(b" ", at, at + PIECE), data.rfind(b"\n", at, at + PIECE)) + 1
        to = to if to > at else at + PIECE
        yield data[at:to]
        at = to
    yield data[at:]


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    if len(words) < width:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        h = (h ^ words[i:len(words) - width + 1 + i]) * ODD
        h ^= h >> np.uint64(32)
    return h


def hashes_of(text: str, widths: list[int]) -> dict[int, np.ndarray]:
    """Shingle hashes of a whole text for each width."""
    words = [word_hashes(p) for p in pieces(text.lower().encode())]
    joined = words[0] if len(words) == 1 else np.concatenate(words)
    return {w: shingle_hashes(joined, w) for w in widths}


def shingles(words: list[str], width: int) -> set[str]:
    return {" ".join(words[i:i + width]) for i in range(len(words) - width + 1)}


class Block:
    """Sketches of a block of items, partitioned by shingle width and number."""

    def __init__(self, items: list[tuple], shingle: int, threshold: float):
        self.threshold, self.items = threshold, items
        self.sets: list[tuple[int, set[str]]] = []
        classes: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.least_words: dict[tuple[int, int], int] = {}
        for number, (_, text) in enumerate(items):
            words = WORD.findall(text.lower())
            width = min(shingle, len(words))
            own = shingles(words, width) if width else set()
            self.sets.append((width, own))
            if not own:
                continue
            need = math.ceil(threshold * len(own) - 1e-9)
            hashed = np.unique(hashes_of(text, [width])[width])
            # equal hashes of unequal shingles only shorten the list; the sketch keeps its size
            sketch = hashed[:len(own) - need + 1]
            key = (width, len(own).bit_length())
            classes.setdefault(key, []).extend((int(h), number) for h in sketch)
            self.least_words[key] = min(self.least_words.get(key, 1 << 60), need + width - 1)
        self.classes = {}
        for key, pairs in classes.items():
            values = np.array([h for h, _ in pairs], np.uint64)
            order = np.argsort(values, kind="stable")
            numbers = np.array([n for _, n in pairs])[order]
            sieve = np.zeros(1 << 16, bool)
            sieve[values & np.uint64(0xFFFF)] = True
            self.classes[key] = (values[order], numbers, sieve)
        self.widths = sorted({w for w, _ in self.classes})

    def candidates(self, text: str) -> set[int]:
        hashed, found = hashes_of(text, self.widths), set()
        for key, (values, numbers, sieve) in self.classes.items():
            h = hashed[key[0]]
            if len(h) + key[0] - 1 < self.least_words[key]:
                continue
            h = h[sieve[h & np.uint64(0xFFFF)]]
            h = np.unique(h[h <= values[-1]])
            for left, right in zip(np.searchsorted(values, h, "left"), np.searchsorted(values, h, "right")):
                found.update(numbers[left:right].tolist())
        return found

    def contained(self, text: str) -> list[tuple[int, int, int]]:
        """(item number, shingles shared, shingles of the item), verified."""
        found = self.candidates(text)
        if not found:
            return []
        words, by_width, out = WORD.findall(text.lower()), {}, []
        for number in sorted(found):
            width, own = self.sets[number]
            if width not in by_width:
                by_width[width] = shingles(words, width)
            shared = len(own & by_width[width])
            if shared >= self.threshold * len(own) - 1e-9:
                out.append((number, shared, len(own)))
        return out


def blocks_of(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Items in blocks of bounded text, read one partition at a time."""
    block, size = [], 0
    rows = (items.select(id_col, text_col).where(F.col(text_col).isNotNull()).distinct())
    for row in rows.toLocalIterator():
        if block and size + len(row[1]) * 4 > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1]) * 4
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, shingle: int = 5, threshold: float = 0.8,
                 id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                 item_text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, item_id, n_shared, n_item, containment`` for every contained
    item of every document row."""
    kinds = dict(docs.dtypes)
    schema = (f"id {kinds[id_col]}, item_id {dict(items.dtypes)[item_id_col]}, n_shared int, n_item int, "
              "containment double")
    found = []
    for block in blocks_of(items, item_id_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        found.append(map_batches(docs.select(id_col, text_col), _finder(shared, shingle, threshold), schema))
    if not found:
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    return reduce(DataFrame.unionByName, found).withColumnRenamed("id", id_col)


def _finder(shared, shingle: int, threshold: float):
    key = _key(shared.value, shingle, threshold)

    def run(batch: pa.RecordBatch):
        block = _block(key, shared, shingle, threshold)
        out: dict[str, list] = {"id": [], "item_id": [], "n_shared": [], "n_item": [], "containment": []}
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for number, n_shared, n_item in block.contained(text) if text else ():
                out["id"].append(i)
                out["item_id"].append(block.items[number][0])
                out["n_shared"].append(n_shared)
                out["n_item"].append(n_item)
                out["containment"].append(n_shared / n_item)
        yield out

    return run


_BLOCKS: dict[str, Block] = {}


def _key(items: list[tuple], shingle: int, threshold: float) -> str:
    return xxhash.xxh3_128_hexdigest(repr((items, shingle, threshold)).encode("utf-8", "surrogatepass"))


def _block(key: str, shared, shingle: int, threshold: float) -> Block:
    """The sketches of a broadcast block, built once per worker; one is kept."""
    if key not in _BLOCKS:
        _BLOCKS.clear()
        _BLOCKS[key] = Block(shared.value, shingle, threshold)
    return _BLOCKS[key]


def clean(docs: DataFrame, items: DataFrame, shingle: int = 5, threshold: float = 0.8, id_col: str = "doc_id",
          text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that contain no item."""
    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    at = docs.columns.index(text_col)
    for block in blocks_of(items, item_id_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        docs = map_batches(docs, _keeper(shared, shingle, threshold, at), kinds)
    return docs


def _keeper(shared, shingle: int, threshold: float, at: int):
    key = _key(shared.value, shingle, threshold)

    def run(batch: pa.RecordBatch):
        block = _block(key, shared, shingle, threshold)
        keep = pa.array([not (t and block.contained(t)) for t in batch.column(at).to_pylist()], pa.bool_())
        left = batch.filter(keep)
        yield {name: left.column(i) for i, name in enumerate(left.schema.names)}

    return run
