"""Periodic runs of words, and texts collapsed by them.

A run is a stretch of words with smallest period q (words q apart are equal) that
is at least ``min_words`` and three periods long and that neither neighbouring word
extends. Each has a Lyndon root under one of two opposite word orders: the longest
Lyndon word that starts at the root's place. So, per task and slice of documents:

1. A run's every eight words occur again inside it. Words outside all stretches of
   repeated eight-word shingles (hashed, so a collision only lets more through) can
   be in no run; only the stretches go on, each whole.
2. Baier's first phase of suffix sorting, over all stretches of the slice joined by
   separators, once for each order: suffixes are grouped by first word; groups are
   taken from the greatest down; each member points to the nearest earlier suffix in
   a lower group, and suffixes pointed to equally often move from their group to a
   new one just above it. In the end a group is the set of suffixes with one and the
   same longest Lyndon prefix, whose length is the Lyndon array.
3. Neighbouring equal roots (group equal at i and i + q) chain; the common
   extension of a chain's ends by the same period gives the run.

All steps are linear but for the sorting of hashes. A slice holds ``SLICE_BYTES``
of text, or one longer document. Documents are independent: no shuffle.

Edge cases: a null or blank text has no words and no runs, and collapses to the
empty string; repeated rows are treated alike; an empty table gives an empty result.
Other columns of ``docs`` are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.common import map_arrow

SLICE_BYTES = 2 << 20
MIN_WORDS, MIN_PERIODS = 24, 3  # shingles of MIN_WORDS // MIN_PERIODS words
WORD = r"[^\x20\x09-\x0D]+"  # fixed value: what bytes.split() splits into
SCHEMA = "id {id}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def lyndon_groups(codes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Baier's phase one. ``codes``: word ranks from 0, where 0 separates texts.

    Returns per position the length of the longest Lyndon word that starts there
    and the number of its group, equal for equal Lyndon words.
    """
    n = len(codes)
    by_code = np.argsort(codes, kind="stable").tolist()
    group = list(codes)
    members: list[list[int] | None] = [[] for _ in range(max(codes, default=0) + 1)]
    for i in by_code:
        members[codes[i]].append(i)
    length = [1] * len(members)
    lower = list(range(-1, len(members) - 1))  # the group just below
    upper = list(range(1, len(members) + 1))
    done = bytearray(n)
    before = [-1] * n
    at = len(members) - 1
    while at > 0:
        own = [i for i in members[at] if group[i] == at]
        members[at] = None
        for i in own:
            done[i] = 1
        # the places pointed to ascend, because members do
        places: list[int] = []
        counts: list[int] = []
        for i in own:
            j = i - 1
            while j >= 0 and done[j]:
                j = before[j]
            before[i] = j
            if j < 0 or not group[j]:  # separators stay alone and lowest
                continue
            if places and places[-1] == j:
                counts[-1] += 1
            else:
                places.append(j)
                counts.append(1)
        if places:
            add = length[at]
            for times in sorted(set(counts), reverse=True):
                new: dict[int, int] = {}
                for j, c in zip(places, counts):
                    if c != times:
                        continue
                    old = group[j]
                    to = new.get(old)
                    if to is None:
                        to = new[old] = len(members)
                        members.append([])
                        length.append(length[old] + add * times)
                        above = upper[old]
                        lower.append(old)
                        upper.append(above)
                        upper[old] = to
                        lower[above] = to
                    group[j] = to
                    members[to].append(j)
        at = lower[at]
    final = np.array(group, np.int64)
    return np.array(length, np.int64)[final], final


def _extend(codes: np.ndarray, i: int, j: int, most: int, step: int) -> int:
    """How many words agree from i and j on, going by ``step``, up to ``most``."""
    got, width = 0, 16
    while got < most:
        take = min(width, most - got)
        if step > 0:
            same = codes[i + got:i + got + take] == codes[j + got:j + got + take]
        else:
            same = codes[i - got - take + 1:i - got + 1][::-1] == codes[j - got - take + 1:j - got + 1][::-1]
        if not same.all():
            return got + int(np.argmin(same))
        got, width = got + take, width * 2
    return got


def find_runs(codes: np.ndarray, texts: np.ndarray, min_words: int = MIN_WORDS,
              min_periods: int = MIN_PERIODS) -> set[tuple[int, int, int]]:
    """(start, length, period) of all runs in ``codes``: word numbers from 1,
    stretches of text separated by zeros. ``texts``: per position the end of its
    stretch (the place of its separator)."""
    n, found = len(codes), set()
    top = int(codes.max(initial=0)) + 1
    for ranks in (codes, np.where(codes > 0, top - codes, 0)):
        period, group = lyndon_groups(ranks.tolist())
        here = np.arange(n)
        after = np.minimum(here + period, n - 1)
        same = (codes > 0) & (here + period < n) & (group[after] == group)
        prior = here - period
        first = same & ~((prior >= 0) & (group[np.maximum(prior, 0)] == group))
        for i in np.flatnonzero(first).tolist():
            q, last = int(period[i]), i
            own = group[i]
            while last + q < n and group[last + q] == own:
                last += q
            left = i
            end = last + q
            if end - left + 2 * (q - 1) < max(min_words, min_periods * q):
                continue
            left -= _extend(codes, i - 1, i + q - 1, min(q - 1, i), -1)
            end += _extend(codes, last, end, min(q - 1, int(texts[i]) - end), 1)
            if end - left >= max(min_words, min_periods * q):
                found.add((left, end - left, q))
    return found


def _stretches(hashes: np.ndarray, ends: np.ndarray, doc_of: np.ndarray, shingle: int,
               min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words whose every shingle occurs twice
    or more in their document."""
    n = len(hashes)
    if n < shingle:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    key = np.zeros(n - shingle + 1, np.uint64)
    for k in range(shingle):
        key = key * odd + hashes[k:n - shingle + 1 + k]
    key ^= key >> np.uint64(29)
    at = np.arange(len(key))
    key += (doc_of[:len(key)].astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    inside = at + shingle <= ends[doc_of[:len(key)]]
    at, key = at[inside], key[inside]
    order = np.argsort(key)
    ranked = key[order]
    twin = ranked[1:] == ranked[:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][twin]] = True
    again[order[:-1][twin]] = True
    at = at[again]
    if not len(at):
        return at, at
    new = np.flatnonzero((np.diff(at) != 1) | (doc_of[at[1:]] != doc_of[at[:-1]])) + 1
    starts = at[np.concatenate(([0], new))]
    stops = at[np.concatenate((new - 1, [len(at) - 1]))] + shingle
    long = stops - starts >= min_words
    return starts[long], stops[long]


def runs_of_texts(docs: list[list[bytes]], min_words: int = MIN_WORDS,
                  min_periods: int = MIN_PERIODS) -> list[list[tuple[int, int, int]]]:
    """Per text (a list of words) its runs (start, length, period), sorted."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    sizes = np.array([len(d) for d in docs], np.int64)
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(docs) else 0
    hashes = np.fromiter(map(hash, chain.from_iterable(docs)), np.int64, n).view(np.uint64)
    doc_of = np.repeat(np.arange(len(docs)), sizes)
    # at least one word in all; a run of min_words holds min_periods shingles' words
    starts, stops = _stretches(hashes, ends, doc_of, max(1, min_words // min_periods), min_words)
    if not len(starts):
        return out
    numbers: dict[bytes, int] = {}
    codes, text_ends, origin = [], [], []
    for a, b in zip(starts.tolist(), stops.tolist()):
        d = int(doc_of[a])
        base = int(ends[d] - sizes[d])
        origin.append((len(codes), d, a - base))
        words = docs[d][a - base:b - base]
        text_ends.extend([len(codes) + len(words)] * (len(words) + 1))
        codes.extend([numbers.setdefault(w, len(numbers) + 1) for w in words])
        codes.append(0)
    places = [o[0] for o in origin]
    for start, length, period in find_runs(np.array(codes, np.int64), np.array(text_ends, np.int64),
                                           min_words, min_periods):
        k = int(np.searchsorted(places, start, side="right")) - 1
        at, d, word = origin[k]
        out[d].append((word + start - at, length, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but for those that a run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int32)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
    return [words[i] for i in kept.tolist()]


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > SLICE_BYTES:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
              min_periods: int = MIN_PERIODS) -> DataFrame:
    """Per row ``id_col``, ``n_words``, ``runs`` (array of start, length, period by
    start, then period; word numbers from 0) and ``collapsed``, the kept words joined
    by one space. Runs have at least ``min_words`` words and ``min_periods`` periods
    (three or more, so that two neighbouring roots lie whole in each)."""
    if min_periods < 3 or min_words < min_periods:
        raise ValueError("at least three periods, and a word for each")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            sizes = texts.fill_null(b"")
            sizes = pa.compute.binary_length(sizes).to_numpy(zero_copy_only=False)
            for a, b in _slices(sizes):
                words = [(t or b"").split() for t in texts.slice(a, b - a).to_pylist()]
                runs = runs_of_texts(words, min_words, min_periods)
                offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
                flat = np.array(list(chain.from_iterable(runs)), np.int64).reshape(-1, 3)
                fields = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)],
                                                    ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array([len(w) for w in words], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets), fields),
                     pa.array([b" ".join(collapse(w, r)) for w, r in zip(words, runs)], pa.binary()).cast(pa.string())],
                    ["id", "n_words", "runs", "collapsed"])

    kind = dict(docs.dtypes)[id_col]
    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run,
                     SCHEMA.format(id=kind)).withColumnRenamed("id", id_col)


def with_periodic_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``text_col`` with a tenth of the texts given a periodic end.

    h is the CRC-32 of the decimal id and g = h div 10. Where h mod 10 is 0 and the
    text has n > 0 words, each word i >= a becomes word a + (i - a) mod p, with
    a = g mod n and p = 1 + (n - a) div (3 + g mod 8); such a text is its words
    joined by one space. A null id changes nothing.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    text = F.col(text_col)

    def rewritten(w: Column) -> Column:
        n = F.size(w).cast("long")
        g = F.floor(h / 10)
        at = F.struct(n.alias("n"), (g % n).alias("a"), (F.lit(3) + g % 8).alias("parts"))

        def joined(s: Column) -> Column:
            p = F.lit(1) + F.floor((s["n"] - s["a"]) / s["parts"])

            def word(i: Column) -> Column:
                j = F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % p)
                return F.get(w, j.cast("int"))

            return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), s["n"] - 1), word), " ")

        return F.when(F.size(w) > 0, F.element_at(F.transform(F.array(at), joined), 1)).otherwise(text)

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    planted = F.element_at(F.transform(F.array(words), rewritten), 1)
    return docs.select(F.col(id_col), F.when((h % 10 == 0) & text.isNotNull(), planted).otherwise(text).alias(text_col))


def run_report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests of ``word_runs``: the number of runs, the run of greatest exact
    length/period (ties: smallest start, then period), and SHA-256 sums of the runs
    and of the collapsed text."""
    runs = F.col("runs")
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate(runs, none, lambda b, r: F.when(
        b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.array_join(F.transform(runs, lambda r: F.concat_ws(
        "", F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")),
        F.lit("\n"))), "")
    return found.select(
        F.col(id_col), F.size(runs).cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    ).select(id_col, "n_runs", "best.start", "best.length", "best.period",
             F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
