"""Line and sentence de-duplication across documents by unit digests.

A unit is a line, or a piece of a line; where a line is cut depends only on the
words near the cut, never on what precedes, so that a passage pasted into a
paragraph yields the same units in every document. A sentence of ``SHORT`` words
or more stands for itself, and so does an unbroken run of shorter ones (one of
under ``SHORT`` words in all goes with the next sentence); within these a cut falls
before each word whose hash (with the next word's) is the least of the ``NEAR``
words on either side. Units are normalised (lower case, white
space runs to one space) and hashed to 128 bits: whole lines whatever their
length, pieces from ``min_words`` words on. Spark groups the
digests globally (partial minima before the shuffle, so a line that a third of
all documents hold costs one row per task), the occurrence of least rank
(document id, text hash, unit number) stays, and all others are cut out of their
texts. Spans keep the offsets of the original text.

A document's own later copies of a unit go too. Only digests and positions are
shuffled by unit; texts move once, to meet their removals.

Edge cases: a null text stays null, an empty one empty; null ids rank first;
rows equal in id and text count as one document and keep or lose the same
spans; ties in rank are equal rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.common import cut, map_batches

#: Sentences of fewer words are no units of their own.
SHORT = 5
#: A cut's word hash is the least of so many words on either side.
NEAR = 5
#: Words from cut to cut where none is found in over 4 * ``NEAR`` words.
STEP = 9
END = re.compile(r"[.!?]+(?=\s)")
WORD = re.compile(r"\S+")


def cut_words(text: str) -> list[int]:
    """Numbers of the words before which a sentence is cut. The window lies
    within the sentence, so a piece has over ``NEAR`` words. Where words repeat
    so that long none is least, cuts follow at even steps."""
    words = " ".join(text.lower().split()).encode().split(b" ")
    if len(words) < 2 * NEAR + 2:
        return []
    h = list(map(crc32, words[1:], map(crc32, words)))
    cuts, i = [0], NEAR + 1
    while i < len(words) - NEAR:
        window = h[i - NEAR:i + NEAR + 1]
        least = i - NEAR + window.index(min(window))
        if least == i:
            cuts.append(i)
        # none between the least word and the end of its reach is a least one
        i = least if least > i else least + NEAR + 1
    cuts.append(len(words))
    for at, to in zip(cuts[:-1], cuts[1:]):
        if to - at > 4 * NEAR:
            cuts.extend(range(at + STEP, to - NEAR, STEP))
    return sorted(cuts)[1:-1]


def sentences(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Spans of a line: long sentences, and runs of short ones. A run too short
    for a unit goes with the sentence after it, if there is one."""
    spans: list[tuple[int, int]] = []
    at = run = start
    short = 0  # words in the run from ``run`` to ``at``
    for to in (*(found.end() for found in END.finditer(text, start, end)), end):
        n = len(text[at:to].split())
        if n >= SHORT:
            if short >= SHORT:
                spans.append((run, at))
                run = at
            spans.append((run, to))
            run, short = to, 0
        else:
            short += n
        at = to
    if spans and (run == end or text[run:end].isspace()):
        spans[-1] = (spans[-1][0], end)
    else:
        spans.append((run, end))
    return iter(spans)


def units(text: str) -> Iterator[tuple[int, int]]:
    """Consecutive (start, end) spans; newlines lie between units."""
    line = 0
    while True:
        end = text.find("\n", line)
        end = len(text) if end < 0 else end
        for start, to in sentences(text, line, end):
            cuts = cut_words(text[start:to])
            if cuts:
                words = WORD.finditer(text, start, to)
                passed = 0
                for number in cuts:
                    at = next(islice(words, number - passed, None)).start()
                    passed = number + 1
                    yield start, at
                    start = at
            yield start, to
        if end == len(text):
            return
        line = end + 1


def digests(text: str | None, min_words: int) -> Iterator[tuple[int, int, int]]:
    """(unit number, digest high, digest low) of the units that count."""
    text = text or ""
    for number, (start, end) in enumerate(units(text)):
        words = text[start:end].lower().split()
        whole = (not start or text[start - 1] == "\n") and (end == len(text) or text[end] == "\n")
        if words and (whole or len(words) >= min_words):
            digest = xxhash.xxh3_128_digest(" ".join(words).encode())
            yield number, int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def cut_spans(text: str, removed: dict[int, object]) -> tuple[str, list[dict]]:
    """The text without the removed units, and the spans cut out of it. A line
    of which nothing is left goes with its newline; neighbouring spans that
    stay in the same document are one."""
    spans: list[dict] = []
    whole_line, line_at = True, 0
    for number, (start, end) in enumerate(units(text)):
        if start == 0 or text[start - 1] == "\n":
            whole_line, line_at = True, start
        if number not in removed:
            whole_line = whole_line and start == end
            continue
        kept = removed[number]
        newline = end < len(text) and text[end] == "\n"
        to = end + 1 if newline and whole_line and (not spans or spans[-1]["end"] >= start or line_at == start) else end
        if spans and spans[-1]["end"] == start and spans[-1]["kept_id"] == kept:
            spans[-1]["end"] = to
        else:
            spans.append({"start": start, "end": to, "kept_id": kept})
    pieces, at = [], 0
    for span in spans:
        pieces.append(text[at:span["start"]])
        at = span["end"]
    return "".join([*pieces, text[at:]]), spans


def dedup(docs: DataFrame, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, text, n_removed`` (units cut), ``removed`` (spans with the id of
    the document that keeps the unit) for every row."""
    id_type = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))

    def hashed(batch: pa.RecordBatch):
        out: dict[str, list] = {"id": batch.column(0), "text_hash": batch.column(2), "unit": [], "hi": [], "lo": []}
        for text in batch.column(1).to_pylist():
            counted = list(digests(text, min_words))
            for at, name in enumerate(("unit", "hi", "lo")):
                out[name].append([unit[at] for unit in counted])
        yield out

    # texts are cut and hashed once; the written table has 20 bytes a unit
    written = cut(map_batches(rows.select("id", "text", "text_hash"), hashed,
                              f"id {id_type}, text_hash long, unit array<int>, hi array<long>, lo array<long>"))
    found = written.select("id", "text_hash", F.inline(F.arrays_zip("unit", "hi", "lo")))
    first = (found.groupBy("hi", "lo")
             .agg(F.min(F.struct("id", "text_hash", "unit")).alias("kept"), F.count("*").alias("n"))
             .where("n > 1").select("hi", "lo", "kept"))

    def differs(name: str) -> Column:
        return ~F.col(name).eqNullSafe(F.col(f"kept.{name}"))

    removals = (found.join(first, ["hi", "lo"]).where(differs("id") | differs("text_hash") | differs("unit"))
                .select("id", "text_hash", F.struct("unit", F.col("kept.id").alias("kept_id")).alias("r"))
                .distinct()  # rows repeated as a whole removed alike
                .groupBy("id", "text_hash").agg(F.collect_list("r").alias("removals"))
                .select(F.col("id").alias("r_id"), F.col("text_hash").alias("r_hash"), "removals"))
    joined = rows.join(removals, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("text_hash") == F.col("r_hash")), "left")

    def apply(batch: pa.RecordBatch):
        out: dict[str, list] = {"id": batch.column(0), "text": [], "n_removed": [], "removed": []}
        for text, removed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            spans: list[dict] = []
            if removed:
                text, spans = cut_spans(text, {r["unit"]: r["kept_id"] for r in removed})
            out["text"].append(text)
            out["n_removed"].append(len(removed or ()))
            out["removed"].append(spans)
        yield out

    span = f"array<struct<start:int,end:int,kept_id:{id_type}>>"
    return map_batches(joined.select("id", "text", "removals"), apply,
                       f"id {id_type}, text string, n_removed int, removed {span}").withColumnRenamed("id", id_col)
