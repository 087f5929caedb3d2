"""Language identification by a string kernel.

The kernel of two texts counts the character n-grams (1 to 4, hashed to bins)
that both hold, presence only, over the geometric mean of their numbers. A
bounded sample of labelled documents fits the model: some become Nystroem
landmarks, whose inverse root kernel maps a text's kernel values to features,
and kernel ridge regression on these gives one score per language against the
rest. A text's score is linear in its n-gram presences, so landmarks, map and
ridge weights fold into one matrix (bins x languages), and texts are scored by
products of presence batches with it. The predicted language has the highest
score (ties: the first in sorted order); ``score`` is its share in a softmax.

Texts are whole, lower-cased, runs of non-letters as one space. Edge cases: a
text that is null or has no letter is ``und`` with score 0; with no labelled
rows every text is ``und``; with one language every other text is that one.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.common import cut, map_batches
from surveyspark.llm.quality import crc_of_id

BINS_LOG2, LONGEST = 15, 4
#: Sampled documents per language, in expectation; and over all, at most.
PER_LANGUAGE, SAMPLE = 500, 8000
LANDMARKS, RIDGE, SHARPNESS = 160, 1e-3, 8.0
UNKNOWN = "und"
#: Characters hashed at once.
PIECE = 500_000


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def bins(text: str | None) -> np.ndarray | None:
    """The sorted bins of a text's n-grams; None if it has no letter."""
    held = np.zeros(1 << BINS_LOG2, bool)
    some, tail = False, np.array([32], np.uint32)
    lowered = (text or "").lower()
    for at in range(0, len(lowered), PIECE):
        points = np.frombuffer(lowered[at:at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = letters()[points]
        some = some or bool(letter.any())
        points = np.where(letter, points, np.uint32(32))
        points = np.concatenate((tail, points, [np.uint32(32)] if at + PIECE >= len(lowered) else []))
        points = points.astype(np.uint32)
        points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]
        h = np.zeros(len(points), np.uint32)
        for n in range(1, LONGEST + 1):
            if len(points) < n:
                break
            h = (h[:len(points) - n + 1] ^ points[n - 1:]) * np.uint32(0x01000193) + np.uint32(n)
            held[(h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BINS_LOG2)] = True
        tail = points[-(LONGEST - 1):]
    return np.flatnonzero(held) if some else None


def presence(rows: list[np.ndarray]) -> np.ndarray:
    """Presence rows scaled by one over the root of their counts."""
    out = np.zeros((len(rows), 1 << BINS_LOG2), np.float32)
    for i, b in enumerate(rows):
        out[i, b] = 1 / np.sqrt(len(b))
    return out


def fit_kernel(rows: list[np.ndarray], langs: list[str]) -> tuple[list[str], np.ndarray]:
    """Sorted languages and the matrix (bins x languages)."""
    names = sorted(set(langs))
    turn: dict[str, int] = {}
    place = []  # round robin over languages picks the landmarks
    for i, lang in enumerate(langs):
        turn[lang] = turn.get(lang, 0) + 1
        place.append((turn[lang], i))
    chosen = [i for _, i in sorted(place)[:max(LANDMARKS, len(names))]]
    marks = presence([rows[i] for i in chosen])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    to_features = vectors[:, keep] / np.sqrt(values[keep])
    gram = np.zeros((keep.sum(),) * 2)
    targets = np.zeros((keep.sum(), len(names)))
    for at in range(0, len(rows), 256):
        phi = presence(rows[at:at + 256]) @ marks.T @ to_features
        want = np.array(langs[at:at + 256])[:, None] == np.array(names)
        gram += phi.T @ phi
        targets += phi.T @ (2.0 * want - 1)
    weights = np.linalg.solve(gram + RIDGE * len(rows) * np.eye(len(gram)), targets)
    return names, (marks.T @ (to_features @ weights)).astype(np.float32)


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> tuple[list[str], np.ndarray] | None:
    """The model from a bounded sample of rows with a language for which
    ``learn`` (over ``id``) holds."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn)
    counts = rows.groupBy("lang").count().collect()  # one row per language
    if not counts:
        return None
    share = min(PER_LANGUAGE, SAMPLE / len(counts))
    rate = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, share / r["count"]))))
    draw = F.xxhash64(F.lit("sample"), "id").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    drawn = rows.where(draw < rate[F.col("lang")]).withColumn("text_hash", F.xxhash64("text"))
    # keys alone are sorted; a row that repeats as a whole counts once
    keys = (drawn.select("id", "lang", "text_hash").distinct()
            .orderBy(draw / rate[F.col("lang")], "id", "lang", "text_hash").limit(SAMPLE)
            .select(F.col("id").alias("k_id"), F.col("lang").alias("k_lang"), F.col("text_hash").alias("k_hash")))
    picked = drawn.join(F.broadcast(keys), F.col("id").eqNullSafe(F.col("k_id"))  # at most SAMPLE keys
                        & (F.col("lang") == F.col("k_lang")) & (F.col("text_hash") == F.col("k_hash")), "left_semi")
    sample = cut(picked.dropDuplicates(["id", "lang", "text_hash"])
                 .select("id", "lang", "text", draw.alias("draw")))

    def run(batch: pa.RecordBatch):
        found = [bins(t) for t in batch.column(2).to_pylist()]
        yield {"draw": batch.column(0), "lang": batch.column(1),
               "bins": [None if b is None else b.astype(np.uint16).tobytes() for b in found]}

    got = (map_batches(sample.select("draw", "lang", "text").repartition(8), run, "draw double, lang string, bins binary")
           .where("bins is not null").toPandas().sort_values(["draw", "bins"]))
    if not len(got):
        return None
    return fit_kernel([np.frombuffer(b, np.uint16).astype(np.int64) for b in got["bins"]], got["lang"].tolist())


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col, held_out, lang_pred, score``: learnt from ids whose CRC mod 4 is
    not 2."""
    model = fit(docs, crc_of_id("id") % 4 != 2, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        found = [bins(t) for t in batch.column(1).to_pylist()]
        langs, scores = [UNKNOWN] * len(found), np.zeros(len(found))
        if shared.value is not None:
            names, matrix = shared.value
            at = [i for i, b in enumerate(found) if b is not None]
            for block in (at[i:i + 64] for i in range(0, len(at), 64)):
                values = (presence([found[i] for i in block]) @ matrix).astype(np.float64) * SHARPNESS
                share = np.exp(values - values.max(1, keepdims=True))
                share /= share.sum(1, keepdims=True)
                for i, best, row in zip(block, values.argmax(1), share):
                    langs[i], scores[i] = names[best], row[best]
        yield {"id": batch.column(0), "lang_pred": langs, "score": scores}

    out = map_batches(docs.select(id_col, text_col), run,
                      f"id {dict(docs.dtypes)[id_col]}, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), (crc_of_id("id") % 4 == 2).alias("held_out"), "lang_pred", "score")
