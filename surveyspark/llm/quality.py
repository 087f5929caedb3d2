"""Quality classifier: random-indexing word vectors, a two-layer network and a
temperature.

Words are letter-digit runs and punctuation runs; every word also counts by its
shape (upper, lower, title case, digits, ...). Each word falls into one of
``BUCKETS`` buckets, and each bucket has a fixed sparse ternary index vector.
Random indexing sums for each bucket, over all documents, labelled or not, the
index vectors of the neighbours of its words; the sums are integers, so they do
not depend on how rows were dealt. A document is the mean
of its words' normalised context vectors, of their index vectors and shapes,
beside a few statistics of its repetition. A network with one hidden layer is
trained on the driver on at most ``SAMPLE`` such rows; a temperature fitted on
a fifth of them, which the training did not see, calibrates its probabilities.
Scoring runs over whole texts in batches; only the model (under 5 MB whatever
the input) is broadcast.

Edge cases: a null text is an empty one and gets the score of empty texts;
labels that are null are ignored, several labels of one id are averaged; with
no labels every score is 0.5, with labels of one class every score is that
class's smoothed share. Label columns, language, source and id are never
inputs.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, replace
from functools import lru_cache
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.common import cut, map_arrow, map_batches

#: Labelled documents used for fitting, at most.
SAMPLE = 12_000
BUCKETS, DIMS, NONZERO, WINDOW = 8192, 32, 4, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 30, 128, 5e-3, 1e-4
SHAPES = ("lower", "title", "upper", "mixed", "digit", "alnum", "punct", "long punct")
WORDS = re.compile(r"\w+|[^\w\s]+")
STATISTICS = 6
WIDTH = 2 * DIMS + len(SHAPES) + STATISTICS
#: Characters split into words at once.
PIECE = 200_000


def crc_of_id(id_col: str) -> Column:
    """CRC-32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


@lru_cache(1)
def index_vectors() -> np.ndarray:
    """Fixed sparse ternary vectors, ``NONZERO`` entries of +-1 each."""
    rng = np.random.default_rng(7)
    out = np.zeros((BUCKETS, DIMS), np.int32)
    at = rng.permuted(np.tile(np.arange(DIMS), (BUCKETS, 1)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.int32), at.shape), axis=1)
    return out


@lru_cache(50_000)
def bucket(word: str) -> int:
    return crc32(word.encode()) % BUCKETS


@lru_cache(50_000)
def shape(word: str) -> int:
    if not (word[0].isalnum() or word[0] == "_"):
        return 6 if len(word) == 1 else 7
    if word.isalpha():
        return 0 if word.islower() else 2 if word.isupper() and len(word) > 1 else 1 if word[1:].islower() or len(word) == 1 else 3
    return 4 if word.isdigit() else 5


def pieces(text: str):
    """Consecutive pieces of a text, cut at white space where there is some."""
    at = 0
    while len(text) - at > PIECE:
        to = max(text.rfind(" ", at, at + PIECE), text.rfind("\n", at, at + PIECE)) + 1
        to = to if to > at else at + PIECE
        yield text[at:to]
        at = to
    yield text[at:]


class Buckets(dict):
    """Buckets of words by one lookup; forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = out = crc32(word.encode()) % BUCKETS
        return out


class Contexts:
    """For each bucket, the index vectors of its words' neighbours, summed.

    Neighbours are counted as pairs of buckets first, so that a pair costs the
    same however often it occurs; the index vectors' ``NONZERO`` entries are then
    added for the distinct pairs only.
    """

    #: Bucket pairs held before they are added up.
    HELD = 1 << 21

    def __init__(self):
        self.sums = np.zeros(BUCKETS * DIMS, np.int64)
        self.find = Buckets()
        self.at = np.nonzero(index_vectors())[1].reshape(BUCKETS, NONZERO)
        self.sign = np.take_along_axis(index_vectors(), self.at, axis=1).astype(np.float64)
        self.pairs: list[np.ndarray] = []
        self.held = 0

    def add(self, text: str | None) -> None:
        for piece in pieces(text or ""):
            words = WORDS.findall(piece)
            b = np.fromiter(map(self.find.__getitem__, words), np.int32, len(words))
            for d in range(1, min(WINDOW, len(b) - 1) + 1):
                self.pairs.append(b[:-d] * np.int32(BUCKETS) + b[d:])
                self.held += len(b) - d
            if self.held >= self.HELD:
                self.settle()

    def settle(self) -> None:
        if self.pairs:
            pair, times = np.unique(np.concatenate(self.pairs), return_counts=True)
            left, right = np.divmod(pair, BUCKETS)
            for word, other in ((left, right), (right, left)):
                cell = word.astype(np.int64) * DIMS
                for t in range(NONZERO):
                    # whole numbers far below 2**53, so the doubles are exact
                    added = np.bincount(cell + self.at[other, t], self.sign[other, t] * times, len(self.sums))
                    self.sums += added.astype(np.int64)
        self.pairs, self.held = [], 0

    def result(self) -> np.ndarray:
        self.settle()
        return self.sums.reshape(BUCKETS, DIMS)


def context_sums(texts: list[str | None]) -> np.ndarray:
    """For each bucket, the index vectors of its words' neighbours, summed."""
    contexts = Contexts()
    for text in texts:
        contexts.add(text)
    return contexts.result()


def corpus_contexts(docs: DataFrame, text_col: str) -> np.ndarray:
    """``context_sums`` of all texts of ``docs``: sums per task, then per bucket, so
    the driver gets ``BUCKETS`` rows whatever the input."""
    names = [f"s{i}" for i in range(DIMS)]

    def run(batches):
        contexts = Contexts()
        for batch in batches:
            for text in batch.column(0):
                contexts.add(text.as_py())
        sums = contexts.result()
        some = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_pydict(
            {"bucket": some.astype(np.int32)} | {n: sums[some, i] for i, n in enumerate(names)})

    parts = map_arrow(docs.select(text_col), run, "bucket int, " + ", ".join(f"{n} long" for n in names))
    table = parts.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    total = np.zeros((BUCKETS, DIMS), np.int64)
    if table.num_rows:
        total[table.column("bucket").to_numpy()] = np.stack([table.column(n).to_numpy() for n in names], axis=1)
    return total


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Normalised context vectors beside index vectors, per bucket."""
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.hstack([sums / np.maximum(norm, 1), index_vectors() / 2.0]).astype(np.float32)


def features(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """One pooled row per text."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for i, text in enumerate(texts):
        counts: Counter[str] = Counter()
        repeats = 0  # of the word just before
        for piece in pieces(text or ""):
            found = WORDS.findall(piece)
            counts.update(found)
            repeats += sum(map(eq, found, found[1:]))
        if not counts:
            continue
        words = list(counts)
        times = np.fromiter(counts.values(), np.float32, len(words))
        n = float(times.sum())
        row = out[i]
        row[:2 * DIMS] = times @ vectors[list(map(bucket, words))] / n
        shapes = np.bincount(list(map(shape, words)), times, len(SHAPES))
        row[2 * DIMS:-STATISTICS] = shapes / n
        letters = times @ np.fromiter(map(len, words), np.float32, len(words))
        row[-STATISTICS:] = (len(words) / n, times.max() / n, np.log1p(n) / 8, letters / n / 10,
                             np.log1p(n / len(words)), repeats / n)
    return out


@dataclass
class Network:
    """Standardised inputs, a tanh layer, a logit divided by a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 11) -> Network:
    """Adam on the cross entropy of the first four fifths; the temperature from
    the rest. Rows come in a fixed order, so the result is reproducible."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    rng, held = np.random.default_rng(seed), np.arange(len(y)) % 5 == 4
    tx, ty = (x[~held], y[~held])
    net = Network(tx.mean(0), tx.std(0) + 1e-3, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)),
                  np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0)
    if y.min() == y.max():
        return replace(net, w2=np.zeros(HIDDEN), b2=float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    z = (tx - net.mean) / net.scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(ty))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            h = np.tanh(z[rows] @ params[0] + params[1])
            error = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30))) - ty[rows]) / len(rows)
            back = np.outer(error, params[2]) * (1 - h * h)
            grads = [z[rows].T @ back + DECAY * params[0], back.sum(0), h.T @ error + DECAY * params[2],
                     np.array([error.sum()])]
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (1 - epoch / EPOCHS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if held.any():
        logit, want = net.logits(x[held]), y[held]

        def loss(t: float) -> float:
            return float(np.mean(np.logaddexp(0, -np.clip(logit / t, -60, 60) * (2 * want - 1))))

        net.temperature = min(np.geomspace(0.25, 8, 61).tolist(), key=loss)
    return net


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> tuple[np.ndarray, Network] | None:
    """Word vectors from all texts, network from at most ``SAMPLE`` labelled
    documents for which ``learn`` (over ``id``) holds; None without any."""
    marked = (labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
              .where(F.col("id").isNotNull() & F.col("label").isNotNull() & learn)
              .groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label")))
    draw = F.xxhash64(F.lit("sample"), "id").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    wanted = (marked.where(draw < SAMPLE / max(1, marked.count())).orderBy(draw, "id")
              .limit(SAMPLE))  # the draw leaves about SAMPLE rows for this sort
    sample = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
                 .join(F.broadcast(wanted), "id")  # at most SAMPLE rows
                 .groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
                 .repartition(8))

    vectors = word_vectors(corpus_contexts(docs, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def rows(batch: pa.RecordBatch):
        yield {"id": batch.column(0), "label": batch.column(1),
               "x": [r.tobytes() for r in features(batch.column(2).to_pylist(), shared.value)]}

    id_type = dict(docs.dtypes)[id_col]
    got = map_batches(sample.select("id", "label", "text"), rows, f"id {id_type}, label int, x binary").toPandas()
    if not len(got):
        return None
    got = got.sort_values("id", key=lambda ids: ids.map(lambda v: crc32(str(v).encode())), kind="stable")
    return vectors, train(np.stack([np.frombuffer(r, np.float32) for r in got["x"]]), got["label"].to_numpy())


def score(docs: DataFrame, model: tuple[np.ndarray, Network] | None, id_col: str = "doc_id",
          text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``score`` and the columns in ``keep`` per row."""
    kinds = dict(docs.dtypes)
    names = [id_col, text_col, *(c for c in keep if c not in (id_col, text_col))]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        texts = batch.column(1).to_pylist()
        p = (np.full(len(texts), 0.5) if shared.value is None
             else shared.value[1].probability(features(texts, shared.value[0]).astype(np.float64)))
        cols = {f"c{i}": batch.column(i) for i in range(len(names)) if i != 1 or text_col in keep}
        yield cols | {"p": p}

    kept = [i for i in range(len(names)) if i != 1 or text_col in keep]
    schema = ", ".join([*(f"c{i} {kinds[names[i]]}" for i in kept), "p double"])
    out = map_batches(docs.select(*names), run, schema)
    return out.select(*(F.col(f"c{i}").alias(names[i]) for i in kept), F.col("p").alias("score"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted``: learnt from ids whose CRC mod 5 is
    not 0; ``predicted`` is 1 from ``threshold`` on."""
    model = fit(docs, labels, crc_of_id("id") % 5 != 0, id_col, text_col)
    return score(docs, model, id_col, text_col).select(
        id_col, (crc_of_id(id_col) % 5 == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that score ``threshold`` or more;
    the model learns from the same documents as in ``classify``."""
    model = fit(docs, labels, crc_of_id("id") % 5 != 0, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch):
        if shared.value is not None:
            vectors, network = shared.value
            p = network.probability(features(batch.column(at).to_pylist(), vectors).astype(np.float64))
            batch = batch.filter(pa.array(p >= threshold))
        yield {name: batch.column(i) for i, name in enumerate(batch.schema.names)}

    return map_batches(docs, run, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes))
