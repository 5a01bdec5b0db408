"""Quality scores from random-indexing word vectors and a two-layer network.

Tokens are runs of letters, of digits and of other signs, hashed to `SLOTS`
slots.  Every slot has a fixed sparse ternary index vector; its context vector
adds up the index vectors of the tokens up to two places away, over all
documents of the corpus.  A slot's word vector is its unit context vector less
the mean of those, plus half its unit index vector.  A document is pooled to the mean of its tokens'
word vectors, that mean's length, the mean cosine and the share of equal ones among
neighbours, and the logarithm of its length.

A numpy network (one hidden tanh layer) is fitted on at most `fit_rows`
labelled documents; a fifth of them is held back to fit one temperature, which
calibrates the probabilities.

Labels, language, source and id are never inputs of a score.

Results in odd cases: null and empty texts are scored as a document without
tokens; null doc_ids are scored and never labelled; an id with contradictory
labels has the smallest; with no labels at all every score is 0.5, with labels
of one class only it is that class's smoothed share.  An empty table gives an
empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from harfmill.llm.bytesops import CHUNK, POLY, U64, doc_chunks, expand, mix, squeeze, string_bytes, token_runs, trim
from harfmill.llm.shared import ship

BITS, DIMENSIONS, SIGNS = 15, 48, 2
SLOTS = 1 << BITS
_PART = 128  # slots in one message
_TEXT = 8 * CHUNK  # bytes whose contexts are added up at a time


def slots_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each token, and each row's range of tokens."""
    start, end = token_runs(data, off)
    h = mix(POLY[0].span(POLY[0].prefix(data), start, end))
    return (h >> U64(64 - BITS)).astype(np.int64), np.searchsorted(start, off)


def index_positions(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """For each slot the places of its +1s and of its -1s."""
    rng = np.random.default_rng(seed)
    places = np.argsort(rng.random((SLOTS, DIMENSIONS)), axis=1)
    return places[:, :SIGNS], places[:, SIGNS : 2 * SIGNS]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's context sums, a message for each group of slots."""
    plus, minus = index_positions()
    total = np.zeros(SLOTS * DIMENSIONS, np.int64)
    for batch in batches:
        data, off = string_bytes(batch.column("text"))
        for lo, hi in doc_chunks(off, _TEXT):
            slot, edge = slots_of(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            owner = np.repeat(np.arange(hi - lo), np.diff(edge))
            for far in (1, 2):
                near = owner[far:] == owner[:-far]
                a, b = slot[:-far][near], slot[far:][near]
                for x, y in ((a, b), (b, a)):
                    for k in range(SIGNS):
                        total += np.bincount(x * DIMENSIONS + plus[y, k], minlength=len(total))
                        total -= np.bincount(x * DIMENSIONS + minus[y, k], minlength=len(total))
    trim()
    rows = total.reshape(SLOTS, DIMENSIONS)
    out = [(k, squeeze(rows[k * _PART : (k + 1) * _PART].astype(np.int32 if np.abs(rows).max(initial=0) < 2**31 else np.int64))) for k in range(SLOTS // _PART) if rows[k * _PART : (k + 1) * _PART].any()]
    if out:
        yield pa.RecordBatch.from_pydict({"part": pa.array([k for k, _ in out], pa.int32()), "sums": pa.array([b for _, b in out], pa.binary())})


def _open(blob: bytes) -> np.ndarray:
    raw = expand(blob)
    return np.frombuffer(raw, np.int32 if len(raw) == 4 * _PART * DIMENSIONS else np.int64).astype(np.int64)


def _add(table: pa.Table) -> pa.Table:
    total = sum(_open(b) for b in table.column("sums").to_pylist())
    return pa.table({"part": table.column("part")[:1], "sums": pa.array([squeeze(total)], pa.binary())})


def word_vectors(documents: DataFrame) -> np.ndarray:
    """SLOTS x DIMENSIONS word vectors over all documents (text column `text`): a model of fixed size."""
    sums = documents.select("text").mapInArrow(_contexts, "part int, sums binary").groupBy("part").applyInArrow(_add, "part int, sums binary")
    context = np.zeros((SLOTS // _PART, _PART * DIMENSIONS))
    for part, blob in sums.collect():  # SLOTS / _PART rows, whatever the input
        context[part] = _open(blob)
    context = context.reshape(SLOTS, DIMENSIONS)
    plus, minus = index_positions()
    index = np.zeros((SLOTS, DIMENSIONS))
    np.put_along_axis(index, plus, 1.0, axis=1)
    np.put_along_axis(index, minus, -1.0, axis=1)
    norm = np.sqrt((context * context).sum(1, keepdims=True))
    seen = norm[:, 0] > 0
    unit = context / np.where(norm > 0, norm, 1)
    if seen.any():  # what all words share, the frequent words around them, tells nothing
        unit[seen] -= unit[seen].mean(0)
    return (unit + 0.5 * index / math.sqrt(2 * SIGNS)).astype(np.float32)


FEATURES = DIMENSIONS + 4


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """The features of each text."""
    data, off = string_bytes(column)
    out = np.zeros((len(off) - 1, FEATURES), np.float32)
    unit = vectors / np.maximum(np.sqrt((vectors * vectors).sum(1, keepdims=True)), 1e-12)
    for lo, hi in doc_chunks(off, CHUNK):
        slot, edge = slots_of(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        n = np.diff(edge)
        some = np.flatnonzero(n > 0)
        if not len(some):
            continue
        starts = edge[:-1][some]
        mean = np.add.reduceat(vectors.take(slot, axis=0), starts, axis=0) / n[some, None]
        u = unit.take(slot, axis=0)
        near = np.zeros(len(slot), np.float32)
        near[:-1] = (u[1:] * u[:-1]).sum(1)
        near[edge[1:][some] - 1] = 0
        row = lo + some
        out[row, :DIMENSIONS] = mean
        out[row, DIMENSIONS] = np.sqrt((mean * mean).sum(1))
        out[row, DIMENSIONS + 1] = np.add.reduceat(near, starts) / np.maximum(n[some] - 1, 1)
        out[row, DIMENSIONS + 2] = np.log1p(n[some])
        again = np.zeros(len(slot), np.float32)
        again[:-1] = slot[1:] == slot[:-1]
        again[edge[1:][some] - 1] = 0
        out[row, DIMENSIONS + 3] = np.add.reduceat(again, starts) / np.maximum(n[some] - 1, 1)
    return out


class Network:
    """Standardised inputs, one tanh layer, a logistic output divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 80, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        held = np.zeros(len(y), bool)
        held[rng.permutation(len(y))[: len(y) // 5]] = True
        self.mean, self.spread = x[~held].mean(0), x[~held].std(0) + 1e-6
        fit = ((x - self.mean) / self.spread).astype(np.float64)
        w = [rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / math.sqrt(hidden), hidden), np.zeros(1)]
        m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        rows, t = np.flatnonzero(~held), 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(rows), max(1, len(rows) // 128)):
                a, h = fit[part], np.tanh(fit[part] @ w[0] + w[1])
                d = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - y[part]) / len(part)
                back = d[:, None] * w[2] * (1 - h * h)
                t += 1
                for k, g in enumerate((a.T @ back + 1e-4 * w[0], back.sum(0), h.T @ d + 1e-4 * w[2], d.sum(keepdims=True))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    w[k] = w[k] - 3e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.weights, self.temperature = w, 1.0
        z, target = self._logit(x[held]), y[held]
        if len(target):
            grid = np.exp(np.linspace(math.log(0.25), math.log(8), 80))
            loss = [np.logaddexp(0, -(2 * target - 1) * z / t).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def _logit(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.tanh(((x - self.mean) / self.spread) @ w[0] + w[1]) @ w[2] + w[3]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logit(x) / self.temperature, -700, 700)))


class Constant:
    def __init__(self, value: float) -> None:
        self.value = value

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def held_out(doc_id: str = "doc_id") -> Column:
    """The rows that are never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class QualityModel:
    """`use`: the features that the network gets, for comparisons."""

    def __init__(self, documents: DataFrame, labels: DataFrame, fit_rows: int = 20_000, use: slice = slice(None)) -> None:
        self.use = use
        ship(documents.sparkSession)
        texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.vectors = vectors = word_vectors(texts)
        known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").where(~held_out())
        # The sample is the rows with the smallest hashes: at most fit_rows ids, so it may be broadcast.
        sample = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = pooled(b.column("text"), vectors)
                yield pa.RecordBatch.from_pydict({"y": b.column("quality"), "h": b.column("h"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

        joined = texts.join(F.broadcast(sample), "doc_id").select("text", "quality", F.xxhash64("doc_id", "text").alias("h"))
        rows = joined.mapInArrow(features, "y int, h long, x binary").orderBy("h").limit(fit_rows).collect()  # bounded by fit_rows
        x = np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(len(rows), FEATURES)[:, use]
        y = np.array([float(r["y"] > 0) for r in rows])
        if not len(y):
            self.model: Network | Constant = Constant(0.5)
        elif y.min() == y.max() or len(y) < 20:
            self.model = Constant((y.sum() + 1) / (len(y) + 2))
        else:
            self.model = Network(x, y)

    def score(self, frame: DataFrame, name: str = "score") -> DataFrame:
        """The frame with a score for its text, in place of a column of that name; a narrow map."""
        vectors, model, use = self.vectors, self.model, self.use
        frame = frame.drop(name)
        marked = frame.withColumn("hm_quality_text", F.coalesce(F.col("text").cast("string"), F.lit("")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                score = model.predict(pooled(b.column(b.num_columns - 1), vectors)[:, use])
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score.astype(np.float64))], [*b.schema.names[:-1], name])
            trim()

        return marked.mapInArrow(run, StructType([*frame.schema.fields, StructField(name, DoubleType())]))


def score_documents(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document."""
    model = QualityModel(documents, labels)
    flat = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = model.score(flat)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
