"""Toxicity by a classifier chain.

Categories, in chain order: `abusive` (holds toxic language at all),
`repeated` (several times), `dense` (a high share of its words), and `toxic`
(the label itself).  Tokens are lower-cased letter runs, with their prefixes of
3 to 7 bytes as further features, as toxic stems come with many endings.

Fitting, on at most `fit_rows` labelled documents: counts of documents per
hashed feature and label pick the features that mark toxic text (log odds with
support); the three weak categories label a toxic document by how many and how
large a share of its tokens carry such features, as picked without the
document's own fold.  Each chain member is a linear
(logistic) model over the document's feature counts and the probabilities of
all members before it; in training those are out-of-fold predictions, each
fold's by a model that has not seen the fold (folds and feature selection by a
hash of the id), so later members learn with inputs as unsure as they will
meet.  Scoring is one narrow map with a model of fixed size.

Results in odd cases: null and empty texts have no features and get the
intercepts' probabilities; null ids are scored and never labelled; an id with
contradictory labels has the largest; without labels of both classes every
probability is 0 and nothing is toxic; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from harfmill.llm.bytesops import CHUNK, POLY, U64, doc_chunks, letter_runs, lower, mix, string_bytes, trim
from harfmill.llm.shared import ship

BITS = 18
PREFIXES = (3, 4, 5, 6, 7)
MEMBERS = ("abusive", "repeated", "dense", "toxic")
FOLDS = 5
KEPT = 4096


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each token (tokens x kinds; -1: the token has no such prefix), and the rows' ranges of tokens."""
    data = lower(data)
    start, end = letter_runs(data, off)
    prefix = POLY[0].prefix(data)
    kinds = [mix(POLY[0].span(prefix, start, end)) >> U64(64 - BITS)]
    for n in PREFIXES:
        h = mix(POLY[0].span(prefix, start, np.minimum(start + n, end)) + U64(n)) >> U64(64 - BITS)
        kinds.append(np.where(end - start > n, h.astype(np.int64), -1))
    return np.stack([k.astype(np.int64) for k in kinds], axis=1), np.searchsorted(start, off)


def _feature_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each feature, by fold and label, over this task's share of the bounded sample."""
    counts = np.zeros((FOLDS, 2, 1 << BITS), np.int32)
    for batch in batches:
        data, off = string_bytes(batch.column("text"))
        label, fold = batch.column("y").to_numpy(), batch.column("fold").to_numpy()
        for lo, hi in doc_chunks(off, CHUNK):
            feature, edge = tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            owner = np.repeat(np.arange(lo, hi), np.diff(edge))
            pair = np.unique((owner[:, None] * (1 << BITS) + feature)[feature >= 0])
            row, which = pair >> BITS, pair & ((1 << BITS) - 1)
            np.add.at(counts, (fold[row], label[row], which), 1)
    at = np.flatnonzero(counts)
    trim()
    yield pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int64()), "n": pa.array(counts.ravel()[at], pa.int64())})


class _Marks:
    """The chosen features: a slot for each, and whether it marks toxic text."""

    def __init__(self, counts: np.ndarray, documents: np.ndarray) -> None:
        clean, toxic = counts.astype(np.float64)
        odds = np.log((toxic + 0.5) / (documents[1] + 1)) - np.log((clean + 0.5) / (documents[0] + 1))
        support = toxic >= 3
        score = np.where(support, odds * np.sqrt(toxic), -np.inf)
        chosen = np.argsort(-score)[:KEPT]
        chosen = chosen[(odds[chosen] > 2) & support[chosen]]
        self.slot = np.full((1 << BITS) + 1, -1, np.int32)  # the last stands for "no such prefix"
        self.slot[chosen] = np.arange(len(chosen))
        self.strength = np.append(odds[chosen], 0)
        self.count = len(chosen)

    def document(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row: the strongest feature's hits (row, slot pairs), and the number of tokens."""
        feature, edge = tokens(data, off)
        slot = self.slot[feature]
        owner = np.repeat(np.arange(len(off) - 1), np.diff(edge))
        best = np.argmax(np.where(slot >= 0, self.strength[slot], -1), axis=1) if len(slot) else np.empty(0, np.int64)
        slot = slot[np.arange(len(slot)), best]
        hit = slot >= 0
        return owner[hit], slot[hit], np.diff(edge)


class _Logistic:
    """A linear model by full-batch accelerated gradient steps with an L2 penalty; x is dense and small, s sparse."""

    def __init__(self, rows: int, owner: np.ndarray, slot: np.ndarray, value: np.ndarray, size: int, dense: np.ndarray, y: np.ndarray, use: np.ndarray, rounds: int = 150, penalty: float = 3e-4) -> None:
        self.w, self.d, self.b = np.zeros(size), np.zeros(dense.shape[1]), 0.0
        keep = use[owner]
        owner, slot, value = owner[keep], slot[keep], value[keep]
        n = max(int(use.sum()), 1)
        m = [0.0, 0.0, 0.0]
        v = [0.0, 0.0, 0.0]
        weight = use / n
        for t in range(1, rounds + 1):
            z = np.bincount(owner, self.w[slot] * value, rows) + dense @ self.d + self.b
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
            grads = (np.bincount(slot, g[owner] * value, size) + penalty * self.w, dense.T @ g + penalty * self.d, g.sum())
            steps = []
            for k, x in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.999 * v[k] + 0.001 * x * x
                steps.append(0.1 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8))
            self.w, self.d, self.b = self.w - steps[0], self.d - steps[1], self.b - steps[2]

    def predict(self, rows: int, owner: np.ndarray, slot: np.ndarray, value: np.ndarray, dense: np.ndarray) -> np.ndarray:
        z = np.bincount(owner, self.w[slot] * value, rows) + dense @ self.d + self.b if len(owner) else dense @ self.d + self.b
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _summary(rows: int, owner: np.ndarray, slot: np.ndarray, n: np.ndarray, strength: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse values (row, slot, log count) and dense ones: log hits, hits' strength, share of tokens."""
    pair, count = np.unique(owner * (KEPT + 1) + slot, return_counts=True) if len(owner) else (np.empty(0, np.int64), np.empty(0, np.int64))
    hits = np.bincount(owner, minlength=rows).astype(np.float64)
    power = np.bincount(owner, strength[slot], rows) if len(owner) else np.zeros(rows)
    dense = np.stack([np.log1p(hits), np.log1p(power), 20 * hits / np.maximum(n, 20)], axis=1)
    return pair // (KEPT + 1), pair % (KEPT + 1), np.log1p(count), dense


class ToxicityModel:
    """`chain` false: the last member alone, for comparison."""

    def __init__(self, documents: DataFrame, labels: DataFrame, fit_rows: int = 20_000, label: str = "toxic", chain: bool = True) -> None:
        self.names = MEMBERS if chain else MEMBERS[-1:]
        spark = documents.sparkSession
        ship(spark)
        texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(label) > 0).cast("int").alias("y")).where("doc_id is not null and y is not null")
        # The rows with the smallest hashes: at most fit_rows ids, so they may be broadcast.
        sample = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
        joined = texts.join(F.broadcast(sample), "doc_id").select("text", "y", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(FOLDS)).cast("int").alias("fold"), F.xxhash64("doc_id", "text").alias("h"))
        cells = joined.select("text", "y", "fold").mapInArrow(_feature_documents, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        counts = np.zeros(FOLDS * 2 * (1 << BITS), np.int64)
        found = cells.where("n > 0").toArrow()  # at most FOLDS x 2 x 2**BITS cells, whatever the input
        counts[found.column("cell").to_numpy()] = found.column("n").to_numpy()
        counts = counts.reshape(FOLDS, 2, -1)
        sizes = np.zeros((FOLDS, 2), np.int64)
        for fold, y, n in joined.groupBy("fold", "y").count().collect():
            sizes[fold, y] = n
        self.members: list[_Logistic] = []
        self.marks = _Marks(counts.sum(0), sizes.sum(0)) if sizes.sum(0).min() > 0 else None
        if self.marks is None or not self.marks.count:
            self.marks = None
            return
        self._fit(joined, counts, sizes, fit_rows)

    def _fit(self, joined: DataFrame, counts: np.ndarray, sizes: np.ndarray, fit_rows: int) -> None:
        # For the rows of a fold the marks come from the other folds; the final models use all.
        by_fold = [_Marks(counts.sum(0) - counts[f], sizes.sum(0) - sizes[f]) for f in range(FOLDS)]
        sets = [self.marks, *by_fold]

        def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, off = string_bytes(batch.column("text"))
                out = []
                for k, marks in enumerate(sets):
                    owners, slots, sizes_ = [], [], []
                    for lo, hi in doc_chunks(off, CHUNK):
                        o, s, n = marks.document(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                        owners.append(o + lo)
                        slots.append(s)
                        sizes_.append(n)
                    owner, slot = np.concatenate(owners or [[]]).astype(np.int64), np.concatenate(slots or [[]]).astype(np.int32)
                    n = np.concatenate(sizes_ or [[]]).astype(np.int64)
                    edge = np.searchsorted(owner, np.arange(batch.num_rows + 1))
                    out.append([slot[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)])
                columns = {"y": batch.column("y"), "fold": batch.column("fold"), "h": batch.column("h"), "n": pa.array(n, pa.int64())}
                yield pa.RecordBatch.from_pydict(columns | {f"s{k}": pa.array(o, pa.binary()) for k, o in enumerate(out)})
            trim()

        schema = "y int, fold int, h long, n long, " + ", ".join(f"s{k} binary" for k in range(len(sets)))
        rows = joined.mapInArrow(hits, schema).orderBy("h").limit(fit_rows).toArrow()  # bounded by fit_rows
        y, fold, n = (rows.column(c).to_numpy() for c in ("y", "fold", "n"))
        count = len(y)

        def view(k: int) -> tuple:
            slots = [np.frombuffer(b, np.int32) for b in rows.column(f"s{k}").to_pylist()]
            owner = np.repeat(np.arange(count), np.fromiter(map(len, slots), np.int64, count))
            slot = np.concatenate(slots).astype(np.int64)
            return *_summary(count, owner, slot, n, sets[k].strength), np.bincount(owner, minlength=count)

        views = [view(k) for k in range(len(sets))]
        amount = np.zeros(count, np.int64)
        for f in range(FOLDS):
            amount[fold == f] = views[1 + f][4][fold == f]
        targets = [(y > 0) & (amount >= 1), (y > 0) & (amount >= 4), (y > 0) & (amount >= 0.02 * np.maximum(n, 1)) & (amount >= 1), y > 0][-len(self.names) :]
        held_out = np.zeros((count, 0))
        for target in targets:
            fresh = np.zeros(count)
            for f in range(FOLDS):
                owner, slot, value, dense, _ = views[1 + f]
                model = _Logistic(count, owner, slot, value, sets[1 + f].count + 1, np.concatenate([dense, held_out], axis=1), target.astype(float), fold != f)
                p = model.predict(count, owner, slot, value, np.concatenate([dense, held_out], axis=1))
                fresh[fold == f] = p[fold == f]
            owner, slot, value, dense, _ = views[0]
            self.members.append(_Logistic(count, owner, slot, value, self.marks.count + 1, np.concatenate([dense, held_out], axis=1), target.astype(float), np.ones(count, bool)))
            held_out = np.concatenate([held_out, fresh[:, None]], axis=1)

    def probabilities(self, column: pa.Array) -> np.ndarray:
        """Rows x members."""
        data, off = string_bytes(column)
        out = np.zeros((len(off) - 1, len(self.names)))
        if self.marks is None:
            return out
        for lo, hi in doc_chunks(off, CHUNK):
            owner, slot, n = self.marks.document(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            rows = hi - lo
            owner, slot, value, dense = _summary(rows, owner, slot.astype(np.int64), n, self.marks.strength)
            for k, model in enumerate(self.members):
                out[lo:hi, k] = model.predict(rows, owner, slot, value, np.concatenate([dense, out[lo:hi, :k]], axis=1))
        return out

    def score(self, frame: DataFrame) -> DataFrame:
        """The frame with p_<member> for each member of the chain, in place of columns of these names; a narrow map."""
        model = self
        frame = frame.drop(*[f"p_{m}" for m in self.names])
        marked = frame.withColumn("hm_toxic_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
        names = [f"p_{m}" for m in self.names]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = model.probabilities(b.column(b.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(p[:, k].copy()) for k in range(len(names))]], [*b.schema.names[:-1], *names])
            trim()

        schema = StructType([*frame.schema.fields, *[StructField(n, DoubleType()) for n in names]])
        return marked.mapInArrow(run, schema)


def predict_toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, p_abusive, p_repeated, p_dense, p_toxic, toxic) for each document."""
    model = ToxicityModel(documents, labels)
    flat = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return model.score(flat).drop("text").withColumn("toxic", F.col("p_toxic") >= threshold)
