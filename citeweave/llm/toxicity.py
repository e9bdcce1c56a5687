"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Training takes a bounded, hash-chosen sample of labelled documents that are not held
out. Of every hashed n-gram the share of toxic and of other documents that hold it
gives a log-count ratio. N-grams that are rare or whose ratio says little are set
aside; the others, scaled by their ratio, are the features of a logistic regression.
All texts, in training and scoring, are read whole.

Counting and fitting run on executors: tasks count n-grams by label, the counts are
added up by slices of the buckets, and one task fits the weights on rows that hold
chosen features only. The driver receives the buckets that could be features, at most
16 bytes for each of ``2**BITS``, chooses among them, and receives the weights.

What every operator here does with odd rows: null and empty texts have no n-grams and
get the score of no evidence; a null id is not held out; rows are scored each for
itself, so repeated rows repeat their scores; an empty table gives an empty one; equal
scores need no order, for nothing is ranked; of other columns ``toxicity_scores`` and
``train`` read none, and ``without_toxic`` hands all of them on, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._ngrams import HELD_OUT, blocks, fold
from ._shared import discard, keep_alone, materialize, text_slices

LENGTHS, BITS = (5, 6, 8), 20
#: Documents of each label that training may use; more than that are thinned by a hash of their id.
SAMPLE = 2500
#: Features of a model: of more, those with the largest ratio times the root of their documents.
FEATURES = 1 << 16
#: The least documents of the sample that hold an n-gram, and the least size of its log ratio, for a feature.
LEAST_DOCUMENTS, LEAST_RATIO = 4, 0.8
RIDGE, STEPS = 2e-4, 300
#: Entries of the training rows that one step looks at together.
ENTRIES = 1 << 19
#: Tasks that count n-grams of the sample, and slices of the buckets that are added up each for itself.
COUNTERS, SLICES = 12, 16
SLICE = (1 << BITS) // SLICES
THRESHOLD = 0.3
_OTHER = re.compile(r"[\W_]+")


def _gram_blocks(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of a whole text's n-grams, repeats kept; words stand between single spaces."""
    if text:
        yield from blocks(f" {_OTHER.sub(' ', text.lower()).strip()} ".encode("utf-8", "replace"), LENGTHS, BITS)


def features(text: str | None) -> np.ndarray:
    """Distinct buckets of a whole text, ascending."""
    found = [np.unique(b) for b in _gram_blocks(text)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


class Model:
    """Weights of some buckets and a bias; scores are probabilities."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, bias: float):
        self.buckets, self.weights, self.bias = buckets.astype(np.uint32), weights.astype(np.float32), float(bias)
        self._table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_table": None}

    def table(self) -> np.ndarray:
        """Weights by bucket; made where the model is used, so that tasks are sent the short form."""
        if self._table is None:
            self._table = np.zeros(1 << BITS, np.float32)
            self._table[self.buckets] = self.weights
        return self._table

    def score(self, text: str | None) -> float:
        weights, found = self.table(), []
        for block in _gram_blocks(text):
            found.append(np.unique(block[weights[block] != 0]))
        z = self.bias + (float(weights[np.unique(np.concatenate(found))].sum(dtype=np.float64)) if found else 0.0)
        return 1 / (1 + np.exp(-z)) if z > -700 else 0.0


def log_ratios(count: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """Log of the share of toxic documents that hold an n-gram over the share of others; ``count`` has a row for each label."""
    return np.log((count[1] + 1) / (documents[1] + 2)) - np.log((count[0] + 1) / (documents[0] + 2))


def useful(count: np.ndarray, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets that could be features, ascending, their ratios, and what they are worth."""
    ratio = log_ratios(count, documents)
    total = count.sum(0)
    kept = np.flatnonzero((total >= LEAST_DOCUMENTS) & (np.abs(ratio) >= LEAST_RATIO))
    return kept, ratio[kept], np.abs(ratio[kept]) * np.sqrt(total[kept])


def best_features(buckets: np.ndarray, ratio: np.ndarray, worth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``FEATURES`` most worthy buckets, ascending, ties to the smaller, and their ratios."""
    first = np.lexsort((buckets, -worth))[:FEATURES]
    first = first[np.argsort(buckets[first])]
    return buckets[first], ratio[first]


def fit(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights of the scaled features and the bias; ``rows`` hold positions of features.

    ``prior`` is the share of label 1 outside the sample. Full-batch gradient descent with
    Adam's step sizes: deterministic, no tuning by size. A step goes over the entries
    piece by piece, so it needs little memory beside them.
    """
    labels = np.asarray(labels, np.float64)
    share = labels.mean()
    balance = np.where(labels == 1, prior / share, (1 - prior) / (1 - share)) / len(labels)
    lengths = np.array([len(x) for x in rows])
    column = np.concatenate(rows) if rows else np.zeros(0, np.uint16)
    ends = np.cumsum(lengths)
    # pieces of whole rows
    cuts, last = [0], 0
    for i, end in enumerate(ends):
        if end - last >= ENTRIES or i == len(rows) - 1:
            cuts.append(i + 1)
            last = end
    w, b = np.zeros(len(scale)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, STEPS + 1):
        scaled, g, gb = (w * scale).astype(np.float32), np.zeros(len(scale)), 0.0
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            own = column[ends[lo] - lengths[lo] : ends[hi - 1]]
            owner = np.repeat(np.arange(hi - lo, dtype=np.int32), lengths[lo:hi])
            z = np.bincount(owner, scaled[own], hi - lo) + b
            error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels[lo:hi]) * balance[lo:hi]
            g += np.bincount(own, error[owner], len(scale))
            gb += error.sum()
        g = g * scale + RIDGE * w
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix, fix2 = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.02 * (m / fix) / (np.sqrt(v / fix2) + 1e-8)
        b -= 0.02 * (mb / fix) / (np.sqrt(vb / fix2) + 1e-8)
    return w * scale, b


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label by bucket, as one row for each slice of the buckets."""
    keep_alone("toxicity")
    count, any_text = np.zeros((2, 1 << BITS), np.uint32), False
    for part, texts in text_slices(batches):
        any_text = True
        for label, text in zip(part.column("toxic").to_pylist(), texts, strict=True):
            count[label, features(text)] += 1
    if any_text:
        for k in range(SLICES):
            own = np.ascontiguousarray(count[:, k * SLICE : (k + 1) * SLICE])
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["slice", "count"])


class _Choose:
    """The features among one slice of the buckets."""

    def __init__(self, documents: np.ndarray):
        self.documents = documents

    def __call__(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        count = sum(np.frombuffer(c, np.uint32).reshape(2, -1).astype(np.int64) for c in rows["count"])
        bucket, ratio, worth = useful(count, self.documents)
        return pd.DataFrame({"bucket": [(bucket + int(key[0]) * SLICE).astype(np.uint32).tobytes()], "ratio": [ratio.tobytes()], "worth": [worth.astype(np.float32).tobytes()]})


class _Restrict:
    """Positions of a text's features among the chosen ones."""

    def __init__(self, buckets: np.ndarray):
        self.buckets = buckets

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_alone("toxicity")
        place = np.full(1 << BITS, -1, np.int32)
        place[self.buckets] = np.arange(len(self.buckets))
        for part, texts in text_slices(batches):
            at = [place[features(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array([a[a >= 0].astype(np.uint16).tobytes() for a in at], pa.binary())], ["toxic", "at"])


class _Fit:
    def __init__(self, scale: np.ndarray, prior: float):
        self.scale, self.prior = scale, prior

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, bytes]] = []
        for batch in batches:
            rows += zip(batch.column("toxic").to_pylist(), batch.column("at").to_pylist(), strict=True)
        rows.sort()
        weights, bias = fit([np.frombuffer(at, np.uint16) for _, at in rows], np.array([t for t, _ in rows]), self.scale, self.prior)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["weights", "bias"])


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most about ``sample`` documents of each label, none of them held out.

    Rows with a null id or a label other than 0 and 1 are not used. An id counts once
    for a label; if several rows have it, one of their texts teaches, so the sample is
    bounded also where an id is very frequent. Without documents of both labels the
    model knows only their share.
    """
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    known = usable.select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    prior = n.get(1, 0) / total if total else 0.0
    unknown = Model(np.zeros(0), np.zeros(0), np.log((prior + 1e-6) / (1 - prior + 1e-6)))
    if len(n) < 2:
        return unknown
    steps = 1 << 30
    limit = F.lit(0)
    for label, rows in n.items():
        limit = F.when(F.col("toxic") == label, F.lit(min(steps, int(steps * sample / rows)))).otherwise(limit)
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(steps)) < limit)
    # at most about 2 * sample small rows, so they may go to all executors
    found = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    texts = materialize(one.select("toxic", "text"), "toxicity-sample")
    taught = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(taught) < 2:
        discard(texts)
        return unknown
    dealt = texts.repartition(COUNTERS)
    choose = _Choose(np.array([taught[0], taught[1]]))
    counts = dealt.mapInArrow(_count_batches, "slice int, count binary")
    found = counts.groupBy("slice").applyInPandas(lambda key, own: choose(key, own), "bucket binary, ratio binary, worth binary").collect()
    joined = lambda c, kind: np.concatenate([np.frombuffer(bytes(r[c]), kind) for r in found])
    buckets, ratio = best_features(joined("bucket", np.uint32), joined("ratio", np.float64), joined("worth", np.float32))
    held = dealt.mapInArrow(_Restrict(buckets), "toxic int, at binary").repartition(1)
    got = held.mapInArrow(_Fit(ratio, prior), "weights binary, bias double").collect()[0]
    discard(texts)
    return Model(buckets, np.frombuffer(bytes(got["weights"]), np.float32), got["bias"])


class _Score:
    def __init__(self, model: Model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_alone("toxicity")
        for part, texts in text_slices(batches):
            scores = np.array([self.model.score(t) for t in texts])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32), pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )


def toxicity_scores(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every whole text; odd rows as the module says."""
    rows = documents.select("doc_id", "text", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"))
    return rows.mapInArrow(_Score(model), "doc_id long, held_out boolean, score double, predicted int")


class _Keep:
    def __init__(self, model: Model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_alone("toxicity")
        for part, texts in text_slices(batches):
            yield part.filter(pa.array([self.model.score(t) < THRESHOLD for t in texts], pa.bool_()))


def without_toxic(documents: DataFrame, model: Model) -> DataFrame:
    """The same columns, without the documents that the model rejects."""
    return documents.mapInArrow(_Keep(model), documents.schema)
