"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from a bounded, hash-chosen sample of documents with a language that
are not held out: rows are counted for each language first, languages of few rows
are learned from all of them, and the others from equal shares of the rest. The
prior is of all rows, not of the sample. Executors count and turn the counts of a
language into its log-probabilities, so the driver receives one column of 32-bit
numbers for each language. The matrix (buckets x languages) goes to the executors,
where a batch of texts is a sparse matrix of counts: each row has its distinct buckets
only, and is multiplied with those rows of the log-probabilities, in slices of bounded size.

What every operator here does with odd rows: null, empty and letterless texts are
``und`` with 0 and teach nothing; a null id is not held out; rows are judged each for
itself, so repeated rows repeat their results; of languages that are equally likely
the first by name wins; an empty table gives an empty one; of other columns
``language_predictions`` and ``train`` read none, and ``with_language`` hands all of
them on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._ngrams import HELD_OUT, blocks, fold
from ._shared import keep_alone, text_slices

LENGTHS, BITS = (1, 2, 3, 4), 16
#: Documents that counting may use, and languages that a model may hold; each has 256 KB of the matrix.
SAMPLE, MOST_LANGUAGES = 20_000, 256
SMOOTHING = 0.5
UNKNOWN = "und"
#: Numbers of the matrix that one slice of a batch gathers.
GATHERED = 1 << 20


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def counted(text: str) -> np.ndarray:
    """How often a whole text has each bucket."""
    total = np.zeros(1 << BITS, np.int64)
    for block in blocks(f" {text.lower()} ".encode("utf-8", "replace"), LENGTHS, BITS):
        total += np.bincount(block, minlength=1 << BITS)
    return total


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Of the buckets in one language, smoothed."""
    smooth = counts.astype(np.float64) + SMOOTHING
    return np.log(smooth / smooth.sum())


class Model:
    """Log-probabilities of buckets (rows) and languages (columns), and the languages' documents."""

    def __init__(self, languages: list[str], columns: list[np.ndarray], documents: np.ndarray):
        self.languages = languages
        if languages:
            self.matrix = np.stack([c.astype(np.float32) for c in columns], axis=1)
            self.prior = np.log(documents / documents.sum())

    def likelihoods(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each text in each language, and the number of n-grams of each text."""
        summed, sizes = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        step = max(1, GATHERED // len(self.languages))
        for i, t in enumerate(texts):
            count = counted(t)
            sizes[i] = count.sum()
            bucket = np.flatnonzero(count)
            for lo in range(0, len(bucket), step):
                own = bucket[lo : lo + step]
                summed[i] += count[own] @ self.matrix[own].astype(np.float64)
        return summed, sizes

    def explains(self, texts: list[str | None]) -> list[bool]:
        """Whether some language makes a text likelier than n-grams drawn evenly from all buckets do.

        Never of texts without a letter, nor when no language was learned.
        """
        out = [False] * len(texts)
        own = [i for i, t in enumerate(texts) if self.languages and has_letter(t)]
        if own:
            likelihoods, sizes = self.likelihoods([texts[i] for i in own])
            for i, x in zip(own, (likelihoods.max(1) > -sizes * np.log(1 << BITS)).tolist(), strict=True):
                out[i] = x
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and probability of each text; UNKNOWN with 0 where there is no letter or nothing was learned."""
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        own = [i for i, t in enumerate(texts) if self.languages and has_letter(t)]
        if own:
            summed = self.likelihoods([texts[i] for i in own])[0] + self.prior
            best = summed.argmax(1)
            p = 1 / np.exp(summed - summed.max(1, keepdims=True)).sum(1)
            for i, b, x in zip(own, best.tolist(), p.tolist(), strict=True):
                lang[i], score[i] = self.languages[b], x
        return lang, score


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep_alone("language")
    counts: dict[str, np.ndarray] = {}
    for part, texts in text_slices(batches):
        for lang, text in zip(part.column("lang").to_pylist(), texts, strict=True):
            if lang not in counts:
                counts[lang] = np.zeros(1 << BITS, np.int64)
            counts[lang] += counted(text)
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c.tobytes() for c in counts.values()], pa.binary())], ["lang", "counts"])


def _language_column(key, rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, np.int64) for c in rows["counts"])
    return pd.DataFrame({"lang": [key[0]], "column": [log_probabilities(total).astype(np.float32).tobytes()]})


def share(rows: list[int], sample: int) -> float:
    """The most rows that a language may give so that all together give ``sample`` at most; no bound if all fit."""
    left = sample
    for k, n in enumerate(sorted(rows)):
        if n * (len(rows) - k) > left:
            return left / (len(rows) - k)
        left -= n
    return float("inf")


def train(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from about ``sample`` documents at most that have a language and are not held out.

    Documents without a letter teach nothing. Null ids are not held out; only text,
    lang and the id's fold are read. The sample is drawn by a hash of id and text, so
    rows that repeat both come in together; counting holds no rows, so they cost time only.
    A grouped count is run first, when this is called, to set the languages' shares.
    """
    usable = documents.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    n = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if not n:
        return Model([], [], np.zeros(0))
    if len(n) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    steps, most = 1 << 30, share(list(n.values()), sample)
    chosen = usable
    if limits := [F.lit(x) for lang, rows in n.items() if rows > most for x in (lang, int(steps * most / rows))]:
        limit = F.coalesce(F.try_element_at(F.create_map(*limits), F.col("lang")), F.lit(steps))
        chosen = usable.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(23)), F.lit(steps)) < limit)
    # a fixed number of tasks counts the sample, so a language has at most as many rows of counts
    rows = chosen.select("lang", "text").repartition(12).mapInArrow(_count_batches, "lang string, counts binary")
    got = sorted(rows.groupBy("lang").applyInPandas(lambda key, own: _language_column(key, own), "lang string, column binary").collect(), key=lambda r: r["lang"])
    return Model([r["lang"] for r in got], [np.frombuffer(r["column"], np.float32) for r in got], np.array([n[r["lang"]] for r in got], np.float64))


class _Predict:
    def __init__(self, model: Model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_alone("language")
        for part, texts in text_slices(batches, most=1_000_000):
            lang, score = self.model.predict(texts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def language_predictions(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every whole text; odd rows as the module says."""
    rows = documents.select("doc_id", "text", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"))
    return rows.mapInArrow(_Predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


class _Keep:
    def __init__(self, model: Model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_alone("language")
        for part, texts in text_slices(batches, most=1_000_000):
            yield part.filter(pa.array(self.model.explains(texts), pa.bool_()))


def with_language(documents: DataFrame, model: Model) -> DataFrame:
    """The same columns, without documents that no learned language explains (``Model.explains``).

    Texts without a letter, gibberish and unknown scripts go. An unlearned language that shares
    many n-grams with a learned one mostly stays, and when no language was learned nothing stays.
    """
    return documents.mapInArrow(_Keep(model), documents.schema)
