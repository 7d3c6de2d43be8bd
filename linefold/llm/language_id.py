"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: 1- to 3-grams of the lower-cased characters of a whole text, hashed into DIMENSIONS buckets,
counts times inverse document frequency, scaled to length one. Document frequencies come from all learning
texts: each task counts its own into one array, and the arrays are added by bucket. Weights are fitted on a
bounded sample (FIT_ROWS learning rows, dealt evenly over the languages by a hash of the text) with
follow-the-regularised-leader under an elastic-net penalty; a part of the sample is left out of the fit and
sets the temperature that calibrates the probabilities. Every language is learned: a weight's slot is its bucket
times the number of languages plus its language, modulo SLOTS, so with more than SLOTS / DIMENSIONS languages
weights share slots and the model grows no further.

Rows with a null language or text teach nothing. A text that is null or has no letter gets `und` with score
0, as every text does if there is nothing to learn from; with a single language every text with a letter
gets it with score 1. A letter is a character of a Unicode letter category: `½` and `Ⅷ` are none. Between languages
of equal probability the first by value is taken. Texts are read whole, however long; repeated rows get equal
answers. Other columns pass; columns of the names made here are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linefold.llm.common import add_columns

DIMENSIONS = 1 << 15
ORDERS = (1, 2, 3)
#: Weights of a model at most.
SLOTS = 1 << 23
#: Learning rows that are aimed at; twice as many come to the driver at most, or two of each language.
FIT_ROWS = 3_000
EPOCHS = 3
#: Step size and offset of the per-coordinate rates, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
UNKNOWN = "und"

COLUMNS = {"lang_pred": "string", "score": "double"}


def buckets(text: str) -> np.ndarray:
    """Bucket of every n-gram of a text."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), dtype=np.uint32)
    out = []
    for n in ORDERS:
        key = np.full(max(0, len(c) - n + 1), n, dtype=np.uint32)
        for k in range(n):
            key = (key ^ c[k : k + len(key)]) * np.uint32(0x9E3779B1)
            key ^= key >> np.uint32(15)
        out.append(key & np.uint32(DIMENSIONS - 1))
    return np.concatenate(out)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray | None = None  # by slot; the bias is bucket DIMENSIONS
    temperature: float = 1.0

    @property
    def size(self) -> int:
        return min((DIMENSIONS + 1) * len(self.languages), SLOTS)

    def slots(self, at: np.ndarray) -> np.ndarray:
        """Slots of the weights of some buckets: a row for each bucket and the bias, a column for each language."""
        k = len(self.languages)
        return (np.append(at, DIMENSIONS)[:, None] * k + np.arange(k)) % self.size

    def logits(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.append(values, 1.0) @ self.weights[self.slots(at)]

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        counts = np.bincount(buckets(text), minlength=DIMENSIONS)
        at = np.flatnonzero(counts)
        values = counts[at] * self.idf[at]
        norm = np.sqrt(values @ values)
        return at, values / norm if norm else values

    def probabilities(self, text: str) -> np.ndarray:
        at, values = self.features(text)
        return softmax(self.logits(at, values) / self.temperature)

    def predict(self, texts: list[str | None]) -> list[list]:
        names, scores = [], []
        for text in texts:
            if not self.languages or not has_letter(text):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            p = self.probabilities(text)
            best = int(np.argmax(p))
            names.append(self.languages[best])
            scores.append(float(p[best]))
        return [names, scores]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts hold each bucket, and the number of texts, over all rows of one text column."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(DIMENSIONS + 1, dtype=np.int64), 0
        for frame in frames:
            for text in frame.iloc[:, 0]:
                seen = np.bincount(buckets(text), minlength=DIMENSIONS)
                total[:DIMENSIONS] += seen > 0
                n += 1
        total[DIMENSIONS] = n
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    rows = texts.mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(DIMENSIONS + 1, dtype=np.int64)
    out[rows.bucket.to_numpy()] = rows.n.to_numpy()
    return out[:DIMENSIONS], int(out[DIMENSIONS])


def leader(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> None:
    """Follow-the-regularised-leader, one row after another; sets the weights.

    z gathers gradients less the weights' drift, n squared gradients; a weight is zero while |z| <= L1.
    """
    z, n = np.zeros(model.size), np.zeros(model.size)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(epochs):
        for at, values, label in rows:
            at, values = model.slots(at), np.append(values, 1.0)
            w = weights(at)
            error = softmax(values @ w)
            error[label] -= 1
            g = np.outer(values, error)
            after = n[at] + g * g
            z[at] += g - (np.sqrt(after) - np.sqrt(n[at])) / ALPHA * w
            n[at] = after
    model.weights = weights(slice(None))


def calibrate(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """The temperature of least log loss on rows that the fit hasn't seen."""
    if not rows:
        return
    logits = np.array([model.logits(at, v) for at, v, _ in rows])
    labels = np.array([label for _, _, label in rows])

    def loss(t: float) -> float:
        return -float(np.mean(np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12)))

    model.temperature = min(np.geomspace(0.2, 5.0, 80), key=loss)


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang") -> Model:
    """A model from the rows where `learn` holds."""
    rows = docs.select(F.col(text).cast("string").alias("body"), F.col(lang).cast("string").alias("lang"), learn.alias("learn"))
    rows = rows.where("learn and body is not null and lang is not null").select("body", "lang")
    per = rows.groupBy("lang").count().orderBy("lang").collect()  # a row for each language
    languages = sorted(r.lang for r in per)
    frequencies, n = document_frequencies(rows.select("body"))
    model = Model(languages, np.log((1 + n) / (1 + frequencies)) + 1)
    model.weights = np.zeros(model.size)
    if len(languages) < 2:
        return model
    each = max(1, FIT_ROWS // len(languages))
    # An even share of each language: rows whose hash falls below its share of all values.
    shares = [(r.lang, float(min(1.0, each / r["count"]))) for r in per]
    shares = docs.sparkSession.createDataFrame(shares, "lang string, share double")
    picked = F.pmod(F.xxhash64("body", F.lit(3)), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    # Equal texts share a hash: each is taken once, so that a group of copies can't fill the sample.
    sample = rows.join(shares, "lang").where(picked).groupBy(F.xxhash64("body").alias("order"), "lang").agg(F.first("body").alias("body"))
    sample = sample.orderBy("order").limit(2 * max(FIT_ROWS, len(languages))).collect()
    number = {name: i for i, name in enumerate(languages)}
    fit = [(*model.features(r.body), number[r.lang]) for r in sample if has_letter(r.body)]
    leader(model, [r for i, r in enumerate(fit) if i % 5])
    calibrate(model, fit[::5])
    return model


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score. The model goes out once per executor; its size is fixed."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return add_columns(docs, text, COLUMNS, lambda: shared.value.predict)
