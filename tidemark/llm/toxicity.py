"""Toxicity: FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features of a text are its distinct words, word pairs and pairs that skip one
word, hashed to ``2**bits`` coordinates. Training is the per-coordinate
FTRL-proximal rule with L1, so most weights are exactly zero and the model that
is broadcast holds only the others, at most ``2**bits`` of them. The last fifth of
the sample doesn't train: it shifts the intercept so that 0.5 parts its classes best.

The model is fitted on a bounded sample of labelled rows: ``Fit.max_rows`` rows
at most (in expectation), chosen by a hash of the id. The one training task
holds only that sample. Scoring covers every row and whole texts.

Edge cases: null and empty texts have no features and score by the intercept; very
long texts are scored whole; equal texts (repeated rows) score alike; rows with a null label or id do not train; repeated labels of an id count once
(the largest); without labelled rows (or with one class only) there is no
evidence: every score is 0; extra columns are kept.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, owns


@dataclass(frozen=True)
class Fit:
    bits: int = 22
    max_rows: int = 12_000
    passes: int = 6
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0
    #: A clean text called toxic costs as many toxic texts missed (as shares of their class).
    false_alarm: float = 5.0


_EDGES = ".,;:!?\"'()[]{}<>#*$%&|~`_-+=/\\…«»“”„‘’¿¡"
_WORDS: dict[str, int] = {}
owns("toxicity", _WORDS.clear)


def _word_hash(chunk: str) -> int:
    """crc32 of the chunk in lower case without punctuation at its ends; 0 for none."""
    h = zlib.crc32(w.encode()) or 1 if (w := chunk.lower().strip(_EDGES)) else 0
    if len(_WORDS) >= 200_000:
        _WORDS.clear()
    if len(chunk) <= 48:
        _WORDS[chunk] = h
    return h


def features(text: str | None, bits: int) -> np.ndarray:
    """Distinct coordinates of a text, ascending."""
    if not text:
        return np.empty(0, np.int64)
    known = _WORDS.get
    h = np.fromiter([known(c) or _word_hash(c) for c in text.split()], np.uint64)
    h = h[h > 0]
    mix = np.uint64(0x9E3779B97F4A7C15)
    parts = [h * mix]
    if len(h) > 1:
        parts.append((h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:] + np.uint64(1)) * mix)
    if len(h) > 2:
        parts.append((h[:-2] * np.uint64(0x165667B19E3779F9) + h[2:] + np.uint64(2)) * mix)
    return np.unique((np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64))


class Ftrl:
    """State of the FTRL-proximal rule; coordinate ``2**bits`` is the intercept."""

    def __init__(self, fit: Fit):
        self.fit = fit
        self.z = np.zeros((1 << fit.bits) + 1)
        self.n = np.zeros((1 << fit.bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        f, z = self.fit, self.z[at]
        shrunk = np.sign(z) * f.l1 - z
        l1_free = at == 1 << f.bits  # the intercept is not shrunk to zero
        shrunk[l1_free] = -z[l1_free]
        w = shrunk / ((f.beta + np.sqrt(self.n[at])) / f.alpha + f.l2)
        w[(np.abs(z) <= f.l1) & ~l1_free] = 0.0
        return w

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, 1 << self.fit.bits)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.fit.alpha * w
        self.n[at] = n + g * g

    def settle(self, docs: list[np.ndarray], labels: np.ndarray) -> float:
        """What to add to the intercept so that 0.5 parts the sample's classes best."""
        intercept = self.weights(np.array([1 << self.fit.bits]))[0]
        raw = np.array([self.weights(x).sum() + intercept for x in docs])
        bad, good = labels.sum(), len(labels) - labels.sum()
        if not bad or not good:
            return 0.0
        order = np.argsort(raw, kind="stable")
        raw, y = raw[order], labels[order]
        gain = (bad - np.cumsum(y)) / bad - self.fit.false_alarm * (good - np.cumsum(1 - y)) / good
        gain[:-1][raw[:-1] == raw[1:]] = -np.inf  # no border between equals
        best = int(np.argmax(gain))
        return -(raw[best] + raw[best + 1]) / 2 if best + 1 < len(raw) else 0.0

    def compact(self) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates and values of the weights that are not zero."""
        at = np.flatnonzero(self.n)  # coordinates that were seen
        w = self.weights(at)
        return at[w != 0].astype(np.int64), w[w != 0]


def train_rows(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), key: str = "doc_id", text: str = "text", label: str = "toxic", allowed=None) -> DataFrame:
    """``text, label, turn``: the bounded sample, in an order by hash."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    if allowed is not None:
        known = known.where(allowed)
    known = known.groupBy(key).agg(F.max(label).cast("int").alias("label"))
    total = known.count()
    rate = min(1.0, fit.max_rows / total) if total else 1.0
    sample = known.where(F.pmod(F.xxhash64(key), F.lit(1_000_003)) < int(rate * 1_000_003)).select(F.col(key).alias("__key"), "label")
    # The sample's ids are a bounded table.
    own = docs.select(F.col(key).alias("__id"), F.col(text).alias("text"))
    return own.join(F.broadcast(sample), F.col("__id") == F.col("__key")).select("text", "label", F.xxhash64("__id", "text").alias("turn"))


def train(rows: DataFrame, fit: Fit = Fit()) -> tuple[np.ndarray, np.ndarray]:
    """Fits in one task over the bounded sample and returns the compact weights."""

    def run(batches):
        claim("toxicity")
        docs, labels = [], []
        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                docs.append(features(t, fit.bits).astype(np.int32))
                labels.append(y)
        if len(set(labels)) < 2:
            return
        model, n = Ftrl(fit), len(docs) - len(docs) // 5
        for _ in range(fit.passes):
            for x, y in zip(docs[:n], labels[:n], strict=True):
                model.learn(x, y)
        at, w = model.compact()
        at, w = np.append(at, 1 << fit.bits), np.append(w, model.settle(docs[n:], np.array(labels[n:])))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w)], names=["at", "w"])

    found = rows.repartition(1).sortWithinPartitions("turn", "label", "text").select("text", "label").mapInArrow(run, "at long, w double").toArrow()
    return found.column("at").to_numpy(), found.column("w").to_numpy()


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], fit: Fit = Fit(), text: str = "text", out: str = "score") -> DataFrame:
    """Adds ``out``, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast((weights[0].astype(np.int32), weights[1]))
    table: list[np.ndarray] = []  # one for each task

    @F.arrow_udf("double")
    def probability(col: pa.Array) -> pa.Array:
        claim("toxicity")
        at, w = shared.value
        if not len(at):
            return pa.array(np.zeros(len(col)))
        if not table:
            table.append(np.zeros((1 << fit.bits) + 1, np.float32))
            np.add.at(table[0], at, w)  # the intercept comes in two parts
        dense, intercept = table[0], table[0][-1]
        raw = np.array([dense[features(t, fit.bits)].sum(dtype=np.float64) + intercept for t in col.to_pylist()])
        return pa.array(1 / (1 + np.exp(-np.clip(raw, -35, 35))))

    return docs.withColumn(out, probability(F.col(text)))


def fit_and_score(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), allowed=None, text: str = "text", out: str = "score") -> DataFrame:
    weights = train(train_rows(docs, labels, fit, text=text, allowed=allowed), fit)
    return score(docs, weights, fit, text, out)
