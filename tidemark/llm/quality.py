"""Quality rules: an isolation forest over rule statistics.

Each text gets counts (words, symbols, repeated lines and word windows, words in
capitals). Two hard rules reject texts that are too short or repeat themselves;
the rest is judged by an isolation forest over ratios of the counts: documents
that random splits isolate after few steps are anomalous. The forest is fitted on
a bounded sample of all rows (``Fit.max_rows``, by a hash of the id and text), and
the path-length score above which a document goes is calibrated on every labelled
row, from a histogram of scores by label.

Edge cases: a null or empty text has no words, fails the base rules and isn't
kept; without labelled rows of both kinds the threshold is ``Fit.default``; rows
with a null label do not calibrate; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, words_of


@dataclass(frozen=True)
class Fit:
    trees: int = 128
    sample: int = 256
    max_rows: int = 32_768
    seed: int = 11
    bins: int = 2_000
    default: float = 0.65
    #: A clean text rejected costs as many junk texts kept (as shares of their class).
    false_alarm: float = 10.0


SYMBOLS = "#*$%&|<>"
_NO_SYMBOLS = str.maketrans("", "", SYMBOLS)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_distinct")


def repeated_words(words: list[str], width: int = 8) -> int:
    """Words that lie in a window of ``width`` words found twice or more.

    Windows are compared exactly: codes of 1, 2, 4 and 8 words are ranks of pairs
    of codes half as wide.
    """
    n = len(words)
    if n <= width:
        return 0
    number: dict[str, int] = {}
    code = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, n)
    if len(number) == n:
        return 0
    reach = 1
    while reach < width:
        pair = code[:-reach] * (int(code.max()) + 1) + code[reach:]
        found, code = np.unique(pair, return_inverse=True)
        if len(found) == len(pair):
            return 0
        reach *= 2
    again = np.bincount(code)[code] > 1
    cover = np.zeros(n + 1, np.int64)
    cover[:-width][again] += 1
    cover[width:][again] -= 1
    return int((np.cumsum(cover)[:n] > 0).sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """The counts named in ``COUNTS``."""
    if not text:
        return (0,) * len(COUNTS)
    words = words_of(text)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return (
        len(words),
        sum(map(len, words)),
        len(text) - len(text.translate(_NO_SYMBOLS)) if not text.isascii() else sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(map(str.isupper, words)),
        len(set(words)),
    )


def ratios(c: dict[str, np.ndarray]) -> np.ndarray:
    """Features of the forest, a row for each document. Repeated lines and windows
    are left to the base rules: below their limits they don't mark bad texts."""
    n = np.maximum(c["n_words"], 1).astype(float)
    return np.column_stack(
        [
            (c["word_chars"] + 250) / (n + 50),  # few words tell little: fifty of five letters are added
            np.floor(20 * c["n_symbols"] / n) / 20,  # in steps: a stray symbol or capital is nothing
            np.floor(20 * c["n_upper_words"] / n) / 20,
            np.minimum(np.log1p(c["n_distinct"]) / np.log1p(n), 0.9),  # only a poor vocabulary tells
        ]
    )


def _average_path(n):
    """Mean depth of an unsuccessful search among n."""
    n = np.asarray(n, float)
    h = np.log(np.maximum(n - 1, 1)) + 0.5772156649
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Trees of random splits as flat arrays: feature (-1: leaf), cut, first child, path length."""

    def __init__(self, rows: np.ndarray, fit: Fit):
        rng = np.random.default_rng(fit.seed)
        self.norm = float(max(_average_path(min(fit.sample, len(rows))), 1e-9))
        self.trees = [self._grow(rows[rng.choice(len(rows), min(fit.sample, len(rows)), replace=False)], rng) for _ in range(fit.trees)] if len(rows) else []

    def _grow(self, rows: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        most = int(np.ceil(np.log2(max(len(rows), 2))))
        feature, cut, child, path = [-1], [0.0], [0], [0.0]
        todo = [(0, rows, 0)]
        while todo:
            at, own, depth = todo.pop()
            low, high = own.min(axis=0), own.max(axis=0)
            wide = np.flatnonzero(high > low)
            if depth >= most or len(own) < 2 or not len(wide):
                path[at] = depth + float(_average_path(len(own)))
                continue
            f = int(rng.choice(wide))
            c = float(rng.uniform(low[f], high[f]))
            left = own[:, f] <= c
            feature[at], cut[at], child[at] = f, c, len(feature)
            for part in (own[left], own[~left]):
                todo.append((len(feature), part, depth + 1))
                for x, v in ((feature, -1), (cut, 0.0), (child, 0), (path, 0.0)):
                    x.append(v)
        return np.array(feature), np.array(cut), np.array(child), np.array(path)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 anomalous, 0.5 and less ordinary."""
        if not self.trees:
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        each = np.arange(len(rows))
        for feature, cut, child, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            while True:
                f = feature[at]
                if (f < 0).all():
                    break
                inner = f >= 0
                at = np.where(inner, child[at] + (rows[each, np.maximum(f, 0)] > cut[at]), at)
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / self.norm)


def measure(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The id and the counts of every row."""
    kind = pa.struct([(c, pa.int64()) for c in COUNTS])

    @F.arrow_udf(", ".join(f"{c} long" for c in COUNTS))
    def count(col: pa.Array) -> pa.Array:
        rows = [counts_of(t) for t in col.to_pylist()]
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * len(COUNTS))], fields=list(kind))

    out = df.select(F.col(key).alias("doc_id"), count(F.col(text)).alias("c")).select("doc_id", "c.*")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def fit_forest(measured: DataFrame, fit: Fit = Fit()) -> Forest:
    """Fitted on a bounded sample of the rows that pass the base rules."""
    rows = measured.where(~F.col("base_failed"))
    n = rows.count()
    rate = min(1.0, fit.max_rows / n) if n else 1.0
    turn = F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(1_000_003))
    sample = rows.where(turn < int(rate * 1_000_003)).select("doc_id", *COUNTS).toArrow().to_pandas().sort_values(["doc_id", *COUNTS])
    return Forest(ratios({c: sample[c].to_numpy() for c in COUNTS}), fit)


def add_scores(measured: DataFrame, forest: Forest, out: str = "score") -> DataFrame:
    shared = measured.sparkSession.sparkContext.broadcast(forest)

    @F.arrow_udf("double")
    def judge(*cols: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(ratios({c: x.to_numpy(zero_copy_only=False) for c, x in zip(COUNTS, cols, strict=True)})))

    return measured.withColumn(out, judge(*[F.col(c) for c in COUNTS]))


def calibrate(scored: DataFrame, labels: DataFrame, fit: Fit = Fit(), label: str = "quality", key: str = "doc_id") -> float:
    """The score above which a document goes, from all labelled rows that pass the base rules."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("doc_id")).agg(F.min(label).alias("good"))
    bins = scored.where(~F.col("base_failed")).join(known, "doc_id").groupBy(F.floor(F.col("score") * fit.bins).cast("int").alias("bin"), (F.col("good") > 0).alias("good")).count().collect()  # at most 2 * bins rows
    good, bad = np.zeros(fit.bins + 2), np.zeros(fit.bins + 2)
    for r in bins:
        (good if r["good"] else bad)[r["bin"]] += r["count"]
    if not good.sum() or not bad.sum():
        return fit.default
    above = lambda x: np.cumsum(x[::-1])[::-1] / x.sum()
    gain = above(bad) - fit.false_alarm * above(good)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(best[len(best) // 2]) / fit.bins  # the middle of a flat top


def judge(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``score`` and ``kept`` of every row."""
    measured = materialize(measure(docs, text, key), "quality-counts")
    scored = add_scores(measured, fit_forest(measured, fit))
    limit = calibrate(scored, labels, fit, key=key)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") < limit))
