"""Language identification by multilingual mixture inference.

Each language has a smoothed character n-gram model: the likelihood of a word is
the product of its letters' probabilities given the letters before, with orders 1
to ``order`` interpolated. A text is a mixture: expectation-maximisation over its
distinct words estimates the share of each language. Starting from all languages,
the set is thinned: the language with the least share goes as long as the
penalised likelihood (BIC, ``penalty`` times half log n for each language) does
not fall. The prediction is the language with the largest share.

Models are fitted on a bounded sample of labelled rows: at most ``Fit.max_rows`` rows
and ``Fit.max_chars`` characters of each language (in expectation), chosen by a hash
among texts of at most ``Fit.longest`` characters. The table of n-grams and languages
has at most ``Fit.max_cells`` cells; the rarest n-grams go first. No language is left
out. Prediction covers all rows and whole texts.

Edge cases: a null text and one without letters give ``und`` with score 0; rows
without a language do not train; without training rows every text is ``und``; words
of any length are looked up whole, in pieces of bounded memory; equal texts (repeated
rows) get equal results; equal shares go to the language first by code point; extra
columns are kept, but for ``lang_pred`` and ``score``, which are replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import claim


@dataclass(frozen=True)
class Fit:
    max_rows: int = 2_000
    max_chars: int = 20_000_000
    longest: int = 1_000_000
    max_cells: int = 100_000_000
    order: int = 4
    min_count: int = 2
    penalty: float = 4.0
    rounds: int = 12


_LETTERS = regex.compile(r"\p{L}+")


def _grams(word: str, order: int) -> list[str]:
    s = f" {word} "
    return [s[i - n + 1 : i + 1] for i in range(1, len(s)) for n in range(1, order + 1) if i - n + 1 >= 0]


def _codes(points: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length up to ``order``, a 64-bit code of the letters that end at each place."""
    mul, add = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x632BE59BD9B4E019)
    x = (points.astype(np.uint64) + np.uint64(1)) * mul
    out, code = [], x
    for k in range(1, order + 1):
        if k > 1:
            longer = np.zeros_like(x)
            longer[k - 1 :] = (out[-1][k - 2 : len(x) - 1] ^ np.uint64(k)) * add + x[k - 1 :]  # what ends one before, then this letter
            code = longer ^ (longer >> np.uint64(29))
        out.append(code)
    return out


class Model:
    """n-gram tables of all languages and a cache of word likelihoods."""

    ROWS = 400_000
    #: Texts whose new words are looked up together.
    TOGETHER = 128

    def __init__(self, languages: list[str], grams: list[str], probability: np.ndarray, fit: Fit):
        """``probability`` has a row for each n-gram and a column for each language."""
        self.languages, self.fit = languages, fit
        self.tables = []
        length = np.array([len(g) for g in grams], int)
        for k in range(1, fit.order + 1):
            own = np.flatnonzero(length == k)
            points = np.frombuffer("".join([grams[i] for i in own]).encode("utf-32-le"), np.uint32)
            code = _codes(points, k)[k - 1][k - 1 :: k] if len(own) else np.empty(0, np.uint64)
            order = np.argsort(code)
            self.tables.append((code[order], probability[own[order]].reshape(len(own), len(languages))))
        self._known: dict[str, int] = {}
        self._rows = np.zeros((4096, len(languages)), np.float32)
        #: Letters that are looked up at once.
        self._piece = max(64, 8_000_000 // max(len(languages), 1))

    def _learn(self, words: list[str]) -> None:
        """Puts the likelihoods of new words into the cache."""
        base, n = len(self._known), len(words)
        while base + n > len(self._rows):
            self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)])
        ends, at = np.cumsum([len(w) + 2 for w in words]), 0
        while at < n:  # words of a bounded number of letters, or one
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + self._piece, side="right")))
            self._rows[base + at : base + to] = self._words(words[at:to]) if to - at > 1 or len(words[at]) + 2 <= self._piece else self._long(words[at])
            at = to
        self._known.update(zip(words, range(base, base + n), strict=True))

    def _words(self, words: list[str]) -> np.ndarray:
        """Log likelihoods of words; a blank begins and ends each."""
        points = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le"), np.uint32)
        length = np.array([len(w) + 2 for w in words])
        begin = np.concatenate([[0], np.cumsum(length)[:-1]])
        logs = self._logs(points, np.arange(len(points)) - np.repeat(begin, length))
        logs[begin] = 0  # the opening blank is given
        return np.add.reduceat(logs, begin, axis=0)

    def _long(self, word: str) -> np.ndarray:
        """The same for one word, piece by piece; a piece sees the letters before it."""
        points = np.frombuffer(f" {word} ".encode("utf-32-le"), np.uint32)
        total, back = np.zeros(len(self.languages)), self.fit.order - 1
        for i in range(1, len(points), self._piece):
            begin = max(0, i - back)
            own = points[begin : i + self._piece]
            total += self._logs(own, np.arange(begin, begin + len(own)))[i - begin :].sum(axis=0, dtype=float)
        return total.astype(np.float32)

    def _logs(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log likelihood of each letter, which is at place ``at`` of its word."""
        p = np.full((len(points), len(self.languages)), 1e-6, np.float32)
        for k, (code, (known, prob)) in enumerate(zip(_codes(points, self.fit.order), self.tables, strict=True), 1):
            if not len(known):
                continue
            i = np.minimum(np.searchsorted(known, code), len(known) - 1)
            # Longer contexts outweigh shorter ones where they are known.
            q = np.where((known[i] == code)[:, None], prob[i], 0)
            inside = at >= k - 1
            p[inside] = 0.25 * p[inside] + 0.75 * q[inside]
        return np.log(np.maximum(p, 1e-9))

    def shares(self, text: str | None) -> np.ndarray | None:
        """Share of each language; None without a letter."""
        return self.all_shares([text])[0]

    def all_shares(self, texts: list[str | None]) -> list[np.ndarray | None]:
        out = []
        for i in range(0, len(texts), self.TOGETHER):
            counts = [Counter(_LETTERS.findall(t.lower())) if t else None for t in texts[i : i + self.TOGETHER]]
            new = {w for c in counts if c for w in c if w not in self._known}
            if new and len(self._known) + len(new) > self.ROWS:
                self._known.clear()
                new = {w for c in counts if c for w in c}
            if new and self.languages:
                self._learn(list(new))
            out += [self._mixture(c) if c and self.languages else None for c in counts]
        return out

    def _mixture(self, counts: Counter) -> np.ndarray:
        at = np.fromiter(map(self._known.__getitem__, counts), np.int64, len(counts))
        c = np.fromiter(counts.values(), np.float64, len(counts))
        like = self._rows[at].astype(np.float64)
        like = np.ascontiguousarray(np.exp(like - like.max(axis=1, keepdims=True)).T)
        total, n = c.sum(), len(self.languages)
        held = np.arange(n)
        share, fit = self._em(like, c, np.full(n, 1 / n))
        cost = self.fit.penalty * 0.5 * np.log(max(total, 2.0))
        while len(held) > 1:
            keep = np.delete(np.arange(len(held)), int(np.argmin(share)))
            less, found = self._em(like[held[keep]], c, share[keep])
            if found + cost < fit:
                break
            held, share, fit = held[keep], less, found
        out = np.zeros(n)
        out[held] = share
        return out

    def _em(self, like: np.ndarray, c: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
        """Shares and log likelihood; ``like`` has a row for each language."""
        share = np.maximum(share, 1e-6)
        share = share / share.sum()
        total = c.sum()
        for _ in range(self.fit.rounds if len(share) > 1 else 0):
            new = share * (like @ (c / np.maximum(share @ like, 1e-300))) / total
            done = np.abs(new - share).max() < 1e-3
            share = new
            if done:
                break
        return share, float(c @ np.log(np.maximum(share @ like, 1e-300)))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language of the largest share, and that share."""
        out = []
        for share in self.all_shares(texts):
            best = 0 if share is None else int(np.argmax(share))
            out.append(("und", 0.0) if share is None else (self.languages[best], float(min(1.0, share[best]))))
        return out


def train(labelled: DataFrame, fit: Fit = Fit(), text: str = "text", lang: str = "lang", key: str = "doc_id") -> tuple[list[str], list[str], np.ndarray]:
    """Languages, n-grams and their conditional probabilities, from rows with a language."""
    rows = labelled.where(F.col(lang).isNotNull() & (F.length(text) <= fit.longest)).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.pmod(F.xxhash64(key, text), F.lit(1_000_003)).alias("turn"))
    rate = F.least(F.lit(1.0), F.lit(fit.max_rows) / F.count("*"), F.lit(fit.max_chars) / F.greatest(F.sum(F.length("text")), F.lit(1)))
    sizes = rows.groupBy("lang").agg(F.floor(rate * 1_000_003).alias("rate"))
    sample = rows.join(F.broadcast(sizes), "lang").where("turn < rate")
    order = fit.order

    def count(batches):
        found: dict[str, Counter] = {}
        for b in batches:
            for t, g in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                tally = found.setdefault(g, Counter())
                for w, c in Counter(_LETTERS.findall(t.lower())).items():
                    for x in _grams(w, order):
                        tally[x] += c
        for g, tally in found.items():
            keys = list(tally)
            for i in range(0, len(keys), 100_000):
                part = keys[i : i + 100_000]
                yield pa.RecordBatch.from_pydict({"lang": [g] * len(part), "gram": part, "n": [tally[k] for k in part]}, schema=pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())]))

    # The sample of each language is bounded, and so are its n-grams. Where none is seen often enough, all count.
    counted = sample.select("text", "lang").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    often = F.max("n").over(Window.partitionBy("lang"))
    grams = counted.withColumn("most", often).where(F.col("n") >= F.least(F.lit(fit.min_count), F.col("most"))).select("lang", "gram", "n").toArrow()
    languages = sorted(set(grams.column("lang").unique().to_pylist()))
    if not languages:
        return [], [], np.zeros((0, 0), np.float32)
    coded = grams.column("gram").combine_chunks().dictionary_encode()
    names, gram = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    place = {g: i for i, g in enumerate(languages)}
    tongue = np.array([place[g] for g in grams.column("lang").to_pylist()], int)
    n = grams.column("n").to_numpy().astype(np.float64)
    # How often each context occurs in each language.
    stems: dict[str, int] = {}
    stem_of = np.array([stems.setdefault(x[:-1], len(stems)) for x in names], int)
    pair = stem_of[gram] * len(languages) + tongue
    found, where = np.unique(pair, return_inverse=True)
    value = n / (np.bincount(where, n)[where] + 1.0)
    most = max(1, fit.max_cells // len(languages))
    if len(names) > most:  # the rarest go, ties by code point
        total = np.bincount(gram, n)
        kept = sorted(range(len(names)), key=lambda i: (-total[i], names[i]))[:most]
        new = np.full(len(names), -1)
        new[kept] = np.arange(len(kept))
        names, use = [names[i] for i in kept], new[gram] >= 0
        gram, tongue, value = new[gram][use], tongue[use], value[use]
    table = np.zeros((len(names), len(languages)), np.float32)
    table[gram, tongue] = value
    return languages, names, table


def predict(df: DataFrame, model: tuple[list[str], list[str], np.ndarray], fit: Fit = Fit(), text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score``, the share of that language in the text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
    own: dict[int, Model] = {}

    @F.arrow_udf("lang_pred string, score double")
    def guess(col: pa.Array) -> pa.Array:
        claim("langid")
        m = own.get(0)
        if m is None:
            m = own[0] = Model(*shared.value, fit)
        return pa.array([dict(zip(("lang_pred", "score"), x, strict=True)) for x in m.predict(col.to_pylist())], kind)

    return df.withColumn("__guess", guess(F.col(text))).select(*[F.col(f"`{c}`") for c in df.columns if c not in ("lang_pred", "score")], F.col("__guess.lang_pred").alias("lang_pred"), F.col("__guess.score").alias("score"))
