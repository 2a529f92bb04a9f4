"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(w . x - t[k]) with one weight vector for all grades and thresholds
t[1] < t[2] < ..., kept in order by learning the logs of their gaps. So each text gets an expected
grade and a tail probability for every grade, and selection is a bound on a tail probability.

x are hashed features of the text: the shapes of its words (capitals, small letters, digits and
other signs, runs of a kind cut to one) and pairs of neighbouring shapes, with how large a share of
the text they are; how many words repeat the one before or are distinct; and the words themselves.

Training uses at most `per_grade` labelled rows of each grade (those with the smallest id hashes),
in one Spark task over that bounded sample; 2**bits weights at most reach the driver.

Defined results: null and empty texts have no words and get the tail probabilities of an empty
feature list; labels that are null, or of null ids, are not used; of repeated label rows the larger
grade counts; with fewer than two grades everything is kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm._rt import begin, holds, ready
from vellum.llm.toxicity import sampled_labels

MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shape(word: str) -> str:
    """Capitals, small letters and digits as A, a and 0, other signs as they are; runs of one kind as one. The whole word counts."""
    out = []
    for c in word:
        x = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != x:
            out.append(x)
    return "".join(out)


class Words:
    """Hashes of each word and of its shape; a bounded table per worker."""

    def __init__(self, cap: int = 300_000):
        self.cap, self.row, self.hash = cap, {}, np.zeros((cap, 2), np.uint32)

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.row) + len(words) > self.cap:
            self.row.clear()
            if len(words) > self.cap:
                return np.concatenate([self(words[k : k + self.cap // 2]) for k in range(0, len(words), self.cap // 2)])
        for w in set(words).difference(self.row):
            i = self.row[w] = len(self.row)
            self.hash[i] = xxhash.xxh32_intdigest(w.lower()), xxhash.xxh32_intdigest(shape(w), 3)
        return self.hash[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))]


WORDS = Words()
holds("quality", WORDS.row.clear)


def _shares(h: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Hashes of (value, size of its share of n, in powers of two)."""
    u, c = np.unique(h, return_counts=True)
    level = np.minimum(7, np.floor(-np.log2(c / max(1, n)))).astype(np.uint64)
    return (u ^ np.uint64(salt)) * MIX + (level + np.uint64(1)) * MIX2


def features(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's features."""
    table = WORDS((text or "").split()).astype(np.uint64)
    n = len(table)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0)
    w, s = table[:, 0], table[:, 1]
    again = int((w[1:] == w[:-1]).sum())
    distinct = np.unique(w)
    flags = np.array([11, round(8 * again / n), 12, round(8 * len(distinct) / n)], np.uint64)
    shares = [_shares(s, n, 1), flags[:2].prod(keepdims=True) * MIX + flags[0], (flags[3:] + np.uint64(100)) * MIX2 + flags[2]]
    if n > 1:
        shares.append(_shares(s[:-1] * MIX2 ^ s[1:], n, 2))
    x = np.concatenate([*shares, distinct * MIX2 + np.uint64(5)])
    v = np.ones(len(x))
    v[len(x) - len(distinct) :] = 0.5 / math.sqrt(len(distinct))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(64 - bits)).astype(np.int64), v


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ordinal:
    """Cumulative-link model for grades 0 .. n - 1, learned by stochastic gradients with per-coordinate rates."""

    def __init__(self, n: int, bits: int = 18, rate: float = 0.1, l2: float = 1e-5):
        self.n, self.rate, self.l2 = n, rate, l2
        self.w, self.g = np.zeros(2**bits), np.full(2**bits, 1e-2)
        self.first, self.gaps = 0.0, np.zeros(max(0, n - 2))

    def thresholds(self) -> np.ndarray:
        return self.first + np.concatenate([[0.0], np.cumsum(np.exp(self.gaps))])

    def tails(self, i: np.ndarray, v: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. n - 1."""
        return _sigmoid((self.w[i] * v).sum() - self.thresholds())

    def learn(self, i: np.ndarray, v: np.ndarray, y: int) -> None:
        t = np.concatenate([[1.0], self.tails(i, v), [0.0]])
        slope = t[y] + t[y + 1] - 1  # of -log P(y) by w . x
        p = max(t[y] - t[y + 1], 1e-9)
        by_t = np.zeros(self.n + 1)
        by_t[y] += t[y] * (1 - t[y]) / p
        by_t[y + 1] -= t[y + 1] * (1 - t[y + 1]) / p
        by_t = by_t[1 : self.n]
        g = slope * v + self.l2 * self.w[i]
        np.add.at(self.g, i, g * g)
        np.add.at(self.w, i, -self.rate * g / np.sqrt(self.g[i]))
        step = self.rate * 0.1
        self.first -= step * by_t.sum()
        for k in range(len(self.gaps)):
            self.gaps[k] -= step * by_t[k + 1 :].sum() * math.exp(self.gaps[k])


def fit(documents: DataFrame, labels: DataFrame, target: str = "quality", allowed: Column | None = None, per_grade: int = 4000, bits: int = 18, epochs: int = 4) -> dict:
    """{"bits", "grades", "thresholds", "index", "weight"}; grades are the distinct values of the target, in order. Only rows of labels where `allowed` holds are used."""
    ready(documents.sparkSession)
    ids = sampled_labels(labels, target, per_grade, F.lit(True) if allowed is None else allowed)
    rows = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "grade").repartition(1)  # at most per_grade rows for each grade

    def train(batches):
        begin("quality")
        seen = []
        for b in batches:
            for d, t, g in zip(*(b.column(k).to_pylist() for k in range(3))):
                seen.append((xxhash.xxh64_intdigest(str(d), 7), d, features(t, bits), g))
        seen.sort(key=lambda r: r[:2])
        grades = sorted({r[3] for r in seen})
        model = Ordinal(max(2, len(grades)), bits)
        for _ in range(epochs if len(grades) > 1 else 0):
            for _, _, (i, v), g in seen:
                model.learn(i, v, grades.index(g))
        i = np.flatnonzero(model.w)
        t = model.thresholds()
        yield pa.record_batch({"kind": ["w"] * len(i) + ["t"] * len(t) + ["g"] * len(grades), "i": np.concatenate([i, np.arange(len(t)), np.arange(len(grades))]), "v": np.concatenate([model.w[i], t, np.asarray(grades, float)])})

    got = rows.mapInArrow(train, "kind string, i long, v double").toPandas().sort_values("i")
    part = lambda k: got[got.kind == k]
    return {"bits": bits, "grades": [int(x) for x in part("g").v], "thresholds": part("t").v.to_numpy(), "index": part("w").i.to_numpy(), "weight": part("w").v.to_numpy()}


def score(documents: DataFrame, model: dict) -> DataFrame:
    """documents with expected_grade and tails (P(grade >= k) for the second grade on)."""
    ready(documents.sparkSession)
    bits, grades, t, index, weight = model["bits"], model["grades"], model["thresholds"], model["index"], model["weight"]
    names = [c for c in documents.columns if c not in ("expected_grade", "tails")]
    place = names.index("text")

    def run(batches):
        begin("quality")
        w = np.zeros(2**bits)
        w[index] = weight
        steps = np.diff(grades) if len(grades) > 1 else np.zeros(1)
        for b in batches:
            tails = [_sigmoid((w[i] * v).sum() - t) if len(grades) > 1 else np.ones(1) for i, v in (features(x, bits) for x in b.column(place).to_pylist())]
            expected = [(grades[0] if grades else 0) + float((x * steps).sum()) for x in tails]
            yield pa.record_batch([*b.columns, pa.array(expected, pa.float64()), pa.array([x.tolist() for x in tails], pa.list_(pa.float64()))], [*names, "expected_grade", "tails"])

    kept = documents.select(*names)
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, expected_grade double, tails array<double>")


def select(documents: DataFrame, model: dict, least_tail: float = 0.5, grade: int = 1) -> DataFrame:
    """documents whose probability of the `grade`-th grade or better (counted from 0) is at least least_tail."""
    return score(documents, model).where(F.col("tails")[grade - 1] >= least_tail).select(*documents.columns)
