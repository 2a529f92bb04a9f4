"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, word pairs, word triples, pairs with
one word between, and word beginnings (for inflected forms). Per-coordinate learning rates and an L1 threshold leave a few thousand non-zero
weights out of 2**bits, so the model is a small array that is sent to every task.

Training uses at most `per_class` labelled rows of each class (the rows with the smallest hashes
of their ids); it runs as one Spark task over that
bounded sample, and only the non-zero weights reach the driver.

Defined results: a null text scores as an empty one; a null id is never trained on; of repeated
label rows the larger label counts; with no labelled row of a class the model is a constant.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm._rt import begin, holds, ready

MOST_GRADES = 100
EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_/\\~`^+=@"


class Words:
    """Hashes of each word and of its first 4 and 6 letters (inflected forms of a word share these); a bounded table per worker."""

    def __init__(self, cap: int = 300_000):
        self.cap, self.row, self.hash = cap, {}, np.zeros((cap, 3), np.uint32)

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.row) + len(words) > self.cap:
            self.row.clear()
            if len(words) > self.cap:
                return np.concatenate([self(words[k : k + self.cap // 2]) for k in range(0, len(words), self.cap // 2)])
        for w in set(words).difference(self.row):
            i = self.row[w] = len(self.row)
            x = w.strip(EDGE) or w
            self.hash[i] = xxhash.xxh32_intdigest(x), xxhash.xxh32_intdigest(x[:4], 4), xxhash.xxh32_intdigest(x[:6], 6)
        return self.hash[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))]


WORDS = Words()
holds("toxicity", WORDS.row.clear)


def features(text: str | None, bits: int) -> np.ndarray:
    """Distinct hashed 1-, 2-, 3-grams, 1-skip pairs and word beginnings of a text, sorted."""
    table = WORDS((text or "").lower().split()).astype(np.uint64)
    h = table[:, 0]
    parts = [h * np.uint64(0x9E3779B97F4A7C15), table[:, 1] * np.uint64(0xA24BAED4963EE407), table[:, 2] * np.uint64(0x9FB21C651E98DF25)]
    if len(h) > 1:
        parts.append((h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (h[1:] * np.uint64(0x165667B19E3779F9)))
    if len(h) > 2:
        skip = (h[:-2] * np.uint64(0xD6E8FEB86659FD93)) ^ (h[2:] * np.uint64(0xA0761D6478BD642F))
        parts += [skip, (skip ^ (h[1:-1] * np.uint64(0xE7037ED1A0B428DB))) * np.uint64(0x8EBC6AF09C88C6E3)]
    x = np.concatenate(parts)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return np.unique(x >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """FTRL-proximal for binary features; coordinate -1 (the last) is the intercept, without L1."""

    def __init__(self, bits: int = 20, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(2**bits + 1), np.zeros(2**bits + 1)

    def weights(self, i: np.ndarray) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        l1 = np.where(i == len(self.z) - 1, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > l1, w, 0.0)

    def learn(self, i: np.ndarray, y: int) -> None:
        i = np.append(i, len(self.z) - 1)
        w = self.weights(i)
        g = _sigmoid(w.sum()) - y
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def learnable(doc_id: Column) -> Column:
    """True for the rows whose labels may be used: crc32 of the id as text, modulo 5, is not 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 0, F.lit(False))


def sampled_labels(labels: DataFrame, target: str, per_class: int, allowed: Column) -> DataFrame:
    """(doc_id, grade): per grade at most per_class rows, those with the smallest id hashes."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & allowed).groupBy("doc_id").agg(F.max(target).cast("int").alias("grade"))
    # a first cut by the hash leaves about twice per_class rows of a grade, so that ranking them is small work at any size
    u = F.pmod(F.xxhash64("doc_id"), F.lit(2**32))
    counts = rows.groupBy("grade").agg(F.count("*").alias("n")).limit(MOST_GRADES + 1).collect()
    if len(counts) > MOST_GRADES:
        raise ValueError(f"more than {MOST_GRADES} grades: not a graded label")
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("grade") == r["grade"], min(1.0, (2.0 * per_class + 100) / r["n"])).otherwise(share)
    near = rows.where(u < share * 2**32)
    first = Window.partitionBy("grade").orderBy(u, "doc_id")
    return near.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= per_class).select("doc_id", "grade")


def fit(documents: DataFrame, labels: DataFrame, target: str = "toxic", allowed: Column | None = None, per_class: int = 5000, bits: int = 20, epochs: int = 4, **ftrl) -> dict:
    """Train on the labelled rows; returns {"bits", "index", "weight", "bias"} with the non-zero weights only."""
    ready(documents.sparkSession)
    ids = sampled_labels(labels, target, per_class, F.lit(True) if allowed is None else allowed)
    # at most per_class rows for each class: a proven bound, and shuffled as single rows into one task
    rows = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "grade").repartition(1)

    def train(batches):
        begin("toxicity")
        seen = []
        for b in batches:
            for d, t, g in zip(*(b.column(i).to_pylist() for i in range(3))):
                seen.append((xxhash.xxh64_intdigest(str(d), 7), d, features(t, bits), int(g > 0)))
        seen.sort(key=lambda r: r[:2])
        model = Ftrl(bits, **ftrl)
        for _ in range(epochs if len({r[3] for r in seen}) == 2 else 0):
            for _, _, x, y in seen:
                model.learn(x, y)
        i = np.arange(len(model.z))
        w = model.weights(i)
        keep = np.flatnonzero(w)
        yield pa.record_batch({"i": keep, "w": w[keep]})

    got = rows.mapInArrow(train, "i long, w double").toArrow()
    i, w = got.column("i").to_numpy(), got.column("w").to_numpy()
    order = np.argsort(i)
    i, w = i[order], w[order]
    last = len(i) > 0 and i[-1] == 2**bits
    return {"bits": bits, "index": i[:-1] if last else i, "weight": w[:-1] if last else w, "bias": float(w[-1]) if last else 0.0}


def score(documents: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) for every row and whole text."""
    ready(documents.sparkSession)
    bits, bias, index, weight = model["bits"], model["bias"], model["index"], model["weight"].astype(np.float32)

    def run(batches):
        begin("toxicity")
        table = np.zeros(2**bits, np.float32)
        table[index] = weight
        for b in batches:
            s = [_sigmoid(bias + float(table[features(t, bits)].sum())) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(s, pa.float64())], ["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
