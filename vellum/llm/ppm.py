"""LM scoring by prediction by partial matching over a byte-context trie.

A context of up to `order` bytes predicts the next byte; unseen bytes escape to the next shorter
context, with the escape share of method C (distinct followers over followers + distinct), and the
bytes a longer context has seen are excluded there. The last resort is a flat share over the bytes
not yet excluded, and the end of a text is a symbol of its own, so code lengths sum over symbols to
a proper probability of the whole text.

Pretrained scoring counts every window of order + 1 symbols of all texts (those outside the training
texts with zero), in Spark: tasks count their own windows, one shuffle adds them up. Shorter
contexts' counts are the sums of these. In a fixed trie the bytes excluded at a context depend only
on the longer context left behind, so the code length of a symbol is a function of its window alone,
and each window is priced once. Windows are dealt by the last two bytes of their context, so a task
has all counts of the contexts of two bytes or more; the counts of shorter ones (at most 2 ** 16)
are sent to it.

No window is left out. The prices of frequent windows (at most `max_windows`, by a least count) are
sent to tasks, which keep a hashed table of them and look whole arrays of windows up at once; those
of all others are joined on the window.

Adaptive scoring (`Adaptive`) grows the trie while it reads one text.

The base score is a word unigram with additive smoothing. Counts of frequent words (at most
`max_words`, by a least count) are sent to tasks; the others are joined on the word.

Defined results: null and empty texts score their end alone; an empty training set leaves the flat
share; repeated rows are scored and counted each; rows without an id are never trained on.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm._rt import begin, holds, ready, release, store

END, START = 0xFF, 0xFE  # bytes that no UTF-8 text holds
SYMBOLS = 255  # all bytes but START
LIMIT = 1 << 20  # windows that a task holds before it folds or gives them out


def windows(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of order + 1 symbols as integers, the symbol to predict lowest, and where each text begins."""
    pad = bytes([START]) * order
    parts = [pad + (t or "").encode() + bytes([END]) for t in texts]
    sizes = np.array([len(p) - order for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    key = np.zeros(max(0, len(data) - order), np.uint64)
    for k in range(order + 1):
        key = (key << np.uint64(8)) | data[k : len(data) - order + k]
    starts = np.concatenate([[0], np.cumsum(sizes + order)[:-1]]) if len(parts) else np.zeros(0, np.int64)
    keep = np.ones(len(key), bool)
    for k in range(order):
        i = starts[1:] - order + k
        keep[i[i >= 0]] = False
    return key[keep], np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(parts) else np.zeros(0, np.int64)


def count_windows(texts: DataFrame, order: int) -> DataFrame:
    """(w, n): windows of all texts and how often those that are `trained` hold them."""

    def run(batches):
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        learnt: list[np.ndarray] = []
        other: list[np.ndarray] = []

        def fold():
            nonlocal keys, counts
            k, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *learnt]), return_counts=True)
            o = np.unique(np.concatenate([np.zeros(0, np.uint64), *other]))
            learnt.clear()
            other.clear()
            both, where = np.unique(np.concatenate([keys, k, o]), return_inverse=True)
            total = np.zeros(len(both), np.int64)
            np.add.at(total, where, np.concatenate([counts, c, np.zeros(len(o), np.int64)]))
            keys, counts = both, total

        def flush():
            for lo in range(0, len(keys), 100_000):
                yield pa.record_batch([pa.array(keys[lo : lo + 100_000].view(np.int64)), pa.array(counts[lo : lo + 100_000])], ["w", "n"])

        for b in batches:
            texts, trained = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo in range(0, len(texts), 200):
                part = list(zip(texts[lo : lo + 200], trained[lo : lo + 200]))
                learnt.append(windows([t for t, yes in part if yes], order)[0])
                other.append(windows([t for t, yes in part if not yes], order)[0])
                if sum(map(len, learnt)) + sum(map(len, other)) > LIMIT:
                    fold()
            if len(keys) > LIMIT:
                yield from flush()
                keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        fold()
        yield from flush()
        keys = counts = None
        release()

    return texts.select("text", "trained").mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


def price_windows(counts: DataFrame, order: int) -> DataFrame:
    """(w, n, price) for every window of (w, n); those of n = 0 are priced but not part of the model."""
    spark = counts.sparkSession
    m = min(2, order)
    mask = (1 << (8 * m)) - 1
    low = counts.where("n > 0").groupBy(F.col("w").bitwiseAND(F.lit(mask)).alias("w")).agg(F.sum("n").alias("n")).toArrow()  # at most 2 ** 16 rows
    sent = spark.sparkContext.broadcast((low.column("w").to_numpy().astype(np.uint64), low.column("n").to_numpy()))
    group = F.shiftrightunsigned("w", 8).bitwiseAND(F.lit(mask))
    dealt = counts.select(group.alias("g"), "w", "n").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "g").sortWithinPartitions("g")

    def run(batches):
        def found(m):
            w, n = m[1].view(np.uint64), m[2]
            trie = Trie(w[n > 0], n[n > 0], order, sent.value)
            for lo in range(0, len(w), 100_000):
                yield pa.record_batch([pa.array(m[1][lo : lo + 100_000]), pa.array(n[lo : lo + 100_000]), pa.array(trie.price(w[lo : lo + 100_000]))], ["w", "n", "price"])

        held, size = [], 0
        for b in batches:
            held.append(np.stack([b.column(i).to_numpy() for i in range(3)]))
            size += b.num_rows
            if size > LIMIT // 4:
                m = np.concatenate(held, axis=1)
                new = np.flatnonzero(m[0, 1:] != m[0, :-1])
                cut = int(new[-1]) + 1 if len(new) else 0
                if cut:
                    yield from found(np.ascontiguousarray(m[:, :cut]))
                held, size = [m[:, cut:].copy()], m.shape[1] - cut
        if size:
            yield from found(np.concatenate(held, axis=1))
        held = None
        release()

    return dealt.mapInArrow(run, "w long, n long, price double")


def least_count(counts: DataFrame, most: int, column: str = "n") -> int:
    """The least count c for which at most `most` rows have c or more; from a histogram of counts, by powers of 2 ** 0.25."""
    level = F.floor(F.log2(F.col(column).cast("double")) * 4).cast("int")
    rows = {r["l"]: r["k"] for r in counts.groupBy(level.alias("l")).agg(F.count("*").alias("k")).collect()}  # a few hundred at most
    total, least = 0, 1
    for l in sorted(rows, reverse=True):
        total += rows[l]
        if total > most:
            return math.ceil(2 ** ((l + 1) / 4))
        least = math.ceil(2 ** (l / 4)) if l > 0 else 1
    return 1 if total <= most else least


class Trie:
    """Counts of windows, and the price in log10 of each window under escapes and exclusion."""

    def __init__(self, windows: np.ndarray, counts: np.ndarray, order: int, low: tuple[np.ndarray, np.ndarray] | None = None):
        """low: the counts of the last two symbols (of the last one if order is 1) over all windows, where `windows` are but those of some contexts."""
        self.order = order
        self.keys, self.counts, self.ctx, self.total, self.kinds, self.rest, self.spare = [], [], [], [], [], [], []
        order_of = np.argsort(windows)
        w, c = windows[order_of].astype(np.uint64), counts[order_of].astype(np.int64)
        levels = {order: (w, c)}
        for k in range(order - 1, -1, -1):
            if low is not None and k == min(2, order) - 1:
                order_of = np.argsort(low[0])
                levels[k] = (low[0][order_of].astype(np.uint64), low[1][order_of].astype(np.int64))
                continue
            mask = np.uint64((1 << (8 * (k + 1))) - 1)
            u, inv = np.unique(levels[k + 1][0] & mask, return_inverse=True)
            n = np.zeros(len(u), np.int64)
            np.add.at(n, inv, levels[k + 1][1])
            levels[k] = (u, n)
        for k in range(order + 1):
            u, n = levels[k]
            ctx, first = np.unique(u >> np.uint64(8), return_index=True)
            self.keys.append(u)
            self.counts.append(n)
            self.ctx.append(ctx)
            self.total.append(np.add.reduceat(n, first) if len(n) else n)
            self.kinds.append(np.diff(np.append(first, len(u))))
        # what is left at the next shorter context when a context's own symbols are excluded there
        for k in range(1, order + 1):
            u = self.keys[k]
            below = np.searchsorted(self.keys[k - 1], u & np.uint64((1 << (8 * k)) - 1))
            which = np.searchsorted(self.ctx[k], u >> np.uint64(8))
            gone = np.zeros(len(self.ctx[k]), np.int64)
            np.add.at(gone, which, self.counts[k - 1][below])
            shorter = self._find(self.ctx[k - 1], self.ctx[k] & np.uint64((1 << (8 * (k - 1))) - 1 if k > 1 else 0))
            self.rest.append(self.total[k - 1][shorter] - gone)
            self.spare.append(self.kinds[k - 1][shorter] - self.kinds[k])

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted key, or -1."""
        if not len(keys):
            return np.full(len(wanted), -1)
        i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[i] == wanted, i, -1)

    def price(self, w: np.ndarray) -> np.ndarray:
        """log10 of the probability of each window's last symbol after its other symbols."""
        out = np.zeros(len(w))
        open_ = np.ones(len(w), bool)
        above = np.full(len(w), -1)  # the context that was escaped from, one longer; -1: none
        for k in range(self.order, -1, -1):
            own = w & np.uint64((1 << (8 * (k + 1))) - 1) if k < 7 else w
            c = self._find(self.ctx[k], own >> np.uint64(8))
            s = self._find(self.keys[k], own)
            total, kinds = self.total[k][c] if len(self.total[k]) else np.zeros(len(w)), self.kinds[k][c] if len(self.kinds[k]) else np.zeros(len(w))
            if k < self.order and len(self.rest[k]):
                total = np.where(above >= 0, self.rest[k][above], total)
                kinds = np.where(above >= 0, self.spare[k][above], kinds)
            use = open_ & (c >= 0) & (total > 0)  # a context that has nothing left gives no escape either
            hit = use & (s >= 0)
            if len(self.counts[k]):
                out[hit] += np.log10(self.counts[k][s[hit]] / (total[hit] + kinds[hit]))
            miss = use & ~hit
            out[miss] += np.log10(kinds[miss] / (total[miss] + kinds[miss]))
            open_ &= ~hit
            above = np.where(c >= 0, c, -1)
        seen = self.kinds[0][0] if len(self.kinds[0]) else 0
        out[open_] -= math.log10(max(1, SYMBOLS - seen))
        return out


class Priced:
    """Prices of some windows, not a number for all others."""

    def __init__(self, windows: np.ndarray, prices: np.ndarray, order: int):
        place = np.argsort(windows)
        self.order, self.keys, self.prices = order, windows[place], np.append(prices[place], np.nan)

    def price(self, w: np.ndarray) -> np.ndarray:
        return self.prices[Trie._find(self.keys, w)]


class Scorer:
    """Sums of prices per text, through a direct-mapped table of windows already priced."""

    def __init__(self, trie: Trie | Priced, bits: int = 20):
        self.trie, self.bits = trie, bits
        self.key, self.value = np.full(1 << bits, 2**64 - 1, np.uint64), np.zeros(1 << bits)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        w, starts = windows(texts, self.trie.order)
        return np.add.reduceat(self.prices(w), starts) if len(starts) else np.zeros(0)

    def prices(self, w: np.ndarray) -> np.ndarray:
        slot = ((w * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out, known = self.value[slot], self.key[slot] == w
        new = np.flatnonzero(~known)
        if len(new):
            u, inv = np.unique(w[new], return_inverse=True)
            p = self.trie.price(u)
            out[new] = p[inv]
            s = ((u * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
            self.key[s], self.value[s] = u, p
        return out

    def split(self, texts: list[str | None]) -> tuple[np.ndarray, pa.Array]:
        """Sums of the known prices per text, and the windows without one, as lists of (w, n)."""
        w, starts = windows(texts, self.trie.order)
        p = self.prices(w)
        at = np.flatnonzero(np.isnan(p))
        p[at] = 0
        of, w = np.searchsorted(starts, at, "right") - 1, w[at]
        place = np.lexsort((w, of))
        of, w = of[place], w[place]
        first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (w[1:] != w[:-1])])) if len(w) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(w)))
        ends = np.searchsorted(of[first], np.arange(len(texts) + 1))
        rest = pa.StructArray.from_arrays([pa.array(w[first].view(np.int64)), pa.array(n.astype(np.int64))], ["w", "n"])
        return np.add.reduceat(p, starts), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), rest)


class Adaptive:
    """The trie of one text, grown symbol by symbol; the same escapes and exclusion, in plain Python."""

    def __init__(self, order: int = 4):
        self.order, self.trie = order, {}

    def score(self, text: str | None, learn: bool = True) -> float:
        """log10 of the text's probability. learn: count each symbol after it is coded."""
        data, out = bytes([START]) * self.order + (text or "").encode() + bytes([END]), 0.0
        for i in range(self.order, len(data)):
            s, gone = data[i], set()
            for k in range(self.order, -1, -1):
                followers = self.trie.get(data[i - k : i])
                if not followers:
                    continue
                left = {x: n for x, n in followers.items() if x not in gone}
                total, kinds = sum(left.values()), len(left)
                if not total:
                    continue
                if s in left:
                    out += math.log10(left[s] / (total + kinds))
                    break
                out += math.log10(kinds / (total + kinds))
                gone |= left.keys()
            else:
                out -= math.log10(max(1, SYMBOLS - len(gone)))
            if learn:
                self.learn(data[i - self.order : i], s)
        return out

    def learn(self, context: bytes, s: int) -> None:
        for k in range(self.order + 1):
            node = self.trie.setdefault(context[len(context) - k :], {})
            node[s] = node.get(s, 0) + 1


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts; words are runs of anything but ASCII space, A-Z lower-cased."""

    def run(batches):
        held: Counter = Counter()

        def flush():
            words = list(held.items())
            held.clear()
            for lo in range(0, len(words), 50_000):
                w, c = zip(*words[lo : lo + 50_000])
                yield pa.record_batch([pa.array([x.decode() for x in w], pa.string()), pa.array(c, pa.int64())], ["word", "c"])

        for b in batches:
            for t in b.column(0).to_pylist():
                held.update((t or "").encode().lower().split())
                if len(held) > 150_000:
                    yield from flush()
        yield from flush()
        release()

    return texts.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


FIRST = "row long, doc_id long, n_tokens long, n_known long, base double, score double, rare array<struct<word:string,n:long>>, rest array<struct<w:long,n:long>>"


def score(documents: DataFrame, trained_on: Column, order: int = 5, max_windows: int = 2_000_000, max_words: int = 200_000) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every whole text."""
    ready(documents.sparkSession)
    texts = documents.where(trained_on).select("text")
    n_texts = texts.count()
    counts = store(word_counts(texts), "words")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, kinds = totals["n"] + n_texts, totals["v"] + (n_texts > 0)
    least = least_count(counts, max_words, "c")
    common = counts.where(F.col("c") >= least).toArrow()
    words, c = common.column("word").to_pylist(), common.column("c").to_numpy()
    every = documents.select("text", F.coalesce(trained_on, F.lit(False)).alias("trained"))
    priced = store(price_windows(store(count_windows(every, order), "windows"), order), "prices")
    frequent = least_count(priced.where("n > 0"), max_windows)
    got = priced.where(F.col("n") >= frequent).select("w", "price").toArrow()
    w, of_w = got.column("w").to_numpy().view(np.uint64), got.column("price").to_numpy()
    bottom = math.log10(n_train + 0.5 * (kinds + 1))
    of_end, of_new = math.log10(n_texts + 0.5) - bottom, math.log10(0.5) - bottom
    prices = np.log10(c + 0.5) - bottom
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))), ("rest", pa.list_(pa.struct([("w", pa.int64()), ("n", pa.int64())])))])
    token = uuid.uuid4().hex
    sent = documents.sparkSession.sparkContext.broadcast((pa.array(words, pa.string()), prices, w, of_w))  # at most max_words and max_windows entries

    def run(batches):
        begin("ppm")
        table, known_windows = _loaded(sent, token, order)
        scorer = Scorer(known_windows)
        task, row = TaskContext.get().partitionId(), 0
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo in range(0, len(texts), 100):
                part = texts[lo : lo + 100]
                out = {k: [] for k in schema.names}
                for t in part:
                    own = (t or "").encode().lower().split()
                    found = list(map(table.get, own))
                    rare = Counter(x for x, p in zip(own, found) if p is None) if None in found else {}
                    known = [p for p in found if p is not None]
                    out["n_tokens"].append(len(own) + 1)
                    out["n_known"].append(len(known) + (n_texts > 0))
                    out["base"].append(sum(known) + of_end + of_new * (len(own) - len(known)))
                    out["rare"].append([{"word": x.decode(), "n": k} for x, k in rare.items()])
                    out["row"].append(task << 33 | row)
                    row += 1
                out["doc_id"] = ids[lo : lo + 100]
                out["score"], out["rest"] = scorer.split(part)
                yield pa.RecordBatch.from_pydict(out, schema)
        scorer = None
        release()

    first = store(documents.select("doc_id", "text").mapInArrow(run, FIRST), "scored")
    rare = first.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    rest = first.select("row", F.explode("rest").alias("r")).select("row", "r.w", F.col("r.n").alias("times"))
    by_word = rare.join(counts.where(F.col("c") < least), "word").select(F.col("row").alias("of"), F.col("n").alias("more"), (F.col("n") * (F.log10(F.col("c") + 0.5) - math.log10(0.5))).alias("gain"), F.lit(0.0).alias("price"))
    by_window = rest.join(priced.where(F.col("n") < frequent), "w").select(F.col("row").alias("of"), F.lit(0).cast("long").alias("more"), F.lit(0.0).alias("gain"), (F.col("times") * F.col("price")).alias("price"))
    late = by_word.unionByName(by_window).groupBy("of").agg(F.sum("more").alias("more"), F.sum("gain").alias("gain"), F.sum("price").alias("price"))
    both = first.drop("rare", "rest").join(late, first["row"] == late["of"], "left")
    return both.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("price", F.lit(0.0))).alias("score"),
    )


LOADED: dict = {}
holds("ppm", LOADED.clear)


def _loaded(sent, token: str, order: int) -> tuple[dict[bytes, float], Priced]:
    """The word table and the window prices of a broadcast, built once per worker."""
    if LOADED.get("token") != token:
        words, prices, w, of_w = sent.value
        LOADED.clear()
        release()
        LOADED.update(token=token, value=(dict(zip((x.encode() for x in words.to_pylist()), prices.tolist())), Priced(w, of_w, order)))
    return LOADED["value"]
