"""Best-fit packing: a configuration linear program over the length histogram.

Documents become token pieces of at most `size` tokens. Only the histogram of piece lengths (at
most `size` rows, whatever the corpus) reaches the driver. There the fractional program

    minimise sum x_c  with  sum_c a[l, c] * x_c >= n[l]  for every length l

over all configurations c (multisets of lengths with sum <= size) is solved by multiplicative
weights: each round a knapsack dynamic program prices the configuration of greatest weight under
the current weights, and the weights of the lengths it covers shrink. The solution is rounded down
to whole sequences; what that leaves is packed best-fit, largest first, into the room that is left.

Pieces then get their places from their rank among pieces of equal length, which needs no sort of
the corpus: the tokenizing task numbers its own pieces of each length, and prefix sums over the
(task, length) counts turn these into global ranks.

Defined results: a null or empty text is one piece holding the closing id alone; equal texts and
repeated rows are packed separately; an empty table gives no rows; a null doc_id stays null.
"""

from __future__ import annotations

import array
import bisect
import os
import random
import re
import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm._rt import begin, holds, ready, store

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank_in_task long"


STOP = re.compile(rb"(?<=[a-z])([,.])(?![^ \t\n\r\x0b\x0c])")


class Encoder:
    """Text -> little-endian uint32 ids, through a bounded table of words where the tokenizer allows it.

    A tokenizer that drops white space and joins nothing over it gives words between ASCII space the
    ids that they have on their own (other space stays inside a word); new words of a batch then go
    in one call. Whether a tokenizer does so is tried out when it is loaded, on texts of all kinds of
    signs; with any other tokenizer whole texts are encoded.
    """

    def __init__(self, path: str, cap: int = 400_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok, self.cap = Tokenizer.from_file(path), cap
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}  # the table before the last one filled up; its words move over when met
        self.by_word = True
        tried = probes()
        self.by_word = self(tried) == self.whole(tried)

    def whole(self, texts: list[str | None]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]

    @staticmethod
    def words(text: str) -> list[bytes]:
        """Pieces that are encoded alike on their own; A-Z is lower-cased and a comma or full stop after a letter set off, as the tokenizer does both, so that fewer pieces differ."""
        data = text.encode()
        if b"<|" not in data:  # else it might hold the name of a special token, which no letter's case may change
            data = STOP.sub(rb" \1", data.lower())
        return data.split()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_word:
            return self.whole(texts)
        split = [self.words(t or "") for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > self.cap:
            self.known, self.older = {}, self.known
            new = set().union(*split)
        met = new.intersection(self.older)
        self.known.update((w, self.older[w]) for w in met)
        new = list(new - met)
        for k in range(0, len(new), 5000):
            words = new[k : k + 5000]
            for w, e in zip(words, self.tok.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)):
                self.known[w] = array.array("I", e.ids).tobytes()
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


def probes(n: int = 400) -> list[str]:
    """Texts of letters, digits, marks, all kinds of space, accents, other scripts and names of special tokens, beside and inside words."""
    r = random.Random(5)
    signs = [*string.printable, *"\xa0\u2028\u200b\u3000\x85éÉßİΣσ\u0301\u0627\u0644漢字🙂ﬁ", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "  ", ", ", ". ", "\r\n"]
    word = lambda: "".join(r.choice(string.ascii_letters) for _ in range(r.randint(1, 9)))
    return ["".join(r.choice((word, word, lambda: " ", lambda: r.choice(signs), lambda: str(r.randint(0, 12345))))() for _ in range(r.randint(0, 40))) for _ in range(n)]


ENCODERS: dict[str, Encoder] = {}
holds("packing", ENCODERS.clear)


def encoder(path: str) -> Encoder:
    """One per worker and vocabulary."""
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def pieces(documents: DataFrame, tokenizer: str, size: int = 2048) -> DataFrame:
    """One row per piece, numbered within its task and length."""
    ready(documents.sparkSession)
    end = b"\0\0\0\0"

    def run(batches):
        begin("packing")
        encode, count, task = encoder(tokenizer), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            rows = []
            for d, ids in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist())):
                ids += end
                for k in range(0, len(ids), 4 * size):
                    part = ids[k : k + 4 * size]
                    n = len(part) // 4
                    rows.append((d, k // (4 * size), k // 4, n, zlib.crc32(part), task, int(count[n])))
                    count[n] += 1
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], PIECES.replace(",", "").split()[::2])

    return documents.select("doc_id", "text").mapInArrow(run, PIECES)


def price(weights: np.ndarray, size: int, most: np.ndarray) -> dict[int, int]:
    """The multiset of lengths with sum <= size of greatest weight, each length at most most[l] times."""
    best, pick = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    for c in range(1, size + 1):
        v = best[c - 1 :: -1] + weights[1 : c + 1]
        k = int(np.argmax(v))
        best[c], pick[c] = (v[k], k + 1) if v[k] > best[c - 1] else (best[c - 1], 0)
    out: dict[int, int] = {}
    c = size
    while c > 0:
        l = int(pick[c])
        if not l:
            c -= 1
            continue
        out[l] = out.get(l, 0) + 1
        c -= l
    return {l: min(k, int(most[l])) for l, k in out.items()}


def solve(hist: dict[int, int], size: int, eps: float = 0.1, rounds: int = 300) -> list[tuple[dict[int, int], float]]:
    """Fractional covering by multiplicative weights: [(configuration, amount)], scaled to cover every length."""
    n = np.zeros(size + 1)
    for l, k in hist.items():
        n[l] = k
    have = n > 0
    y = np.where(have, np.arange(size + 1) / size, 0.0)  # the start: the linear program's area bound
    done, x = np.zeros(size + 1), {}
    for _ in range(rounds):
        live = have & (done < n)
        if not live.any():
            break
        c = price(np.where(live, y, 0.0), size, n)
        if not c:
            break
        step = min(max(1.0, eps * n[l] / k) if n[l] - done[l] > k else (n[l] - done[l]) / k for l, k in c.items())
        for l, k in c.items():
            done[l] += k * step
            y[l] *= 1 - eps * min(1.0, k * step / n[l])
        key = tuple(sorted(c.items(), reverse=True))
        x[key] = x.get(key, 0.0) + step
    return [(dict(k), v) for k, v in sorted(x.items(), key=lambda t: (-t[1], t[0]))]


def plan(hist: dict[int, int], size: int, rounds: int = 300, shares: tuple[float, ...] = (1.0, 0.95, 0.8, 0.6, 0.4, 0.2)) -> list[tuple[dict[int, int], int]]:
    """Whole sequences: [(configuration, how many)] that hold every piece exactly once.

    The amounts of the linear program are rounded down, and the rest is packed best-fit. Rounding
    down a smaller share of each amount leaves more short pieces for filling; the best share wins.
    """
    left = {l: k for l, k in hist.items() if k and l < size}
    whole = [({size: 1}, hist[size])] if hist.get(size) else []
    least = -(-sum(l * k for l, k in left.items()) // size)
    amounts, best = solve(left, size, rounds=rounds), None
    for share in shares:
        rest, out = dict(left), []
        for c, amount in amounts:
            m = min([int(amount * share), *(rest.get(l, 0) // k for l, k in c.items())])
            if m > 0:
                out.append((c, m))
                for l, k in c.items():
                    rest[l] -= m * k
        bins = _best_fit({l: k for l, k in rest.items() if k}, out, size)
        if best is None or sum(m for _, m in bins) < sum(m for _, m in best):
            best = bins
        if sum(m for _, m in best) == least:
            break
    return whole + best


def _best_fit(left: dict[int, int], full: list[tuple[dict[int, int], int]], size: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over groups of equal sequences; a group is split when only some of it is used."""
    groups: list[list] = [[dict(c), m] for c, m in full]
    free: dict[int, list[int]] = {}
    rooms: list[int] = []

    def put(g: int) -> None:
        r = size - sum(l * k for l, k in groups[g][0].items())
        if r:
            if not free.get(r):
                free[r] = []
                bisect.insort(rooms, r)
            free[r].append(g)

    for g in range(len(groups)):
        put(g)
    for l in sorted(left, reverse=True):
        need = left[l]
        while need:
            at = bisect.bisect_left(rooms, l)
            if at == len(rooms):  # no room anywhere: new sequences, as full of l as they can be
                k = size // l
                whole = need // k
                for c, m in (({l: k}, whole), ({l: need - whole * k}, 1 if need > whole * k else 0)):
                    if m:
                        groups.append([c, m])
                        put(len(groups) - 1)
                need = 0
                break
            r = rooms[at]
            g = free[r].pop()
            if not free[r]:
                rooms.pop(at)
            c, m = groups[g]
            k = min(r // l, need)
            use = min(m, need // k)
            if use < m:
                groups.append([dict(c), m - use])
                put(len(groups) - 1)
            groups[g] = [{**c, l: c.get(l, 0) + k}, use]
            put(g)
            need -= use * k
    return [(c, m) for c, m in groups]


def places(bins: list[tuple[dict[int, int], int]], size: int) -> dict[str, np.ndarray]:
    """For each length the runs of ranks and where they go; a table of at most (configurations x lengths in each) rows."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for c, m in bins:
        at = 0
        for l, k in sorted(c.items(), reverse=True):
            r = taken.get(l, 0)
            rows.append((l, r, base, k, at))
            taken[l] = r + k * m
            at += l * k
        base += m
    rows.sort()
    cols = np.asarray(rows, np.int64).reshape(-1, 5)
    return {"key": cols[:, 0] << 44 | cols[:, 1], "rank": cols[:, 1], "base": cols[:, 2], "k": cols[:, 3], "at": cols[:, 4]}


def pack(documents: DataFrame, tokenizer: str, size: int = 2048, rounds: int = 300) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    own = store(pieces(documents, tokenizer, size), "pieces")
    counts = own.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    where = places(plan(hist, size, rounds), size)
    ranked = own.join(before, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank_in_task") + F.col("before")).alias("rank"))

    def run(batches):
        for b in batches:
            l, r = (b.column(i).to_numpy() for i in (3, 5))
            i = np.searchsorted(where["key"], l << 44 | r, side="right") - 1
            d = r - where["rank"][i]
            seq, off = where["base"][i] + d // where["k"][i], where["at"][i] + d % where["k"][i] * l
            yield pa.record_batch([*(b.column(j) for j in range(5)), pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
