"""Exact top-k search: tiled integer matrix products, partial selection per tile, tree merging.

Each component x becomes floor(1024 * x); the score is the integer inner product. Queries are dealt
to blocks of about `block` vectors, candidates to groups; a run of rows is one block's queries, then
one group's candidates, so a task holds one block and one tile of `tile` candidates at a time. A
tile's product is cut to the k best per query and merged with those of the tiles before it; Spark's
per-group limits merge the groups' lists before and after the last shuffle. There are as many groups
as keep all tasks of a shuffle busy, of `group` candidates at least: each block's queries go to every
group, each candidate goes to every block. Nothing is held on the driver but two counts.

Products are exact: float64 while every partial sum stays below 2**53, then 64-bit integers below
2**62, then Python integers.

Defined results: vectors that are null or empty, or hold null or non-finite components, and rows
with a null id take no part; a row never meets rows of its own id; repeated ids are separate
candidates but one query (that of the smallest vector); vectors of unequal length are compared as
if the shorter went on with zeros; fewer than k candidates give as many rows; components and scores
beyond 2**62 count as 2**62.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm._rt import ready

SCALE = 1024
MOST = 2**62
NONE = -(2**63) + 1  # below every score


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): ids and finite vectors."""
    x = F.col("embedding")
    finite = F.forall(x, lambda e: F.coalesce(~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))


def whole(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x) as integers."""
    with np.errstate(over="ignore"):
        y = np.floor(x.astype(np.float64) * SCALE)
    return np.clip(y, -float(MOST), float(MOST)).astype(np.int64)


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All components, and where each vector's begin."""
    ends = column.offsets.to_numpy()
    return whole(column.flatten().to_numpy(zero_copy_only=False)), ends - ends[0]


def _matrix(flat: np.ndarray, ends: np.ndarray, dim: int) -> np.ndarray:
    """Vectors as rows of `dim` components."""
    n = len(ends) - 1
    if n and (np.diff(ends) == dim).all():
        return flat.reshape(n, dim)
    out = np.zeros((n, dim), np.int64)
    for i in range(n):
        part = flat[ends[i] : ends[i + 1]][:dim]
        out[i, : len(part)] = part
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `scores` cut to their k best; ties to the smaller id."""
    if scores.shape[1] > k:
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
        wide = int((scores >= kth).sum(axis=1).max())  # ties at the k-th place stay until ids decide
        pick = np.argpartition(-scores, wide - 1, axis=1)[:, :wide] if wide < scores.shape[1] else np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
        ids, scores = np.take_along_axis(ids, pick, 1), np.take_along_axis(scores, pick, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def _products(q: np.ndarray, qmost: int, c: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of q and c."""
    bound = qmost * max(int(c.max()), -int(c.min()), 0) * c.shape[1] if c.size else 0
    if bound < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if bound < MOST:
        return q @ c.T
    return np.clip(q.astype(object) @ c.astype(object).T, -MOST, MOST).astype(np.int64)


class Block:
    """One block of queries and their best so far."""

    def __init__(self, k: int, tile: int):
        self.k, self.tile, self.ids, self.parts = k, tile, [], []
        self.q = None

    def add(self, ids: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> None:
        self.ids.append(ids)
        self.parts.append((flat, ends))

    def meet(self, cid: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> None:
        if not self.ids:
            return
        if self.q is None:
            ids = np.concatenate(self.ids)
            dim = max(int(np.diff(e).max()) for _, e in self.parts)
            self.q, self.own = np.concatenate([_matrix(f, e, dim) for f, e in self.parts]), ids
            self.most = max(int(self.q.max()), -int(self.q.min()), 0)
            self.top_i, self.top_s = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0), np.int64)
            self.parts = []
        c = _matrix(flat, ends, self.q.shape[1])
        for lo in range(0, len(cid), self.tile):
            i = cid[lo : lo + self.tile]
            s = _products(self.q, self.most, c[lo : lo + self.tile])
            s[self.own[:, None] == i[None, :]] = NONE
            i, s = _best(np.broadcast_to(i, s.shape), s, self.k)
            self.top_i, self.top_s = _best(np.concatenate([self.top_i, i], 1), np.concatenate([self.top_s, s], 1), self.k)

    def lists(self):
        if self.q is None:
            return
        keep = self.top_s > NONE
        at, _ = np.nonzero(keep)
        for lo in range(0, len(at), 50_000):
            part = slice(lo, lo + 50_000)
            yield pa.record_batch([pa.array(self.own[at[part]]), pa.array(self.top_i[keep][part]), pa.array(self.top_s[keep][part])], ["query_id", "vec_id", "score"])


def search(vectors: DataFrame, is_query: Column, k: int = 10, block: int = 4096, tile: int = 2048, group: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of all other rows for each row where is_query holds."""
    spark = ready(vectors.sparkSession)
    rows = usable(vectors)
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-queries.count() // block))
    groups = max(1, min(-(-rows.count() // group), -(-4 * parallel // blocks)))
    own_block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = queries.select(own_block.alias("block"), each(groups).alias("group"), F.lit(0).alias("kind"), "vec_id", "v")
    # by place and not by id, as one id may be on very many rows
    own_group = F.pmod(F.monotonically_increasing_id(), F.lit(groups)).cast("int")
    answers = rows.select(own_group.alias("group"), "vec_id", "v").select(each(blocks).alias("block"), "group", F.lit(1).alias("kind"), "vec_id", "v")
    runs = asks.unionByName(answers).repartition(parallel, "block", "group").sortWithinPartitions("block", "group", "kind")
    found = runs.mapInArrow(_searcher(k, tile), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(k: int, tile: int):
    """From runs of rows (block, group, kind, vec_id, v), a block's queries first, to the queries' lists."""

    def run(batches):
        now, held = None, Block(k, tile)
        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            ids = b.column(3).to_numpy()
            for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [b.num_rows]])):
                if hi <= lo:
                    continue
                if (keys[lo, 0], keys[lo, 1]) != now:
                    yield from held.lists()
                    now, held = (keys[lo, 0], keys[lo, 1]), Block(k, tile)
                (held.meet if keys[lo, 2] else held.add)(ids[lo:hi], *_rows(b.column(4).slice(lo, hi - lo)))
        yield from held.lists()

    return run
