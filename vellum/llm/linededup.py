"""Line dedup with levelled sorted runs of line hashes. DataFrame functions only.

Documents are split at newlines; a line's key is the line stripped of ASCII space with A-Z
lower-cased. Keys of at least `least_chars` code points are hashed to 128 bits. The hashes come in
batches, from the largest ids down. Each batch is merge-anti-joined with the sorted runs so far:
keys that no run holds are new, and their largest id in this batch is the keeper; keys that a run
holds only add to the count. Both are written as a new run, bucketed and sorted by hash, so that a
later batch joins it without moving it. When `fanout` runs of a level exist they are compacted into
one of the next level. Keys found in at least `least_docs` documents then lose all lines outside
their keeper.

A hash that a third of all documents hold is summed before it is shuffled; only (hash, id) pairs of
keys that lose lines are joined back, where Spark may split a large key.

Defined results: a null text is one empty line; an empty table gives no rows; rows that repeat an
id count as one document and are treated alike; rows without an id are not counted, are never
keepers, and lose the lines that others lose.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm._rt import discard, new_path, ready, store

SPACE = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]
RUN = "h1 long, h2 long, docs long, keeper long"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), string.ascii_uppercase, string.ascii_lowercase)


class Runs:
    """Levelled runs of (h1, h2, docs, keeper), each sorted by hash."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, list[tuple[str, str]]] = {}

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels.values() for name, _ in level]

    def _write(self, run: DataFrame, level: int) -> None:
        name, path = f"run_{uuid.uuid4().hex}", new_path(self.spark, "run")
        run.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        self.levels.setdefault(level, []).append((name, path))

    def add(self, batch: DataFrame) -> None:
        """Add one batch of distinct (h1, h2, doc_id): anti-join with every run, then a run of its own."""
        own = batch.groupBy(*KEY).agg(F.count("doc_id").alias("docs"), F.max(F.col("doc_id").cast("long")).alias("last"))
        runs = self.tables()
        if not runs:
            self._write(own.withColumnRenamed("last", "keeper"), 0)
        else:
            fresh, seen = own, None
            for run in runs:
                fresh = fresh.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
                part = own.join(run.select(*KEY).hint("merge"), KEY, "left_semi")
                seen = part if seen is None else seen.unionByName(part)
            late = seen.groupBy(*KEY).agg(F.first("docs").alias("docs")).withColumn("keeper", F.lit(None).cast("long"))
            self._write(fresh.withColumnRenamed("last", "keeper").unionByName(late), 0)
        self.compact()

    def compact(self, all_levels: bool = False) -> None:
        level = 0
        while level <= max(self.levels, default=-1):
            own = self.levels.get(level, [])
            if len(own) >= self.fanout:
                self._write(self.merged(own), level + 1)
                self.drop(own)
                self.levels[level] = []
            level += 1

    def merged(self, runs: list[tuple[str, str]] | None = None) -> DataFrame:
        """One row per hash over the given runs, or over all."""
        out = None
        for _, path in runs if runs is not None else [r for level in self.levels.values() for r in level]:
            # read as plain files: a union of bucketed tables passes for bucketed itself, which is wrong where one has empty buckets
            t = self.spark.read.schema(RUN).parquet(path)
            out = t if out is None else out.unionByName(t)
        return out.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))

    def drop(self, runs: list[tuple[str, str]] | None = None) -> None:
        for name, path in runs if runs is not None else [r for level in self.levels.values() for r in level]:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard(self.spark, path)


def hashed_lines(documents: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2) of the lines that are long enough to count."""
    parts = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    keyed = parts.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    return keyed.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def repeated(keys: DataFrame, runs: Runs, least_docs: int, batches: int) -> DataFrame:
    """(h1, h2, keeper) of the keys found in at least least_docs documents, through the runs."""
    for b in range(batches):
        runs.add(keys.where((F.col("batch") == b) & F.col("doc_id").isNotNull()).select(*KEY, "doc_id").distinct())
    return runs.merged().where(F.col("docs") >= least_docs).select(*KEY, "keeper")


def dedup(documents: DataFrame, least_chars: int = 40, least_docs: int = 5, batches: int = 4, fanout: int = 2) -> DataFrame:
    """documents with text replaced by the kept lines, and n_lines (before) and n_dropped."""
    spark = ready(documents.sparkSession)
    span = documents.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    low, high = (span["a"] or 0), (span["b"] or 0)
    width = max(1, -(-(high - low + 1) // batches))
    batch = F.least(F.lit(batches - 1), F.floor((F.lit(high) - F.coalesce(F.col("doc_id"), F.lit(low))) / width)).cast("int")
    keys = store(hashed_lines(documents, least_chars).withColumn("batch", batch), "lines", "batch")
    runs = Runs(spark, fanout)
    try:
        hot = store(repeated(keys, runs, least_docs, batches), "hot")
    finally:
        runs.drop()
    lost = keys.join(hot, KEY).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    lost = lost.groupBy(F.col("doc_id").alias("lost_id"), F.col("text_hash").alias("lost_hash")).agg(F.collect_set("pos").alias("lost_pos"))
    docs = documents.withColumn("own_hash", F.xxhash64("text"))
    both = docs.join(lost, F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("own_hash") == F.col("lost_hash")), "left")
    every = lines(F.col("text"))
    # split once: a lambda's variable holds the lines while those that stay are taken out of them
    stay = lambda held: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(held) - 1), F.col("lost_pos")), lambda i: F.get(held, i)), "\n")
    text = F.when(F.col("lost_pos").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.get(F.transform(F.array(every), stay), F.lit(0)))
    out = both.select(*(F.col(c) for c in documents.columns if c != "text"), text.alias("text"), F.size(every).cast("long").alias("n_lines"), F.coalesce(F.size("lost_pos"), F.lit(0)).cast("long").alias("n_dropped"))
    return out
