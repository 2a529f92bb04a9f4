"""The corpus pipeline: quality selection, line dedup, near-duplicate dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import decontaminate, linededup, packing, quality, queries, simhash
from vellum.llm._rt import ready, store, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the better grade of `labels` is a half or more; the others go."""
    ready(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality")
    return quality.select(docs, model, least_tail=0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the long lines that five or more documents hold (their last holder keeps them)."""
    ready(spark)
    out = linededup.dedup(docs, least_chars=40, least_docs=5).drop("n_lines", "n_dropped")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that are near copies of one that stays: five-word shingles, similarity of 0.8 or more."""
    ready(spark)
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of `benchmark`, with up to a fifth of an item's characters in edits."""
    ready(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), share=0.2)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    ready(spark)
    return packing.pack(docs, queries.vocabulary(), queries.SIZE)


STAGES = [
    ("quality", good_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pack", pack),
]

# Models, fingerprints and packing are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
