"""The document model as files: one JSON document per page, ground truth, recorded engine results; readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum import model as M

ENGINE_RESULTS = (
    "doc_id string, block_id string, role string, engine string, text string, html string, confidence double, token_logprobs array<double>,"
    f"lines array<struct<text:string,bbox:{M.BOX},confidence:double>>, flags array<string>, seconds double"
)


def _stem(suffix: str):
    return F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*?){suffix}$", 1).alias("stem")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Nested documents with the stem of their file; unknown fields are left out, missing ones are null."""
    return spark.read.schema(M.DOCUMENT).option("multiLine", "true").option("pathGlobFilter", "*.json").json(path).select(_stem(r"\.json"), "*")


def truth(spark: SparkSession, path: str, only: str | None = None, limit: int | None = None) -> DataFrame:
    """Ground-truth pages (*.gt.json); only: part of the name; limit: so many in order of name."""
    t = spark.read.schema(M.TRUTH).option("multiLine", "true").option("pathGlobFilter", "*.gt.json").json(path).select(_stem(r"\.gt\.json"), "*")
    if only:
        t = t.where(F.col("stem").contains(only))
    return t.orderBy("stem").limit(limit) if limit else t


def engine_results(spark: SparkSession, path: str) -> DataFrame:
    """Recorded results of recognition engines, to be replayed."""
    return spark.read.schema(ENGINE_RESULTS).json(path)


def blocks_of(docs: DataFrame, page: str = "stem") -> DataFrame:
    """A row for each block."""
    return docs.select(F.col(page).alias("doc_id"), F.explode("blocks").alias("b")).select("doc_id", "b.*")


def nested(blocks: DataFrame, page: str = "doc_id") -> DataFrame:
    """Blocks brought together again, in reading order."""
    fields = [c for c in blocks.columns if c != page]
    return blocks.groupBy(page).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("order").alias("_o"), F.col("id").alias("_i"), F.struct(*fields).alias("_b")))), lambda x: x["_b"]).alias("blocks"))


def write(docs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line; Parquet for anything that reads back."""
    docs.write.mode(mode).json(path)


def as_json(docs: DataFrame):
    """A column: the document as indented JSON."""
    return F.to_json(F.struct(*(c for c in docs.columns if c != "stem")), {"pretty": "true", "ignoreNullFields": "false"})
