"""Session helpers that the operators share: worker path, batch sizes, the shared folder."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and keep Arrow batches of long texts small."""
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a session on one machine may do without; a cluster's executors share no other folder."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/vellum-shared"


def scratch_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables are."""
    return f"{shared_dir(spark)}/vellum/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; for when its results have been written."""
    discard(spark, scratch_dir(spark))


def store(df: DataFrame, name: str, *partition_by: str, rows: int | None = None, each: int = 200_000) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors.

    rows: about how many there are at most, where that is known; so many tasks write that each has `each` of them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // each)))
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.vellum_path = path
    return out


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def sized(df: DataFrame, rows: int, most: int = 1_000_000) -> DataFrame:
    """df, to be sent to all tasks of a join if it has few rows (a count; rows are narrow), else to be shuffled."""
    return F.broadcast(df) if rows <= most else df


def release() -> None:
    """Give memory that a finished task has freed back to the system; Python workers live on for the next stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


HOLDERS: dict = {}


def holds(name: str, empty) -> None:
    """Register how the tables that an operator keeps in a worker between tasks are emptied."""
    HOLDERS[name] = empty


def begin(name: str) -> None:
    """At the start of a task: a worker that served other operators before gives up what they have kept."""
    others = [empty for k, empty in HOLDERS.items() if k != name]
    for empty in others:
        empty()
    if others:
        release()


class Memo(dict):
    """A per-worker cache of a pure function of one word; emptied when it holds `cap` entries."""

    def __init__(self, f, cap: int = 300_000):
        super().__init__()
        self.f, self.cap = f, cap

    def __missing__(self, key):
        if len(self) >= self.cap:
            self.clear()
        self[key] = v = self.f(key)
        return v
