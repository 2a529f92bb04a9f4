"""Connected components of an edge table by alternating star contraction, round by round in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm._rt import discard, store


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node reachable. rows: about how many edges there are.

    A round sends each node's larger neighbours to its smallest one, then each node's smaller
    neighbours to the smallest of these. Minima are summed before the shuffle and joined back, so a
    node with very many edges is not gathered in one task (the join back is one that Spark may split
    by the sizes of its parts). Rounds go on until nothing changes; each at least halves what is left of a path.
    """
    now = store(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges", rows=rows)
    n = now.count()
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = store(large, "edges", rows=n)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        small = store(small, "edges", rows=n)
        discard(now.sparkSession, now.vellum_path, large.vellum_path)
        now = small
        r = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == (r["n"], r["h"]):
            break
        mark = (r["n"], r["h"])
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
