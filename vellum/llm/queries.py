"""The queries op1 to op10 with their production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import decontaminate, licenses, linededup, packing, ppm, quality, simhash, topk, toxicity, warc
from vellum.llm._rt import table

SIZE = 2048


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer files are; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each benchmark item found in a document."""
    found = decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), share=0.2)
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.first_word", "m.n_words", "m.edits")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", toxicity.learnable(F.col("doc_id")))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), least_chars=40, least_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of the fuzzy matches come as JSON."""
    return licenses.scan(table(spark, sf_dir, "documents")).withColumn("spans", F.to_json("spans"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.links(table(spark, sf_dir, "documents"), shingle=3, radius=3)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), SIZE)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and probability of the better grade of every document, and whether it is selected; nothing is learnt from held-out rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", toxicity.learnable(F.col("doc_id")))
    tail, held = F.get("tails", F.lit(0)), F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "expected_grade", tail.alias("tail_probability"), (tail >= 0.5).alias("selected"))


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.crc32(F.col("doc_id").cast("string")) % 5
    out = ppm.score(table(spark, sf_dir, "documents"), F.coalesce(rest != 1, F.lit(False)))
    return out.select("doc_id", (rest == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_toxicity": op2_toxicity,
    "op3_warc": op3_warc,
    "op4_line_dedup": op4_line_dedup,
    "op5_topk": op5_topk,
    "op6_licenses": op6_licenses,
    "op7_simhash": op7_simhash,
    "op8_packing": op8_packing,
    "op9_quality": op9_quality,
    "op10_ppm": op10_ppm,
}

ORACLE = {
    "op3_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), d AS (
  SELECT page_id, strlen(payload) AS n, sha1(payload) AS digest FROM p
), k AS (
  SELECT digest, max(page_id) AS keeper FROM d WHERE n >= 1000 GROUP BY digest
)
SELECT page_id, n AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN n >= 1000 AND keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM d LEFT JOIN k ON d.digest = k.digest
""",
    "op4_line_dedup": """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT r, doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), g AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT r, doc_id, pos, line, keeper IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS dropped FROM k LEFT JOIN g ON k.key = g.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
""",
    "op5_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
""",
}
