"""The catalogue of queries over the given tables, each with its SQL where SQL can express it.

The tables hold no page images, so most queries first project their rows into the shape of the
document model: an order is a page, its lines are blocks, with boxes from whole-number arithmetic
that any engine repeats exactly. `ar()` writes letters in Arabic script for a third of the texts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from vellum import model as M
from vellum.config import Vlm
from vellum.functions import geometry as G
from vellum.functions import scoring as S
from vellum.functions import text as T
from vellum.kernels import geometry as KG
from vellum.operators import evaluate as E
from vellum.operators import layout as L
from vellum.operators import order as O
from vellum.operators import post as P
from vellum.operators import tables as TB
from vellum.session import prepared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

LETTERS = "abcdefghijklmnopqrstuvwxyz"
ARABIC = "ابتثجحخدذرزسشصضطظعغفقكلمنهو"[:26]
TIE = ["l_partkey", "l_suppkey"]


def query(name: str, sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepared(spark)
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return f

    return add


def ascii_part(c: Column) -> Column:
    return F.regexp_replace(c, "[^ -~]", "")


def arabic(text: Column, doc_id: Column) -> Column:
    return F.when(doc_id % 3 == 0, F.translate(F.lower(text), LETTERS, ARABIC)).otherwise(text)


ARABIC_SQL = f"CASE WHEN doc_id % 3 = 0 THEN translate(lower(text), '{LETTERS}', '{ARABIC}') ELSE text END"
BOX_SQL = """
SELECT l_orderkey AS doc_id, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_discount, l_tax,
       CAST(l_partkey % 800 AS DOUBLE) AS x0, CAST(l_linenumber * 97 % 600 AS DOUBLE) AS y0,
       CAST(l_partkey % 800 + 40 + l_suppkey % 200 AS DOUBLE) AS x1, CAST(l_linenumber * 97 % 600 + 20 + CAST(l_quantity AS INTEGER) AS DOUBLE) AS y1
FROM lineitem"""
TYPES = ("paragraph", "title", "table", "header", "footer", "stamp", "logo")


def boxes(lineitem: DataFrame) -> DataFrame:
    x0, y0 = F.col("l_partkey") % 800, F.col("l_linenumber") * 97 % 600
    box = G.box(x0, y0, x0 + 40 + F.col("l_suppkey") % 200, y0 + 20 + F.col("l_quantity").cast("int"))
    kind = F.get(F.array(*map(F.lit, TYPES)), (F.col("l_partkey") % 7).cast("int"))
    return lineitem.select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", *TIE, "l_quantity", "l_returnflag", "l_discount", "l_tax", box.alias("bbox"), kind.alias("type"))


def block_key() -> Column:
    return F.concat_ws("-", "l_linenumber", *TIE)


KEY_SQL = "concat_ws('-', l_linenumber, l_partkey, l_suppkey)"


# ---- evaluation ----

# Every line of every text is a block, and its hypothesis has some letters read wrong or missed. SQL counts edits of bytes,
# so there letters with accents become single bytes first, one for one; edits of texts in Arabic letters are those of the letters
# that were replaced.
ACCENTED = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöüáúàâîôûëïÁÀÂ"
BYTES_SQL = "translate({}, '" + ACCENTED + "', " + " || ".join(f"chr({c})" for c in [*range(1, 10), *range(11, 32)][: len(ACCENTED)]) + ")"
LINES_SQL = f"""
SELECT doc_id, lang, source, pos, CASE WHEN doc_id % 3 = 0 THEN lower(line) ELSE line END AS ref FROM (
  SELECT doc_id, lang, source, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS ls FROM documents))"""
FACTS_SQL = f"""
SELECT *, levenshtein({BYTES_SQL.format("ref")}, {BYTES_SQL.format("hyp")}) AS edits FROM (
  SELECT *, translate(replace(ref, 'o', ''), 'aei', 'eao') AS hyp FROM ({LINES_SQL}))"""


def lines_of(get) -> DataFrame:
    d = get("documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return d.select("doc_id", "lang", "source", "pos", arabic(F.col("line"), F.col("doc_id")).alias("ref"))


def facts(get) -> DataFrame:
    """One row for each line of each text, a third of the texts in Arabic letters."""
    a, e, i, o = (ARABIC[LETTERS.index(c)] for c in "aeio")
    # counting edits costs far more than moving a line, and one text may hold very many lines: they are dealt anew
    lines = lines_of(get).repartition("doc_id", "pos")
    return lines.withColumn("hyp", F.translate("ref", f"aei{a}{e}{i}o{o}", f"eao{e}{a}{o}"))


@query(
    "q01_error_rates",
    f"""
SELECT lang, source, count(*) AS n, CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(length(ref)) AS BIGINT) AS chars, sum(edits) / greatest(sum(length(ref)), 1) AS cer
FROM ({FACTS_SQL}) GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())
""",
)
def error_rates(get):
    """Flagship: character error rates of all lines by language and source, for all groupings in one pass; edits are counted before rows are multiplied."""
    f = facts(get).select("lang", "source", S.edits(F.col("ref"), F.col("hyp")).alias("e"), F.char_length("ref").alias("c"))
    f = f.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("e").alias("e"), F.sum("c").alias("c"))
    edits, chars = F.sum("e"), F.sum("c")
    return f.groupingSets([[F.col("lang")], [F.col("source")], [F.col("lang"), F.col("source")], []], F.col("lang"), F.col("source")).agg(
        F.sum("n").alias("n"), edits.cast("long").alias("edits"), chars.cast("long").alias("chars"), (edits / F.greatest(chars, F.lit(1))).alias("cer")
    )


@query(
    "q02_normalised_text",
    r"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(t, '[\x{200e}\x{200f}\x{061c}\x{202a}-\x{202e}\x{2066}-\x{2069}\x{feff}]', '', 'g'), '[\s\x{0b}\x{85}\p{Z}]+', ' ', 'g'), ' ')) AS squeezed,
       md5(regexp_replace(t, '[\p{P}\s\x{0b}\x{85}\p{Z}\x{200e}\x{200f}\x{061c}\x{202a}-\x{202e}\x{2066}-\x{2069}\x{feff}\x{640}\x{610}-\x{61a}\x{64b}-\x{65f}\x{670}\x{6d6}-\x{6ed}]', '', 'g')) AS comparable
FROM (SELECT doc_id, replace(text, ' the ', ' ' || chr(8207) || 'the  ') AS t FROM documents)
""",
)
def normalised_text(get):
    t = F.replace(F.col("text"), F.lit(" the "), F.lit(" ‏the  "))
    return get("documents").select("doc_id", F.md5(T.squeeze(t, compose=False)).alias("squeezed"), F.md5(T.comparable(t, compose=False)).alias("comparable"))


@query("q03_composed", "SELECT doc_id, md5(nfc_normalize(replace(text, 'e', 'e' || chr(769)))) AS composed FROM documents")
def composed(get):
    return get("documents").select("doc_id", F.md5(T.nfc(F.replace(F.col("text"), F.lit("e"), F.lit("e\u0301")))).alias("composed"))


RTL_SQL = "length(regexp_replace(t, '[^\\x{620}-\\x{64a}\\x{5d0}-\\x{5ea}]', '', 'g'))"
LTR_SQL = "length(regexp_replace(t, '[^A-Za-z]', '', 'g'))"


@query(
    "q04_scripts",
    f"""
WITH d AS (SELECT doc_id, {ARABIC_SQL} AS t FROM documents), c AS (SELECT doc_id, {RTL_SQL} AS r, {LTR_SQL} AS l FROM d)
SELECT doc_id, r AS rtl, l AS latin,
       CASE WHEN r + l = 0 THEN NULL WHEN l <= 0.05 * (r + l) THEN 'ar' WHEN r <= 0.05 * (r + l) THEN 'en' ELSE 'mixed' END AS lang,
       CASE WHEN r + l = 0 OR r >= l THEN 'rtl' ELSE 'ltr' END AS direction
FROM c
""",
)
def scripts(get):
    t = arabic(F.col("text"), F.col("doc_id"))
    d = get("documents").select("doc_id", T.count_rtl(t).cast("long").alias("rtl"), T.count_latin(t).cast("long").alias("latin"))  # each text is counted once
    return d.select("doc_id", "rtl", "latin", T.language_of(F.col("rtl"), F.col("latin")).alias("lang"), T.direction_of(F.col("rtl"), F.col("latin")).alias("direction"))


@query(
    "q05_page_direction",
    f"""
WITH d AS (
  SELECT conv_id, role, CASE WHEN (conv_id + turn) % 3 = 0 THEN translate(lower(text), '{LETTERS}', '{ARABIC}') ELSE text END AS t FROM conversations
), c AS (
  SELECT conv_id, sum({RTL_SQL} * CASE WHEN role = 'system' THEN 3 ELSE 10 END) AS r, sum({LTR_SQL} * CASE WHEN role = 'system' THEN 3 ELSE 10 END) AS l FROM d GROUP BY conv_id
)
SELECT conv_id, CASE WHEN r + l = 0 OR r >= l THEN 'rtl' ELSE 'ltr' END AS page_direction FROM c
""",
)
def page_direction(get):
    c = get("conversations")
    t = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.translate(F.lower("text"), LETTERS, ARABIC)).otherwise(F.col("text"))
    return P.page_directions(c.select("conv_id", F.when(F.col("role") == "system", "header").otherwise("paragraph").alias("type"), t.alias("text")), "conv_id")


def order_text(get) -> DataFrame:
    o = get("orders")
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    line = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Date: "), day)).otherwise(F.concat(F.lit("Date: "), T.arabic_digits(day)))
    return o.select("o_orderkey", "o_custkey", "o_orderdate", line.alias("date_line"), F.concat(F.lit("Ref. No.: "), F.col("o_custkey"), F.lit("/"), F.col("o_orderkey")).alias("ref_line"))


@query("q06_dates", "SELECT o_orderkey, 'gregorian' AS calendar, strftime(o_orderdate, '%Y-%m-%d') AS normalized, 1 AS n FROM orders")
def find_dates(get):
    d = order_text(get).withColumn("d", T.dates(F.col("date_line"), F.col("o_orderkey").cast("string")))
    return d.select("o_orderkey", F.col("d")[0].calendar.alias("calendar"), F.col("d")[0].normalized.alias("normalized"), F.size("d").alias("n"))


@query("q07_document_numbers", "SELECT o_orderkey, 'Ref. No.: ' || o_custkey || '/' || o_orderkey AS raw, o_custkey || '/' || o_orderkey AS value_latin, 'reference' AS role FROM orders")
def document_numbers(get):
    d = order_text(get).select("o_orderkey", F.explode(T.doc_numbers(F.col("ref_line"), F.lit("b"), F.lit(False))).alias("n"))
    return d.select("o_orderkey", "n.raw", "n.value_latin", "n.role")


@query(
    "q08_refined_types",
    """
SELECT kind, refined, count(*) AS n FROM (
  SELECT 'date' AS kind, 'date' AS refined FROM orders
  UNION ALL SELECT 'number', 'doc_number' FROM orders
  UNION ALL SELECT 'both', CASE WHEN length('Ref. No.: ' || o_custkey || '/' || o_orderkey || ', on ' || strftime(o_orderdate, '%d/%m/%Y') || repeat(' and so on', CAST(o_orderkey % 6 AS INTEGER))) <= 70 THEN 'doc_number' ELSE 'paragraph' END FROM orders
  UNION ALL SELECT 'many lines', 'title' FROM orders
  UNION ALL SELECT 'table', 'table' FROM orders
  UNION ALL SELECT 'text', 'paragraph' FROM documents
) GROUP BY kind, refined
""",
)
def refined_types(get):
    o, day = order_text(get), F.date_format("o_orderdate", "dd/MM/yyyy")
    row = lambda kind, text, was="paragraph": o.select(F.lit(kind).alias("kind"), text.alias("t"), F.lit(was).alias("was"))
    long = F.concat(F.col("ref_line"), F.lit(", on "), day, F.expr("repeat(' and so on', CAST(o_orderkey % 6 AS INT))"))
    rows = row("date", F.col("date_line")).unionByName(row("number", F.col("ref_line"))).unionByName(row("both", long))
    rows = rows.unionByName(row("many lines", F.concat("ref_line", F.lit("\n"), "date_line"), "title")).unionByName(row("table", F.col("ref_line"), "table"))
    rows = rows.unionByName(get("documents").select(F.lit("text").alias("kind"), F.concat(F.lit("about "), "text").alias("t"), F.lit("paragraph").alias("was")))
    return rows.groupBy("kind", T.refined_type(F.col("was"), F.col("t")).alias("refined")).agg(F.count("*").alias("n"))


@query(
    "q09_split_lines",
    """
SELECT o_orderkey, o_orderkey || '_0' AS id, 'doc_number' AS type, 0.0::DOUBLE AS y0, 20.0::DOUBLE AS y1 FROM orders
UNION ALL SELECT o_orderkey, o_orderkey || '_1', 'date', 20.0, 40.0 FROM orders
""",
)
def split_lines(get):
    o = order_text(get).select("o_orderkey", F.col("o_orderkey").cast("string").alias("id"), F.lit("paragraph").alias("type"), F.concat("ref_line", F.lit("\n"), "date_line").alias("text"), G.box(0, 0, 100, 40).alias("bbox"))
    return P.split_lines(o).select("o_orderkey", "id", "type", F.col("bbox.y0").alias("y0"), F.col("bbox.y1").alias("y1"))


BARE_SQL = r"regexp_replace({}, '[\p{{P}}\s]', '', 'g')"


@query(
    "q10_agreement",
    f"""
WITH b AS (SELECT doc_id, pos, {BARE_SQL.format("ref")} AS a, {BARE_SQL.format("translate(replace(ref, 'o', ''), 'aei', 'eao')")} AS b FROM ({LINES_SQL}))
SELECT doc_id, pos, CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE 1 - levenshtein({BYTES_SQL.format("a")}, {BYTES_SQL.format("b")}) / greatest(length(a), length(b)) END AS agree FROM b
""",
)
def agreement(get):
    """Agreement of two readings of every line."""
    return facts(get).select("doc_id", "pos", S.agreement(F.col("ref"), F.col("hyp"), compose=False, edits=S.edits).alias("agree"))


@query(
    "q11_block_scores",
    """
WITH s AS (
  SELECT l_returnflag, l_linestatus, CASE WHEN l_returnflag = 'R' THEN NULL ELSE 1 - CAST(round(l_discount * 100) AS INTEGER) / 100.0::DOUBLE END AS conf,
         CASE WHEN l_linestatus = 'O' THEN NULL ELSE CAST(round(l_tax * 100) AS INTEGER) / 8.0::DOUBLE END AS agree, l_linenumber FROM lineitem
), r AS (
  SELECT *, CASE WHEN agree IS NULL THEN coalesce(conf, 0.5) ELSE 0.6::DOUBLE * coalesce(conf, 0.5) + 0.4::DOUBLE * agree END - CASE WHEN l_linenumber = 4 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END AS s0 FROM s
), t AS (
  SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN l_linenumber = 5 THEN least(s0, 0.2::DOUBLE) ELSE s0 END)) AS s1 FROM r
)
SELECT l_linenumber, l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (WHERE s1 < 0.7499 OR l_linenumber = 4) AS low, CAST(sum(round(s1 * 1000)) AS BIGINT) AS total
FROM t WHERE abs(s1 - 0.75) > 0.0002 AND abs(s1 * 1000 - floor(s1 * 1000) - 0.5) > 0.001 GROUP BY ALL
""",
)
def block_scores(get):
    conf = F.when(F.col("l_returnflag") == "R", None).otherwise(1 - F.round(F.col("l_discount") * 100).cast("int") / 100.0)
    agree = F.when(F.col("l_linestatus") == "O", None).otherwise(F.round(F.col("l_tax") * 100).cast("int") / 8.0)
    kind = F.when(F.col("l_linenumber") == 4, "handwritten_note").otherwise("paragraph")
    text = F.when(F.col("l_linenumber") == 5, " ").otherwise("some text")
    d = get("lineitem").select("l_linenumber", "l_returnflag", "l_linestatus", S.raw_block_score(kind, text, conf, agree).alias("s"), S.score_block(kind, text, F.lit(None).cast("string"), conf, agree, F.array().cast("array<string>")).alias("b"))
    d = d.where((F.abs(F.col("s") - 0.75) > 0.0002) & (F.abs(F.col("s") * 1000 - F.floor(F.col("s") * 1000) - 0.5) > 0.001))
    return d.groupBy("l_linenumber", "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_if("b.needs_review").alias("low"), F.sum(F.round(F.col("s") * 1000)).cast("long").alias("total"))


REVIEW_SQL = f"""
WITH b AS (
  SELECT l_orderkey AS doc_id, l_linenumber, l_partkey, l_suppkey, {KEY_SQL} AS id, CASE l_partkey % 7 {" ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(TYPES))} END AS type,
         128 - 4 * CAST(round(l_discount * 100) AS BIGINT) AS c, CAST(l_quantity AS BIGINT) AS n, l_discount > 0.085 AS flag FROM lineitem
), p AS (
  SELECT doc_id, sum(c * n) FILTER (WHERE type NOT IN ('stamp', 'logo'))::BIGINT AS t, 128 * sum(n) FILTER (WHERE type NOT IN ('stamp', 'logo'))::BIGINT AS d,
         list(id || '(' || type || ')' ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (WHERE flag) AS f FROM b GROUP BY doc_id
), r AS (
  SELECT doc_id, CASE WHEN d IS NULL THEN 0.0 ELSE (t * 10000 // d + CASE WHEN 2 * (t * 10000 % d) > d OR (2 * (t * 10000 % d) = d AND (t * 10000 // d) % 2 = 1) THEN 1 ELSE 0 END) / 10000.0 END AS page_score,
         [CASE WHEN f IS NOT NULL THEN len(f) || ' block(s) need review: ' || list_aggregate(f[1:12], 'string_agg', ', ') END,
          CASE WHEN coalesce(t * 100 < 85 * d, true) THEN 'page score ' || printf('%.2f', coalesce(t / d, 0.0)) || ' < 0.85' END, CASE WHEN d IS NULL THEN 'no text recognized' END] AS why FROM p
)
"""


def reviewed_pages(get) -> DataFrame:
    """The operator over every order's page; confidences are whole 128ths, so that both engines agree to the last bit."""
    conf = (128 - 4 * F.round(F.col("l_discount") * 100)) / 128.0
    b = boxes(get("lineitem")).select("doc_id", "type", F.expr("repeat('x', CAST(l_quantity AS INT))").alias("text"), conf.alias("confidence"), (F.col("l_discount") > 0.085).alias("needs_review"), F.struct("l_linenumber", *TIE).alias("order"), block_key().alias("id"))
    return P.page_review(b)


@query("q12_page_review", REVIEW_SQL + "SELECT doc_id, page_score, len(list_filter(why, lambda x: x IS NOT NULL)) > 0 AS needs_review FROM r")
def page_review(get):
    return reviewed_pages(get).select("doc_id", "page_score", "needs_review")


@query("q12b_page_review_reasons", REVIEW_SQL + "SELECT doc_id, coalesce(list_aggregate(list_filter(why, lambda x: x IS NOT NULL), 'string_agg', '; '), '') AS reasons FROM r")
def page_review_reasons(get):
    return reviewed_pages(get).select("doc_id", F.array_join("reasons", "; ").alias("reasons"))


INTER_SQL = "greatest(0.0::DOUBLE, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0::DOUBLE, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
TOUCH_SQL = "a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"


@query(
    "q13_containment",
    f"""
WITH t AS ({BOX_SQL}), k AS (SELECT *, {KEY_SQL} AS id FROM t)
SELECT a.doc_id, a.id AS inner_id, b.id AS outer_id FROM k a JOIN k b ON a.doc_id = b.doc_id AND {TOUCH_SQL} AND a.id <> b.id
WHERE {INTER_SQL} >= 0.5 * ((a.x1 - a.x0) * (a.y1 - a.y0))
""",
)
def containment(get):
    b = boxes(get("lineitem")).withColumn("id", block_key()).select("doc_id", "id", "bbox")
    pairs = L.contained_pairs(b, b, 0.5).where("a.id <> b.id")
    return pairs.select("doc_id", F.col("a.id").alias("inner_id"), F.col("b.id").alias("outer_id"))


def _iou_sql(how: str) -> str:
    return f"""
WITH t AS ({BOX_SQL}), k AS (SELECT *, {KEY_SQL} AS id, l_partkey % 7 AS kind FROM t)
SELECT a.doc_id, a.id FROM k a WHERE {how} (
  SELECT 1 FROM (SELECT doc_id, kind, x0 + 15 AS x0, y0 + 5 AS y0, x1 + 15 AS x1, y1 + 5 AS y1 FROM k WHERE l_suppkey % 2 = 0) b
  WHERE a.doc_id = b.doc_id AND a.kind = b.kind AND {TOUCH_SQL}
    AND {INTER_SQL} > 0.25 * ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {INTER_SQL}))
"""


def _iou(get, how: str) -> DataFrame:
    a = boxes(get("lineitem")).withColumn("id", block_key())
    o = F.col("bbox")
    b = a.where("l_suppkey % 2 = 0").select("doc_id", "type", G.box(o.x0 + 15, o.y0 + 5, o.x1 + 15, o.y1 + 5).alias("bbox"))
    return L.matched(a, b, how).select("doc_id", "id")


@query("q14_iou_matched", _iou_sql("EXISTS"))
def iou_matched(get):
    return _iou(get, "left_semi")


@query("q14b_iou_missed", _iou_sql("NOT EXISTS"))
def iou_missed(get):
    return _iou(get, "left_anti")


@query(
    "q15_tiled",
    f"""
WITH t AS ({BOX_SQL}), k AS (SELECT *, {KEY_SQL} AS id FROM t)
SELECT b.doc_id, b.id, count(*) AS inner_boxes, sum({INTER_SQL}) AS covered,
       count(*) >= 2 AND sum({INTER_SQL}) > 0.6 * max((b.x1 - b.x0) * (b.y1 - b.y0)) AS tiled
FROM k a JOIN k b ON a.doc_id = b.doc_id AND {TOUCH_SQL} AND a.id <> b.id
WHERE {INTER_SQL} > 0.5 * ((a.x1 - a.x0) * (a.y1 - a.y0)) GROUP BY b.doc_id, b.id
""",
)
def tiled(get):
    b = boxes(get("lineitem")).withColumn("id", block_key()).withColumn("type", F.lit("paragraph")).select("doc_id", "id", "type", "bbox")
    areas = b.select("doc_id", "id", F.greatest(G.area(F.col("bbox")), F.lit(1.0)).alias("a"))
    return L.tiled_by(b).join(areas, ["doc_id", "id"]).select("doc_id", "id", F.col("inner").alias("inner_boxes"), F.round(F.col("cover") * F.col("a")).alias("covered"), "tiled")


@query(
    "q16_islands",
    f"""
WITH t AS ({BOX_SQL}), m AS (
  SELECT *, max(x1) OVER (PARTITION BY doc_id ORDER BY x0, x1, l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM t
)
SELECT doc_id, {KEY_SQL} AS id, CAST(sum(CASE WHEN reach IS NULL OR x0 > reach + 10 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY x0, x1, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM m
""",
)
def islands(get):
    b = boxes(get("lineitem"))
    return L.islands(b, ["doc_id"], F.col("bbox.x0"), F.col("bbox.x1"), ["l_linenumber", *TIE], 10.0).select("doc_id", block_key().alias("id"), "grp")


@query(
    "q17_clusters",
    """
WITH v AS (SELECT o_custkey, o_orderkey, floor(o_totalprice)::BIGINT AS v FROM orders), s AS (
  SELECT *, CASE WHEN v - lag(v) OVER (PARTITION BY o_custkey ORDER BY v, o_orderkey) <= 20000 THEN 0 ELSE 1 END AS step FROM v
), c AS (
  SELECT *, sum(step) OVER (PARTITION BY o_custkey ORDER BY v, o_orderkey ROWS UNBOUNDED PRECEDING) AS cluster FROM s
)
SELECT o_custkey, CAST(cluster AS BIGINT) AS cluster, sum(v)::BIGINT / count(*) AS center, count(*) AS n FROM c GROUP BY o_custkey, cluster
""",
)
def clusters(get):
    return L.clusters(get("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], F.floor("o_totalprice").cast("long"), 20000, ["o_orderkey"])


@query(
    "q18_ids_and_gaps",
    f"""
WITH t AS ({BOX_SQL}), r AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y0, l_linenumber, l_partkey, l_suppkey) AS n,
         last_value(CASE WHEN l_partkey % 7 <> 5 THEN y1 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY y0, l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bottom FROM t
)
SELECT doc_id, 'b' || lpad(CAST(n AS VARCHAR), 3, '0') AS id, {KEY_SQL} AS line,
       round(CASE WHEN bottom IS NULL THEN 0.0 ELSE least(greatest((y0 - bottom) / 8.0 * 2.83465 * 0.6, 0.0), 30.0) END, 6) AS gap_pt FROM r
""",
)
def ids_and_gaps(get):
    b = boxes(get("lineitem")).withColumn("y0", F.col("bbox.y0")).withColumn("px_per_mm", F.lit(8.0))
    b = O.gap_above(O.numbered(b, by=("y0", "l_linenumber", *TIE)))
    return b.select("doc_id", "id", block_key().alias("line"), F.round("gap_pt", 6).alias("gap_pt"))


@F.arrow_udf(IntegerType())
def shaded_prefix(dark: pa.Array) -> pa.Array:
    """How many rows at the top of a drawn table are headers: a table with these rows shaded is drawn, plain paper below it, and measured."""
    out = []
    for rows in dark.to_pylist():
        picture = np.full((24 * len(rows) + 12, 40, 3), 255, np.uint8)
        for k, shaded in enumerate(rows):
            if shaded:
                picture[12 * k : 12 * k + 12] = 205
        out.append(KG.shaded_rows(picture, [(12 * k, 12 * k + 12) for k in range(len(rows))]))
    return pa.array(out, pa.int32())


@query(
    "q19_header_prefix",
    f"""
SELECT l_orderkey AS doc_id, {KEY_SQL} AS id, bool_and(l_returnflag <> 'R') OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS header FROM lineitem
""",
)
def header_prefix(get):
    """Rows of a drawn table that are headers: each order is a picture whose rows are shaded where the flag is not R."""
    d = get("lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", *TIE, (F.col("l_returnflag") != "R").alias("dark")))).alias("rows"))
    d = d.withColumn("n", shaded_prefix(F.transform("rows", lambda r: r.dark)))
    d = d.select("doc_id", "n", F.posexplode("rows").alias("at", "r"))
    return d.select("doc_id", F.concat_ws("-", "r.l_linenumber", *(f"r.{c}" for c in TIE)).alias("id"), (F.col("at") < F.col("n")).alias("header"))


@query(
    "q20_row_order",
    f"""
WITH t AS ({BOX_SQL})
SELECT doc_id, {KEY_SQL} AS id, row_number() OVER (PARTITION BY doc_id ORDER BY round_even(y0 / 20, 0), CASE WHEN doc_id % 2 = 0 THEN -x1 ELSE x0 END, l_linenumber, l_partkey, l_suppkey) AS place FROM t
""",
)
def row_order(get):
    b, o = boxes(get("lineitem")), F.col("bbox")
    keys = O.row_order(o.x0, o.y0, o.x1, F.when(F.col("doc_id") % 2 == 0, "rtl").otherwise("ltr"))
    return b.select("doc_id", block_key().alias("id"), F.row_number().over(Window.partitionBy("doc_id").orderBy(*keys, "l_linenumber", *TIE)).cast("long").alias("place"))


@query("q21_reading_order")
def reading_order(get):
    """Recursive cuts of every page."""
    b = boxes(get("lineitem")).withColumn("id", block_key()).withColumn("page_direction", F.when(F.col("doc_id") % 2 == 0, "rtl").otherwise("ltr"))
    return O.ordered(b).select("doc_id", "id", "type", "order")


@query("q21b_deduped_regions")
def deduped_regions(get):
    """Overlapping detections of every page resolved."""
    b = boxes(get("lineitem")).select("doc_id", block_key().alias("id"), "type", "bbox", (1 - F.col("l_discount")).alias("score"))
    return L.deduped(b)


@query("q21c_line_groups")
def line_groups(get):
    b = boxes(get("lineitem")).select("doc_id", block_key().alias("id"), "bbox")
    return L.line_groups(b)


@query(
    "q22_order_correlation",
    f"""
WITH t AS ({BOX_SQL}), k AS (SELECT doc_id, {KEY_SQL} AS id, row_number() OVER (PARTITION BY doc_id ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, y0 FROM t)
SELECT a.doc_id, CAST(sum(sign(b.y0 - a.y0)) AS DOUBLE) / nullif(count(*) FILTER (WHERE a.y0 <> b.y0), 0) AS tau
FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.n < b.n GROUP BY a.doc_id HAVING count(*) FILTER (WHERE a.y0 <> b.y0) > 0
""",
)
def order_correlation(get):
    b = boxes(get("lineitem")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", *TIE, F.col("bbox.y0").cast("int").alias("y")))).alias("r"))
    return b.select("doc_id", S.kendall_tau(F.transform("r", lambda x: x.y)).alias("tau")).where("tau is not null")


@query(
    "q23_direction_hint",
    f"""
WITH t AS ({BOX_SQL}), s AS (
  SELECT doc_id, count(*) AS n, sum(x0) AS s0, sum(x0 * x0) AS q0, sum(x1) AS s1, sum(x1 * x1) AS q1 FROM t WHERE x1 - x0 > 0.35 * 290 GROUP BY doc_id HAVING count(*) >= 3
), v AS (SELECT doc_id, n * q0 - s0 * s0 AS l, n * q1 - s1 * s1 AS r FROM s)
SELECT doc_id, CASE WHEN r < 0.36 * l THEN 'rtl' WHEN l < 0.36 * r THEN 'ltr' END AS hint FROM v
""",
)
def direction_hint(get):
    return O.direction_hint(boxes(get("lineitem")).withColumn("page_w", F.lit(290.0)))


@query(
    "q24_body_size",
    f"""
WITH b AS (
  SELECT l_orderkey AS doc_id, {KEY_SQL} AS id, l_partkey % 7 AS kind, CAST(l_quantity AS INTEGER)::DOUBLE AS s FROM lineitem
), m AS (
  SELECT doc_id, list_sort(list(s) FILTER (WHERE kind = 0)) AS q FROM b GROUP BY doc_id
), j AS (
  SELECT b.*, q[len(q) // 2 + 1] AS med FROM b JOIN m ON b.doc_id = m.doc_id
)
SELECT doc_id, id, kind = 1 AS bold, CASE WHEN med IS NULL THEN s WHEN kind = 0 AND abs(s - med) > 0.25::DOUBLE * med THEN med WHEN kind = 1 THEN least(greatest(s, med), med * 1.6::DOUBLE) ELSE s END AS size_pt FROM j
""",
)
def body_size(get):
    """Sizes of all blocks, body text brought to its page's upper median; line heights are chosen to give whole points."""
    b = boxes(get("lineitem"))
    height = (F.col("l_quantity").cast("int") + 0.1) / 2.83465 * (1000.0 / 200.0)
    b = b.select("doc_id", block_key().alias("id"), "type", "bbox", F.lit("some text").alias("text"), F.lit("en").alias("lang"), height.alias("line_height_px"), F.lit(1000.0).alias("page_w"), F.lit(200.0).alias("width_mm"), F.lit("ltr").alias("page_direction"))
    return P.styled(b).select("doc_id", "id", F.coalesce("style.bold", F.lit(False)).alias("bold"), "style.size_pt")


LABEL_SQL = "CASE lower(split_part(p_type, ' ', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.LABEL_MAP.items()) + " ELSE 'paragraph' END"


@query("q25_labels", f"SELECT p_partkey, {LABEL_SQL} AS type, CASE p_size % 4 WHEN 0 THEN 'stamp' WHEN 1 THEN 'table' WHEN 2 THEN 'footer' ELSE 'paragraph' END AS mapped FROM part")
def labels(get):
    label = F.get(F.array(*map(F.lit, ("seal", "table", "number", "no such label"))), F.col("p_size") % 4)
    return get("part").select("p_partkey", L.typed(F.lower(F.split("p_type", " ")[0])).alias("type"), L.typed(label).alias("mapped"))


@query(
    "q26_logprob_confidence",
    """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: -abs(CAST(x AS DOUBLE)) * 4) AS lp FROM embeddings)
SELECT vec_id, round(greatest(0.0, least(1.0, exp(list_sum(lp) / len(lp)) - 0.5 * len(list_filter(lp, lambda x: x < ln(0.5))) / len(lp))), 9) AS confidence FROM e
""",
)
def logprob_confidence(get):
    lp = F.transform("embedding", lambda x: -F.abs(x.cast("double")) * 4)
    return get("embeddings").select("vec_id", F.round(S.logprob_confidence(lp), 9).alias("confidence"))


@query(
    "q27_token_budget",
    f"""
WITH t AS ({BOX_SQL}), n AS (
  SELECT doc_id, {KEY_SQL} AS id, greatest(1.0::DOUBLE, (y1 - y0) / (1.25::DOUBLE * 18.0::DOUBLE)) * greatest(4.0::DOUBLE, (x1 - x0) / (0.45::DOUBLE * 18.0::DOUBLE)) * 0.55::DOUBLE * {{factor}}::DOUBLE AS n, l_partkey % 7 = 2 AS wide FROM t
)
SELECT doc_id, id, CAST(floor(least(greatest(CASE WHEN wide THEN n * 3 ELSE n END + 16, 32.0::DOUBLE), 2048.0::DOUBLE)) AS INTEGER) AS tokens FROM n
""".replace("{factor}", str(Vlm().tokens_per_line_factor)),
)
def token_budget(get):
    """The operator over every box, for lines of 18 pixels."""
    o = F.col("bbox")
    return boxes(get("lineitem")).select("doc_id", block_key().alias("id"), S.token_budget(G.width(o), G.height(o), F.col("type"), F.lit(18.0)).alias("tokens"))


def nation_cells(get) -> DataFrame:
    n = get("nation").join(get("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    w = Window.partitionBy("r_regionkey").orderBy("n_nationkey")
    n = n.withColumn("row", (F.row_number().over(w) - 1).cast("int")).withColumn("size", F.count("*").over(Window.partitionBy("r_regionkey")).cast("int"))
    cell = lambda c, text, span, header: F.struct(F.col("row"), F.lit(c).alias("col"), span.cast("int").alias("rowspan"), F.lit(1).alias("colspan"), text.alias("text"), F.lit(header).alias("header"))
    both = F.when(F.col("row") == 0, F.array(cell(0, F.col("r_name"), F.col("size"), True), cell(1, F.col("n_name"), F.lit(1), False))).otherwise(F.array(cell(1, F.col("n_name"), F.lit(1), False)))
    return n.groupBy("r_regionkey").agg(F.flatten(F.collect_list(both)).alias("cells"))


@query(
    "q28_table_round_trip",
    """
WITH n AS (SELECT r_regionkey, r_name, n_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS row, count(*) OVER (PARTITION BY r_regionkey) AS size FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT r_regionkey, CAST(row AS INTEGER) AS row, 1 AS col, 1 AS rowspan, n_name AS text, false AS header FROM n
UNION ALL SELECT r_regionkey, 0, 0, CAST(size AS INTEGER), r_name, true FROM n WHERE row = 0
""",
)
def table_round_trip(get):
    """Cells to HTML and back."""
    g = nation_cells(get).select("r_regionkey", TB.html_of(F.col("cells")).alias("html"))
    return TB.cells_of(g, "r_regionkey", "html").select("r_regionkey", "row", "col", "rowspan", "text", "header")


@query(
    "q29_table_similarity",
    """
WITH n AS (SELECT r_regionkey, r_name, n_name, n_nationkey, replace(n_name, 'A', 'E') AS hyp FROM nation JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT r_regionkey, -1 AS k, r_name AS ref FROM n GROUP BY r_regionkey, r_name UNION ALL SELECT r_regionkey, n_nationkey, n_name FROM n)
SELECT r_regionkey, round(1 - sum((length(ref) - length(replace(ref, 'A', ''))) / length(ref)) / (2 * count(*)), 9) AS teds, 1.0::DOUBLE AS teds_s, string_agg(replace(ref, 'A', 'E'), ' ' ORDER BY k) AS plain FROM c GROUP BY r_regionkey
""",
)
def table_similarity(get):
    """A table against itself with a letter read wrong: a cell costs its share of wrong letters, and there is a node for each cell, row and the table."""
    h = nation_cells(get).select("r_regionkey", TB.html_of(F.col("cells")).alias("ref"))
    h = h.withColumn("hyp", F.regexp_replace("ref", "A", "E"))
    return h.select("r_regionkey", F.round(TB.teds_column(F.col("ref"), F.col("hyp")), 9).alias("teds"), TB.teds_column(F.col("ref"), F.col("hyp"), True).alias("teds_s"), TB.plain_column(F.col("hyp")).alias("plain"))


@query(
    "q30_metadata",
    """
SELECT o_custkey AS doc_id, list(o_custkey || '/' || o_orderkey ORDER BY o_orderkey) AS numbers, list(strftime(o_orderdate, '%Y-%m-%d') ORDER BY o_orderkey) AS dates FROM orders GROUP BY o_custkey
""",
)
def metadata(get):
    o = order_text(get).select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("order"), F.col("o_orderkey").cast("string").alias("id"), F.lit("paragraph").alias("type"), F.lit("en").alias("lang"), F.concat("ref_line", F.lit(" "), "date_line").alias("text"))
    m = P.metadata(o)
    return m.select("doc_id", F.transform("doc_numbers", lambda n: n.value_latin).alias("numbers"), F.transform("dates", lambda d: d.normalized).alias("dates"))


@query(
    "q31_date_overlap",
    """
WITH d AS (
  SELECT o_custkey, list_distinct(list(strftime(o_orderdate, '%Y-%m-%d')) FILTER (WHERE o_orderkey % 4 > 0)) AS a, list_distinct(list(strftime(o_orderdate, '%Y-%m-%d')) FILTER (WHERE o_orderkey % 3 > 0)) AS b,
         list_distinct(list(o_custkey || '/' || o_orderkey) FILTER (WHERE o_orderkey % 5 > 0)) AS n FROM orders GROUP BY o_custkey
)
SELECT CAST(o_custkey AS VARCHAR) AS stem, len(list_intersect(coalesce(a, []), coalesce(b, []))) AS dates_found, len(coalesce(a, [])) AS dates_total, len(coalesce(n, [])) AS docno_found, len(coalesce(n, [])) AS docno_total FROM d
""",
)
def date_overlap(get):
    """What the evaluation finds of the dates and numbers of a page: a customer's orders are the page's blocks, and some are not in the prediction."""
    o = order_text(get)
    k = F.col("o_orderkey")
    date, number = F.concat(F.lit("Date: "), F.date_format("o_orderdate", "dd/MM/yyyy")), F.col("ref_line")
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    each = lambda c: F.array_compact(F.collect_list(c))
    t = o.groupBy(F.col("o_custkey").cast("string").alias("stem")).agg(F.concat(each(F.when(k % 4 > 0, block("date", date))), each(F.when(k % 5 > 0, block("doc_number", number)))).alias("blocks"))
    t = t.select("stem", F.struct(F.lit("clean").alias("level")).alias("augment"), F.lit("en").alias("lang"), "blocks")
    number_ref = F.struct(F.lit("self").alias("role"), F.concat("o_custkey", F.lit("/"), k).alias("value_latin"))
    p = o.groupBy(F.col("o_custkey").cast("string").alias("stem")).agg(each(F.when(k % 3 > 0, F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("normalized")))).alias("dates"), each(number_ref).alias("doc_numbers"))
    p = p.select("stem", F.struct("dates", "doc_numbers").alias("metadata"), F.create_map(F.lit("total"), F.lit(1.0)).alias("timings_s"), F.struct(F.lit(False).alias("needs_review"), F.lit(1.0).alias("page_score")).alias("review"), F.array().cast("array<struct<order:int,id:string,type:string,text:string>>").alias("blocks"))
    f = t.select("stem", F.lit(0).alias("pos"), F.lit(0).alias("pred_order"), F.lit("date").alias("type"), F.lit("").alias("ref"))
    return E.page_facts(t, p, f).select("stem", *(F.col(c).cast("long").alias(c) for c in ("dates_found", "dates_total", "docno_found", "docno_total")))


@query(
    "q32_image_recall",
    f"""
WITH hits AS ({_iou_sql("EXISTS")}), t AS ({BOX_SQL}), k AS (SELECT doc_id, {KEY_SQL} AS id, l_partkey % 7 AS kind FROM t)
SELECT CASE k.kind WHEN 5 THEN 'stamp' ELSE 'logo' END AS type, count(hits.id) AS hit, count(*) AS n FROM k LEFT JOIN hits ON k.doc_id = hits.doc_id AND k.id = hits.id WHERE k.kind IN (5, 6) GROUP BY k.kind
""",
)
def image_recall(get):
    """Pictures of every page that the prediction has, among boxes that are a little off; truth and prediction are documents, the truth at half the size."""
    a, o = boxes(get("lineitem")).withColumn("id", block_key()), F.col("bbox")
    page = lambda rows, blocks: rows.groupBy(F.col("doc_id").cast("string").alias("stem")).agg(F.collect_list(F.struct("type", blocks.alias("bbox"))).alias("blocks"))
    t = page(a, F.array(*(o[c] / 2 for c in ("x0", "y0", "x1", "y1")))).withColumns({"width_px": F.lit(500), "height_px": F.lit(350)})
    p = page(a, G.box(o.x0 + 15, o.y0 + 5, o.x1 + 15, o.y1 + 5)).withColumn("page", F.struct(F.lit(1000).alias("width_px"), F.lit(700).alias("height_px")))
    some = page(a.where("l_suppkey % 2 = 0"), G.box(o.x0 + 15, o.y0 + 5, o.x1 + 15, o.y1 + 5)).withColumnRenamed("blocks", "found")
    p = p.join(some, "stem", "left").select("stem", "page", F.coalesce("found", F.slice("blocks", 1, 0)).alias("blocks"))
    return E.image_facts(t, p).groupBy("type").agg(F.sum("hit").cast("long").alias("hit"), F.sum("n").cast("long").alias("n"))


@query(
    "q33_worst",
    f"""
SELECT doc_id, pos, CASE WHEN ref = '' THEN CASE WHEN hyp = '' THEN 0.0 ELSE 1.0 END ELSE edits / length(ref) END AS cer FROM ({FACTS_SQL}) ORDER BY cer DESC, doc_id, pos LIMIT 15
""",
)
def worst(get):
    """The fifteen worst lines of all, as the report shows."""
    return facts(get).select("doc_id", "pos", S.cer(F.col("ref"), F.col("hyp")).alias("cer")).orderBy(F.desc("cer"), "doc_id", "pos").limit(15)


@query(
    "q34_owner",
    """
WITH c AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_partkey, l_suppkey AS owner, n FROM c QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) = 1
""",
)
def owner(get):
    c = get("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    m = c.groupBy("l_partkey").agg(F.max(F.struct("n", (-F.col("l_suppkey")).alias("s"))).alias("m"))
    return m.select("l_partkey", (-F.col("m.s")).alias("owner"), F.col("m.n").alias("n"))


@query("q35_batch_report", "SELECT count(*) AS pages, count(*) FILTER (WHERE event_type <> 'error') AS ok, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE value > 50) AS needs_review FROM events")
def batch_report(get):
    return P.batch_report(get("events").select((F.col("event_type") != "error").alias("ok"), (F.col("value") > 50).alias("needs_review")))


@query(
    "q36_word_error_rate",
    """
WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM conversations)
SELECT conv_id, turn, CASE WHEN len(ws) = 0 THEN 0.0 ELSE len(list_filter(ws, lambda x: length(x) % 3 = 0)) / len(ws) END AS wer FROM w
""",
)
def word_error_rate(get):
    """Whole texts against what is left of them without the words whose length is a multiple of three: each is one edit."""
    words = F.filter(F.split("text", r"(?U)\s+"), lambda w: F.char_length(w) % 3 != 0)
    return get("conversations").select("conv_id", "turn", S.wer(F.col("text"), F.array_join(words, " ")).alias("wer"))


@query(
    "q37_clean_output",
    """
SELECT item_id, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) || chr(10) || 'QXZ over' AS text, 'repetition_truncated' AS flags FROM benchmark
""",
)
def clean_output(get):
    """Whole texts as a model might give them: fenced, and with a phrase said over and over at the end."""
    raw = F.concat(F.lit("```text\n"), F.trim("text"), F.lit("\n"), F.repeat(F.lit("QXZ over "), 6), F.lit("\n```"))
    return get("benchmark").select("item_id", T.cleaned_output(raw, F.lit("text")).alias("c")).select("item_id", "c.text", F.array_join("c.flags", ",").alias("flags"))


@query("q38_bidi_runs", f"SELECT doc_id, md5({ARABIC_SQL}) AS text_md5, true AS lossless FROM documents")
def bidi_runs(get):
    """Runs of every text, checked to lose nothing."""
    t = arabic(F.col("text"), F.col("doc_id"))
    d = get("documents").select("doc_id", t.alias("t"), T.bidi_run_array(t, F.lit("rtl")).alias("r"))
    whole = F.array_join(F.transform("r", lambda x: x.text), "")
    return d.select("doc_id", F.md5(whole).alias("text_md5"), (whole == F.col("t")).alias("lossless"))


@query(
    "q39_set_operators",
    """
SELECT 'union' AS op, count(*) AS n FROM (SELECT page_id AS k FROM pages UNION ALL SELECT doc_id FROM documents)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT page_id AS k FROM pages INTERSECT SELECT doc_id FROM documents)
UNION ALL SELECT 'except', count(*) FROM (SELECT doc_id AS k FROM documents EXCEPT SELECT page_id FROM pages)
""",
)
def set_operators(get):
    a, b = get("pages").select(F.col("page_id").alias("k")), get("documents").select(F.col("doc_id").alias("k"))
    count = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return count(a.unionByName(b), "union").unionByName(count(a.intersect(b), "intersect")).unionByName(count(b.subtract(a), "except"))


@query("q40_source_digest", "SELECT page_id, sha256(html) AS sha256, regexp_matches(lower(url), '[.](jpg|jpeg|png|heic|heif|tif|tiff|bmp|webp)$') AS is_image FROM pages")
def source_digest(get):
    return get("pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.lower("url").rlike(f"[.]({'|'.join(M.IMAGE_SUFFIXES)})$").alias("is_image"))


@query(
    "q41_arbitration",
    """
WITH r AS (
  SELECT l_linenumber, CASE WHEN l_linenumber = 1 THEN '' WHEN l_linenumber = 2 THEN 'total ' || l_partkey ELSE 'plain words' END AS p,
         CASE WHEN l_linenumber = 2 THEN 'total ' || (l_partkey + 1) ELSE 'plain words' END AS s, 1 - CAST(round(l_discount * 100) AS INTEGER) * 5 / 100.0::DOUBLE AS c FROM lineitem
)
SELECT l_linenumber, CASE WHEN l_linenumber = 1 AND c >= 0.6 THEN 'secondary' WHEN l_linenumber = 2 AND c >= 0.75 THEN 'secondary' ELSE 'primary' END AS source_engine, count(*) AS n FROM r GROUP BY ALL
""",
)
def arbitration(get):
    n = F.col("l_linenumber")
    d = get("lineitem").select(
        n, F.lit("paragraph").alias("type"), F.lit("vlm").alias("p_name"), F.lit("primary").alias("p_engine"), F.lit(0.9).alias("p_conf"),
        F.when(n == 1, "").when(n == 2, F.concat(F.lit("total "), "l_partkey")).otherwise("plain words").alias("p_text"),
        F.lit("tesseract").alias("s_name"), F.lit("secondary").alias("s_engine"), (1 - F.round(F.col("l_discount") * 100).cast("int") * 5 / 100.0).alias("s_conf"),
        F.when(n == 2, F.concat(F.lit("total "), F.col("l_partkey") + 1)).otherwise("plain words").alias("s_text"), F.array().cast("array<string>").alias("flags"),
    )
    return P.arbitrated(d, compose=False).groupBy("l_linenumber", "source_engine").agg(F.count("*").alias("n"))


@query(
    "q42_positional_types",
    f"""
WITH t AS ({BOX_SQL}), k AS (
  SELECT *, CASE l_partkey % 7 {" ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(TYPES))} END AS type FROM t
), b AS (
  SELECT *, max(CASE WHEN type IN ('header', 'logo') AND y1 < 0.22 * 700 THEN y1 END) OVER (PARTITION BY doc_id) AS band FROM k
), a AS (
  SELECT *, CASE WHEN type IN ('paragraph', 'title') AND band IS NOT NULL AND (y0 + y1) / 2 < band AND y1 < 0.22 * 700 THEN 'header'
                 WHEN type IN ('paragraph', 'title') AND y0 > 0.6 * 700 * 1.55 THEN 'footer' ELSE type END AS type1 FROM b
), z AS (
  SELECT *, CASE WHEN type1 = 'paragraph' AND abs((x0 + x1) / 2 - 500) < 40 AND x1 - x0 < 600 THEN 'title' ELSE type1 END AS type2 FROM a
)
SELECT type, type2 AS refined, count(*) AS n FROM z GROUP BY ALL
""",
)
def positional_types(get):
    b = boxes(get("lineitem")).withColumn("was", F.col("type")).withColumn("text", F.lit("one line")).withColumn("page_w", F.lit(1000.0)).withColumn("page_h", F.lit(700.0))
    return P.positional_types(b).groupBy(F.col("was").alias("type"), F.col("type").alias("refined")).agg(F.count("*").alias("n"))


@query(
    "q43_rates_by_grouping",
    f"""
WITH f AS (SELECT source AS type, lang, CAST(doc_id % 3 AS VARCHAR) AS level, CASE WHEN ref = '' THEN CASE WHEN hyp = '' THEN 0.0 ELSE 1.0 END ELSE edits / length(ref) END AS cer, edits, length(ref) AS n FROM ({FACTS_SQL})),
r AS (SELECT 'by_type' AS grouping, type AS key, * FROM f UNION ALL SELECT 'by_lang', lang, * FROM f UNION ALL SELECT 'by_level', level, * FROM f UNION ALL SELECT 'by_page_lang', lang, * FROM f
      UNION ALL SELECT 'by_level_lang', level || '/' || lang, * FROM f UNION ALL SELECT 'overall', 'all', * FROM f)
SELECT grouping, key, count(*) AS n, round(sum(cer * n) / greatest(sum(n), 1), 9) AS cer, round(avg(cer), 9) AS wer, CAST(avg(CASE WHEN level = '0' THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS type_acc FROM r GROUP BY grouping, key
""",
)
def rates_by_grouping(get):
    """The evaluation's own aggregate over all lines: six groupings in one pass."""
    f, level = facts(get), (F.col("doc_id") % 3).cast("string")
    f = f.select(F.col("source").alias("type"), "lang", level.alias("level"), F.col("lang").alias("page_lang"), "ref", S.cer(F.col("ref"), F.col("hyp")).alias("cer"), F.col("source").alias("pred_type"), F.when(level == "0", F.col("source")).otherwise("none").alias("type_"))
    got = E.rates(f.select("*", F.col("cer").alias("cer_nodiac"), F.col("cer").alias("wer")))
    return got.select("grouping", "key", "n", F.round("cer", 9).alias("cer"), F.round("wer", 9).alias("wer"), "type_acc")


def scored_blocks(get) -> DataFrame:
    """Recognised and scored blocks of every order's page, as they come from arbitration."""
    n = F.col("l_linenumber")
    text = (
        F.when(n == 1, F.concat(F.lit("Ref. No.: "), "l_partkey", F.lit("/"), "l_suppkey"))
        .when(n == 2, F.concat(F.lit("Date: "), F.date_format("l_shipdate", "dd/MM/yyyy")))
        .when(n == 3, F.concat(F.lit("Ref. No.: "), "l_suppkey", F.lit("\nDate: "), F.date_format("l_shipdate", "dd/MM/yyyy")))
        .otherwise(F.concat(F.lit("plain words about part "), "l_partkey"))
    )
    x0, y0 = F.col("l_partkey") % 800, n * 97 % 600
    none = F.array().cast("array<string>")
    return get("lineitem").select(
        F.col("l_orderkey").cast("string").alias("doc_id"), block_key().alias("id"), F.get(F.array(*map(F.lit, TYPES)), (F.col("l_partkey") % 7).cast("int")).alias("type"),
        G.box(x0, y0, x0 + 40 + F.col("l_suppkey") % 200, y0 + 20 + F.col("l_quantity").cast("int")).alias("bbox"), text.alias("text"), F.lit(None).cast("string").alias("html"),
        (1 - F.col("l_discount")).alias("confidence"), (F.col("l_discount") > 0.085).alias("needs_review"), none.alias("review_reasons"), F.lit("en").alias("lang"), F.lit("ltr").alias("direction"),
        F.lit("engine").alias("source_engine"), F.lit("model").alias("source"), F.lit(0.9).alias("score"), F.array().cast("array<struct<engine:string,text:string,html:string,confidence:double,mean_logprob:double,seconds:double>>").alias("alternatives"),
        F.lit(24.0).alias("line_height_px"), F.lit(1000).alias("page_w"), F.lit(700).alias("page_h"), F.lit(None).cast(f"array<{M.BOX}>").alias("lines"), F.lit(None).cast("string").alias("image_path"),
    )


@query("q44_finished_documents")
def finished_documents(get):
    """Everything after recognition, for every page: splits, duplicates, types, order, styles, metadata, review, nested documents."""
    from vellum import pipeline

    qa = F.struct(
        F.lit(1000).alias("width_px"), F.lit(700).alias("height_px"), F.lit(100.0).alias("blur_laplacian_var"), F.lit(0.0).alias("glare_ratio"), F.lit(1.0).alias("document_coverage"),
        F.lit(150.0).alias("estimated_dpi"), F.lit(True).alias("boundary_found"), F.array().cast("array<string>").alias("warnings"),
    )
    pages = get("lineitem").select(F.col("l_orderkey").cast("string").alias("doc_id")).distinct().select(
        "doc_id", F.lit("p").alias("path"), F.lit("0").alias("sha256"), F.lit(1000).alias("width_px"), F.lit(700).alias("height_px"), F.lit(1000).alias("page_w"), F.lit(700).alias("page_h"),
        F.lit(297.0).alias("width_mm"), F.lit(210.0).alias("height_mm"), F.lit("A4").alias("paper"), F.lit(0).alias("rotation"), qa.alias("qa"), F.create_map(F.lit("total"), F.lit(0.0)).alias("timings"), F.lit(None).cast("string").alias("error"),
    )
    d = pipeline.finished(scored_blocks(get), pages)
    return d.select("stem", F.size("blocks").alias("n_blocks"), F.size("metadata.dates").alias("n_dates"), F.size("metadata.doc_numbers").alias("n_numbers"), "review.page_score", "review.needs_review", "page.direction")


# ---- functions of boxes, texts and scores over whole tables ----

TYPE_SQL = f"CASE l_partkey % 7 {' '.join(f'WHEN {i} THEN {chr(39)}{t}{chr(39)}' for i, t in enumerate(TYPES))} END"


@query(
    "q45_box_algebra",
    f"""
WITH t AS ({BOX_SQL}), s AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM t)
SELECT doc_id, {KEY_SQL} AS id, w, h, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, w * h AS area, [x0, y0, x1, y1] AS corners, x0 + w * 0.25::DOUBLE AS inner_x0, y1 - h * 0.25::DOUBLE AS inner_y1,
       least(x1, 500.0::DOUBLE) - least(x0, 500.0::DOUBLE) AS on_page, CASE WHEN (x0 + x1) / 2 / 1000 < 0.36::DOUBLE THEN 'left' WHEN (x0 + x1) / 2 / 1000 > 0.64::DOUBLE THEN 'right' ELSE 'center' END AS band
FROM s
""",
)
def box_algebra(get):
    b = F.col("bbox")
    small, cut = G.shrink(b, 0.25), G.clip(b, F.lit(500.0), F.lit(300.0))
    return boxes(get("lineitem")).select(
        "doc_id", block_key().alias("id"), G.width(b).alias("w"), G.height(b).alias("h"), G.center_x(b).alias("cx"), G.center_y(b).alias("cy"), G.area(b).alias("area"), G.as_array(b).alias("corners"),
        small.x0.alias("inner_x0"), small.y1.alias("inner_y1"), G.width(cut).alias("on_page"), G.band(b, F.lit(1000.0)).alias("band"),
    )


@query("q46_page_extents", f"WITH t AS ({BOX_SQL}) SELECT doc_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM t GROUP BY doc_id")
def page_extents(get):
    return boxes(get("lineitem")).groupBy("doc_id").agg(G.union_agg(F.col("bbox")).alias("u")).select("doc_id", "u.x0", "u.y0", "u.x1", "u.y1")


@query(
    "q47_paper",
    """
WITH s AS (SELECT DISTINCT p_size + 49.0::DOUBLE AS w, (p_partkey % 90) + 50.0::DOUBLE AS h FROM part), r AS (SELECT *, greatest(w, h) / least(w, h) AS r, h >= w AS up FROM s)
SELECT w, h, CASE WHEN abs(r / (279.4::DOUBLE / 215.9::DOUBLE) - 1) < 0.015::DOUBLE THEN 'Letter' WHEN r BETWEEN 1.25::DOUBLE AND 1.5::DOUBLE THEN 'A4' END AS paper,
       CASE WHEN abs(r / (279.4::DOUBLE / 215.9::DOUBLE) - 1) < 0.015::DOUBLE THEN CASE WHEN up THEN 215.9::DOUBLE ELSE 279.4::DOUBLE END WHEN up THEN 210.0::DOUBLE ELSE 297.0::DOUBLE END AS width_mm,
       CASE WHEN abs(r / (279.4::DOUBLE / 215.9::DOUBLE) - 1) < 0.015::DOUBLE THEN CASE WHEN up THEN 279.4::DOUBLE ELSE 215.9::DOUBLE END WHEN r BETWEEN 1.25::DOUBLE AND 1.5::DOUBLE THEN CASE WHEN up THEN 297.0::DOUBLE ELSE 210.0::DOUBLE END
            ELSE CASE WHEN up THEN 210.0::DOUBLE ELSE 297.0::DOUBLE END * h / w END AS height_mm
FROM r
""",
)
def paper(get):
    p = get("part").select((F.col("p_size") + 49.0).alias("w"), (F.col("p_partkey") % 90 + 50.0).alias("h")).distinct()
    return p.withColumn("s", G.snap_paper(F.col("w"), F.col("h"))).select("w", "h", "s.paper", "s.width_mm", "s.height_mm")


@query(
    "q48_region_filters",
    f"""
WITH t AS ({BOX_SQL}), s AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h, (x1 - x0) * (y1 - y0) * CAST(round(l_discount * 100) AS INTEGER) / 64.0::DOUBLE AS ink FROM t)
SELECT doc_id, {KEY_SQL} AS id, h >= 0.006::DOUBLE * 600 AND h <= 0.08::DOUBLE * 600 AND w >= 0.012::DOUBLE * 600 AND ink >= 0.06::DOUBLE * w * h AS text_line,
       w >= 0.03::DOUBLE * 3000 AND h >= 0.008::DOUBLE * 5000 AND ink >= 0.0005::DOUBLE * 3000 * 5000 / 10 AND w * h <= 0.2::DOUBLE * 3000 * 5000 AND ink / greatest(w * h, 1.0::DOUBLE) >= 0.01::DOUBLE AND ink >= 0.0005::DOUBLE * 3000 * 5000 AS blob,
       w * h >= 0.0008::DOUBLE * 2000 * 2000 AND ink / (w * h) >= 0.04::DOUBLE AS text_group,
       CASE WHEN w / greatest(h, 1.0::DOUBLE) > 0.7::DOUBLE AND w / greatest(h, 1.0::DOUBLE) < 1.4::DOUBLE AND w > 0.08::DOUBLE * 600 THEN 'stamp' WHEN w * l_linenumber / 8 > 0.55::DOUBLE * w AND l_suppkey % 7 <= 4 AND w > 0.1::DOUBLE * 600 THEN 'signature' ELSE 'handwritten_note' END AS kind
FROM s
""",
)
def region_filters(get):
    b = F.col("bbox")
    w, h = G.width(b), G.height(b)
    ink = w * h * F.round(F.col("l_discount") * 100).cast("int") / 64.0
    return boxes(get("lineitem")).select(
        "doc_id", block_key().alias("id"), G.is_text_line(b, ink, F.lit(600)).alias("text_line"), G.is_coloured_blob(b, ink, F.lit(3000), F.lit(5000)).alias("blob"),
        G.is_text_group(b, ink / (w * h), F.lit(2000), F.lit(2000)).alias("text_group"), G.blob_type(w, h, F.lit(600), F.col("l_suppkey") % 7, w * F.col("l_linenumber") / 8).alias("kind"),
    )


@query(
    "q49_text_signs",
    f"""
WITH l AS (
  SELECT doc_id, pos, ref || CASE WHEN pos % 3 = 0 THEN ' QX 12' WHEN pos % 3 = 1 THEN ' Latinword' ELSE '' END AS t, doc_id % 3 = 0 AS ar FROM ({LINES_SQL})
), c AS (
  SELECT doc_id, pos, ar, t, length(regexp_replace(t, '\\s', '', 'g')) AS n, length(regexp_replace(t, '[^0-9]', '', 'g')) AS digits,
         length(regexp_replace(t, '[^a-z]', '', 'g')) AS low, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up FROM l
)
SELECT doc_id, pos, CASE WHEN n = 0 THEN 0.0 ELSE digits / n END AS digit_share,
       ar AND low - CASE WHEN pos % 3 = 1 THEN 8 ELSE 0 END > 10 AND pos % 3 = 0 AND 2 < 0.25::DOUBLE * low AS suspicious FROM c
""",
)
def text_signs(get):
    """Share of digits, and stray short Latin words in Arabic lines; words in Latin letters are put at the ends of lines."""
    tail = F.when(F.col("pos") % 3 == 0, " QX 12").when(F.col("pos") % 3 == 1, " Latinword").otherwise("")
    t = lines_of(get).select("doc_id", "pos", F.concat("ref", tail).alias("t"))
    return t.select("doc_id", "pos", T.digit_share(F.col("t")).alias("digit_share"), T.suspicious_latin(F.col("t")).alias("suspicious"))


HIJRI = [k for k, n in sorted(M.HIJRI_MONTHS.items(), key=lambda x: (x[1], x[0])) if k == next(j for j, m in sorted(M.HIJRI_MONTHS.items(), key=lambda x: (x[1], x[0])) if m == n)]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


@query(
    "q50_calendars",
    """
SELECT o_orderkey, ['hijri', 'gregorian', 'hijri', 'gregorian'] AS calendars,
       [printf('%04d-%02d-%02d', 1400 + o_orderkey % 60, 1 + o_orderkey % 12, 1 + o_orderkey % 28), printf('%04d-%02d-%02d', 1990 + o_orderkey % 30, 1 + o_orderkey % 12, 1 + o_orderkey % 28),
        printf('%04d-%02d-%02d', 1400 + o_orderkey % 60, 1 + o_orderkey % 12, 1 + o_orderkey % 28), printf('%04d-%02d-%02d', 1990 + o_orderkey % 30, 1 + o_orderkey % 12, 1 + o_orderkey % 28)] AS dates FROM orders
""",
)
def calendars(get):
    """Dates of two calendars, in figures and with the names of months, in Arabic digits for every other order; figures come first."""
    k = F.col("o_orderkey")
    d, m, hy, gy = ((1 + k % 28).cast("string"), (k % 12).cast("int"), (1400 + k % 60).cast("string"), (1990 + k % 30).cast("string"))
    month = (m + 1).cast("string")
    name = lambda names: F.get(F.array(*map(F.lit, names)), m)
    text = F.concat_ws(
        " ; ", F.concat(hy, F.lit("/"), month, F.lit("/"), d, F.lit("هـ")), F.concat(d, F.lit("."), month, F.lit("."), gy), F.concat(d, F.lit(" "), name(HIJRI), F.lit(" "), hy), F.concat(d, F.lit(" "), name(MONTHS), F.lit(", "), gy)
    )
    o = get("orders").select(k, F.when(k % 2 == 0, text).otherwise(T.arabic_digits(text)).alias("t"))
    o = o.withColumn("d", T.dates(F.col("t"), F.lit("b")))
    return o.select("o_orderkey", F.transform("d", lambda x: x.calendar).alias("calendars"), F.transform("d", lambda x: x.normalized).alias("dates"))


@query("q51_sizes", "SELECT DISTINCT l_quantity AS q, least(greatest(round_even(l_quantity / 4 * 2, 0) / 2, 8.0), 28.0)::DOUBLE AS size_pt FROM lineitem")
def sizes(get):
    return get("lineitem").select(F.col("l_quantity").alias("q")).distinct().select("q", S.clamp_size(F.col("q") / 4).alias("size_pt"))


@query(
    "q52_quartiles",
    """
WITH v AS (SELECT l_returnflag AS k, list_sort(list(l_extendedprice)) AS v, count(*) AS n FROM lineitem GROUP BY l_returnflag), p AS (SELECT *, unnest([1, 2, 3]) AS i FROM v), a AS (SELECT *, least(greatest((n + 1) * i / 4.0::DOUBLE, 1.0), n) AS pos FROM p)
SELECT k, n, round(max(CASE WHEN i = 1 THEN q END), 6) AS q1, round(max(CASE WHEN i = 2 THEN q END), 6) AS q2, round(max(CASE WHEN i = 3 THEN q END), 6) AS q3
FROM (SELECT k, n, i, v[floor(pos)::BIGINT] * (1 - (pos - floor(pos))) + coalesce(v[floor(pos)::BIGINT + 1], 0) * (pos - floor(pos)) AS q FROM a) GROUP BY k, n
""",
)
def quartiles(get):
    got = E.exclusive_quartiles(get("lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_extendedprice").alias("v")), "k", "v")
    return got.select("k", F.col("n").cast("long").alias("n"), *(F.round(f"q{i}", 6).alias(f"q{i}") for i in (1, 2, 3)))


@query(
    "q53_text_under_stamps",
    f"""
WITH t AS ({BOX_SQL}), k AS (SELECT *, {KEY_SQL} AS id, {TYPE_SQL} AS type FROM t)
SELECT a.doc_id, a.id, count(*) AS stamps, min(b.x0) AS x0 FROM k a JOIN k b ON a.doc_id = b.doc_id AND {TOUCH_SQL} WHERE a.type IN ('paragraph', 'title', 'header', 'footer') AND b.type = 'stamp' GROUP BY a.doc_id, a.id
""",
)
def text_under_stamps(get):
    b = boxes(get("lineitem")).withColumn("id", block_key())
    return L.suppressed_by_stamps(b).select("doc_id", "id", F.size("stamps").cast("long").alias("stamps"), F.array_min(F.transform("stamps", lambda s: s.x0)).alias("x0"))


@query(
    "q54_bidi_runs_of_lines",
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN ['مرحبا ', 'no' || o_custkey || ' at', ' سلام ٣'] ELSE ['total ', 'مبلغ', ' is ' || o_custkey] END AS texts,
       CASE WHEN o_orderkey % 2 = 0 THEN ['rtl', 'ltr', 'rtl'] ELSE ['ltr', 'rtl', 'ltr'] END AS directions FROM orders
""",
)
def bidi_runs_of_lines(get):
    """Texts and directions of runs: letters decide, digits follow them, spaces between directions take the base."""
    k, even = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 2 == 0
    t = F.when(even, F.concat(F.lit("مرحبا no"), k, F.lit(" at سلام ٣"))).otherwise(F.concat(F.lit("total مبلغ is "), k))
    o = get("orders").select("o_orderkey", T.bidi_run_array(t, F.when(even, "rtl").otherwise("ltr")).alias("r"))
    return o.select("o_orderkey", F.transform("r", lambda x: x.text).alias("texts"), F.transform("r", lambda x: x.direction).alias("directions"))


@query(
    "q55_alignment",
    f"""
WITH t AS ({BOX_SQL}), c AS (SELECT *, (((x0 + x1) / 2) - 100.0::DOUBLE) / 800.0::DOUBLE AS c FROM t)
SELECT doc_id, {KEY_SQL} AS id, CASE WHEN x1 > 900 - 0.05::DOUBLE * 800 AND x0 < 100 + 0.05::DOUBLE * 800 THEN CASE WHEN doc_id % 2 = 0 THEN 'right' ELSE 'left' END
  WHEN x1 > 900 - 0.06::DOUBLE * 800 THEN 'right' WHEN x0 < 100 + 0.06::DOUBLE * 800 THEN 'left' WHEN c < 0.38::DOUBLE THEN 'left' WHEN c > 0.62::DOUBLE THEN 'right' ELSE 'center' END AS align FROM c
""",
)
def alignment(get):
    side = F.when(F.col("doc_id") % 2 == 0, "rtl").otherwise("ltr")
    return boxes(get("lineitem")).select("doc_id", block_key().alias("id"), P.visual_align(F.col("bbox"), F.lit(100.0), F.lit(900.0), side).alias("align"))


@query(
    "q56_prompts",
    "SELECT p_partkey, CASE p_size % 3 " + " ".join("WHEN {} THEN '{}'".format(i, M.PROMPTS.get(t, M.PROMPTS["text"]).replace("'", "''")) for i, t in enumerate(("table", "handwritten_note", "paragraph"))) + " END AS prompt, CASE p_size % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'h' ELSE 'p' END AS adapter FROM part",
)
def prompts(get):
    kind = F.get(F.array(F.lit("table"), F.lit("handwritten_note"), F.lit("paragraph")), F.col("p_size") % 3)
    adapters = F.create_map(F.lit("table"), F.lit("a"), F.lit("handwritten"), F.lit("h"), F.lit("printed"), F.lit("p"))
    return get("part").select("p_partkey", T.prompt(kind).alias("prompt"), T.adapter(adapters, kind).alias("adapter"))


@query("q57_corners", f"WITH t AS ({BOX_SQL}) SELECT doc_id, {KEY_SQL} AS id, [[x0, y0], [x1, y0], [x1, y1], [x0, y1]] AS corners FROM t WHERE y1 - y0 < x1 - x0")
def corners(get):
    """Corners in any order, put in order again."""
    b = F.col("bbox")
    p = [F.array(b.x0, b.y0), F.array(b.x1, b.y0), F.array(b.x1, b.y1), F.array(b.x0, b.y1)]
    mixed = F.when(F.col("l_linenumber") % 2 == 0, F.array(p[2], p[0], p[3], p[1])).otherwise(F.array(p[3], p[2], p[1], p[0]))
    return boxes(get("lineitem")).where(G.height(b) < G.width(b)).select("doc_id", block_key().alias("id"), G.order_points(mixed).alias("corners"))


@query("q58_missing_predictions", "SELECT CAST(doc_id AS VARCHAR) AS stem FROM documents WHERE doc_id NOT IN (SELECT page_id FROM pages)")
def missing_predictions(get):
    stem = lambda t, c: get(t).select(F.col(c).cast("string").alias("stem"))
    return E.checked(stem("documents", "doc_id"), stem("pages", "page_id"))
