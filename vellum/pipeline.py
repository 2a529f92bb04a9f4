"""From page images, or recorded engine results, to finished documents: a composition of operators.

Pixels are needed up to recognition; everything later runs on rows of blocks, keyed by their page.
A page that fails carries an error and does not end the batch.
"""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum import engines, model as M
from vellum.config import Config, Layout
from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.kernels import geometry as KG
from vellum.kernels import image as KI
from vellum.kernels import regions as KR
from vellum.operators import layout as L
from vellum.operators import order as O
from vellum.operators import post as P
from vellum.operators import tables as TB
from vellum.session import prepared
from vellum.sources import documents as D
from vellum.sources import docx
from vellum.sources import images as IM

@dataclass
class Conversion:
    """Documents, and the tables they were made from."""

    documents: DataFrame
    pages: DataFrame
    regions: DataFrame


PAGES = "doc_id string, path string, sha256 string, width_px int, height_px int, page binary, page_w int, page_h int, width_mm double, height_mm double, paper string, rotation int, qa struct<width_px:int,height_px:int,blur_laplacian_var:double,glare_ratio:double,document_coverage:double,estimated_dpi:double,boundary_found:boolean,warnings:array<string>>, timings map<string,double>, error string"
REGIONS = f"doc_id string, id string, type string, bbox {M.BOX}, score double, source string, image binary, line_height_px double, page_w int, page_h int"


def pages(spark: SparkSession, path: str, cfg: Config = Config()) -> DataFrame:
    """Flat, upright, evenly lit pages with their quality report."""
    raw = IM.load(prepared(spark), path, cfg.runtime.max_image_side)
    names = "doc_id path sha256 width_px height_px page page_w page_h width_mm height_mm paper rotation qa timings error".split()

    def run(frames: Iterable[pd.DataFrame]):
        for f in frames:
            out = []
            for r in f.itertuples():
                row = {**dict.fromkeys(names), "doc_id": r.path.rsplit("/", 1)[-1].rsplit(".", 1)[0], "path": r.path, "sha256": r.sha256, "width_px": r.width_px, "height_px": r.height_px, "error": r.error}
                if not r.error:
                    t0 = time.monotonic()
                    bgr = IM.from_png(r.data)
                    geo = KG.correct(bgr, cfg.geometry)
                    t1 = time.monotonic()
                    qa = KI.with_coverage(KI.assess(bgr, cfg.qa), geo["coverage"], geo["found"], geo["dpi"] / r.scale, cfg.qa)
                    blind = [f"no detector of orientation is installed ({cfg.geometry.orientation}); judged by ink"] if cfg.geometry.orientation not in ("heuristic", "none") and geo["rotation_by"] == "heuristic" else []
                    qa["warnings"] = [*r.warnings, *blind, *qa["warnings"]]
                    page = KI.flatten(geo["page"], cfg.illumination.kernel_frac) if cfg.illumination.enabled else geo["page"]
                    row.update(page=IM.png(page), page_w=page.shape[1], page_h=page.shape[0], width_mm=geo["width_mm"], height_mm=geo["height_mm"], paper=geo["paper"], rotation=geo["rotation"], qa=qa, timings={"geometry": t1 - t0, "illumination": time.monotonic() - t1})
                out.append(row)
            yield pd.DataFrame(out, columns=names, dtype=object)

    return raw.mapInPandas(run, PAGES)


def detect(page: np.ndarray, cfg: Layout = Layout()) -> list[tuple[str, tuple, float, str]]:
    """Regions without a model: groups of lines, coloured ink, rings."""
    return [(r.type, r.box, r.score, r.source) for r in KR.analysed(page, [], cfg.detect_ink_colors, cfg.fill_uncovered_text)]


def regions(pages_: DataFrame, detections: DataFrame | None = None, cfg: Layout = Layout()) -> DataFrame:
    """Regions of each page with their crops. detections (doc_id, label, score, x0, y0, x1, y1): a model's boxes, which are looked at more closely and filled up with what they miss."""
    if detections is not None:
        found = detections.where(F.col("score") >= cfg.threshold).select("doc_id", F.struct(L.typed(F.col("label")).alias("type"), F.array("x0", "y0", "x1", "y1").cast("array<double>").alias("bbox"), F.col("score").cast("double").alias("score"), F.concat(F.lit(f"{cfg.model_name}:"), "label").alias("source")).alias("d"))
        given = pages_.join(found.groupBy("doc_id").agg(F.array_sort(F.collect_list("d")).alias("given")), "doc_id", "left")
    else:
        given = pages_.withColumn("given", F.lit(None).cast("array<struct<type:string,bbox:array<double>,score:double,source:string>>"))

    def run(frames: Iterable[pd.DataFrame]):
        for f in frames:
            out = []
            for r in f.itertuples():
                page = IM.from_png(r.page)
                h, w = page.shape[:2]
                model = [KR.Found(d["type"], tuple(d["bbox"]), d["score"], d["source"]) for d in r.given] if r.given is not None else []
                found = KR.analysed(page, model, cfg.detect_ink_colors, cfg.fill_uncovered_text)
                stamps = [x.box for x in found if x.type == "stamp"]
                for n, x in enumerate(found):
                    b, t = x.box, x.type
                    pad = 10 if t == "table" else 6
                    x0, y0, x1, y1 = max(0, int(b[0]) - pad), max(0, int(b[1]) - pad), min(w, int(b[2]) + pad), min(h, int(b[3]) + pad)
                    crop = page[y0:y1, x0:x1]
                    over = [s for s in stamps if L._share(s, b) > 0]
                    if over and t in KR.TEXT:
                        crop = KR.without_stamps(crop, x0, y0, over)
                    lh, _ = KI.line_height(KI.ink_mask(KI.gray(crop)), w) if t not in M.IMAGE_TYPES else (None, None)
                    img = KI.ink_on_transparent(crop) if t in ("stamp", "signature") else KI.whitened(crop) if t in M.IMAGE_TYPES else crop
                    out.append((r.doc_id, f"r{n:03d}", t, dict(zip(("x0", "y0", "x1", "y1"), map(float, b))), x.score, x.source, IM.png(img), lh, w, h))
            yield pd.DataFrame(out, columns="doc_id id type bbox score source image line_height_px page_w page_h".split(), dtype=object)

    return given.where("error is null").select("doc_id", "page", "given").mapInPandas(run, REGIONS)


def asset_path():
    """Where the picture of an image region goes, beside the document; it keeps the region's first id."""
    return F.when(F.col("type").isin(*M.IMAGE_TYPES), F.concat("doc_id", F.lit("_assets/"), "id", F.lit("_"), "type", F.lit(".png")))


def assets(regions_: DataFrame) -> DataFrame:
    """(doc_id, name, content): the pictures of stamps, signatures, logos and figures; ink on a clear ground, or whitened paper."""
    return regions_.where(F.col("type").isin(*M.IMAGE_TYPES)).select("doc_id", asset_path().alias("name"), F.col("image").alias("content"))


def as_docx(documents: DataFrame, regions_: DataFrame) -> DataFrame:
    """(name, content): a .docx for each document, with its pictures."""
    held = assets(regions_).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "content"))).alias("images"))
    rows = documents.join(held, documents["stem"] == held["doc_id"], "left")
    return rows.select(F.col("stem").alias("name"), docx.docx_column(D.as_json(documents), F.col("images")).alias("content"))


def write_stages(found: Conversion, path: str) -> None:
    """The intermediate tables of a conversion, for looking into: pages, regions with crops, documents; a new run replaces them."""
    for name, df in (("pages", found.pages), ("regions", found.regions), ("documents", found.documents)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def from_results(regions_: DataFrame, results: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Blocks from regions and engines' results (role primary or secondary), arbitrated and scored."""
    r = results.withColumnRenamed("block_id", "id")
    one = lambda role, p: r.where(F.col("role") == role).select("doc_id", "id", *(F.col(c).alias(f"{p}_{n}") for c, n in (("text", "text"), ("html", "html"), ("confidence", "conf"), ("engine", "engine"), ("lines", "lines"), ("flags", "flags"), ("seconds", "seconds"))))
    rows = engines.routed(regions_, cfg.recognition).join(one("primary", "p"), ["doc_id", "id"], "left").join(one("secondary", "s"), ["doc_id", "id"], "left")
    rows = rows.withColumn("s_name", F.lit(cfg.recognition.secondary)).withColumn("flags", F.coalesce("p_flags", F.array().cast("array<string>")))
    rows = rows.withColumn("p_conf", F.coalesce("p_conf", F.when(F.col("p_engine").isNull(), 0.0))).withColumn("p_engine", F.coalesce("p_engine", F.lit("none")))
    out = P.arbitrated(rows, cfg.confidence, cfg.recognition.numeric_prefer_classic).withColumn("html", F.col("p_html")).withColumn("lines", F.transform("p_lines", lambda x: x["bbox"]))
    alt = lambda p: F.when(F.col(f"{p}_engine").isNotNull(), F.struct(F.col(f"{p}_engine").alias("engine"), F.col(f"{p}_text").alias("text"), F.col(f"{p}_html").alias("html"), F.col(f"{p}_conf").alias("confidence"), F.lit(None).cast("double").alias("mean_logprob"), F.col(f"{p}_seconds").alias("seconds")))
    out = out.withColumn("image_path", asset_path())
    out = out.withColumn("alternatives", F.array_compact(F.array(alt("p"), alt("s"))))
    text = P.scored(out.where(~F.col("type").isin(*M.IMAGE_TYPES)), cfg.confidence)
    images = out.where(F.col("type").isin(*M.IMAGE_TYPES)).select(
        *out.columns, F.when(F.col("type") == "stamp", F.col("p_conf")).alias("confidence"), F.lit(False).alias("needs_review"), F.array().cast("array<string>").alias("review_reasons"),
        T.language(F.coalesce("text", F.lit(""))).alias("lang"), T.direction(F.coalesce("text", F.lit(""))).alias("direction"),
    )
    return text.unionByName(images)


def finished(blocks: DataFrame, pages_: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Documents from scored blocks: split, deduplicated, typed, ordered, numbered, styled, with metadata and review."""
    b = P.split_lines(blocks)
    b = P.without_duplicates(b)
    b = b.withColumn("type", T.refined_type(F.col("type"), F.col("text")))
    b = P.positional_types(b)
    b = P.with_page_direction(b).join(pages_.select("doc_id", "width_mm"), "doc_id")
    b = P.styled(O.numbered(O.ordered(b)), cfg.docx)
    b = b.withColumn("html_text", F.when(F.coalesce("html", F.lit("")) != "", TB.plain_column(F.coalesce("html", F.lit("")))))
    b = b.withColumn("layout_source", F.col("source")).withColumn("layout_score", F.col("score"))
    fields = "id type bbox order text html image_path lang direction style confidence source_engine layout_source layout_score alternatives needs_review review_reasons line_height_px".split()
    out = P.summarised(b, pages_.where("error is null"), fields, cfg=cfg.confidence)
    none = F.array().cast("array<string>")
    return out.select(
        F.col("doc_id").alias("stem"), F.lit(M.SCHEMA_VERSION).alias("schema_version"), F.struct("path", "sha256", "width_px", "height_px").alias("source"),
        F.struct(F.col("page_w").alias("width_px"), F.col("page_h").alias("height_px"), "width_mm", "height_mm", (F.col("page_w") / F.col("width_mm") * 25.4).alias("dpi"), F.coalesce("page_direction", F.lit("rtl")).alias("direction"), F.col("rotation").alias("rotation_applied"), "paper").alias("page"),
        "blocks", F.struct("doc_numbers", "dates", "stamp_texts", F.coalesce("languages", none).alias("languages")).alias("metadata"), "qa",
        F.struct(F.coalesce("page_score", F.lit(0.0)).alias("page_score"), F.coalesce("needs_review", F.lit(True)).alias("needs_review"), F.coalesce("reasons", F.array(F.lit("no text recognized"))).alias("reasons")).alias("review"),
        F.col("timings").alias("timings_s"), F.lit(cfg.digest()).alias("config_digest"),
    )


def convert(spark: SparkSession, path: str, cfg: Config = Config(), results: DataFrame | None = None, detections: DataFrame | None = None) -> Conversion:
    """All images under a path. results: recorded engine results instead of running the engines."""
    ps = pages(spark, path, cfg)
    rs = regions(ps, detections, cfg.layout)
    if results is None:
        crops = rs.withColumnRenamed("id", "block_id").withColumn("direction", F.lit("rtl")).where(~F.col("type").isin("signature", "logo", "figure"))
        run = lambda name, role: engines.recognized(crops, name, cfg.recognition).withColumn("role", F.lit(role))
        results = by_type_results(spark, crops, cfg)
        if cfg.recognition.secondary not in ("none", cfg.recognition.primary):
            results = results.unionByName(run(cfg.recognition.secondary, "secondary"))
        results = with_tables_read_again(results, crops, from_results(rs, results, cfg), cfg)
    return Conversion(finished(from_results(rs, results, cfg), ps, cfg), ps, rs)


def by_type_results(spark: SparkSession, crops: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Primary results where types go to engines of their own: one pass for each engine over its crops."""
    rows, out = engines.routed(crops, cfg.recognition), None
    for name in sorted({cfg.recognition.primary, *cfg.recognition.primary_by_type.values()} - {"none"}):
        part = engines.recognized(rows.where(F.col("p_name") == name).drop("p_name"), name, cfg.recognition).withColumn("role", F.lit("primary"))
        out = part if out is None else out.unionByName(part)
    return out


def read_tables_again(crops: DataFrame, directions: DataFrame, hint: str, cfg: Config = Config()) -> DataFrame:
    """Results for table crops of pages whose direction turned out other than the hint, by each table's own engine; only their html and lines are to be used."""
    other = directions.where(F.col("page_direction") != hint)
    again = crops.where("type = 'table'").drop("direction").join(other.select("doc_id", F.col("page_direction").alias("direction")), "doc_id")
    return by_type_results(crops.sparkSession, again.select(*crops.columns), cfg)


def with_tables_read_again(results: DataFrame, crops: DataFrame, blocks: DataFrame, cfg: Config = Config(), hint: str = "rtl") -> DataFrame:
    """results with the html of tables as it reads in their page's own direction, where that is not what they were read with."""
    again = read_tables_again(crops, P.page_directions(blocks, hint=hint), hint, cfg)
    new = again.select("doc_id", "block_id", F.lit("primary").alias("role"), F.col("html").alias("_html"), F.col("text").alias("_text"))
    both = results.join(new, ["doc_id", "block_id", "role"], "left")
    had = F.col("_html").isNotNull()
    return both.select(*(F.when(had, F.col("_html")).otherwise(F.col("html")).alias("html") if c == "html" else F.when(had, F.col("_text")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in results.columns))


def report(documents: DataFrame, pages_: DataFrame) -> DataFrame:
    """The batch in one row."""
    rows = pages_.select(F.col("doc_id").alias("stem"), "error").join(documents.select("stem", F.col("review.needs_review").alias("needs_review")), "stem", "left")
    return P.batch_report(rows.select(F.col("error").isNull().alias("ok"), "needs_review"))
