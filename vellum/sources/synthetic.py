"""Letters with known truth, at the level of the document model (no rasteriser is needed): a generator as a DataFrame.

languages x seeds x levels is the one cross product here, and its size is what the caller asks for.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.kernels import geometry as KG
from vellum.kernels import image as KI
from vellum.model import TRUTH
from vellum.operators.tables import Cell, to_html
from vellum.session import prepared

LANGS, LEVELS = ("ar", "en", "mixed"), ("clean", "mild", "hard")
W, H, DPI = 1654, 2339, 200

# Texts of the letters, made up here.
SENTENCES = {
    "ar": ("نود إفادتكم بأنه تم استلام الملف المرفق", "يرجى التكرم بمراجعة البيانات وإبداء الرأي", "وتفضلوا بقبول فائق الاحترام والتقدير"),
    "en": ("We confirm that the enclosed file has been received", "Please review the figures and send your remarks", "We look forward to hearing from you"),
    "mixed": ("تم تحديث نظام ECM إلى الإصدار الجديد", "يرجى إرسال ملف PDF قبل نهاية الشهر", "The report نسخة نهائية is attached"),
}
NAMES = {"ar": ("وزارة الثقافة", "طلب مراجعة"), "en": ("Ministry of Culture", "Request for review"), "mixed": ("وزارة الثقافة", "طلب Review")}


def digits(value, arabic: bool) -> str:
    s = str(value)
    return s.translate(str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩")) if arabic else s


def letter_dates(r: random.Random, arabic: bool) -> tuple[str, str]:
    """A Hijri and a Gregorian date, day first."""
    one = lambda lo, hi: digits(f"{r.randint(1, 28):02d}/{r.randint(1, 12):02d}/{r.randint(lo, hi)}", arabic)
    return one(1440, 1447), one(2018, 2026)


def cost_table(r: random.Random, arabic: bool) -> str:
    """Two header rows with spans and three rows of figures."""
    head = ("المشروع", "التكلفة", "المجموع", "أولى", "ثانية") if arabic else ("Project", "Cost", "Total", "first", "second")
    cells = [Cell(0, 0, 2, 1, head[0], True), Cell(0, 1, 1, 2, head[1], True), Cell(0, 3, 2, 1, head[2], True), Cell(1, 1, 1, 1, head[3], True), Cell(1, 2, 1, 1, head[4], True)]
    for row in range(2, 5):
        a, b = r.randint(10, 900), r.randint(10, 900)
        cells += [Cell(row, c, 1, 1, digits(v, arabic)) for c, v in enumerate((row - 1, a, b, a + b))]
    return to_html(cells)


def page(seed: int, lang: str, level: str, with_table: bool = True, with_stamp: bool = True, with_handwriting: bool = True) -> dict:
    """A letter's truth, blocks in reading order; fewer paragraphs where it would not fit."""
    r = random.Random(f"{seed}-{lang}")
    arabic, rtl = lang != "en", lang != "en"
    for n in (3, 2, 1):
        out: list[dict] = []

        def put(kind, text, x0, y0, x1, y1, **more):
            out.append({"id": f"g{len(out):02d}", "type": kind, "lang": lang if text else None, "bbox": [float(v) for v in (x0, y0, x1, y1)], "text": text, "html": None, "align": None, "size_pt": 13.0, "bold": kind == "title", **more})

        name, title = NAMES[lang]
        put("header", name, 950, 110, 1500, 170)
        put("logo", None, 760, 90, 900, 230)
        a, b = digits(r.randint(1, 9), arabic), digits(r.randint(1000, 9999), arabic)
        put("doc_number", f"{'الرقم' if arabic else 'Ref. No.'}: {a}/{b}", 950, 280, 1500, 330)
        hijri, gregorian = letter_dates(r, arabic)
        put("date", f"التاريخ: {hijri} هـ" if arabic else f"Date: {gregorian}", 950, 350, 1500, 400)
        put("title", title, 600, 480, 1050, 540)
        y = 620
        for _ in range(n):
            text = "\n".join(r.choice(SENTENCES[lang]) for _ in range(r.randint(3, 5)))
            h = 60 * (text.count("\n") + 1)
            put("paragraph", text, 180, y, 1480, y + h, align="right" if rtl else "left")
            y += h + 40
        if with_table:
            put("table", None, 180, y, 1480, y + 360, html=cost_table(r, arabic))
            y += 400
        if with_stamp:
            put("stamp", None, 300, y, 560, y + 260)
        put("signature", None, 1000, y + 40, 1400, y + 200)
        if with_handwriting:
            put("handwritten_note", "للمتابعة" if arabic else "to follow up", 200, 300, 500, 380)
        put("footer", digits(1, arabic), 780, 2230, 860, 2270)
        if y + 260 <= 0.93 * H:
            break
    return {"id": f"{lang}{seed}_{level}", "direction": "rtl" if rtl else "ltr", "lang": lang, "width_px": W, "height_px": H, "dpi": DPI, "blocks": out, "augment": {"level": level}, "image": None}


def truths(spark: SparkSession, per_language: int = 3, levels: tuple = LEVELS, seed: int = 0) -> DataFrame:
    """languages x seeds x levels truth pages, made on the executors."""
    keys = prepared(spark).range(seed, seed + per_language).select("id", F.explode(F.array(*map(F.lit, LANGS))).alias("lang")).select("id", "lang", F.explode(F.array(*map(F.lit, levels))).alias("level"))

    def run(frames):
        import json

        import pandas as pd

        for f in frames:
            yield pd.DataFrame({"doc": [json.dumps(page(int(r.id), r.lang, r.level), ensure_ascii=False) for r in f.itertuples()]})

    return keys.mapInPandas(run, "doc string").select(F.from_json("doc", TRUTH).alias("t")).select(F.col("t.id").alias("stem"), "t.*")


def degraded(img: np.ndarray, level: str, seed: int) -> tuple[np.ndarray, dict]:
    """A photo of a page: uneven light, a little turn, blur and noise; clean pages stay as they are."""
    if level == "clean":
        return img, {"level": level}
    r = np.random.default_rng(seed)
    k = {"mild": 1.0, "hard": 2.0}[level]
    angle = float(r.uniform(-1, 1) * k)
    out = KG.rotate(img, angle).astype(np.float64)
    out *= np.linspace(1 - 0.15 * k, 1, img.shape[1])[None, :, None]
    size = 1 + 2 * int(k)
    out = np.stack([KI.box_mean(out[..., c], size) for c in range(3)], -1) + r.normal(0, 3 * k, out.shape)
    return out.clip(0, 255).astype(np.uint8), {"level": level, "blur_sigma": size / 3.5, "angle": angle}


def composed(page_: np.ndarray, patch: np.ndarray, x: int, y: int) -> np.ndarray:
    """A BGRA patch multiplied onto the page."""
    out = page_.copy()
    h, w = patch.shape[:2]
    part = out[y : y + h, x : x + w].astype(np.float64)
    alpha = patch[: part.shape[0], : part.shape[1], 3:] / 255.0
    ink = patch[: part.shape[0], : part.shape[1], :3] / 255.0
    out[y : y + h, x : x + w] = (part * (1 - alpha + alpha * ink)).astype(np.uint8)
    return out


def noisy_prediction(truth: DataFrame, rate: int = 17) -> DataFrame:
    """A prediction for each truth page: every rate-th character of a text lost; for tests of the evaluation at any size."""
    lost = lambda t: F.regexp_replace(t, f"(?s)(.{{{rate - 1}}}).", "$1")
    box = lambda b: F.struct(*(F.get(b, k).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))))
    blocks = F.transform("blocks", lambda b, i: F.struct(
        b["id"].alias("id"), b["type"].alias("type"), box(b["bbox"]).alias("bbox"), i.cast("int").alias("order"), lost(b["text"]).alias("text"), b["html"].alias("html"),
    ))
    none = F.lit(None)
    return truth.select(
        "stem", F.struct("width_px", "height_px").alias("page"), blocks.alias("blocks"),
        none.cast("struct<dates:array<struct<normalized:string>>,doc_numbers:array<struct<value_latin:string,role:string>>>").alias("metadata"),
        F.create_map(F.lit("total"), F.lit(1.0)).alias("timings_s"), F.struct(F.lit(0.9).alias("page_score"), F.lit(False).alias("needs_review")).alias("review"),
    )
